"""Counters and silences: the batch forms against plain loops, and the stream with timers against the batch forms."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trellis.operators.watching import latched, silences, since
from trellis.streaming.changes import change_stream
from trellis.streaming.watching import STALE, watched

START = datetime(2024, 1, 1)
KINDS = ["wake", "wake", "wake", "cycle", "failed", "failed", "failed", "ok", "beat"]


def log_of(n, seed, machines="mmmmno"):
    rng, at, out = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 2, 5, 29, 31, 40]), microseconds=rng.randrange(1000))
        out.append((rng.choice(machines), i, at, rng.choice(KINDS)))
    return out


def by_hand(log):
    pending, failures, out = {}, {}, {}
    for m, i, _, kind in log:
        pending[m] = 0 if kind == "cycle" else pending.get(m, 0) + (kind == "wake")
        failures[m] = failures.get(m, 0) + 1 if kind == "failed" else 0 if kind == "ok" else failures.get(m, 0)
        out[i] = (m, pending[m], failures[m], failures[m] >= 3)
    return out


SCHEMA = "machine string, seq long, ts timestamp, kind string"


def test_counters_over_many_ranges(spark):
    log = log_of(900, 1)
    events = spark.createDataFrame(log, SCHEMA)
    expected = by_hand(log)
    got = since(events, "machine", "seq", F.col("kind") == "wake", F.col("kind") == "cycle", "pending", block_rows=20)
    assert {r["seq"]: (r["machine"], r["pending"]) for r in got.collect()} == {i: x[:2] for i, x in expected.items()}
    counted = events.where("kind in ('failed', 'ok')")
    got = latched(counted, "machine", "seq", F.col("kind") == "failed")
    assert {r["seq"]: (r["machine"], r["failures"], r["latched"]) for r in got.collect()} == {i: (x[0], *x[2:]) for i, x in expected.items() if log[i][3] in ("failed", "ok")}
    assert since(events.limit(0), "machine", "seq", F.lit(True), F.lit(False), "n").collect() == []
    odd = spark.createDataFrame([(None, 1, "wake"), (None, 2, None), ("a", 3, "wake")], "machine string, seq long, kind string")
    assert {r["seq"]: r["n"] for r in since(odd.where("machine = 'a'"), "machine", "seq", F.col("kind") == "wake", F.col("kind") == "cycle", "n").collect()} == {3: 1}


def silent(log, micros, until):
    times = {}
    for m, _, at, _ in log:
        times.setdefault(m, set()).add(at)
    out = set()
    for m, of in times.items():
        of = sorted(of)
        for a, b in zip(of, [*of[1:], None]):
            if ((b or until) - a) > timedelta(microseconds=micros):
                out.add((m, a, b))
    return out


def test_silences_over_many_ranges(spark):
    log = log_of(600, 2)
    until = log[-1][2] + timedelta(seconds=10)
    got = silences(spark.createDataFrame(log, SCHEMA).union(spark.createDataFrame([("m", -1, None, "beat")], SCHEMA)), "machine", "ts", 30_000_000, F.lit(until))
    assert {tuple(r) for r in got.collect()} == silent(log, 30_000_000, until)


def test_the_stream_says_what_the_batch_says(spark, tmp_path):
    log = log_of(400, 3)
    # one last event far behind moves the watermark past all silences
    end = ("z", 400, log[-1][2] + timedelta(hours=1), "beat")
    batches = [log[:150], log[150:160], log[160:330], log[330:], [end], [("z", 401, end[2] + timedelta(seconds=1), "beat")]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    stream = change_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], SCHEMA).schema)
    writer = watched(stream, "machine", "ts").writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/offsets")
    writer.trigger(availableNow=True).start().awaitTermination()
    events = {r["seq"]: (r["machine"], r["pending"], r["failures"], r["latched"]) for r in seen if r["what"] != STALE}
    assert {i: x for i, x in events.items() if i < 400} == by_hand(log)
    stale = sorted((r["machine"], r["at"]) for r in seen if r["what"] == STALE)
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert stale == sorted((m, micros(a) + 30_000_000) for m, a, _ in silent(log, 30_000_000, end[2]))
