"""The change feed by tokens and the keyed table that it is merged into: crashes, a held tail, pages that come again."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trellis.operators.feed import applied
from trellis.sources.change_feed import feed, feed_page, hold, publish, release, start_token
from trellis.sources.store import Store
from trellis.streaming.changes import merge_stream, state_of
from trellis.streaming.mirror import refresh

SCHEMA = "seq long, removed boolean, id long, name string"
ROWS = "id long, name string"


def changes_of(spark, first, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + i, rng.random() < 0.3, rng.randrange(40), f"v{first + i}") for i in range(n)], SCHEMA)


def expected(spark, *parts):
    log = parts[0]
    for p in parts[1:]:
        log = log.union(p)
    return sorted(map(tuple, applied(spark.createDataFrame([], ROWS), log, "id", "seq", F.col("removed")).collect()))


def files_of(folder):
    return {str(p) for p in Path(folder).rglob("*.parquet")}


def test_tokens_hold_the_tail_and_nothing_is_skipped(spark, tmp_path):
    log, schema = f"file://{tmp_path}/log", spark.createDataFrame([], SCHEMA).schema
    assert start_token(log) == -1
    a, b = changes_of(spark, 0, 2500, 1), changes_of(spark, 2500, 700, 2)
    publish(a, log, files=3)
    assert hold(log) == 2499
    publish(b, log)
    assert start_token(log) == 2499
    page, token = feed_page(spark, log, schema, -1)
    assert token == "2499" and sorted(r["seq"] for r in page.collect()) == list(range(2500))
    assert page.rdd.getNumPartitions() >= 3
    page, token = feed_page(spark, log, schema, 2600)  # a token from before the hold was taken
    assert token == "2600" and page.count() == 0
    release(log)
    page, token = feed_page(spark, log, schema, 2499)
    assert token == "3199" and sorted(r["seq"] for r in page.collect()) == list(range(2500, 3200))
    with pytest.raises(Exception, match="no page begins at token 4000"):
        feed_page(spark, log, schema, 4000)[0].count()
    with pytest.raises(RuntimeError):
        publish(a, log)
    publish(a.limit(0), log)
    assert start_token(log) == 3199


def test_crashes_between_merge_and_offsets_end_in_the_same_table(spark, tmp_path, monkeypatch):
    log, folder, offsets = (f"file://{tmp_path}/{n}" for n in ("log", "table", "offsets"))
    schema = spark.createDataFrame([], SCHEMA).schema
    parts = [changes_of(spark, 300 * i, 300, i) for i in range(4)]
    run = lambda: merge_stream(feed(spark, log, schema, page="50"), folder, offsets, "id", "seq", "removed", buckets=8, most_parts=2).awaitTermination()
    rows = lambda: sorted(map(tuple, state_of(spark, folder, spark.createDataFrame([], ROWS).schema).collect()))
    publish(parts[0], log)
    run()
    assert rows() == expected(spark, parts[0])
    merge = Store.merge

    def before(self, *args):
        raise OSError("lost before the commit")

    def behind(self, *args):
        merge(self, *args)
        raise OSError("lost behind the commit")

    for crash, part in ((before, parts[1]), (behind, parts[2])):
        publish(part, log)
        monkeypatch.setattr(Store, "merge", crash)
        with pytest.raises(Exception, match="lost"):
            run()
        monkeypatch.setattr(Store, "merge", merge)
        run()
    assert rows() == expected(spark, *parts[:3])
    hold(log)
    publish(parts[3], log)
    run()
    assert rows() == expected(spark, *parts[:3])
    release(log)
    run()
    assert rows() == expected(spark, *parts)
    # all pages again, from the first token and with offsets of its own
    merge_stream(feed(spark, log, schema), folder, f"file://{tmp_path}/again", "id", "seq", "removed").awaitTermination()
    assert rows() == expected(spark, *parts)


def test_a_merge_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t")
    store.keyed("rows", spark.range(1000).select("id", F.lit("old").alias("name")), "id", 16)
    before = files_of(tmp_path)
    assert len(before) == 16
    change = spark.createDataFrame([(1, False, 5, "a"), (2, False, 5, "b"), (3, True, 6, None), (4, False, 5000, "new")], SCHEMA)
    store.merge("rows", change, F.col("seq"), F.col("removed"), {"token": "4"})
    assert before < (now := files_of(tmp_path)) and len(now - before) <= 3 and store.meta("token") == "4"
    got = {r["id"]: r["name"] for r in store.table("rows").collect()}
    assert len(got) == 1000 and got[5] == "b" and 6 not in got and got[5000] == "new" and got[7] == "old"
    for _ in range(3):
        store.merge("rows", change, F.col("seq"), F.col("removed"))
    assert {r["id"]: r["name"] for r in store.table("rows").collect()} == got
    before = files_of(tmp_path)
    touched = store.compact("rows", 3)
    assert 1 <= len(touched) <= 3 and len(files_of(tmp_path) - before) <= len(touched)
    assert {r["id"]: r["name"] for r in store.table("rows").collect()} == got
    assert store.compact("rows", 3) == []
    store.vacuum()
    assert {r["id"]: r["name"] for r in store.table("rows").collect()} == got and len(files_of(tmp_path)) <= 16
    store.merge("rows", change.limit(0), F.col("seq"), F.col("removed"))
    assert {r["id"]: r["name"] for r in store.table("rows").collect()} == got
    store.reset("rows")
    assert store.table("rows").count() == 0


def test_two_writers_of_one_number(spark, tmp_path):
    one, other = (Store(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.commit({"t": spark.range(1)})
    number, now = one._read()
    other.commit({"t": spark.range(2)})
    with pytest.raises(RuntimeError):
        one._name(number, now, None)
    assert one.table("t").count() == 2


def test_a_mirror_reads_the_feed_by_its_token(spark, tmp_path):
    node = "file_id string, parent_id string, name string"
    log, store = f"file://{tmp_path}/log", Store(spark, f"file://{tmp_path}/mirror")
    schema = spark.createDataFrame([], "seq long, removed boolean, " + node).schema
    refreshed = lambda: refresh(store, lambda: str(start_token(log)), lambda: spark.createDataFrame([("a", "root", "A")], node), lambda t: feed_page(spark, log, schema, int(t)), None, "root")
    refreshed()
    publish(spark.createDataFrame([(0, False, "b", "a", "B"), (1, False, "z", "lost", "Z")], schema), log)
    hold(log)
    publish(spark.createDataFrame([(2, True, "b", None, None)], schema), log)
    refreshed()
    assert {r["file_id"] for r in store.table("nodes").collect()} == {"a", "b"} and store.meta("page_token") == "1"
    release(log)
    refreshed()
    assert {r["file_id"] for r in store.table("nodes").collect()} == {"a"} and store.meta("page_token") == "2"
