from pyspark.sql import functions as F

from trellis.sources.store import Store
from trellis.streaming.changes import change_stream, telling
from trellis.streaming.folds import folded_stream
from trellis.streaming.mirror import TOKEN, rebuild, refresh

NODE = "file_id string, parent_id string, name string"


def test_a_walk_and_then_increments(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}/mirror"), []
    rows = lambda: spark.createDataFrame([("a", "root", "A"), ("b", "a", "B"), ("z", "lost", "Z")], NODE)

    def feed(token):
        at = int(token)
        return spark.createDataFrame(log[at:], "seq long, removed boolean, " + NODE), str(len(log))

    def names():
        return {r["file_id"]: r["name"] for r in store.table("nodes").collect()}

    token = lambda: str(len(log))
    refresh(store, token, rows, feed, None, "root")
    assert names() == {"a": "A", "b": "B"} and store.meta(TOKEN) == "0"
    log += [(0, False, "c", "a", "C"), (1, False, "b", "a", "B2"), (2, True, "c", None, None), (3, False, "d", "gone", "D")]
    for _ in range(2):
        refresh(store, token, rows, feed, None, "root")
        assert names() == {"a": "A", "b": "B2"} and store.meta(TOKEN) == "4"
    rebuild(store, token, rows)
    assert set(names()) == {"a", "b", "z"} and store.meta(TOKEN) == "4"


def test_a_change_during_the_walk_is_met_again(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}/mirror"), []

    def walk():
        log.append((0, False, "a", "root", "new"))
        return spark.createDataFrame([("a", "root", "old")], NODE)

    refresh(store, lambda: str(len(log)), walk, lambda t: (spark.createDataFrame(log[int(t):], "seq long, removed boolean, " + NODE), str(len(log))), None, "root")
    assert [tuple(r) for r in store.table("nodes").select("file_id", "name").collect()] == [("a", "new")]


def test_runs_go_on_from_batch_to_batch(spark, tmp_path):
    schema = "id long, machine string, kind string, path string, ts long"
    batches = [[(1, "m", "up", "x", 10), (2, "m", "up", "x", 11), (3, "n", "up", None, 12)], [(4, "m", "up", "x", 13), (5, "m", "error", None, 14), (6, "n", "up", None, 15), (7, "m", "up", "x", 16)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    stream = change_stream(spark, str(tmp_path / "log"), spark.createDataFrame([], schema).schema)
    query = folded_stream(stream, "machine", ["kind", "path"], "id", "ts").writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect())))
    query.option("checkpointLocation", f"file://{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
    last = {(r[0], r[1]): r[2:] for r in seen}
    assert last == {("m", 1): ("up", "x", 13, 3), ("m", 5): ("error", None, 14, 1), ("m", 7): ("up", "x", 16, 1), ("n", 3): ("up", None, 15, 2)}


def test_events_that_are_worth_a_cycle(spark):
    rows = [("/r", "write"), ("/r/a", "chmod"), ("/r/a", "create"), ("/r/x.tmp/b", "write"), ("/r/d/y.tmp", "remove"), ("/r/d/e", "rename"), ("/q/x.tmp/b", "write"), ("/q/y.tmp", "write")]
    got = telling(spark.createDataFrame(rows, "path string, op string"), "/r", ["*.tmp"])
    assert {tuple(r) for r in got.select("path", F.col("op")).collect()} == {("/r", "write"), ("/r/a", "create"), ("/r/d/e", "rename"), ("/q/x.tmp/b", "write")}


def test_bursts_of_a_stream_end_in_the_rows_of_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    from trellis.streaming.changes import debounced

    at = [0, 200, 600, 1300, 1350, 5000, 5400, 5800, 9000]
    rows = [(m, datetime(2024, 1, 1) + timedelta(milliseconds=t + 37 * k)) for k, m in enumerate("ab") for t in at] + [("z", datetime(2024, 1, 1, 1))]
    events = spark.createDataFrame(rows, "machine string, ts timestamp")
    for part in (events.where("machine <> 'z'"), events.where("machine = 'z'"), events.where("machine = 'z'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = []
    stream = debounced(change_stream(spark, str(tmp_path / "log"), events.schema), "ts", "500 milliseconds", "1 second", "machine")
    writer = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/offsets")
    writer.trigger(availableNow=True).start().awaitTermination()
    expected = {tuple(r) for r in debounced(events.where("machine <> 'z'"), "ts", "500 milliseconds", "1 second", "machine").collect()}
    assert {r for r in seen if r[0] != "z"} == expected and sorted(r[3] for r in expected if r[0] == "a") == [1, 2, 3, 3]
