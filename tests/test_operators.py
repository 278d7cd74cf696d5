import itertools

import pytest
from pyspark.sql import functions as F

from trellis.functions import paths as P
from trellis.operators import audit, feed, nodes, reconcile
from trellis.streaming.changes import change_stream, merge_stream, state_of


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_paths(spark):
    lit = F.lit
    assert one(spark, P.extension(lit("a/.bashrc"))) == ".bashrc" and one(spark, P.extension(lit("a.b/c"))) == ""
    assert one(spark, P.dirname(lit("a/b/c"))) == "a/b" and one(spark, P.dirname(lit("a"))) == ""
    assert one(spark, P.proper_ancestors(lit("a/b/c"))) == ["a", "a/b"] and one(spark, P.proper_ancestors(lit("a"))) == []
    assert one(spark, P.join_path(lit(""), lit("x"))) == "x" and one(spark, P.join_path(lit("p"), lit("x"))) == "p/x"
    names = spark.createDataFrame([(n,) for n in ("x.tmp", "a.txt", "q1", "[", P.TEMP_PREFIX + "1", ".", "")], "n string")
    got = {r["n"]: r["i"] for r in names.select("n", P.ignored(F.col("n"), ["*.tmp", "q?", "[a"]).alias("i")).collect()}
    assert [k for k, v in got.items() if v] == ["x.tmp", "q1", P.TEMP_PREFIX + "1"]
    assert [r["n"] for r in names.where(~P.valid_name(F.col("n"))).collect()] == [".", ""]
    assert one(spark, P.fold_key(lit("ÉA"), True, True)) == "éa"
    assert one(spark, P.one_line(lit(" a\n b "))) == "a b" and one(spark, P.clip(lit("abcdef"), 4)) == "abc…"


def test_a_twin_of_a_fold_loser_is_a_collision(spark):
    rows = spark.createDataFrame([("1", "p", "A"), ("2", "p", "a"), ("3", "p", "a"), ("4", "p", "A"), ("5", "q", "a")], "file_id string, parent_id string, name string")
    got = {r["file_id"]: r["verdict"] for r in nodes.siblings(rows, P.fold_key(F.col("name"), True, False)).collect()}
    assert got == {"1": "kept", "2": "collision", "3": "collision", "4": "duplicate", "5": "kept"}


def test_cycles_are_not_reached(spark):
    rows = spark.createDataFrame([("a", "root", "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y"), ("root", "b", "R")], "file_id string, parent_id string, name string")
    assert {(r["file_id"], r["rel_path"]) for r in nodes.tree_paths(rows, "root").collect()} == {("a", "A"), ("b", "A/B")}
    assert {r["file_id"] for r in nodes.pruned(rows, "root").collect()} == {"x", "y"}


def test_rules_of_children(spark):
    rows = spark.createDataFrame([("d", nodes.FOLDER, False), ("doc", nodes.NATIVE_PREFIX + ".document", False), ("x.tmp", "t", False), ("a/b", "t", False), ("t", "t", True)], "name string, mime_type string, trashed boolean")
    assert [r["rule"] for r in nodes.child_rules(rows, ["*.tmp"]).collect()] == ["ok", "native", "ignored", "invalid", "trashed"]


def test_folding(spark):
    log = lambda kinds: spark.createDataFrame([(i, k, i) for i, k in enumerate(kinds)], "id long, kind string, ts long")
    fold = lambda kinds: [(r["kind"], r["count"], r["ts"]) for r in feed.folded(log(kinds), ["kind"], "id", "ts").orderBy("first").collect()]
    assert fold(["error"] * 300) == [("error", 300, 299)]
    assert fold(["error", "error", "upload", "error"]) == [("error", 2, 1), ("upload", 1, 2), ("error", 1, 3)]
    assert fold([None, None, "a"]) == [(None, 2, 1), ("a", 1, 2)] and fold([]) == []


def test_search_takes_marks_literally(spark):
    rows = spark.createDataFrame([("50%",), ("505",)], "t string")
    assert [r["t"] for r in rows.where(feed.matching([F.col("t")], "0%")).collect()] == ["50%"]


def test_secret_lines(spark):
    rows = spark.createDataFrame([(1, "a\nAKIA" + "A1" * 8 + "\nxoxb-0123456789ab"), (2, "clean")], "id long, text string")
    assert {tuple(r) for r in audit.secret_lines(rows).collect()} == {(1, 2, "aws-access-key-id"), (1, 3, "slack-token")}


def test_a_stream_of_changes_is_merged_and_replayed(spark, tmp_path):
    schema = "seq long, file_id string, name string, removed boolean"
    feed_dir, table = str(tmp_path / "feed"), f"file://{tmp_path}/table"
    for batch in ([(1, "a", "x", False), (2, "b", "y", False)], [(3, "a", "z", False), (4, "b", None, True)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed_dir)
    stream = change_stream(spark, feed_dir, spark.createDataFrame([], schema).schema)
    merge_stream(stream, table, f"file://{tmp_path}/offsets", "file_id", "seq", "removed").awaitTermination()
    out = spark.createDataFrame([], "file_id string, name string").schema
    assert [tuple(r) for r in state_of(spark, table, out).collect()] == [("a", "z")]
    merge_stream(stream, table, f"file://{tmp_path}/again", "file_id", "seq", "removed").awaitTermination()
    assert [tuple(r) for r in state_of(spark, table, out).collect()] == [("a", "z")]


def test_runs_are_those_of_one_sequence_wherever_blocks_end(spark):
    for kinds in ("aabbbaaccab" * 9, "a" * 60, "ab" * 30, "aab" + "c" * 40 + "ba"):
        rows = [(i * 3 + i % 2, k, i) for i, k in enumerate(kinds)]
        want, at = [], 0
        for k, run in itertools.groupby(kinds):
            n = len(list(run))
            want.append((k, rows[at][0], rows[at + n - 1][2], n))
            at += n
        got = feed.folded(spark.createDataFrame(rows, "id long, kind string, ts long"), ["kind"], "id", "ts", block_rows=5)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_ranks_go_on_from_range_to_range(spark):
    rows = [(f"p{i:03}", "hot" if i % 9 else f"m{i}", 1) for i in range(200)]
    got = {(r["md5"], r["path"]): r["k"] for r in reconcile.ranked(spark.createDataFrame(rows, "path string, md5 string, size long").repartition(7), ["md5", "size"], "path").collect()}
    hot = sorted(p for p, m, _ in rows if m == "hot")
    assert got == {(m, p): hot.index(p) + 1 if m == "hot" else 1 for p, m, _ in rows}


def test_trees_deeper_than_allowed_are_an_error(spark):
    chain = spark.createDataFrame([(str(i + 1), str(i), "n") for i in range(5)], "file_id string, parent_id string, name string")
    assert nodes.tree_paths(chain, "0", most=5).count() == 5
    with pytest.raises(ValueError):
        nodes.tree_paths(chain, "0", most=3)
