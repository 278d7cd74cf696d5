import os
import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from trellis.operators import reconcile
from trellis.sources.tables import staged

BASE = "rel_path string, file_id string, md5 string, drive_md5 string, size long, version long"
LOCAL, REMOTE = "rel_path string, md5 string, size long", "rel_path string, file_id string, md5 string, size long, version long"
COPY = "a (conflict test_box 2026-07-08_103000).txt"


def plan(spark, base, local, remote):
    b = spark.createDataFrame([(p, i, m, m, 1, 1) for p, i, m in base], BASE)
    lo = spark.createDataFrame([(p, m, 1) for p, m in local], LOCAL)
    r = spark.createDataFrame([(p, i, m, 1, 1) for p, i, m in remote], REMOTE)
    return b, lo, r, reconcile.planned(b, lo, r, "test_box", F.expr("timestamp '2026-07-08 10:30:00'"))


B = [("a.txt", "i", "m")]
CASES = {
    "new local": ([], [("a.txt", "x")], [], [("upload", "a.txt", None)]),
    "new remote": ([], [], [("a.txt", "i", "x")], [("download", "a.txt", None)]),
    "adopted": ([], [("a.txt", "x")], [("a.txt", "i", "x")], [("record", "a.txt", None)]),
    "both new": ([], [("a.txt", "x")], [("a.txt", "i", "y")], [("conflict_backup", "a.txt", COPY), ("upload", COPY, None), ("download", "a.txt", None)]),
    "same": (B, [("a.txt", "m")], [("a.txt", "i", "m")], []),
    "local edit": (B, [("a.txt", "x")], [("a.txt", "i", "m")], [("update_remote", "a.txt", None)]),
    "remote edit": (B, [("a.txt", "m")], [("a.txt", "i", "x")], [("download", "a.txt", None)]),
    "same edit": (B, [("a.txt", "x")], [("a.txt", "i", "x")], [("record", "a.txt", None)]),
    "two edits": (B, [("a.txt", "x")], [("a.txt", "i", "y")], [("conflict_backup", "a.txt", COPY), ("upload", COPY, None), ("download", "a.txt", None)]),
    "local delete": (B, [], [("a.txt", "i", "m")], [("trash_remote", "a.txt", None)]),
    "remote delete": (B, [("a.txt", "m")], [], [("quarantine_local", "a.txt", None)]),
    "edit beats remote delete": (B, [("a.txt", "x")], [], [("upload", "a.txt", None)]),
    "edit beats local delete": (B, [], [("a.txt", "i", "x")], [("download", "a.txt", None)]),
    "both deleted": (B, [], [], [("forget", "a.txt", None)]),
    "local move": (B, [("b.txt", "m")], [("a.txt", "i", "m")], [("move_remote", "a.txt", "b.txt")]),
    "remote move": (B, [("a.txt", "m")], [("b.txt", "i", "m")], [("move_local", "a.txt", "b.txt")]),
    "same move": (B, [("b.txt", "m")], [("b.txt", "i", "m")], [("record", "b.txt", None)]),
    "replaced in place": (B, [("a.txt", "m")], [("a.txt", "j", "x")], [("download", "a.txt", None)]),
}


@pytest.mark.parametrize("name", list(CASES))
def test_decision_table(spark, name):
    *sides, expected = CASES[name]
    got = [tuple(r) for r in reconcile.ordered(plan(spark, *sides)[-1]).select("type", "rel_path", "new_rel_path").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    stages = [reconcile.STAGES[t] for t, *_ in got]
    assert stages == sorted(stages)


def random_sides(seed):
    r = random.Random(seed)
    path = lambda: f"{r.choice('pqr')}/{r.randint(0, 12)}.txt"
    base = {path(): f"i{k}" for k in range(14)}
    base = [(p, i, r.choice("uvw")) for p, i in base.items()]
    local = {p: r.choice([m, m, "x", "y"]) for p, _, m in base if r.random() < 0.7} | {path(): r.choice("uvwxy") for _ in range(4)}
    remote, taken = [], set()
    for p, i, m in base + [(path(), f"n{k}", "z") for k in range(4)]:
        q = path() if r.random() < 0.2 else p
        if r.random() < 0.75 and q not in taken:
            taken.add(q)
            remote.append((q, i, r.choice([m, m, "x", "y"])))
    return base, list(local.items()), remote


@pytest.mark.parametrize("seed", [1, 2])
def test_an_empty_base_deletes_nothing(spark, seed):
    _, local, remote = random_sides(seed)
    kinds = {r["type"] for r in plan(spark, [], local, remote)[-1].collect()}
    assert not kinds & {"trash_remote", "quarantine_local", "forget"}


def test_pairs_are_those_of_queues(spark):
    r = random.Random(3)
    gone = [(f"g{i:03}", f"i{i}", r.choice("abc"), r.randint(0, 2)) for i in range(60)]
    new = [(f"n{i:03}", r.choice("abc"), r.randint(0, 2)) for i in range(60)]
    queues, expected = {}, set()
    for p, _, m, s in sorted(gone):
        queues.setdefault((m, s), deque()).append(p)
    for p, m, s in sorted(new):
        if queues.get((m, s)):
            expected.add((queues[m, s].popleft(), p))
    got = reconcile.move_pairs(spark.createDataFrame(gone, "path string, file_id string, md5 string, size long"), spark.createDataFrame(new, "path string, md5 string, size long"))
    assert {(x["from"], x["to"]) for x in got.collect()} == expected


def test_collapse_keeps_to_dead_directories(spark):
    deletes = spark.createDataFrame([("a/b/1",), ("a/b/2",), ("a/c/3",), ("d/4",), ("5",)], "rel_path string")
    alive = spark.createDataFrame([("a/c/6",)], "rel_path string")
    got = {(r["root"], r["files"]) for r in reconcile.collapsed(deletes, alive).collect()}
    assert got == {("a/b", 2), ("a/c/3", 1), ("d", 1), ("5", 1)}


def test_guard(spark):
    acts = spark.createDataFrame([("quarantine_local",)] * 11, "type string")
    tracked = spark.createDataFrame([(i,) for i in range(40)], "i long")
    on = lambda **k: reconcile.mass_delete_guard(acts, tracked, 0.25, **{"confirmed": False, "bin_available": False} | k).first()["tripped"]
    assert on() and not on(confirmed=True) and not on(bin_available=True)
    assert not reconcile.mass_delete_guard(acts.limit(10), tracked, 0.1, False, False).first()["tripped"]


def test_overlaps(spark):
    acts = spark.createDataFrame([("upload", "a"), ("download", "a"), ("upload", "a/b"), ("forget", "c")], "type string, rel_path string")
    assert {tuple(r) for r in reconcile.overlaps(acts).collect()} == {("a", "twice"), ("a/b", "beneath")}


def shuffled(spark, run, most="50k"):
    """Bytes that run writes into shuffles while only small tables are broadcast, as on large inputs."""
    def total():
        time.sleep(0.5)
        spark.range(1).count()  # later tasks make the store take in the figures of earlier ones
        return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    name, before = "spark.sql.autoBroadcastJoinThreshold", total()
    limit = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        run()
    finally:
        spark.conf.set(name, limit)
    return total() - before


def test_each_side_is_moved_once(spark):
    ids = spark.range(20000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), "id").alias("rel_path"), F.concat(F.lit("i"), "id").alias("file_id"), F.md5(F.col("id").cast("string")).alias("md5"))
    base = ids.withColumns({"drive_md5": F.col("md5"), "size": F.lit(1).cast("long"), "version": F.lit(1).cast("long")})
    local, remote = base.select("rel_path", "md5", "size"), base.select("rel_path", "file_id", "md5", "size", "version")
    once = shuffled(spark, lambda: [df.repartition(4, by).write.format("noop").mode("overwrite").save() for df, by in ((base, "rel_path"), (local, "rel_path"), (base, "file_id"), (remote, "file_id"))])
    got = shuffled(spark, lambda: reconcile.planned(base, local, remote, "box", F.current_timestamp()).write.format("noop").mode("overwrite").save())
    assert once > 1_000_000 and got < 1.4 * once


def test_rows_of_one_side_have_its_columns(spark):
    base = spark.createDataFrame([("a", "i", "m", "m", 1, 1), ("b", "j", "m", "m", 1, 1)], BASE)
    local, remote = spark.createDataFrame([("a", "x", 5), ("n", "y", 6)], LOCAL), spark.createDataFrame([("c", "j", "z", 1, 3), ("n", "k", None, 1, 4)], REMOTE)
    both = reconcile.sides(base, local, remote, spark.createDataFrame([("j", "held"), ("k", "no"), (None, "none")], "file_id string, why string"))
    got = {tuple(r) for r in both.select("rel_path", "file_id", "in_b", "in_l", "in_r", "l_md5", "r_rel_path", "why").collect()}
    assert got == {("a", "i", True, True, False, "x", None, None), ("b", "j", True, False, True, None, "c", "held"), ("n", None, False, True, False, "y", None, None), (None, "k", False, False, True, None, "n", None)} and both.count() == 4
    assert [tuple(r) for r in reconcile.unknown_local(both, "md5", "size").collect()] == [("n", "y", 6)] and [tuple(r) for r in reconcile.unknown_remote(both, "rel_path", "version").collect()] == [("k", "n", 4)]


def test_rows_near_others(spark):
    df = spark.createDataFrame([("a/1",), ("a/b/2",), ("c",), ("d/3",)], "rel_path string")
    rows = spark.createDataFrame([("a/x",), ("e/y",), ("z",), (None,)], "at string")
    assert sorted(r[0] for r in reconcile.near(df, "rel_path", rows, F.col("at")).collect()) == ["a/1", "c"]
    assert reconcile.near(df, "rel_path", rows, F.col("at"), most=2).count() == 4


def test_packed_texts_come_back(spark):
    from trellis.sources.tables import packed, unpacked

    texts = ["d41d8cd98f00b204e9800998ecf8427e", "D41D", "abc", "", "zz", "é\x00x", "ff", "0a\n", " 0a", "tc", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed(F.col("t"))).withColumn("u", unpacked(F.col("p"))).collect()
    assert [r["u"] for r in rows] == texts and len(rows[0]["p"]) == 17 and len({bytes(r["p"]) for r in rows[:-1]}) == 10


def test_columns_like_another_come_back(spark):
    from trellis.sources.tables import staged_alike

    rows = [("a", "a", 1), ("a", "b", 2), ("a", None, 3), (None, "b", 4), (None, None, 5)]
    got = staged_alike(spark.createDataFrame(rows, "x string, y string, n int"), "alike", {"y": "x"})
    assert got.columns == ["x", "y", "n"] and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == rows


def test_sides_move_digests_packed_and_write_them_once(spark):
    ids = spark.range(20000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), "id").alias("rel_path"), F.concat(F.lit("i"), "id").alias("file_id"), F.md5(F.col("id").cast("string")).alias("md5"))
    base = ids.withColumns({"drive_md5": F.col("md5"), "size": F.lit(1).cast("long"), "version": F.lit(1).cast("long")})
    local, remote = base.select("rel_path", "md5", "size"), base.select("rel_path", "file_id", "md5", "version")
    once = shuffled(spark, lambda: [df.repartition(4, by).write.format("noop").mode("overwrite").save() for df, by in ((base, "rel_path"), (local, "rel_path"), (base, "file_id"), (remote, "file_id"))])
    both = []
    got = shuffled(spark, lambda: both.append(reconcile.sides(base, local, remote)))
    assert once > 1_000_000 and got < 0.85 * once
    assert folder_size(both[0]) < 1.3 * folder_size(staged(ids, "ids"))
    assert both[0].where("in_b and in_l and in_r and md5 = l_md5 and md5 = r_md5 and md5 = drive_md5 and r_rel_path = rel_path").count() == 20000


def folder_size(df):
    """Bytes of the files of a staged table."""
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
