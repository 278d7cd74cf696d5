from pyspark.sql import functions as F

from trellis.operators import planner as pl

BASE = "rel_path string, file_id string, is_dir boolean, size long, md5 string, mtime_ns long, drive_md5 string, version long"
LOCAL, REMOTE = "rel_path string, is_dir boolean, size long, mtime_ns long, md5 string", "rel_path string, file_id string, is_dir boolean, size long, md5 string, version long, modified_ns long"


def tree(spark, base, local, remote, **how):
    """Rows are (path, id, content) and (path, content); a content of None is a directory."""
    b = spark.createDataFrame([(p, i, m is None, 1, m or "", 1000, m or "", 1) for p, i, m in base], BASE)
    lo = spark.createDataFrame([(x[0], x[1] is None, 1, x[2] if len(x) > 2 else 1000, x[1] or "") for x in local], LOCAL)
    r = spark.createDataFrame([(x[0], x[1], x[2] is None, 1, x[2] or "", 1, x[3] if len(x) > 3 else 0) for x in remote], REMOTE)
    return pl.Tree(b, lo, r, "box", F.expr("timestamp '2026-07-08 10:30:00'"), **how)


def copy(path):
    stem, _, ext = path.rpartition(".")
    return f"{stem} (conflict box 2026-07-08_103000).{ext}"


D, F1 = ("d", "D", None), ("d/a.txt", "a", "m")
CASES = {
    "remote rename of a directory": ([D, F1], [("d", None), ("d/a.txt", "m")], [("e", "D", None), ("e/a.txt", "a", "m")], [("move_local", "d", "e")], 0),
    "edit beneath a renamed directory": ([D, F1], [("d", None), ("d/a.txt", "x")], [("e", "D", None), ("e/a.txt", "a", "m")], [("move_local", "d", "e"), ("update_remote", "e/a.txt", None)], 0),
    "local rename of a directory": ([D, F1], [("e", None), ("e/a.txt", "m")], [("d", "D", None), F1], [("move_remote", "d", "e")], 0),
    "new folder beneath a local rename": ([D, F1], [("e", None), ("e/a.txt", "m"), ("e/n", None)], [("d", "D", None), F1], [("move_remote", "d", "e"), ("mkdir_remote", "e/n", None)], 0),
    "scattered children are no rename": ([D, F1, ("d/b.txt", "b", "k")], [("e", None), ("e/a.txt", "m"), ("f", None), ("f/b.txt", "k")], [("d", "D", None), F1, ("d/b.txt", "b", "k")], [("mkdir_remote", "e", None), ("mkdir_remote", "f", None), ("move_remote", "d/a.txt", "e/a.txt"), ("move_remote", "d/b.txt", "f/b.txt"), ("trash_remote", "d", None)], 0),
    "new folders": ([], [("n", None), ("both", None)], [("both", "B", None), ("r", "R", None)], [("mkdir_remote", "n", None), ("mkdir_local", "r", None), ("record", "both", None)], 0),
    "folder here, file there": ([], [("x", None)], [("x", "X", "m")], [], 1),
    "file here, folder there": ([], [("x", "m")], [("x", "X", None)], [], 1),
    "a directory took a file's place": ([("x", "X", "m")], [("x", None)], [("x", "X", "m")], [], 1),
    "remote folder deleted": ([D, F1], [("d", None), ("d/a.txt", "m")], [], [("quarantine_local", "d/a.txt", None), ("quarantine_local", "d", None)], 0),
    "remote folder deleted over an edit": ([D, F1], [("d", None), ("d/a.txt", "x")], [], [("mkdir_remote", "d", None), ("upload", "d/a.txt", None)], 0),
    "local folder deleted": ([D, F1], [], [("d", "D", None), F1], [("trash_remote", "d/a.txt", None), ("trash_remote", "d", None)], 0),
    "local folder deleted over a new remote file": ([D, F1], [], [("d", "D", None), F1, ("d/n.txt", "n", "k")], [("download", "d/n.txt", None), ("trash_remote", "d/a.txt", None)], 0),
    "folder gone on both sides": ([D], [], [], [("forget", "d", None)], 0),
    "an occupant steps aside": ([("a.txt", "a", "m")], [("a.txt", "m"), ("b.txt", "x")], [("b.txt", "a", "m")], [("conflict_backup", "b.txt", copy("b.txt")), ("move_local", "a.txt", "b.txt"), ("upload", copy("b.txt"), None)], 0),
    "a swap": ([("a.txt", "a", "m"), ("b.txt", "b", "k")], [("a.txt", "m"), ("b.txt", "k")], [("b.txt", "a", "m"), ("a.txt", "b", "k")], [("move_local", "a.txt", "b.txt"), ("move_local", "b.txt", "a.txt")], 0),
    "touched": ([("a.txt", "a", "m")], [("a.txt", "m", 2000)], [("a.txt", "a", "m")], [("record", "a.txt", None)], 0),
}


def test_trees(spark):
    """All cases in one tree, each beneath a directory of its own and with contents of its own."""
    base, local, remote = [], [], []
    for k, (b, lo, r, *_) in enumerate(CASES.values()):
        own = lambda x, k=k: None if x is None else f"{k}{x}"
        base += [(f"c{k}/{p}", own(i), own(m)) for p, i, m in b]
        local += [(f"c{k}/{x[0]}", own(x[1]), *x[2:]) for x in lo]
        remote += [(f"c{k}/{x[0]}", own(x[1]), own(x[2])) for x in r]
    plan, skips = pl.planned_tree(tree(spark, base, local, remote))
    found = pl.numbered(plan, pl.run_order()).orderBy("ord").collect()
    left = [r["rel_path"] for r in skips.collect()]
    for k, (name, (*_, expected, skipped)) in enumerate(CASES.items()):
        cut = lambda p, k=k: p and p.removeprefix(f"c{k}/")
        got = [(r["type"], cut(r["rel_path"]), cut(r["new_rel_path"])) for r in found if r["rel_path"].startswith(f"c{k}/")]
        assert got == expected, name
        assert sum(p.startswith(f"c{k}/") for p in left) == skipped, name
    assert pl.overlaps_tree(plan).isEmpty() and [r["ord"] for r in found] == list(range(1, len(found) + 1))


def test_names_that_fold(spark):
    got = lambda t: sorted((r["type"], r["rel_path"], r["new_rel_path"]) for r in pl.planned_tree(t)[0].collect())
    assert got(tree(spark, [], [("A.txt", "m")], [("a.txt", "i", "m")], case_fold=True)) == [("move_local", "A.txt", "a.txt"), ("record", "a.txt", None)]
    assert got(tree(spark, [], [("A.txt", "m")], [("a.txt", "i", "k")], case_fold=True)) == [("conflict_backup", "A.txt", copy("A.txt")), ("download", "a.txt", None), ("upload", copy("A.txt"), None)]
    assert got(tree(spark, [], [("A.txt", "m")], [("a.txt", "i", "k")])) == [("download", "a.txt", None), ("upload", "A.txt", None)]
    assert got(tree(spark, [], [("e\u0301.txt", "m")], [("\u00e9.txt", "i", "m")], norm_fold=True)) == [("move_local", "e\u0301.txt", "\u00e9.txt"), ("record", "\u00e9.txt", None)]


def test_the_newer_side_keeps_its_name(spark):
    got = lambda when: sorted((r["type"], r["rel_path"], r["new_rel_path"]) for r in pl.planned_tree(tree(spark, [], [("a.txt", "m", 50)], [("a.txt", "i", "k", when)], prefer_newer=True))[0].collect())
    backup = [("conflict_backup", "a.txt", copy("a.txt")), ("download", "a.txt", None), ("upload", copy("a.txt"), None)]
    assert got(40) == [("download", copy("a.txt"), None), ("move_remote", "a.txt", copy("a.txt")), ("upload", "a.txt", None)]
    assert got(50) == backup and got(0) == backup


def test_what_is_held_is_left_alone(spark):
    t = tree(spark, [D, F1, ("g.txt", "g", "m")], [("d", None), ("d/a.txt", "m")], [])
    held = pl.expanded(t.base, spark.createDataFrame([("d",)], "rel_path string"))
    plan, skips = pl.planned_tree(tree(spark, [D, F1, ("g.txt", "g", "m")], [("d", None), ("d/a.txt", "m")], [], shadowed=held))
    assert [(r["type"], r["rel_path"]) for r in plan.collect()] == [("forget", "g.txt")]
    assert sorted(r["rel_path"] for r in skips.collect()) == ["d", "d/a.txt"]


def test_deletes_gather_at_directories(spark):
    base = [D, F1, ("d/s", "S", None), ("d/s/b.txt", "b", "k"), ("e", "E", None), ("e/c.txt", "c", "q")]
    t = tree(spark, base, [(p, m) for p, _, m in base], [])
    plan, entries = pl.collapsed_tree(pl.planned_tree(t)[0], t.remote)
    beneath = sorted((r["root"], r["rel_path"]) for r in entries.collect())
    got = {r["rel_path"]: (r["subtree_files"], [p for root, p in beneath if root == r["rel_path"]]) for r in plan.collect()}
    assert {r["rel_path"]: r["entries"] for r in plan.collect()} == {"d": 3, "e": 1} and got == {"d": (2, ["d/a.txt", "d/s", "d/s/b.txt"]), "e": (1, ["e/c.txt"])}
    assert pl.guarded(plan, 3, 0.5, False, False, least=1).first()["tripped"] and not pl.guarded(plan, 3, 0.5, True, False, least=1).first()["tripped"]
    t = tree(spark, [D, F1], [], [("d", "D", None), F1])
    assert [r["rel_path"] for r in pl.collapsed_tree(pl.planned_tree(t)[0], t.remote)[0].collect()] == ["d"]
    assert pl.without_deletes(pl.planned_tree(t)[0]).isEmpty()


def test_rows_arent_moved_to_find_moves_of_directories(spark, tmp_path):
    from trellis.operators.planner import carried

    spark.createDataFrame([(f"d{i % 3}/e{i % 2}/{i}", i) for i in range(60)] + [("d1", -1), ("top", -2)], "rel_path string, n int").write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    moves = spark.createDataFrame([("d1", "x"), ("d1/e1", "y/z"), ("d2/e", "no")], "`from` string, `to` string")
    threshold = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = carried(rows, "rel_path", moves, "now")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", threshold)
    assert "Exchange hashpartitioning" not in plan
    told = {r["n"]: (r["rel_path"], r["now"]) for r in found.collect()}
    assert len(told) == 62 and told[-1] == ("d1", "d1") and told[-2] == ("top", "top")
    assert told[1] == ("d1/e1/1", "y/z/1") and told[4] == ("d1/e0/4", "x/e0/4") and told[2][0] == told[2][1]


def test_paths_beneath_others(spark):
    from trellis.operators.reconcile import overlaps

    paths = ["a", "a/b", "a/b/c", "ab/c", "d/e/f", "d/e/f", "d/e/g", "d/e", "é/x", "é"]
    got = overlaps(spark.createDataFrame([("upload", p) for p in paths], "type string, rel_path string"))
    assert {(r[0], r[1]) for r in got.collect()} == {("d/e/f", "twice"), *((p, "beneath") for p in ("a/b", "a/b/c", "d/e/f", "d/e/g", "é/x"))} and got.count() == 6


def test_each_side_is_moved_once(spark):
    from tests.test_reconcile import shuffled

    ids = spark.range(20000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), "id").alias("rel_path"), F.concat(F.lit("i"), "id").alias("file_id"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"), F.md5(F.col("id").cast("string")).alias("md5"))
    base = ids.withColumns({"mtime_ns": F.col("size"), "drive_md5": F.col("md5"), "version": F.col("size")})
    local, remote = base.select("rel_path", "is_dir", "size", "mtime_ns", "md5"), base.select("rel_path", "file_id", "is_dir", "size", "md5", "version", F.col("size").alias("modified_ns"))
    once = shuffled(spark, lambda: [df.repartition(4, by).write.format("noop").mode("overwrite").save() for df, by in ((base, "rel_path"), (local, "rel_path"), (base, "file_id"), (remote, "file_id"))])
    got = shuffled(spark, lambda: pl.planned_tree(pl.Tree(base, local, remote, "box", F.current_timestamp()))[0].write.format("noop").mode("overwrite").save())
    assert once > 1_000_000 and got < 1.8 * once


def test_files_that_are_as_they_were_are_not_written_again(spark):
    """Of an unchanged tree nothing but its directories is staged as known; what changed is, and is planned."""
    import os
    from glob import glob

    files = [(f"d{i % 3}/{i}", f"i{i}", f"m{i}") for i in range(300)]
    base = [(f"d{k}", f"D{k}", None) for k in range(3)] + files
    local = [(p, m) for p, _, m in base if p != "d1/1"]
    local[3] = (local[3][0], "other")
    remote = [(p, i, m) for p, i, m in base if p != "d2/2"]
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/trellis"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    plan, _ = pl.planned_tree(tree(spark, base, local, remote))
    known = [d for d in set(os.listdir(where)) - before if d.startswith("known-")]
    assert len(known) == 1 and glob(f"{where}/{known[0]}/*.parquet")
    assert sorted(r["rel_path"] for r in spark.read.parquet(f"file://{where}/{known[0]}").select("rel_path").collect()) == ["d0", "d0/0", "d1", "d1/1", "d2", "d2/2"]
    assert sorted((r["type"], r["rel_path"]) for r in plan.collect()) == [("quarantine_local", "d2/2"), ("trash_remote", "d1/1"), ("update_remote", "d0/0")]


def test_new_directories_move_no_remote_rows(spark):
    """Whether the remote side has a new local directory is asked for that directory alone."""
    from tests.test_reconcile import shuffled

    base = spark.range(60000).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), F.md5(F.col("id").cast("string"))).alias("rel_path"), F.concat(F.lit("i"), "id").alias("file_id"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"), F.lit("").alias("md5"))
    base = base.withColumns({"mtime_ns": F.col("size"), "drive_md5": F.col("md5"), "version": F.col("size")})
    local, remote = base.select("rel_path", "is_dir", "size", "mtime_ns", "md5"), base.select("rel_path", "file_id", "is_dir", "size", "md5", "version", F.col("size").alias("modified_ns"))
    local = local.union(spark.createDataFrame([(f"d{i}/new", True, 0, 1, "") for i in range(7)], LOCAL))
    remote = remote.union(spark.createDataFrame([("d3/new", "X", False, 1, "", 1, 0)], REMOTE))
    paths = shuffled(spark, lambda: remote.select("rel_path").repartition(4, "rel_path").write.format("noop").mode("overwrite").save())
    plans = []
    sides = shuffled(spark, lambda: pl.tree_sides(pl.Tree(base, local, remote, "box", F.current_timestamp())))
    got = shuffled(spark, lambda: plans.extend(pl.planned_tree(pl.Tree(base, local, remote, "box", F.current_timestamp()))))
    assert paths > 1_000_000 and got - sides < 1.5 * paths
    assert sorted((r["type"], r["rel_path"]) for r in plans[0].collect()) == [("mkdir_remote", f"d{i}/new") for i in range(7) if i != 3] and [r["rel_path"] for r in plans[1].collect()] == ["d3/new"]


def test_digests_stay_packed(spark):
    """No step of a plan writes digests as texts, and what differs in case, or is no digest at all, differs still."""
    import os

    base = [("d", "D", None), ("d/a", "a", "ab"), ("d/b", "b", "cd"), ("d/c", "c", "not hex"), ("d/e", "e", "ef")]
    local = [("d", None), ("d/a", "AB"), ("d/b", "cd"), ("d/c", "not hex"), ("d/moved", "ef"), ("d/n", "0a")]
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/trellis"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    plan, _ = pl.planned_tree(tree(spark, base, local, [*base, ("d/n", "n", "0A")]))
    written = [f for d in set(os.listdir(where)) - before for f in spark.read.parquet(f"file://{where}/{d}").schema if f.name.endswith("md5")]
    assert written and {f.dataType.simpleString() for f in written} == {"binary"}
    assert sorted((r["type"], r["rel_path"]) for r in plan.collect()) == [("conflict_backup", "d/n"), ("download", "d/n"), ("move_remote", "d/e"), ("update_remote", "d/a"), ("upload", copy_of("d/n"))]


def copy_of(path):
    return f"{path} (conflict box 2026-07-08_103000)"
