"""Plans for trees that run to their end, are interrupted, or fail in part: planning again must find nothing left to do."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trellis.operators import commit, planner
from trellis.plans.fixtures import NOW
from trellis.plans.trees import trees
from trellis.sources.store import Store
from trellis.sources.tables import staged


@pytest.fixture(scope="module")
def sides(spark):
    t = trees(spark, SMALL)
    return commit.Sides(*(staged(t[n].select(*names), n) for n, names in (("base", commit.BASE), ("loc", commit.LOCAL), ("rem", commit.REMOTE))))


def planned(sides):
    tree = planner.Tree(sides.base, sides.local, sides.remote, "test_box", F.expr(NOW), case_fold=True, prefer_newer=True)
    return staged(planner.numbered(planner.planned_tree(tree)[0], planner.run_order()), "plan")


@pytest.fixture(scope="module")
def plan(sides):
    return planned(sides)


class Crash(Exception):
    pass


def started(spark, tmp_path, sides, plan, failed=None):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(vars(sides))
    run = commit.Run(store)
    return run, run.begin(plan, failed)


def test_a_whole_plan_leaves_nothing_to_do(spark, tmp_path, sides, plan):
    run, out = started(spark, tmp_path, sides, plan)
    assert out.count() == 0
    run.all()
    after = run.sides()
    assert run.store.table("journal").count() == 0 and planned(after).count() == 0
    files = lambda df: {(r["rel_path"], r["md5"]) for r in df.where("not is_dir").select("rel_path", "md5").collect()}
    tree = planner.Tree(sides.base, sides.local, sides.remote, "test_box", F.expr(NOW), case_fold=True, prefer_newer=True)
    again = planner.Tree(after.base, after.local, after.remote, "test_box", F.expr(NOW), case_fold=True, prefer_newer=True)
    clashes = {r["rel_path"] for t in (tree, again) for r in planner.planned_tree(t)[1].collect()}
    apart = lambda rows: {x for x in rows if x[0] not in clashes}
    base = files(after.base)
    assert apart(base) <= files(after.local) and apart(base) <= files(after.remote)


@pytest.mark.parametrize(("stage", "behind"), [(1, True), (3, True), (5, True), (6, True)])
def test_a_crash_at_any_stage_is_made_good(spark, tmp_path, sides, plan, monkeypatch, stage, behind):
    run, _ = started(spark, tmp_path, sides, plan)
    touch = commit.Run.touch

    def crash(self, after):
        if behind:
            touch(self, after)
        raise Crash

    for s in commit.STAGES:
        if s < stage:
            run.stage(s)
    monkeypatch.setattr(commit.Run, "touch", crash)
    with pytest.raises(Crash):
        run.stage(stage)
    monkeypatch.setattr(commit.Run, "touch", touch)
    assert {r[0] for r in run.store.table("journal").where(F.col("stage") == stage).select("state").distinct().collect()} == {"in_progress"}
    run.recover()
    assert run.store.table("journal").count() == 0
    for _ in range(3):
        rest = planned(run.sides())
        if rest.isEmpty():
            break
        run.begin(rest)
        run.all()
    assert rest.isEmpty()
    # nothing was made twice: a path has one row on each side and in the base
    for df in vars(run.sides()).values():
        assert df.groupBy("rel_path").count().where("count > 1").count() == 0


def test_what_a_failed_protector_guards_doesnt_run(spark, tmp_path, sides, plan):
    backup = plan.where("type = 'conflict_backup'").orderBy("ord").limit(1).select("rel_path")
    path = backup.first()[0]
    run, out = started(spark, tmp_path, sides, plan, backup)
    guarded = {r["ord"] for r in plan.where((F.col("protected_by") == path) | (F.col("rel_path") == path)).collect()}
    assert {r["ord"] for r in out.collect()} == guarded and len(guarded) > 1
    before = sides.local.where(F.col("rel_path") == path).first()
    run.all()
    assert run.sides().local.where(F.col("rel_path") == path).first() == before
    run.begin(planned(run.sides()))
    run.all()
    assert planned(run.sides()).count() == 0


def test_an_upload_finds_its_file_where_the_directory_went(spark, tmp_path):
    base = [("d", "D", True, 0, "", 1, "", 1), ("d/x.txt", "X", False, 3, "old", 1, "old", 1), ("d/y.txt", "Y", False, 3, "y", 1, "y", 1)]
    local = [("d", True, 0, 1, ""), ("d/x.txt", False, 4, 2, "new"), ("d/y.txt", False, 3, 1, "y")]
    remote = [("r", "D", True, 0, "", 1, 0), ("r/y.txt", "Y", False, 3, "y", 1, 0)]
    schema = lambda names: ", ".join(f"{n} {'boolean' if n == 'is_dir' else 'long' if n in ('size', 'mtime_ns', 'version', 'modified_ns') else 'string'}" for n in names)
    sides = commit.Sides(*(spark.createDataFrame(rows, schema(names)) for rows, names in ((base, commit.BASE), (local, commit.LOCAL), (remote, commit.REMOTE))))
    run, _ = started(spark, tmp_path, sides, planned(sides))
    assert {(r["type"], r["rel_path"], r["source"]) for r in run.store.table("journal").where("stage = 6").collect()} == {("upload", "d/x.txt", "r/x.txt")}
    run.all()
    after = run.sides()
    assert ("d/x.txt", "new") in {(r["rel_path"], r["md5"]) for r in after.remote.collect()} & {(r["rel_path"], r["md5"]) for r in after.base.collect()}
    assert {r["rel_path"]: r["md5"] for r in after.local.where("not is_dir").collect()} == {"r/x.txt": "new", "r/y.txt": "y"}
    for _ in range(3):
        if (rest := planned(run.sides())).isEmpty():
            break
        run.begin(rest)
        run.all()
    assert rest.isEmpty() and {r["rel_path"] for r in run.sides().remote.where("md5 = 'new'").collect()} == {"r/x.txt"}


def test_a_stage_writes_what_its_actions_change(spark, tmp_path, sides, plan):
    run, _ = started(spark, tmp_path, sides, plan)
    run.all()
    acts, dirs = plan.count(), [r[0] for r in plan.where("is_dir and type in ('move_local', 'move_remote')").select("rel_path").collect()]
    assert dirs
    for name, side in vars(sides).items():
        written = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "store" / "data").iterdir() if p.name.startswith(f"{name}-"))
        beneath = sum(side.where(F.startswith("rel_path", F.lit(d)) & (F.col("rel_path").isin(d) | F.startswith("rel_path", F.lit(f"{d}/")))).count() for d in dirs)
        assert written <= side.count() + acts + beneath
    # one copy as it was planned, one as it ran, and a row for each stage that was marked
    journal = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "store" / "data").iterdir() if p.name.startswith("journal-"))
    assert journal <= 2 * acts + len(commit.STAGES)


def test_inner_directories_move_at_the_paths_that_outer_ones_leave(spark, tmp_path):
    rows = [("a", "A", True), ("a/c", "C", True), ("a/c/x", "X", False), ("a/y", "Y", False), ("ab", "B", False)]
    of = lambda names, *more: spark.createDataFrame([r + more for r in rows], "rel_path string, file_id string, is_dir boolean, size long, mtime_ns long, version long, modified_ns long, md5 string, drive_md5 string").select(*names)
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({n: of(names, 1, 1, 1, 1, "m", "m") for n, names in (("base", commit.BASE), ("local", commit.LOCAL), ("remote", commit.REMOTE))})
    acts = spark.createDataFrame([("b/c", "b/d"), ("a", "b")], "rel_path string, new_rel_path string")
    after = commit._dir_moves(store, acts, "local")
    store.commit(after)
    for name in ("local", "base"):
        assert {r[0] for r in store.table(name).select("rel_path").collect()} == {"b", "b/d", "b/d/x", "b/y", "ab"}
    assert {r["rel_path"] for r in after["local"][0].rows.collect()} == {"b", "b/d", "b/d/x", "b/y"}


def test_sides_for_a_planner_have_no_changes_beside_them(spark, tmp_path, sides, plan):
    run, _ = started(spark, tmp_path, sides, plan)
    run.all()
    held = {n: sorted(map(str, run.store.table(n).collect())) for n in vars(sides)}
    assert any(run.store.changes(n) for n in held)
    after = vars(run.sides())
    assert not any(run.store.changes(n) for n in held) and held == {n: sorted(map(str, df.collect())) for n, df in after.items()}
