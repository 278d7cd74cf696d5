"""Running a plan for trees: what each stage makes of the two sides and of the base, with a journal written ahead.

The sides are tables here as they are everywhere in this library: local, remote and base as in `planner`. A stage is one set
of joins, but for moves of directories, which run depth by depth, as inner ones are told at the paths that outer ones leave.
It writes the rows that its actions change, beside the tables, and no others.
An action whose protector failed is refused, and so are those that it protects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.paths import depth
from trellis.operators.planner import carried
from trellis.operators.reconcile import DIGESTS, with_packed
from trellis.operators.state import latest, made_but_unrecorded, refused, upserted
from trellis.sources.store import Change, Store
from trellis.sources.tables import staged, unpacked

STAGES = range(1, 8)
BASE = ["rel_path", "file_id", "is_dir", "size", "md5", "mtime_ns", "drive_md5", "version"]
LOCAL = ["rel_path", "is_dir", "size", "mtime_ns", "md5"]
REMOTE = ["rel_path", "file_id", "is_dir", "size", "md5", "version", "modified_ns"]
#: What a commit changes, by the names of the tables.
Changes = dict[str, list[Change]]


@dataclass(frozen=True)
class Sides:
    base: DataFrame
    local: DataFrame
    remote: DataFrame


def renamed(df: DataFrame, moves: DataFrame) -> DataFrame:
    """df with the paths at and beneath each move's from (from, to) taken to its to."""
    own = moves.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    rows = carried(df, "rel_path", moves, "_now").join(own, F.col("rel_path") == F.col("_from"), "left")
    return rows.withColumn("rel_path", F.coalesce("_to", "_now")).select(*df.columns)


def _followed_dirs(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows beneath moves of directories (from, to), the outermost first, at their new paths; _was is where they were."""
    moves, rows = staged(moves, "moves"), rows.withColumn("_was", F.col("rel_path"))
    for d in sorted(r[0] for r in moves.select(depth(F.col("from"))).distinct().collect()):
        rows = renamed(rows, moves.where(depth(F.col("from")) == d))
    return rows.where("rel_path <> _was")


def _dir_moves(store: Store, acts: DataFrame, side: str) -> Changes:
    """Moves of directories on one side; the base goes along."""
    moves = acts.select(F.col("rel_path").alias("from"), F.col("new_rel_path").alias("to"))
    key = lambda name: ("rel_path", "_was") if name == "local" else "file_id"
    return {name: [store.change(name, _followed_dirs(store.table(name), moves), key(name))] for name in (side, "base")}


def sourced(plan: DataFrame) -> DataFrame:
    """plan with source: where the file at rel_path lies once the local moves of directories are done, told level by level."""
    if "source" in plan.columns:
        return plan
    moves = plan.where("type = 'move_local' and is_dir").select(F.col("rel_path").alias("from"), F.col("new_rel_path").alias("to"))
    moves, out = staged(moves, "moves"), plan.withColumn("source", F.col("rel_path"))
    for d in sorted(r[0] for r in moves.select(depth(F.col("from"))).distinct().collect()):
        out = carried(out, "source", moves.where(depth(F.col("from")) == d), "_now").withColumn("source", F.col("_now")).drop("_now")
    return out


def _directories(store: Store, acts: DataFrame) -> Changes:
    dirs = acts.select("rel_path", F.when(F.col("type") == "mkdir_remote", F.concat(F.lit("mk:"), "rel_path")).otherwise(F.col("file_id")).alias("file_id"), "type")
    none, text = F.lit(0).cast("long"), F.lit("")
    rows = dirs.select("rel_path", "file_id", F.lit(True).alias("is_dir"), none.alias("size"), text.alias("md5"), none.alias("mtime_ns"), text.alias("drive_md5"), F.lit(1).cast("long").alias("version"), none.alias("modified_ns"), "type")
    rows = staged(rows, "made")
    made = {"base": store.change("base", latest(rows.select(*BASE)), "file_id", "rel_path")}
    for name, kind, columns in (("local", "mkdir_local", LOCAL), ("remote", "mkdir_remote", REMOTE)):
        made[name] = store.change(name, rows.where(F.col("type") == kind).select(*columns), "rel_path")
    return {name: [change] for name, change in made.items()}


def _light(df: DataFrame) -> DataFrame:
    """df as it is moved: digests packed, drive_md5 null where it is md5, as _same tells."""
    df = with_packed(df)
    if "drive_md5" not in df.columns:
        return df
    same = F.col("md5").eqNullSafe(F.col("drive_md5"))
    return df.withColumns({"_same": same, "drive_md5": F.when(~same, F.col("drive_md5"))})


def _plain(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of what was made light."""
    if "_same" in df.columns:
        df = df.withColumn("drive_md5", F.when(F.col("_same"), F.col("md5")).otherwise(F.col("drive_md5")))
    return df.select(*[unpacked(F.col(c)).alias(c) if c in DIGESTS else c for c in names])


def _moves(store: Store, acts: DataFrame) -> Changes:
    """Moves of files and backups, all at once; what lies where one goes is replaced, unless it goes away itself."""
    acts = staged(acts.select("type", "file_id", "rel_path", "new_rel_path"), "acts")
    here = acts.where(F.col("type").isin("move_local", "conflict_backup")).select("rel_path", F.col("new_rel_path").alias("_to"))
    there = acts.where("type = 'move_remote'").select("file_id", F.col("new_rel_path").alias("_to"))
    asked = here.select("rel_path").union(there.select("_to")).distinct()
    found = staged(store.table("local", _light).join(asked, "rel_path", "left_semi"), "found")
    gone = found.join(here, "rel_path").withColumns({"_was": F.col("rel_path"), "rel_path": F.col("_to")})
    gone = store.change("local", _plain(gone, [*LOCAL, "_was"]), ("rel_path", "_was"), "rel_path")
    kept = found.join(here, "rel_path", "left_anti").join(gone.rows, "rel_path", "left_anti")
    local = kept.select("rel_path", "size", "mtime_ns").union(gone.rows.select("rel_path", "size", "mtime_ns"))
    went = store.table("remote", _light).join(there, "file_id").withColumn("rel_path", F.col("_to"))
    went = store.change("remote", _plain(went, REMOTE), "file_id")
    followed = acts.where(F.col("type").isin("move_local", "move_remote") & F.col("file_id").isNotNull()).select("file_id", F.col("new_rel_path").alias("_to"))
    took = store.table("base", _light, followed.select("file_id")).join(followed, "file_id").withColumn("rel_path", F.col("_to"))
    # what moved on the remote side is noted as it is on both sides now
    fresh = there.join(local.select(F.col("rel_path").alias("_to"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime")), "_to", "left").drop("_to")
    took = took.join(fresh, "file_id", "left").join(went.rows.select("file_id", F.col("version").alias("_version")), "file_id", "left")
    noted = {"size": F.coalesce("_size", "size"), "mtime_ns": F.coalesce("_mtime", "mtime_ns"), "version": F.coalesce("_version", "version")}
    took = latest(took.withColumns(noted).select(*BASE, "_same"))
    return {"local": [gone], "remote": [went], "base": [store.change("base", _plain(took, BASE), "file_id", "rel_path")]}


def _transfers(store: Store, acts: DataFrame) -> Changes:
    names = {"size": "size", "mtime_ns": "mtime", "md5": "md5"}
    here = lambda df: _light(df).select("rel_path", *[F.col(c).alias(f"l_{n}") for c, n in names.items()], F.lit(True).alias("_found"))
    there = lambda df: _light(df).select("file_id", "rel_path", *[F.col(c).alias(f"r_{n}") for c, n in {"size": "size", "md5": "md5", "version": "version", "modified_ns": "modified"}.items()])
    acts = acts.select("type", "rel_path", "file_id", "is_dir", "source")
    sent = acts.where(F.col("type").isin("upload", "update_remote", "record"))
    sent = staged(sent.join(store.table("local", here), "rel_path", "left"), "sent")
    # a plan may tell a file at the path that it had before its directory moved here
    left = staged(sent.where("_found is null and source <> rel_path").select(*acts.columns), "left")
    late = store.table("local", here, left.select(F.col("source").alias("rel_path"))).withColumnRenamed("rel_path", "source")
    lying = sent.where("_found").unionByName(left.join(late, "source"))
    got = acts.where("type = 'download'").withColumns({"l_size": F.lit(None).cast("long"), "l_mtime": F.lit(None).cast("long"), "l_md5": F.lit(None).cast("binary"), "_found": F.lit(None).cast("boolean")})
    known = lying.where("type <> 'upload'").unionByName(got).join(store.table("remote", there).drop("rel_path"), "file_id")
    up = lying.where("type = 'upload'").withColumn("file_id", F.concat(F.lit("up:"), "rel_path"))
    rows = known.unionByName(up, allowMissingColumns=True)
    down, note = F.col("type") == "download", F.col("type") == "record"
    version = F.when(F.col("type") == "upload", F.lit(1).cast("long")).when(F.col("type") == "update_remote", F.col("r_version") + 1).otherwise(F.col("r_version"))
    side = lambda n: F.when(down, F.col(f"r_{n}")).otherwise(F.col(f"l_{n}"))
    mtime = F.when(down, F.col("r_modified")).otherwise(F.col("l_mtime"))
    rows = rows.select("type", "rel_path", "file_id", "is_dir", side("size").alias("size"), side("md5").alias("md5"), mtime.alias("mtime_ns"), F.when(down | note, F.col("r_md5")).otherwise(F.col("l_md5")).alias("drive_md5"), version.alias("version"))
    rows = staged(_light(rows), "transfers")
    base = store.change("base", _plain(latest(rows.drop("type")), BASE), "file_id", "rel_path")
    went = rows.where(F.col("type").isin("upload", "update_remote")).withColumn("modified_ns", F.col("mtime_ns"))
    return {
        "base": [base],
        "local": [store.change("local", _plain(rows.where("type = 'download'"), LOCAL), "rel_path")],
        "remote": [store.change("remote", _plain(went, REMOTE), "file_id")],
    }


def _removals(store: Store, acts: DataFrame) -> Changes:
    ids = lambda *types: acts.where(F.col("type").isin(*types)).select("file_id")
    # a deleted row's path is that of its id in the base, which went along with its directory in the stages before
    aside = staged(acts.where("type = 'quarantine_local'").select("file_id", F.col("rel_path").alias("_told")), "aside")
    paths = store.table("base", lambda df: df.select("file_id", "rel_path"), aside.select("file_id"))
    aside = aside.join(paths, "file_id", "left").select(F.coalesce("rel_path", "_told").alias("rel_path"))
    gone = lambda name, rows, key: [store.change(name, rows, key, gives=False)]
    return {"base": gone("base", ids("quarantine_local", "trash_remote", "forget"), "file_id"), "local": gone("local", aside, "rel_path"), "remote": gone("remote", ids("trash_remote"), "file_id")}


def ran(store: Store, plan: DataFrame, stage: int) -> Changes:
    """What one stage of a plan whose every action there goes well changes of the sides and of the base in the store, written there."""
    acts = (sourced(plan) if stage == 6 else plan).where(F.col("stage") == stage)
    if stage in (1, 3):
        return _dir_moves(store, acts, "local" if stage == 1 else "remote")
    return {2: _directories, 4: _directories, 5: _moves, 6: _transfers, 7: _removals}[stage](store, acts)


def failing(plan: DataFrame, failed: DataFrame | None) -> DataFrame:
    """ord, why of the actions that don't run: those that fail (rel_path) and those behind a protector that doesn't run."""
    none = plan.select("ord", F.lit("").alias("why")).limit(0)
    if failed is None:
        return none
    lost = staged(plan.join(failed.select("rel_path"), "rel_path", "left_semi").select("ord", "rel_path", F.lit("failed").alias("why")), "failed")
    out, last = lost, lost
    # a chain of protectors is as long as a conflict has steps: two or three
    while not last.isEmpty():
        behind = refused(plan, last.select("rel_path")).join(out.select("ord"), "ord", "left_anti")
        last = staged(behind.select("ord", "rel_path", F.lit("refused").alias("why")), "refused")
        out = out.union(last)
    return out.select("ord", "why")


def _followed(base: DataFrame, acts: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The base with the moves that a side has made: what moves is at its new path there, and no longer at the old one."""
    moves = acts.where(F.col("type").isin("move_local", "move_remote")).select("type", "is_dir", "file_id", F.col("rel_path").alias("from"), F.col("new_rel_path").alias("to"))
    made = None
    for kind, side in (("move_local", local), ("move_remote", remote)):
        there = moves.where(F.col("type") == kind).join(side.select(F.col("rel_path").alias("to")), "to", "left_semi").join(side.select(F.col("rel_path").alias("from")), "from", "left_anti")
        made = there if made is None else made.unionByName(there)
    made = staged(made, "made")
    dirs = made.where("is_dir")
    for d in sorted(r[0] for r in dirs.select(depth(F.col("from"))).distinct().collect()):
        base = staged(renamed(base, dirs.where(depth(F.col("from")) == d).select("from", "to")), "base")
    files = made.where("not is_dir and file_id is not null").select("file_id", F.col("to").alias("_to"))
    return upserted(base, base.join(files, "file_id").withColumn("rel_path", F.col("_to")).select(*BASE))


def recovered(base: DataFrame, journal: DataFrame, local: DataFrame, remote: DataFrame, root: str = "") -> DataFrame:
    """The base with what an interrupted run did but didn't record: moves that a side has made, uploads, and remote directories."""
    base = _followed(base, journal.where("state = 'in_progress'"), local, remote)
    parent = lambda df: F.when(F.contains("rel_path", F.lit("/")), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise(root)
    ids = remote.select(F.col("rel_path").alias("_dir"), F.col("file_id").alias("parent_id"))
    nodes = remote.withColumn("_dir", parent(remote)).join(ids, "_dir", "left").withColumn("parent_id", F.when(F.col("_dir") == root, root).otherwise(F.col("parent_id")))
    nodes = nodes.select("file_id", "parent_id", F.substring_index("rel_path", "/", -1).alias("name"))
    ops = journal.select("op_id", F.col("type").alias("op_type"), "rel_path", "state").where("state = 'in_progress'")
    # what is found must also be what the action had to send: else the next plan decides
    made = made_but_unrecorded(ops, base, nodes, root)
    here = local.select("rel_path", "is_dir", "size", F.col("mtime_ns"), "md5")
    there = remote.select("file_id", F.col("md5").alias("drive_md5"), "version")
    rows = made.join(here, "rel_path").join(there, "file_id").where("md5 = drive_md5").join(base.select("file_id"), "file_id", "left_anti")
    return upserted(base, rows.select(*BASE))


class Run:
    """A plan that runs stage by stage over the tables base, local, remote and journal of a store.

    Before a stage touches a side its actions stand in the journal as in_progress. Then the sides change, and last one commit
    moves the base and takes the stage's actions out of the journal. After a crash in between, `recover` notes what was made
    and clears the journal; a new plan does the rest.
    """

    def __init__(self, store: Store) -> None:
        self.store = store

    def sides(self) -> Sides:
        """The three tables for a planner, which reads them many times: those with changes beside them are written anew first."""
        if changed := [n for n in ("base", "local", "remote") if self.store.changes(n)]:
            self.store.commit({n: self.store.table(n) for n in changed})
        return Sides(*(self.store.table(n) for n in ("base", "local", "remote")))

    def begin(self, plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
        """Writes the journal; ord, why of what will not run."""
        out = staged(failing(plan, failed), "failing")
        runs = sourced(plan.join(out.select("ord"), "ord", "left_anti"))
        self.store.commit({"journal": runs.select(F.col("ord").alias("op_id"), *[c for c in runs.columns if c != "ord"], F.lit("planned").alias("state"))})
        return out

    def stage(self, stage: int) -> None:
        plan = self.store.table("journal").where(F.col("stage") == stage)
        if plan.isEmpty():
            return
        own = self.store.change("journal", self.store.spark.range(1).select(F.lit(stage).alias("stage")), "stage", gives=False)
        self.store.commit({"journal": [own, self.store.change("journal", plan.withColumn("state", F.lit("in_progress")))]})
        after = ran(self.store, plan.withColumn("ord", F.col("op_id")), stage)
        self.touch(after)
        self.store.commit({"base": after["base"], "journal": [own]})

    def touch(self, after: Changes) -> None:
        """The change of the two sides, which no commit of the base can be one with."""
        self.store.commit({side: after[side] for side in ("local", "remote") if side in after})

    def all(self) -> None:
        for stage in STAGES:
            self.stage(stage)

    def recover(self) -> None:
        journal, sides = self.store.table("journal"), self.sides()
        self.store.commit({"base": recovered(sides.base, journal, sides.local, sides.remote), "journal": journal.limit(0)})
