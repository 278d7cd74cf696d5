"""Three-way reconciliation of keyed snapshots of files.

base has rel_path, file_id, md5, drive_md5, size, version; local has rel_path, md5, size; remote has rel_path, file_id, md5,
size, version. Local rows meet the base by path, remote rows by id. Every join is an equality on one of these keys; which
of them is broadcast is left to the optimizer, by size. Absence is told by a flag of the joined side, never by a null value.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.paths import conflict_name, depth, dirname, proper_ancestors
from trellis.sources.tables import packed, staged, staged_alike, unpacked

#: Where each type of action runs. Of the moves the backups come first; deletes go from the deepest path up.
STAGES = {"conflict_backup": 5, "move_local": 5, "move_remote": 5, "upload": 6, "update_remote": 6, "download": 6, "record": 6, "trash_remote": 7, "quarantine_local": 7, "forget": 7}
#: Columns of base, local and remote that hold digests.
DIGESTS = ("md5", "drive_md5")
#: Columns of sides that mostly are what another one is.
ALIKE = {"drive_md5": "md5", "l_md5": "md5", "r_md5": "md5", "r_rel_path": "rel_path"}


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns], F.lit(True).alias(f"in_{prefix}"))


def _on(left: str, right: str) -> Column:
    return F.col(left) == F.col(right)


def aligned(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each base row with the local row at its path (l_) and the remote row of its id (r_)."""
    out = _side(base, "b").join(_side(local, "l"), _on("b_rel_path", "l_rel_path"), "left").join(_side(remote, "r"), _on("b_file_id", "r_file_id"), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_l", "in_r")})


def new_rows(base: DataFrame, local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local rows at paths that the base doesn't have, and remote rows of ids that it doesn't have."""
    return local.join(base.select("rel_path"), "rel_path", "left_anti"), remote.join(base.select("file_id"), "file_id", "left_anti")


def with_packed(df: DataFrame) -> DataFrame:
    """df with its digests packed; those that are bytes already stay as they are. Equal ones stay equal, others unequal."""
    texts = [c for c, kind in df.dtypes if c in DIGESTS and kind == "string"]
    return df.withColumns({c: packed(F.col(c)) for c in texts}) if texts else df


def sides(base: DataFrame, local: DataFrame, remote: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Base rows with the local row at their path (l_) and the remote row of their id (r_), and the rows that the base doesn't know.

    in_b, in_l and in_r tell where a row is. rel_path is that of the base or else the local one, file_id that of the base or
    else the remote one. notes are more columns by file_id. Each side is moved once, with its digests packed, and
    what is staged serves all later steps. Digests that were packed before stay so, texts become texts again.
    """
    texts = dict(base.dtypes)["md5"] == "string"
    base, local, remote = (with_packed(df) for df in (base, local, remote))
    here = local.select(F.col("rel_path").alias("_path"), *[F.col(c).alias(f"l_{c}") for c in local.columns if c != "rel_path"], F.lit(True).alias("in_l"))
    rows = base.withColumn("in_b", F.lit(True)).join(here, F.col("rel_path") == F.col("_path"), "full_outer")
    # rows without an id meet nothing; a number from their path spreads them over all tasks
    salt = F.when(F.col("file_id").isNull(), F.xxhash64("rel_path")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("rel_path", F.coalesce("rel_path", "_path")).withColumn("_salt", salt).drop("_path")
    by_id = lambda df, prefix: df.select(F.col("file_id").alias("_id"), salt.alias("_none"), *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "file_id"])
    on = (F.col("file_id") == F.col("_id")) & (F.col("_salt") == F.col("_none"))
    if notes is not None:
        marked = notes.withColumn("rel_path", F.lit(None).cast("string"))
        rows = rows.join(by_id(marked, "").drop("rel_path"), on, "left").drop("_id", "_none")
    rows = rows.join(by_id(remote, "r_").withColumn("in_r", F.lit(True)), on, "full_outer").withColumn("file_id", F.coalesce("file_id", "_id")).drop("_id", "_none", "_salt")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_b", "in_l", "in_r")})
    if texts:
        rows = rows.withColumns({c: unpacked(F.col(c)) for c in ("md5", "drive_md5", "l_md5", "r_md5")})
    return staged_alike(rows, "sides", ALIKE)


def unknown_local(both: DataFrame, *columns: str) -> DataFrame:
    """Those rows of sides that the local side alone has, as it has them."""
    return both.where("in_l and not in_b").select("rel_path", *[F.col(f"l_{c}").alias(c) for c in columns])


def unknown_remote(both: DataFrame, *columns: str) -> DataFrame:
    """Those rows of sides that the remote side alone has, as it has them."""
    return both.where("in_r and not in_b").select("file_id", *[F.col(f"r_{c}").alias(c) for c in columns])


def near(df: DataFrame, path: str, rows: DataFrame, at: Column, most: int = 100_000) -> DataFrame:
    """df cut down to the directories that hold a path of rows (at), as a join by path asks for no others; df as it is if these are more than most."""
    dirs = staged(rows.select(dirname(at).alias("_d")).where("_d is not null").distinct(), "near")
    return df if dirs.count() > most else df.join(dirs, dirname(F.col(path)) == F.col("_d"), "left_semi")


def classified(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """row_cls, n: how many rows fall into each class of the decision table."""
    lm, rm, bm = F.col("l_md5"), F.col("r_md5"), F.col("b_md5")
    moved = F.col("r_rel_path") != F.col("b_rel_path")
    known = (
        F.when(~F.col("in_l") & ~F.col("in_r"), "forget").when(~F.col("in_l") & ((rm != bm) | moved), "restore_remote").when(~F.col("in_l"), "trash_remote")
        .when(~F.col("in_r") & (lm != bm), "resurrect").when(~F.col("in_r"), "quarantine").when((lm == bm) & (rm == bm), "noop_or_record")
        .when(rm == bm, "update_remote").when(lm == bm, "download").when(lm == rm, "record_same").otherwise("conflict")
    )
    nl, nr = new_rows(base, local, remote)
    both = _side(nl, "l").join(_side(nr, "r"), _on("l_rel_path", "r_rel_path"), "full_outer")
    new = F.when(F.col("in_r").isNull(), "upload_new").when(F.col("in_l").isNull(), "download_new").when(lm == rm, "adopt").otherwise("conflict_new")
    rows = aligned(base, local, remote).select(known.alias("row_cls")).union(both.select(new.alias("row_cls")))
    return rows.groupBy("row_cls").agg(F.count("*").alias("n"))


def action(kind: str, rel_path: Column, new_rel_path: Column | None = None, file_id: Column | None = None, protected_by: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(kind).alias("type"), rel_path.alias("rel_path"), text(new_rel_path).alias("new_rel_path"), text(file_id).alias("file_id"), text(protected_by).alias("protected_by"))


def in_ranges(df: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """df in ranges of by, with _range, ascending with these, and _at, the place of the row in its range by order, from 1."""
    # a row's number has the task in its upper bits and its place there in the lower 33
    rows = df.repartitionByRange(*by).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumn("_range", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id")


def in_parts(rows: DataFrame, *parts: tuple[Column, list[tuple[DataFrame, Column]]]) -> DataFrame:
    """Staged rows, those of each part (a condition that excludes the others) left joined as it says; the rest isn't moved for it."""
    out = rows.where(~F.coalesce(functools.reduce(Column.__or__, (c for c, _ in parts)), F.lit(False)))
    for condition, joins in parts:
        part = rows.where(condition)
        for other, on in joins:
            part = part.join(other, on, "left")
        out = out.unionByName(staged(part, "part"), allowMissingColumns=True)
    return out


def ranked(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with k, the rank of each row by `order` among those of equal keys, from 1.

    Rows are cut into ranges of keys and order, so that rows of one key spread over as many tasks as they need; a key that
    goes on from one range into the next starts there at the number of its rows before.
    """
    rows = staged(in_ranges(df, [*keys, order], [*keys, order]), "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one key a range goes on from an earlier one, that of its first row
    heads = staged(rows.where("_at = 1").select(*keys).distinct(), "heads")
    before = rows.join(heads, keys, "left_semi").groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    before = staged(before, "before")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order)))
    return rows.join(before, [*keys, "_range"], "left").withColumn("k", F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_range", "_at", "_before")


def move_pairs(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Deleted rows (path, file_id, md5, size) and new ones (path, md5, size) of equal content, first come first served by path.

    Both sides are ranked within their content and joined on content and rank, which a queue per content would give too.
    Only content that both sides have is ranked.
    """
    keys = ["md5", "size"]
    gone, new = staged(gone, "gone"), staged(new, "new")
    common = staged(gone.select(*keys).distinct().join(new.select(*keys).distinct(), keys), "common")
    left, right = (ranked(x.join(common, keys, "left_semi"), keys, "path").withColumnRenamed("path", name) for x, name in ((gone, "from"), (new, "to")))
    return left.join(right, [*keys, "k"]).select("from", "to", "file_id", *keys)


def planned(base: DataFrame, local: DataFrame, remote: DataFrame, machine: str, now: Column) -> DataFrame:
    """stage, type, rel_path, new_rel_path, file_id, protected_by: what to do to make both sides agree, for files.

    Changed content on one side goes to the other; deletes lose against edits and moves; where both sides changed, the
    local bytes step aside under a conflict name and are uploaded too. Directories, moves of directories and folding of
    names are not planned here.
    """
    both = sides(base.select("rel_path", "file_id", "md5", "drive_md5", "size", "version"), local.select("rel_path", "md5", "size"), remote.select("file_id", "rel_path", "md5", "version"))
    nl, nr = unknown_local(both, "md5", "size"), unknown_remote(both, "rel_path", "md5")
    b, r, lp, rp = F.col("b_md5"), F.col("r_md5"), F.col("b_rel_path"), F.col("r_rel_path")
    rows = both.where("in_b").drop("in_b").withColumnsRenamed({c: f"b_{c}" for c in ("rel_path", "file_id", "md5", "drive_md5", "size", "version")})
    o_side, t_side = (near(df, "rel_path", rows.where(rp != lp), rp) for df in (local.select("rel_path", "md5"), base.select("rel_path")))
    at_target = [(_side(o_side, "o"), F.col("o_rel_path") == rp), (_side(t_side, "t"), F.col("t_rel_path") == rp)]
    new_there = [(_side(nr.select("rel_path", "file_id", "md5"), "n"), F.col("n_rel_path") == lp)]
    rows = in_parts(rows, (rp != lp, at_target), (F.col("in_l") & ~F.col("in_r"), new_there))  # every branch below starts from these rows
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_o", "in_t", "in_n")})
    rows = rows.withColumns({"moved": F.coalesce(rp != lp, F.lit(False)), "lc": F.col("in_l") & (F.col("l_md5") != b), "rc": F.col("in_r") & (r != F.col("b_drive_md5"))})
    rows = rows.withColumn("met", ~F.col("in_l") & F.col("moved") & ~F.col("in_t") & F.col("in_o"))
    rows = rows.withColumn("clash", F.col("in_l") & F.col("in_r") & F.col("lc") & F.col("rc") & (F.col("l_md5") != r))
    fid, copy = F.col("b_file_id"), lambda p: conflict_name(p, machine, now)
    none = F.array().cast("array<struct<type:string,rel_path:string,new_rel_path:string,file_id:string,protected_by:string>>")
    there = F.when(F.col("moved"), rp).otherwise(lp)

    def triple(at: Column, to: Column, file_id: Column) -> Column:
        return F.array(action("conflict_backup", at, copy(at)), action("upload", copy(at), protected_by=at), action("download", to, file_id=file_id, protected_by=at))

    displaced = F.col("in_o") & ~F.col("in_t")
    move = F.when(displaced, F.array(action("conflict_backup", rp, copy(rp)), action("upload", copy(rp), protected_by=rp), action("move_local", lp, rp, fid, rp))).otherwise(F.array(action("move_local", lp, rp, fid)))
    drift = (F.col("b_size") != F.col("l_size")) | (F.col("b_version") != F.col("r_version"))
    after_move = F.when(F.col("moved"), lp)
    decided = (
        F.when(F.col("met"), F.when(F.col("o_md5") == r, F.array(action("record", rp, file_id=fid))).otherwise(triple(rp, rp, fid)))
        .when(~F.col("in_l") & ~F.col("in_r"), F.array(action("forget", lp, file_id=fid)))
        .when(~F.col("in_l") & (F.col("rc") | F.col("moved")), F.array(action("download", there, file_id=fid)))
        .when(~F.col("in_l"), none)
        .when(~F.col("in_r") & F.col("lc") & F.col("in_n") & (F.col("n_md5") == F.col("l_md5")), F.array(action("record", lp, file_id=F.col("n_file_id"))))
        .when(~F.col("in_r") & F.col("lc") & F.col("in_n"), triple(lp, lp, F.col("n_file_id")))
        .when(~F.col("in_r") & F.col("lc"), F.array(action("upload", lp)))
        .when(~F.col("in_r") & F.col("in_n"), none)
        .when(~F.col("in_r"), F.array(action("quarantine_local", lp, file_id=fid)))
        .when(~F.col("lc") & ~F.col("rc"), F.when(drift, F.array(action("record", there, file_id=fid, protected_by=after_move))).otherwise(none))
        .when(~F.col("rc"), F.array(action("update_remote", there, file_id=fid, protected_by=after_move)))
        .when(~F.col("lc"), F.array(action("download", there, file_id=fid)))
        .when(F.col("l_md5") == r, F.array(action("record", there, file_id=fid, protected_by=after_move)))
        .otherwise(triple(lp, there, fid))
    )
    moving = F.when(F.col("moved") & F.col("in_l") & ~F.col("clash"), move).otherwise(none)
    first = rows.select(F.explode(F.concat(decided, moving)).alias("a")).select("a.*")

    claimed = rows.where(F.col("in_n") & F.col("lc") & ~F.col("in_r")).select(lp.alias("rel_path"))
    met = rows.where("met").select(rp.alias("rel_path"))
    aside = rows.where(F.col("moved") & F.col("in_l") & ~F.col("clash") & displaced).select(rp.alias("rel_path"))
    nl = nl.join(met.union(aside), "rel_path", "left_anti")
    pairs = staged(_side(nl, "l").join(_side(nr.select("rel_path", "file_id", "md5"), "n"), _on("l_rel_path", "n_rel_path"), "left"), "pairs")
    at = F.col("l_rel_path")
    second = pairs.where("in_n").select(F.explode(F.when(F.col("l_md5") == F.col("n_md5"), F.array(action("record", at, file_id=F.col("n_file_id")))).otherwise(triple(at, at, F.col("n_file_id")))).alias("a")).select("a.*")
    gone = rows.where(~F.col("in_l") & F.col("in_r") & ~F.col("rc") & ~F.col("moved")).select(lp.alias("path"), fid.alias("file_id"), b.alias("md5"), F.col("b_size").alias("size"))
    lone = pairs.where(F.col("in_n").isNull()).select(at.alias("path"), F.col("l_md5").alias("md5"), F.col("l_size").alias("size"))
    matched = staged(move_pairs(gone, lone), "moves")
    moves = matched.select(action("move_remote", F.col("from"), F.col("to"), F.col("file_id")).alias("a")).select("a.*")
    uploads = lone.join(matched.select(F.col("to").alias("path")), "path", "left_anti").select(action("upload", F.col("path")).alias("a")).select("a.*")
    trash = gone.join(matched.select(F.col("from").alias("path")), "path", "left_anti").select(action("trash_remote", F.col("path"), file_id=F.col("file_id")).alias("a")).select("a.*")
    taken = claimed.union(pairs.where("in_n").select(at))
    third = nr.join(taken, "rel_path", "left_anti").select(action("download", F.col("rel_path"), file_id=F.col("file_id")).alias("a")).select("a.*")
    plan = first.union(second).union(moves).union(uploads).union(trash).union(third)
    stage = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in STAGES.items()])
    return plan.select(stage.alias("stage"), "type", "rel_path", "new_rel_path", "file_id", "protected_by")


def ordered(plan: DataFrame) -> DataFrame:
    """The plan in the order in which it runs, by a range sort."""
    d = F.when(F.col("stage") == 7, -depth(F.col("rel_path"))).when(F.col("stage") == 6, 0).otherwise(depth(F.col("rel_path")))
    down = F.when(F.col("stage") == 7, F.col("rel_path"))
    return plan.orderBy("stage", F.col("type") != "conflict_backup", d, F.when(F.col("stage") != 7, F.col("rel_path")), down.desc(), "type")


def mass_delete_guard(plan: DataFrame, tracked: DataFrame, threshold: float, confirmed: bool, bin_available: bool, least: int = 10) -> DataFrame:
    """deletions, tracked, tripped: whether the plan takes away more than least files and a larger share than threshold."""
    n = plan.agg(F.count_if(F.col("type") == "quarantine_local").alias("deletions"))
    t = tracked.agg(F.count("*").alias("tracked"))
    on = F.lit(not confirmed and not bin_available) & (F.col("tracked") > 0) & (F.col("deletions") > least)
    return n.join(t, F.lit(True)).select("deletions", "tracked", (on & (F.col("deletions") / F.nullif("tracked", F.lit(0)) > threshold)).alias("tripped"))


def overlaps(plan: DataFrame) -> DataFrame:
    """rel_path, problem: paths that the transfer stage touches twice, and those beneath a path that it writes as a file."""
    rows = staged(plan.where(F.col("type").isin("upload", "update_remote", "download", "record")).select("rel_path"), "transfers")
    twice = rows.groupBy("rel_path").agg(F.count("*").alias("n")).where("n > 1").select("rel_path", F.lit("twice").alias("problem"))
    return twice.union(within(rows).select("rel_path", F.lit("beneath").alias("problem")).distinct())


def within(rows: DataFrame) -> DataFrame:
    """rel_path of those of the rows that lie beneath another's path; directories are compared once, not for each path in them."""
    above = lambda df: df.select("rel_path", F.explode(proper_ancestors(F.col("rel_path"))).alias("above"))
    dirs = staged(above(rows).select(F.col("above").alias("rel_path")).distinct(), "dirs")
    hit = staged(rows.join(dirs, "rel_path", "left_semi").select(F.col("rel_path").alias("above")).distinct(), "hit")
    return above(rows).join(hit, "above", "left_semi").select("rel_path")


def collapsed(deletes: DataFrame, alive: DataFrame) -> DataFrame:
    """root, files: deletes gathered at the highest directory beneath which nothing is alive; files without one stay alone.

    Containment is an equality on exploded ancestors, so that there is no join on prefixes.
    """
    held = alive.select(F.explode(proper_ancestors(F.col("rel_path"))).alias("dir")).distinct()
    # files are counted up by their directories before these meet the directories above them
    parents = deletes.groupBy(dirname(F.col("rel_path")).alias("parent")).agg(F.count("*").alias("files")).where("parent <> ''")
    dirs = parents.select("parent", F.explode(F.concat(proper_ancestors(F.col("parent")), F.array("parent"))).alias("dir"))
    dead = dirs.select("dir").distinct().join(held, "dir", "left_anti")
    roots = dirs.join(dead, "dir").groupBy("parent").agg(F.min_by("dir", depth(F.col("dir"))).alias("root"))
    gathered = parents.join(roots, "parent").groupBy("root").agg(F.sum("files").alias("files"))
    alone = deletes.join(roots, dirname(F.col("rel_path")) == F.col("parent"), "left_anti").groupBy(F.col("rel_path").alias("root")).agg(F.count("*").alias("files"))
    return gathered.union(alone)


def rewritten(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """rel_path, now: paths after moves (from, to) of directories; of several that contain a path the longest applies."""
    hit = paths.select("rel_path", F.explode(proper_ancestors(F.col("rel_path"))).alias("from")).join(moves, "from")
    best = hit.groupBy("rel_path").agg(F.max_by(F.struct("from", "to"), F.length("from")).alias("m"))
    now = F.when(F.col("m").isNull(), F.col("rel_path")).otherwise(F.concat(F.col("m.to"), F.substr("rel_path", F.length("m.from") + 1)))
    return paths.join(best, "rel_path", "left").select("rel_path", now.alias("now"))


def summary(plan: DataFrame) -> DataFrame:
    """type, n of each type of action."""
    return plan.groupBy("type").agg(F.count("*").alias("n"))


def applied(base: DataFrame, local: DataFrame, remote: DataFrame, plan: DataFrame) -> DataFrame:
    """file_id, rel_path, md5 of the base after a plan whose every action went well; uploads get ids from their paths."""
    plan = staged(plan, "plan")
    gone = plan.where(F.col("type").isin("forget", "trash_remote", "quarantine_local")).select("file_id")
    backed = plan.where("type = 'conflict_backup'").select(F.col("rel_path").alias("was"), F.col("new_rel_path").alias("rel_path"))
    here = local.select("rel_path", F.col("md5").alias("l_md5"))
    sent = plan.where("type = 'upload'").select("rel_path").join(backed, "rel_path", "left").withColumn("src", F.coalesce("was", "rel_path"))
    new = sent.join(here.withColumnRenamed("rel_path", "src"), "src").select(F.concat(F.lit("up:"), "rel_path").alias("file_id"), "rel_path", F.col("l_md5").alias("md5"))
    got = plan.where(F.col("type").isin("download", "record")).select("file_id", "rel_path").join(remote.select("file_id", "md5"), "file_id")
    updated = plan.where("type = 'update_remote'").select("file_id", "rel_path", F.coalesce("protected_by", "rel_path").alias("src")).join(here.withColumnRenamed("rel_path", "src"), "src").select("file_id", "rel_path", F.col("l_md5").alias("md5"))
    moved = plan.where(F.col("type").isin("move_local", "move_remote")).select("file_id", F.col("new_rel_path").alias("rel_path")).join(base.select("file_id", "md5"), "file_id")
    written = got.union(updated.select("file_id", "rel_path", "md5")).union(new)
    moved = moved.join(written.select("file_id"), "file_id", "left_anti")
    fresh = written.union(moved.select("file_id", "rel_path", "md5"))
    stay = base.select("file_id", "rel_path", "md5").join(gone, "file_id", "left_anti").join(fresh.select("file_id"), "file_id", "left_anti").join(fresh.select("rel_path"), "rel_path", "left_anti")
    return stay.select("file_id", "rel_path", "md5").union(fresh)
