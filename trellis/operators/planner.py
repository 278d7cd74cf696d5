"""The whole plan for trees of files and directories, with moves of directories, holds and folded names.

base has rel_path, file_id, is_dir, size, md5, mtime_ns, drive_md5, version; local has rel_path, is_dir, size, mtime_ns, md5;
remote has rel_path, file_id, is_dir, size, md5, version, modified_ns. A row is decided at the path that it will have once all
moves of directories are done. Containment is always an equality on exploded ancestors; greedy steps are joins on ranks;
each set that a later step must not touch again is an anti join. Tables that several branches start from are staged.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.paths import conflict_name, depth, dirname, fold_key, join_path, proper_ancestors
from trellis.operators.reconcile import ALIKE, in_parts, in_ranges, move_pairs, near, sides, unknown_local, unknown_remote, with_packed, within
from trellis.sources.tables import staged, staged_alike

ACTION = "type string, rel_path string, new_rel_path string, file_id string, is_dir boolean, protected_by string, pin_size long, pin_mtime long"
SKIP = "rel_path string, reason string"


@dataclass(frozen=True)
class Tree:
    """The three snapshots, ids that are held back on either side, and how names meet."""

    base: DataFrame
    local: DataFrame
    remote: DataFrame
    machine: str
    now: Column
    shadowed: DataFrame | None = None
    unreadable: DataFrame | None = None
    case_fold: bool = False
    norm_fold: bool = False
    prefer_newer: bool = False


def act(kind: str, at: Column, to: Column | None = None, file_id: Column | None = None, protected_by: Column | None = None, pin: tuple[Column, Column] | None = None, is_dir: bool = False) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    size, mtime = pin or (F.lit(None), F.lit(None))
    fields = {"type": F.lit(kind), "rel_path": at, "new_rel_path": text(to), "file_id": text(file_id), "is_dir": F.lit(is_dir), "protected_by": text(protected_by), "pin_size": size.cast("long"), "pin_mtime": mtime.cast("long")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _none() -> Column:
    return F.array().cast(f"array<struct<{ACTION.replace(' ', ':').replace(',:', ',')}>>")


def _rows(df: DataFrame, actions: Column) -> DataFrame:
    return df.select(F.explode(actions).alias("a")).select("a.*")


def _named(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns], F.lit(True).alias(f"in_{prefix}"))


def _flags(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.withColumns({f"in_{p}": F.coalesce(f"in_{p}", F.lit(False)) for p in prefixes})


def _at(df: DataFrame, rows: DataFrame, at: Column, name: str) -> DataFrame:
    """rel_path of df where it is a path of rows (at), staged."""
    asked = staged(rows.select(at.alias("rel_path")).distinct(), "asked")
    return staged(near(df, "rel_path", rows, at).select("rel_path").join(asked, "rel_path", "left_semi"), name)


def carried(df: DataFrame, path: str, moves: DataFrame, out: str, among: DataFrame | None = None) -> DataFrame:
    """df with out: the path after moves (from, to) of directories; of several that strictly contain it the longest applies.

    It is looked up once for each directory that holds paths; those that moved are staged, so that the join with the rows
    knows their size. among has the same column, and no fewer paths, where df itself is dear to compute twice.
    """
    dirs = (df if among is None else among).select(dirname(F.col(path)).alias("_d")).where("_d <> ''").distinct()
    hit = dirs.select("_d", F.explode(F.concat(proper_ancestors(F.col("_d")), F.array("_d"))).alias("from")).join(moves.select("from", "to"), "from")
    best = staged(hit.groupBy("_d").agg(F.max_by(F.struct("from", "to"), F.length("from")).alias("_m")), "carried")
    now = F.when(F.col("_m").isNull(), F.col(path)).otherwise(F.concat(F.col("_m.to"), F.substr(F.col(path), F.length("_m.from") + 1)))
    return df.join(best, dirname(F.col(path)) == F.col("_d"), "left").withColumn(out, now).drop("_d", "_m")


def beneath(paths: DataFrame) -> DataFrame:
    """dir: every directory that strictly contains one of the paths (rel_path)."""
    return paths.select(F.explode(proper_ancestors(F.col("rel_path"))).alias("dir")).distinct()


def remote_dir_moves(base: DataFrame, remote: DataFrame) -> DataFrame:
    """from, to of the directories whose id is at another path on the remote side."""
    there = remote.select("file_id", F.col("rel_path").alias("to"))
    dirs = staged(base.where("is_dir").select("file_id", F.col("rel_path").alias("from")), "dirs")
    return dirs.join(there, "file_id").where("from <> to").select("from", "to")


def tree_sides(tree: Tree, notes: DataFrame | None = None) -> DataFrame:
    """The three snapshots as sides, with what a plan asks of each."""
    return sides(tree.base, tree.local.select("rel_path", "is_dir", "size", "mtime_ns", "md5"), tree.remote.select("file_id", "rel_path", "is_dir", "md5", "version", "modified_ns"), notes)


def local_dir_moves(tree: Tree, by_remote: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """from, to, file_id of the directories that were renamed locally, told by what their files became.

    A directory of the base counts that is gone locally and unmoved remotely, if at least one file beneath it pairs with a
    new local file of equal content, and all that pair kept their places beneath one and the same new directory. That must be
    there, unknown to the base and free on the remote side. Of nested ones the outermost counts. both are the sides, where the
    caller has them.
    """
    both = tree_sides(tree) if both is None else both
    files = carried(both.where("in_b and in_r and not is_dir"), "rel_path", by_remote, "expected")
    clash = (F.col("l_md5") != F.col("md5")) & (F.col("r_md5") != F.col("drive_md5")) & (F.col("l_md5") != F.col("r_md5"))
    files = files.withColumn("_gone", F.expr("not in_l and r_md5 = drive_md5 and r_rel_path = expected")).withColumn("_aside", F.col("in_l") & ~F.col("l_is_dir") & (F.col("r_rel_path") != F.col("expected")) & ~clash)
    files = staged(files.where("_gone or _aside").select("rel_path", "file_id", "md5", "size", "r_rel_path", "_gone", "_aside"), "dir-evidence")
    gone = files.where("_gone").select(F.col("rel_path").alias("path"), "file_id", "md5", "size")
    aside = files.where("_aside").select(F.col("r_rel_path").alias("rel_path"))
    new, fresh = unknown_local(both, "is_dir", "size", "md5"), unknown_remote(both, "rel_path", "is_dir")
    new = new.where("not is_dir").join(aside.union(fresh.where("not is_dir").select("rel_path")), "rel_path", "left_anti")
    pairs = move_pairs(gone, new.select(F.col("rel_path").alias("path"), "md5", "size"))
    told = pairs.select("from", "to", F.explode(proper_ancestors(F.col("from"))).alias("dir")).withColumn("rest", F.substr("from", F.length("dir") + 1))
    told = told.groupBy("dir").agg(F.bool_and(F.endswith("to", F.col("rest")) & (F.length("to") > F.length("rest"))).alias("shaped"), F.count_distinct(F.left("to", F.length("to") - F.length("rest"))).alias("n"), F.min(F.left("to", F.length("to") - F.length("rest"))).alias("new"))
    told = staged(told.where("shaped and n = 1").select(F.col("dir").alias("from"), F.col("new").alias("to")), "told")
    # the sides are cut down to the few paths in question before these meet them
    asked = staged(told.select(F.col("from").alias("rel_path")).union(told.select("to")).distinct(), "asked")
    base, local, remote = (df.join(asked, "rel_path", "left_semi") for df in (tree.base, tree.local, tree.remote))
    at = lambda df, name: df.select(F.col("rel_path").alias(name))
    found = told.join(base.where("is_dir").select(F.col("rel_path").alias("from"), "file_id"), "from").join(at(local, "from"), "from", "left_anti")
    found = found.join(remote.select("file_id", F.col("rel_path").alias("from")), ["file_id", "from"], "left_semi")
    found = found.join(at(local.where("is_dir"), "to"), "to", "left_semi").join(at(base, "to"), "to", "left_anti").join(at(remote, "to"), "to", "left_anti")
    found = staged(found.select("from", "to", "file_id"), "dir-moves")
    inner = found.select("from", F.explode(proper_ancestors(F.col("from"))).alias("above")).join(found.select(F.col("from").alias("above")), "above", "left_semi").select("from").distinct()
    return found.join(inner, "from", "left_anti").select("from", "to", "file_id")


def planned_tree(tree: Tree) -> tuple[DataFrame, DataFrame]:
    """The plan (stage and the columns of ACTION) and the skips (SKIP)."""
    # digests are compared and never told: they are moved and written packed all along
    base, local, remote = (with_packed(df) for df in (tree.base, tree.local, tree.remote))
    tree = replace(tree, base=base, local=local, remote=remote)
    copy = lambda p: conflict_name(p, tree.machine, tree.now)
    rd = staged(remote_dir_moves(base, remote), "remote-dir-moves")
    held = None
    for ids, why in ((tree.shadowed, "remote copy is shadowed"), (tree.unreadable, "local copy can't be read")):
        if ids is not None:
            rows = ids.select("file_id", F.lit(why).alias("_why"))
            held = rows if held is None else held.unionByName(rows.join(held, "file_id", "left_anti"))
    both = tree_sides(tree, None if held is None else held.distinct())
    both = both.withColumn("_why", F.lit(None).cast("string")) if held is None else both
    unknown = staged(unknown_local(both, "is_dir", "size", "mtime_ns", "md5"), "unknown")
    fresh = staged(unknown_remote(both, "rel_path", "is_dir", "md5", "modified_ns"), "fresh")
    ld = staged(local_dir_moves(tree, rd, both), "local-dir-moves")
    every = rd.union(ld.select("from", "to"))
    fresh = carried(fresh, "rel_path", ld, "to_path")
    known = both.where("in_b").drop("in_b", "r_is_dir", "r_modified_ns")
    known = carried(carried(carried(known, "rel_path", ld, "at"), "rel_path", every, "expected", known), "r_rel_path", ld, "r_to_path", known)
    known = known.join(ld.select(F.col("from").alias("_from"), F.col("to").alias("_to")), F.col("is_dir") & (F.col("rel_path") == F.col("_from")), "left")
    known = known.withColumn("at", F.coalesce("_to", "at")).drop("_from", "_to")
    # beneath a directory that moved locally the local row is another one than that at the path of the base
    stays, l_side = F.col("at").eqNullSafe(F.col("rel_path")), ["rel_path", "is_dir", "size", "mtime_ns", "md5"]
    follows = known.where(~stays).drop("in_l", *[f"l_{c}" for c in l_side])
    follows = follows.join(_named(near(local, "rel_path", follows, F.col("at")), "l", *l_side), F.col("at") == F.col("l_rel_path"), "left").drop("l_rel_path")
    known = _flags(known.where(stays).unionByName(follows), "l").withColumn("moved", F.col("in_r") & (F.col("r_to_path") != F.col("expected")))
    drift = (F.col("mtime_ns") != F.col("l_mtime_ns")) | (F.col("size") != F.col("l_size")) | (F.col("version") != F.col("r_version"))
    # files that are everywhere as they were ask for nothing; they are most of a tree
    changed = F.col("moved") | F.col("l_is_dir") | (F.col("l_md5") != F.col("md5")) | (F.col("r_md5") != F.col("drive_md5")) | drift
    known = known.where(F.col("is_dir") | F.col("_why").isNotNull() | ~F.col("in_l") | ~F.col("in_r") | F.coalesce(changed, F.lit(True)))
    known = staged_alike(known, "known", ALIKE | {c: "rel_path" for c in ("at", "expected", "r_to_path")}).withColumn("now_at", F.coalesce("r_to_path", "expected"))

    # files of the base
    rows = known.where("not is_dir and _why is null and not (in_l and l_is_dir)")
    o_side, t_side = (near(df, "rel_path", rows.where("moved"), F.col("now_at")) for df in (local, base))
    at_target = [(_named(o_side, "o", *l_side), F.col("now_at") == F.col("o_rel_path")), (_named(t_side, "t", "rel_path"), F.col("now_at") == F.col("t_rel_path"))]
    new_there = [(_named(fresh, "n", "rel_path", "file_id", "md5"), F.col("at") == F.col("n_rel_path"))]
    rows = _flags(in_parts(rows, (F.col("moved"), at_target), (F.col("in_l") & ~F.col("in_r"), new_there)), "o", "t", "n")
    lm, rm, om, nm = (F.col(f"{x}_md5") for x in "lron")
    rows = rows.withColumns({"lc": F.col("in_l") & (lm != F.col("md5")), "rc": F.col("in_r") & (rm != F.col("drive_md5")), "o_file": F.col("in_o") & ~F.coalesce("o_is_dir", F.lit(False))})
    rows = rows.withColumns({"met": ~F.col("in_l") & F.col("moved") & ~F.col("in_t") & F.col("o_file"), "clash": F.col("in_l") & F.col("lc") & F.col("rc") & (lm != rm)})
    rows = rows.withColumns({"moving": F.col("moved") & F.col("in_l") & ~F.col("clash"), "displaced": F.col("o_file") & ~F.col("in_t")})
    p, at, ex, go, fid = (F.col(c) for c in ("rel_path", "at", "expected", "now_at", "file_id"))
    l_pin, o_pin = (F.col("l_size"), F.col("l_mtime_ns")), (F.col("o_size"), F.col("o_mtime_ns"))
    after = F.when(F.col("moved"), ex)

    def triple(spot: Column, to: Column, file_id: Column) -> Column:
        return F.array(act("conflict_backup", spot, copy(spot)), act("upload", copy(spot), protected_by=spot), act("download", to, file_id=file_id, protected_by=spot))

    one = lambda *a, **k: F.array(act(*a, **k))
    decided = (
        F.when(F.col("met"), F.when(om == rm, one("record", go, file_id=fid, pin=o_pin)).otherwise(triple(go, go, fid)))
        .when(~F.col("in_l") & ~F.col("in_r"), one("forget", p, file_id=fid))
        .when(~F.col("in_l") & (F.col("rc") | F.col("moved")), one("download", go, file_id=fid))
        .when(~F.col("in_l"), _none())
        .when(~F.col("in_r") & F.col("lc") & F.col("in_n") & (nm == lm), one("record", at, file_id=F.col("n_file_id"), pin=l_pin))
        .when(~F.col("in_r") & F.col("lc") & F.col("in_n"), triple(at, at, F.col("n_file_id")))
        .when(~F.col("in_r") & F.col("lc"), one("upload", at))
        .when(~F.col("in_r") & F.col("in_n"), _none())
        .when(~F.col("in_r"), one("quarantine_local", at, file_id=fid, pin=l_pin))
        .when(~F.col("lc") & ~F.col("rc"), F.when(drift, one("record", go, file_id=fid, protected_by=after, pin=l_pin)).otherwise(_none()))
        .when(~F.col("rc"), one("update_remote", go, file_id=fid, protected_by=after))
        .when(~F.col("lc"), one("download", go, file_id=fid, pin=l_pin))
        .when(lm == rm, one("record", go, file_id=fid, protected_by=after, pin=l_pin))
        .otherwise(triple(ex, go, fid))
    )
    aside = F.array(act("conflict_backup", go, copy(go)), act("upload", copy(go), protected_by=go), act("move_local", ex, go, fid, go))
    move = F.when(F.col("displaced"), aside).when(F.col("o_file"), one("move_local", ex, go, fid, pin=o_pin)).otherwise(one("move_local", ex, go, fid))
    first = staged(_rows(rows, F.concat(decided, F.when(F.col("moving"), move).otherwise(_none()))), "first")

    # new local rows, at the paths that they will have
    # what few of the new rows ask for is looked up for these alone and staged, so that the joins with all of them know its size
    used = staged(rows.where("met or (moving and displaced)").select(go.alias("rel_path")), "used")
    back = ld.select(F.col("to").alias("from"), F.col("from").alias("to"))
    new = carried(carried(unknown, "rel_path", every, "target"), "rel_path", back, "origin", unknown)
    new = new.join(back.withColumnsRenamed({"from": "_from", "to": "_to"}), F.col("rel_path") == F.col("_from"), "left").withColumn("origin", F.coalesce("_to", "origin")).drop("_from", "_to")
    explained = _at(base, new.where("origin <> rel_path"), F.col("origin"), "explained")
    new = new.join(_named(explained, "e", "rel_path"), (F.col("origin") != F.col("rel_path")) & (F.col("origin") == F.col("e_rel_path")), "left_anti").drop("origin").join(used, "rel_path", "left_anti")
    taken = _at(remote, new.where("is_dir"), F.col("target"), "taken")
    new = new.join(_named(taken, "x", "rel_path"), F.col("is_dir") & (F.col("target") == F.col("x_rel_path")), "left")
    new = new.join(_named(fresh, "n", "rel_path", "file_id", "is_dir", "md5", "modified_ns"), F.col("target") == F.col("n_rel_path"), "left")
    fold = lambda c: F.array_join(F.transform(F.split(c, "/"), lambda s: fold_key(s, tree.case_fold, False)), "/") if not tree.norm_fold else fold_key(c, tree.case_fold, True)
    met_by_name = fresh.where("not is_dir").withColumn("_fold", fold(F.col("rel_path")))
    new = _flags(new, "n", "x").withColumn("_key", F.when(~F.col("in_n") & ~F.col("is_dir") & F.lit(tree.case_fold or tree.norm_fold), fold(F.col("target"))))
    new = new.join(_named(met_by_name, "f", "_fold", "rel_path", "file_id", "md5", "modified_ns"), (F.col("_key") == F.col("f__fold")) & (F.col("target") != F.col("f_rel_path")), "left")
    new = staged(_flags(new, "f"), "new")
    target, pin = F.col("target"), (F.col("size"), F.col("mtime_ns"))
    newer = lambda x: F.lit(tree.prefer_newer) & (F.col(f"{x}_modified_ns") > 0) & (F.col("mtime_ns") > F.col(f"{x}_modified_ns"))

    def both_new(x: str, same: Column) -> Column:
        spot, other = F.col(f"{x}_rel_path"), F.col(f"{x}_file_id")
        loser = F.array(act("move_remote", spot, copy(spot), other), act("upload", target, protected_by=spot), act("download", copy(spot), file_id=other, protected_by=spot))
        return F.when(F.col(f"{x}_md5") == F.col("md5"), same).when(newer(x), loser).otherwise(triple(target, spot, other))

    renamed = F.array(act("move_local", target, F.col("f_rel_path"), pin=pin), act("record", F.col("f_rel_path"), file_id=F.col("f_file_id"), protected_by=target, pin=pin))
    decided = (
        F.when(F.col("is_dir") & F.col("in_n") & F.col("n_is_dir"), one("record", target, file_id=F.col("n_file_id"), is_dir=True))
        .when(F.col("is_dir") & ~F.col("in_n") & ~F.col("in_x"), one("mkdir_remote", target, is_dir=True))
        .when(F.col("is_dir") | (F.col("in_n") & F.col("n_is_dir")), _none())
        .when(F.col("in_n"), both_new("n", one("record", target, file_id=F.col("n_file_id"), pin=pin)))
        .when(F.col("in_f"), both_new("f", renamed))
        .otherwise(_none())
    )
    second = staged(_rows(new, decided), "second")
    lone = new.where("not is_dir and not in_n and not in_f").select(target.alias("path"), "md5", "size", F.col("rel_path").alias("own"))
    gone = rows.where("not in_l and in_r and not rc and not moved").select(p.alias("path"), "file_id", "md5", "size")
    # sources and new files meet in the order of their own paths; the move goes to where the file will be
    pairs = staged(move_pairs(gone, lone.select(F.col("own").alias("path"), "md5", "size")), "pairs")
    moves = pairs.join(lone.select(F.col("own").alias("to"), F.col("path").alias("goal")), "to")
    uploads = _rows(lone.join(pairs.select(F.col("to").alias("own")), "own", "left_anti"), one("upload", F.col("path")))
    trash = _rows(gone.join(pairs.select(F.col("from").alias("path")), "path", "left_anti"), one("trash_remote", F.col("path"), file_id=fid))

    # new remote rows that nobody has met
    claimed = rows.where("in_n and lc and not in_r").select(F.col("n_rel_path").alias("rel_path")).union(new.where("in_n").select("n_rel_path")).union(new.where("in_f").select("f_rel_path"))
    left = fresh.join(claimed, "rel_path", "left_anti").join(_named(local, "l", "rel_path", "is_dir", "size", "mtime_ns"), F.col("to_path") == F.col("l_rel_path"), "left")
    vacated = first.union(second).where(F.col("type").isin("move_local", "conflict_backup")).select(F.col("rel_path").alias("_gone")).distinct()
    left = left.join(vacated, F.col("to_path") == F.col("_gone"), "left")
    left = staged(_flags(left, "l").withColumn("odd", F.col("in_l") & (F.col("l_is_dir") != F.col("is_dir"))), "left")
    to = F.col("to_path")
    here = F.col("in_l") & F.col("_gone").isNull()
    third = _rows(left.where("not odd"), F.when(F.col("is_dir"), one("mkdir_local", to, file_id=fid, is_dir=True)).when(here, one("download", to, file_id=fid, pin=l_pin)).otherwise(one("download", to, file_id=fid)))

    acts = first.union(second).union(_rows(moves, one("move_remote", F.col("from"), F.col("goal"), fid))).union(uploads).union(third)
    dir_moves = carried(rd, "from", every, "start").where("start <> to")
    acts = staged(acts.union(_rows(dir_moves, one("move_local", F.col("start"), F.col("to"), is_dir=True))).union(_rows(ld, one("move_remote", F.col("from"), F.col("to"), fid, is_dir=True))), "acts")

    # directories of the base, once all else is known
    made = F.when(F.col("type").isin("move_remote", "move_local", "conflict_backup"), F.col("new_rel_path")).when(~F.col("type").isin("forget", "quarantine_local", "trash_remote"), p)
    full = staged(beneath(acts.select(made.alias("rel_path")).where("rel_path is not null")), "full")
    alive = beneath(fresh.select("rel_path"))
    dirs = known.where("is_dir and _why is null")
    for name, column, of in (("u1", "rel_path", full), ("u2", "expected", full), ("u3", "r_rel_path", full), ("u4", "r_to_path", full), ("u5", "r_rel_path", alive)):
        dirs = dirs.join(of.select(F.col("dir").alias(f"{name}_dir"), F.lit(True).alias(f"in_{name}")), F.col(column) == F.col(f"{name}_dir"), "left")
    dirs = dirs.join(local.where("is_dir").select(F.col("rel_path").alias("h_dir"), F.lit(True).alias("in_h")), F.col("r_rel_path") == F.col("h_dir"), "left")
    dirs = _flags(dirs, "u1", "u2", "u3", "u4", "u5", "h")
    fourth = _rows(
        dirs,
        F.when(F.col("in_l") & F.col("in_r"), _none())
        .when(F.col("in_l") & (F.col("in_u1") | F.col("in_u2")), one("mkdir_remote", p, is_dir=True))
        .when(F.col("in_l"), one("quarantine_local", at, file_id=fid, is_dir=True))
        .when(F.col("in_r") & (F.col("in_h") | F.col("in_u3") | F.col("in_u4") | F.col("in_u5")), _none())
        .when(F.col("in_r"), one("trash_remote", F.col("r_rel_path"), file_id=fid, is_dir=True))
        .otherwise(one("forget", p, file_id=fid, is_dir=True)),
    )
    plan = acts.union(trash).union(fourth)
    under = ld.select(F.col("to").alias("_to"))
    inside = plan.where("type = 'mkdir_remote'").select("rel_path", F.explode(F.concat(proper_ancestors(p), F.array(p))).alias("_to")).join(under, "_to", "left_semi").select(F.col("rel_path").alias("_late")).distinct()
    plan = plan.join(inside, (F.col("type") == "mkdir_remote") & (p == F.col("_late")), "left")
    t = F.col("type")
    stage = (
        F.when((t == "move_local") & F.col("is_dir"), 1).when(t.startswith("mkdir"), F.when(F.col("_late").isNotNull(), 4).otherwise(2)).when((t == "move_remote") & F.col("is_dir"), 3)
        .when(t.isin("move_local", "move_remote", "conflict_backup"), 5).when(t.isin("upload", "update_remote", "download", "record"), 6).otherwise(7)
    )
    plan = plan.select(stage.alias("stage"), *[c.split()[0] for c in ACTION.split(", ")])
    clashes = new.where("(is_dir and in_n and not n_is_dir) or (not is_dir and in_n and n_is_dir)").select(target.alias("rel_path")).union(left.where("odd").select("to_path"))
    skips = known.where("_why is not null").select("rel_path", F.col("_why").alias("reason"))
    skips = skips.union(known.where("not is_dir and _why is null and in_l and l_is_dir").select("rel_path", F.lit("a directory took the place of the file")))
    return plan, skips.union(clashes.select("rel_path", F.lit("a file on one side, a directory on the other")))


def run_order() -> list[Column]:
    """The order in which a plan runs: by stage, backups before other moves, directories from the top, deletes from the bottom."""
    p, s = F.col("rel_path"), F.col("stage")
    d = F.when(s == 7, -depth(p)).when(s == 6, 0).otherwise(depth(p))
    return [s, F.col("type") != "conflict_backup", d, F.when(s != 7, p), F.when(s == 7, p).desc(), F.col("type"), F.col("new_rel_path"), F.col("file_id")]


def numbered(df: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """df with the place of each row in a total order, from 1: ranges are sorted apart, and their sizes added up before them."""
    rows = staged(in_ranges(df, order, order), "ranges")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # a row for each range, as many as there are shuffle partitions
    starts = staged(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"), "starts")
    return rows.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def collapsed_tree(plan: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with deletes of one kind beneath a deleted directory gathered into its row, and the deletes that went.

    The plan has subtree_files and entries, how many of them lie beneath; they themselves are rows of root, type, rel_path,
    is_dir, file_id, size and mtime_ns, so that a directory can hold any number.

    A directory qualifies if nothing but deletes happens beneath it, at either end of a move, and, where it goes to the
    remote bin, every remote row beneath it is deleted or forgotten by the plan. Of nested ones the highest counts; deletes of
    the other kind beneath it stay rows of their own.
    """
    deletes = F.col("type").isin("quarantine_local", "trash_remote")
    busy = plan.where(~deletes & (F.col("type") != "forget"))
    busy = beneath(busy.select("rel_path").union(busy.where("new_rel_path is not null").select("new_rel_path"))).select(F.col("dir").alias("root"))
    planned = plan.where(F.col("type").isin("trash_remote", "forget")).select("rel_path")
    strange = beneath(remote.select("rel_path").join(planned, "rel_path", "left_anti")).select(F.col("dir").alias("root"), F.lit("trash_remote").alias("kind"))
    dirs = plan.where(deletes & F.col("is_dir")).select(F.col("rel_path").alias("root"), F.col("type").alias("kind"))
    dirs = staged(dirs.join(busy, "root", "left_anti").join(strange, ["root", "kind"], "left_anti"), "roots")
    inner = dirs.select("root", F.explode(proper_ancestors(F.col("root"))).alias("above")).join(dirs.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    roots = dirs.join(inner, "root", "left_anti")
    covered = plan.where(deletes).select("*", F.explode(proper_ancestors(F.col("rel_path"))).alias("root")).join(roots, "root").where("type = kind")
    covered = staged(covered, "covered")
    counts = covered.groupBy(F.col("root").alias("_root"), F.col("kind").alias("_kind")).agg(F.count_if(~F.col("is_dir")).alias("subtree_files"), F.count("*").alias("entries"))
    kept = plan.join(covered.select("type", "rel_path").distinct(), ["type", "rel_path"], "left_anti").select(*plan.columns)
    kept = kept.join(counts, (F.col("rel_path") == F.col("_root")) & (F.col("type") == F.col("_kind")) & F.col("is_dir"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.select(*plan.columns, count("subtree_files"), count("entries")), covered.select("root", "type", "rel_path", "is_dir", "file_id", F.col("pin_size").alias("size"), F.col("pin_mtime").alias("mtime_ns"))


def guarded(plan: DataFrame, tracked: int, threshold: float, confirmed: bool, bin_available: bool, least: int = 10) -> DataFrame:
    """deletions, tripped: files that a plan takes away locally, those of gathered directories too, and whether these are too many."""
    n = F.coalesce(F.sum(F.when(F.col("type") == "quarantine_local", F.when(F.col("is_dir"), F.col("subtree_files")).otherwise(1))), F.lit(0)).cast("long")
    on = F.lit(not confirmed and not bin_available and tracked > 0) & (F.col("deletions") > least) & (F.col("deletions") > threshold * tracked)
    return plan.agg(n.alias("deletions")).select("deletions", on.alias("tripped"))


def without_deletes(plan: DataFrame) -> DataFrame:
    """The plan as it runs where deletes are put off."""
    return plan.where(~F.col("type").isin("trash_remote", "quarantine_local"))


def overlaps_tree(plan: DataFrame) -> DataFrame:
    """rel_path, problem: paths that the transfer stage touches twice, and files beneath a path that it writes as a file."""
    rows = staged(plan.where("stage = 6").select("rel_path", "is_dir"), "transfers")
    twice = rows.groupBy("rel_path").agg(F.count("*").alias("n")).where("n > 1").select("rel_path", F.lit("twice").alias("problem"))
    files = rows.where("not is_dir").select("rel_path")
    return twice.union(within(files).select("rel_path", F.lit("beneath").alias("problem")).distinct())


def expanded(base: DataFrame, paths: DataFrame) -> DataFrame:
    """file_id of every base row at one of the paths (rel_path) or beneath it: what is shadowed or can't be read."""
    at = base.select("file_id", F.explode(F.concat(proper_ancestors(F.col("rel_path")), F.array("rel_path"))).alias("rel_path"))
    return at.join(paths.select("rel_path"), "rel_path", "left_semi").select("file_id").distinct()


__all__ = ["Tree", "planned_tree", "collapsed_tree", "guarded", "without_deletes", "overlaps_tree", "expanded", "numbered", "run_order", "carried", "beneath", "join_path"]
