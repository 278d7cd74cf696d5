"""Trees kept as nodes (file_id, parent_id, name): siblings that collide, paths, and what can be reached from a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.paths import ignored, join_path, valid_name
from trellis.functions.reports import nanoseconds
from trellis.sources.tables import staged

FOLDER, NATIVE_PREFIX = "application/vnd.google-apps.folder", "application/vnd.google-apps"


def siblings(nodes: DataFrame, key: Column) -> DataFrame:
    """Each node with verdict: kept, duplicate (same name as the first of its key) or collision (another name).

    One window over parent and key, in the order of ids: exact twins of a node that lost by its key are collisions too,
    as they never met the twin.
    """
    among = Window.partitionBy("parent_id", "_key").orderBy("file_id")
    rows = nodes.withColumn("_key", key).withColumn("_n", F.row_number().over(among)).withColumn("_first", F.first("name").over(among))
    verdict = F.when(F.col("_n") == 1, "kept").when(F.col("name") == F.col("_first"), "duplicate").otherwise("collision")
    return rows.withColumn("verdict", verdict).drop("_key", "_n", "_first")


def duplicates(nodes: DataFrame) -> DataFrame:
    """parent_id, name, n, kept: names that a directory has several times, how often, and the id that stays, which is the first."""
    return nodes.groupBy("parent_id", "name").agg(F.count("*").alias("n"), F.min("file_id").alias("kept")).where("n > 1")


def child_rules(nodes: DataFrame, globs: list[str]) -> DataFrame:
    """Each node with rule: the first that keeps it out (trashed, native, ignored, invalid), or ok."""
    native = F.startswith("mime_type", F.lit(NATIVE_PREFIX)) & (F.col("mime_type") != FOLDER)
    rule = F.when(F.col("trashed"), "trashed").when(native, "native").when(ignored(F.col("name"), globs), "ignored").when(~valid_name(F.col("name")), "invalid").otherwise("ok")
    return nodes.withColumn("rule", rule)


def tree_paths(nodes: DataFrame, root: str, most: int = 10_000) -> DataFrame:
    """file_id, rel_path, depth of every node beneath root; nodes on cycles, and beneath what isn't there, are left out.

    Nodes that hold others find their way up in rounds of doubling: after k of them each has its path from its 2^k-th
    ancestor, so that a depth of 10,000 takes 14 equality joins. As long as anything beneath root is left, the ancestors
    just behind those that are done get done in the next round; a round that gets none done leaves only cycles. All other
    nodes are joined once, with the directory that holds them. Rounds are written in the shared folder. Trees that are
    deeper than `most` levels are an error.
    """
    rows = staged(nodes.where(F.col("file_id") != root).select("file_id", "parent_id", "name"), "nodes")
    holders = rows.select(F.col("parent_id").alias("file_id")).distinct()
    inner = rows.join(holders, "file_id", "left_semi").select("file_id", F.col("parent_id").alias("up"), F.col("name").alias("rel_path"), F.lit(1).alias("depth"))
    at = staged(inner.withColumn("done", F.coalesce(F.col("up") == root, F.lit(False))), "round")
    done, left = [at.where("done").drop("up")], at.where("not done")
    while True:
        above = left.select(F.col("file_id").alias("up"), F.col("up").alias("_up"), F.col("rel_path").alias("_path"), F.col("depth").alias("_depth"), "done")
        for part in done:
            above = above.union(part.select(F.col("file_id").alias("up"), F.lit(None).alias("_up"), F.col("rel_path").alias("_path"), F.col("depth").alias("_depth"), "done"))
        jumped = left.drop("done").join(above, "up").select("file_id", F.col("_up").alias("up"), join_path(F.col("_path"), F.col("rel_path")).alias("rel_path"), (F.col("depth") + F.col("_depth")).alias("depth"), "done")
        at = staged(jumped, "round")
        deepest = at.where("done").agg(F.max("depth")).first()[0]
        if deepest is None:
            break
        if deepest > most:
            raise ValueError(f"directories are nested more than {most} deep")
        done.append(at.where("done").drop("up"))
        left = at.where("not done")
    dirs = done[0]
    for part in done[1:]:
        dirs = dirs.union(part)
    dirs = dirs.select("file_id", "rel_path", "depth")
    leaves = rows.join(holders, "file_id", "left_anti")
    beneath = leaves.join(dirs.select(F.col("file_id").alias("parent_id"), "rel_path", "depth"), "parent_id").select("file_id", join_path(F.col("rel_path"), F.col("name")).alias("rel_path"), (F.col("depth") + 1).alias("depth"))
    return dirs.union(leaves.where(F.col("parent_id") == root).select("file_id", F.col("name").alias("rel_path"), F.lit(1).alias("depth"))).union(beneath)


def pruned(nodes: DataFrame, root: str) -> DataFrame:
    """The nodes that root doesn't reach: those that a mirror drops."""
    return nodes.where(F.col("file_id") != root).join(tree_paths(nodes, root).select("file_id"), "file_id", "left_anti")


def children(nodes: DataFrame, parent: str, *columns: str) -> DataFrame:
    """The named columns of what lies in a directory and not in the bin; both conditions reach the scan."""
    return nodes.where((F.col("parent_id") == parent) & ~F.col("trashed")).select(*columns)


def from_feed(files: DataFrame) -> DataFrame:
    """Rows of the mirror from listed files: times as nanoseconds, 0 where none or an unreadable one is given."""
    return files.select("file_id", "parent_id", "name", "mime_type", F.coalesce("md5", F.lit("")).alias("md5"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("trashed", F.lit(False)).alias("trashed"), nanoseconds(F.col("modified")).alias("modified_ns"))


def found(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of any number of keys at once."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")
