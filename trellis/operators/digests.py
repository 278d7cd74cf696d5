"""Trees compared by digests: each directory has one of all that lies beneath it, and only unequal directories are opened.

A digest is made of sums and exclusive ors of the hashes of entries, so that parts are combined before the shuffle and no
directory, however full, is gathered in one place. Files are summed by their directory first; only these sums go up to the
ancestors. The entries of a tree are kept in buckets by the hash of their directory, and a comparison goes down level by
level, reading the buckets of unequal directories alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.paths import dirname, proper_ancestors
from trellis.sources.tables import shared, staged

_PARTS = ("_n", "_low", "_high", "_mix")
BUCKET = "_bucket"


def _hashed(content: Column) -> list[Column]:
    """What is summed up of an entry. Paths are part of it, so that equal contents elsewhere are something else."""
    one, two = F.xxhash64("rel_path", "is_dir", content), F.xxhash64(content, "is_dir", "rel_path", F.lit(1))
    return [F.lit(1).cast("long").alias("_n"), one.bitwiseAND(F.lit(0xFFFFFFFF)).alias("_low"), F.shiftrightunsigned(one, 32).alias("_high"), two.alias("_mix")]


def _combined(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("_n").alias("_n"), F.sum("_low").alias("_low"), F.sum("_high").alias("_high"), F.bit_xor("_mix").alias("_mix"))


def digested(tree: DataFrame, content: Column) -> DataFrame:
    """parent, rel_path, is_dir, digest, entries of every entry of a tree (rel_path, is_dir and more), and of its root, ''.

    The digest of a file is made of its content; that of a directory of all entries beneath it, whose number is `entries`,
    and of itself. Directories that are only named by what lies in them are there too. Paths are unique; '' is the root.
    """
    rows = tree.select("rel_path", "is_dir", content.cast("string").alias("_content"))
    hashed = rows.select("rel_path", "is_dir", dirname(F.col("rel_path")).alias("parent"), *_hashed(F.col("_content")))
    direct = staged(_combined(hashed, "parent"), "sums")
    # the sums of each directory, for itself and for those above it
    above = F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), proper_ancestors(F.col("parent")), F.array("parent")))
    sums = _combined(direct.select(F.explode(above).alias("rel_path"), *_PARTS), "rel_path")
    text = F.md5(F.concat_ws(":", *_PARTS))
    kept = hashed.where("is_dir").select("rel_path", F.col("_low").alias("_a"), F.col("_high").alias("_b"))
    full = sums.join(kept, "rel_path", "full_outer").select("rel_path", F.lit(True).alias("is_dir"), F.md5(F.concat_ws(":", *[F.coalesce(c, F.lit(0)) for c in _PARTS], F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))).alias("digest"), F.coalesce("_n", F.lit(0)).alias("entries"))
    files = hashed.where("not is_dir").select("rel_path", "is_dir", text.alias("digest"), F.lit(0).cast("long").alias("entries"))
    return full.union(files).select(F.when(F.col("rel_path") != "", dirname(F.col("rel_path"))).alias("parent"), "rel_path", "is_dir", "digest", "entries")


@dataclass
class DigestTree:
    """The digests of a tree as they are kept: entries in buckets of their directory; the root's own lies by itself."""

    spark: SparkSession
    path: str
    buckets: int
    root: str | None

    def beneath(self, parents: DataFrame, buckets: list[int]) -> DataFrame:
        """The entries of directories that lie in these buckets; no other bucket is read."""
        rows = self.spark.read.schema(f"parent string, rel_path string, is_dir boolean, digest string, {BUCKET} int").parquet(self.path)
        return rows.where(F.col(BUCKET).isin(buckets)).join(parents, "parent", "left_semi").drop(BUCKET)


def _bucket(parent: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")


def kept_tree(tree: DataFrame, content: Column, buckets: int = 64, path: str | None = None) -> DigestTree:
    spark = tree.sparkSession
    path = path or f"{shared(spark)}/trellis/digests-{uuid.uuid4().hex}"
    found = staged(digested(tree, content), "digests")
    rows = found.where("parent is not null").select("parent", "rel_path", "is_dir", "digest", _bucket(F.col("parent"), buckets).alias(BUCKET))
    # a directory with a third of all entries is one bucket and still many files
    rows.repartition(BUCKET, F.pmod(F.xxhash64("rel_path"), F.lit(8))).write.partitionBy(BUCKET).parquet(path)
    root = found.where("parent is null").select("digest").first()
    return DigestTree(spark, path, buckets, root and root[0])


def differences(a: DigestTree, b: DigestTree) -> DataFrame:
    """rel_path, why of what differs: changed (both files), kind (file and directory), only_a, only_b (topmost, not what lies in it).

    Directories that are equal are never opened. A level costs two joins over the entries of the directories that differ.
    """
    if a.buckets != b.buckets:
        raise ValueError("both trees must have the same number of buckets")
    spark, out = a.spark, []
    none = spark.createDataFrame([], "rel_path string, why string")
    if a.root == b.root:
        return none
    frontier = spark.createDataFrame([("",)], "parent string")
    while True:
        places = [r[0] for r in frontier.select(_bucket(F.col("parent"), a.buckets)).distinct().collect()]
        if not places:
            break
        sides = [t.beneath(frontier, places).select("rel_path", F.col("is_dir").alias(f"dir_{x}"), F.col("digest").alias(f"digest_{x}")) for t, x in ((a, "a"), (b, "b"))]
        level = staged(sides[0].join(sides[1], "rel_path", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))), "level")
        both = F.col("dir_a") & F.col("dir_b")
        why = F.when(F.col("dir_b").isNull(), "only_a").when(F.col("dir_a").isNull(), "only_b").when(F.col("dir_a") != F.col("dir_b"), "kind").otherwise("changed")
        out.append(level.where(~F.coalesce(both, F.lit(False))).select("rel_path", why.alias("why")))
        frontier = level.where(both).select(F.col("rel_path").alias("parent"))
    for rows in out:
        none = none.union(rows)
    return none
