"""A folder tree as a snapshot: listed level by level, one directory a row, with hashes of what has drifted only."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.paths import TEMP_PREFIX, basename, ignored, valid_name
from trellis.sources.tables import staged

LISTED = "rel_path string, kind string, size long, mtime_ns long, note string"
#: Why an entry of a kind is no row of the snapshot.
REASONS = {"symlink": "a link, which is left alone", "other": "neither file nor directory", "unnamed": "its name can't be read as text"}


def _listed(root: str):
    schema = pa.schema([("rel_path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("note", pa.string())])

    def entries(rel: str) -> Iterator[tuple]:
        try:
            found = list(os.scandir(os.path.join(root, rel)))
        except OSError as e:
            if not rel:
                raise
            yield rel, "unreadable", 0, 0, os.strerror(e.errno)
            return
        for e in found:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                path.encode()
            except UnicodeEncodeError:
                yield path.encode("utf-8", "replace").decode(), "unnamed", 0, 0, None
                continue
            try:
                s = e.stat(follow_symlinks=False)
            except FileNotFoundError:
                continue  # gone since it was listed
            kind = next((k for k, is_ in (("symlink", stat.S_ISLNK), ("dir", stat.S_ISDIR), ("file", stat.S_ISREG)) if is_(s.st_mode)), "other")
            yield path, kind, s.st_size, s.st_mtime_ns, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                rows = list(entries(rel))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def listing(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """rel_path, kind, size, mtime_ns, note of all entries beneath root, which every executor must have mounted.

    Ignored names are left out with all beneath them. Directories of invalid names and unreadable ones are rows, and are not
    entered. A root that can't be read is an error. Each level is written in the shared folder.
    """
    level = spark.createDataFrame([("",)], "rel_path string")
    levels: list[DataFrame] = []
    while not levels or not level.isEmpty():
        found = level.select("rel_path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_listed(root), LISTED)
        found = found.where((F.col("kind") == "unreadable") | ~ignored(basename(F.col("rel_path")), globs))
        levels.append(staged(found, "listing"))
        level = levels[-1].where((F.col("kind") == "dir") & valid_name(basename(F.col("rel_path"))))
    out = levels[0]
    for rows in levels[1:]:
        out = out.union(rows)
    return out


def _hash(root: str):
    @F.arrow_udf("string")
    def md5(paths: pa.Array) -> pa.Array:
        out = []
        for rel in paths.to_pylist():
            with open(os.path.join(root, rel), "rb") as f:
                out.append(hashlib.file_digest(f, "md5").hexdigest())
        return pa.array(out, pa.string())

    return md5


def scanned(spark: SparkSession, root: str, base: DataFrame, globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """The local snapshot (rel_path, is_dir, size, mtime_ns, md5) and the skips (rel_path, reason, unreadable).

    A file with the size and time of its row in the base keeps that row's hash; only all others are read, in pieces. An
    unreadable directory is a row and a skip, so that what the base has beneath it can be held.
    """
    rows = listing(spark, root, globs)
    good = valid_name(basename(F.col("rel_path")))
    reason = F.coalesce(*[F.when(F.col("kind") == k, text) for k, text in REASONS.items()], F.when(F.col("kind") == "unreadable", F.concat(F.lit("nothing beneath it is touched, as it can't be listed: "), "note")), F.when(~good, "its name can't be used"))
    skips = rows.select("rel_path", reason.alias("reason"), (F.col("kind") == "unreadable").alias("unreadable")).where("reason is not null")
    dirs = rows.where((F.col("kind") == "dir") & good).select("rel_path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.lit("").alias("md5"))
    known = base.where("not is_dir").select("rel_path", "size", "mtime_ns", "md5")
    files = rows.where((F.col("kind") == "file") & good).select("rel_path", F.lit(False).alias("is_dir"), "size", "mtime_ns").join(known, ["rel_path", "size", "mtime_ns"], "left")
    files = files.select("rel_path", "is_dir", "size", "mtime_ns", "md5")
    drifted = files.where("md5 is null")
    spread = drifted.repartition(spark.sparkContext.defaultParallelism * 4).withColumn("md5", _hash(root)(F.col("rel_path")))
    return dirs.union(files.where("md5 is not null")).union(spread), skips


def temporary(spark: SparkSession, root: str) -> DataFrame:
    """rel_path of the files that an interrupted transfer left behind; ignored names of the user's don't hide them."""
    rows = spark.createDataFrame([("",)], "rel_path string")
    found = []
    while not found or not rows.isEmpty():
        found.append(staged(rows.select("rel_path").mapInArrow(_listed(root), LISTED), "orphans"))
        rows = found[-1].where("kind = 'dir'")
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out.where((F.col("kind") == "file") & F.startswith(basename(F.col("rel_path")), F.lit(TEMP_PREFIX))).select("rel_path")
