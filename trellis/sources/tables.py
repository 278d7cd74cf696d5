"""Reading the tables of a folder, and tables written on the way in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only where none is set and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet (zstd: most of it is paths and digests) under spark.checkpoint.dir and read again."""
    spark = df.sparkSession
    path = f"{shared(spark)}/trellis/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def staged_alike(df: DataFrame, name: str, like: dict[str, str]) -> DataFrame:
    """df staged; a column that mostly equals another one (like: its name to that one's) is written only where it differs."""
    same = {c: F.col(c).eqNullSafe(F.col(o)) for c, o in like.items()}
    rows = df.select(*[F.when(~same[c], F.col(c)).alias(c) if c in like else c for c in df.columns], *[is_same.alias(f"_{c}_same") for c, is_same in same.items()])
    back = staged(rows, name)
    return back.select(*[F.when(F.col(f"_{c}_same"), F.col(like[c])).otherwise(F.col(c)).alias(c) if c in like else c for c in df.columns])


def union_of(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def packed(text: Column) -> Column:
    """The text as bytes behind a mark, a digest in lower-case hex as those that it stands for, which are half as many."""
    is_hex = F.coalesce(F.lower(F.hex(F.unhex(text))) == text, F.lit(False))
    return F.when(is_hex, F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked(held: Column) -> Column:
    """The text that was packed."""
    rest = F.substring(held, 2, 2**31 - 1)
    return F.when(F.substring(held, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
