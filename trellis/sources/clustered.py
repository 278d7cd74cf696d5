"""Tables laid out by key, so that looking up some keys opens few files.

A table is range-sorted by its key: each file holds a range of keys of its own, with a bloom filter and the bounds of its row
groups. The bounds of the files, a row each, lie beside them. A lookup finds the files whose ranges its keys fall into, which
is a binary search per key in the tasks that hold the keys, and reads those alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trellis.sources.tables import shared

#: Files whose bounds a lookup sends to its tasks at most; a larger table is to be cut by a partition column above it.
MOST_FILES = 1_000_000


@dataclass(frozen=True)
class Clustered:
    spark: SparkSession
    path: str
    key: str
    schema: StructType

    def bounds(self) -> list[tuple]:
        """(low, high, file) in order; one row a file."""
        rows = self.spark.read.parquet(f"{self.path}/bounds").orderBy("low").limit(MOST_FILES + 1).collect()
        if len(rows) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files")
        return [tuple(r) for r in rows]

    def files(self, keys: DataFrame) -> list[str]:
        """The files that can have rows of the keys."""
        bounds = self.bounds()
        if not bounds:
            return []
        lows, highs = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])

        def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(lows), bool)
            for batch in batches:
                of = np.array(batch.column(0).drop_null().to_pylist(), lows.dtype)
                # a key that many rows share can fill several files: from the first that ends at it to the last that begins there
                first, last = np.searchsorted(highs, of, side="left"), np.searchsorted(lows, of, side="right")
                change = np.zeros(len(lows) + 1, np.int64)
                np.add.at(change, first[first < last], 1)
                np.add.at(change, last[first < last], -1)
                seen |= np.cumsum(change)[:-1] > 0
            yield pa.record_batch({"file": pa.array(np.flatnonzero(seen), pa.int64())})

        found = keys.select(self.key).distinct().mapInArrow(hit, "file long").distinct().collect()
        return [bounds[r[0]][2] for r in sorted(found)]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of any number of keys. Null keys have none; keys that come twice count once."""
        files = self.files(keys)
        rows = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return rows.join(keys.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.names)


def clustered(df: DataFrame, key: str, files: int, path: str | None = None) -> Clustered:
    """df written in ranges of its key. Rows with a null key are kept in files of their own that no lookup opens."""
    spark, path = df.sparkSession, path or f"{shared(df.sparkSession)}/trellis/clustered-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(files, key).sortWithinPartitions(key)
    ranged.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows").where(F.col(key).isNotNull())
    bounds = rows.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    bounds.select("low", "high", "file").coalesce(1).write.parquet(f"{path}/bounds")
    return Clustered(spark, path, key, df.schema)
