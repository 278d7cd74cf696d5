"""Change feeds as streams: every micro-batch is merged into a versioned table, and a replay of it changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trellis.functions.paths import ignored
from trellis.sources.store import Store


def change_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def state_of(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table as of the last commit, empty before the first."""
    store = Store(spark, folder)
    return store.table("rows") if "rows" in store.tables() else spark.createDataFrame([], schema)


def merge_stream(changes: DataFrame, folder: str, checkpoint: str, key: str, seq: str, removed: str, every: str | None = None, buckets: int = 64, most_parts: int = 8) -> StreamingQuery:
    """Merges changes batch by batch into the keyed table in folder: all there are, or, with `every`, for good at that interval.

    A batch writes the rows that it changes and nothing else; buckets that have gathered more than most_parts such parts are
    rewritten behind it. A batch and its number are one commit; offsets are kept once that is done. A batch that comes again
    after a crash is known by its number. A replay from other offsets merges the same changes again, which ends in the same
    table.
    """
    schema, mark = StructType([f for f in changes.schema if f.name not in (seq, removed)]), f"batch:{checkpoint}"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, folder)
        if "rows" not in store.tables():
            store.keyed("rows", spark.createDataFrame([], schema), key, buckets)
        if number > int(store.meta(mark) or -1):
            store.merge("rows", batch, F.col(seq), F.col(removed), {mark: str(number)})
        store.compact("rows", most_parts)

    when = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**when).start()


def debounced(events: DataFrame, ts: str, gap: str = "500 milliseconds", late: str = "10 seconds", *within: str) -> DataFrame:
    """One row for each burst of events, of each of `within`, that are less than gap apart; from a stream, once it is over."""
    bursts = events.withWatermark(ts, late).groupBy(*within, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return bursts.select(*within, "first", "last", "n")


def telling(events: DataFrame, root: str, globs: list[str]) -> DataFrame:
    """The events (path, op) that are worth a cycle: content came, went or moved, and no name on the way from root is ignored.

    The root itself always is. Of paths elsewhere only the last name counts.
    """
    within = F.startswith("path", F.lit(root + "/"))
    names = F.when(within, F.split(F.substr("path", F.lit(len(root) + 2)), "/")).otherwise(F.array(F.substring_index("path", "/", -1)))
    quiet = F.exists(names, lambda name: ignored(name, globs))
    return events.where(F.col("op").isin("create", "write", "remove", "rename") & ((F.col("path") == root) | ~quiet))
