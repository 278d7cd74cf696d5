"""What is counted while one watches: changes since the last cycle, failures in a row, and silences between signs of life.

Each sequence (`within`) is cut into ranges of its order, so that one that has a third of all rows spreads over many tasks.
What a range hands on to the next follows from a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.sources.tables import staged

BLOCK_ROWS = 250_000


def ranges(rows: DataFrame, *keys: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with _block: the number of their range in the order of keys, as many ranges as the rows ask for."""
    n = max(8, rows.count() // block_rows + 1)
    return staged(rows.repartitionByRange(n, *keys).withColumn("_block", F.spark_partition_id()), "ranges")


def since(events: DataFrame, within: str, order: str, counted: Column, reset: Column, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """events with a column `name`: how many counted ones there were since the last reset, up to and with each; 0 at a reset.

    Orders must be unique within a sequence. A null condition is none.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = ranges(events.withColumn("_reset", flag(reset)).withColumn("_counted", flag(counted) & ~F.col("_reset")), within, order, block_rows=block_rows)
    along = Window.partitionBy(within, "_block").orderBy(order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_resets", F.sum(F.col("_reset").cast("long")).over(upto))
    here = Window.partitionBy(within, "_block", "_resets").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.sum(F.col("_counted").cast("long")).over(here))
    # a range hands on what it counted behind its last reset, and what came into it if it had none
    ends = rows.groupBy(within, "_block").agg(F.max("_resets").alias("_resets"), F.max_by("_here", order).alias("_here"))
    before = Window.partitionBy(within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_group", F.coalesce(F.sum((F.col("_resets") > 0).cast("long")).over(before), F.lit(0)))
    own = ends.select(within, "_block", F.when(F.col("_resets") > 0, F.col("_group") + 1).otherwise(F.col("_group")).alias("_group"), "_here")
    total = Window.partitionBy(within, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_in", F.sum("_here").over(total))
    handed = own.select(within, (F.lead("_block").over(Window.partitionBy(within).orderBy("_block"))).alias("_block"), "_in").where("_block is not null")
    out = rows.join(handed, [within, "_block"], "left")
    return out.withColumn(name, F.col("_here") + F.when(F.col("_resets") == 0, F.coalesce("_in", F.lit(0))).otherwise(0)).select(*events.columns, name)


def latched(events: DataFrame, within: str, order: str, failed: Column, least: int = 3) -> DataFrame:
    """events with failures (in a row, up to each) and latched: whether there are so many. Anything that didn't fail begins anew."""
    gone = F.coalesce(failed, F.lit(False))
    return since(events, within, order, gone, ~gone, "failures").withColumn("latched", F.col("failures") >= least)


def silences(beats: DataFrame, within: str, ts: str, micros: int, until: Column) -> DataFrame:
    """within, last, back: signs of life that none followed for longer than micros; back is null where none did before `until`.

    ts is a timestamp; signs at the same time are one.
    """
    rows = ranges(beats.where(F.col(ts).isNotNull()).select(within, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")), within, "_at")
    along = Window.partitionBy(within, "_block").orderBy("_at")
    rows = rows.withColumn("_next", F.lead("_at").over(along))
    first = rows.groupBy(within, "_block").agg(F.min("_at").alias("_first"))
    behind = first.select(within, "_block", F.lead("_first").over(Window.partitionBy(within).orderBy("_block")).alias("_later"))
    rows = rows.join(behind, [within, "_block"]).withColumn("_next", F.coalesce("_next", "_later"))
    last, limit = F.col("_at"), F.unix_micros(until.cast("timestamp"))
    ended = F.when(F.col("_next").isNull(), limit).otherwise(F.col("_next")) - last > micros
    return rows.where(ended).select(within, F.timestamp_micros(last).alias("last"), F.timestamp_micros("_next").alias("back"))
