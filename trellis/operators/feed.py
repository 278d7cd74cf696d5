"""Change feeds and activity logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators.watching import ranges
from trellis.sources.tables import staged


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change of each key: one aggregate with map-side combination, no window."""
    last = F.max_by(F.struct(*changes.columns), seq).alias("c")
    return changes.groupBy(F.col(key).alias("_key")).agg(last).select("c.*")


def applied(state: DataFrame, changes: DataFrame, key: str, seq: str, removed: Column) -> DataFrame:
    """state after the feed: the last change of a key replaces its row, or takes it away where removed holds. Applying it twice changes nothing."""
    last = latest(changes.withColumn("_gone", removed), key, seq)
    return state.join(last.select(key), key, "left_anti").select(*state.columns).union(last.where(~F.col("_gone")).select(*state.columns))


def folded(log: DataFrame, same: list[str], order: str, ts: str, within: list[str] | None = None, block_rows: int = 250_000) -> DataFrame:
    """Runs of rows equal in `same`, in `order`: same, first (the run's first order), ts (the latest), count.

    Without `within` the log is one sequence. It is cut into ranges of `order`, as many as its rows ask for, and runs are
    folded range by range. Only a range's first and last run can go on in a neighbour, so that these alone, two a range, meet
    in one task; all others stay where they are.
    """
    where = within or []
    rows = log.select(*where, *[c for c in same if c not in where], F.col(order).alias("first"), F.col(ts).alias("ts"), F.lit(1).cast("long").alias("count"))
    out = [*where, *[c for c in same if c not in where], "first", "ts", "count"]
    if where:
        return _runs(rows, same, where).select(*out)
    blocks = ranges(rows, "first", block_rows=block_rows)
    runs = staged(_runs(blocks, same, ["_block"]), "runs")
    ends = runs.groupBy("_block").agg(F.min("first").alias("_head"), F.max("first").alias("_tail"))
    runs = runs.join(ends, "_block").withColumn("_edge", F.col("first").isin(F.col("_head"), F.col("_tail"))).drop("_head", "_tail")
    inner = runs.where(~F.col("_edge")).select(*out)
    # two runs of one block are two runs, whatever lay between them
    return _runs(runs.where("_edge").drop("_edge"), same, [], "_block").select(*out).union(inner)


def _runs(rows: DataFrame, same: list[str], within: list[str], apart: str | None = None) -> DataFrame:
    along = Window.partitionBy(*within).orderBy("first") if within else Window.orderBy("first")
    equal = F.lit(True) if apart is None else F.col(apart) != F.lag(apart).over(along)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.lag(c).over(along))
    rows = rows.withColumn("_new", F.when(equal & F.lag("first").over(along).isNotNull(), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*within, "_run", *[c for c in same if c not in within]]
    return rows.groupBy(*keys).agg(F.min("first").alias("first"), F.max("ts").alias("ts"), F.sum("count").alias("count")).drop("_run")


def recent(log: DataFrame, n: int, order: str = "id", default: int = 20) -> DataFrame:
    """The newest n rows; the default for n of 0 or less. Each task keeps its n, and one merges them."""
    return log.orderBy(F.col(order).desc()).limit(n if n > 0 else default)


def ring(log: DataFrame, cap: int = 500, order: str = "id") -> DataFrame:
    return recent(log, cap, order)


def direction(kind: Column, source: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "" else kind == "error" if wanted == "error" else source == wanted


def matching(texts: list[Column], query: str) -> Column:
    """Whether any of the texts has query in it, letters in either case; marks of patterns are ordinary characters."""
    out = F.lit(query == "")
    for t in texts:
        out = out | F.contains(F.lower(t), F.lit(query.lower()))
    return out


def failures(log: DataFrame, ok: Column, order: str, within: str, least: int = 3) -> DataFrame:
    """within, n: for each sequence how many runs of failures are at least so long."""
    runs = folded(log.withColumn("ok", ok), ["ok"], order, order, [within])
    return runs.where(~F.col("ok") & (F.col("count") >= least)).groupBy(within).agg(F.count("*").alias("n"))
