"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

The documents of a source wait in a shuffled queue, again and again up to max_epochs times. A copy is served in packets of at
most PACKET words, so that long documents don't hold up others. A packet's virtual finish time is the number of its source's
words up to its end, divided by the source's target. All packets of all sources are range-sorted by their finish times,
running totals are added up over the ranges, and the order is truncated where the total budget is spent; the packet there is
served in part. Nothing else decides what a source gets: it ends within about a packet of its target. Where documents are
served whole, a copy stays if at least half of it lies before the cut. Targets above max_epochs times a source's size are cut
there, and the excess is shared again by weight.

Running sums over a source are split into buckets by a hash of the document, whose number follows the row count, so that
no task holds a source: sums per bucket are added up first, and each bucket's rows after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import NOT_SPACE, documents, pick, staged

WEIGHTS, MAX_EPOCHS = (5.0, 2.0, 1.0), 3
#: Rows that a bucket of the shuffle holds on average.
BUCKET_ROWS = 2_000
#: Words of a packet at most. Shorter ones make more rows to sort, longer ones leave sources farther from their targets.
PACKET = 100
#: Packets of a range of the global order, and ranges at most; one sum for each comes to the driver. A range that is larger
#: is cut into ranges again.
RANGE_ROWS, MAX_RANGES = 20_000, 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; 0 for a null text) and a hash of the text that settles the order of repeated ids."""
    rows = pick(docs, "doc_id", "text", "source")
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """source, source_size, target of each row (source, source_size); the budget is the sum of all sizes unless given.

    A level is sought at which each source gets the smaller of level * weight and its limit. With sources by rising
    limit / weight, the first that the level left by those before it doesn't fill up sets the level. One row a source
    passes through these windows.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    rows = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_limit", max_epochs * F.col("source_size").cast("double"))
    rows = rows.withColumn("_budget", F.sum("source_size").over(everything).cast("double") if budget is None else F.lit(float(budget)))
    filled = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_level", (F.col("_budget") - before) / F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.col("_level"))).over(everything))
    return rows.select("source", "source_size", F.when(F.col("_level") * F.col("_w") < F.col("_limit"), F.col("_level") * F.col("_w")).otherwise(F.col("_limit")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: float | None = None, seed: int = 1, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (struct<epoch, finish, words> of the copies served) of each document.

    taken counts the words served, those of repeats too. Of each source at most one copy is served in part, with whole none. The
    order within a source is that of hashes of doc_id with the seed, then of doc_id, size and a hash of the text, so that
    reruns agree; rows equal in all of these are interchangeable. Packets of several sources that finish at the same time are
    served in the order of their sources. A null source is one of its own, after all others. A document counts by its words
    alone, whatever its length. Documents without words are served nothing; an empty table gives no rows. Other columns are
    not read.
    """
    rows = staged(sizes(docs), "sizes")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs, budget)
    through = Window.partitionBy("source").orderBy("_bucket")
    starts = sums.select("source", "_bucket", (F.sum("_sum").over(through) - F.col("_sum")).alias("_before")).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    inside = Window.partitionBy("source", "_bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", "_text")
    rows = rows.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"), F.row_number().over(inside).alias("_row"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    rows = staged(rows.select("doc_id", "source", "size", "source_size", "target", "_text", "_bucket", "_row", (F.col("_before") + F.col("_end")).alias("_end")), "queue")
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    packets = F.flatten(F.transform(epochs, lambda e: F.transform(_numbers(), lambda p: F.struct(_place(e, p).alias("key"), _words(p).alias("words")))))
    queue = rows.where("size > 0").select(F.explode(packets).alias("p")).select("p.key.*", "p.words")
    spent = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) if budget is None else int(budget)
    at, left = truncation(queue, spent)

    def served(epoch: Column) -> Column:
        if at is None:
            return F.col("size")
        upto = lambda total, p: total + F.when(_place(epoch, p) < at, _words(p)).when(_place(epoch, p) == at, F.lit(left)).otherwise(0)
        part = F.aggregate(_numbers(), F.lit(0).cast("long"), lambda total, p: upto(total, p).cast("long"))
        words = F.when(_place(epoch, _packets() - 1) < at, F.col("size")).when(_place(epoch, F.lit(0)) > at, 0).otherwise(part)
        return F.when(2 * words >= F.col("size"), F.col("size")).otherwise(0) if whole else words

    finish = lambda e: _place(e, _packets() - 1)["finish"]
    copies = F.transform(epochs, lambda e: F.struct(e.cast("int").alias("epoch"), finish(e).alias("finish"), served(e).cast("long").alias("words")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.filter(copies, lambda c: c["words"] > 0)).otherwise(F.filter(copies, lambda c: F.lit(False))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "_text")


#: The global order of packets.
ORDER = ["finish", "source", "epoch", "bucket", "row", "packet"]


def _packets() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("size") / PACKET)).cast("int")


def _numbers() -> Column:
    return F.sequence(F.lit(0), _packets() - 1)


def _words(packet: Column) -> Column:
    return (F.least(F.col("size"), (packet + 1) * F.lit(PACKET).cast("long")) - packet * F.lit(PACKET).cast("long")).cast("long")


def _place(epoch: Column, packet: Column) -> Column:
    """The place in the global order of a packet of a document's copy."""
    end = F.col("_end") - F.col("size") + F.least(F.col("size"), (packet + 1) * F.lit(PACKET).cast("long")) + epoch * F.col("source_size")
    key = [F.try_divide(end.cast("double"), F.col("target")), F.col("source"), epoch.cast("int"), F.col("_bucket"), F.col("_row"), packet.cast("int")]
    return F.struct(*[c.alias(n) for c, n in zip(key, ORDER, strict=True)])


def truncation(queue: DataFrame, budget: int) -> tuple[Column | None, int]:
    """(place, words left for it) of the packet at which the budget is spent, None where all together don't spend it.

    queue has ORDER and words. Its ranges are in that order; the one in which the running total passes the budget is cut
    into ranges again until it is small enough to be added up row by row.
    """
    before, found, n = 0, queue, queue.count()
    while True:
        ranges = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
        found = staged(found.drop("_range").repartitionByRange(ranges, *ORDER).withColumn("_range", F.spark_partition_id()), "ranges")
        cut = None
        for r in found.groupBy("_range").agg(F.sum("words").alias("words"), F.count("*").alias("n")).orderBy("_range").collect():
            if before + r["words"] > budget:
                cut = r
                break
            before += r["words"]
        if cut is None:
            return None, 0
        found, n, whole = found.where(F.col("_range") == cut["_range"]), cut["n"], n
        if n <= 4 * RANGE_ROWS or n == whole:
            break
    so_far = Window.partitionBy("_range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    at = found.withColumn("_to", F.sum("words").over(so_far)).where(F.col("_to") + F.lit(before) > budget).orderBy(*ORDER).limit(1).first()
    kinds = dict(found.dtypes)
    return F.struct(*[F.lit(at[n]).cast(kinds[n]).alias(n) for n in ORDER]), budget - before - at["_to"] + at["words"]


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
