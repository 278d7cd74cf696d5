"""Connected components by alternating stars, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import staged

#: Parts that the links of one node are dealt over when its least neighbour is handed back to them; from MANY links on,
#: one for each STAR_LINKS of the node's links instead.
SALTS, MANY, STAR_LINKS = 16, 1 << 22, 1 << 16
#: Nodes of many links that are broadcast at most.
LARGE_NODES = 500_000


def _star(links: DataFrame, larger: bool, n: int) -> DataFrame:
    """Ties the neighbours of each node u to the least of them: the larger ones (v > u), or the smaller ones and u itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.ceil(F.count("*") / STAR_LINKS).cast("int").alias("salts"))
    rows = near.where("v > u") if larger else near
    if n < MANY:
        least, rows = least.withColumn("salts", F.lit(SALTS)), rows.withColumn("salts", F.lit(SALTS))
    else:
        # a row for each node with more than STAR_LINKS links: at most two for each STAR_LINKS of all links
        large = least.where("salts > 1").select("u", "salts")
        rows = rows.join(F.broadcast(large) if n // STAR_LINKS <= LARGE_NODES else large, "u", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    rows = rows.withColumn("s", F.pmod(F.hash("v"), F.col("salts")).cast("int")).drop("salts")
    out = rows.join(dealt, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (u, v: long) the smallest node that it reaches. Self-links are ignored."""
    links = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before, n = None, links.count()
    while True:
        links = staged(_star(_star(links, True, n), False, n), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
