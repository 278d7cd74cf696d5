"""From raw documents to packed training sequences, in five stages; each takes what the one before it kept.

Quality rules drop documents, the n-gram Jaccard join leaves one document of each group of near copies (five-word
shingles, similarity 0.8), secrets are masked in the texts, sources are mixed to near their target weights, with
copies, each of a whole document, and the result is tokenized and packed. All but the last stage return the columns of
documents, n_chars counted again where a text has changed. SQL can't express the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import documents, pick, staged
from trellis.llm.jaccard import BROADCAST_IDS, similar_components
from trellis.llm.mixing import mixed
from trellis.llm.packing import packed_documents
from trellis.llm.rules import text_key, verdicts
from trellis.llm.secret_scan import redacted

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, whole.

    A verdict follows from the text alone, so that rows go by the key of their text: null and empty texts go, equal texts go
    or stay together, and rows with a null doc_id are judged like others. An empty table stays empty.
    """
    gone = verdicts(docs).where("not kept").select(F.col("key").alias("_key")).distinct()
    gone = staged(gone, "rejected")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text_key(docs["text"]).alias("_key"))
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_key", "left_anti")
    return left.select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without those of a component whose doc_id isn't its smallest.

    Of rows that share a doc_id the one with the least text stays, then the one least in its other columns. Rows with a null
    doc_id take no part and stay, and rows without words, which are linked with nothing. An empty table stays empty.
    """
    found = staged(similar_components(docs, k=5, percent=80), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    n, rows, ids = gone.count(), *found.where("doc_id is not null").agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    left = docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, docs["doc_id"] == F.col("_id"), "left_anti")
    if rows == ids:
        return left
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    several = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    once = left.join(several, left["doc_id"] == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row")).select("_row.*").select(*docs.columns)
    return left.join(several, left["doc_id"] == F.col("_id"), "left_anti").unionByName(once)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked. Null and empty texts stay as they are, repeated rows are masked one by one, and null
    ids play no part. An empty table stays empty."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix serves, whole, in the order of its virtual finish times.

    Rows without words, null texts among them, are served nothing and go. A null source is one of its own. For rows equal in
    doc_id, text and source, the one least in its other columns stands in all of their copies. An empty table stays empty.
    """
    key = ["_id", "_hash", "_source"]
    met = lambda other: [F.col(c).eqNullSafe(other[f"{c}2"]) for c in key]
    served = mixed(pick(docs, "doc_id", "text", "source"), whole=True).where(F.size("copies") > 0)
    served = staged(served.select(F.col("doc_id").alias("_id2"), F.col("_text").alias("_hash2"), F.col("source").alias("_source2"), "copies"), "served")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_hash"), docs["source"].alias("_source"))
    several = staged(served.groupBy("_id2", "_hash2", "_source2").count().where("count > 1").drop("count"), "several")
    if not several.isEmpty():
        one = rows.join(several, met(several), "left_semi").groupBy(*key).agg(F.min("_row").alias("_row")).select("_row", *key)
        rows = rows.join(several, met(several), "left_anti").union(one)
    copies = rows.join(served, met(served)).select("_row", "_hash", F.explode("copies").alias("_copy"))
    return copies.orderBy("_copy.finish", "_hash", "_copy.epoch").select("_row.*").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences.

    Null and empty texts are one piece, the end id; repeated rows are packed each; a null doc_id stays null; an empty table
    gives no rows.
    """
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secrets),
    ("source_mix", source_mix),
    ("sequence_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are written in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
