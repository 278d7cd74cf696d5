"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Each word has two units: itself, or a slot of its hash where it is too seldom, and its shape (letters, digits, marks, length,
whether it repeats the word before). Words that occur often enough have vectors of their own, however many they are; what is
enough grows with the square root of the corpus. Units have fixed sparse index vectors; a unit's context vector is the sum of
its neighbours' index vectors over all documents. A document is the mean of its words' vectors, the mean of the squares of their shapes' vectors, and how many of
its words are distinct. The network is trained on a bounded sample of labelled documents, and its temperature is fitted on
labelled documents that it was not trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import Texts, U, Words, column, documents, pick, released, splitmix, text_slices
from trellis.llm.vocabulary import LEAST, frequent, word_counts

#: Slots of seldom words, dimensions of a vector, entries of an index vector that aren't zero, most labelled documents that
#: are used, hidden units, steps of training, tasks whose tables are added up together, documents that are pooled at once.
SLOTS, DIMS, ENTRIES, MAX_LABELLED, HIDDEN, STEPS, TABLE_TASKS, POOLED = 4096, 32, 2, 20_000, 32, 400, 256, 256
#: The least count of a word with a vector of its own, as a part of the square root of all words; rows for a bucket of counts.
ROOT_SHARE, BUCKET_ROWS = 0.05, 16_000

_CLASS = np.zeros(256, np.int64)  # 0 mark, 1 upper, 2 lower, 3 digit, 4 symbol, 5 beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[np.frombuffer(b"#*$%&|<>@=_+/\\{}[]~^", np.uint8)] = 4
SHAPES = 3 * 2 * 2 * 3 * 6 * 4 * 2
FEATURES = 3 * DIMS + 2


def units(words: Words, h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit and the shape of each word: words of the table (ascending hashes) first, then the slots, then shapes."""
    kinds = _CLASS[words.data]
    long = np.minimum(np.searchsorted([3, 7, 12], words.ends - words.starts, "left"), 3)

    def many(kind: int) -> np.ndarray:
        sums = np.r_[0, np.cumsum(kinds == kind)]
        return sums[words.ends] - sums[words.starts]

    shape = np.minimum(many(1), 2)
    for n, size in ((np.minimum(many(2), 1), 2), (np.minimum(many(3), 1), 2), (np.minimum(many(4), 2), 3), (kinds[words.ends - 1], 6), (long, 4)):
        shape = shape * size + n
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[words.first[:-1][words.counts() > 0]] = 0
    own = len(table) + (h % U(SLOTS)).astype(np.int64)
    if len(table):
        near = np.minimum(np.searchsorted(table, h), len(table) - 1)
        own = np.where(table[near] == h, near, own)
    return own, len(table) + SLOTS + shape * 2 + again


def index_vectors(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each unit's index vector; a word's follow from its hash, whatever the table holds."""
    seeds = np.r_[table, splitmix(np.arange(SLOTS + SHAPES, dtype=U) + U(0x1DE7))]
    r = splitmix(seeds[:, None] ^ (np.arange(ENTRIES, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
    return (r % U(DIMS)).astype(np.int64), 1 - 2 * ((r >> U(40)) & U(1)).astype(np.int32)


def word_vectors(docs: DataFrame, table: np.ndarray) -> np.ndarray:
    """Index and context vectors of the units, each of length 1, added up; contexts come from all documents.

    DIMS numbers a unit come to the driver.
    """
    n_units = len(table) + SLOTS + SHAPES
    sent = docs.sparkSession.sparkContext.broadcast((table, *index_vectors(table)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, place, sign = sent.value
        total = np.zeros(n_units * DIMS, np.int32)
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                words = texts.words()
                if len(words.starts) < 2:
                    continue
                both = units(words, words.hashes(), table)
                owner = words.owner()
                near = np.flatnonzero(owner[1:] == owner[:-1])
                for a in both:
                    for b in both:
                        for left, right in ((a[near], b[near + 1]), (a[near + 1], b[near])):
                            for j in range(ENTRIES):
                                np.add.at(total, left * DIMS + place[right, j], sign[right, j])
        task = TaskContext.get().partitionId() // TABLE_TASKS
        parts = np.array_split(total, 8)
        yield pa.record_batch({"tasks": pa.array([task] * 8, pa.int64()), "part": pa.array(range(8), pa.int32()), "wide": pa.array([False] * 8), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})
        released()

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64 if wide else np.int32).astype(np.int64) for wide, p in zip(rows["wide"].to_pylist(), rows["sums"].to_pylist(), strict=True))
        return pa.table({"tasks": pa.array([0], pa.int64()), "part": pa.array([key[-1].as_py()], pa.int32()), "wide": [True], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "tasks long, part int, wide boolean, sums binary"
    once = pick(docs, "text").mapInArrow(count, schema).groupBy("tasks", "part").applyInArrow(add, schema)
    parts = {r["part"]: np.frombuffer(bytes(r["sums"]), np.int64) for r in once.groupBy("part").applyInArrow(add, schema).toLocalIterator()}
    contexts = np.concatenate([parts[i] for i in range(8)]).reshape(n_units, DIMS).astype(np.float32) if parts else np.zeros((n_units, DIMS), np.float32)
    contexts /= np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors(table)
    for j in range(ENTRIES):
        np.add.at(contexts, (np.arange(n_units), place[:, j]), sign[:, j] / np.float32(np.sqrt(ENTRIES)))
    return contexts


def pooled(texts: Texts, vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The features of each text; zeros for one without words."""
    words = texts.words()
    h, n = words.hashes(), words.counts()
    own, shape = units(words, h, table)
    start = len(table) + SLOTS
    out = np.zeros((len(texts), FEATURES), np.float32)
    squares = vectors[start:] ** 2
    for a in range(0, len(texts), POOLED):
        b = min(a + POOLED, len(texts))
        part = slice(words.first[a], words.first[b])
        owner = np.repeat(np.arange(b - a), n[a:b])
        each = np.maximum(n[a:b, None], 1)
        of_words = np.zeros((b - a, DIMS), np.float32)
        if full := np.flatnonzero(n[a:b]).tolist():
            of_words[full] = np.add.reduceat(vectors[own[part]], words.first[a:b][full] - words.first[a], axis=0)
        of_shapes = np.bincount(owner * SHAPES + shape[part] - start, minlength=(b - a) * SHAPES).reshape(b - a, SHAPES).astype(np.float32)
        key = np.unique(splitmix(h[part]) >> U(16) | owner.astype(U) << U(48))
        distinct = np.bincount((key >> U(48)).astype(np.int64), minlength=b - a)
        out[a:b] = np.hstack([of_words / each, of_shapes @ vectors[start:] / each, of_shapes @ squares / each, distinct[:, None] / each, np.log1p(n[a:b, None])])
    return out


@dataclass
class Network:
    """Standardized inputs, one hidden layer, one logit that is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def trained(x: np.ndarray, y: np.ndarray, fold: np.ndarray, steps: int = STEPS, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """A network trained, by Adam, where fold is not 0; the temperature is the best of a range where it is."""
    learn = fold != 0
    if not learn.any() or len(set(y[learn])) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))])])
    r = np.random.default_rng(5)
    a, t = x[learn].astype(float), y[learn].astype(float)
    net = Network(a.mean(0), a.std(0) + 1e-3, [r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)])
    a = (a - net.mean) / net.scale
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    for step in range(1, steps + 1):
        rows = r.integers(0, len(a), 1024)
        w1, b1, w2, b2 = net.weights
        hidden = np.tanh(a[rows] @ w1 + b1)
        slip = (1 / (1 + np.exp(-(hidden @ w2 + b2)[:, 0])) - t[rows])[:, None] / len(rows)
        back = slip @ w2.T * (1 - hidden**2)
        slopes = [a[rows].T @ back + decay * w1, back.sum(0), hidden.T @ slip + decay * w2, slip.sum(0)]
        for w, g, (m, v) in zip(net.weights, slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if not learn.all():
        z, t = net.logits(x[~learn].astype(float)), y[~learn]
        loss = lambda k: np.logaddexp(0, np.where(t == 1, -z, z) / k).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return net


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), from labels (doc_id, quality 0 or 1).

    Labels of rows with crc32(doc_id as text) mod 3 = 1 are never read; of the others at most max_labelled are used,
    those with the smallest hashes of doc_id. Labels that are null are left out, and of several for one doc_id the mean
    counts, rounded up. Null and empty texts are scored as texts without words. Without labels of both kinds every score
    is the share of label 1. Repeated rows are scored each; a null doc_id is not held out; an empty table gives no rows.
    Other columns are not read.
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    counts = word_counts(rows, max(16, -(-rows.count() // BUCKET_ROWS)), lower=False)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = np.sort(frequent(counts, max(LEAST, math.ceil(ROOT_SHARE * math.sqrt(total))))[0])
    vectors = rows.sparkSession.sparkContext.broadcast((word_vectors(rows, table), table))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                x = pooled(texts, *vectors.value)
                yield pa.record_batch([column(batch, "doc_id").slice(at, len(x)), column(batch, "y").slice(at, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "y", "x"])

    # at most max_labelled ids, so that they can be broadcast; one text for each
    labelled = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = labelled.mapInArrow(features, "doc_id long, y int, x binary").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5))).orderBy("doc_id").toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in sample["x"]]).reshape(len(sample), FEATURES)
    network = trained(x, sample["y"].to_numpy(), sample["fold"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                p = network.probabilities(pooled(texts, *vectors.value))
                yield pa.record_batch([column(batch, "doc_id").slice(at, len(p)), column(batch, "held_out").slice(at, len(p)), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        released()

    return rows.withColumn("held_out", held(F.col("doc_id"))).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
