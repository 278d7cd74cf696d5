"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. Each round counts scores in bins of a range per query,
finds the bin that holds the k-th highest score and narrows the range to it; scores are integers, so that the range
ends as one value. A last pass keeps the scores above that value and, of those equal to it, the smallest ids that are
still needed. A block counts only its highest scores, down to its own k-th, and gives at most k rows a query, so that the
rows between stages grow with queries and blocks, however often one vector is repeated. Blocks hold components in as few
bytes as they need, since each block of candidates meets each block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import pick, staged

#: Rows of a block of queries, of a block of candidates, queries scored at once, and bins of a round.
QUERY_ROWS, BLOCK_ROWS, SCORED, BINS = 4096, 8192, 256, 1 << 16
PACKED = "block long, dim int, ids binary, vals binary"


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v array<long>) of the rows that take part: floor(scale * x) of each component, computed as double."""
    rows = pick(df, id_col, vec_col).toDF("id", "x")
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & (F.size("x") > 0) & whole)
    return rows.select(F.col("id").cast("long").alias("id"), F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of rows by a hash of the id. Of rows with one id the one with the smallest vector stands for all."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vals = np.array(table["v"].to_pylist(), np.int64)
        order = np.lexsort((*vals.T[::-1], ids))
        ids, vals = ids[order], vals[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids[first].tobytes()], pa.binary()), "vals": pa.array([_narrow(vals[first]).tobytes()], pa.binary())})

    keyed = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"), "id", "v")
    return keyed.groupBy("block", "dim").applyInArrow(pack, PACKED)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products; through doubles where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest whole numbers that hold it."""
    low, high = x.min(initial=0), x.max(initial=0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(raw: bytes, ids: np.ndarray, dim: int) -> np.ndarray:
    kind = np.dtype(f"i{len(raw) // (len(ids) * dim)}")
    return np.frombuffer(raw, kind).reshape(-1, dim).astype(np.int64)


def exact_topk(df: DataFrame, id_col: str, vec_col: str, k: int, query_mod: int, scale: float) -> DataFrame:
    """The k highest inner products of each row whose id is divisible by query_mod with the rows of other ids.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Rows with a null id, and vectors that
    are null, empty, or hold null or non-finite components, take no part; vectors are compared with those of their
    own length. Rows with one id count as one, with the smallest vector. An empty table gives no rows. Scores are
    exact while they fit 64 bits.
    """
    spark = df.sparkSession
    rows = quantized(df, id_col, vec_col, scale)
    n, squared = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    bound = min(math.isqrt(int(squared or 0)) ** 2 + 2 * math.isqrt(int(squared or 0)) + 2, 2**62)
    blocks, groups_of = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n / query_mod / QUERY_ROWS))
    candidates = staged(packed(rows, blocks), "candidates")
    queries = staged(packed(rows.where(F.pmod("id", F.lit(query_mod)) == 0), groups_of), "queries")
    tasks = min(blocks * groups_of, 10_000)

    def each(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    left = candidates.select(F.col("block").alias("cb"), "dim", "ids", "vals", each("qb", groups_of)).repartition(tasks, "qb", "cb", "dim")
    right = queries.select(F.col("block").alias("qb"), "dim", F.col("ids").alias("qids"), F.col("vals").alias("qvals"))

    def paired(state: DataFrame | None) -> DataFrame:
        asked = right if state is None else state
        return left.join(asked.select("*", each("cb", blocks)).repartition(tasks, "qb", "cb", "dim"), ["qb", "cb", "dim"])

    state, low, span = None, -bound, 2 * bound + 1
    while span > 1:
        step = -(-span // BINS)
        found = _kth_bins(paired(state), k, low, step, span, state is None)
        state, span = staged(_narrowed(found, right if state is None else state, k, low, step), "range"), step
    kept = _kept(paired(state), k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth_bins(pairs: DataFrame, k: int, low: int, step: int, span: int, first: bool) -> DataFrame:
    """(query, bin, n): how many scores lie in each bin from the highest down to the one with the block's k-th, counted from the range's low end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = _matrix(r["qvals"], qids, r["dim"]), _matrix(r["vals"], ids, r["dim"])
                lows = np.full(len(qids), low, np.int64) if first else np.frombuffer(r["lows"], np.int64)
                out_q, out_bin, out_n = [], [], []
                for at in range(0, len(qids), SCORED):
                    part = slice(at, at + SCORED)
                    off = _scores(q[part], c) - lows[part, None]
                    off[(off < 0) | (off >= span) | (qids[part, None] == ids[None, :])] = -1
                    # what lies below a block's own k-th score can't be needed, and no bin above it misses anything
                    nth = max(0, len(ids) - k)
                    i, j = np.nonzero(off >= np.maximum(np.partition(off, nth, 1)[:, nth], 0)[:, None])
                    codes, n = np.unique(i * (BINS + 1) + off[i, j] // step, return_counts=True)
                    out_q.append(qids[part][codes // (BINS + 1)])
                    out_bin.append(codes % (BINS + 1))
                    out_n.append(n)
                yield pa.record_batch({"qb": np.full(sum(map(len, out_q)), r["qb"]), "query_id": np.concatenate(out_q), "bin": np.concatenate(out_bin).astype(np.int32), "n": np.concatenate(out_n).astype(np.int64)})

    return pairs.mapInArrow(count, "qb long, query_id long, bin int, n long").groupBy("qb", "query_id", "bin").agg(F.sum("n").alias("n"))


def _narrowed(found: DataFrame, asked: DataFrame, k: int, low: int, step: int) -> DataFrame:
    """The blocks of queries with lows, the low ends of the bins with the k-th scores, and need, how many are sought from there on down.

    A query with fewer than k scores keeps the lowest value as its end, so that all of them stay.
    """
    first = "lows" not in asked.columns
    out_schema = "qb long, dim int, qids binary, qvals binary, lows binary, need binary"
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def narrow(left: pa.Table, table: pa.Table) -> pa.Table:
        bins: dict[int, list[tuple[int, int]]] = {}
        for q, b, n in zip(table["query_id"].to_pylist(), table["bin"].to_pylist(), table["n"].to_pylist(), strict=True):
            bins.setdefault(q, []).append((b, n))
        out = []
        for r in left.to_pylist():
            ids = np.frombuffer(r["qids"], np.int64)
            lows = np.full(len(ids), low, np.int64) if first else np.frombuffer(r["lows"], np.int64).copy()
            need = np.full(len(ids), k, np.int64) if first else np.frombuffer(r["need"], np.int64).copy()
            for i, q in enumerate(ids.tolist()):
                seen = 0
                for b, n in sorted(bins.get(q, ()), reverse=True):
                    if seen + n >= need[i]:
                        lows[i] += b * step
                        need[i] -= seen
                        break
                    seen += n
            out.append((r["qb"], r["dim"], r["qids"], r["qvals"], lows.tobytes(), need.tobytes()))
        return pa.table({f.split()[0]: pa.array([o[i] for o in out], t) for i, (f, t) in enumerate(zip(out_schema.split(", "), kinds, strict=True))})

    return asked.groupBy("qb").cogroup(found.groupBy("qb")).applyInArrow(narrow, out_schema)


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) above the k-th score, and of those equal to it the smallest ids of each block."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = _matrix(r["qvals"], qids, r["dim"]), _matrix(r["vals"], ids, r["dim"])
                lows, need = np.frombuffer(r["lows"], np.int64), np.frombuffer(r["need"], np.int64)
                for at in range(0, len(qids), SCORED):
                    part = slice(at, at + SCORED)
                    scores = _scores(q[part], c)
                    other = qids[part, None] != ids[None, :]
                    ties = (scores == lows[part, None]) & other
                    ties &= np.cumsum(ties, 1) <= need[part, None]  # ids are in ascending order in a block
                    i, j = np.nonzero(((scores > lows[part, None]) & other) | ties)
                    yield pa.record_batch({"query_id": qids[part][i], "vec_id": ids[j], "score": scores[i, j]})

    return pairs.mapInArrow(keep, "query_id long, vec_id long, score long")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", k=20, query_mod=20, scale=64.0)


OP7_SQL = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
