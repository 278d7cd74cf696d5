"""N-gram Jaccard join by a grouped prefix join.

A document's set holds hashes of its word shingles. All sets are sorted by one order, seldom shingles first, and two similar
sets share one of the first few of them, their prefixes. The order takes a shingle's frequency from a table of counts with a
fixed number of slots, filled from all documents, and its hash; the table bears on the work only, never on the result.

1. Documents with one size and one prefix make a group; a group's shingles are listed once. Lists of one group end there.
2. Each group is held against the groups that begin most of its lists, and each group's members against one of them.
   The links found tie large groups of near copies together, without pairs among all of their members.
3. Long lists with several components are shuffled into parts, round by round, and a part's members held against its first.
4. Lists that still have several components are expanded to members, and pairs of different components, of fitting sizes
   and places, are verified. Pairs within a component can't change it.

Verification compares whole sets, made again from the texts. Only pairs whose sketches leave room for a link come that
far: a sketch has a bit or two for each shingle, each the parity of the shingles that fall on it, so that two of them differ
in no more bits than the sets do in shingles. No link is lost by that, and few texts are shuffled that aren't linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import Texts, U, column, discarded, documents, pick, released, splitmix, staged, text_slices, windows
from trellis.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Most bits of the slot number in the table of counts, slots that are summed up by one task, entries of a bucket of
#: lists, pairs of a task that verifies, and ids that are broadcast at most (8 MB).
MAX_BITS, PART_SLOTS, BUCKET_ENTRIES, TASK_PAIRS, BROADCAST_IDS = 22, 1 << 16, 400_000, 128, 500_000
#: Tasks whose tables of counts are added up together, before these sums are.
TABLE_TASKS = 256
#: Lists of more entries are first linked in parts of about that many, in so many rounds at most.
LONG_LIST, ROUNDS = 32, 4
ENTRY = np.dtype([("token", np.uint64), ("g", np.int64), ("n", np.int32), ("at", np.int32)])


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of lower-cased texts, and where each text's begin; fewer words make one shingle."""
    words = texts.words(lower=True)
    h, counts, first = words.hashes(), words.counts(), words.first
    whole = windows(h, k)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    edges = np.r_[0, np.cumsum(sizes)]
    out = np.empty(edges[-1], U)
    long = np.flatnonzero(counts >= k)
    if len(long):
        place = np.repeat(edges[long] - first[long], sizes[long])
        index = np.arange(sizes[long].sum()) - np.repeat(np.r_[0, np.cumsum(sizes[long])[:-1]], sizes[long]) + np.repeat(first[long], sizes[long])
        out[index + place] = whole[index]
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        if len(short):
            out[edges[short]] = windows(h, c, seed=c)[first[short]]
    return out, edges


def _in_order(h: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """Tokens: the class of a shingle's slot above 56 bits of its hash."""
    mixed = h >> U(8)
    if table is None:
        return mixed
    return table[(h >> U(64 - int(math.log2(len(table))))).astype(np.int64)].astype(U) << U(56) | mixed


def slot_classes(rows: DataFrame, k: int, bits: int) -> np.ndarray:
    """For each slot twice the binary logarithm of how many shingles fall into it: 2**bits bytes at the driver."""
    size = 1 << bits
    part = min(PART_SLOTS, size)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                slots = (shingles(texts, k)[0] >> U(64 - bits)).astype(np.int64)
                if len(slots) * 4 > size:
                    counts += np.bincount(slots, minlength=size).astype(np.uint32)
                else:
                    np.add.at(counts, slots, 1)
        wide = counts if counts.max(initial=0) > 255 else counts.astype(np.uint8)
        yield _table([(TaskContext.get().partitionId() // TABLE_TASKS, i // part, wide.itemsize, wide[i : i + part].tobytes()) for i in range(0, size, part)])
        released()

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.float64)
        for n, raw in zip(table["size"].to_pylist(), table["counts"].to_pylist(), strict=True):
            total += np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.float64}[n])
        if len(key) == 1:
            total = np.minimum(2 * np.log2(1 + total), 255).astype(np.uint8)
        return pa.Table.from_batches([_table([(0, key[-1].as_py(), total.itemsize, total.tobytes())])])

    out = np.zeros(size, np.uint8)
    once = rows.select("text").mapInArrow(gather, TABLE).groupBy("tasks", "part").applyInArrow(add, TABLE)
    for r in once.groupBy("part").applyInArrow(add, TABLE).toLocalIterator():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out


TABLE = "tasks long, part int, size int, counts binary"


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["tasks", "part", "size", "counts"])


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with a similar one."""
    return -(-percent * n // 100)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many of the distinct tokens fall on each bit: as many bits as the next power of two from their number, 64 at least."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((splitmix(tokens ^ U(0x51E7C4)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y) of rep of sets whose sizes and sketches leave room for a link; the longer sketch is folded to the other's bits."""
    for c in "xy":
        pairs = pairs.join(sets.select(F.col("rep").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")), c)
    fitting = pairs.where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")).withColumn("words", F.least(F.size("x_bits"), F.size("y_bits")))
    folded = lambda c: F.when(F.size(c) > F.col("words"), F.zip_with(F.slice(c, 1, F.col("words")), F.slice(c, F.col("words") + 1, F.col("words")), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(folded("x_bits"), folded("y_bits"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    # of n1 + n2 shingles in all, those of one set only are at least as many as the bits that differ
    return fitting.where((100 + percent) * apart.cast("long") <= (100 - percent) * (F.col("x_n") + F.col("y_n")).cast("long")).select("x", "y")


FOUND = "kind int, a long, th long, g long, n int, s1 long, s2 long, bits array<long>, at int, center long"


def prefix_lists(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Of kind 0, a row per document: a = doc_id, th = the hash of its text, its group g, size n, two hashes and the sketch of its set. Of kind 1, a row per place of a
    group in a list of two groups or more: a = the shingle, g, n, at = the place in the prefix, center = the list's group of the first place."""
    count = rows.count()
    bits = min(MAX_BITS, max(12, math.ceil(math.log2(max(1, count))) + 4))
    sent = rows.sparkSession.sparkContext.broadcast(slot_classes(rows, k, bits))
    buckets = max(64, -(-count * 80 // BUCKET_ENTRIES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            size, group, s1, s2 = (np.zeros(batch.num_rows, t) for t in (np.int32, np.int64, np.int64, np.int64))
            entries, listed, sketches = [], set(), [np.empty(0, np.int64)] * batch.num_rows
            for row, texts in text_slices(batch, "text"):
                h, edges = shingles(texts, k)
                tokens = _in_order(h, sent.value)
                for i in range(len(texts)):
                    t = np.unique(tokens[edges[i] : edges[i + 1]])
                    n = len(t)
                    if not n:
                        continue
                    head = t[: n - needed(n, percent) + 1]
                    g = splitmix(splitmix(head).sum(keepdims=True) + U(n)).view(np.int64)[0]
                    at = row + i
                    size[at], group[at] = n, g
                    sketches[at] = sketch(t)
                    s1[at], s2[at] = splitmix(t + U(1)).sum(keepdims=True).view(np.int64)[0], splitmix(t ^ U(0x5DEECE66D)).sum(keepdims=True).view(np.int64)[0]
                    if g not in listed:
                        listed.add(g)
                        e = np.empty(len(head), ENTRY)
                        e["token"], e["g"], e["n"], e["at"] = head, g, n, np.arange(len(head))
                        entries.append(e)
            docs = column(batch, "doc_id").cast(pa.int64())
            table = pa.table({"a": docs, "th": column(batch, "th"), "g": group, "n": size, "s1": s1, "s2": s2, "bits": _lists(sketches)}).to_batches()[0] if batch.num_rows else None
            if table is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_batch(table)
                key = int(splitmix(np.array([int(group[0]) & ((1 << 63) - 1)], U))[0] >> U(40)) * 64 + number
                yield pa.record_batch({"kind": pa.array([0], pa.int32()), "key": pa.array([key], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            if entries:
                e = np.concatenate(entries)
                home = (splitmix(e["token"].copy()) % U(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                e, home = e[order], home[order]
                cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True])
                yield pa.record_batch({"kind": pa.array([1] * (len(cuts) - 1), pa.int32()), "key": pa.array(home[cuts[:-1]]), "payload": pa.array([e[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})
        released()

    kinds = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("th", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("bits", pa.list_(pa.int64())), ("at", pa.int32()), ("center", pa.int64())])

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        payloads = table["payload"].to_pylist()
        if key[0].as_py() == 0:
            docs = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads])
            n = len(docs)
            zero32, zero64 = pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64))
            return pa.table([zero32, docs["a"], docs["th"], docs["g"], docs["n"], docs["s1"], docs["s2"], docs["bits"], zero32, zero64], schema=kinds)
        e = np.concatenate([np.frombuffer(p, ENTRY) for p in payloads])
        e = e[np.lexsort((e["g"], e["at"], e["token"]))]
        new = np.r_[True, e["token"][1:] != e["token"][:-1]]
        e = e[new | np.r_[True, e["g"][1:] != e["g"][:-1]]]
        starts = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1]])
        sizes = np.diff(np.r_[starts, len(e)])
        center = np.repeat(e["g"][starts], sizes)
        keep = np.repeat(sizes > 1, sizes)
        e, center = e[keep], center[keep]
        zero = np.zeros(len(e), np.int64)
        return pa.table([pa.array(zero.astype(np.int32) + 1, pa.int32()), pa.array(e["token"].view(np.int64).copy()), pa.array(zero), pa.array(e["g"].copy()), pa.array(e["n"].copy()), pa.array(zero), pa.array(zero), pa.nulls(len(e), pa.list_(pa.int64())), pa.array(e["at"].copy()), pa.array(center)], schema=kinds)

    return rows.mapInArrow(gather, "kind int, key long, payload binary").groupBy("kind", "key").applyInArrow(settle, FOUND)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32), pa.array(np.concatenate(parts), pa.int64()))


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) of texts, struct<doc_id, th> each, whose whole sets are similar enough, as doc_ids (u, v)."""
    ids = staged(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "ids")
    n, most = ids.count(), pairs.groupBy("y").count().agg(F.max("count")).first()[0]
    if not n:
        return pairs.select(F.col("x.doc_id").alias("u"), F.col("y.doc_id").alias("v"))
    salts = -(-most // TASK_PAIRS)
    asked = rows.select(F.struct("doc_id", "th").alias("node"), "text").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    dealt = pairs.withColumn("s", F.pmod(F.hash("x"), F.lit(salts)).cast("int"))
    left = dealt.join(asked.withColumnRenamed("node", "x"), "x").select(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y"), F.col("y.th").alias("y_th"), F.col("s").alias("salt"), "text")
    right = dealt.select("y", "s").distinct().join(asked.withColumnRenamed("node", "y"), "y").select(F.col("y.doc_id").alias("of"), F.col("y.th").alias("of_th"), F.col("s").alias("part"), F.col("text").alias("whole"))

    def sets(table: pa.Table, name: str) -> list[np.ndarray]:
        out = []
        for batch in table.select([name]).to_batches():
            for _, texts in text_slices(batch, name):
                h, edges = shingles(texts, k)
                out += [np.unique(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        u, v = [], []
        if len(a) and len(b):
            y = sets(b, "whole")[0]
            for x_id, y_id, x in zip(a["x"].to_pylist(), a["y"].to_pylist(), sets(a, "text"), strict=True):
                if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                    both = np.isin(x, y, assume_unique=True).sum()
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        u.append(x_id)
                        v.append(y_id)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return left.groupBy("y", "y_th", "salt").cogroup(right.groupBy("of", "of_th", "part")).applyInArrow(compare, "u long, v long")


def _open_lists(lists: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(t, token, rep, c, n, at, entries): the members of the lists (t = 0) and of the groups (t = 1) that hold several components."""
    tied = sets.select("rep", "g", "n").join(components(links), F.col("rep.doc_id") == F.col("node"), "left").select("rep", "g", "n", F.coalesce("component", "rep.doc_id").alias("c"))
    tied = staged(tied, "tied")
    placed = lists.select("token", "g", "at").join(tied, "g").select(F.lit(0).alias("t"), "token", "rep", "c", "n", "at")
    placed = placed.union(tied.select(F.lit(1).alias("t"), F.col("g").alias("token"), "rep", "c", "n", F.lit(0).alias("at")))
    several = placed.groupBy("t", "token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("entries")).where("lo < hi").select("t", "token", "entries")
    out = staged(placed.join(several, ["t", "token"]), "open")
    discarded(tied)
    return out


def _close(percent: int) -> Column:
    """Whether sizes and places leave room for enough overlap, if this is the first common shingle.

    Similar sets pass in the list of their first common shingle, before which they have nothing in common.
    """
    n1, n2, at1, at2 = (F.col(c) for c in ("n1", "n2", "at1", "at2"))
    most = F.least(n1 - at1, n2 - at2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (((100 + percent) * most >= percent * (n1 + n2)) | (F.col("t1") == 1))


def similar_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs: the smallest doc_id that it reaches over links of similar sets.

    Null and empty texts, and texts without words, have no shingles and are their own components, also where another row
    has the same doc_id. Other rows that share a doc_id are linked with each other, each with its own text. Rows with a
    null doc_id take no part and get a null component. doc_id is an integer; an empty table gives no rows. Other columns
    are not read.
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("th", F.xxhash64("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    found = staged(prefix_lists(known, k, percent), "lists")
    members = found.where("kind = 0").select(F.col("a").alias("doc_id"), "th", "g", "n", "s1", "s2", "bits")
    sets = staged(members.where("n > 0").groupBy("s1", "s2", "n", "g").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.any_value("bits").alias("bits")), "sets")
    lists = found.where("kind = 1").select(F.col("a").alias("token"), "g", "n", "at", "center")
    firsts = sets.groupBy("g").agg(F.min("rep").alias("first"))

    # one or two stars a group, and one within each group
    often = Window.partitionBy("g").orderBy(F.col("count").desc(), "center")
    stars = lists.where("g <> center").groupBy("g", "center").count().withColumn("r", F.row_number().over(often)).where("r <= 2").select("g", "center")
    across = stars.join(firsts, "g").withColumnRenamed("first", "x").join(firsts.select(F.col("g").alias("center"), F.col("first").alias("y")), "center").select("x", "y")
    within = sets.join(firsts, "g").where("rep <> first").select(F.col("rep").alias("x"), F.col("first").alias("y"))
    # the sets of one doc_id
    of_id = F.struct("s1", "s2", "n")
    several = members.where("n > 0").groupBy("doc_id").agg(F.min(of_id).alias("lo"), F.max(of_id).alias("hi")).where("lo <> hi").select("doc_id")
    own = members.drop("bits").join(several, "doc_id").join(sets, ["s1", "s2", "n", "g"]).select(F.col("doc_id").alias("u"), F.col("rep.doc_id").alias("v")).where("u <> v")
    links = staged(verified(staged(_likely(across.union(within).distinct(), sets, percent), "pairs"), known, k, percent).union(own), "links")

    # long lists: each member and the first of its shuffled part of the list, until no further link turns up
    placed = None
    for turn in range(ROUNDS):
        # the lists of the turn before have given all of their pairs
        if placed is not None:
            discarded(placed)
        placed = _open_lists(lists, sets, links)
        part = Window.partitionBy("t", "token", F.pmod(F.hash("rep", F.lit(turn)), F.ceil(F.col("entries") / LONG_LIST))).orderBy("at", "rep")
        near = placed.where(F.col("entries") > LONG_LIST)
        near = near.select(*[F.col(c).alias(f"{c}1") for c in ("t", "rep", "c", "n", "at")], *[F.first(c).over(part).alias(f"{c}2") for c in ("rep", "c", "n", "at")])
        near = near.where((F.col("c1") != F.col("c2")) & _close(percent)).select(F.greatest("rep1", "rep2").alias("x"), F.least("rep1", "rep2").alias("y"))
        pairs = staged(_likely(near.distinct(), sets, percent), "pairs")
        new = staged(verified(pairs, known, k, percent), "links")
        discarded(pairs)
        if new.isEmpty():
            break
        links = staged(links.union(new), "links")

    # pairs of what different components still have in common
    classes = placed.groupBy("t", "token", "c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("room"))
    one, two = (classes.withColumnsRenamed({c: f"{c}{i}" for c in ("c", "low", "high", "room")}) for i in (1, 2))
    fit = (100 * F.col("high1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low1"))
    fit &= ((100 + percent) * F.least("room1", "room2") >= percent * (F.col("low1") + F.col("low2"))) | (F.col("t") == 1)
    ways = one.join(two, ["t", "token"]).where((F.col("c1") < F.col("c2")) & fit).select("t", "token", "c1", "c2", "low2", "high2", "room2")
    x, y = (placed.drop("entries").withColumnsRenamed({c: f"{c}{i}" for c in ("rep", "c", "n", "at")}) for i in (1, 2))
    # a member that fits no size or place of the other component stays out before it meets that one's members
    able = (100 * F.col("n1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("n1"))
    able &= ((100 + percent) * F.least(F.col("n1") - F.col("at1"), F.col("room2")) >= percent * (F.col("n1") + F.col("low2"))) | (F.col("t") == 1)
    both = ways.join(x, ["t", "token", "c1"]).where(able).select("t", "token", "c2", "rep1", "c1", "n1", "at1").join(y, ["t", "token", "c2"]).withColumnRenamed("t", "t1").where(_close(percent))
    rest = staged(_likely(both.select(F.greatest("rep1", "rep2").alias("x"), F.least("rep1", "rep2").alias("y")).distinct(), sets, percent), "rest")
    more = verified(rest, known, k, percent)

    named = sets.join(components(links.union(more)), F.col("rep.doc_id") == F.col("node"), "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n").alias("size"), F.coalesce("component", "rep.doc_id").alias("component_id"))
    same = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") == F.col("size"))
    out = members.join(named, same, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long"), F.lit(None).cast("long")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


#: The contract of the query in plain steps: whole sets, all pairs with a common shingle and fitting sizes, links followed to their ends.
OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
sets as (
  select doc_id, case when len(ws) = 0 then cast([] as varchar[])
    else list_sort(list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, greatest(len(ws) - 2, 2))])) end as shingles
  from w),
groups as (select shingles, len(shingles) as n, min(doc_id) as rep from sets where len(shingles) > 0 group by shingles),
entries as (select rep, n, unnest(shingles) as shingle from groups),
shared as (
  select x.rep as a, y.rep as b, any_value(x.n) + any_value(y.n) as n_sum, count(*) as n_common
  from entries x join entries y on x.shingle = y.shingle and x.rep < y.rep and 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) group by x.rep, y.rep),
links as (select a, b from shared where 100 * n_common >= 85 * (n_sum - n_common)),
edges as (select a, b from links union all select b, a from links),
reach as (select rep as a, rep as b from groups union select r.a, e.b from reach r join edges e on e.a = r.b),
least_of as (select a, min(b) as component from reach group by a)
select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, coalesce(l.component, s.doc_id) as component_id
from sets s left join groups g on g.shingles = s.shingles left join least_of l on l.a = g.rep
"""
