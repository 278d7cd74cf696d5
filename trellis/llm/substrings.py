"""Removal of repeated passages by suffix trees that are partitioned by prefixes of variable length.

The suffixes that matter begin at the windows of `window` words. Three passes over the texts find the earlier of equal ones:

1. Each window has an anchor, the smallest hash of its half-length word sequences, so that equal windows have equal anchors.
   Anchors that occur at two places or more set a bit in a map of bounded size; windows without that bit repeat nowhere.
   The same pass counts suffixes by hashes of their first 1, 2, 4 and 8 words.
2. The suffixes left are split by prefixes: a prefix that starts too many of them is made longer, up to a whole window,
   and prefixes are gathered to groups that fit into memory. A suffix goes as its path from the root: up to EDGES edges of
   a few words each, a hash an edge, down to the depth of a window. A group sorts its suffixes by their paths, so that
   neighbours have their common prefixes at hand; the depth at which neighbours part is that of an internal node of the
   subtree. Nodes as deep as a window hold what repeats; of their leaves the earliest stays and all others are repeats.
   Each task does the same first with what it reads, and sends one leaf of each of its deep nodes, so that a passage of
   very many documents is sent once a task.
3. Repeats go to their documents, in groups of documents, and the words that they cover are taken out; repeats that start
   one after another make a maximal one, whose span is returned.

Nodes below the depth of a window change nothing in what repeats, so that paths end there. A false bit costs work and
changes nothing. Two windows are the same when the hashes of all of their edges are, 32 bits each, 160 together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import U, Words, column, documents, pick, released, splitmix, text_slices, windows

WINDOW = 20
#: Edges of a path from the root to the depth of a window.
EDGES = 5
#: Lengths of prefixes that are counted, least and most bits of a slot of their tables, suffixes of a group, groups that
#: there are at least on large inputs, documents of a last group, and the most bits of the map of anchors.
LEVELS, SLOT_BITS, GROUP_SUFFIXES, LEAST_GROUPS, GROUP_ROWS, MAX_BITS = (1, 2, 4, 8), (14, 20), 1_000_000, 256, 1_000, 28
#: Suffixes that a task holds before it sends them off.
HELD_SUFFIXES = 1 << 20
#: A place in a slice of texts; one text has fewer words than that.
PLACE_BITS = U(28)
#: Tasks whose tables of prefixes are added up together, before the driver adds up the sums.
TABLE_TASKS = 256
NO_ID = np.int64(np.iinfo(np.int64).max)


def _valid(words: Words, window: int) -> np.ndarray:
    """Whether a window starts at each word and stays in its text; as long as there are windows in the slice."""
    n = len(words.starts) - window + 1
    if n <= 0:
        return np.empty(0, bool)
    ends = np.repeat(words.first[1:], words.counts())
    return np.arange(n) + window <= ends[:n]


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest of its half-length hashes above the bits of the place, the leftmost of equal ones."""
    half = window // 2
    grams = windows(h, half, seed=7)
    keys = (grams >> PLACE_BITS) << PLACE_BITS | np.arange(len(grams), dtype=U)
    span, width, best = window - half + 1, 1, keys
    while 2 * width <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    return best


def _anchor_bits(keys: np.ndarray) -> np.ndarray:
    return splitmix(keys >> PLACE_BITS)


def _slot(h: np.ndarray, level: int, slots: int) -> np.ndarray:
    return (windows(h, level, seed=level) % U(slots)).astype(np.int64)


def _packed(kind: int, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (kind, key, bytes) with the values of each key; keys are made ascending."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    return [(kind, int(keys[a]), values[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array([r[0] for r in rows], pa.int32()), "key": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _payloads(table: pa.Table, dtype: np.dtype | type) -> np.ndarray:
    parts = [np.frombuffer(p, dtype) for p in table["payload"].to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


ROW = "kind int, key long, payload binary"


def shared_anchors(rows: DataFrame, window: int, n_rows: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The map of anchors that occur twice, the counts of prefixes by level, and the number of its bits as a power of two.

    What comes to the driver is the map, at most 2**MAX_BITS bits, and the tables.
    """
    bits = min(MAX_BITS, max(18, math.ceil(math.log2(max(1, n_rows) * 400))))
    slots_of = 1 << min(max(SLOT_BITS[0], math.ceil(math.log2(max(1, n_rows)) - 6)), SLOT_BITS[1])
    buckets = min(1 << (bits - 10), 1 << max(8, math.ceil(math.log2(max(1, n_rows) / 4_000))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(slots_of, np.int64) for _ in LEVELS]
        for batch in batches:
            found = []
            for _, texts in text_slices(batch, "text"):
                words = texts.words()
                h, ok = words.hashes(), _valid(words, window)
                if not ok.any():
                    continue
                keys = _anchors(h, window)[ok]
                found.append(_anchor_bits(np.unique(keys)))
                for table, level in zip(counts, LEVELS, strict=True):
                    np.add.at(table, _slot(h, level, slots_of)[: len(ok)][ok], 1)
            if found:
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                marked = (anchors & ~U(1)) | (n > 1).astype(U)
                yield _batch(_packed(0, (anchors >> U(64 - int(math.log2(buckets)))).astype(np.int64), marked))
        first = TaskContext.get().partitionId() // TABLE_TASKS * len(LEVELS)
        yield _batch([(1, first + i, t.tobytes()) for i, t in enumerate(counts)])
        released()

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            total = sum(np.frombuffer(p, np.int64) for p in table["payload"].to_pylist())
            return pa.Table.from_batches([_batch([(1, key[1].as_py(), total.tobytes())])])
        marked = _payloads(table, U)
        anchors, n = np.unique(marked & ~U(1), return_counts=True)
        twice = np.union1d(anchors[n > 1], marked[(marked & U(1)) == U(1)] & ~U(1))
        size = 1 << (bits - int(math.log2(buckets)))
        slots = np.zeros(size, np.uint8)
        slots[(twice >> U(64 - bits)).astype(np.int64) & (size - 1)] = 1
        return pa.Table.from_batches([_batch([(0, key[1].as_py(), np.packbits(slots, bitorder="little").tobytes())])])

    share = (1 << bits) // 8 // buckets
    bit_map = np.zeros((1 << bits) // 8, np.uint8)
    tables = [np.zeros(slots_of, np.int64) for _ in LEVELS]
    for r in rows.select("text").mapInArrow(gather, ROW).groupBy("kind", "key").applyInArrow(settle, ROW).toLocalIterator():
        if r["kind"]:
            tables[r["key"] % len(LEVELS)] += np.frombuffer(bytes(r["payload"]), np.int64)
        else:
            bit_map[r["key"] * share : (r["key"] + 1) * share] = np.frombuffer(bytes(r["payload"]), np.uint8)
    return bit_map, tables, bits


def prefix_groups(tables: list[np.ndarray], most: int) -> tuple[list[np.ndarray], int]:
    """For each level the group of each slot, -1 where the prefix must be longer, and the number of groups.

    Slots are gathered in order until a group would grow beyond most. Whole windows, below the last level, get as many
    groups again as the suffixes that come to them need.
    """
    out, group, size, left = [], 0, 0, 1.0
    for table in tables:
        homes = np.full(len(table), -1, np.int64)
        for slot in np.flatnonzero((table <= most) & (table > 0)).tolist():
            n = int(table[slot] * left) + 1
            if size and size + n > most:
                group, size = group + 1, 0
            homes[slot], size = group, size + n
        out.append(homes)
        total = table.sum()
        left = left * float(table[table > most].sum() / total) if total else 0.0
    rest = int(left * float(tables[0].sum())) // most + 1
    return out, group + 1 + rest


SUFFIX = np.dtype([("path", np.uint32, (EDGES,)), ("doc", np.int64), ("at", np.int32)])
PLACE = np.dtype([("doc", np.int64), ("at", np.int64)])


def depths(window: int) -> list[int]:
    """The depths, in words, at which the edges of a path begin and end; EDGES of them, some empty where a window is short."""
    return [window * i // EDGES for i in range(EDGES + 1)]


def paths(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The paths of the suffixes that start at words at: a hash of the words of each edge."""
    out = np.zeros((len(at), EDGES), np.uint32)
    cuts = depths(window)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            out[:, i] = (windows(h, b - a, seed=11 + i)[at + a] >> U(32)).astype(np.uint32)
    return out


def subtree(r: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of suffixes along their tree, equal ones by place, and the depth of the node at which each parts from the one before it."""
    p = r["path"].astype(np.uint64)
    order = np.lexsort((r["at"], r["doc"], p[:, 4], p[:, 2] << U(32) | p[:, 3], p[:, 0] << U(32) | p[:, 1]))
    p = r["path"][order]
    common = np.zeros(len(r), np.int64)
    common[1:] = np.logical_and.accumulate(p[1:] == p[:-1], axis=1).sum(1)
    return order, np.array(depths(window))[common]


def leaves(r: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of subtree(); which of its suffixes are the first below their node as deep as a window (all others are
    alone below none, or below the same one); and which are repeats: below such a node, at another place than the first."""
    order, depth = subtree(r, window)
    first = depth < window
    early = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.empty(0, np.int64)
    doc, at = r["doc"][order], r["at"][order]
    return order, first, ~first & ((doc != doc[early]) | (at != at[early]))


def repeats(rows: DataFrame, window: int, homes: int) -> DataFrame:
    """(home, payload): places (doc, at) of the windows whose words also start earlier, for groups of documents by a hash of doc_id."""
    sc = rows.sparkSession.sparkContext
    bit_map, tables, bits = shared_anchors(rows, window, rows.count())
    groups, n_groups = prefix_groups(tables, min(GROUP_SUFFIXES, max(20_000, int(tables[0].sum()) // LEAST_GROUPS)))
    last = max(int(g.max()) for g in groups) + 1 if groups else 0
    sent = sc.broadcast((bit_map, groups))

    def group_of(h: np.ndarray, at: np.ndarray, path: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(at), -1, np.int64)
        for level, table in zip(LEVELS, levels, strict=True):
            open_ = out < 0
            out[open_] = table[_slot(h, level, len(table))[at[open_]]]
        whole = out < 0
        out[whole] = last + (splitmix((path[whole, 0].astype(U) << U(32) | path[whole, 1]) ^ path[whole, 3]) % U(max(1, n_groups - last))).astype(np.int64)
        return out

    def home_of(docs: np.ndarray) -> np.ndarray:
        return (splitmix(docs.view(U)) % U(homes)).astype(np.int64)

    def places(r: np.ndarray) -> list[tuple[int, int, bytes]]:
        out = np.empty(len(r), PLACE)
        out["doc"], out["at"] = r["doc"], r["at"]
        return _packed(1, home_of(out["doc"].copy()), out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, levels = sent.value
        parts, whose = [], []

        def sorted_off() -> Iterator[pa.RecordBatch]:
            r, group = np.concatenate(parts), np.concatenate(whose)
            order, first, again = leaves(r, window)
            yield _batch(_packed(0, group[order[first]], r[order[first]]))
            if again.any():
                yield _batch(places(r[order[again]]))

        for batch in batches:
            ids = column(batch, "doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
            for row, texts in text_slices(batch, "text"):
                words = texts.words()
                h, ok = words.hashes(), _valid(words, window)
                if not ok.any():
                    continue
                at = np.flatnonzero(ok)
                bit = (_anchor_bits(_anchors(h, window)[at]) >> U(64 - bits)).astype(np.int64)
                at = at[(marks[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    continue
                owner = words.owner()[at]
                r = np.empty(len(at), SUFFIX)
                r["path"], r["doc"], r["at"] = paths(h, at, window), ids[row + owner], at - words.first[owner]
                parts.append(r)
                whose.append(group_of(h, at, r["path"], levels))
                if sum(map(len, parts)) > HELD_SUFFIXES:
                    yield from sorted_off()
                    parts, whose = [], []
        if parts:
            yield from sorted_off()
        released()

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return table
        r = _payloads(table, SUFFIX)
        order, _, again = leaves(r, window)
        return pa.Table.from_batches([_batch(places(r[order[again]]))])

    found = rows.mapInArrow(gather, ROW).groupBy("kind", "key").applyInArrow(settle, ROW)
    return found.select(F.col("key").alias("home"), "payload")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by single spaces) and spans (of the words that go) of each row.

    A word goes if it is covered by a window of consecutive words that also starts earlier: in a row with a smaller
    doc_id, or in the same one at an earlier word. Windows are judged on the input. Null and empty texts have no words.
    doc_id is an integer; nulls come after all others. Rows that share a doc_id are the same place: the words that go
    are those of any of them, and equal rows don't remove each other. An empty table gives no rows. Other columns are
    not read.
    """
    rows = pick(docs, "doc_id", "text")
    homes = max(1, -(-rows.count() // GROUP_ROWS))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        places = np.unique(_payloads(right, PLACE))
        ids = left["doc_id"].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
        low, high = np.searchsorted(places["doc"], ids, "left"), np.searchsorted(places["doc"], ids, "right")
        n_words, n_removed, out, spans = [], [], [], []
        for text, a, b in zip(left["text"].to_pylist(), low.tolist(), high.tolist(), strict=True):
            words = (text or "").encode().split()
            n, gone = len(words), np.empty(0, np.int64)
            if b > a:
                at = places["at"][a:b]
                at = at[at < n]
                change = np.zeros(n + window + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                stay = np.cumsum(change)[:n] == 0
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
                gone = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
            n_words.append(n)
            n_removed.append(n - len(words))
            out.append(b" ".join(words).decode())
            spans.append([{"start": x, "end": y} for x, y in gone.reshape(-1, 2).tolist()])
        released()
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(out, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    homed = rows.withColumn("home", _home(number, homes))
    return homed.groupBy("home").cogroup(repeats(rows, window, homes).groupBy("home")).applyInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, text string, spans array<struct<start:long,end:long>>")


def _home(number, homes: int):
    """The same as splitmix(doc) % homes, which the numpy side computes."""

    @F.arrow_udf("long")
    def home(ids: pa.Array) -> pa.Array:
        return pa.array((splitmix(ids.to_numpy().view(U)) % U(homes)).astype(np.int64))

    return home(number)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The contract of the query in plain steps: each window's words, all but the first place of each, the words that those cover.
OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as pos from w where len(ws) >= 20),
windows as (select doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') as words from places),
ranked as (select doc_id, pos, row_number() over (partition by words order by doc_id, pos) as r from windows),
gone as (select distinct doc_id, pos + j as pos from ranked, range(0, 20) t(j) where r > 1),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
counted as (
  select s.doc_id, count(*) as n_words, count(g.pos) as n_removed, string_agg(word, ' ' order by s.pos) filter (where g.pos is null) as kept
  from words s left join gone g on g.doc_id = s.doc_id and g.pos = s.pos group by s.doc_id)
select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join counted c on c.doc_id = w.doc_id
"""
