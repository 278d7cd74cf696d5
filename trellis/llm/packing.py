"""Packing documents into sequences by non-negative least squares over patterns of lengths.

Documents are tokenized and cut into pieces of at most seq_len tokens; only the first piece of a document can be shorter.
The histogram of lengths, one number a length, comes to the driver. Patterns are the multisets of up to three lengths that
fill a sequence, or nearly. How often each is used is fitted to the histogram by non-negative least squares, rounded with
the fractions carried on among patterns of one longest piece, and held to what is there; what remains is packed best fit,
longest first, a group of equal sequences at a time. The plan has patterns with counts, so that its size follows the number
of lengths and not that of documents. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import column, documents, pick, released, staged, text_slices

SEQ_LEN, END_ID = 1024, 2
#: The fit leaves this share of the pieces under this part of a sequence to the residual, which needs them as filling.
HELD_SHARE, HELD_UNDER = 0.5, 0.25
#: Units of text whose ids a worker keeps, twice, and rows that a bucket of the ranking holds on average.
KEPT_UNITS, BUCKET_ROWS = 250_000, 4_000


class Units:
    """Ids of texts by a vocabulary of ranks, unit by unit.

    A unit is what lies between single spaces that have no white space beside them, with the space before it. The
    pattern that splits text ahead of the merges never crosses such a space, so that the ids of a text are those of its
    units one after another, and the ids of units seen before are taken from a table.
    """

    def __init__(self, ranks_path: str, pattern: str, end_id: int, added: tuple[tuple[str, int], ...] = ()) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.border = re.compile(r"(?<=\S) (?=\S)")
        self.spaces = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
        self.end = np.uint32(end_id).tobytes()
        self.added = {content: np.uint32(i).tobytes() for content, i in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {m: self.raw(m, "") for m in ".,"}

    def raw(self, unit: str, space: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(space + unit)).tobytes()

    def later(self, unit: str) -> bytes:
        """Ids of a unit with the space before it. Letters are one piece; a full stop or comma after them is another."""
        if unit.isalpha():
            if (raw := self.older.get(unit)) is None:
                raw = array("I", self.encoding._core_bpe.encode_single_piece(f" {unit}".encode())).tobytes()
        elif (raw := self.older.get(unit)) is None:
            if (mark := unit[-1:]) in self.marks and (word := unit[:-1]).isalpha():
                raw = (self.known.get(word) or self.later(word)) + self.marks[mark]
            else:
                raw = self.raw(unit, " ")
        if len(unit) <= 64:
            if len(self.known) >= KEPT_UNITS:
                self.known, self.older = {}, self.known
            self.known[unit] = raw
        return raw

    def ids(self, text: str) -> bytes:
        """Native unsigned 32-bit ids of text, then the end id. Added tokens stand for themselves, and end what is before them."""
        if self.added_pattern is not None and any(map(text.__contains__, self.added)):
            parts = self.added_pattern.split(text)
            return b"".join([self.added.get(part) or self.plain(part) for part in parts if part] + [self.end])
        return self.plain(text) + self.end

    def plain(self, text: str) -> bytes:
        """Native unsigned 32-bit ids of a text without added tokens."""
        if not text:
            return b""
        units = text.split(" ")
        if "" in units or " \n" in text or "\n " in text or any(map(text.__contains__, self.spaces)):
            units = self.border.split(text)
        out = list(map(self.known.get, units))
        out[0] = self.raw(units[0], "")
        if None in out:
            get, later = self.known.get, self.later
            for i, raw in enumerate(out):
                if raw is None:
                    out[i] = get(units[i]) or later(units[i])
        return b"".join(out)


_units: dict[tuple, Units] = {}


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are whole."""
    first = n - (n - 1) // seq_len * seq_len
    return [(0, first), *((s, seq_len) for s in range(first, n, seq_len))]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; a null text is an empty one."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern, end_id, added)
        if key not in _units:
            _units[key] = Units(*key)
        units = _units[key]
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(texts)):
                    raw = units.ids(texts.bytes(i).decode())
                    for p, (s, n) in enumerate(cut(len(raw) // 4, seq_len)):
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                numbers = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                ids = column(batch, "doc_id").slice(at, len(texts))
                yield pa.record_batch([ids.take(pa.array(row, pa.int64())), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        released()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# ---- the plan, on the driver: its size follows the number of lengths


def patterns(lengths: np.ndarray, seq_len: int, slack: int) -> np.ndarray:
    """Up to three lengths, the longest first and 0 for none, that leave at most slack of a sequence."""
    out = [(x, 0, 0) for x in lengths if seq_len - slack <= x]
    present = np.zeros(seq_len + 1, bool)
    present[lengths] = True
    for a in lengths:
        for b in lengths[(lengths <= a) & (lengths <= seq_len - a)]:
            left = seq_len - a - b
            if left <= slack:
                out.append((a, b, 0))
            low, high = max(1, left - slack), min(left, b)
            if low <= high:
                out += [(a, b, c) for c in np.flatnonzero(present[low : high + 1]) + low]
    return np.array(out, np.int64).reshape(-1, 3)


def fitted(shapes: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least sum of squares between the lengths that they use and the histogram.

    Accelerated projected gradient; the matrix, three entries a column, is never written out. Each length's error is
    weighed by its number of tokens.
    """
    n = len(histogram)
    weight = np.sqrt(np.arange(n) / n)
    used = [shapes[:, j] for j in range(3)]

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(u, x, n) for u in used)
        y[0] = 0
        return y

    def backward(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return sum(r[u] for u in used)

    v = np.ones(len(shapes))
    for _ in range(20):
        v = backward(weight**2 * forward(v))
        largest = np.linalg.norm(v)
        v /= max(largest, 1e-12)
    rate = 0.9 / max(largest, 1e-12)
    goal = histogram
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - rate * backward(weight**2 * (forward(y) - goal)), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Groups of equal sequences: the lengths in each, where its sequences begin and how many there are."""

    shapes: list[tuple[int, ...]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    def add(self, shape: tuple[int, ...], count: int) -> None:
        if count:
            self.shapes.append(shape)
            self.counts.append(count)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: first rank, first sequence and offset of each run of its places, by rank; a last rank ends them."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for shape, count in zip(self.shapes, self.counts, strict=True):
            offset = 0
            for x in shape:
                out.setdefault(x, []).append((taken.get(x, 0), base, offset))
                taken[x] = taken.get(x, 0) + count
                offset += x
            base += count
        return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in out.items()}


def packing_plan(histogram: np.ndarray, seq_len: int = SEQ_LEN, slack: int = 0) -> Plan:
    """A plan that places histogram[x] pieces of each length x, 1 to seq_len."""
    plan, left = Plan(), histogram.astype(np.int64).copy()
    plan.add((seq_len,), int(left[seq_len]))
    left[seq_len] = 0
    shapes = patterns(np.flatnonzero(left), seq_len, slack)
    if len(shapes):
        held = np.where(np.arange(seq_len + 1) < HELD_UNDER * seq_len, HELD_SHARE * left, 0)
        x = fitted(shapes, left - held)
        order = np.lexsort((-x, -shapes[:, 0]))
        carry, longest = 0.0, 0
        for i in order:
            if shapes[i, 0] != longest:
                carry, longest = 0.0, shapes[i, 0]
            carry += x[i]
            n = int(carry + 0.5)
            if n:
                parts = [int(p) for p in shapes[i] if p]
                n = max(0, min(n, min(int(left[p] - held[p]) // parts.count(p) for p in parts)))
                carry -= n
                for p in parts:
                    left[p] -= n
                plan.add(tuple(parts), n)
    for shape, count in best_fit(left, seq_len):
        plan.add(shape, count)
    return plan


def best_fit(left: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: groups of equal sequences are filled together, those with the least room first."""
    room: dict[int, dict[tuple[int, ...], int]] = {seq_len: {}}
    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        for free in sorted(r for r in room if x <= r < seq_len):
            # sequences with room for several of this length take them one at a time, in further rounds below
            while n and room[free]:
                shape, count = room[free].popitem()
                most = min(free // x, -(-n // count))
                whole = min(count, n // most) if most else 0
                if whole:
                    _put(room, free - most * x, shape + (x,) * most, whole)
                    n -= whole * most
                if count - whole:
                    _put(room, free, shape, count - whole)
                    if not whole:
                        break
        if n:
            each = seq_len // x
            _put(room, seq_len - each * x, (x,) * each, n // each)
            if n % each:
                _put(room, seq_len - n % each * x, (x,) * (n % each), 1)
    return [(shape, count) for groups in room.values() for shape, count in groups.items() if shape]


def _put(room: dict[int, dict[tuple[int, ...], int]], free: int, shape: tuple[int, ...], count: int) -> None:
    if count:
        groups = room.setdefault(free, {})
        groups[shape] = groups.get(shape, 0) + count


def packed(cut_pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """The pieces with sequence_id and offset.

    Ranks of equal lengths are counted per bucket of a hash of the document and added up over buckets, so that no task
    holds a length.
    """
    spark = cut_pieces.sparkSession
    rows = staged(cut_pieces, "pieces")
    by_length = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(seq_len + 1, np.int64)
    histogram[list(by_length)] = list(by_length.values())
    places = packing_plan(histogram, seq_len).places()
    buckets = max(1, -(-int(histogram.sum()) // BUCKET_ROWS))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    through = Window.partitionBy("length").orderBy("_b")
    starts = rows.groupBy("length", "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(through) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_b"])
    sent = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = column(batch, "length").to_numpy()
            rank = column(batch, "_before").to_numpy() + column(batch, "_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(length) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                which = order[a:b]
                first, base, at = sent.value[int(length[which[0]])]
                run = np.searchsorted(first, rank[which], side="right") - 1
                sequence[which] = base[run] + rank[which] - first[run]
                offset[which] = at[run]
            yield pa.record_batch([*(column(batch, n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    ranked = rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_before").cast("long").alias("_before"), F.col("_rank").cast("long").alias("_rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def added_tokens(tokenizer_path: str) -> tuple[tuple[str, int], ...]:
    """Contents and ids of the tokens that a tokenizer's file adds to its vocabulary; such a string in a text is that token."""
    with open(tokenizer_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return tuple((t["content"], t["id"]) for t in found)


def packed_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    The tokenizer is a file of ranks, the pattern that splits text ahead of it, and its added tokens; by default those of
    the public byte_bpe_50k vocabulary. Null and empty texts are one piece, the end id. Texts are encoded whole, whatever
    their length. Repeated rows are packed each. A null doc_id stays null. An empty table gives no rows. Other columns are
    not read.
    """
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packed(pieces(docs, ranks_path, pattern, seq_len, end_id, added), seq_len)


def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
