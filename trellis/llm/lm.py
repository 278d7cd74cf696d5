"""Scoring by a class-based bigram model, after exchange clustering.

Words are counted first, by tasks and then by buckets of hashes. Those that occur often enough (least_count: a count that
grows with the square root of the corpus) are units of their own, however many they are; each seldom word starts in a unit
with others that end alike. Texts become numbers of units, written once. Classes are found by exchange in windows of
frequency: the most frequent words and the units of seldom words change places on the driver, one by one, over the table of
their bigrams; after that all frequent words take part in rounds in which every second one goes, part by part of the
vocabulary, to the class that raises the likelihood most, by how often each class stands before and after it anywhere in the
training documents. Then every seldom word, however seldom, leaves its unit for the class that raises the likelihood most
by its own neighbours. Classes of frequent words, a byte a word, and the table of class bigrams are all that comes to the
driver; counts and classes of seldom words stay in their buckets.

A token's probability is that of its class after the last one's, times that of the word in its class, both smoothed by added
counts; each class keeps room for one unseen word, which has the class of its unit. Blocks of documents send the buckets
their seldom tokens with the classes beside them; class and count of each come back. Words are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import U, column, documents, pick, released, staged, text_slices
from trellis.llm.vocabulary import SUFFIXES, bucket_of, cuts_by, frequent, least_count, suffix_slots, word_counts

#: Words of the first window, classes besides that of the end, rounds of the exchange on the driver, rounds for all words.
TOP, CLASSES, ROUNDS, WIDE_ROUNDS = 511, 32, 8, 4
SEEDS = 1 + TOP + SUFFIXES
#: Tokens of a block, documents of a bucket and task tables that are dealt with together, units of a part of the
#: vocabulary, seldom words whose neighbours are counted at once, and pairs of units and classes that a task holds before
#: it adds them up.
BLOCK_TOKENS, BUCKET_ROWS, TABLE_TASKS, PART_UNITS, SELDOM_WORDS, HELD_PAIRS = 1 << 20, 16_000, 256, 2048, 1 << 13, 1 << 21
#: In place of a class: of the word before a token that isn't learned from, and of a word that wasn't seen in training.
NO_CLASS = 255
ADDED_WORD, ADDED_CLASS = 0.5, 0.1

_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("sizes", "held", "low", "high", "sums", "known", "seldom"))])
BLOCKS = "block long, doc_ids array<long>, sizes binary, held binary, low binary, high binary, sums binary, known binary, seldom binary"


def ids_of(row: dict) -> np.ndarray:
    """The units of a row's tokens, which are kept as low and high halves."""
    return np.frombuffer(row["low"], np.uint16).astype(np.int64) | np.frombuffer(row["high"], np.uint16).astype(np.int64) << 16


def learning(row: dict) -> np.ndarray:
    """Which of a row's tokens belong to documents that are learned from."""
    return np.repeat(~np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int32))


def blocks(rows: DataFrame, words: np.ndarray, counts: np.ndarray, ends: int) -> DataFrame:
    """Documents by blocks: units of their tokens, sums of log10(count + added) and numbers of known tokens over the frequent
    words and the end, and hashes of their seldom tokens in their order."""
    order = np.argsort(words)
    logs = np.r_[np.log10(ends + ADDED_WORD), np.log10(counts + ADDED_WORD), np.zeros(SUFFIXES)]
    sent = rows.sparkSession.sparkContext.broadcast((words[order], (1 + order).astype(np.uint32), logs))
    v = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unit, logs = sent.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = column(batch, "held_out").to_numpy(zero_copy_only=False).astype(bool)
            first, tokens, parts = 0, 0, []
            for at, texts in text_slices(batch, "text"):
                if tokens > BLOCK_TOKENS:
                    yield _block(number, batch, held, first, at, parts)
                    number, first, tokens, parts = number + 1, at, 0, []
                found = texts.words(lower=True)
                h, n = found.hashes(), found.counts()
                units = np.zeros(len(h), np.uint32)
                known = np.zeros(len(h), bool)
                if v:
                    near = np.minimum(np.searchsorted(table, h), v - 1)
                    known = table[near] == h
                    units[known] = unit[near[known]]
                other = np.flatnonzero(~known)
                if len(other):
                    units[other] = 1 + v + suffix_slots(found.data, found.starts[other], found.ends[other]).astype(np.uint32)
                last = np.cumsum(n + 1) - 1
                ids = np.zeros(int(n.sum()) + len(n), np.uint32)
                inner = np.ones(len(ids), bool)
                inner[last] = False
                ids[inner] = units
                start = np.r_[0, last[:-1] + 1]
                sums, sure = np.add.reduceat(logs[ids], start), np.add.reduceat(((ids <= v) & ((ids > 0) | (ends > 0))).astype(np.int64), start)
                parts.append(((n + 1).astype(np.int32), ids.astype(np.uint16), (ids >> 16).astype(np.uint16), sums, sure, h[other]))
                tokens += len(ids)
            if parts:
                yield _block(number, batch, held, first, batch.num_rows, parts)
                number += 1
        released()

    return rows.mapInArrow(run, BLOCKS)


def _block(number: int, batch: pa.RecordBatch, held: np.ndarray, first: int, to: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    sizes, low, high, sums, known, seldom = (np.concatenate(x).tobytes() for x in zip(*parts, strict=True))
    ids = column(batch, "doc_id").slice(first, to - first).to_pylist()
    return pa.RecordBatch.from_pylist([{"block": number, "doc_ids": ids, "sizes": sizes, "held": held[first:to].tobytes(), "low": low, "high": high, "sums": sums, "known": known, "seldom": seldom}], schema=_BLOCKS)


def requests(table: DataFrame, classes: np.ndarray, v: int, buckets: int) -> DataFrame:
    """For each block and bucket the seldom tokens in their order: words, and the classes before (none, if not learned from) and after them."""
    sent = table.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("bucket", pa.int64()), ("of", pa.int64()), ("words", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, words = ids_of(r), np.frombuffer(r["seldom"], U)
                c, where = sent.value[ids], np.flatnonzero(ids > v)
                before = np.where(learning(r)[where], np.r_[np.uint8(0), c[:-1]][where], np.uint8(NO_CLASS))
                after = c[where + 1]  # an end follows each text
                home = bucket_of(words, buckets)
                order, edges = cuts_by(home)
                pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                parts = [pa.array([x[order[a:b]].tobytes() for a, b in pairs], pa.binary()) for x in (words, before.astype(np.uint8), after)]
                yield pa.record_batch([pa.array(home[order[edges[:-1]]] if pairs else [], pa.int64()), pa.array([r["block"]] * len(pairs), pa.int64()), *parts], schema=schema)
        released()

    return table.select("block", "sizes", "held", "low", "high", "seldom").mapInArrow(ask, "bucket long, of long, words binary, before binary, after binary")


def pulls(g: np.ndarray) -> np.ndarray:
    """How much a word's likelihood in each class gains by one more class before it (the first rows) and after it (the rest).

    That is the first order of what an exchange gains, which is all there is to a word seldom beside the classes.
    """
    g = g + ADDED_CLASS
    return np.r_[np.log(g) - np.log(g.sum(0)), np.log(g).T - np.log(g.sum(1))]


def seldom_classes(at: np.ndarray, before: np.ndarray, after: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of words numbered at, with the classes before and after them: the words, and for each the class it belongs to by all its neighbours."""
    k = CLASSES + 1
    order = np.argsort(at, kind="stable")
    at, before, after = at[order], before[order].astype(np.int64), after[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    out, ends = np.empty(len(first), np.uint8), np.r_[first, len(at)]
    for i in range(0, len(first), SELDOM_WORDS):
        to = min(i + SELDOM_WORDS, len(first))
        word = np.repeat(np.arange(to - i), np.diff(ends[i : to + 1])) * (2 * k)
        a, b = ends[i], ends[to]
        n = np.bincount(np.r_[word + before[a:b], word + k + after[a:b]], minlength=(to - i) * 2 * k).reshape(to - i, 2 * k)
        out[i:to] = 1 + np.argmax((n @ pull)[:, 1:], 1)
    return at[first], out


def answers(asked: DataFrame, counts: DataFrame, classes: np.ndarray, g: np.ndarray, v: int, least: int) -> DataFrame:
    """of, bucket, classes, n: for each request the classes of its tokens and how often their words occur in training, both none for
    unseen words; and of = -1 for each bucket, with n = how many seldom words of it are in each class."""
    k = CLASSES + 1
    sent = asked.sparkSession.sparkContext.broadcast((classes[1 + v :], pulls(g)))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        slot, pull = sent.value
        words, n, slots = (np.concatenate([np.frombuffer(x, t) for x in right[c].to_pylist()] or [np.empty(0, t)]) for c, t in (("words", U), ("counts", np.int64), ("slots", np.uint16)))
        home = slot[slots]
        sizes = [x.as_py() for x in pa.compute.binary_length(left["words"])] if len(left) else []
        asked, before, after = (np.concatenate([np.frombuffer(x, t) for x in left[c].to_pylist()] or [np.empty(0, t)]) for c, t in (("words", U), ("before", np.uint8), ("after", np.uint8)))
        near = np.minimum(np.searchsorted(words, asked), max(0, len(words) - 1))
        seen = words[near] == asked if len(words) else np.zeros(len(asked), bool)
        from_ = np.flatnonzero(seen & (before != NO_CLASS))
        which, own = seldom_classes(near[from_], before[from_], after[from_], pull)
        home[which] = own
        got, count = np.full(len(asked), NO_CLASS, np.uint8), np.zeros(len(asked), np.uint32)
        got[seen], count[seen] = home[near[seen]], n[near[seen]]
        edges = np.r_[0, np.cumsum(np.array(sizes, np.int64) // 8)].tolist()
        key = (left if len(left) else right)["bucket"][0].as_py()
        of, parts = [-1, *left["of"].to_pylist()], list(zip(edges[:-1], edges[1:], strict=True))
        types = np.bincount(home[n < least], minlength=k).astype("<i8")
        released()
        return pa.table([pa.array(of, pa.int64()), pa.array([key] * len(of), pa.int64()), pa.array([b"", *(got[a:b].tobytes() for a, b in parts)], pa.binary()), pa.array([types.tobytes(), *(count[a:b].tobytes() for a, b in parts)], pa.binary())], names=["of", "bucket", "classes", "n"])

    return asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, "of long, bucket long, classes binary, n binary")


def classed(table: DataFrame, replies: DataFrame, classes: np.ndarray, v: int, buckets: int) -> DataFrame:
    """Blocks with the class of each token, sums and known over all tokens."""
    sent = table.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("sizes", "held", "sums", "known", "classes", "homes", "places"))])
    final = pa.schema([schema.field(n) for n in ("doc_ids", "sizes", "held", "sums", "known", "classes")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = ids_of(r)
                out = {n: r[n] for n in ("block", "doc_ids", "sizes", "held", "sums", "known")}
                out |= {"classes": sent.value[ids].tobytes(), "homes": bucket_of(np.frombuffer(r["seldom"], U), buckets).astype(np.uint32).tobytes(), "places": np.packbits(ids > v).tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=schema)
        released()

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = {r["bucket"]: r for r in right.to_pylist()}
        out = []
        for r in left.to_pylist():
            sizes, c = np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["classes"], np.uint8).copy()
            where = np.flatnonzero(np.unpackbits(np.frombuffer(r["places"], np.uint8), count=len(c)))
            home, n = np.frombuffer(r["homes"], np.uint32), np.zeros(len(where), np.int64)
            order, edges = cuts_by(home)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                reply, own = replies[int(home[order[a]])], order[a:b]
                got = np.frombuffer(reply["classes"], np.uint8)
                c[where[own[got != NO_CLASS]]] = got[got != NO_CLASS]
                n[own] = np.frombuffer(reply["n"], np.uint32)
            row = np.repeat(np.arange(len(sizes)), sizes)[where]
            sums = np.frombuffer(r["sums"]) + np.bincount(row, np.log10(n + ADDED_WORD), len(sizes))
            known = np.frombuffer(r["known"], np.int64) + np.bincount(row[n > 0], minlength=len(sizes))
            out.append({"doc_ids": r["doc_ids"], "sizes": r["sizes"], "held": r["held"], "sums": sums.tobytes(), "known": known.tobytes(), "classes": c.tobytes()})
        released()
        return pa.Table.from_pylist(out, schema=final)

    kind = "block long, doc_ids array<long>, sizes binary, held binary, sums binary, known binary, classes binary, homes binary, places binary"
    return table.mapInArrow(walk, kind).groupBy("block").cogroup(replies.where("of >= 0").groupBy("of")).applyInArrow(fill, "doc_ids array<long>, sizes binary, held binary, sums binary, known binary, classes binary")


def seed_bigrams(table: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """How often each unit of the first window follows each in the training documents, an end before each first word."""
    sent = table.sparkSession.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEEDS * SEEDS, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                units = sent.value[ids_of(r)[learning(r)]]
                np.add.at(total, np.r_[0, units[:-1]] * SEEDS + units, 1)
        task = TaskContext.get().partitionId() // TABLE_TASKS
        raw = total.astype(np.uint32) if total.max(initial=0) < 2**32 else total
        parts = [raw[i * SEEDS : (i + 16) * SEEDS].tobytes() for i in range(0, SEEDS, 16)]
        yield pa.record_batch({"tasks": pa.array([task] * len(parts), pa.int64()), "part": pa.array(range(len(parts)), pa.int32()), "wide": pa.array([raw.itemsize == 8] * len(parts)), "n": pa.array(parts, pa.binary())})
        released()

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros(16 * SEEDS, np.int64)
        for wide, n in zip(rows["wide"].to_pylist(), rows["n"].to_pylist(), strict=True):
            part = np.frombuffer(n, np.int64 if wide else np.uint32)
            total[: len(part)] += part
        return pa.table({"tasks": pa.array([0], pa.int64()), "part": pa.array([key[-1].as_py()], pa.int32()), "wide": [True], "n": pa.array([total.tobytes()], pa.binary())})

    schema = "tasks long, part int, wide boolean, n binary"
    once = table.select("sizes", "held", "low", "high").mapInArrow(count, schema).groupBy("tasks", "part").applyInArrow(add, schema)
    out = np.zeros((SEEDS + 16) * SEEDS, np.int64)
    for r in once.groupBy("part").applyInArrow(add, schema).toLocalIterator():
        n = np.frombuffer(bytes(r["n"]), np.int64)
        out[r["part"] * 16 * SEEDS : r["part"] * 16 * SEEDS + len(n)] += n
    return out[: SEEDS * SEEDS].reshape(SEEDS, SEEDS)


def exchanged(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each unit; the end alone has class 0. Units move, most frequent first, to the class with the highest likelihood."""
    mass = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-mass, kind="stable") if u != 0 and mass[u]]
    home = np.ones(len(pairs), np.int64)
    home[0] = 0
    for i, u in enumerate(order):
        home[u] = 1 + i % classes
    k = classes + 1
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), home] = 1
    wide = pairs.astype(float)
    g = member.T @ wide @ member
    ahead, behind = wide @ member, wide.T @ member
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = home[u], wide[u, u]
            out, into = ahead[u].copy(), behind[u].copy()
            out[a] -= own
            into[a] -= own
            g[a] -= out
            g[:, a] -= into
            g[a, a] -= own
            rows, columns = f(g + out).sum(1) - f(g).sum(1), (f(g + into[:, None]) - f(g)).sum(0)
            d = np.diagonal(g)
            corner = f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            left, right = g.sum(1), g.sum(0)
            n_out, n_in = out.sum() + own, into.sum() + own
            gain = rows + columns + corner - (f(left + n_out) - f(left)) - (f(right + n_in) - f(right))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            g[b] += out
            g[:, b] += into
            g[b, b] += own
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                home[u] = b
                ahead[:, a] -= wide[:, u]
                ahead[:, b] += wide[:, u]
                behind[:, a] -= wide[u]
                behind[:, b] += wide[u]
            elif b != a:
                g[b] -= out
                g[:, b] -= into
                g[b, b] -= own
                g[a] += out
                g[:, a] += into
                g[a, a] += own
        if not moved:
            break
    return home


def class_bigrams(table: DataFrame, classes: np.ndarray | None = None) -> np.ndarray:
    """How often each class follows each in the training documents; classes of units, or none where the table has those of tokens."""
    k = CLASSES + 1
    sent = table.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                c = np.frombuffer(r["classes"], np.uint8) if sent.value is None else sent.value[ids_of(r)]
                c = c[learning(r)].astype(np.int64)
                total += np.bincount(np.r_[0, c[:-1]] * k + c, minlength=k * k) if len(c) else 0
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])
        released()

    out = np.zeros(k * k)
    for r in table.select("sizes", "held", *(["classes"] if classes is None else ["low", "high"])).mapInArrow(count, "n array<long>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out.reshape(k, k)


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For words of class own, with counts of the classes after and before them, the class of the highest likelihood.

    Each word is taken out of the class bigrams g and put into each class in turn; the others stay. Ties leave it.
    """
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    at = np.arange(len(own))
    left = np.repeat(g[None], len(own), 0)
    left[at, own] -= after
    left[at, :, own] -= before
    left = np.maximum(left, 0)
    rows = (f(left + after[:, None, :]) - f(left)).sum(2)
    columns = (f(left + before[:, :, None]) - f(left)).sum(1)
    out, into = left.sum(2), left.sum(1)
    gain = rows + columns - (f(out + after.sum(1)[:, None]) - f(out)) - (f(into + before.sum(1)[:, None]) - f(into))
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, own] + 1e-9, best, own)


def regrouped(table: DataFrame, classes: np.ndarray, v: int, g: np.ndarray, turn: int) -> np.ndarray:
    """The classes after every second frequent word, by turns, has gone to its best one; decided part by part of the vocabulary."""
    k = CLASSES + 1
    sent = table.sparkSession.sparkContext.broadcast((classes, g))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            n, codes = np.diff(np.r_[first, len(codes)]), codes[first]
            part = codes // (PART_UNITS * 2 * k)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            inner, pairs = (codes - part * (PART_UNITS * 2 * k)).astype(np.uint32), list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            return pa.record_batch([pa.array(part[edges[:-1]].astype(np.int64)), *(pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (inner, n.astype(np.uint32)))], names=["part", "codes", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                units = ids_of(r)[learning(r)]
                c = sent.value[0][units].astype(np.int64)
                where = np.flatnonzero((units > 0) & (units <= v) & ((units + turn) % 2 == 0))
                if len(where):
                    start = (units[where] - 1) * (2 * k)
                    codes = np.r_[start + np.r_[0, c[:-1]][where], start + k + np.r_[c[1:], 0][where]]
                    held.append(codes.astype(np.uint32 if v * 2 * k < 2**32 else np.uint64))
                    if sum(map(len, held)) > HELD_PAIRS:
                        yield summed()
                        held = []
        if held:
            yield summed()
        released()

    def decide(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        classes, g = sent.value
        part = key[0].as_py()
        total = np.zeros(PART_UNITS * 2 * k, np.int64)
        for codes, n in zip(rows["codes"].to_pylist(), rows["n"].to_pylist(), strict=True):
            total[np.frombuffer(codes, np.uint32)] += np.frombuffer(n, np.uint32)
        total = total.reshape(PART_UNITS, 2, k).astype(float)
        own = classes[1 + part * PART_UNITS : min(1 + v, 1 + (part + 1) * PART_UNITS)].astype(np.int64)
        moving = np.flatnonzero(total[: len(own)].sum((1, 2)) > 0)
        for at in range(0, len(moving), 256):
            which = moving[at : at + 256]
            own[which] = best_classes(own[which], total[which, 1], total[which, 0], g)
        return pa.table({"part": pa.array([part], pa.int64()), "classes": pa.array([own.astype(np.uint8).tobytes()], pa.binary())})

    out = classes.copy()
    found = table.select("sizes", "held", "low", "high").mapInArrow(count, "part long, codes binary, n binary").groupBy("part").applyInArrow(decide, "part long, classes binary")
    for r in found.toLocalIterator():
        now = np.frombuffer(bytes(r["classes"]), np.uint8)
        out[1 + r["part"] * PART_UNITS : 1 + r["part"] * PART_UNITS + len(now)] = now
    return out


def clustered(table: DataFrame, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (the end, the frequent words, the slots of seldom ones), and the class bigrams."""
    v = len(slots)
    seeds = np.r_[0, 1 + np.arange(min(v, TOP)), 1 + TOP + slots[TOP:].astype(np.int64), 1 + TOP + np.arange(SUFFIXES)]
    classes = exchanged(seed_bigrams(table, seeds))[seeds].astype(np.uint8)
    for turn in range(WIDE_ROUNDS if v > TOP else 0):
        classes = regrouped(table, classes, v, class_bigrams(table, classes), turn)
    return classes, class_bigrams(table, classes)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs.

    Rows with crc32(doc_id as text) mod 5 other than 1 are learned from, and those with a null doc_id. Null and empty
    texts have one token, the end. Repeated rows count each. Scores are base-10 logarithms; where nothing is learned
    from, every token is unseen. An empty table gives no rows. Other columns are not read.
    """
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)))
    size, ends = rows.agg(F.count("*"), F.count_if(~F.col("held_out"))).first()
    buckets = max(16, -(-size // BUCKET_ROWS))
    counts = word_counts(rows.where(~F.col("held_out")), buckets, lower=True)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    least = least_count(n)
    words, often, slots = frequent(counts, least)
    table = staged(blocks(rows, words, often, ends), "blocks")
    classes, g = clustered(table, slots)
    replies = staged(answers(requests(table, classes, len(words), buckets), counts, classes, g, len(words), least), "replies")
    tokens = staged(classed(table, replies, classes, len(words), buckets), "classed")
    moves = class_bigrams(tokens)
    step = np.log10((moves + ADDED_CLASS) / (moves.sum(1, keepdims=True) + ADDED_CLASS * (CLASSES + 1)))
    types = np.bincount(classes[: 1 + len(words)], minlength=CLASSES + 1)
    for r in replies.where("of < 0").select("n").toLocalIterator():
        types = types + np.frombuffer(bytes(r["n"]), np.int64)
    room = np.log10(moves.sum(0) + ADDED_WORD * (types + (np.arange(CLASSES + 1) > 0)))
    floor = np.log10(n + ADDED_WORD * (v + 1))
    sent = rows.sparkSession.sparkContext.broadcast(step - room[None, :])
    final = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                c, sizes = np.frombuffer(r["classes"], np.uint8), np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                sums, known = np.frombuffer(r["sums"]), np.frombuffer(r["known"], np.int64)
                model = np.add.reduceat(cost[np.r_[np.uint8(0), c[:-1]], c], np.cumsum(sizes) - sizes)
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(np.frombuffer(r["held"], bool)), *(pa.array(x) for x in (sizes, known, np.full(len(sizes), n, np.int64), sums - sizes * floor, model + sums))], schema=final)
        released()

    out = tokens.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
