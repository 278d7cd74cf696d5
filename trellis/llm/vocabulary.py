"""Counting the words of a corpus: tasks add up their own words first, buckets of hashes add up the tasks.

No vocabulary is held as a whole but that of the words which occur often enough. What "enough" is grows with the square
root of the corpus, so that these words become more with the input, and far more slowly than all words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.common import U, Words, released, splitmix, staged, text_slices

#: Slots of the words that are too seldom, by their ends; distinct words that a task holds before it sends them off;
#: the least count of a frequent word, and the part of the square root of all tokens that it must reach.
SUFFIXES, HELD_WORDS, LEAST, ROOT_SHARE = 512, 1_000_000, 5, 0.01
COUNTED = "bucket long, n long, v long, words binary, counts binary, slots binary"


def least_count(tokens: int) -> int:
    return max(LEAST, math.ceil(ROOT_SHARE * math.sqrt(tokens)))


def suffix_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A slot for each word, by its last two bytes and whether it is one byte long."""
    last = data[ends - 1].astype(U)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(U) + U(1), U(0))
    return (splitmix(last * U(257) + before + U(1)) % U(SUFFIXES)).astype(np.uint16)


def _slots_of(words: Words, which: np.ndarray) -> np.ndarray:
    return suffix_slots(words.data, words.starts[which], words.ends[which]) if len(which) else np.empty(0, np.uint16)


def merged(words: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, ascending, with the sums of their counts."""
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    return words[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64), slots[order][first]


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (splitmix(words) % U(buckets)).astype(np.int64)


def cuts_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that makes keys ascend and keeps equal ones in place, and the edges of the runs of equal ones."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)


def word_counts(rows: DataFrame, buckets: int, lower: bool) -> DataFrame:
    """Per bucket of word hashes: n tokens, v distinct words, and the words (ascending) with counts and suffix slots; staged."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return merged(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def sent() -> pa.RecordBatch:
            words, counts, slots = whole()
            order, edges = cuts_by(bucket_of(words, buckets))
            words, counts, slots = words[order], counts[order], slots[order]
            pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            home = bucket_of(words[edges[:-1]], buckets)
            parts = [pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (words, counts.astype("<i8"), slots)]
            return pa.record_batch([pa.array(home), pa.array(np.zeros(len(pairs), np.int64)), pa.array(np.zeros(len(pairs), np.int64)), *parts], names=["bucket", "n", "v", "words", "counts", "slots"])

        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                words = texts.words(lower)
                if not len(words.starts):
                    continue
                distinct, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                held.append((distinct, n, _slots_of(words, first)))
                if sum(len(x[0]) for x in held) > 2 * HELD_WORDS:
                    held = [whole()]
                    if len(held[0][0]) > HELD_WORDS:
                        yield sent()
                        held = []
        if held:
            yield sent()
        released()

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("words", U), ("counts", np.int64), ("slots", np.uint16))]
        words, counts, slots = merged(*parts)
        sums = [pa.array([key[0].as_py()], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(words)], pa.int64())]
        return pa.table([*sums, *(pa.array([x.tobytes()], pa.binary()) for x in (words, counts, slots))], names=["bucket", "n", "v", "words", "counts", "slots"])

    return staged(rows.select("text").mapInArrow(gather, COUNTED).groupBy("bucket").applyInArrow(add, COUNTED), "word-counts")


def frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and slots of the words that occur least times or more, the most frequent first: what comes to the driver."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.frombuffer(r["counts"], np.int64)
                on = n >= least
                yield pa.RecordBatch.from_pylist([{"words": np.frombuffer(r["words"], U)[on].tobytes(), "counts": n[on].tobytes(), "slots": np.frombuffer(r["slots"], np.uint16)[on].tobytes()}])

    found = [(r["words"], r["counts"], r["slots"]) for r in counts.select("words", "counts", "slots").mapInArrow(keep, "words binary, counts binary, slots binary").toLocalIterator()]
    words, n, slots = (np.frombuffer(b"".join(bytes(x[i]) for x in found), t) for i, t in enumerate((U, np.int64, np.uint16)))
    order = np.lexsort((words, -n))
    return words[order], n[order], slots[order]
