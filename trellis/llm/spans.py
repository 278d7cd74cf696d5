"""What the two span finders share: running a scanner over the texts that can hold anything, and the digest columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Texts, column, pick, released, text_slices

#: A span of code points [start, end) of a text, with what the method knows of it.
SPAN = "struct<kind:string,start:int,end:int,score:double>"
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
Span = tuple[str, int, int, float]


def holding(texts: Texts, marks: np.ndarray) -> np.ndarray:
    """Whether each text has a byte at one of the marked places (ascending)."""
    at = np.searchsorted(marks, texts.offsets)
    return at[1:] > at[:-1]


def places(data: bytes, needle: bytes) -> list[int]:
    out, at = [], data.find(needle)
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + 1)
    return out


def scanned(docs: DataFrame, candidates: Callable[[Texts], np.ndarray], scan: Callable[[list[str]], list[list[Span]]]) -> DataFrame:
    """(doc_id, found) for each row of docs: the spans that scan finds in the texts that candidates marks."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                which = np.flatnonzero(candidates(texts))
                if len(which):
                    for i, spans in zip(which.tolist(), scan([texts.bytes(i).decode() for i in which.tolist()]), strict=True):
                        found[i] = [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans]
                yield pa.record_batch([column(batch, "doc_id").slice(at, len(texts)), pa.array(found, pa.list_(_ARROW))], names=["doc_id", "found"])
        released()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<{SPAN}>")


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def digest(found: DataFrame, base: list[str]) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_base = F.filter("found", lambda s: s["kind"].isin(*base) & (s["score"] == 1.0))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(of_base, of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(of_base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", text), ",").alias("spans"))

