"""Secret scans by assignment-aware lexing.

Fixed patterns give the base spans. Beyond these, source and configuration syntax is read as pairs of a name and a value
(name = "x", "name": 'x', name := x, NAME=x, <name>x</name>, and operands joined by +). A value is a literal or the name of
a constant assigned before; constants are followed through names to the literals that they stand for. A literal that
reaches a sensitive name is scored by that name and by its own length, alphabet and entropy.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import LOWER, Texts, documents, pick, released, text_slices
from trellis.llm.spans import Span, digest, holding, ordered, places, scanned

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "literal"]

#: How sensitive a target is, by the parts of its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.8, "bearer": 0.9, "key": 0.7, "pass": 0.8,
}
STEMS = [b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer"]
LEAST_SCORE = 0.5
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|todo|changeme|example|placeholder|your[-_ ].*|x+|\*+|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\)s|\{\{.*\}\})$")
#: Those of any length that can hold digits, and how much of each end of a value tells them.
OPEN_PLACEHOLDER = re.compile(r"(?i)^(?:your[-_ ].*|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\)s|\{\{.*\}\})$")
ENDS = 16

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_VALUE = rf"""(?:"(?P<{{0}}dq>(?:[^"\\\n]|\\.)*)"|'(?P<{{0}}sq>(?:[^'\\\n]|\\.)*)'|(?P<{{0}}bare>[A-Za-z0-9+/_.=@$%~\-]+))"""
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?:(?P<xml><)(?P<tag>{_NAME})>(?P<body>[^<>\n]+)</(?P=tag)>|(?P<name>{_NAME})["']?\]?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*"""
    + _VALUE.replace("{0}", "a")
    + ")"
)
MORE = re.compile(r"[ \t]*\+[ \t]*" + _VALUE.replace("{0}", "a"))


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """The highest weight of the parts of a name: words between separators and at changes of case, and neighbours joined."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


class Value(NamedTuple):
    """What the score of a value needs: its length, the share of each character, its two ends, and whether a part was quoted."""

    n: int
    shares: dict[str, float]
    head: str
    tail: str
    quoted: bool


def _literal(value: str, quoted: bool) -> Value:
    n = len(value)
    return Value(n, {c: k / n for c, k in Counter(value).items()}, value[:ENDS], value[-ENDS:], quoted)


def _joined(parts: list[Value]) -> Value:
    """The parts one after another; work and memory don't depend on the length that this has written out."""
    if len(parts) == 1:
        return parts[0]
    n = sum(p.n for p in parts)
    shares: dict[str, float] = {}
    for p in parts:
        for c, share in p.shares.items():
            shares[c] = shares.get(c, 0.0) + p.n / n * share
    head = tail = ""
    for p in parts:
        head = (head + p.head)[:ENDS]
        tail = (tail + p.tail)[-ENDS:]
    return Value(n, shares, head, tail, any(p.quoted for p in parts))


def strength(value: Value) -> float:
    """0 to 1: how much a value looks like a secret and not like a word, a path, a number or a placeholder.

    Placeholders longer than ENDS are told by their ends, or have no digit.
    """
    n, shares = value.n, value.shares
    if n < 8 or " " in shares or not any(c.isdigit() for c in shares) or not any(c.isalpha() for c in shares):
        return 0.0
    if PLACEHOLDER.match(value.head) if n <= ENDS else OPEN_PLACEHOLDER.match(value.head + value.tail):
        return 0.0
    entropy = -sum(x * math.log2(x) for x in shares.values() if x)
    length = min(n, 16) / 16
    return min(1.0, entropy / 3.2) * (0.6 + 0.4 * length) * (1.0 if value.quoted else 0.9)


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, each once, with the best of its scores.

    Each assignment keeps its operands: literals, or the numbers of the earlier assignments of its constants. Nothing is
    written out, so that constants that double line by line cost no more than others.
    """
    known: dict[str, int] = {}
    operands: list[list[tuple[int, int, bool] | int]] = []
    scores: list[float] = []
    values: dict[int, Value] = {}

    def operand(m: re.Match) -> tuple[int, int, bool] | int:
        group, quoted = next(x for x in (("adq", True), ("asq", True), ("abare", False)) if m[x[0]] is not None)
        return known[m[group]] if not quoted and m[group] in known else (*m.span(group), quoted)

    def value(number: int) -> Value:
        waiting = [number]
        while waiting:
            at = waiting[-1]
            if at not in values and (first := [p for p in operands[at] if isinstance(p, int) and p not in values]):
                waiting += first
                continue
            if at not in values:
                parts = [values[p] if isinstance(p, int) else _literal(text[p[0] : p[1]], p[2]) for p in operands[at]]
                values[at] = _joined(parts)
            waiting.pop()
        return values[number]

    for m in PAIR.finditer(text):
        if m["xml"]:
            name, parts = m["tag"], [(*m.span("body"), True)]
        else:
            name, parts, at = m["name"], [operand(m)], m.end()
            while more := MORE.match(text, at):
                parts.append(operand(more))
                at = more.end()
        known[name] = len(operands)
        operands.append(parts)
        weight = sensitivity(name)
        score = weight * strength(value(known[name])) if weight else 0.0
        scores.append(min(score, 0.99) if score >= LEAST_SCORE else 0.0)
    best: dict[tuple[int, int], float] = {}
    for number in range(len(operands) - 1, -1, -1):
        if score := scores[number]:
            for p in operands[number]:
                if isinstance(p, int):
                    scores[p] = max(scores[p], score)
                else:
                    best[p[:2]] = max(best.get(p[:2], 0.0), score)
    return [("literal", a, b, s) for (a, b), s in sorted(best.items()) if b > a]


def secret_spans(text: str) -> list[Span]:
    """The base spans, and the literals that lie in none of them."""
    base = base_spans(text)
    starts = sorted(x for _, x, _, _ in base)
    ends = list(accumulate((y for _, _, y, _ in sorted(base, key=lambda s: s[1])), max))
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and ends[k - 1] >= b
    return ordered([*base, *(s for s in literal_spans(text) if not inside(s[1], s[2]))], KINDS)


_HEX_BYTES = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def candidates(texts: Texts) -> np.ndarray:
    """Texts that have a run of hex digits that is long enough, AKIA, or a stem of a sensitive name and an assignment."""
    lower = LOWER[texts.data]
    raw = lower.tobytes()
    # a run of hex digits ends where its text ends
    inside = _HEX_BYTES[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    hexes = starts[ends - starts >= MIN_HEX]
    marks = holding(texts, hexes) | holding(texts, np.array(places(texts.data.tobytes(), b"AKIA"), np.int64))
    stems = np.sort(np.array([p for s in STEMS for p in places(raw, s)], np.int64))
    signs = np.flatnonzero((lower == ord("=")) | (lower == ord(":")) | (lower == ord("<")))
    return marks | (holding(texts, stems) & holding(texts, signs))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, found): for each row the spans of secrets, by start and then kind; the score of a base span is 1.

    Null and empty texts have none; a null doc_id stays null; repeated rows are scanned one by one; texts are scanned
    whole, whatever their length. An empty table gives no rows. Other columns are not read.
    """
    return scanned(docs, candidates, lambda texts: [secret_spans(t) for t in texts])


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span replaced by mark, overlapping spans by one, and n_chars counted again.

    All rows and columns stay; null and empty texts, and texts without secrets, stay as they are. Repeated rows are masked
    one by one. An empty table gives no rows. The text is the first column of that name; n_chars, where there is one such
    column, becomes a long.
    """
    names = docs.columns
    where = names.index("text")

    def masked(text: str) -> str | None:
        spans, out, end = secret_spans(text), [], 0
        for _, a, b, _ in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if spans else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(where).type
            for at, part in text_slices(batch, names[where]):
                rows = batch.slice(at, len(part))
                pieces, done = [], 0
                for i in np.flatnonzero(candidates(part)).tolist():
                    if (now := masked(part.bytes(i).decode())) is not None:
                        pieces += [rows.column(where).slice(done, i - done), pa.array([now], kind)]
                        done = i + 1
                if pieces:
                    text = pa.concat_arrays([*pieces, rows.column(where).slice(done)])
                    rows = pa.record_batch([text if i == where else rows.column(i) for i in range(rows.num_columns)], schema=batch.schema)
                yield rows
        released()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if names.count("n_chars") == 1 else out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(pick(documents(spark, sf_dir), "doc_id", "text")), BASE_KINDS)
