"""Cross-tokenizer alignment: where the tokens of two vocabularies overlap in a text, and how often each pair of ids does.

Texts are worked on in blocks of a few megabytes. Neither tokenizer merges across a single space between two characters
that aren't white space, so that a block's texts are sequences of units, each of which is encoded and aligned once. Its
tokens are intervals of bytes in two tables of a DuckDB database of the task: an equality join gives the ends that both
share, window sums over these number the groups, an ASOF join gives the token in which another starts, and a range join
those that start inside one. Blocks are written with their counts of id pairs; Spark adds these up, ranks them by the
second id, and sends each block the counts of its own pairs, from which follow the sums of its texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm.common import IS_SPACE, LARGE_ROWS, Texts, Words, binary, column, documents, ints, pick, released, staged, text_slices

#: Bytes of text in a block, and those whose new units are aligned together, but for one longer text. Larger blocks hold
#: fewer distinct units and id pairs; what is held at once in DuckDB follows the smaller number.
BLOCK_BYTES, STEP_BYTES = 4 << 20, 1 << 18
#: What the first bytes of white space beyond ASCII are among: no unit begins beside a character that begins with them.
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_META = "▁"

OVERLAPS = [
    "create or replace temp table shared as select a.e from a join b using (e)",
    *(
        f"create or replace temp table grouped_{x} as select k, coalesce(sum(shut) over (order by k rows between unbounded preceding and 1 preceding), 0)::int as g "
        f"from (select {x}.k, (shared.e is not null)::int as shut from {x} left join shared using (e))"
        for x in "ab"
    ),
    "create or replace temp table started as select a.u, a.s, a.e, a.id as a, b.id as b, b.e as upto from a asof join b on a.s >= b.s",
    "create or replace temp table later as select b.s, b.id as b from b anti join a using (s)",
    "create or replace temp table inside as select started.u, started.a, later.b from started join later on later.s > started.s and later.s < started.e where started.upto < started.e",
    "create or replace temp table links as select u, (a::bigint << 32) + b as pair, count(*) as m from (select u, a, b from started union all select u, a, b from inside) group by all",
]


class Vocabularies:
    """Two tokenizers and the bytes of their tokens: ranks of a byte-level vocabulary (a), and a model of pieces (b)."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_META, " ").encode() for i, p in enumerate(pieces)]
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # a unit can begin at a space only if no piece has one behind another character
        self.splits = not any(_META in p.lstrip(_META) for p in pieces)
        #: A token's id as text with what may stand behind it: of a ',' or '|', of b ',' or ';'.
        self.strings = pa.array([f"{i}{c}" for n, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for c in marks])


_vocabularies: dict[tuple, Vocabularies] = {}


def vocabularies(*paths: str) -> Vocabularies:
    if paths not in _vocabularies:
        _vocabularies[paths] = Vocabularies(*paths)
    return _vocabularies[paths]


def spaced(texts: Texts) -> Texts:
    """The texts, each with a space before it."""
    return Texts(np.insert(texts.data, texts.offsets[:-1], 0x20), texts.offsets + np.arange(len(texts.offsets)))


def unit_starts(texts: Texts, splits: bool) -> np.ndarray:
    """Where units begin: at the start of each text, and at single spaces between characters that aren't white space."""
    data, n = texts.data, len(texts.data)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    if not splits:
        return np.flatnonzero(edge[:-1])
    at = np.flatnonzero(data == 0x20)
    before, behind, second, third = (np.take(data, at + i, mode="clip") for i in (-1, 1, -2, -3))
    wide = (before >= 0x80) & ((second == 0xC2) | _WIDE[third])
    inner = ~IS_SPACE[before] & ~wide & ~IS_SPACE[behind] & ~_WIDE[behind] & ~edge[at + 1]
    return at[edge[at] | inner]


def unequal(units: list[bytes], tokens: list[list[int]], token_bytes: list[bytes]) -> np.ndarray:
    """Whether the tokens of each unit, joined, are something else than the unit."""
    if b"".join(map(token_bytes.__getitem__, chain.from_iterable(tokens))) == b"".join(units):
        return np.zeros(len(units), bool)
    return np.fromiter((b"".join(map(token_bytes.__getitem__, t)) != u for u, t in zip(units, tokens, strict=True)), bool, len(units))


def intervals(tokens: list[list[int]], n_bytes: np.ndarray) -> pa.Table:
    """u (unit), k (number), id, s and e (bytes from and to) of the tokens, unit after unit."""
    count = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ids = np.fromiter(chain.from_iterable(tokens), np.int32, int(count.sum()))
    ends = np.cumsum(n_bytes[ids])
    return pa.table({"u": np.repeat(np.arange(len(tokens), dtype=np.int32), count), "k": np.arange(len(ids), dtype=np.int32), "id": ids, "s": ends - n_bytes[ids], "e": ends})


class Overlaps:
    """The groups and links of units: per unit its numbers and the text of its groups, per unit and id pair the links."""

    def __init__(self, con: "duckdb.DuckDBPyConnection", voc: Vocabularies, of_a: list[list[int]], of_b: list[list[int]]) -> None:
        a, b, n = intervals(of_a, voc.n_a), intervals(of_b, voc.n_b), len(of_a)
        for name, rows in (("a", a), ("b", b)):
            con.register("rows", rows)
            con.execute(f"create or replace temp table {name} as select * from rows")
            con.unregister("rows")
        for statement in OVERLAPS:
            con.execute(statement)
        group_a, group_b = (con.sql(f"select g from grouped_{x} order by k").fetchnumpy()["g"] for x in "ab")
        links = con.sql("select u, pair, m from links order by u, pair").fetchnumpy()
        self.unit, self.pair, self.links = links["u"].astype(np.int32), links["pair"].astype(np.int64), links["m"].astype(np.int32)
        unit_a, unit_b = a["u"].to_numpy(), b["u"].to_numpy()
        last_a, last_b = (np.append(g[1:] != g[:-1], np.ones(min(len(g), 1), bool)) for g in (group_a, group_b))
        self.numbers = [np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_a[last_a], minlength=n), np.bincount(self.unit, self.links, minlength=n).astype(np.int64)]
        # a group's tokens of a, then those of b
        order = np.empty(len(group_a) + len(group_b), np.int64)
        order[np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a["id"].to_numpy().astype(np.int64) + last_a
        order[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(voc.bytes_a) + 2 * b["id"].to_numpy().astype(np.int64) + last_b
        # texts of tokens that are taken one after another lie so in memory: those of a unit are one text there
        tokens = voc.strings.take(pa.array(order))
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[np.append(0, np.cumsum(self.numbers[0] + self.numbers[1]))] if n else np.zeros(1, np.int32)
        self.texts = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), tokens.buffers()[2] or pa.py_buffer(b""))


def _sums(values: np.ndarray, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the units' values over each text, whose units are those from first[i] to first[i + 1]."""
    return np.diff(np.append(0, np.cumsum(values[units]))[first])


class Block:
    """Texts that are written together, as sequences of units, each of which is encoded and aligned where it is first seen."""

    def __init__(self, con: "duckdb.DuckDBPyConnection", voc: Vocabularies) -> None:
        self.con, self.voc, self.n_bytes = con, voc, 0
        self.ids: list[pa.Array] = []
        self.units: list[np.ndarray] = []
        self.n_units: list[np.ndarray] = []
        self.empty: list[np.ndarray] = []
        # units in the order of their numbers, and the numbers by ascending hash
        self.hashes, self.by_hash = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.texts: list[pa.StringArray] = []
        self.changed: list[np.ndarray] = []
        self.numbers: list[list[np.ndarray]] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: Texts) -> None:
        self.ids.append(ids)
        self.n_bytes += len(texts.data)
        self.empty.append(np.diff(texts.offsets) == 0)
        texts = spaced(texts)
        starts = unit_starts(texts, self.voc.splits)
        ends = np.append(starts[1:], len(texts.data))
        first = np.searchsorted(starts, texts.offsets)
        found, which, unit = np.unique(Words(texts.data, starts, ends, first).hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        new = (at == len(self.hashes)) | (np.take(self.hashes, at, mode="clip") != found) if len(self.hashes) else np.ones(len(found), bool)
        self._align(texts.data.tobytes(), starts[which[new]].tolist(), ends[which[new]].tolist())
        self.by_hash = np.insert(self.by_hash, at[new], np.arange(len(self.hashes), len(self.hashes) + new.sum(), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at[new], found[new])
        self.units.append(self.by_hash[np.searchsorted(self.hashes, found)][unit])
        self.n_units.append(np.diff(first))

    def _align(self, raw: bytes, starts: list[int], ends: list[int]) -> None:
        """Encodes new units; those that a tokenizer changes have no tokens."""
        before, voc = len(self.hashes), self.voc
        units = [raw[i:j] for i, j in zip(starts, ends)]
        plain = [u.decode() for u in units]
        of_a, of_b = list(map(voc.a.encode_ordinary, plain)), voc.b.encode([u[1:] for u in plain], num_threads=1)
        changed = unequal(units, of_a, voc.bytes_a) | unequal(units, of_b, voc.bytes_b)
        for i in np.flatnonzero(changed).tolist():
            of_a[i] = of_b[i] = []
        found = Overlaps(self.con, voc, of_a, of_b)
        self.texts.append(found.texts)
        self.changed.append(changed)
        self.numbers.append(found.numbers)
        self.links.append((found.unit + np.int32(before), found.pair, found.links))

    def row(self, number: int, digest: bool) -> pa.RecordBatch:
        """The block's number, its texts' ids, numbers and units, the links of each unit by the place of their id pair, and counts of pairs."""
        unit, n_units = np.concatenate(self.units), np.concatenate(self.n_units)
        owner = np.repeat(np.arange(len(n_units)), n_units)
        # a text with a unit that either tokenizer changes has no tokens
        whole = ~np.concatenate(self.empty) & (np.bincount(owner, np.concatenate(self.changed)[unit], minlength=len(n_units)) == 0)
        unit, n_units = unit[whole[owner]], np.where(whole, n_units, 0)
        first = np.append(0, np.cumsum(n_units))
        texts, groups = pa.concat_arrays(self.texts).cast(pa.large_string()), []
        n_texts = len(texts)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            of = texts.take(pa.array(unit[i:j])).buffers() if j > i else None
            raw = memoryview(of[2])[: np.frombuffer(of[1], np.int64)[j - i] - 1] if of else b""
            groups.append(hashlib.sha256(raw).hexdigest() if digest and of else bytes(raw).decode())
        del texts
        self.texts.clear()
        of_unit, pair, links = (np.concatenate(x) for x in zip(*self.links))
        self.links.clear()
        pairs, of_pair = np.unique(pair, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, of_pair, links * np.bincount(unit, minlength=n_texts)[of_unit])
        listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        numbers = [_sums(np.concatenate(x), unit, first) for x in zip(*self.numbers)]
        columns = {"block": pa.array([number], pa.int64()), "doc_id": listed(pa.concat_arrays(self.ids)), "groups": listed(pa.array(groups, pa.string()))}
        columns |= {name: listed(pa.array(x, pa.int64())) for name, x in zip(_LONGS, [*numbers, n_units], strict=True)}
        # a link an entry, by unit: nearly all are the only one of their pair in a unit
        per_unit = np.bincount(of_unit, links, minlength=n_texts)
        columns |= {name: binary([x.astype(np.int32)]) for name, x in (("units", unit), ("per_unit", per_unit), ("of_pair", np.repeat(of_pair, links)))}
        a, b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        columns["pairs"] = listed(pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(counts)], names=["a", "b", "n"]))
        return pa.record_batch(columns)


_LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_units")


def blocks(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, digest: bool = True) -> DataFrame:
    """A row for each block of docs: its number, its texts' ids and numbers, and counts of its own id pairs."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        voc, number = vocabularies(ranks_path, pattern, model_path), TaskContext.get().partitionId() << 32
        with duckdb.connect(config={"threads": 1}) as con:
            block = Block(con, voc)
            for batch in batches:
                for at, texts in text_slices(batch, "text", min(STEP_BYTES, BLOCK_BYTES)):
                    block.add(column(batch, "doc_id").slice(at, len(texts)), texts)
                    if block.n_bytes >= BLOCK_BYTES:
                        yield block.row(number, digest)
                        block, number = Block(con, voc), number + 1
                        released()
            if block.ids:
                yield block.row(number, digest)
            del block
        released()

    longs = ", ".join(f"{name} array<long>" for name in _LONGS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, doc_id array<{kind}>, groups array<string>, {longs}, units binary, per_unit binary, of_pair binary, pairs array<struct<a:int,b:int,n:long>>")


def _own_pairs(written: DataFrame) -> DataFrame:
    """The id pairs of each block with their places there; pairs that only changed texts have count nothing."""
    return written.select("block", F.posexplode("pairs").alias("p", "pair")).select("block", "p", "pair.*")


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, count and best of each pair of ids that overlap somewhere: in how many links, and whether b has none with more.

    Blocks have each pair once, so that no key has more rows than there are blocks, and sums are combined before the shuffle.
    """
    counts = _own_pairs(written).where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row of docs.

    Space and text are encoded by the ranks (a), the text by the model of pieces (b), which puts the space before it itself.
    groups has the ids of each group as `a1,a2|b1;a3|b2,b3`, or with digest its SHA-256 in hex. Null and empty texts, and
    texts that a tokenizer doesn't give back byte for byte, have no tokens: numbers are 0 and groups ''. Special tokens in a
    text are plain text. Repeated rows each count; a null doc_id stays null. Texts are encoded whole whatever their length;
    memory follows the block, the longest text and the longest unit. An empty table gives no rows.
    """
    written = staged(blocks(docs, ranks_path, pattern, model_path, digest), "aligned", **LARGE_ROWS)
    counts = staged(pair_counts(written), "pair-counts")
    answers = _own_pairs(written).join(counts, ["a", "b"]).select(F.col("block").alias("_block"), "p", "count", "best")
    kind = written.schema["doc_id"].dataType.elementType.simpleString()

    def summed(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({})
        row = block.combine_chunks().to_batches()[0]
        listed = lambda name: column(row, name).values.slice(column(row, name).offsets[0].as_py(), column(row, name).value_lengths()[0].as_py())
        numbers = lambda name, kind: np.frombuffer(column(row, name)[0].as_buffer(), kind)
        units, per_unit, of_pair = (numbers(x, np.int32) for x in ("units", "per_unit", "of_pair"))
        count, best = np.zeros((2, int(of_pair.max(initial=-1)) + 1), np.int64)
        if answer.num_rows:
            one = answer.combine_chunks().to_batches()[0]
            count[ints(one, "p")], best[ints(one, "p")] = ints(one, "count"), ints(one, "best")
        first, edges = (np.append(0, np.cumsum(x, dtype=np.int64)) for x in (listed("n_units").to_numpy(), per_unit))
        of_units = {name: np.diff(np.append(0, np.cumsum(of[of_pair]))[edges]) for name, of in (("n_best", best), ("count_sum", count))}
        sums = {name: _sums(of, units, first) for name, of in of_units.items()}
        return pa.table({"doc_id": listed("doc_id"), **{x: listed(x) for x in _LONGS[:4]}, **sums, "groups": listed("groups")})

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return written.drop("pairs").groupBy("block").cogroup(answers.groupBy("_block")).applyInArrow(summed, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabulary

    found = aligned(documents(spark, sf_dir), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN, vocabulary.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")
