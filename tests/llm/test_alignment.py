"""Cross-tokenizer alignment against a plain model: whole texts through both tokenizers, and every pair of tokens by its bytes."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SMALL
from trellis.llm import alignment
from trellis.llm.catalog import QUERIES

WIDE = ["\x85", "\xa0", " ", " ", " ", " ", " ", "　", "᠎", "​", "﻿", "\x1c", "\x1f", "\x00", "é", "ß", "—", "…", "中", "\U0001f600"]
ODD = [
    None, "", " ", "   ", "\n", "one", " one", "one ", "a  b   c", "don't  stop\n me we'll", "<|endoftext|> <s>x</s> <unk> <0x41>", "x▁y and more", "▁", "tab\tand\r\nline  \n  ends  ", "1 2 34 567 8,900.5",
    *(f"a{w}b {w} c{w} {w}d e{w}" for w in WIDE), "the cat sat " * 40, "a" * 3000, "ab" * 1500, " a" * 800, "\n" * 500, "x " * 500 + "y", "über die Straße gehen, und zurück.", "a b", "a b",
]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # how byte-level vocabularies write bytes: printable ones as themselves, others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in plain)}
    bytes_a = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    bytes_b = {i: piece(i) for i in range(b.get_piece_size())}

    def encode(text):
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [[bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]]
        return (ids_a, ids_b, *parts) if text and all(b"".join(p) == whole for p in parts) else ([], [], [], [])

    return encode


def places(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at := at + len(p)))
    return out


def by_hand(encode, texts):
    found, total = [], collections.Counter()
    for text in texts:
        ids_a, ids_b, parts_a, parts_b = encode(text or "")
        a, b = places(parts_a), places(parts_b)
        links, j = [], 0
        for i, (s, e) in enumerate(a):
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        number_a, number_b = ({e: n for n, (_, e) in enumerate(x, 1)} for x in (a, b))
        groups, i, k = [], 0, 0
        for end in sorted({e for _, e in a} & {e for _, e in b}):
            i2, k2 = number_a[end], number_b[end]
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[k:k2])))
            i, k = i2, k2
        total.update(links)
        found.append((len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), ";".join(groups)) for n_a, n_b, links, groups in found]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def run(docs, **options):
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(docs, *paths, **options)


def test_odd_texts_against_every_pair(spark, encoders):
    rng = random.Random(7)
    alphabet = [*WIDE, " ", " ", "  ", "the", "tion", "a", "X", "9", "'s", "\n", ".", "▁"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i % 50 == 49 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, groups string, n_a int").repartition(3)
    got = sorted((str(r["doc_id"]), *(r[c] for c in NUMBERS), r["groups"]) for r in run(docs, digest=False).collect())
    assert got == sorted((str(None if i % 50 == 49 else i), *x) for i, x in enumerate(by_hand(encoders, texts)))
    assert {r[1] for r in got if r[0] == "11"} == {0}  # a tokenizer that changes a text leaves it without tokens
    assert run(docs.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in run(docs.where("doc_id in (0, 1)")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_blocks_of_one_text_each_change_nothing(spark, encoders, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, run(docs).collect()), key=repr)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    assert sorted(map(tuple, run(docs).collect()), key=repr) == whole


def test_the_query_against_every_pair(spark, encoders):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    hashed = lambda text: hashlib.sha256(text.encode()).hexdigest() if text else ""
    expected = sorted((i, *x[:-1], hashed(x[-1])) for (i, _), x in zip(rows, by_hand(encoders, [t for _, t in rows])))
    assert sorted((r["doc_id"], *(r[c] for c in NUMBERS), r["groups_sha256"]) for r in QUERIES["op12_token_alignment"](spark, SMALL).collect()) == expected


def test_rows_of_megabytes_get_row_groups_of_few_rows(spark):
    from urllib.parse import urlparse

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from trellis.llm.common import LARGE_ROWS, staged

    rows = spark.range(12).coalesce(1).select("id", F.expr("transform(sequence(1, 300000), x -> xxhash64(id, x))").alias("x"))
    kept = staged(rows, "large", **LARGE_ROWS)
    [file] = kept.inputFiles()
    found = pq.ParquetFile(urlparse(file).path).metadata
    assert found.num_rows == 12 and max(found.row_group(i).num_rows for i in range(found.num_row_groups)) <= 4
    assert kept.select(F.sum(F.size("x"))).first()[0] == 12 * 300000
