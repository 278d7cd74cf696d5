"""The stages of the pipeline against plain versions, each on its own input."""

import collections
import re

import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trellis.llm.common import documents, staged
from trellis.llm.mixing import PACKET, mixed
from trellis.llm.rules import quality_rules
from trellis.llm.secret_scan import secret_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = documents(spark, SMALL)
    columns, inputs = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        inputs.append(staged(stage(spark, inputs[-1], SMALL), name))
    raw, ruled, lone, masked, mix, pieces = inputs
    assert all(x.columns == columns for x in inputs[:-1])
    assert {r["doc_id"] for r in ruled.collect()} == {r["doc_id"] for r in quality_rules(raw).where("kept").collect()}

    sets = {r["doc_id"]: shingles(r["text"]) for r in ruled.collect()}
    home = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and home[i] != home[j] and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((home[i], home[j]))
                home = {k: a if h == b else h for k, h in home.items()}
    assert sorted(r["doc_id"] for r in lone.collect()) == sorted(set(home.values()))

    def mask(text):
        out, end = [], 0
        for _, a, b, _ in secret_spans(text):
            if a >= end:
                out += [text[end:a], "[secret]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()} == {r["doc_id"]: (mask(r["text"]), len(mask(r["text"]))) for r in lone.collect()}

    before = {r["doc_id"]: r for r in masked.collect()}
    served, total = collections.Counter(), collections.Counter()
    for r in mix.collect():
        words = WORD.findall(r["text"])
        assert words == WORD.findall(before[r["doc_id"]]["text"])[: len(words)] and r["n_chars"] == len(r["text"])
        served[r["source"]] += len(words)
    for r in before.values():
        total[r["source"]] += len(WORD.findall(r["text"]))
    longest = collections.Counter()
    for r in before.values():
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"])))
    assert 2 * abs(sum(served.values()) - sum(total.values())) <= sum(longest.values()) and all(served[s] <= 3 * total[s] for s in served)
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in mix.select("doc_id").collect()}


def test_columns_that_clash_and_empty_tables(spark):
    rows = [(i, "the cat and the dog of it ran on " * 12 + f"tail {i}", "en", "s", 5, 1, "x", True) for i in range(4)] + [(9, None, None, None, 0, 1, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, words string, kept boolean")
    for n in (5, 0):
        now = docs.limit(n)
        for name, stage in pipeline.STAGES:
            now = staged(stage(spark, now, SMALL), name)
        now.collect()


def test_rows_that_share_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "a", 2), (1, text, "en", "a", 1), (1, "b " + text, "de", "a", 3), (None, text, "en", "b", 4), (None, text, "en", "b", 4), (2, text + " x", "en", "b", 5), (3, None, "en", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, "b " + text, "de", "a", 3), *rows[3:5], rows[6]], key=repr)
    mixed_rows = collections.Counter(tuple(r) for r in pipeline.source_mix(spark, docs, SMALL).collect())
    taken = mixed(docs, whole=True).groupBy("doc_id", "source", "size").agg(F.sum(F.size("copies")).alias("n")).where("n > 0").collect()
    assert {(r["doc_id"], r["size"]): r["n"] for r in taken} == {(i, len(t.split())): sum(n for k, n in mixed_rows.items() if (k[0], k[1]) == (i, t)) for i, t in {(k[0], k[1]) for k in mixed_rows}}
    assert all(k[4] == 1 for k in mixed_rows if k[:2] == (1, text)) and all(k[1] for k in mixed_rows)


def test_the_mix_serves_whole_documents(spark):
    r = np.random.default_rng(3)
    sizes = {"long": [60_000, 70, 90, 110], "small": [500, 800], **{f"s{k:02}": r.integers(60, 900, 7).tolist() for k in range(8)}, None: [40]}
    rows = [(100 * k + i, " ".join(f"w{k}x{i}x{j}" for j in range(n)), "en", s, 0) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = {x[0]: x[1] for x in rows}
    served = collections.Counter(x["doc_id"] for x in pipeline.source_mix(spark, docs, SMALL).collect() if x["text"] == before[x["doc_id"]])
    assert served.total() == pipeline.source_mix(spark, docs, SMALL).count() and max(served.values()) <= 3
    parts = mixed(docs).groupBy("source").agg(F.first("target").alias("target")).collect()
    for x in parts:
        own = {i: len(t.split()) for i, t, _, s, _ in rows if s == x["source"]}
        words = sum(n * served[i] for i, n in own.items())
        assert abs(words - x["target"]) <= max(own.values()) / 2 + 2 * PACKET
    assert all(x["taken"] % max(1, x["size"]) == 0 for x in mixed(docs, whole=True).collect())
