"""Fill-in-middle against a plain model: odd texts, the delimiter and its escape in a text, and markers that can't be told apart."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import same
from trellis.llm.catalog import QUERIES, SQL
from trellis.llm.infilling import DELIMITER, ESCAPE, infilled, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACES = " \t\n\v\f\r"
TEXTS = [
    None, "", " ", SPACES, "one", " one", "one ", "a b", "a  b \n c\t", f"a{DELIMITER}b {DELIMITER} {DELIMITER}{DELIMITER}", f"{ESCAPE}0 {ESCAPE}1{ESCAPE} {ESCAPE}{DELIMITER}1 x", "$0 \\$1 (a) [b] . * +",
    "<P> a b", "a <S> b", "a<M>", "< P> <S <M", "<p> <s> <m>", " a b \U0001f600́ \x85c d", "null \x00 byte", "0 1 0 1", "word " * 30_000, " " * 50_000, "x" * 100_000, "a b", "a b",
]


def by_hand(doc_id, text, seed="42", percent=50, spm_percent=80):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= percent:
        return (n, "plain", None, None, text)
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if d[3] % 100 < spm_percent:
        return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("spm_percent", [0, 100])
def test_odd_texts_are_cut_as_by_hand(spark, spm_percent):
    rows = [(None if i % 40 == 39 else i, text, "x", True) for i, text in enumerate(TEXTS * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, prefix boolean")
    got = infilled(docs, percent=90, spm_percent=spm_percent).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    expected = sorted((str(i), t or "", *by_hand(i, t, percent=90, spm_percent=spm_percent)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["text"], r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in got) == expected
    assert all(r["again"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "spm" if spm_percent else "psm"}
    assert infilled(docs.limit(0)).collect() == []


def test_other_seeds_cut_elsewhere(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(200)], "doc_id int, text string")
    got = {s: {r["doc_id"]: (r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in infilled(docs, seed=s).collect()} for s in ("42", "7")}
    assert got["42"] != got["7"]
    assert got["7"] == {i: by_hand(i, "one two three four five six seven", seed="7") for i in range(200)}


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("<a>", "<a>x", "m"), ("aXa", "b", "c"), ("", "b", "c")])
def test_markers_must_be_told_apart(spark, markers):
    with pytest.raises(ValueError):
        infilled(spark.createDataFrame([(1, "a")], "doc_id long, text string"), markers=markers)


def test_the_query_matches_its_sql(spark):
    same(QUERIES["op13_fill_in_middle"](spark, SMALL), SQL["op13_fill_in_middle"], SMALL)
