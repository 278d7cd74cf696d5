"""Licence scans: base places against a plain search, statistics against every run of every notice, chains by example."""

import random
import re
import time

import numpy as np
import pytest

from tests.conftest import SMALL
from trellis.llm.catalog import QUERIES
from trellis.llm.licences import GAP, LEAST_SHARE, NOTICES, PHRASES, Automaton, Scanner, licences, scanned_texts, words_of
from trellis.llm.common import Texts

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
NOTICE = dict(NOTICES[::-1])
MIT = next(text for label, text in NOTICES if text.startswith("Permission is hereby"))
ODD = [
    None, "", " .,- ", "one", "CC BY", "cc-by", "ccby", "cc by cc by cc by", "cc cc by by", "All rights\nreserved. ALL RIGHTS RESERVED!", "all rights reserved all rights", "general public", "General\x00Public\x7fLicense",
    "gnu general public license general public license", "école cc by ÉCOLE cc by", "Keep cc by", "rights all reserved", "cc by " * 20_000, "the software " * 50_000, MIT, MIT + " " + MIT,
]


def base_by_hand(text):
    words = TOKEN.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def of(text, **options):
    data = np.frombuffer(text.encode(), np.uint8)
    _, found = scanned_texts(Scanner(NOTICES, PHRASES), Texts(data, np.array([0, len(data)])), GAP, LEAST_SHARE)
    return found[0]


def test_the_automaton_against_every_run():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        runs = {}
        for n, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    runs.setdefault(tuple(s[i:j]), set()).add((n, j - 1))
        automaton = Automaton(sequences)
        text = [rng.randrange(5) for _ in range(60)]
        for i, (length, state) in enumerate(automaton.statistics(text)):
            assert length == max(k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs)
            if length:
                assert sorted(automaton.ends[state]) == sorted(runs[tuple(text[i + 1 - length : i + 1])])


def test_odd_texts(spark):
    docs = spark.createDataFrame([(None if i == 4 else i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id int, text string, n_words string, found int").coalesce(1)
    got = sorted(licences(docs).collect(), key=lambda r: 4 if r["doc_id"] is None else r["doc_id"])
    for r, text in zip(got, ODD, strict=True):
        starts = sorted((s["first"], s["label"]) for s in r["found"] if s["notice"] < 0)
        n, places, first, last, labels = base_by_hand(text)
        assert (r["n_words"], len(starts)) == (n, places)
        assert (starts[0][0], starts[-1][0]) == (first, last) if starts else first is None
        assert ",".join(sorted({label for _, label in starts})) == labels
    assert licences(docs.limit(0)).collect() == []


def test_texts_side_by_side_share_no_phrase(spark):
    docs = spark.createDataFrame([(1, "all rights"), (2, "reserved cc"), (3, "by the terms"), (4, "general public"), (5, "license")], "doc_id long, text string").coalesce(1)
    assert all(r["found"] == [] for r in licences(docs).collect())


def test_random_words_of_notices_against_a_plain_search(spark):
    rng = random.Random(5)
    words = [*{w for _, t in NOTICES for w in words_of(t)}, "cc", "by", "general", "public", "license", "all", "rights", "reserved", "unknown"]
    phrases = [*PHRASES, "cc", "all rights", "public license"]
    texts = ["-".join(rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licences(docs).collect():
        starts = sorted(s["first"] for s in r["found"] if s["notice"] < 0)
        assert (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None)) == base_by_hand(texts[r["doc_id"]])[:4]


@pytest.mark.parametrize(("label", "text"), NOTICES)
def test_a_notice_is_found_whole_and_with_words_changed(label, text):
    words = words_of(text)
    assert (label, 10, 10 + len(words) - 1, 1.0) in [(f["label"], f["first"], f["last"], f["share"]) for f in of("some other words stand here before it really begins and\n" + " ".join(words) + "\nnothing more")]
    if len(words) >= 20:
        changed = [w for i, w in enumerate(words) if i != len(words) // 2]
        changed[len(words) // 4] = "acme"
        assert label in {f["label"] for f in of(" ".join(changed))}
        assert label not in {f["label"] for f in of(" ".join(words[: len(words) // 3])) if f["words"] > 8}


def test_notices_that_share_wording_are_told_apart():
    for kind in ("cc-by-nc", "cc-by-sa"):
        for text in (t for label, t in NOTICES if label == kind):
            assert {f["label"] for f in of(text) if f["notice"] >= 0} == {kind}
    assert {f["label"] for f in of("Licensed under the GNU Lesser General Public License") if f["notice"] >= 0} == {"lgpl"}


def test_lines_of_the_documents():
    labels = lambda text: {f["label"] for f in of(text)}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc"}
    assert labels("the permission of the owner and the software that is subject to the rules of the house") == set()


def test_work_is_linear_in_fragments():
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        of("of the software and to permit " * n)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2


def test_the_query_against_a_plain_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op11_licence_scan"](spark, SMALL).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_hand(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert r["labels"].split(",") == sorted(set(r["labels"].split(","))) and (r["score"] == 1) >= (r["n_base"] > 0)
