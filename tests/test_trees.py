"""Paths by doubling and trees of digests: long chains, cycles, and equal subtrees that are never opened."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trellis.operators import nodes as trees
from trellis.operators.digests import differences, digested, kept_tree

NODE = "file_id string, parent_id string, name string"
ENTRY = "rel_path string, is_dir boolean, md5 string"


def test_a_chain_of_five_thousand_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5_000, []
    stage = trees.staged
    monkeypatch.setattr(trees, "staged", lambda df, name: rounds.append(name) or stage(df, name))
    chain = spark.createDataFrame([(f"f{i}", f"f{i - 1}" if i else "root", "a") for i in range(n)], NODE)
    got = {r["file_id"]: (r["n"], r["depth"]) for r in trees.tree_paths(chain, "root").select("file_id", F.length("rel_path").alias("n"), "depth").collect()}
    assert got == {f"f{i}": (2 * i + 1, i + 1) for i in range(n)} and rounds.count("round") <= 15
    with pytest.raises(ValueError, match="more than 100 deep"):
        trees.tree_paths(chain, "root", most=100)


def test_cycles_strays_and_odd_nodes_are_left_out(spark):
    rows = [("a", "root", "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "a", "D"), ("x", "y", "X"), ("y", "z", "Y"), ("z", "x", "Z"), ("w", "x", "W"), ("s", "gone", "S"), ("t", "s", "T"), ("self", "self", "me"), ("null", None, "n"), ("root", "c", "again")]
    got = {tuple(r) for r in trees.tree_paths(spark.createDataFrame(rows, NODE), "root").collect()}
    assert got == {("a", "A", 1), ("b", "A/B", 2), ("c", "A/B/C", 3), ("d", "A/D", 2)}
    assert {r[0] for r in trees.pruned(spark.createDataFrame(rows, NODE), "root").collect()} == {"x", "y", "z", "w", "s", "t", "self", "null"}
    assert trees.tree_paths(spark.createDataFrame([], NODE), "root").collect() == []
    assert {tuple(r) for r in trees.tree_paths(spark.createDataFrame(rows, NODE), "a").collect()} == {("b", "B", 1), ("c", "B/C", 2), ("d", "D", 1), ("root", "B/C/again", 3)}


def test_random_forests_against_a_walk(spark):
    rng = random.Random(11)
    for _ in range(3):
        n = 120
        rows = [(f"f{i}", rng.choice(["root", *[f"f{rng.randrange(n)}" for _ in range(4)]]), f"n{i}") for i in range(n)]
        expected, level = set(), [(i, name, 1) for i, p, name in rows if p == "root"]
        while level:
            expected |= set(level)
            level = [(i, f"{path}/{name}", depth + 1) for up, path, depth in level for i, p, name in rows if p == up]
        assert {tuple(r) for r in trees.tree_paths(spark.createDataFrame(rows, NODE), "root").collect()} == expected


def tree_of(seed, n=300):
    rng, out = random.Random(seed), {}
    for i in range(n):
        parts = [f"d{rng.randrange(4)}" for _ in range(rng.randrange(5))]
        for k in range(1, len(parts) + 1):
            out["/".join(parts[:k])] = (True, "")
        out["/".join([*parts, f"f{i % 90}"])] = (False, f"c{rng.randrange(30)}")
    return out


def by_hand(a, b):
    out = set()
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    both = {p for p in a if p in b and a[p][0] and b[p][0]} | {""}
    for p in a.keys() | b.keys():
        if up(p) in both and a.get(p) != b.get(p):
            out.add((p, "only_a" if p not in b else "only_b" if p not in a else "kind" if a[p][0] != b[p][0] else "changed"))
    return out


def test_digest_trees_find_what_differs(spark):
    rng = random.Random(4)
    for seed in range(3):
        a = tree_of(seed)
        b = dict(a)
        for p in rng.sample(sorted(b), 12):
            kind = rng.randrange(4)
            below = [q for q in b if q == p or q.startswith(p + "/")]
            if kind == 0:
                for q in below:
                    del b[q]
            elif p in b and not b[p][0]:
                b[p] = (False, "new") if kind == 1 else (True, "")
        b["new/deep/file"], b["new"], b["new/deep"] = (False, "x"), (True, ""), (True, "")
        sides = [kept_tree(spark.createDataFrame([(p, *v) for p, v in t.items()], ENTRY), F.col("md5"), buckets=8) for t in (a, b)]
        assert {tuple(r) for r in differences(*sides).collect()} == by_hand(a, b)
        assert differences(sides[0], sides[0]).collect() == []


def test_directories_count_what_lies_beneath(spark):
    rows = [("a", True, ""), ("a/b", True, ""), ("a/b/x", False, "1"), ("a/y", False, "2"), ("z", False, "3"), ("e", True, "")]
    got = {r["rel_path"]: r["entries"] for r in digested(spark.createDataFrame(rows, ENTRY), F.col("md5")).where("is_dir").collect()}
    assert got == {"": 6, "a": 3, "a/b": 1, "e": 0}


def test_equal_subtrees_are_never_opened(spark, tmp_path):
    a = {f"d{i}": (True, "") for i in range(30)} | {f"d{i}/f{j}": (False, f"{j}") for i in range(30) for j in range(20)}
    b = dict(a) | {"d3/f7": (False, "other")}
    sides = []
    for name, t in (("a", a), ("b", b)):
        frame = spark.createDataFrame([(p, *v) for p, v in t.items()], ENTRY)
        sides.append(kept_tree(frame, F.col("md5"), buckets=64, path=f"file://{tmp_path}/{name}"))
        needed = {r[0] for r in spark.createDataFrame([("",), ("d3",)], "p string").select(F.pmod(F.xxhash64("p"), F.lit(64))).collect()}
        kept = [p for p in Path(tmp_path / name).iterdir() if p.is_dir() and int(p.name.split("=")[1]) not in needed]
        assert len(kept) >= 5
        for p in kept:
            shutil.rmtree(p)
    assert [tuple(r) for r in differences(*sides).collect()] == [("d3/f7", "changed")]
