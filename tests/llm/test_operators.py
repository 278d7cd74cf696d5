"""Each operator against a plain model of its contract, on a small table and on odd rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import same
from trellis.llm import jaccard, lm, mixing, packing, pii, quality_model, rules, secret_scan, substrings, topk
from trellis.llm.catalog import QUERIES, SQL
from trellis.llm.common import staged
from trellis.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, size int, words string, home long, kept boolean"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, LONG, "xx", "b"), (5, "the cat sat on the mat " * 30, "en", "b"), (6, "the cat sat on the mat " * 30, "en", "b"), (6, "the cat sat on the mat " * 30, "en", "b"), (7, "one", None, None), (8, "don't  stop\n me", "de", "c"), (None, "some words of no id", "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, True) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SMALL).collect()}


OPERATORS = {
    "secrets": secret_scan.scan_secrets, "redacted": secret_scan.redacted, "pieces": packing.packed_documents, "jaccard": jaccard.similar_components, "mix": mixing.mixed, "lm": lm.scored,
    "pii": pii.find_pii, "repeats": substrings.without_repeats, "rules": rules.quality_rules, "quality": lambda d: quality_model.quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


def by_text(rows, *columns):
    """What the rows of the odd table got, by doc_id; rows of one doc_id are equal there."""
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}


def words_of(text):
    return WORD.findall(text or "")


def removed_by_hand():
    seen, out = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in ODD}, key=lambda x: (x[0] is None, x[0] or 0)):
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if tuple(w[j : j + 20]) in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(tuple(w[j : j + 20]))
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


EXPECTED = {
    "secrets": lambda got: by_text(got, "found") == {r[0]: ([],) for r in ODD},
    "pii": lambda got: by_text(got, "found") == {r[0]: ([],) for r in ODD},
    "redacted": lambda got: by_text(got, "text", "lang", "home", "kept") == {r[0]: (r[1], r[2], 2, True) for r in ODD},
    "pieces": lambda got: {r["doc_id"]: r["length"] for r in got if r["doc_id"] in (1, 2)} == {1: 1, 2: 1} and sum(r["doc_id"] == 6 and r["piece"] == 0 for r in got) == 2 and max(r["offset"] + r["length"] for r in got) <= 1024,
    "jaccard": lambda got: by_text(got, "component_id") == {r[0]: (5 if r[0] == 6 else r[0],) for r in ODD} and by_text(got, "n_shingles")[5] == (6,) and by_text(got, "n_shingles")[2] == (0,) and by_text(got, "n_shingles")[7] == (1,),
    "mix": lambda got: by_text(got, "size") == {r[0]: (len(words_of(r[1])),) for r in ODD} and all(0 <= r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) == sum(r["size"] for r in got),
    "lm": lambda got: by_text(got, "n_tokens") == {r[0]: (len(words_of(r[1])) + 1,) for r in ODD} and len({round(r["score"], 9) for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got),
    "repeats": lambda got: by_text(got, "n_words", "n_removed", "text") == removed_by_hand(),
    "rules": lambda got: by_text(got, "n_words", "base_failed") == {r[0]: (len(words_of(r[1])), r[0] != 4) for r in ODD} and not any(r["kept"] and r["base_failed"] for r in got),
    "quality": lambda got: all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(spark, odd, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) == len(ODD) if name != "pieces" else {r["doc_id"] for r in got} == {r[0] for r in ODD}
    assert EXPECTED[name](got)
    assert OPERATORS[name](odd.limit(0)).collect() == []


def base_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secrets(spark, texts):
    kinds = ["assign", "access", "hex"]
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = run(spark, "op1_secret_scan")
    for i, t in texts.items():
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
        count = collections.Counter(s[0] for s in spans)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"]) == (count["assign"], count["access"], count["hex"], base_digest(spans))
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(filter(None, got[i]["spans"].split(",")))


def test_constants_reach_sensitive_names():
    text = 'DB = "hunter2hunter2x9"\nother = "plain words"\nadmin_pwd = DB\n<private_key>zz99yy88xx77ww66</private_key>\nkey: value'
    assert [text[a:b] for _, a, b, _ in secret_scan.literal_spans(text)] == ["hunter2hunter2x9", "zz99yy88xx77ww66"]


def test_every_part_of_a_secret_has_a_span(spark):
    parts = [f"q7Zk{i:02}Xw" for i in range(20)]
    quoted = [f'"{p}"' for p in parts]
    for text in ("api_key = " + " + ".join(quoted), "A = " + " + ".join(quoted[:10]) + "\nB = " + " + ".join(quoted[10:]) + "\napi_key = A + B"):
        assert sorted(text[a:b] for _, a, b, _ in secret_scan.literal_spans(text)) == parts
        masked = secret_scan.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
        assert not any(p in masked for p in parts)
    doubling = 'K0 = "hunter2hunter2x9"\n' + "".join(f"K{i + 1} = K{i} + K{i}\n" for i in range(3000)) + "password = K3000"
    assert [doubling[a:b] for _, a, b, _ in secret_scan.literal_spans(doubling)] == ["hunter2hunter2x9"]
    growing = 'token = "a1"\n' + "".join(f'token = token + "b{i}c"\n' for i in range(3000))
    assert len(secret_scan.literal_spans(growing)) == 3001


def test_a_run_of_digits_ends_with_its_text(spark):
    texts = ["the whole tale", "0123456789abcdef0123456789abcdef", "abc", "def0123456789abcdef0123", "01234567890123456789012", "3a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in secret_scan.scan_secrets(df).collect()}
    assert got == {i: [("hex", 0, 32)] if i == 1 else [] for i in range(6)}
    assert [r["text"] for r in secret_scan.redacted(df).orderBy("doc_id").collect()] == [texts[0], "[secret]", *texts[2:]]


def test_long_chains_are_decoded_like_short_ones():
    field = pii.train(pii.labelled_table())
    words = [f"{i % 10}{i % 7}" for i in range(20_000)]
    chains = [field.rows(words, 0, len(words)), *(field.rows(words, i, i + 1 + i % 5) for i in range(300))]
    together = field.decode(chains)
    assert together[0] == field.decode(chains[:1])[0] and len(together[0]) == 20_000
    assert together[1:] == [field.decode([c])[0] for c in chains[1:]]


def test_pii(spark, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    got = run(spark, "op8_pii")
    for i, t in texts.items():
        spans = sorted(((k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if fits(k, m[0])), key=lambda s: (s[1], list(patterns).index(s[0])))
        assert got[i]["base_sha256"] == base_digest(spans)
    tricky = "a@b.c_d@e.fg x@y 1.2.3.4.5 " + "9" * 40 + "@q.r"
    assert [s[:3] for s in pii.emails(tricky)] == [("email", m.start(), m.end()) for m in re.finditer(patterns["email"], tricky)]


def test_the_field_labels_unseen_rows():
    field, right, n = pii.train(pii.labelled_table()), 0, 0
    for words, tags in pii.labelled_table(150, seed=77):
        for a, b in pii.runs(words):
            right += [pii.LABELS[k] for k in field.decode([field.rows(words, a, b)])[0]] == tags[a:b]
            n += 1
    assert right >= 0.97 * n


def test_packing_is_an_exact_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op2_sequence_packing"](spark, SMALL).collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["length"] == 1024 for r in own[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> bye", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  c ", "<|endoftext", " x\n\n y\u00a0z \u3000 don't  12345 .,", "caf\u00e9 \U0001f600 \u4e2d\u6587 a.b, c. d", "", " ", "x" * 3000]
    rows = packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), seq_len=4096).collect()
    for r in rows:
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r["doc_id"]]
    assert len(rows) == len(texts)


def test_plans_place_every_piece():
    r = np.random.default_rng(1)
    for lengths in (r.integers(1, 65, 3000), np.full(100, 33), r.integers(1, 9, 50), np.array([], int)):
        histogram = np.bincount(lengths, minlength=65)[:65]
        plan, got = packing.packing_plan(histogram, 64), np.zeros(65, np.int64)
        for shape, count in zip(plan.shapes, plan.counts, strict=True):
            assert sum(shape) <= 64
            for x in shape:
                got[x] += count
        assert (got == histogram).all()


def test_jaccard_components(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                home[b] = a
    got = run(spark, "op4_ngram_jaccard")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}


def test_near_copies_of_one_text(spark):
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(words[: i % 7] + [f"e{i}"] + words[i % 7 :])) for i in range(120)] + [(200, "quite another text of some words")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(120)} | {200: 200}


def test_rows_of_one_id_are_linked_each_with_its_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (9, c + " more"), (9, d), (9, None), (10, d), (None, a), (11, ""), (11, "")]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 37, 1), (5, 37, 1), (5, 37, 1), (7, 37, 1), (8, 37, 8), (9, 38, 8), (9, 37, 8), (9, 0, 9), (10, 37, 8), (None, None, None), (11, 0, 11), (11, 0, 11)])


def test_sketches_lose_no_link(spark):
    r = np.random.default_rng(7)
    base, sets = r.integers(0, 1 << 63, 3000).astype(np.uint64), []
    for n in (3, 20, 63, 64, 65, 125, 128, 131, 500, 512, 530, 1024, 1040, 2300):
        for share in (0.0, 0.02, 0.07, 0.1, 0.3, 1.0):
            new = int(n * share)
            sets.append(set(base[: n - new].tolist()) | set(r.integers(0, 1 << 63, new).tolist()))
    rows = [((i, i), len(x), jaccard.sketch(np.array(sorted(x), np.uint64)).tolist()) for i, x in enumerate(sets)]
    known = spark.createDataFrame(rows, "rep struct<doc_id: long, th: long>, n int, bits array<long>")
    pairs = known.select(F.col("rep").alias("x")).crossJoin(known.select(F.col("rep").alias("y"))).where("x.doc_id < y.doc_id")
    kept = {(r["x"]["doc_id"], r["y"]["doc_id"]) for r in jaccard._likely(pairs, known, 85).collect()}
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    linked = {(i, j) for i, j in every if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    far = {(i, j) for i, j in every if 100 * len(sets[i] & sets[j]) < 50 * len(sets[i] | sets[j]) and len(sets[i]) > 60}
    assert any(jaccard.sketch(np.array(sorted(sets[i]), np.uint64)).size != jaccard.sketch(np.array(sorted(sets[j]), np.uint64)).size for i, j in linked)
    assert linked <= kept and not far & kept


def test_texts_of_unlike_documents_are_not_compared(spark, monkeypatch):
    asked, whole = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: asked.append(pairs.count()) or whole(pairs, *a))
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"b{b}w{j}" for b in r.choice(30, 3, replace=False) for j in range(40))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " one more") for i in range(0, 150, 10)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == got[i] for i in range(0, 150, 10)) and len(set(got.values())) > 140
    assert 0 < sum(asked) <= 40


def test_staged_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = shuffled()
    held = staged(spark.range(5000, numPartitions=4).withColumn("k", F.col("id") % 700).groupBy("k").agg(F.max("id").alias("m")).orderBy("k"), "sums")
    ends = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < ends:
        time.sleep(0.2)
    assert not shuffled() - before and held.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_of_large_stars(spark, monkeypatch):
    from trellis.llm import components as c

    monkeypatch.setattr(c, "MANY", 1)
    monkeypatch.setattr(c, "STAR_LINKS", 8)
    links = [(i, 0) for i in range(1, 60)] + [(i, 59) for i in range(60, 90)] + [(200, 201)]
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(90)} | {200: 200, 201: 200}


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_mixing(spark, texts):
    rows = QUERIES["op5_source_mix"](spark, SMALL).collect()
    again = QUERIES["op5_source_mix"](spark, SMALL).collect()
    assert sorted(rows) == sorted(again)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["target"], r["source_size"]].append(r)
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 20
    sources = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id")["source"]
    size = collections.Counter()
    for r in rows:
        size[sources[r["doc_id"]]] += r["size"]
    names = sorted(size)
    weight, goal, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, float(sum(size.values()))
    while True:
        free = [s for s in names if s not in goal]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            goal[s] = 3.0 * size[s]
            left -= goal[s]
    goal |= share
    taken = collections.Counter()
    for r in rows:
        assert math.isclose(r["target"], goal[sources[r["doc_id"]]], rel_tol=1e-9)
        taken[sources[r["doc_id"]]] += r["taken"]
    # the order of all sources is cut once, so that a source ends within about a packet of its target
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.PACKET for s in names) and sum(taken.values()) == sum(size.values())


def test_the_mix_is_one_order_of_all_sources(spark):
    """Against a sorted list: two sources interleave, and the cut falls inside a copy of one of them."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "ab"[i % 2]) for i in range(120)] + [(200 + i, None, "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(len((t or "").split()) for _, t, _ in rows)
    for budget in (total // 3, total - 7, 2 * total + 5, 10 * total):
        got = {r["doc_id"]: r for r in mixing.mixed(docs, max_epochs=3, budget=budget).collect()}
        again = {r["doc_id"]: r for r in mixing.mixed(docs, max_epochs=3, budget=budget).collect()}
        assert got == again
        # where each copy ends in its source's queue follows from the first one's finish; the order is of all of them
        ends = {}
        for source in "ab":
            own = [r for r in got.values() if r["source"] == source and r["size"]]
            served = sorted((c["finish"], c["epoch"], r["doc_id"], c["words"]) for r in own for c in r["copies"])
            assert all(abs(f * own[0]["target"] - sum(x[3] for x in served[: k + 1])) < 1e-6 for k, (f, *_, w) in enumerate(served) if w == got[served[k][2]]["size"])
            ends[source] = served
        copies = sorted((f, source, e, i, w) for source, of in ends.items() for f, e, i, w in of)
        cut = [c for c in copies if c[4] < got[c[3]]["size"]]
        assert sum(c[4] for c in copies) == min(budget, 3 * total) and len(cut) <= 1 and (not cut or cut[0] == copies[-1])
        if budget < 3 * total:
            # the next copy of either source would have finished after the last one served
            for source, of in ends.items():
                whole = [c for c in of if c[3] == got[c[2]]["size"]]
                assert not whole or whole[-1][0] <= copies[-1][0]
        kept = mixing.mixed(docs, max_epochs=3, budget=budget, whole=True).collect()
        assert all(c["words"] == r["size"] for r in kept for c in r["copies"])
        words = sum(r["taken"] for r in kept)
        assert abs(words - min(budget, 3 * total)) * 2 <= max(r["size"] for r in kept)


def test_packets_of_long_documents_against_a_sorted_list(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(1, 900)), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(len(t.split()) for _, t, _ in rows)
    rows = {r["doc_id"]: r for r in mixing.mixed(docs, max_epochs=2, budget=10 * total).collect()}
    for budget in (total // 2, total + 1):
        got = {r["doc_id"]: r for r in mixing.mixed(docs, max_epochs=2, budget=budget).collect()}
        # each copy's end in its queue, at the targets of this budget
        end = {(i, c["epoch"]): c["finish"] * r["target"] for i, r in rows.items() for c in r["copies"]}
        packets = []
        for (i, e), to in end.items():
            size, start = rows[i]["size"], to - rows[i]["size"]
            for p in range(-(-size // mixing.PACKET)):
                upto = min(size, (p + 1) * mixing.PACKET)
                packets.append(((start + upto) / got[i]["target"], rows[i]["source"], e, i, upto - p * mixing.PACKET))
        taken, left = collections.Counter(), budget
        for _, _, _, i, w in sorted(packets):
            taken[i] += min(w, left)
            left -= min(w, left)
        assert {i: r["taken"] for i, r in got.items()} == {i: taken[i] for i in got}


def test_a_large_range_is_cut_again(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = sorted(mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    monkeypatch.setattr(mixing, "MAX_RANGES", 4)
    assert sorted(mixing.mixed(docs).collect()) == before


def test_spans_of_a_long_text_are_told_apart_in_time():
    rng = np.random.default_rng(5)
    base = [("email", int(a), int(a) + 5, 1.0) for a in np.sort(rng.choice(2_000_000, 100_000, replace=False))]
    spans = [("name", int(a), int(a) + 4, 0.9) for a in np.sort(rng.choice(2_000_000, 100_000, replace=False))]
    began = time.time()
    got = pii.apart(spans, base)
    assert time.time() - began < 5
    taken = np.zeros(2_000_010, bool)
    for _, a, b, _ in base:
        taken[a:b] = True
    assert got == [s for s in spans if not taken[s[1] : s[2]].any()]


def test_lm(spark, texts):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = run(spark, "op6_lm_scoring")
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(base, got[i]["base_score"], rel_tol=1e-9)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_seldom_words_have_classes_of_their_own(spark):
    learned, held = (iter([i for i in range(9000) if (zlib.crc32(str(i).encode()) % 5 == 1) == out]) for out in (False, True))
    rows = [(next(learned), f"{a} {x}{i}zz {b}") for a, x, b in (("alpha", "x", "gamma"), ("beta", "y", "delta")) for i in range(300) for _ in range(2)]
    rows += [(next(learned), text) for text in ("alpha often gamma", "beta usual delta") for _ in range(60)]
    own, other, new = ([(next(held), f"alpha {x}{i}zz gamma") for i in range(30)] for x in ("x", "y", "z"))
    got = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(rows + own + other + new, "doc_id long, text string")).collect()}
    assert all(got[i]["n_known"] == 4 for i, _ in own + other) and len({round(got[i]["base_score"], 9) for i, _ in own + other}) == 1
    assert min(got[i]["score"] for i, _ in own) > max(got[i]["score"] for i, _ in other) + 1
    assert all(got[i]["n_known"] == 3 and math.isfinite(got[i]["score"]) for i, _ in new)


def test_classes_of_seldom_words_are_the_likeliest(monkeypatch):
    monkeypatch.setattr(lm, "SELDOM_WORDS", 7)
    r, k = np.random.default_rng(3), lm.CLASSES + 1
    g = r.integers(0, 9000, (k, k)).astype(float)
    at, before, after = r.integers(0, 400, 900) * 3, r.integers(0, k, 900).astype(np.uint8), r.integers(0, k, 900).astype(np.uint8)
    words, own = lm.seldom_classes(at, before, after, lm.pulls(g))
    p = np.log(g + lm.ADDED_CLASS)
    into, out = np.log((g + lm.ADDED_CLASS).sum(0)), np.log((g + lm.ADDED_CLASS).sum(1))
    for w, c in zip(words, own, strict=True):
        gain = [sum(p[a, x] - into[x] + p[x, b] - out[x] for a, b in zip(before[at == w], after[at == w], strict=True)) for x in range(1, k)]
        assert math.isclose(gain[c - 1], max(gain), rel_tol=1e-9)
    assert set(words) == set(at)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_its_sql(spark, name):
    same(QUERIES[name](spark, SMALL), SQL[name], SMALL)


def test_topk_in_rounds_and_beside_columns_that_clash(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-300, 300, 6).astype(float).tolist() if i % 9 else [1.0] * 6, "x", i, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, id long, score int")
    want = []
    for q, a, *_ in rows[::20]:
        found = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b, *_ in rows if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    for bins in (16, 1 << 16):
        monkeypatch.setattr(topk, "BINS", bins)
        assert sorted(tuple(x) for x in topk.exact_topk(df, "vec_id", "embedding", 7, 20, 1.0).collect()) == want


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (None, [1.0, 2.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_topk(df, "vec_id", "embedding", 3, 20, 64.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 20480), (0, 2, 2, 20480), (0, 3, 20, 20480), (20, 1, 0, 20480), (20, 2, 1, 20480), (20, 3, 2, 20480)]
    assert topk.exact_topk(df.limit(0), "vec_id", "embedding", 3, 20, 64.0).collect() == []


def test_quality_on_held_out_rows(spark):
    got = run(spark, "op3_quality_model")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def test_repeated_windows(spark, texts):
    first, got = set(), run(spark, "op9_substring_dedup")
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if tuple(w[j : j + 20]) in first:
                gone[j : j + 20] = [True] * 20
            first.add(tuple(w[j : j + 20]))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_subtrees_part_where_their_suffixes_do():
    r = np.random.default_rng(2)
    h = r.integers(0, 3, 600).astype(np.uint64)
    for window in (20, 7, 3):
        at = np.arange(len(h) - window + 1)
        s = np.zeros(len(at), substrings.SUFFIX)
        s["path"], s["doc"], s["at"] = substrings.paths(h, at, window), 1, at
        order, depth = substrings.subtree(s, window)
        cuts = substrings.depths(window)
        for x, y, d in zip(order[:-1], order[1:], depth[1:]):
            common = next((k for k in range(window) if h[x + k] != h[y + k]), window)
            assert d == max(c for c in cuts if c <= common)
        first = {tuple(h[i : i + window]): i for i in at[::-1]}
        order, _, again = substrings.leaves(s, window)
        assert sorted(order[again].tolist()) == [i for i in at if first[tuple(h[i : i + window])] != i]


def test_spans_of_what_goes(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join(["a", *w[5:40], "b"])), (3, " ".join(w[:19])), (None, " ".join(w))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60, 0, []), 2: (37, 35, [(1, 36)]), 3: (19, 0, []), None: (60, 60, [(0, 60)])}


def test_verdicts_can_be_filtered(spark):
    rows = rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"))
    kept = {r["doc_id"] for r in rows.where("kept").collect()}
    assert kept and kept == {r["doc_id"] for r in rows.collect() if r["kept"]}


def test_distances(spark):
    p = spark.range(1).select(rules._distance(F.array(F.lit(3), F.lit(1), F.lit(0)), F.lit(4), [0.5, 0.0, 0.5]).alias("d")).first()["d"]
    half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    a, b = [0.75, 0.25, 0.0], [0.5, 0.0, 0.5]
    assert math.isclose(p, math.sqrt((half(a, b) + half(b, a)) / 2))


def test_rules(spark, texts):
    got = run(spark, "op10_quality_rules")
    for i, t in texts.items():
        w = WORD.findall(t)
        count = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j + k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
