"""Quality rules by distribution divergence, in DataFrame expressions only.

Each document's histogram of character classes and of common words is compared, by Jensen-Shannon distance (base 2, so 0
to 1), with references of the languages. The references are the same histograms summed over all documents of a language;
a document is measured against the nearest one, so that its own language label is never trusted. Distances of texts
under the minimum lengths say little and reject nothing; words are compared only with languages whose common words are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import SPACE, documents, pick, staged

# Frequent function words of each language, by its code.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "im", "nicht"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "que"],
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Removed one after another; what is left counts as other.
CLASSES = {
    "lower": r"\p{Ll}+",
    "space": SPACE,
    "upper": r"\p{Lu}+",
    "mark": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>]+",
    "digit": r"[0-9]+",
}

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Minimum lengths for the distances to count.
MIN_CHARS, MIN_COMPARED_WORDS = 200, 50
#: A text fails beyond the first distance of its characters, or beyond both of the others, of its characters and its
#: words. The words of a text without any common word are 0.29 away from prose in which every third word is common.
MAX_CHAR_DISTANCE, CHAR_DISTANCE_WITH_WORDS, MAX_WORD_DISTANCE = 0.30, 0.125, 0.27
#: The share of all characters that the documents of a language must have to make a reference: at most 1,000 references.
REFERENCE_SHARE = 0.001


def _classes(df: DataFrame) -> DataFrame:
    """Adds n_<class> for each class and n_other."""
    df = df.withColumn("_rest", F.col("text")).withColumn("_left", F.length("text"))
    for name, pattern in CLASSES.items():
        df = df.withColumn("_rest", F.regexp_replace("_rest", pattern, ""))
        df = df.withColumn(f"n_{name}", F.col("_left") - F.length("_rest")).withColumn("_left", F.length("_rest"))
    return df.withColumnRenamed("_left", "n_other").drop("_rest")


def _class_counts() -> list[str]:
    return [*(f"n_{c}" for c in CLASSES), "n_other"]


def references(counts: DataFrame) -> dict[str, tuple[list[float], list[float] | None]]:
    """Shares of character classes, and of common words and all others, summed over the documents of each language.

    counts is what counted() gives. Labels with at least REFERENCE_SHARE of all characters make a reference, so that their
    number is bounded; word shares are known of those in COMMON_WORDS. Where no label has that much, all documents make
    one reference.
    """
    sums = [F.sum(c).alias(c) for c in _class_counts()] + [F.sum(F.col("bins")[i]).alias(f"bin_{i}") for i in range(len(BINS) + 1)]
    by_lang = counts.groupBy("lang").agg(*sums).withColumn("chars", sum((F.col(c) for c in _class_counts()), F.lit(0)))
    total = counts.agg(F.sum("n_chars")).first()[0] or 0
    found = [r for r in by_lang.where(F.col("chars") > 0).where(F.col("chars") >= REFERENCE_SHARE * total).collect()]
    found = [r for r in found if r["lang"] is not None] or counts.agg(*sums).withColumn("lang", F.lit("")).withColumn("chars", sum((F.col(c) for c in _class_counts()), F.lit(0))).where("chars > 0").collect()
    out: dict[str, tuple[list[float], list[float] | None]] = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        words = [float(r[f"bin_{i}"]) for i in range(len(BINS) + 1)]
        listed = sum(words) and (r["lang"] in COMMON_WORDS or r["lang"] == "")
        out[r["lang"]] = ([float(r[c]) / r["chars"] for c in _class_counts()], [x / sum(words) for x in words] if listed else None)
    return out


def _distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance of counts / total from a reference; 0 where total is 0."""

    def part(n: Column, q: Column) -> Column:
        p = n / F.nullif(total, F.lit(0))
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    both = F.zip_with(counts, F.array(*[F.lit(x) for x in reference]), part)
    half = F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(half, F.lit(0.0)))).otherwise(0.0)


def _nearest(counts: Column, total: Column, known: list[list[float]]) -> Column:
    far = [_distance(counts, total, r) for r in known]
    return F.least(*far) if len(far) > 1 else far[0] if far else F.lit(0.0)


#: Starts of 3-word windows that may be found twice or more. Each window's hash, above the bits of its place, is sorted, so
#: that equal ones are neighbours; places need as many bits as n_words has. As that leaves fewer bits for the hash, the
#: windows found are sorted again by their words, and only those with an equal neighbour count.
_KEYS = "transform(slice(words, 1, n_words - 2), (w, i) -> shiftleft(xxhash64(w, words[i + 1], words[i + 2]), _bits) | i)"
_NEAR = "filter(transform(_keys, (x, i) -> if(shiftright(x, _bits) = shiftright(get(_keys, i - 1), _bits) or shiftright(x, _bits) = shiftright(get(_keys, i + 1), _bits), cast(x & (shiftleft(1L, _bits) - 1) as int), null)), x -> x is not null)"
_TOLD = "sort_array(transform(_near, s -> struct(words[s] as a, words[s + 1] as b, words[s + 2] as c, s as s)))"
_SAME = "filter(transform(_told, (x, i) -> if(struct(x.a, x.b, x.c) = struct(get(_told, i - 1).a, get(_told, i - 1).b, get(_told, i - 1).c) or struct(x.a, x.b, x.c) = struct(get(_told, i + 1).a, get(_told, i + 1).b, get(_told, i + 1).c), x.s, null)), x -> x is not null)"


def text_key(text: Column) -> Column:
    """What tells texts apart: two hashes, of 96 bits together, and the length. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("n"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, key, the base measures and both histograms of every document, in one pass; staged, so that nothing
    that is asked of them later reaches the texts."""
    df = pick(docs, "doc_id", "text", "lang").withColumn("key", text_key(F.col("text"))).withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn("n_words", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", F.size("_lines") - F.size(F.array_distinct("_lines"))).drop("_lines")
    df = _classes(df)
    df = df.withColumn("_bits", F.length(F.bin("n_words")))
    df = df.withColumn("_keys", F.expr(f"if(n_words < 4, cast(array() as array<bigint>), sort_array({_KEYS}))"))
    df = df.withColumn("_near", F.expr(_NEAR)).withColumn("_told", F.expr(_TOLD)).withColumn("_starts", F.expr(_SAME))
    covered = F.expr("size(array_distinct(concat(_starts, transform(_starts, x -> x + 1), transform(_starts, x -> x + 2))))")
    df = df.withColumn("n_repeat_words", F.when(F.size("_starts") == 0, 0).otherwise(covered)).drop("_starts", "_told", "_near", "_keys", "_bits")
    df = df.withColumn("_common", F.filter("words", lambda w: w.isin(*BINS))).drop("words", "text")
    df = df.withColumn("_n_common", F.size("_common"))
    bins = F.transform(F.array(*[F.lit(w) for w in BINS]), lambda w: F.col("_n_common") - F.size(F.array_remove("_common", w)))
    df = df.withColumn("bins", F.concat(bins, F.array(F.col("n_words") - F.col("_n_common")))).drop("_common", "_n_common")
    return staged(df.withColumn("n_chars", sum((F.col(c) for c in _class_counts()), F.lit(0))), "rule-counts")


def judged(counts: DataFrame, known: dict[str, tuple[list[float], list[float] | None]]) -> DataFrame:
    """doc_id, key, the base measures, both distances and the verdict of each row of counts; staged."""
    chars = F.array(*_class_counts())
    near = lambda refs: _nearest(chars, F.col("n_chars"), refs)
    df = counts.withColumn("_listed", near([c for c, w in known.values() if w])).withColumn("_others", near([c for c, w in known.values() if not w]) if any(not w for _, w in known.values()) else F.lit(1.0))
    df = df.withColumn("char_distance", F.least("_listed", "_others") if any(w for _, w in known.values()) else F.col("_others"))
    df = df.withColumn("word_distance", _nearest(F.col("bins"), F.col("n_words"), [w for _, w in known.values() if w]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    both = (F.col("n_words") >= MIN_COMPARED_WORDS) & (F.col("char_distance") > CHAR_DISTANCE_WITH_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    far = (F.col("n_chars") >= MIN_CHARS) & ((F.col("char_distance") > MAX_CHAR_DISTANCE) | both)
    df = df.withColumn("word_chars", F.col("n_chars") - F.col("n_space")).withColumn("base_failed", failed)
    whole = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars")]
    whole += [F.col("n_symbol").cast("long").alias("n_symbols"), *[F.col(c).cast("long").alias(c) for c in ("n_dup_lines", "n_repeat_words")]]
    return staged(df.select("doc_id", "key", *whole, "base_failed", (~failed & ~far).alias("kept"), "char_distance", "word_distance"), "rule-verdicts")


def verdicts(docs: DataFrame) -> DataFrame:
    """quality_rules() with the key of each row's text."""
    counts = counted(docs)
    return judged(counts, references(counts))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The measures and the verdict (kept) of each row of docs (doc_id, text, lang).

    Null and empty texts have no words and fail the minimum. Repeated rows are judged one by one; a null doc_id stays
    null. An empty table gives no rows. Other columns are not read. The result is a table of its own in the shared folder:
    filters, joins and aggregates on it never reach the texts.
    """
    return verdicts(docs).drop("key")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
