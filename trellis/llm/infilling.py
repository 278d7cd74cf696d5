"""Fill-in-middle transformation by escaped marker injection.

A delimiter is escaped in the text, put behind each unit by one regexp_replace, and counted; the parts before, between and
behind two ranks are then taken by substring_index, freed of delimiters and unescaped, and assembled in the order of the
form. Everything is a built-in function over one row: there is no shuffle, and work is in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import documents, pick

#: A unit: white space and the word behind it, or white space that ends the text. White space never has to be given back.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The delimiter, and what begins an escaped character. Neither is white space, so that units stay what they are.
DELIMITER, ESCAPE = "\u001f", "\u001b"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def injected(text: Column) -> Column:
    """The escaped text with a delimiter behind each unit."""
    return F.regexp_replace(escaped(text), UNIT, f"$0{DELIMITER}")


def count_of(marked: Column) -> Column:
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER)))).cast("long")


def part(marked: Column, of: Column, first: Column, last: Column) -> Column:
    """The text of the units first to last (exclusive) of the `of` units of a marked text."""
    upto = F.when(last == of, marked).otherwise(F.concat(F.call_function("substring_index", marked, F.lit(DELIMITER), last.cast("int")), F.lit(DELIMITER)))
    # what was cut ends with a delimiter, so that one more stands behind the unit before the first
    kept = F.when(first == 0, upto).otherwise(F.call_function("substring_index", upto, F.lit(DELIMITER), (first - last - 1).cast("int")))
    return F.when(first >= last, "").otherwise(unescaped(F.replace(kept, F.lit(DELIMITER))))


def draws(doc_id: Column, seed: str, n: int = 4) -> list[Column]:
    """The first groups of eight digits of the hash of seed:doc_id, as numbers. A null id hashes like an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever text stands beside them: no end of one begins another, and none holds another."""
    for a in markers:
        if not a or any(b != a and b in a for b in markers) or any(b.startswith(a[i:]) for b in markers for i in range(1, len(a))) or markers.count(a) > 1:
            raise ValueError(f"markers can't be told apart: {markers}")


def infilled(docs: DataFrame, seed: str = "42", percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix and output of each row: the text cut at two places between its units.

    About percent of the rows are cut, spm_percent of them with the suffix first; both, and the two places, follow from the
    hash of seed and doc_id alone. A null text is an empty one; empty texts, and texts that hold a marker, stay plain; parts
    are null then. A null doc_id draws as an empty one does. Rows that are repeated are cut alike. Texts of any length are
    cut whole. An empty table gives no rows. Other columns are not read.
    """
    _checked(markers)
    p, s, m = markers
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = rows.select("doc_id", "text", injected(F.col("text")).alias("_marked"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    holds = F.lit(False)
    for x in markers:
        holds = holds | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | (F.col("_h3") % 100 >= percent) | holds, PLAIN).when(F.col("_h4") % 100 < spm_percent, SPM).otherwise(PSM)
    counted = marked.select("doc_id", "text", "_marked", "_h1", "_h2", count_of(F.col("_marked")).alias("n"), form.alias("form"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    cut = counted.select("doc_id", "text", "_marked", "n", "form", F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    piece = lambda first, last: F.when(F.col("form") != PLAIN, part(F.col("_marked"), F.col("n"), first, last))
    parts = cut.select("doc_id", "text", "n", "form", piece(F.lit(0), F.col("_a")).alias("prefix"), piece(F.col("_a"), F.col("_b")).alias("middle"), piece(F.col("_b"), F.col("n")).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return parts.withColumn("output", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("text")))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = markers
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    behind = lambda text, mark: F.substring_index(text, mark, -1)
    head, middle = upto(output, m), behind(output, m)
    psm = F.concat(upto(behind(head, p), s), middle, behind(head, s))
    spm = F.concat(behind(head, p), middle, upto(behind(head, s), p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilled(documents(spark, sf_dir))
    hashed = lambda c: F.sha2(c, 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
cut as (
  select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    [('0x' || substr(h, 8 * i + 1, 8))::ubigint::bigint for i in range(4)] as d
  from docs),
ranked as (
  select doc_id, text, units, len(units) as n, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 50 then 'plain' when d[4] % 100 < 80 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select *, coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m, coalesce(array_to_string(units[b + 1:n], ''), '') as s
  from ranked)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
