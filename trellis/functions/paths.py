"""Expressions over relative paths (posix style, no leading or trailing slash) and over the text of reports."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TEMP_PREFIX = ".trellis.tmp."


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The path without its last segment; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the last segment, also where that is its first character; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """Proper ancestors, the nearest to the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def proper_ancestors(path: Column) -> Column:
    """The same, and none for a path without a slash."""
    return F.when(F.contains(path, F.lit("/")), ancestors(path)).otherwise(F.array().cast("array<string>"))


def conflict_name(path: Column, machine: str, at: Column) -> Column:
    """<stem> (conflict <machine> <time>)<extension>"""
    ext = extension(path)
    stem = F.left(path, F.length(path) - F.length(ext))
    return F.concat(stem, F.lit(f" (conflict {machine} "), F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit(")"), ext)


def valid_name(name: Column) -> Column:
    return ~(name.isin("", ".", "..") | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\0")))


def glob_pattern(glob: str) -> str | None:
    """An anchored regular expression for a glob over one segment, or None for a malformed one, which matches nothing."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" if body[0] == "^" else "") + body.lstrip("^").replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def ignored(name: Column, globs: list[str]) -> Column:
    """Whether a name has the prefix of temporary files or matches any of the globs."""
    out = F.startswith(name, F.lit(TEMP_PREFIX))
    for pattern in filter(None, map(glob_pattern, globs)):
        out = out | F.regexp_like(name, F.lit(pattern))
    return out


def fold_key(name: Column, case_fold: bool, norm_fold: bool) -> Column:
    """The key under which names collide where case or normal form don't count. Spark has no normal forms, hence Arrow there."""
    if not norm_fold:
        return F.lower(name) if case_fold else name

    def fold(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # letters one by one: a letter never becomes two
        return unicodedata.normalize("NFC", "".join(c.lower()[0] for c in text)) if case_fold else text

    @F.arrow_udf("string")
    def folded(names: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold(x) for x in names.to_pylist()], pa.string())

    return folded(name)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, most: int) -> Column:
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes, hours with minutes, or days with hours, cut off to whole numbers."""
    s = seconds.cast("long")
    whole = lambda n: F.floor(s / n).cast("string")
    rest = lambda n, unit: F.floor((s % n) / unit).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h"), rest(3600, 60), F.lit("m")))
        .otherwise(F.concat(whole(86400), F.lit("d"), rest(86400, 3600), F.lit("h")))
    )
