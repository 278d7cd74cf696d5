"""Expressions for activity logs and reports: what an action means to a reader, and texts of fixed shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The direction and the verb of each type of action; record and forget have none.
SOURCES = {
    "local": ["upload", "update_remote", "trash_remote", "move_remote", "mkdir_remote"],
    "remote": ["download", "quarantine_local", "move_local", "mkdir_local"],
    "conflict": ["conflict_backup"],
}
KINDS = {
    "upload": ["upload"],
    "update": ["update_remote"],
    "download": ["download"],
    "trash": ["trash_remote", "quarantine_local"],
    "move": ["move_local", "move_remote"],
    "mkdir": ["mkdir_local", "mkdir_remote"],
    "conflict": ["conflict_backup"],
}


def _of(type_: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(type_.isin(types), F.lit(name)) for name, types in table.items()])


def source(type_: Column) -> Column:
    return _of(type_, SOURCES)


def kind(type_: Column) -> Column:
    return _of(type_, KINDS)


def detail(new_path: Column, subtree_files: Column) -> Column:
    """Where a move goes, or how many files a collapsed action stands for."""
    return F.when(new_path.isNotNull(), F.concat(F.lit("-> "), new_path)).when(subtree_files > 0, F.concat(F.lit("("), subtree_files.cast("string"), F.lit(" files)"))).otherwise("")


def machine_name(name: Column, default: str = "unknown_machine") -> Column:
    """Letters, digits, _ and - stay, dots and spaces become _, all else goes; the default where nothing is left."""
    kept = F.regexp_replace(F.translate(name, ". ", "__"), "[^A-Za-z0-9_-]", "")
    return F.when(kept == "", default).otherwise(kept)


def numbered(path: Column, n: Column) -> Column:
    """stem.n.ext for the second and further ones, the path itself for the first."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.when(n <= 1, path).otherwise(F.concat(F.left(path, F.length(path) - F.length(ext)), F.lit("."), n.cast("string"), ext))


def rescue_path(root: str, at: Column, path: Column) -> Column:
    return F.concat(F.lit(root + "/"), F.date_format(at, "yyyy-MM-dd"), F.lit("/"), path)


def pad(text: Column, width: int) -> Column:
    """Filled up with spaces, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def truncated(text: Column, width: int, keep: str = "left") -> Column:
    """At most width characters, one of them an ellipsis for what is left out; control white space as single spaces."""
    plain = F.translate(text, "\n\r\t", "   ")
    if width <= 0:
        return plain
    part = F.left(plain, F.lit(width - 1)) if keep == "left" else F.right(plain, F.lit(width - 1))
    cut = F.concat(part, F.lit("…")) if keep == "left" else F.concat(F.lit("…"), part)
    return F.when(F.length(plain) > width, cut).otherwise(plain)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def repeat_suffix(count: Column) -> Column:
    return F.when(count < 2, "").otherwise(F.concat(F.lit(" (×"), count.cast("string"), F.lit(")")))


def filter_label(direction: Column, query: Column) -> Column:
    """The filters of a list as a heading: what direction, and the text that was typed; empty where all is shown."""
    side = F.when(direction == "error", "errors").when(direction == "local", "local→drive").when(direction == "remote", "drive→local").when(direction != "", direction)
    return F.concat_ws(" + ", side, F.when(query != "", F.concat(F.lit("“"), query, F.lit("”"))))


def expired_grant(error: Column) -> Column:
    """Whether an error says that access was revoked or ran out, which only a new login mends."""
    return F.coalesce(F.contains(error, F.lit("invalid_grant")), F.lit(False))


def nanoseconds(text: Column) -> Column:
    """An instant with zone (RFC 3339) as nanoseconds since 1970; 0, which means not known, for all other texts."""
    whole = F.regexp_like(text, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"))
    return F.coalesce(F.when(whole, F.unix_micros(F.try_to_timestamp(text)) * 1000), F.lit(0)).cast("long")
