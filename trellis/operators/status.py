"""The read model: what happened in a cycle, what deserves attention, and lines of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.paths import TEMP_PREFIX, basename, clip, duration_text, one_line
from trellis.functions.reports import detail, kind, source, thousands

CYCLE = "actions long, executed long, failed long, duration_ms long"


def recorded(plan: DataFrame, guard_blocked: bool, bin_available: bool, most: int = 500) -> DataFrame:
    """kind, rel_path, detail, source of the actions of a cycle that went well; deletes that a guard held back never happened."""
    t = F.col("type")
    rows = plan.where(kind(t).isNotNull())
    if guard_blocked:
        rows = rows.where(~t.isin("trash_remote", "quarantine_local"))
    what = kind(t) if bin_available else F.when(t == "quarantine_local", "quarantine").otherwise(kind(t))
    return rows.select(what.alias("kind"), one_line(F.col("rel_path")).alias("rel_path"), clip(one_line(detail(F.col("new_rel_path"), F.col("subtree_files"))), most).alias("detail"), source(t).alias("source"))


def cycle_log(plan: DataFrame, failed: DataFrame, guard_blocked: bool, bin_available: bool, most: int = 500) -> DataFrame:
    """kind, rel_path, detail, source of what a cycle adds to the log: its actions, or, if any failed (rel_path, error), the errors alone."""
    errors = failed.select(F.lit("error").alias("kind"), one_line(F.col("rel_path")).alias("rel_path"), clip(one_line(F.col("error")), most).alias("detail"), F.lit("").alias("source"))
    return errors if not failed.isEmpty() else recorded(plan, guard_blocked, bin_available, most)


def backoff(failures: Column, poll: int, most: int = 10) -> Column:
    """How long to wait after so many failures in a row: poll, doubled each time until it is `most` times poll or longer."""
    doublings, wait = 0, poll
    while wait < most * poll:
        wait, doublings = wait * 2, doublings + 1
    return F.when(failures <= 0, poll).otherwise((F.lit(poll) * F.pow(F.lit(2), F.least(failures - 1, F.lit(doublings)))).cast("long"))


def status_view(machine: DataFrame, log: DataFrame, recent: int = 5) -> DataFrame:
    """One row, json: machine's one row (any columns) as it is, and recent_activity: the newest entries of the log (id first)."""
    columns = [f for f in log.schema if f.name != "id"]
    entry = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in columns])
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in columns)
    newest = F.array(*map(entry, log.orderBy(F.col("id").desc()).limit(recent).collect())).cast(f"array<struct<{kind}>>")
    return machine.select(F.to_json(F.struct(*machine.columns, newest.alias("recent_activity")), {"ignoreNullFields": "false"}).alias("json"))


def deletions(plan: DataFrame, tracked: int, threshold: float, failed: int, least: int = 10) -> DataFrame:
    """deleted_local, deleted_remote, large: files that a cycle took away on each side; zeros if any action failed."""
    n = F.when(F.col("is_dir"), F.col("subtree_files")).otherwise(1)
    side = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, n)), F.lit(0)).cast("long") if not failed else F.lit(0).cast("long")
    out = plan.agg(side("quarantine_local").alias("deleted_local"), side("trash_remote").alias("deleted_remote"), F.count("*").alias("_n")).drop("_n")
    most = F.greatest("deleted_local", "deleted_remote")
    return out.withColumn("large", F.lit(tracked > 0) & (most > least) & (most > threshold * tracked))


def cycle(results: DataFrame) -> DataFrame:
    """actions, executed, failed, duration_ms of the results (status, started_ms, ended_ms) of a cycle's actions."""
    return results.agg(F.count("*").alias("actions"), F.count_if(F.col("status") == "done").alias("executed"), F.count_if(F.col("status") == "failed").alias("failed"), (F.max("ended_ms") - F.min("started_ms")).alias("duration_ms"))


def cycle_suffix(text: Column) -> Column:
    """The summary of a cycle kept as JSON; empty where there is none or it can't be read."""
    c = F.from_json(text, CYCLE)
    whole = F.concat(F.lit(" — "), *[x for n, unit in (("actions", " actions, "), ("executed", " ok, "), ("failed", " failed, "), ("duration_ms", "ms")) for x in (F.coalesce(c[n], F.lit(0)).cast("string"), F.lit(unit))])
    return F.when(c.isNull() | F.coalesce(F.get_json_object(text, "$").isNull(), F.lit(True)), "").otherwise(whole)


def ago(now: Column, at: Column) -> Column:
    return F.when(at <= 0, "never").otherwise(F.concat(duration_text(now - at), F.lit(" ago")))


def until(now: Column, at: Column) -> Column:
    return F.when(at <= 0, "unknown").when(at <= now, "now").otherwise(F.concat(F.lit("in "), duration_text(at - now)))


def attention(state: Column, guard_reason: Column, rejected: Column, last_error: Column, bin_available: Column, credentials: Column, autostart: Column) -> Column:
    """What a user would want to be told without asking, as a list; texts that aren't due are left out."""
    told = [
        F.when(guard_reason != "", F.concat(F.lit("guard blocked: "), guard_reason)), F.when(rejected, F.lit("credentials expired")), F.when(last_error != "", F.concat(F.lit("last error: "), last_error)),
        F.when(~bin_available, F.lit("no system bin")), F.when(state == "stale", F.lit("no heartbeats")).when(state.isin("stopped", "never-run"), F.lit("nothing is syncing")),
        F.when(~credentials, F.lit("no saved credentials")), F.when(~autostart, F.lit("autostart not installed")),
    ]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def glyph(source_: Column) -> Column:
    return F.when(source_ == "local", "↑").when(source_ == "remote", "↓").when(source_ == "conflict", "⇅").otherwise("!")


def activity_text(rel_path: Column, detail_: Column, count: Column) -> Column:
    """A row of the log as text; how often it was folded stands in front of a message and behind a path, where a cut spares it."""
    text = F.when(rel_path == "", detail_).when(detail_ == "", rel_path).otherwise(F.concat(rel_path, F.lit(" "), detail_))
    times = F.concat(F.lit("×"), thousands(count))
    return F.when(count <= 1, text).when(rel_path == "", F.concat(times, F.lit(" "), text)).otherwise(F.concat(text, F.lit(" "), times))


def collision_cause(by_norm: Column, first_by_norm: Column, by_case: Column, first_by_case: Column, case_fold: bool, norm_fold: bool) -> Column:
    """case, normalization or either: which of the foldings makes two names meet, from their keys under one folding alone."""
    cause = F.when(F.lit(case_fold) & (by_norm != first_by_norm), "case").when(F.lit(norm_fold) & (by_case != first_by_case), "normalization")
    return cause.otherwise("either")


def trash_info(path: Column, at: Column) -> Column:
    """The body of an entry of the bin: the path escaped like that of a URL, slashes kept, and the time without a zone."""
    escaped = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    for code, c in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        escaped = F.replace(escaped, F.lit(code), F.lit(c))
    escaped = F.replace(escaped, F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit("[Trash Info]\nPath="), escaped, F.lit("\nDeletionDate="), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n"))


def usage(files: DataFrame, folder: str) -> DataFrame:
    """files, bytes beneath a folder."""
    return files.where(F.startswith("rel_path", F.lit(folder + "/"))).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def orphans(files: DataFrame) -> DataFrame:
    """Temporary files that a crash left behind."""
    return files.where(F.startswith(basename(F.col("rel_path")), F.lit(TEMP_PREFIX))).select("rel_path")


def page(rows: DataFrame, order: list[Column], at: int, size: int) -> DataFrame:
    """A window of a list that is scrolled."""
    return rows.orderBy(*order).offset(at).limit(size)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row, of the named columns."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
