"""Reports on snapshots: divergence, incremental hashing, secrets in texts, retention and states of a daemon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of secrets.
SECRET_RULES = {
    "google-oauth-client-secret": r"GOCSPX-[A-Za-z0-9_\-]{10,}",
    "google-api-key": r"AIza[0-9A-Za-z_\-]{35}",
    "aws-access-key-id": r"AKIA[0-9A-Z]{16}",
    "slack-token": r"xox[baprs]-[0-9A-Za-z-]{10,}",
    "private-key-block": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
}


def divergence(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """category, rel_path: rows of the base missing or different on a side, and rows of a side that the base doesn't have."""
    b = base.select("rel_path", "file_id", F.col("md5").alias("was"))
    by_path = b.join(local.select("rel_path", F.col("md5").alias("now"), F.lit(True).alias("here")), "rel_path", "left")
    by_id = b.join(remote.select("file_id", F.col("md5").alias("now"), F.lit(True).alias("here")), "file_id", "left")

    def told(rows: DataFrame, side: str) -> DataFrame:
        what = F.when(F.col("here").isNull(), f"missing_{side}").when(F.col("now") != F.col("was"), f"differs_{side}")
        return rows.select(what.alias("category"), "rel_path").where("category is not null")

    extra_local = local.join(base, "rel_path", "left_anti").select(F.lit("untracked_local").alias("category"), "rel_path")
    extra_remote = remote.join(base, "file_id", "left_anti").select(F.lit("untracked_remote").alias("category"), "rel_path")
    return told(by_path, "local").union(told(by_id, "remote")).union(extra_local).union(extra_remote)


def health(report: DataFrame) -> DataFrame:
    """problems, healthy: healthy where no list of the report has an entry."""
    return report.agg(F.count("*").alias("problems"), (F.count("*") == 0).alias("healthy"))


def adoptable(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """rel_path, file_id, md5 of rows on both sides with equal content that the base has neither by path nor by id."""
    here = local.join(base, "rel_path", "left_anti").select("rel_path", "md5")
    there = remote.join(base, "file_id", "left_anti").select("rel_path", "file_id", "md5")
    return here.join(there, ["rel_path", "md5"]).select("rel_path", "file_id", "md5")


def hashed_on_drift(files: DataFrame, base: DataFrame) -> DataFrame:
    """rel_path, md5, reused: the known hash where size and time are the base's, else that of the content.

    The join comes first, and the content of files that have not drifted is dropped before it is hashed.
    """
    known = base.select("rel_path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("md5").alias("_md5"))
    rows = files.join(known, "rel_path", "left")
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), F.lit(False))
    return rows.select("rel_path", F.when(same, F.col("_md5")).otherwise(F.md5(F.col("content").cast("binary"))).alias("md5"), same.alias("reused"))


def secret_lines(texts: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """id, line, rule: the lines of each text that a rule finds, counted from 1."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "_text"))
    found = F.filter(F.array(*[F.when(F.regexp_like("_text", F.lit(p)), F.lit(k)) for k, p in (rules or SECRET_RULES).items()]), lambda x: x.isNotNull())
    return lines.select("id", (F.col("line") + 1).cast("long").alias("line"), F.explode(found).alias("rule"))


def sensitive_name(name: Column) -> Column:
    return name.isin("token.json", "credentials.json") | F.regexp_like(name, F.lit(r"^client_secret_.*\.json$")) | F.regexp_like(name, F.lit(r"\.(db|db-wal|db-shm)$"))


def expired(names: Column, today: Column, days: int) -> Column:
    """Whether a folder named by a date is older than so many days; other names never are."""
    return F.coalesce(F.try_to_date(names, "yyyy-MM-dd") < F.date_sub(today, days), F.lit(False))


def daemon_state(alive: Column, started: Column, running: Column, heartbeat: Column, now: Column, window: int = 30) -> Column:
    """running where it answers; else by its row: never run, stopped, stale or running."""
    return F.when(alive, "running").when(F.coalesce(started, F.lit(0)) == 0, "never-run").when(~running, "stopped").when(now - heartbeat > window, "stale").otherwise("running")
