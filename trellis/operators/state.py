"""What a run leaves behind and starts from: the journal of its actions, the committed base, guards at execution, the mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.paths import basename, dirname, extension
from trellis.sources.tables import staged

#: States of an action in the journal, in order.
STATES = ["planned", "in_progress", "done"]


def current(journal: DataFrame) -> DataFrame:
    """op_id and the rest of the furthest state of each action; a state never goes back."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    row = F.struct(rank.alias("_rank"), *journal.columns)
    return journal.groupBy(F.col("op_id").alias("_op")).agg(F.max(row).alias("r")).select(*[F.col(f"r.{c}") for c in journal.columns])


def stale(ops: DataFrame) -> DataFrame:
    """Actions that never finished, in the order in which they were planned."""
    return ops.where("state <> 'done'").orderBy("op_id")


def pending(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count_if(F.col("state") != "done").alias("pending"))


def with_parent(rows: DataFrame, base: DataFrame, root_id: str) -> DataFrame:
    """rows with parent_id: the id of the directory that holds their rel_path, null where that is unknown."""
    dirs = base.select(F.col("rel_path").alias("_dir"), F.col("file_id").alias("_id"))
    out = rows.withColumn("_at", dirname(F.col("rel_path"))).join(dirs, F.col("_at") == F.col("_dir"), "left")
    return out.select(*rows.columns, F.when(F.col("_at") == "", root_id).otherwise(F.col("_id")).alias("parent_id"))


def made_but_unrecorded(ops: DataFrame, base: DataFrame, nodes: DataFrame, root_id: str) -> DataFrame:
    """rel_path, file_id of unfinished creations that the remote side has: a node of that name in the directory's id.

    Directories that the same run made count as parents too, level by level, as long as such turn up.
    """
    waiting = stale(ops).where(F.col("op_type").isin("upload", "mkdir_remote")).select("rel_path", "op_type")
    known, found = base.select("rel_path", "file_id"), None
    while True:
        placed = with_parent(waiting, known, root_id).where("parent_id is not null").withColumn("name", basename(F.col("rel_path")))
        new = placed.join(nodes.select("file_id", "parent_id", "name"), ["parent_id", "name"]).select("rel_path", "file_id", "op_type").distinct()
        new = new if found is None else new.join(found.select("rel_path", "file_id"), ["rel_path", "file_id"], "left_anti")
        new = staged(new, "made")
        # a level of directories made by one run: as few as that run's paths are deep
        if new.isEmpty():
            return new.select("rel_path", "file_id") if found is None else found.select("rel_path", "file_id")
        found = new if found is None else found.union(new)
        known = known.union(new.where("op_type = 'mkdir_remote'").select("rel_path", "file_id"))


def refused(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """The actions whose protector failed."""
    return plan.join(failed.select(F.col("rel_path").alias("protected_by")), "protected_by", "left_semi").select(*plan.columns)


def uncovered(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """Base rows whose id the mirror doesn't have; there should be none."""
    return base.join(nodes.select("file_id"), "file_id", "left_anti").select("rel_path", "file_id")


def latest(rows: DataFrame) -> DataFrame:
    """Of rows with one id the one with the last path."""
    return rows.groupBy(F.col("file_id").alias("_id")).agg(F.max_by(F.struct(*rows.columns), "rel_path").alias("r")).select("r.*")


def upserted(base: DataFrame, rows: DataFrame) -> DataFrame:
    """base with rows in it; rows of the base that share an id or a path with one of them go. Of rows with one id the last path stays."""
    last = latest(rows.select(*base.columns))
    stay = base.join(last.select("file_id"), "file_id", "left_anti").join(last.select("rel_path"), "rel_path", "left_anti")
    return stay.select(*base.columns).union(last.select(*base.columns))


def refreshed(base: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    """base with the named columns taken from updates, by file_id; all others stay."""
    new = updates.select("file_id", *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(new, "file_id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def presence(pins: DataFrame, now: DataFrame) -> DataFrame:
    """rel_path, verdict of pins (rel_path, there, size, mtime_ns) against a fresh listing: ok, appeared, changed or vanished."""
    fresh = now.select("rel_path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_here"))
    rows = pins.join(fresh, "rel_path", "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))
    verdict = F.when(F.col("there") & ~F.col("_here"), "vanished").when(~F.col("there") & F.col("_here"), "appeared").when(F.col("there") & ~same, "changed").otherwise("ok")
    return rows.select("rel_path", verdict.alias("verdict"))


def subtree_drift(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """rel_path, why: what a gathered delete would take that its entries (rel_path, is_dir, size, mtime_ns) don't have as it is now."""
    a = entries.select("rel_path", *[F.col(c).alias(f"a_{c}") for c in ("is_dir", "size", "mtime_ns")], F.lit(True).alias("in_a"))
    b = listing.select("rel_path", *[F.col(c).alias(f"b_{c}") for c in ("is_dir", "size", "mtime_ns")], F.lit(True).alias("in_b"))
    rows = a.join(b, "rel_path", "full_outer")
    differs = (F.col("a_is_dir") != F.col("b_is_dir")) | (~F.col("a_is_dir") & ((F.col("a_size") != F.col("b_size")) | (F.col("a_mtime_ns") != F.col("b_mtime_ns"))))
    why = F.when(F.col("in_a").isNull(), "appeared").when(F.col("in_b").isNull(), "vanished").when(differs, "changed")
    return rows.select("rel_path", why.alias("why")).where("why is not null")


def rescue_names(rows: DataFrame) -> DataFrame:
    """rel_path, n, name of rows (rel_path, order) that want one place: the path for the first, `stem (n)ext` for further ones."""
    n = F.row_number().over(Window.partitionBy("rel_path").orderBy("order"))
    p, ext = F.col("rel_path"), extension(F.col("rel_path"))
    name = F.when(F.col("n") == 1, p).otherwise(F.concat(F.left(p, F.length(p) - F.length(ext)), F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ext))
    return rows.withColumn("n", n).select("rel_path", "n", name.alias("name"))


def to_walk(changes: DataFrame, nodes: DataFrame, root_id: str) -> DataFrame:
    """file_id of directories in the changes that the mirror doesn't know, beneath the root or a directory that it knows.

    They came with subtrees for which no change is ever told, so that these must be read whole.
    """
    new = changes.where("is_dir and not removed").join(nodes.select("file_id"), "file_id", "left_anti")
    here = new.join(nodes.select(F.col("file_id").alias("parent_id")), "parent_id", "left_semi").select("file_id")
    return here.union(new.where(F.col("parent_id") == root_id).select("file_id")).distinct()


def backfilled(nodes: DataFrame, changes: DataFrame, subtrees: DataFrame, seq: str = "seq") -> DataFrame:
    """The mirror after a page of changes: the last change of an id counts, removed and trashed ones go, read subtrees come in."""
    last = changes.groupBy(F.col("file_id").alias("_id")).agg(F.max_by(F.struct("removed", *nodes.columns), seq).alias("c")).select("c.*")
    came = last.where("not removed").select(*nodes.columns)
    read = subtrees.select(*nodes.columns).join(last.select("file_id"), "file_id", "left_anti")
    stay = nodes.join(last.select("file_id"), "file_id", "left_anti").join(read.select("file_id"), "file_id", "left_anti")
    return stay.select(*nodes.columns).union(came).union(read)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with side; none where both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def backoffs(poll: int, failures: int) -> list[int]:
    """The waits after so many failures in a row: doubled until one is ten times the poll interval or longer."""
    out, wait = [], poll
    for _ in range(failures):
        out.append(wait)
        wait = wait * 2 if wait < 10 * poll else wait
    return out


def retryable(code: Column, reasons: Column) -> Column:
    """Whether an error is worth another attempt: too many requests, a server's fault, or a limit on the rate."""
    limits = F.arrays_overlap(reasons, F.array(F.lit("rateLimitExceeded"), F.lit("userRateLimitExceeded")))
    return (code == 429) | code.between(500, 599) | ((code == 403) & F.coalesce(limits, F.lit(False)))
