"""Tables that are committed together: data first, then one manifest, whose name is the commit.

A table is rewritten whole by a commit or changed by it: what goes and what comes lies beside the table, and reading joins
them. Or it is keyed: its rows lie in buckets by a hash of their key, a merge writes only what a batch changes, beside what is
there, and a compaction rewrites the buckets that have gathered many such parts.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from trellis.sources.tables import union_of

Migration = Callable[["Store"], tuple[dict[str, DataFrame], dict[str, str]]]
VERSION = "schema_version"
#: Columns that the parts of a keyed table have beside its own: where a change stands in its feed, and whether it takes the row away.
SEQ, GONE, BUCKET = "_seq", "_gone", "_bucket"
CHANGE = [StructField(SEQ, LongType()), StructField(GONE, BooleanType())]


@dataclass(frozen=True)
class Change:
    """Rows of a store's data folder as a change of a table: what they name goes, then they come in, unless they only name.

    takes has pairs of a column of the table and a column of these rows: rows of the table go that have one of its values there.
    """

    path: str
    rows: DataFrame
    takes: tuple[tuple[str, str], ...]
    gives: bool = True


class Store:
    """Named tables and texts in a folder that all executors share.

    A commit writes the tables that it changes in new folders and then names a manifest with the next number, which fails
    if another commit has taken it: on a local disk by a link, elsewhere by a rename, which must refuse a name that is
    there. Readers follow the highest manifest, so that they see all of a commit or nothing, and folders that a crash left
    without a manifest are never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self) -> tuple[int, dict]:
        if not (done := self._numbers()):
            return 0, {"tables": {}, "keyed": {}, "changes": {}, "meta": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{done[-1]}"))
        try:
            return done[-1], {"keyed": {}, "changes": {}} | json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str, shape: Callable[[DataFrame], DataFrame] | None = None, among: DataFrame | None = None) -> DataFrame:
        """The table, each part of it as shape makes it, and of its rows those that have a value of among, a table of one of its columns.

        Both come before parts meet the changes behind them, so that these joins move no more than is asked for. shape must
        leave the columns by which changes take rows.
        """
        now, shape = self._read()[1], shape or (lambda df: df)
        cut = lambda df: df if among is None else df.join(among, among.columns[0], "left_semi").select(*df.columns)
        if name in now["keyed"]:
            return cut(shape(self._merged(now["keyed"][name])))
        path, schema = now["tables"][name]
        schema = StructType.fromJson(schema)
        first, changes = shape(self._at(path, schema)), now["changes"].get(name, [])
        if not changes:
            return cut(first)
        parts = [first, *[shape(self._at(c["path"], schema)) if c["gives"] else None for c in changes]]
        rows = cut(union_of([df.withColumn("_part", F.lit(n)) for n, df in enumerate(parts) if df is not None]))
        taken: dict[str, list[DataFrame]] = {}
        for n, c in enumerate(changes, 1):
            for column, of in c["takes"]:
                keys = self._at(c["path"], StructType([StructField(of, schema[column].dataType)]))
                taken.setdefault(column, []).append(keys.select(F.col(of).alias("_key"), F.lit(n).alias("_by")))
        for column, keys in taken.items():
            rows = rows.join(union_of(keys), (F.col(column) == F.col("_key")) & (F.col("_part") < F.col("_by")), "left_anti")
        return rows.select(*first.columns)

    def _at(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")

    def changes(self, name: str) -> int:
        """How many changes lie beside the table."""
        return len(self._read()[1]["changes"].get(name, []))

    def change(self, name: str, rows: DataFrame, *takes: tuple[str, str] | str, gives: bool = True) -> Change:
        """Writes rows for a commit that changes the table by them; a column alone takes what has the same value there."""
        path = self._new(name)
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
        return Change(path, self._at(path, rows.schema), tuple((t, t) if isinstance(t, str) else t for t in takes), gives)

    def tables(self) -> list[str]:
        now = self._read()[1]
        return sorted([*now["tables"], *now["keyed"]])

    def meta(self, key: str) -> str | None:
        return self._read()[1]["meta"].get(key)

    def commit(self, tables: dict[str, DataFrame | list[Change]], meta: dict[str, str] | None = None) -> int:
        """All of the tables, changes of tables and texts, or none of them; others stay as they are. The number of the commit."""
        number, now = self._read()
        for name, df in tables.items():
            if isinstance(df, list):
                if name not in now["tables"]:
                    raise ValueError(f"{name} is no table that changes can lie beside")
                now["changes"].setdefault(name, []).extend({"path": c.path, "takes": c.takes, "gives": c.gives} for c in df)
                continue
            path = self._new(name)
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{path}")
            now["tables"][name] = [path, df.schema.jsonValue()]
            now["keyed"].pop(name, None)
            now["changes"].pop(name, None)
        return self._name(number, now, meta)

    def _new(self, name: str) -> str:
        return f"data/{name}-{uuid.uuid4().hex}"

    def _name(self, number: int, now: dict, meta: dict[str, str] | None) -> int:
        now["meta"].update(meta or {})
        draft = self._path(f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        target = self._path(f"{self.folder}/manifests/{number + 1}")
        if not self._taken(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"commit {number + 1} was taken by another writer")
        return number + 1

    def _taken(self, draft: object, target: object) -> bool:
        """Gives the draft its number, unless another has that."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(target) and self._fs.rename(draft, target)
        try:
            os.link(urlparse(draft.toString()).path, urlparse(target.toString()).path)
        except FileExistsError:
            return False
        self._fs.delete(draft, False)
        return True

    # ---- keyed tables

    def keyed(self, name: str, rows: DataFrame, key: str, buckets: int = 64, meta: dict[str, str] | None = None) -> int:
        """The table anew, its rows in buckets by the hash of their key; keys must be unique. The number of the commit."""
        number, now = self._read()
        path = self._new(name)
        held = self._deal(rows, key, buckets, path)
        now["tables"].pop(name, None)
        now["changes"].pop(name, None)
        now["keyed"][name] = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "base": dict.fromkeys(held, path), "parts": {}}
        return self._name(number, now, meta)

    def merge(self, name: str, changes: DataFrame, seq: Column, gone: Column, meta: dict[str, str] | None = None) -> int:
        """The table with changes: of each key the one with the highest seq, which replaces the row or, where gone, takes it away.

        Only changed rows are written, each to its bucket, so that the work follows the batch and not the table. Merging the
        same changes twice ends in the same rows.
        """
        number, now = self._read()
        table = now["keyed"][name]
        columns, key = StructType.fromJson(table["schema"]).names, table["key"]
        row = F.struct(*columns, seq.cast("long").alias(SEQ), gone.alias(GONE))
        last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, seq).alias("r")).select("r.*")
        path = self._new(name)
        for bucket in self._deal(last, key, table["buckets"], path):
            table["parts"].setdefault(bucket, []).append(path)
        return self._name(number, now, meta)

    def compact(self, name: str, most: int = 4) -> list[int]:
        """Rewrites the buckets that have more than `most` parts, in one commit; which those are."""
        number, now = self._read()
        table = now["keyed"][name]
        full = [b for b, parts in table["parts"].items() if len(parts) > most]
        if full:
            path = self._new(name)
            held = self._deal(self._merged(table, full), table["key"], table["buckets"], path)
            for b in full:
                del table["parts"][b]
                table["base"].pop(b, None)
            table["base"].update(dict.fromkeys(held, path))
            self._name(number, now, None)
        return sorted(map(int, full))

    def _deal(self, rows: DataFrame, key: str, buckets: int, path: str) -> list[str]:
        """Writes each row to the folder of its bucket, a file a bucket; the buckets that have rows."""
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{path}"))]
        return [n.split("=")[1] for n in names if n.startswith(f"{BUCKET}=")]

    def _parts(self, paths: list[tuple[str, str]], schema: StructType) -> DataFrame:
        found = [f"{self.folder}/{path}/{BUCKET}={b}" for b, path in paths]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _merged(self, table: dict, only: list[str] | None = None) -> DataFrame:
        """The rows of a keyed table, or of some of its buckets: those of its base whose keys no part has, and the parts' last."""
        schema, key = StructType.fromJson(table["schema"]), table["key"]
        within = lambda b: only is None or b in only
        base = self._parts([(b, p) for b, p in table["base"].items() if within(b)], schema)
        parts = [(b, p) for b, of in table["parts"].items() if within(b) for p in of]
        if not parts:
            return base
        rows = self._parts(parts, StructType([*schema, *CHANGE]))
        last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), SEQ).alias("r")).select("r.*")
        return base.join(last.select(key), key, "left_anti").select(*schema.names).union(last.where(f"not {GONE}").select(*schema.names))

    def reset(self, *names: str) -> int:
        """The named tables emptied, in one commit."""
        return self.commit({n: self.spark.createDataFrame([], self.table(n).schema) for n in names})

    def migrate(self, steps: list[Migration]) -> int:
        """Runs the steps that this store hasn't seen, each a commit with its schema version; newer stores are refused."""
        version = int(self.meta(VERSION) or 0)
        if version > len(steps):
            raise ValueError(f"schema version {version} is newer than the newest known, {len(steps)}")
        for at in range(version, len(steps)):
            tables, meta = steps[at](self)
            self.commit(tables, meta | {VERSION: str(at + 1)})
        return len(steps)

    def vacuum(self) -> int:
        """Removes data and manifests that the newest commit doesn't need; only for times without readers and writers."""
        number, now = self._read()
        keep, gone = {path.split("/")[1] for path, _ in now["tables"].values()}, 0
        keep |= {c["path"].split("/")[1] for changes in now["changes"].values() for c in changes}
        held: dict[str, set[str]] = {}
        for t in now["keyed"].values():
            for b, path in [*t["base"].items(), *((b, p) for b, of in t["parts"].items() for p in of)]:
                held.setdefault(path, set()).add(f"{BUCKET}={b}")
        # a folder of which a compaction took some buckets stays for the others
        for path, kept in held.items():
            keep.add(path.split("/")[1])
            for s in self._fs.listStatus(self._path(f"{self.folder}/{path}")):
                if s.isDirectory() and s.getPath().getName() not in kept:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for folder, kept in (("data", keep), ("manifests", {str(number)})):
            where = self._path(f"{self.folder}/{folder}")
            for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if s.getPath().getName() not in kept:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone
