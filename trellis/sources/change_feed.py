"""A log of changes as a data source whose offset is a page token.

The log is a folder that all executors share. Each publication is a folder of Parquet files named by the first and last
number of its changes, and comes into being by one rename. A token is the number of the last change that was seen. What is
published behind the horizon isn't reported yet: the source goes as far as that, and hands out no token beyond it, so that
nothing is skipped once the horizon is lifted. Readers split what they are asked for into pages and never list the past.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME, PAGE, SEQ = "change_feed", 1000, "seq"
HORIZON = "horizon"


@dataclass
class Page(InputPartition):
    """The changes of one file with numbers after low, up to high."""

    path: str
    low: int
    high: int


class Log:
    """What is published in a folder, as far as it is visible."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(folder)

    def publications(self) -> list[tuple[int, int, str]]:
        """(first, last, path), in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        named = [(f.base_name.split("-"), f.path) for f in found if f.type == fs.FileType.Directory]
        return sorted((int(n[0]), int(n[1]), path) for n, path in named if len(n) == 2 and all(x.isdigit() for x in n))

    def end(self) -> int:
        """The number of the last visible change, -1 before the first."""
        last = max((last for _, last, _ in self.publications()), default=-1)
        held = f"{self.path}/{HORIZON}"
        if self.fs.get_file_info(held).type == fs.FileType.File:
            with self.fs.open_input_stream(held) as f:
                last = min(last, int(f.read()))
        return last

    def checked(self, token: int) -> int:
        if not -1 <= token <= max((last for _, last, _ in self.publications()), default=-1):
            raise ValueError(f"no page begins at token {token}")
        return token

    def pages(self, low: int, high: int, page: int) -> list[Page]:
        """Pages of at most `page` numbers of one file; a file's rows are in order, so that a page reads a part of it."""
        out = []
        for first, last, path in self.publications():
            if first <= high and last > low:
                for f in self.fs.get_file_info(fs.FileSelector(path)):
                    if f.base_name.endswith(".parquet"):
                        out += self._of_file(f.path, low, high, page)
        return out

    def _of_file(self, path: str, low: int, high: int, page: int) -> list[Page]:
        groups = list(ds.dataset(path, filesystem=self.fs, format="parquet").get_fragments())[0].row_groups
        bounds = [g.statistics[SEQ] for g in groups if g.statistics and SEQ in g.statistics]
        if not bounds:
            return []
        at, end = max(low, min(b["min"] for b in bounds) - 1), min(high, max(b["max"] for b in bounds))
        return [Page(path, x, min(x + page, end)) for x in range(at, end, page)]

    def read(self, page: Page, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = ds.dataset(page.path, filesystem=self.fs, format="parquet")
        wanted = (pc.field(SEQ) > page.low) & (pc.field(SEQ) <= page.high)
        for batch in rows.to_batches(columns=schema.names, filter=wanted):
            if batch.num_rows:
                yield batch.cast(schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class ChangeFeedStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.folder, self.page, self.first = _arrow(schema), options["path"], int(options.get("page", PAGE)), int(options.get("token", -1))
        self.seen = self.first

    def initialOffset(self) -> dict:
        return {"token": Log(self.folder).checked(self.first)}

    def latestOffset(self) -> dict:
        # a horizon that is set behind what was seen takes nothing back
        self.seen = max(self.seen, Log(self.folder).end())
        return {"token": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.seen = max(self.seen, end["token"])
        return Log(self.folder).pages(start["token"], end["token"], self.page)

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        return Log(self.folder).read(partition, self.schema) if partition else iter(())


class ChangeFeedBatch(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        log, self.schema, self.folder = Log(options["path"]), _arrow(schema), options["path"]
        self.pages = log.pages(log.checked(int(options.get("token", -1))), int(options.get("upto", log.end())), int(options.get("page", PAGE)))

    def partitions(self) -> list[Page]:
        return self.pages

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        return Log(self.folder).read(partition, self.schema) if partition else iter(())


class ChangeFeed(DataSource):
    """format("change_feed"), with a schema that has seq; options: path, token (of the last change seen), page, and for batches upto."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> ChangeFeedStream:
        return ChangeFeedStream(schema, self.options)

    def reader(self, schema: StructType) -> ChangeFeedBatch:
        return ChangeFeedBatch(schema, self.options)


def feed(spark: SparkSession, folder: str, schema: StructType, **options: str) -> DataFrame:
    """The changes as a stream, from the token on."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format(NAME).schema(schema).options(path=folder, **options).load()


def feed_page(spark: SparkSession, folder: str, schema: StructType, token: int) -> tuple[DataFrame, str]:
    """The visible changes after a token, and the token after them."""
    spark.dataSource.register(ChangeFeed)
    upto = max(token, start_token(folder))
    return spark.read.format(NAME).schema(schema).options(path=folder, token=str(token), upto=str(upto)).load(), str(upto)


def start_token(folder: str) -> int:
    return Log(folder).end()


def publish(changes: DataFrame, folder: str, files: int = 8) -> None:
    """Adds changes, which have seq, to the log; seqs that were published before may come again. An empty table adds nothing."""
    spark = changes.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = f"{folder}/draft-{uuid.uuid4().hex}"
    changes.repartitionByRange(files, SEQ).sortWithinPartitions(SEQ).write.parquet(draft)
    first, last = spark.read.schema(changes.schema).parquet(draft).agg(F.min(SEQ), F.max(SEQ)).first()
    if first is None:
        store.delete(path(draft), True)
        return
    target = path(f"{folder}/{first:020d}-{last:020d}")
    if store.exists(target) or not store.rename(path(draft), target):
        store.delete(path(draft), True)
        raise RuntimeError(f"changes {first} to {last} are published already")


def hold(folder: str, at: int | None = None) -> int:
    """Withholds what is published after a number, by default after what is visible now; the horizon."""
    log = Log(folder)
    at = log.end() if at is None else at
    with log.fs.open_output_stream(f"{log.path}/{HORIZON}-draft") as f:
        f.write(str(at).encode())
    log.fs.move(f"{log.path}/{HORIZON}-draft", f"{log.path}/{HORIZON}")
    return at


def release(folder: str) -> None:
    log = Log(folder)
    log.fs.delete_file(f"{log.path}/{HORIZON}")
