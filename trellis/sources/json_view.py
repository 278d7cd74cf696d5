"""A sink for views: each commit leaves one file of JSON lines, in the order of `ord`, or none.

Tasks write parts beside each other and tell where; the commit puts these together and gives the result its name at once. An
aborted write removes its parts. Views are bounded lists, so that the one file is small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, MOST_BYTES = "json_view", 64 << 20


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int
    n_bytes: int


class JsonViewWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.name, self.most = options["path"], options.get("name", "view"), int(options.get("most_bytes", MOST_BYTES))
        self.drafts = f"_draft-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Part:
        rows = sorted((r["ord"], r["json"]) for r in iterator)
        for _, text in rows:
            json.loads(text)
        store, root = self._store()
        path, raw = f"{root}/{self.drafts}/{uuid.uuid4().hex}", "".join(f"{o}\t{text}\n" for o, text in rows).encode()
        if rows:
            store.create_dir(f"{root}/{self.drafts}", recursive=True)
            with store.open_output_stream(path) as f:
                f.write(raw)
        return Part(path, rows[0][0] if rows else -1, len(raw))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.n_bytes]
        if sum(p.n_bytes for p in parts) > self.most:
            self.abort(messages)
            raise ValueError(f"a view has at most {self.most} bytes")
        store, root = self._store()
        lines = []
        for p in parts:
            with store.open_input_stream(p.path) as f:
                lines += [line.split("\t", 1) for line in f.read().decode().split("\n") if line]
        store.create_dir(f"{root}/{self.drafts}", recursive=True)
        whole = f"{root}/{self.drafts}/whole"
        with store.open_output_stream(whole) as f:
            f.write("".join(text + "\n" for _, text in sorted(lines, key=lambda x: int(x[0]))).encode())
        store.move(whole, f"{root}/{self.name}.json")
        store.delete_dir(f"{root}/{self.drafts}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.drafts}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.drafts}")


class JsonView(DataSource):
    """format("json_view"): rows of ord (long) and json (a text of JSON); options path, name and most_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> JsonViewWriter:
        if {f.name: f.dataType.simpleString() for f in schema} != {"ord": "bigint", "json": "string"}:
            raise ValueError("a view has the columns ord (long) and json (string)")
        return JsonViewWriter(self.options)


def write_view(rows: DataFrame, folder: str, name: str) -> None:
    rows.sparkSession.dataSource.register(JsonView)
    rows.select("ord", "json").write.format(NAME).mode("append").options(path=folder, name=name).save()
