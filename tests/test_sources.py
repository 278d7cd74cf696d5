import hashlib
import os

import pytest

from trellis.functions.paths import TEMP_PREFIX
from trellis.sources.folder import scanned, temporary
from trellis.sources.settings import settings
from trellis.sources.store import Store

BASE = "rel_path string, is_dir boolean, size long, mtime_ns long, md5 string"


def test_a_folder_is_scanned(spark, tmp_path):
    files = {"a.txt": b"one", "d/b.txt": b"two", "d/e/c.txt": b"", "skip/x.txt": b"no", "d/y.tmp": b"no", "d/" + TEMP_PREFIX + "1": b"no"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    os.mkfifo(tmp_path / "d/pipe")
    at = (tmp_path / "a.txt").stat().st_mtime_ns
    base = spark.createDataFrame([("a.txt", False, 3, at, "known"), ("d/b.txt", False, 3, 1, "old"), ("d", True, 0, 0, "")], BASE)
    rows, skips = scanned(spark, str(tmp_path), base, ["*.tmp", "skip"])
    md5 = lambda b: hashlib.md5(b).hexdigest()
    assert {(r["rel_path"], r["is_dir"], r["size"], r["md5"]) for r in rows.collect()} == {("a.txt", False, 3, "known"), ("d", True, 0, ""), ("d/b.txt", False, 3, md5(b"two")), ("d/e", True, 0, ""), ("d/e/c.txt", False, 0, md5(b""))}
    assert {tuple(r) for r in skips.collect()} == {("link", "a link, which is left alone", False), ("d/pipe", "neither file nor directory", False)}
    assert [r["rel_path"] for r in temporary(spark, str(tmp_path)).collect()] == ["d/" + TEMP_PREFIX + "1"]


def test_an_empty_folder_and_one_that_is_not_there(spark, tmp_path):
    base = spark.createDataFrame([], BASE)
    rows, skips = scanned(spark, str(tmp_path), base, [])
    assert rows.isEmpty() and skips.isEmpty()
    with pytest.raises(Exception, match="No such file"):
        scanned(spark, str(tmp_path / "none"), base, [])


def test_settings():
    assert settings("").engine.poll_interval_secs == 45
    s = settings('[engine]\nmachine_name = "box-1"\nignore = ["*.bak"]\nmass_delete_threshold = 1\n[local]\nsync_dir = "/x"')
    assert (s.engine.machine_name, s.engine.ignore, s.engine.mass_delete_threshold, s.local.sync_dir) == ("box-1", ("*.bak",), 1, "/x")
    for text in ("[engine]\npoll = 1", "[other]\na = 1", "[engine]\npoll_interval_secs = 0", "[engine]\nmass_delete_threshold = 1.5", '[engine]\nmachine_name = "a b"', '[engine]\npoll_interval_secs = "x"', '[local]\nsync_dir = ""'):
        with pytest.raises(ValueError):
            settings(text)


def test_tables_are_committed_together(spark, tmp_path):
    store, one = Store(spark, f"file://{tmp_path}/s"), lambda *rows: spark.createDataFrame([(r,) for r in rows], "k long")
    assert store.migrate([lambda s: ({"items": one(), "journal": one()}, {})]) == 1 and store.meta("schema_version") == "1"
    store.commit({"items": one(1, 2), "journal": one(7)}, {"token": "5"})
    before = store.table("items")
    assert store.commit({"items": one(3)}) == 3
    assert [r["k"] for r in store.table("items").collect()] == [3] and [r["k"] for r in store.table("journal").collect()] == [7] and store.meta("token") == "5"
    assert sorted(r["k"] for r in before.collect()) == [1, 2]
    other = Store(spark, f"file://{tmp_path}/s")
    taken = other._read
    other._read = lambda: (2, taken()[1])
    with pytest.raises(RuntimeError):
        other.commit({"items": one(9)})
    store.reset("items", "journal")
    assert store.table("items").isEmpty() and store.table("journal").isEmpty() and store.tables() == ["items", "journal"]
    assert store.migrate([lambda s: ({}, {}), lambda s: ({"items": s.table("items").selectExpr("k", "'new' as name")}, {})]) == 2
    assert store.table("items").columns == ["k", "name"]
    assert store.vacuum() > 0 and store.table("items").isEmpty() and store.meta("token") == "5"
    with pytest.raises(ValueError):
        store.migrate([])


def test_a_view_is_one_file_or_none(spark, tmp_path):
    from trellis.sources.json_view import JsonViewWriter, write_view

    folder = f"file://{tmp_path}/views"
    rows = spark.createDataFrame([(i, '{"n":%d}' % i) for i in range(40)], "ord long, json string").repartition(5)
    write_view(rows, folder, "status")
    assert (tmp_path / "views/status.json").read_text() == "".join('{"n":%d}\n' % i for i in range(40))
    assert [p.name for p in (tmp_path / "views").iterdir()] == ["status.json"]
    # a task that fails takes the write with it, and the old file stays
    import pytest

    with pytest.raises(Exception):
        write_view(rows.union(spark.createDataFrame([(41, "{broken")], "ord long, json string")), folder, "status")
    assert [p.name for p in (tmp_path / "views").iterdir()] == ["status.json"]
    assert len((tmp_path / "views/status.json").read_text().splitlines()) == 40
    write_view(rows.limit(0), folder, "status")
    assert (tmp_path / "views/status.json").read_text() == ""
    small = JsonViewWriter({"path": folder, "name": "big", "most_bytes": "10"})
    part = small.write(iter([{"ord": 1, "json": '{"a":"0123456789"}'}]))
    with pytest.raises(ValueError, match="at most 10 bytes"):
        small.commit([part])
    assert [p.name for p in (tmp_path / "views").iterdir()] == ["status.json"]


def test_a_lookup_opens_the_files_of_its_keys(spark, tmp_path):
    import shutil
    from pathlib import Path

    from pyspark.sql import functions as F

    from trellis.sources.clustered import clustered

    rows = spark.range(2000).select(F.format_string("k%05d", F.when(F.col("id") % 10 == 3, 777).otherwise(F.col("id"))).alias("key"), "id").union(spark.createDataFrame([(None, -1)], "key string, id long"))
    t = clustered(rows, "key", 20, f"file://{tmp_path}/t")
    keys = spark.createDataFrame([("k00004",), ("k00005",), ("k00005",), ("k01999",), ("none",), ("",), (None,)], "key string")
    files = t.files(keys)
    assert 1 <= len(files) <= 3 < len(t.bounds())
    for f in Path(tmp_path / "t/rows").glob("*.parquet"):
        if not any(x.endswith(f.name) for x in files):
            shutil.move(f, tmp_path / f.name)
    assert sorted(r["id"] for r in t.lookup(keys).collect()) == [4, 5, 1999]
    for f in tmp_path.glob("*.parquet"):
        shutil.move(f, tmp_path / "t/rows" / f.name)
    assert t.lookup(spark.createDataFrame([("k00777",)], "key string")).count() == 201
    assert t.lookup(keys.limit(0)).count() == 0
    empty = clustered(rows.limit(0), "key", 4, f"file://{tmp_path}/e")
    assert empty.lookup(keys).count() == 0


def test_changes_lie_beside_a_table_until_it_is_written_anew(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *of: spark.createDataFrame(list(of), "id string, path string, n long")
    held = lambda **k: {tuple(r) for r in store.table("t", **k).collect()}
    store.commit({"t": rows(("a", "p", 1), ("b", "q", 1), ("c", "r", 1), (None, "s", 1))})
    # what is at a path goes too, rows without an id meet nothing, and rows of one change leave each other alone
    first = store.change("t", rows(("a", "q", 2), ("d", "q", 2), (None, "t", 2)), "id", "path")
    assert len(held()) == 4
    store.commit({"t": [first]})
    assert held() == {("a", "q", 2), ("d", "q", 2), (None, "t", 2), ("c", "r", 1), (None, "s", 1)}
    gone = store.change("t", spark.createDataFrame([("c", "q")], "id string, was string"), ("path", "was"), "id", gives=False)
    again = store.change("t", rows(("c", "q", 3)))
    store.commit({"t": [gone, again]})
    assert held() == {("c", "q", 3), (None, "t", 2), (None, "s", 1)} and store.table("t").columns == ["id", "path", "n"]
    assert held(among=spark.createDataFrame([("q",), ("r",), ("p",)], "path string")) == {("c", "q", 3)}
    assert held(shape=lambda df: df.select("path", "id")) == {("q", "c"), ("t", None), ("s", None)}
    store.vacuum()
    assert len(held()) == 3 and store.changes("t") == 3
    store.commit({"t": store.table("t")})
    assert len(held()) == 3 and store.changes("t") == 0
    with pytest.raises(ValueError):
        store.commit({"other": [first]})
