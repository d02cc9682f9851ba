"""Commits beside other writers and after crashes, gated sinks, inventories, keyed merges and positions."""

import hashlib
import json
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.sources import commits, files, landing


def many(spark, n):
    return spark.range(n).withColumn("x", F.lit("a"))


def test_one_of_many_writers_is_first(spark, tmp_path):
    top, told = f"file://{tmp_path}/s", {}

    def write(who, n):
        try:
            told[who] = landing.write_snapshot(many(spark, n), top, "kind", "2020-01-01")
        except ValueError as e:
            told[who] = str(e)

    writers = [threading.Thread(target=write, args=(who, n)) for who, n in enumerate((10, 10, 10, 20, 20, 20))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    found = files.read_snapshot(spark, top, "kind", "2020-01-01", "id long, x string").count()
    assert list(told.values()).count("written") == 1
    assert found in (10, 20) and list(told.values()).count("same") == 2
    assert sum("a different snapshot" in t for t in told.values()) == 3
    assert commits.sweep(spark, f"{top}/kind=kind/as_of=2020-01-01") == []  # the others left nothing


def test_what_a_dead_writer_leaves_is_not_seen(spark, tmp_path):
    top = f"file://{tmp_path}/s"
    left = commits.stage(many(spark, 3), f"{top}/kind=k/as_of=2020-01-01", "data")
    assert files.read_snapshot(spark, top, "k", "2020-01-01", "id long").count() == 0 and landing.snapshot_days(spark, top, "k") == []
    assert landing.write_snapshot(many(spark, 4), top, "k", "2020-01-01") == "written"
    assert landing.snapshot_days(spark, top, "k") == ["2020-01-01"] and landing.snapshot_days(spark, top, "none") == []
    assert commits.sweep(spark, f"{top}/kind=k/as_of=2020-01-01") == [left]
    assert files.read_snapshot(spark, top, "k", "2020-01-01", "id long").count() == 4


def test_rows_and_findings_come_together_or_not(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    rows = spark.createDataFrame([("1",), ("2",)], "a string")
    bad = spark.createDataFrame([("x",)], "a string")
    assert commits.read(spark, folder, "rows") is None
    files.write_gated(rows, folder, "a int", rows.where("a = '2'"), gate="g1")
    fails = rows.withColumn("b", F.raise_error(F.lit("no findings")).cast("string"))
    for df, findings in ((bad, rows), (rows.limit(1), fails)):
        with pytest.raises(Exception):
            files.write_gated(df, folder, "a int", findings)
        assert commits.read(spark, folder, "rows").count() == 2 and commits.read(spark, folder, "findings").count() == 1
    held = commits.read(spark, folder, "rows")
    files.write_gated(rows.limit(1), folder, "a int", rows.limit(0), gate="g2")
    assert held.count() == 2  # a reader that began before goes on
    assert commits.read(spark, folder, "rows").count() == 1 and commits.read(spark, folder, "findings").count() == 0
    assert commits.current(spark, folder)["gate"] == "g2"
    assert len(commits.sweep(spark, folder)) == 5  # two of the first commit, and what two failures left


def test_inventory_of_odd_files(spark, tmp_path, monkeypatch):
    put = lambda name, data: (tmp_path / name).parent.mkdir(exist_ok=True) or (tmp_path / name).write_bytes(data)
    put("d/ok.csv", "a,b\n1,\"x\ny\"\n2,z\n".encode())
    put("d/head.csv", b"a,b\n")
    put("d/nothing.csv", b"")
    put("d/wide.csv", b"a,b\n1,2,3\n")
    put("d/bytes.csv", b"a\n\xff\xfe\n")
    put("d/ok.json", json.dumps({"as_of": "2020-01-01", "records": [{"e": 1}, {"f": 2}]}).encode())
    put("d/none.json", b'{"records": []}')
    put("d/other.json", b'{"k": 1}')
    put("d/cut.json", b'{"records": [')
    put("d/cut.parquet", b"PAR1")
    put("d/x.yaml", b"k: v\n")
    pq.write_table(pa.table({"k": [1, 2, 3]}), tmp_path / "d/ok.parquet")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path / "d")).collect()}
    told = {name: (r.state, r.rows, r.columns) for name, r in got.items()}
    assert told == {
        "ok.csv": ("ok", 2, ["a", "b"]), "head.csv": ("empty", 0, ["a", "b"]), "nothing.csv": ("empty", 0, []), "wide.csv": ("corrupt", None, None), "bytes.csv": ("corrupt", None, None),
        "ok.json": ("ok", 2, ["e", "f"]), "none.json": ("empty", 0, []), "other.json": ("other_shape", None, ["k"]), "cut.json": ("corrupt", None, None),
        "cut.parquet": ("corrupt", None, None), "x.yaml": ("opaque", None, None), "ok.parquet": ("ok", 3, ["k"]),
    }
    assert got["ok.json"].declared_as_of == "2020-01-01"
    for name, r in got.items():
        data = (tmp_path / "d" / name).read_bytes()
        assert r.bytes == len(data) and r.sha256 == hashlib.sha256(data).hexdigest()
    monkeypatch.setattr(files, "WHOLE", 10)
    large = {r.path.rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path / "d"), "*.csv").collect()}
    assert large["ok.csv"].state == "large" and large["ok.csv"].sha256 == got["ok.csv"].sha256 and large["head.csv"].state == "empty"


def test_roots_that_are_not_there(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.csv").write_text("k\n1\n")
    got = sorted(tuple(r) for r in files.roots(spark, str(tmp_path), ["a", "b", "c"], "*.csv").collect())
    assert got == [("a", True, 1, 4), ("b", True, 0, 0), ("c", False, 0, 0)]
    assert [tuple(r) for r in files.roots(spark, str(tmp_path), ["c"]).collect()] == [("c", False, 0, 0)]
    with pytest.raises(FileNotFoundError):
        files.roots(spark, str(tmp_path / "none"), ["a"])


def test_null_keys_are_replaced_and_counted(spark, tmp_path):
    old = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (None, None, "c"), (2, 2, "d")], "k long, j long, v string")
    new = spark.createDataFrame([(None, 1, "A", 1), (None, None, "C", 2), (3, None, "E", 3), (3, None, "F", 4)], "k long, j long, v string, w long")
    assert sorted(r.v for r in landing.merge(old, new, ["k", "j"]).collect()) == ["A", "C", "E", "F", "b", "d"]
    path = f"file://{tmp_path}/t"
    assert landing.merge_into(path, old, ["k", "j"]) == (4, 4)
    assert landing.merge_into(path, new, ["k", "j"]) == (4, 6)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["A", "C", "E", "F", "b", "d"]


def test_single_values(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None), (3, None), (4, "x"), (4, "y")], "k long, v string")
    assert {r.k: r.v for r in landing.single_value(df, "v", ["k"]).collect()} == {1: "x", 2: None, 3: None, 4: None}
    assert landing.single_value(df.where("k = 1"), "v").first().v == "x"
    assert landing.single_value(df.where("k = 9"), "v").first().v is None and landing.single_value(df, "none").first().none is None


def test_a_run_keeps_its_place(spark):
    log = spark.createDataFrame([("d1", "a", "OK", 0), ("d1", "b", "OK", 1), ("d1", None, "OK", 2)], "day string, stage string, status string, position long")
    runs = spark.createDataFrame([("d1", "b", "FAILED", 1), ("d1", "z", "OK", 2), ("d1", "b", "RETRIED", 3), ("d1", "c", "OK", 4), ("d2", "c", "OK", 5), ("d1", None, "N", 6)], "day string, stage string, status string, n long")
    out = landing.upsert(log, runs, "day", ["stage"], "n").orderBy("day", "position").collect()
    assert [(r.day, r.stage, r.status, r.position) for r in out] == [("d1", "a", "OK", 0), ("d1", "b", "RETRIED", 1), ("d1", None, "N", 2), ("d1", "z", "OK", 3), ("d1", "c", "OK", 4), ("d2", "c", "OK", 0)]


def test_identities_from_text(spark):
    label, board = landing.ENTITY_LABEL, landing.BOARD_LABEL
    texts = [f"x **{label}**：600519.SH y **{board}**: B1", f"**{board}**:\n B2", f"**{label}**: A **{label}**: B", "no label", None, f"**other**: **{label}**: C"]
    rows = spark.createDataFrame([(n, "t", t) for n, t in enumerate(texts)], "n int, type string, content string")
    got = {r.n: r.about for r in rows.select("n", landing.block_identity(F.col("type"), F.col("content"))["about"].alias("about")).collect()}
    digest = lambda t: "sha256 " + hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: "600519.SH", 1: "B2", 2: "B", 3: digest("no label"), 4: digest(""), 5: digest(texts[5])}
    old = spark.createDataFrame([("t", "no label", "o1", 0), ("t", f"**{board}**: B2", "o2", 1), ("u", "no label", "o3", 2)], "type string, content string, extra string, position long")
    new = spark.createDataFrame([("t", f"**{board}**: B2 newer", 0), ("t", f"**{label}**: E", 1)], "type string, content string, position long")
    out = landing.merge_blocks(old, new).orderBy("position").collect()
    assert [(r.type, r.content, r.extra) for r in out] == [("t", "no label", "o1"), ("t", f"**{board}**: B2 newer", None), ("u", "no label", "o3"), ("t", f"**{label}**: E", None)]
