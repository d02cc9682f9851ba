import hashlib

import pytest

from lodestar.sources import files


def test_inventory_and_mapping(spark, tmp_path):
    (tmp_path / "m.csv").write_text("entity,group\na,x\nb,y\n")
    r = files.inventory(spark, str(tmp_path), "*.csv").first()
    assert r.bytes == 21 and r.sha256 == hashlib.sha256((tmp_path / "m.csv").read_bytes()).hexdigest()
    assert files.read_mapping(spark, str(tmp_path / "m.csv")).count() == 2
    for bad in ("entity,group\n", "entity,group\na,\n", "entity,group\na,x\na,y\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            files.read_mapping(spark, str(tmp_path / "bad.csv"))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.write_typed(spark.createDataFrame([("1",)], "a string"), path, "a int")
    with pytest.raises(Exception):
        files.write_typed(spark.createDataFrame([("x",)], "a string"), path, "a int")
    assert [r.a for r in spark.read.parquet(path).collect()] == [1]
    files.write_typed(spark.createDataFrame([("2",)], "a string"), path, "a int")
    assert [r.a for r in spark.read.parquet(path).collect()] == [2]


def test_strict_series(spark):
    df = spark.createDataFrame([(1, "2020-01-02", "2.5"), (1, "2020-01-01", "1"), (1, "2021-01-01", "9"), (2, "x", "y")], "entity long, trade_date string, close string")
    assert [r.close for r in files.strict_series(df, 1, "2020-12-31").collect()] == [1.0, 2.5]
    for bad in (2, ):
        with pytest.raises(ValueError):
            files.strict_series(df, bad, "2020-12-31")
    with pytest.raises(ValueError):
        files.strict_series(df.drop("close"), 1, "2020-12-31")


def test_nested_documents_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind": "k", "as_of": "2020-01-01", "records": [{"e": 1}, {"e": 2}]}')
    heads, rows = files.nested_documents(spark, str(tmp_path / "a.json"), "struct<e: long>")
    assert heads.first().n == 2 and sorted((r.position, r.e) for r in rows.collect()) == [(0, 1), (1, 2)]
    files.write_typed(rows, str(tmp_path / "t"), "e int, kind string")
    assert spark.read.parquet(str(tmp_path / "t")).dtypes == [("e", "int"), ("kind", "string")]
    assert files.read_snapshot(spark, f"file://{tmp_path}", "none", "2020-01-01", "e int").count() == 0


def test_mapping_round_trip(spark, tmp_path):
    path = str(tmp_path / "mapping")
    rows = spark.createDataFrame([("b", "x,1"), ("a", 'y "z"'), ("c", "x,1")], "entity string, `group` string")
    for df in (rows.limit(1), rows):
        files.write_mapping(df, path)
    assert [tuple(r) for r in files.read_mapping(spark, path).orderBy("entity").collect()] == [("a", 'y "z"'), ("b", "x,1"), ("c", "x,1")]
