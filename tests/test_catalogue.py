"""The file catalogue: footers and headers read by tasks, merged by an associative union."""

import datetime as dt
import gzip
import itertools

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recordaudit.sources import catalogue, files


def test_parquet_footers(spark, tmp_path):
    pd.DataFrame({"a": [1, 2], "b": ["x", None]}).to_parquet(tmp_path / "one file.parquet", index=False)
    spark.range(5).select("id", F.lit(dt.date(2024, 1, 1)).alias("d"), F.array(F.lit(1.5)).alias("v")).coalesce(1).write.parquet(str(tmp_path / "two"))
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    pq.write_table(pa.table({"e": pa.array([], pa.int32())}), tmp_path / "empty.parquet")
    cat = catalogue.catalogue(spark, str(tmp_path), recursive=True, glob="*.parquet")
    rows = {r.path.rsplit("/", 1)[1][:9]: r for r in cat.collect()}
    assert len(rows) == 4
    assert [tuple(c) for c in rows["one file."].columns] == [("a", "bigint"), ("b", "string")] and rows["one file."].rows == 2
    assert [tuple(c) for c in rows["part-0000"].columns] == [("id", "bigint"), ("d", "date"), ("v", "array<double>")]
    assert rows["empty.par"].rows == 0 and rows["bad.parqu"].columns is None and rows["bad.parqu"].error
    assert [r.path.endswith("bad.parquet") for r in catalogue.unreadable(cat).collect()] == [True]
    short = catalogue.lacking(cat, ["a", "id"]).collect()
    assert {(r.path.rsplit("/", 1)[1][:5], tuple(r.missing)) for r in short} == {("one f", ("id",)), ("part-", ("a",)), ("empty", ("a", "id"))}


def test_csv_headers_and_json_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Age,\"Se,x\"\r\n1,2\r\n".encode())
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"Age\n" + b"1\n" * 50_000))
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("x" * 40_000 + ",Age")
    cat = {r.path.rsplit("/", 1)[1]: [c.name for c in r.columns] for r in catalogue.catalogue(spark, str(tmp_path), "csv").collect()}
    assert cat == {"a.csv": ["Age", "Se,x"], "b.csv.gz": ["Age"], "d.csv": ["x" * 40_000, "Age"]}
    js = tmp_path / "js"
    js.mkdir()
    (js / "a.json").write_text('{"v": 1}\n{"w": {"x": 2}}\nnot json\n')
    (js / "b.json").write_text("\n")
    cat = {r.path.rsplit("/", 1)[1]: [c.name for c in r.columns] for r in catalogue.catalogue(spark, str(js), "json").collect()}
    assert cat == {"a.json": ["v", "w"], "b.json": []}


def test_the_union_does_not_depend_on_the_order(spark):
    files_ = [[("a", "int"), ("b", "string")], [("a", "bigint")], [("b", "string"), ("a", "tinyint"), ("c", "date")], [("c", "timestamp_ntz")],
              [("d", "int")], [("d", "double")]]
    want = None
    for order in itertools.islice(itertools.permutations(files_), 0, 720, 240):
        rows = [(f"p{k}", 1, [tuple(c) for c in f], 0, None, None) for k, f in enumerate(order)]
        cat = spark.createDataFrame(rows, catalogue.SCHEMA)
        got = sorted((r.column, r.type, r.files, r.place) for r in catalogue.schema_union(cat).collect())
        want = want or got
        assert got == want
    assert [(c, t, n) for c, t, n, _ in want] == [("a", "bigint", 3), ("b", "string", 2), ("c", "timestamp_ntz", 2), ("d", "double", 2)]
    assert catalogue.union_schema(cat).fieldNames() == ["a", "b", "c", "d"] or set(catalogue.union_schema(cat).fieldNames()) == set("abcd")
    clash = spark.createDataFrame([("p", 1, [("a", "string")], 0, None, None), ("q", 1, [("a", "int")], 0, None, None)], catalogue.SCHEMA)
    with pytest.raises(ValueError, match="'a'"):
        catalogue.union_schema(clash)
    assert catalogue.union_schema(clash.limit(0)).fieldNames() == []


def test_many_files_without_a_read_on_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_first_line", lambda *a: pytest.fail("the driver read a header"))
    for k in range(1500):
        (tmp_path / f"m{k}.csv").write_text("Age,Sex\n1,x\n" if k % 3 else "Sex,Age,More\nx,1,y\n")
    df = files.scan(spark, str(tmp_path), fmt="csv", required=["Age"])
    assert df.agg(F.count("Age"), F.sum("Age"), F.count("More")).first()[:] == (1500, 1500.0, 500)
    (tmp_path / "bad.csv").write_bytes(b"Other\n1\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.scan(spark, str(tmp_path), fmt="csv", required=["Age"])
