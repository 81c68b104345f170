"""Scans with file keys, guards, null tokens and sinks, in fresh temp folders."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordaudit.sources import files


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="recordaudit-test-")


def _write(path, rows):
    pd.DataFrame(rows, columns=["model_name", "Age", "Sex"]).to_parquet(path, index=False)


def test_scan_with_file_keys(spark, tmp):
    _write(os.path.join(tmp, "qwen-7B_v5.1.parquet"), [("qwen-7B", "25", "Male"), ("qwen-7B", "NA", None)])
    _write(os.path.join(tmp, "glm-9B_v5.1_sex_chinese_statistics.parquet"), [("glm-9B", "30岁", "女")])
    with open(os.path.join(tmp, "notes.txt"), "w") as f:
        f.write("not data")
    df = files.scan(spark, tmp, glob="*.parquet", keys={
        "model": files.model_before(F.col("file_name"), "_v5.1"),
        "language": files.language_from_file(F.col("file_name")),
        "stem": files.model_from_file(F.col("file_name"))})
    got = sorted((r.model, r.language, r.stem) for r in df.select("model", "language", "stem").distinct().collect())
    assert got == [("glm-9B", "Chinese", "glm-9B_v5.1_sex_chinese_statistics"), ("qwen-7B", "English", "qwen-7B")]
    assert df.count() == 3


def test_corrupt_files_are_skipped_and_reported(spark, tmp):
    _write(os.path.join(tmp, "a_v1.parquet"), [("a", "1", "M")])
    with open(os.path.join(tmp, "b_v1.parquet"), "wb") as f:
        f.write(b"garbage")
    df = files.scan(spark, tmp, glob="*.parquet", ignore_corrupt=True,
                    schema="model_name string, Age string, Sex string")
    assert df.count() == 1
    assert [r.file_name for r in files.skipped_files(spark, tmp, df, glob="*.parquet").collect()] == ["b_v1.parquet"]


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert files.require_columns(df, ["a", "zz"], on_missing="skip") is None
    with pytest.raises(ValueError):
        files.require_columns(df, ["zz"])
    assert files.require_columns(df, ["a"], ["b", "c"]).columns == ["a", "b", "c"]


def test_normalize_nulls_and_shape(spark):
    df = spark.createDataFrame([("NA", 1), ("ok", 2), ("", 3)], "s string, n int")
    assert [r.s for r in files.normalize_nulls(df).orderBy("n").collect()] == [None, "ok", None]
    shape = {r.column: (r.type, r.n_rows, r.n_columns) for r in files.shape_report(df).collect()}
    assert shape == {"s": ("string", 3, 2), "n": ("int", 3, 2)}


def test_sinks_roundtrip(spark, tmp):
    df = spark.createDataFrame([("m1", "flu", "en", 1), ("m1", "flu", "zh", 2), ("m2", "cold", "en", 3)],
                               "model string, disease string, language string, v int")
    files.write_report(df, os.path.join(tmp, "report"), fmt="csv")
    back = files.read_csv(spark, os.path.join(tmp, "report"), "model string, disease string, language string, v int")
    assert sorted(back.collect()) == sorted(df.collect())
    files.write_partitioned(df, os.path.join(tmp, "parts"), ["model", "language"])
    assert sorted(os.listdir(os.path.join(tmp, "parts", "model=m1"))) == ["language=en", "language=zh"]
    target = files.write_version(df, os.path.join(tmp, "ds"), "v1")
    v1 = spark.read.parquet(target)
    with pytest.raises(ValueError):
        files.write_version(v1, os.path.join(tmp, "ds"), "v1")
    files.write_version(v1.withColumn("v", F.col("v") + 1), os.path.join(tmp, "ds"), "v2")
    files.write_version(v1.withColumn("v", F.col("v") + 1), os.path.join(tmp, "ds"), "v2")  # a rerun replaces
    assert spark.read.parquet(os.path.join(tmp, "ds", "version=v2")).count() == 3


def test_bundle(spark, tmp):
    for name, rows in (("prompt_base", [("p1", "q1")]), ("prompt_alter", [("b1", "c1"), ("b2", "c2")])):
        spark.createDataFrame(rows, "English string, Chinese string").write.parquet(os.path.join(tmp, f"{name}.parquet"))
    bundle = files.load_bundle(spark, tmp, ["prompt_base", "prompt_alter"])
    assert {k: v.count() for k, v in bundle.items()} == {"prompt_base": 1, "prompt_alter": 2}


def test_version_rewrite_and_filters(spark):
    df = spark.createDataFrame([("gemma_v3.0.xlsx",), ("a_SEX_b.xlsx",), ("plain.xlsx",)], "n string")
    rows = df.select(files.rewrite_version(F.col("n"), [(r"_v3\.0", "_v3.2")]).alias("r"),
                     files.name_matches(F.col("n"), ["_sex_", "statistics"]).alias("m")).collect()
    assert [r.r for r in rows] == ["gemma_v3.2.xlsx", "a_SEX_b.xlsx", "plain.xlsx"]
    assert [r.m for r in rows] == [False, True, False]
