"""Files with other headers, other schemas, and broken files."""

import gzip
import json
import os

import pandas as pd
import pytest

from recordaudit.operators import align, contingency
from recordaudit.plans import jobs
from recordaudit.sources import files


def test_csv_files_are_united_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a_v1.csv").write_text("Age,Sex\n25,Male\n")
    (tmp_path / "b_v1.csv").write_text("Sex,Age,Extra\nFemale,30,x\n")
    rows = {r.file_name: r for r in files.scan(spark, str(tmp_path), fmt="csv").collect()}
    assert (rows["a_v1.csv"].Age, rows["a_v1.csv"].Sex, rows["a_v1.csv"].Extra) == ("25", "Male", None)
    assert (rows["b_v1.csv"].Age, rows["b_v1.csv"].Sex, rows["b_v1.csv"].Extra) == ("30", "Female", "x")


def test_parquet_schemas_merge_and_bad_files_are_listed(spark, tmp_path):
    pd.DataFrame({"Age": ["1"]}).to_parquet(tmp_path / "a.parquet", index=False)
    pd.DataFrame({"Age": ["2"], "Age_Chinese": ["3"]}).to_parquet(tmp_path / "b.parquet", index=False)
    df = files.scan(spark, str(tmp_path))
    assert {(r.Age, r.Age_Chinese) for r in df.collect()} == {("1", None), ("2", "3")}
    (tmp_path / "c.parquet").write_bytes(b"garbage that is no parquet file")
    with pytest.raises(Exception):
        files.scan(spark, str(tmp_path)).collect()
    df = files.scan(spark, str(tmp_path), ignore_corrupt=True)
    assert {(r.Age, r.Age_Chinese) for r in df.collect()} == {("1", None), ("2", "3")}
    bad = files.corrupt_files(spark, str(tmp_path)).collect()
    assert [os.path.basename(r.path) for r in bad] == ["c.parquet"] and bad[0].reason and bad[0].path.startswith("file:")


def test_a_truncated_file_is_left_out_whole(spark, tmp_path):
    raw = gzip.compress("".join(json.dumps({"v": i}) + "\n" for i in range(20_000)).encode())
    (tmp_path / "cut.json.gz").write_bytes(raw[:len(raw) // 2])
    (tmp_path / "ok.json.gz").write_bytes(gzip.compress(b'{"v": 1}\n'))
    df = files.scan(spark, str(tmp_path), fmt="json", ignore_corrupt=True)
    assert [r.v for r in df.collect()] == [1]
    assert [os.path.basename(r.path) for r in files.corrupt_files(spark, str(tmp_path), "json").collect()] == ["cut.json.gz"]


def test_column_guard_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Age,Sex\n25,Male\n")
    (tmp_path / "b.csv").write_text("Other\n1\n")
    with pytest.raises(ValueError, match="b.csv"):
        files.scan(spark, str(tmp_path), fmt="csv", required=["Age"])
    kept = files.scan(spark, str(tmp_path), fmt="csv", required=["Age"], on_missing="skip")
    assert [r.file_name for r in kept.collect()] == ["a.csv"]


def test_versions_compare_whole_segments_and_point_to_the_last(spark, tmp_path):
    base = str(tmp_path / "ds")
    files.write_version(spark.range(3), base, "v3.1")
    df = spark.read.parquet(f"{base}/version=v3.1")
    files.write_version(df, base, "v3")
    assert files.current_version(spark, base) == "v3"
    with pytest.raises(ValueError, match="refusing"):
        files.write_version(df, base, "v3.1")


def test_files_per_key_are_bounded_by_rows(spark, tmp_path):
    df = spark.range(3000).selectExpr("id % 30 as k", "id").repartition(50)
    files.write_partitioned(df, str(tmp_path / "out"), ["k"])
    n = sum(f.startswith("part-") for _, _, fs in os.walk(tmp_path / "out") for f in fs)
    assert n == 30 and spark.read.parquet(str(tmp_path / "out")).count() == 3000
    files.write_partitioned(df, str(tmp_path / "more"), ["k"], rows_per_file=40)
    assert spark.read.parquet(str(tmp_path / "more")).count() == 3000


def test_chi_square_frame_is_full(spark):
    rec = spark.createDataFrame([("m", "T1DM", "Female"), ("m", "T1DM", "Male"), ("m", "other", "Male")],
                                "model_name string, disease string, Sex string")
    real = spark.createDataFrame([("T1DM", 5, 5), ("T2DM", 7, 3), ("GDM", 9, 0)], "disease string, female bigint, male bigint")
    out = {r.disease: r for r in contingency.gender_chi_square(rec, real, columns={"English": "Sex"}, expected=True).collect()}
    assert set(out) == {"T1DM", "T2DM", "GDM", "other"}
    assert out["T1DM"].status == "ok" and out["T1DM"].expected_female == 1.0
    assert (out["T2DM"].female, out["T2DM"].male, out["T2DM"].status) == (0, 0, "degenerate")
    assert out["other"].status == "missing" and out["other"].chi2 is None


def test_chi_square_from_model_reports(spark):
    report = spark.createDataFrame([("qwen_v5.csv", "女", "12 (40%)", "3"), ("qwen_v5.csv", "male", "18 (60%)", "4")],
                                   "file_name string, gender string, `Type 1 diabetes` string, gdm string")
    real = contingency.real_from_report(spark.createDataFrame([("female", "10", "9"), ("male", "20", "1")],
                                                              "gender string, T1DM string, GDM string"))
    assert {(r.disease, r.female, r.male) for r in real.collect()} == {("T1DM", 10, 20), ("GDM", 9, 1)}
    out = {r.disease: r for r in contingency.chi_square_from_reports(report, real).collect()}
    assert (out["Type 1 diabetes"].female, out["Type 1 diabetes"].real_female, out["Type 1 diabetes"].model) == (12, 10, "qwen")
    assert out["gdm"].real_male == 1 and out["gdm"].status == "ok"


def test_home_list_and_home_table_agree(spark):
    from recordaudit.operators import coverage

    rec = spark.createDataFrame([("m", "江苏省", "南京市", "玄武区"), ("m", None, None, "鼓楼区")],
                                "model_name string, Province_Chinese string, City_Chinese string, District_Chinese string")
    gaz = spark.createDataFrame([("江苏省", "南京市", "玄武区"), ("江苏省", "南京市", "鼓楼区")], "`省` string, `地级市` string, `县区` string")
    home = spark.createDataFrame([("玄武区",)], "d string")
    a = coverage.location_summary(rec, gaz, ["玄武区"]).first()
    b = coverage.location_summary(rec, gaz, home).first()
    assert a == b and a.Out_Of_Home_Districts == 1 and a.Total_Samples == 2


def test_full_pairing_coalesces_key_like_columns(spark):
    en = spark.createDataFrame([(1, "m", "d", "a")], "prompt_id int, model_name string, disease string, English_a string")
    zh = spark.createDataFrame([(1, "m", "d", "b"), (2, "m", "d", "c")], "prompt_id int, model_name string, disease string, Chinese_a string")
    out = jobs.pair_languages(en, zh, how="position", order_by=["prompt_id"], join="full").orderBy("index").collect()
    assert [(r.model_name, r.disease, r.English_a, r.Chinese_a) for r in out] == [("m", "d", "a", "b"), ("m", "d", None, "c")]
    assert align.pair(en, zh, on=["prompt_id"], join="full").count() == 2
