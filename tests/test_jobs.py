"""Composite jobs and helpers."""

from pyspark.sql import functions as F

from recordaudit.functions.text import label_by_substring
from recordaudit.operators import contingency, generate, reshape
from recordaudit.plans import fixtures as X
from recordaudit.plans import jobs

from .conftest import SF_SMALL


def test_pair_languages_key_and_position(spark):
    en = spark.createDataFrame([("m", "flu", 1, 1, "q", "a"), ("m", "flu", 1, 2, "q", "b"), ("m", "flu", 2, 1, "q", "c")],
                               "model_name string, disease string, prompt_id int, run int, English string, English_a string")
    zh = spark.createDataFrame([("m", "flu", 1, 2, "问", "乙"), ("m", "flu", 2, 1, "问", "丙")],
                               "model_name string, disease string, prompt_id int, run int, Chinese string, Chinese_a string")
    keyed = jobs.pair_languages(en, zh)
    rows = sorted((r["index"], r.English_a, r.Chinese_a) for r in keyed.collect())
    assert rows == [(0, "b", "乙"), (1, "c", "丙")]
    assert keyed.columns[:7] == ["index", "English", "English_a", "Chinese", "Chinese_a", "model_name", "disease"]
    pos = jobs.pair_languages(en.drop("model_name", "disease"), zh.drop("model_name", "disease"), how="position",
                              order_by=["prompt_id", "run"])
    assert sorted((r["index"], r.English_a, r.Chinese_a) for r in pos.collect()) == [(0, "a", "乙"), (1, "b", "丙")]


def test_clean_ages_legacy_and_v1(spark):
    df = spark.createDataFrame([("25-34岁", "约30岁"), ("150", "abc"), (None, "7 years")], "Age_Chinese string, Age string")
    legacy = [(r.Age_Chinese, r.Age) for r in jobs.clean_ages_legacy(df).collect()]
    assert legacy == [(None, 30), (None, None), (None, 7)]  # 2534 is masked; digits of '150' -> 150 > 120
    v1 = [(r.Age_Chinese, r.Age) for r in jobs.clean_ages(df, version="v1").collect()]
    assert v1 == [(29, None), (150, None), (None, None)]


def test_value_audit(spark):
    rec = X.records(spark, SF_SMALL)
    out = jobs.value_audit(rec, ["age_raw", "age_zh_raw"], by=["model_name"])
    freq = out["frequency"]
    total = rec.count()
    per = {(r.model_name, r.column): r.n for r in freq.groupBy("model_name", "column").agg(F.sum("n").alias("n")).collect()}
    assert sum(v for (m, c), v in per.items() if c == "age_raw") == total
    inv = out["invalid_ratio"].collect()
    assert all(0 <= r.invalid <= r.total for r in inv)


def test_location_report_and_gender_reports(spark):
    summary, detail = jobs.location_report(X.places(spark, SF_SMALL), X.gazetteer(spark, SF_SMALL),
                                           X.home(spark, SF_SMALL), position="pid")
    assert detail.count() == sum(r.Out_Of_Home_Districts for r in summary.collect())
    before_after, audit = jobs.gender_cleaning_reports(X.records(spark, SF_SMALL), "sex_zh_raw")
    assert {r.stage for r in before_after.collect()} == {"before", "after"}
    assert audit.where("matched = false").count() >= 1


def test_token_summary_by_file_key(spark):
    df = spark.createDataFrame([("f1", 1, "qwen-7B", 10.0), ("f1", 2, "qwen-7B", 20.0), ("f2", 1, "yi-14B", 5.0),
                                ("f3", 1, "gemma", None), ("f3", 2, "gemma", 3.0)],
                               "file string, pos int, model_name string, English_a_tokens double")
    empty = contingency.token_summary(df.where("model_name = 'gemma'").withColumn("English_a_tokens", F.lit(None).cast("double")),
                                      ["English_a_tokens"]).first()
    assert empty.english_a_tokens == "nan ± nan"
    out = contingency.token_summary(df, ["English_a_tokens"], key="file", position="pos").collect()
    assert [r.model_name for r in out] == ["yi-14B", "qwen-7B", "gemma"]
    assert [r.english_a_tokens for r in out] == ["5.00 ± nan", "15.00 ± 7.07", "3.00 ± nan"]


def test_real_from_report_and_aliases(spark):
    wide = spark.createDataFrame([("Female", "12 (3.0%)", 7), ("Male", "30 (7.5%)", 9)],
                                 "gender string, T1DM string, T2DM int")
    real = {r.disease: (r.female, r.male) for r in contingency.real_from_report(wide).collect()}
    assert real == {"T1DM": (12, 30), "T2DM": (7, 9)}
    df = spark.createDataFrame([("Type 1 diabetes",), ("T2DM cases",), ("other",)], "d string")
    rules = {"T1DM": ["type 1", "t1dm"], "T2DM": ["type 2", "t2dm"]}
    assert [r[0] for r in df.select(label_by_substring(df.d, rules)).collect()] == ["T1DM", "T2DM", "other"]


def test_reshape_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "Model int, A_Ratio double, B_Accuracy double, C string")
    assert reshape.project_available(df, ["C", "missing", "Model"]).columns == ["C", "Model"]
    assert reshape.select_matching(df, ["Ratio", "Accuracy"], keep=["Model"]).columns == ["Model", "A_Ratio", "B_Accuracy"]


def test_grid_carries_shared_key(spark):
    prompts = spark.createDataFrame([(1, "写 {{CONDITION}}")], "prompt_id int, template string")
    conds = spark.createDataFrame([("1型糖尿病", "背景", "Type 1 diabetes")], "condition string, background string, disease string")
    row = generate.prompt_grid(prompts, conds, carry=["disease"], runs=2).first()
    assert row.disease == "Type 1 diabetes" and row.prompt.startswith("写 1型糖尿病\n背景")
