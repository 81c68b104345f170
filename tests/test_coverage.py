"""Coverage cases, ratios and gazetteer matching."""

from pyspark.sql import functions as F

from recordaudit.operators import coverage
from recordaudit.plans import fixtures as X

from .conftest import SF_SMALL


def test_coverage_golden(spark):
    pairs = [("25", "Male"), ("25.5", None), (".5", "1"), ("25-34", "F"), ("-5", "x"),
             ("Unknown", "UNKNOWN"), ("300", "1.0"), (None, "")]
    want = [coverage.BOTH, coverage.ONLY_AGE, coverage.ONLY_AGE, coverage.ONLY_GENDER, coverage.ONLY_GENDER,
            coverage.NEITHER, coverage.BOTH, coverage.ONLY_GENDER]
    df = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(pairs)], "i int, a string, s string")
    got = [r[0] for r in df.orderBy("i").select(coverage.coverage_case(df.a, df.s)).collect()]
    assert got == want


def test_coverage_counts_sum_and_missing_columns(spark):
    df = spark.createDataFrame([("m1", "25", "Male"), ("m1", None, None), ("m2", "x", "F")],
                               "model_name string, Age string, Sex string")
    out = coverage.coverage_counts(df).collect()  # Chinese columns absent -> all Neither
    by = {r.Model: r for r in out}
    assert by["m1"]["English: Both"] == 1 and by["m1"]["English: Neither"] == 1
    assert by["m1"]["Chinese: Neither"] == 2 and by["m2"]["English: Only gender"] == 1
    for r in out:
        for lab in ("English", "Chinese"):
            assert sum(r[f"{lab}: {c}"] for c in ("Both", "Only age", "Only gender", "Neither")) in (1, 2)


def test_ratios(spark):
    df = spark.createDataFrame([("m", 30, 10, 20, 40, 0, 0, 0, 100)],
                               'Model string, `English: Both` long, `English: Only age` long, '
                               '`English: Only gender` long, `English: Neither` long, `Chinese: Both` long, '
                               '`Chinese: Only age` long, `Chinese: Only gender` long, `Chinese: Neither` long')
    r = coverage.coverage_ratios(df).first()
    assert r["English: Only age with Both"] == 40 and r["English_LMS_Both_Ratio"] == 0.01
    assert r["English_LMS_Both_Age_Ratio_Formatted"] == "0.01"
    r2 = coverage.coverage_ratios(df, total=None).first()
    assert r2["English_LMS_Both_Ratio"] == 0.3
    acc = coverage.location_accuracy(df.withColumn("Chinese: City Correct", F.lit(300))).first()
    assert acc["Chinese_City_Accuracy"] == 10.0 and acc["English_Province_Accuracy"] == 0.0


def test_location_summary_invariants(spark):
    s = coverage.location_summary(X.places(spark, SF_SMALL), X.gazetteer(spark, SF_SMALL), X.home(spark, SF_SMALL))
    for r in s.collect():
        for lv in coverage.LOCATION_LEVELS:
            assert r[f"Matched_{lv}"] <= r[f"Chinese_{lv}"] <= r["Total_Samples"]
        assert r["Out_Of_Home_Districts"] <= r["Matched_District"]


def test_home_as_list_equals_home_as_table(spark):
    places, gaz, home = X.places(spark, SF_SMALL), X.gazetteer(spark, SF_SMALL), X.home(spark, SF_SMALL)
    names = [r[0][:-1] for r in home.collect()]  # the list form holds suffix-free names
    a = coverage.location_summary(places, gaz, home).orderBy("Model").collect()
    b = coverage.location_summary(places, gaz, names).orderBy("Model").collect()
    assert a == b
