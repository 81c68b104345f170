"""Banding, distributions, frequencies; invariants over the driver tables."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordaudit.operators import profile, reshape
from recordaudit.plans import fixtures as X

from .conftest import SF_SMALL


def test_band_golden(spark):
    vals = [0.0, 1.0, 5.0, 5.5, 6.0, 100.0, 101.0, -1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    labels = profile.band_labels()
    got = [None if r[0] is None else labels[r[0]] for r in
           df.orderBy("i").select(profile.band_index(df.v)).collect()]
    assert got == ["1-5", "1-5", "1-5", "6-10", "6-10", "96-100", None, None, None]
    assert profile.band_labels(style="lower")[:2] == ["0-4", "5-9"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-10, max_value=110, allow_nan=False), min_size=1, max_size=30))
def test_band_matches_right_closed_rule(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(profile.band_index(df.v)).collect()]
    for x, b in zip(xs, got):
        if x < 0 or x > 100:
            assert b is None
        elif x <= 5:
            assert b == 0
        else:
            assert b * 5 < x <= b * 5 + 5


def test_binned_counts_sum_to_total(spark):
    li = X.table(spark, SF_SMALL, "lineitem")
    out = profile.binned_distribution(li, "l_quantity", by=["l_returnflag"])
    per_group = {r[0]: r[1] for r in out.groupBy("l_returnflag").agg(F.sum("n")).collect()}
    want = {r[0]: r[1] for r in li.groupBy("l_returnflag").count().collect()}
    assert per_group == want  # every quantity is within (0, 50], so nothing is unbanded
    assert out.count() == 20 * len(want)


def test_binned_non_null_denominator(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 200.0), ("b", 7.0)], "g string, v double")
    out = profile.binned_distribution(df, "v", by=["g"], denominator="non_null")
    r = out.where("g = 'a' and band_idx = 0").first()
    assert (r.n, r.pct, r.cell) == (1, 50.0, "1 (50.0%)")
    allrows = profile.binned_distribution(df, "v", by=["g"]).where("g = 'a' and band_idx = 0").first()
    assert allrows.pct == 33.33


def test_category_distribution_zero_fill(spark):
    df = spark.createDataFrame([("x", "Male"), ("x", "Male"), ("x", "other"), ("y", None)], "g string, s string")
    rows = {(r.g, r.category): (r.n, r.cell) for r in profile.category_distribution(df, "s", by=["g"]).collect()}
    assert rows[("x", "Male")] == (2, "2 (66.67%)")
    assert rows[("x", "Female")] == (0, "0 (0.0%)")
    assert rows[("y", "Unknown")] == (0, "0 (0.0%)")


def test_pivot_unpivot_roundtrip(spark):
    li = X.table(spark, SF_SMALL, "lineitem")
    long = profile.binned_distribution(li, "l_quantity", by=["l_returnflag"])
    wide = reshape.pivot_report(long, ["band_idx", "band"], "l_returnflag")
    back = reshape.report_counts(wide, ["band_idx", "band"], variable="l_returnflag")
    a = sorted((r.l_returnflag, r.band_idx, r.cell, r.n) for r in long.collect())
    b = sorted((r.l_returnflag, r.band_idx, r.cell, r.n) for r in back.collect())
    assert a == b


def test_value_frequency_and_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    freq = {r.v: (r.n, r.pct) for r in profile.value_frequency(df, "v").collect()}
    assert freq == {"a": (2, 50.0), None: (1, 25.0), "b": (1, 25.0)}
    nn = {r.v: r.pct for r in profile.value_frequency(df, "v", dropna=True).collect()}
    assert nn == {"a": 66.67, "b": 33.33}
    assert sorted(profile.distinct_values(df, "v").collect(), key=str) == sorted(
        [(None,), ("a",), ("b",)], key=str)
    grouped = profile.value_frequency(df.withColumn("g", F.lit("k")), "v", by=["g"]).collect()
    assert sum(r.pct for r in grouped) == 100.0


def test_valid_and_invalid(spark):
    df = spark.createDataFrame([("m", "25", 1.0), ("m", None, 200.0), ("m", "x", None)], "m string, a string, v double")
    vr = {r.column: (r.valid, r.total, r.valid_pct) for r in profile.valid_ratio(df, ["a", "v"], ["m"]).collect()}
    assert vr == {"a": (2, 3, 66.67), "v": (2, 3, 66.67)}
    inv = {r.v: r.n for r in profile.invalid_values(df, "v").collect()}
    assert inv == {200.0: 1, None: 1}
    r = profile.invalid_ratio(df, "a", text=True).first()
    assert (r.invalid, r.total) == (2, 3)


def test_cleaning_reports(spark):
    from recordaudit.functions.gender import clean_gender_merged
    df = spark.createDataFrame([("男",), ("女性",), (None,), ("boy.",)], "s string")
    rep = {(r.stage, r.value): r.n for r in profile.cleaning_before_after(df, "s", clean_gender_merged(df.s)).collect()}
    assert rep[("before", None)] == 1 and rep[("after", "Male")] == 2 and rep[("after", "Unknown")] == 1
    audit = {r.raw: r.cleaned for r in profile.cleaning_audit(df, "s", clean_gender_merged(df.s)).collect()}
    assert audit == {"男": "Male", "女性": "Female", "boy.": "Male"}
