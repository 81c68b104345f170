"""Dirty-text fuzzing: no cleaner may raise under ANSI mode, and outputs stay in range."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordaudit.functions import age as A
from recordaudit.functions import gender as G
from recordaudit.functions import text as X
from recordaudit.operators.coverage import coverage_case

ALPHABET = list("0123456789０１２３４５６７８９岁多个月周龄天-.+eE ") + ["　", "\t", "years old", "Male", "女性", "男性", "x"]
dirty = st.one_of(
    st.none(),
    st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join),
    st.integers(min_value=0, max_value=10**30).map(str),  # overflows every integer type
    st.text(max_size=8),
)

SETTINGS = settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(dirty, min_size=1, max_size=40))
def test_cleaners_never_raise(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    v = F.col("v")
    rows = df.select(
        A.clean_age_v1(v).alias("v1"), A.clean_age_v2(v).alias("v2"), A.clean_age_v2(v, mask=False).alias("v2raw"),
        A.digits_only(v).alias("d"), A.first_number(v).alias("f"), A.numeric_coerce(v).alias("n"),
        A.age_present(v).alias("ap"), G.gender_present(v).alias("gp"),
        G.clean_gender_en(v).alias("ge"), G.clean_gender_zh(v).alias("gz"), G.clean_gender_merged(v).alias("gm"),
        X.cell_count(v).alias("cc"), X.param_size(v).alias("ps"), X.text_length(v).alias("tl"),
        X.strip_admin_suffix(v).alias("sx"), X.null_tokens(v).alias("nt"), coverage_case(v, v).alias("cv"),
        X.fixed2(A.numeric_coerce(v)).alias("f2"), X.sci4(A.numeric_coerce(v)).alias("s4"),
    ).collect()
    for r in rows:
        assert r.v2 is None or 0 <= r.v2 <= 120
        assert r.f is None or 0 <= r.f <= 120
        assert r.ge in ("Male", "Female", "Unknown") and r.gz in ("Male", "Female", "Unknown")
        assert r.gm in ("Male", "Female", "Unknown")
        assert r.ap in (True, False) and r.gp in (True, False)
        assert r.ps >= 0 and r.tl >= 0


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True)), min_size=1, max_size=30))
def test_numeric_paths_never_raise(spark, values):
    from recordaudit.operators import profile
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = df.select(profile.band_index(df.v).alias("b"), A.to_int(df.v).alias("t"), A.range_mask(df.v).alias("m"),
                    A.is_invalid(df.v).alias("bad"), X.fixed2(df.v).alias("f")).collect()
    for r, x in zip(out, values):
        assert r.b is None or 0 <= r.b < 20
        assert r.bad == (not (x is not None and x == x and 0 <= x <= 120))


def test_overflowing_ranges_give_null(one):
    vals = ["9223372036854775807-9223372036854775807", "99999999999999999999岁", "1-9223372036854775807"]
    assert one(vals, A.clean_age_v1) == [None, None, None]
    assert one(vals, A.clean_age_v2) == [None, None, None]
