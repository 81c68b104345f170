"""Golden table for the age cleaners (hand-derived from the rules)."""

import pytest

from recordaudit.functions import age as A

N = None
# raw, v1, v2 (no mask), v2 + mask, digits only, first number
GOLDEN = [
    ("25", 25, 25, 25, 25.0, 25.0),
    ("150", 150, N, N, 150.0, N),
    ("25岁", 25, 25, 25, 25.0, 25.0),
    ("150岁", 150, 150, N, 150.0, N),
    ("50岁以上", 50, 50, 50, 50.0, 50.0),
    ("25岁左右", 25, 25, 25, 25.0, 25.0),
    ("25 Years Old", 25, 25, 25, 25.0, 25.0),
    ("25-year-old", N, 25, 25, 25.0, 25.0),
    ("25-34岁", 29, 29, 29, 2534.0, 25.0),
    ("25-34", 29, 29, 29, 2534.0, 25.0),
    ("30多岁", 30, 30, 30, 30.0, 30.0),
    ("30-50岁之间", 40, 40, 40, 3050.0, 30.0),
    ("2020-12", 1016, 1016, N, 202012.0, N),
    ("3个月", 0, 3, 3, 3.0, 3.0),
    ("三个月", 0, 0, 0, N, N),
    ("40周龄", 0, 40, 40, 40.0, 40.0),
    ("周岁", N, 0, 0, N, N),
    ("65.0", N, 65, 65, 65.0, 65.0),
    ("-5", N, 5, 5, 5.0, 5.0),
    ("约25岁", N, 25, 25, 25.0, 25.0),
    ("２５岁", 25, 25, 25, N, 25.0),
    (" 40 ", 40, 40, 40, 40.0, 40.0),
    ("unknown", N, N, N, N, N),
    ("", N, N, N, N, N),
    (None, N, N, N, N, N),
]
RAW = [g[0] for g in GOLDEN]


@pytest.mark.parametrize("col,fn", [
    (1, A.clean_age_v1),
    (2, lambda c: A.clean_age_v2(c, mask=False)),
    (3, A.clean_age_v2),
    (4, A.digits_only),
    (5, A.first_number),
])
def test_age_golden(one, col, fn):
    got = one(RAW, fn)
    want = [g[col] for g in GOLDEN]
    assert got == want, [(r, g, w) for r, g, w in zip(RAW, got, want) if g != w]


def test_masked_v2_is_int_in_range(one):
    got = one(RAW, A.clean_age_v2)
    assert all(v is None or (isinstance(v, int) and 0 <= v <= 120) for v in got)


def test_numeric_coerce(one):
    vals = ["25", " 40 ", "25d", "0x10", "２５", "1e2", "-3.5", ".5", "abc", None]
    assert one(vals, A.numeric_coerce) == [25.0, 40.0, None, None, None, 100.0, -3.5, 0.5, None, None]


def test_to_int_truncates(spark):
    df = spark.createDataFrame([(1, 25.9), (2, -1.5), (3, None)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(A.to_int(df.v)).collect()] == [25, -1, None]


def test_range_mask_and_invalid(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 120.0), (3, 120.5), (4, -1.0), (5, None)], "i int, v double")
    rows = df.orderBy("i").select(A.range_mask(df.v), A.is_invalid(df.v)).collect()
    assert [r[0] for r in rows] == [0.0, 120.0, None, None, None]
    assert [r[1] for r in rows] == [False, False, True, True, True]


def test_age_present(one):
    vals = ["25", "25.5", ".5", "25.", "-5", "", ".", "1.2.3", "Unknown", "２５", None]
    assert one(vals, A.age_present) == [True, True, True, True, False, False, False, False, False, True, False]


def test_other_unicode_digits(one):
    vals = ["٣٥岁", "४० years old", "约٢٥岁"]  # Arabic-Indic and Devanagari digits
    assert one(vals, A.clean_age_v2) == [35, 40, 25]
    assert one(vals, A.first_number) == [35.0, 40.0, 25.0]
