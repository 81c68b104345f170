"""Chi-square golden values and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from recordaudit.operators.contingency import chi_square_table


def _chi(spark, a, b, c, d):
    df = spark.createDataFrame([(a, b, c, d)], "real_female long, real_male long, female long, male long")
    return chi_square_table(df, digits=12).first()


def test_golden_small(spark):
    r = _chi(spark, 10, 20, 30, 40)
    assert r.chi2 == pytest.approx(0.446428571428571, abs=1e-12)
    assert r.p_value == pytest.approx(0.504035866452505, rel=1e-12)
    assert r.dof == 1 and r.status == "ok" and r.significant is False


def test_golden_large(spark):
    r = _chi(spark, 1250, 1750, 1600, 1400)
    assert r.chi2 == pytest.approx(81.40417710944027, rel=1e-11)
    assert r.p_text == "1.8397e-19"
    assert r.significant is True


def test_proportional_is_zero(spark):
    r = _chi(spark, 5, 5, 5, 5)
    assert r.chi2 == 0.0 and r.p_value == 1.0


def test_degenerate(spark):
    r = _chi(spark, 0, 0, 3, 4)
    assert r.status == "degenerate" and r.chi2 is None and r.p_value is None and r.significant is None


@pytest.mark.parametrize("t", [(3, 9, 14, 2), (100, 7, 30, 55), (1, 1, 0, 9)])
def test_swap_invariant(spark, t):
    a, b, c, d = t
    base = _chi(spark, a, b, c, d).chi2
    assert _chi(spark, b, a, d, c).chi2 == pytest.approx(base, rel=1e-12)
    assert _chi(spark, c, d, a, b).chi2 == pytest.approx(base, rel=1e-12)


def test_pvalue_matches_closed_form(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 3.841458820694124, 10.0)], "x double")
    from recordaudit.functions.stats import chi2_pvalue_dof1
    got = [r[0] for r in df.select(chi2_pvalue_dof1(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in (0.0, 0.5, 3.841458820694124, 10.0)])
    assert got[2] == pytest.approx(0.05, rel=1e-12)
