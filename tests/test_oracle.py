"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from recordaudit.plans import catalog

from .conftest import SF_ORACLE, SF_SMALL
from .oracle_harness import compare, duck, type_diff

QUERIES = catalog.QUERIES  # the reference's own operators
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES[name], SF_ORACLE, con)
    assert r["ok"], r
    assert not type_diff(QUERIES[name](spark, SF_ORACLE), con, ORACLES[name]), name


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == entry.entry(spark).schema


def test_chi_square_p_consistent(spark):
    from recordaudit.operators import contingency
    from recordaudit.plans import catalog, fixtures
    rows = contingency.gender_chi_square(fixtures.records(spark, SF_SMALL), fixtures.real(spark, SF_SMALL),
                                         columns=catalog._clean_sex(), with_p=True).collect()
    for r in rows:
        if r.status == "ok":
            assert (r.p_value < 0.05) == r.significant
            assert r.p_text == f"{r.p_value:.4e}"
