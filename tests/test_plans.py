"""Plan-shape checks on every registered query (the properties that matter at scale)."""

import re

import pytest

from recordaudit.plans import catalog

from .conftest import SF_SMALL

QUERIES = catalog.QUERIES  # the reference's own operators
# the caller's client, and footers and header lines that tasks read
PYTHON_ALLOWED = {"batch_complete": "MapInArrow", "file_catalogue": "MapInArrow", "schema_union": "MapInArrow"}


def _executed(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    plan = _executed(spark, name)
    # no cross products and no row-at-a-time Python anywhere
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)
    for op in ("ArrowEvalPython", "MapInPandas", "MapInArrow"):
        if PYTHON_ALLOWED.get(name) != op:
            assert op not in plan, (name, op)
    # a single-partition exchange may only carry aggregated rows (totals, offsets, top-k)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 5])
            assert "HashAggregate" in below or "ObjectHashAggregate" in below, (name, lines[i:i + 5])


@pytest.mark.parametrize("name", ["coverage_counts", "binned_distribution_by_group", "gender_profile",
                                  "contingency_counts", "gazetteer_match", "token_mean_std", "value_frequency"])
def test_partial_aggregation_before_shuffle(spark, name):
    plan = _executed(spark, name)
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan), name


@pytest.mark.parametrize("name,table,cols", [
    ("coverage_counts", "orders", {"o_orderkey", "o_custkey"}),
    ("binned_distribution_by_group", "lineitem", {"l_quantity", "l_returnflag"}),
    ("token_mean_std", "documents", {"lang", "source", "n_chars"}),
])
def test_scan_prunes_columns(spark, name, table, cols):
    plan = _executed(spark, name)
    m = re.search(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", plan)
    assert m, plan
    read = {c.split("#")[0] for c in m.group(1).split(",")}
    assert read == cols, (name, read)


def test_gazetteer_joins_are_broadcast(spark):
    plan = _executed(spark, "gazetteer_match")
    assert plan.count("BroadcastHashJoin") >= 4 and "SortMergeJoin" not in plan


# The p-value's higher-order `aggregate` (erfc) is interpreted by Spark; it runs in
# the last projection, over the aggregated rows only (one per model x language x group).
# A JSON line is parsed by Spark's parser, which is no generated code.
INTERPRETED_OK = {"chi_square_p", "record_rescue"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - INTERPRETED_OK))
def test_stays_in_whole_stage_codegen(spark, name):
    """No Project / Filter / HashAggregate falls out of codegen (e.g. a huge generated method)."""
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    off = [line.strip() for line in final.splitlines()
           if re.search(r"(^|[-+:] )(Project|Filter|HashAggregate) \[", line.strip())
           and not re.search(r"\*\(\d+\) (Project|Filter|HashAggregate)", line)]
    assert not off, (name, off[:2])
