"""Results do not depend on the number of shuffle partitions (1 vs 7)."""

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL
from .oracle_harness import rows_of

NAMES = ["coverage_counts", "binned_distribution_by_group", "value_frequency", "copy_column_skip",
         "pair_pad", "batch_complete", "gazetteer_match", "cleaning_before_after", "pair_languages_indexed"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_7_partitions(spark, name):
    fn = entry.queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = fn(spark, SF_SMALL)
            results.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
