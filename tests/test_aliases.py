"""Alias labels against brute force, and the grid's block matrix."""

import os
import random

import pytest
from pyspark.sql import functions as F

from recordaudit.operators import aliases, contingency, generate
from recordaudit.sources import files


def brute(text, table):
    """table: (alias, label, order)."""
    hits = [(o, -len(a), a.lower(), lab) for a, lab, o in table if a and text is not None and a.lower() in text.lower()]
    return min(hits)[3] if hits else None


@pytest.mark.parametrize("order", [None, "order"])
def test_ten_thousand_aliases_equal_brute_force(spark, order):
    rng = random.Random(3)
    letters = "abcdeé日"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(14_000)})[:10_000]
    table = [(w.upper() if k % 5 == 0 else w, f"L{k % 700}", rng.randint(0, 9) if order else 0) for k, w in enumerate(w for w in words)]
    texts = ["".join(rng.choice(letters + "  ") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "same"] + ["repeated dé"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    al = spark.createDataFrame([*table, (None, "x", 0), ("", "y", 0)], "alias string, label string, order int")
    got = {r.i: r.label for r in aliases.label_by_aliases(df, "t", al, order=order).collect()}
    keyed = {}
    for a, lab, o in table:  # one alias with several labels takes the first
        keyed[a.lower()] = min(keyed.get(a.lower(), (o, lab)), (o, lab))
    flat = [(a, lab, o) for a, (o, lab) in keyed.items()]
    assert got == {i: brute(t, flat) for i, t in enumerate(texts)}


def test_defined_cases(spark):
    df = spark.createDataFrame([("Type 1 Diabetes",), ("TYPE 10 x",), ("none",), (None,)], "label string")
    al = spark.createDataFrame([("type 1", "T1"), ("TYPE 1", "T0"), ("type 10", "T10"), ("x", "X")], "alias string, label string")
    assert [r.label for r in aliases.label_by_aliases(df, "label", al, name="label").collect()] is not None
    got = {r.label: r.out for r in aliases.label_by_aliases(df, "label", al, name="out").collect()}
    assert got == {"Type 1 Diabetes": "T0", "TYPE 10 x": "T10", "none": None, None: None}
    assert aliases.label_by_aliases(df, "label", al.limit(0), name="out").where("out is not null").count() == 0


def test_real_groups_through_an_alias_table(spark):
    rec = spark.createDataFrame([("m", "Type 1 diabetes (new)", "Female"), ("m", "other", "Male")], "model_name string, disease string, Sex string")
    real = spark.createDataFrame([("T1DM", 5, 5)], "disease string, female bigint, male bigint")
    al = spark.createDataFrame([("type 1", "T1DM"), ("t1dm", "T1DM")], "alias string, disease string")
    counts = contingency.gender_counts(rec, columns={"English": "Sex"})
    out = {r.disease: r for r in contingency.attach_real(counts, real, aliases=al, alias_contains=True).collect()}
    assert (out["Type 1 diabetes (new)"].real_female, out["other"].real_female) == (5, None)


def test_cells_follow_both_inputs():
    for left, right in ((0, 0), (1, 1), (10, 0), (1, 10**9), (10**9, 1), (3000, 5000), (10**6, 10**6), (7, 10**7)):
        a, b = generate.cells(left, right)
        assert 1 <= a <= max(left, 1) and 1 <= b <= max(right, 1)
        assert left * right <= 3 * a * b * generate.GRID_CELL + 1
    assert generate.cells(10, 10) == (1, 1)


def test_grid_of_many_cells_is_complete(spark, monkeypatch):
    monkeypatch.setattr(generate, "GRID_CELL", 50)
    monkeypatch.setattr(generate.cells, "__defaults__", (50,))
    left, right = spark.range(83).select(F.col("id").alias("a")), spark.range(57).select(F.col("id").alias("b"))
    out = generate._times(left, right, 83, 57)
    assert out.rdd.getNumPartitions() > 50
    assert out.distinct().count() == 83 * 57 == out.count()


def test_partitioned_sink_is_one_pass_and_splits_a_hot_key(spark, tmp_path):
    df = spark.range(0, 300_000, 1, 6).selectExpr("if(id % 3 = 0, 0, id % 40) as k", "id", "sha2(cast(id as string), 256) as v")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        files.write_partitioned(df, str(tmp_path / "out"), ["k"], rows_per_file=60_000)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hot = [f for f in os.listdir(tmp_path / "out" / "k=0") if f.startswith("part-")]
    assert len(hot) > 3 and spark.read.parquet(str(tmp_path / "out")).count() == 300_000
    rows = spark.read.parquet(*[str(tmp_path / "out" / "k=0" / f) for f in hot]).groupBy("_metadata.file_name").count()
    assert rows.agg({"count": "max"}).first()[0] <= 60_000
    plan = df.sparkSession.sql("SELECT /*+ REBALANCE(k) */ * FROM {df}", df=df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "REBALANCE_PARTITIONS_BY_COL" in plan
