"""Distributed positions, positional / keyed pairing, column copies."""

import pytest
from pyspark.sql import functions as F

from recordaudit.operators import align
from recordaudit.plans import fixtures as X

from .conftest import SF_SMALL


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dense_position_matches_sorted_order(spark, parts):
    li = X.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = align.dense_position(li, ["l_orderkey", "l_linenumber"], num_partitions=parts).collect()
    got = sorted((r.pos, r.l_orderkey, r.l_linenumber) for r in out)
    keys = sorted((r.l_orderkey, r.l_linenumber) for r in out)
    assert [g[0] for g in got] == list(range(1, len(keys) + 1))
    assert [(g[1], g[2]) for g in got] == keys


@pytest.mark.parametrize("parts", [1, 5])
def test_grouped_numbering(spark, parts):
    li = X.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = align.number_rows(li, ["l_orderkey", "l_linenumber"], ["l_returnflag"], name="seq").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.l_returnflag, []).append((r.l_orderkey, r.l_linenumber, r.seq))
    for rows in groups.values():
        rows.sort()
        assert [s for *_, s in rows] == list(range(1, len(rows) + 1))


def test_plan_and_build_time_do_not_grow_with_the_parts(spark):
    import time
    df = spark.range(20_000).select((F.col("id") * 7919 % 10_007).alias("a"), F.col("id").cast("string").alias("b"))
    size = {}
    for parts in (64, 3000):
        t0 = time.perf_counter()
        out = align.dense_position(df, ["a", "b"], num_partitions=parts)
        size[parts] = len(out._jdf.queryExecution().analyzed().toString())
        rows = sorted((r.pos, r.a, r.b) for r in out.collect())
        assert time.perf_counter() - t0 < 10
        assert [r[0] for r in rows] == list(range(1, 20_001)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert size[3000] < 3 * size[64]


def test_buckets_are_of_similar_size_and_ties_spread(spark):
    df = spark.range(30_000).select(F.lit("same").alias("k"), "id")
    cols = ["_k0", "_tie"]
    keyed = df.withColumns({"_k0": F.col("k"), "_tie": F.xxhash64("k", "id")})
    placed = align._bucket(keyed, F.struct(*cols), align._range_bounds(keyed, cols, 50), 50)
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert len(sizes) == 50 and max(sizes) < 3 * 30_000 / 50
    repeated = spark.range(5000).select((F.col("id") % 3).alias("k"))  # identical rows share a bucket
    assert sorted(r.pos for r in align.dense_position(repeated, ["k"], num_partitions=9).collect()) == list(range(1, 5001))


def test_null_group_keys_are_numbered(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, k int")
    out = sorted((r.g or "", r.k, r.pos) for r in align.dense_position(df, ["k"], ["g"]).collect())
    assert out == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]


def test_pair_counts(spark):
    conv = X.table(spark, SF_SMALL, "conversations")
    u = conv.where("role = 'user'").select("conv_id", "turn", "text")
    a = conv.where("role = 'assistant'").select("conv_id", "turn", "text")
    nu, na = u.count(), a.count()
    inner = align.pair(u, a, how="position", order_by=["conv_id", "turn"])
    full = align.pair(u, a, how="position", order_by=["conv_id", "turn"], join="full")
    assert inner.count() == min(nu, na) and full.count() == max(nu, na)
    assert set(inner.columns) == {"pos", "conv_id", "turn", "text", "conv_id_zh", "turn_zh", "text_zh"}


def test_copy_modes(spark):
    src = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    tgt = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "k int, w string")
    with pytest.raises(ValueError):
        align.copy_column_strict(src, tgt, "v", ["k"], ["k"])
    left = sorted((r.k, r.v) for r in align.copy_column_left(src, tgt, "v", ["k"], ["k"]).collect())
    assert left == [(10, "x"), (20, "y"), (30, None)]
    same = spark.createDataFrame([(7, "p"), (8, "q")], "k int, w string")
    strict = sorted((r.k, r.v) for r in align.copy_column_strict(src, same, "v", ["k"], ["k"]).collect())
    assert strict == [(7, "x"), (8, "y")]
    targets = tgt.withColumn("t", F.lit("three")).unionByName(same.withColumn("t", F.lit("two")))
    skip = sorted((r.t, r.k, r.v) for r in align.copy_column_skip(src, targets, "v", "t", ["k"], ["k"]).collect())
    assert skip == [("two", 7, "x"), ("two", 8, "y")]


def test_dataset_pairs_and_union(spark):
    a = spark.createDataFrame([("m1_v3.2.x",), ("m1_zz.x",), ("m2_v3.2.x",)], "file_name string")
    b = spark.createDataFrame([("m1_v4.1.x",), ("m3_v4.1.x",)], "file_name string")
    rows = align.dataset_pairs(a, b).collect()
    assert [(r.key, r.source_name, r.target_name) for r in rows] == [("m1", "m1_zz.x", "m1_v4.1.x")]
    assert align.common_keys(a.selectExpr("substring_index(file_name, '_', 1) as k"),
                             b.selectExpr("substring_index(file_name, '_', 1) as k"), "k").count() == 1
    u = align.union_all_by_name([a.withColumn("x", F.lit(1)), b])
    assert u.count() == 5 and u.columns == ["file_name", "x"]
