"""Checkpoint-folder handling: the library reads the session's folder and never sets one."""

from pyspark.sql import functions as F

import recordaudit.session as S
from recordaudit.operators import align


def test_positions_are_dense_without_a_folder_at_a_size_where_bounds_are_sampled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "checkpoint_dir", lambda session: None)
    n = 2_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"))
    align.dense_position(df, ["k"]).write.parquet(str(tmp_path / "pos"))
    out = spark.read.parquet(str(tmp_path / "pos"))
    got = out.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(got) == (n, n, 1, n)
    # in order: the key at the next position is never smaller
    nxt = out.select((F.col("pos") - 1).alias("pos"), F.col("k").alias("next"))
    assert out.join(nxt, "pos").where("next < k").count() == 0


def test_positions_restart_per_group_and_ties_are_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.lit("same").alias("k"), "id")
    once = {r.id: r.pos for r in align.dense_position(df, ["k"], ["g"]).collect()}
    again = {r.id: r.pos for r in align.dense_position(df.repartition(7), ["k"], ["g"]).collect()}
    assert once == again
    for g in range(3):
        assert sorted(p for i, p in once.items() if i % 3 == g) == list(range(1, len(range(g, 5000, 3)) + 1))


def test_null_and_empty_ordering_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("b", None)], "k string, v int")
    got = {(r.k, r.v): r.pos for r in align.dense_position(df, ["k", "v"]).collect()}
    assert got[("a", 2)] == 3 and got[("b", None)] == 4 and {got[(None, 1)], got[(None, 3)]} == {1, 2}
    assert align.dense_position(df.limit(0), ["k"]).count() == 0


def test_freeze_uses_the_session_folder(spark):
    folder = S.checkpoint_dir(spark)
    assert folder  # the test session names one (set only because it was unset, or from spark-defaults)
    frozen = S.freeze(spark.range(5))
    assert frozen.count() == 5


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    import pytest

    class Cluster:
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": lambda self: None})()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Cluster())
    assert S.ensure_checkpoint_dir(spark) == S.checkpoint_dir(spark)
