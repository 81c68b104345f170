"""Tables that tasks wrote as folders of part files are entries of a dataset like single files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordaudit.operators import states
from recordaudit.plans import catalog
from recordaudit.sources import catalogue, files, rescue


@pytest.fixture()
def mixed(spark, tmp_path):
    """A file, a folder of four part files that the glob does not name, and a folder with key=value folders."""
    src = tmp_path / "the src%20+é"
    src.mkdir()
    pd.DataFrame({"a": [1, 2], "b": ["x", None]}).to_parquet(src / "one_v1.parquet", index=False)
    spark.range(10).select(F.col("id").alias("c"), F.lit("t").alias("b")).repartition(4).write.parquet(str(src / "many_v1.parquet"))
    spark.range(6).select(F.col("id").alias("d"), (F.col("id") % 2).cast("int").alias("k")).write.partitionBy("k").parquet(str(src / "keyed_v1.parquet"))
    (src / "_hidden_v1.parquet").mkdir()
    return str(src)


def test_scan_reads_folders_whole_under_their_names(spark, mixed):
    df = files.scan(spark, mixed, glob="*_v1.parquet", keys={"table": files.model_from_file(F.col("file_name"))})
    got = df.groupBy("file_name", "table").agg(F.count(F.lit(1)), *[F.count(c) for c in "abcdk"]).collect()
    assert sorted(map(tuple, got)) == [("keyed_v1.parquet", "keyed", 6, 0, 0, 0, 6, 6), ("many_v1.parquet", "many", 10, 0, 10, 10, 0, 0),
                                       ("one_v1.parquet", "one", 2, 2, 1, 0, 0, 0)]
    assert files.skipped_files(spark, mixed, df, glob="*_v1.parquet").count() == 0
    assert [r.file_name for r in files.skipped_files(spark, mixed, df.where("c is null"), glob="*_v1.parquet").collect()] == ["many_v1.parquet"]
    assert files.scan(spark, mixed, glob="many_v1.parquet", ignore_corrupt=True).groupBy("file_name").count().collect() == [("many_v1.parquet", 10)]


def test_catalogue_adds_up_the_part_files(spark, mixed):
    folders = [f for some in catalogue.table_folders(spark, mixed, "*_v1.parquet")[1:] for f in some]
    cat = catalogue.catalogue(spark, mixed, glob="*_v1.parquet")
    got = {r.path.rsplit("/", 1)[1]: (r.rows, [tuple(c) for c in r.columns]) for r in catalogue.entries(cat, folders).collect()}
    assert got == {"one_v1.parquet": (2, [("a", "bigint"), ("b", "string")]), "many_v1.parquet": (10, [("c", "bigint"), ("b", "string")]),
                   "keyed_v1.parquet": (6, [("d", "bigint")])}


def test_rescue_names_the_folder(spark, tmp_path):
    spark.range(20).select(F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.when(F.col("id") < 15, "}").otherwise("")).alias("value")) \
        .repartition(3).write.text(str(tmp_path / "lines.json"))
    good = rescue.rescue(spark, str(tmp_path), str(tmp_path / "store"), "json", glob="*.json")
    assert good.groupBy("file_name").count().collect() == [("lines.json", 15)] and rescue.quarantined(spark, str(tmp_path / "store")).count() == 5
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    good = rescue.rescue(spark, str(tmp_path), str(tmp_path / "store2"), glob="*.parquet")
    assert good.groupBy("file_name").count().collect() == [("t.parquet", 20)]


def test_states_take_a_folder_as_one_file(spark, mixed, tmp_path):
    store, seen = str(tmp_path / "store"), []
    p = states.Profile("k", "band", ["k"], {"d": "d"})

    def run():
        return states.update(spark, store, mixed, [p], glob="*_v1.parquet", prepare=lambda df: seen.append(df.columns) or df)

    assert run() == 3 and run() == 0 and {"file_name", "k", "d"} <= set(seen[0])
    got = states.report(spark, store, mixed, p, glob="*_v1.parquet").where("n > 0").select("k", "n").collect()
    assert sorted(map(tuple, got)) == [("0", 3), ("1", 3)]
    spark.range(7, 9).select(F.col("id").alias("d"), (F.col("id") % 2).cast("int").alias("k")).write.partitionBy("k").mode("append").parquet(f"{mixed}/keyed_v1.parquet")
    assert run() == 1 and states.report(spark, store, mixed, p, glob="*_v1.parquet").agg(F.sum("n")).collect() == [(8,)]


def test_profile_states_writes_no_table_in_one_task(spark, tmp_path, monkeypatch):
    line = spark.range(400).select(F.element_at(F.array(*map(F.lit, "ARN")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
                                   F.lit("O").alias("l_linestatus"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"))
    line.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts, update = [], states.update

    def watched(spark, store, path, *args, **kw):
        parts.append(sorted(r.path.rsplit("/", 2)[1] for r in catalogue.listing(spark, path, recursive=True).collect()))
        return update(spark, store, path, *args, **kw)

    monkeypatch.setattr(catalog.states, "update", watched)
    rows = catalog.profile_states(spark, str(tmp_path)).collect()
    assert sum(r.n for r in rows) == 400 and {r.files_read for r in rows} == {"2,1,0"}
    assert min(parts[-1].count(f"flag-{f}.parquet") for f in "ARN") > 1
