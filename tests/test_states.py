"""Profiles from stored per-file counts equal a full run, and read only new or changed files."""

import os
import time

import pandas as pd
import pytest

from recordaudit.operators import coverage, states
from recordaudit.plans import jobs
from recordaudit.sources import files

AGE = states.Profile("age", "band", ["disease"], {"Age": "try_cast(Age as double)", "Age_Chinese": "try_cast(Age_Chinese as double)"})
SEX = states.Profile("sex", "category", ["disease"], {"Sex": "Sex", "Sex_Chinese": "Sex_Chinese"})
COVER = states.Profile("cover", "coverage", ["model"], {"English": ("Age", "Sex"), "Chinese": ("Age_Chinese", "Sex_Chinese")})


def write(folder, name, rows):
    pd.DataFrame(rows, columns=["disease", "Age", "Age_Chinese", "Sex", "Sex_Chinese"]).to_parquet(folder / name, index=False)


def full(spark, src):
    df = files.scan(spark, str(src)).withColumn("model", files.model_from_file(files.F.col("file_name")))
    return df


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def same(spark, src, store):
    df = full(spark, src)
    assert rows(states.report(spark, store, str(src), AGE)) == rows(jobs.age_profile(df))
    assert rows(states.report(spark, store, str(src), SEX)) == rows(jobs.gender_profile(df))
    got, want = states.report(spark, store, str(src), COVER), coverage.coverage_counts(df, "model")
    assert rows(got) == rows(want) and got.columns == want.columns


def run(spark, src, store):
    return states.update(spark, store, str(src), [AGE, SEX, COVER],
                         prepare=lambda df: df.withColumn("model", files.model_from_file(files.F.col("file_name"))))


def test_new_changed_and_removed_files(spark, tmp_path):
    src, store = tmp_path / "the src%20+é", str(tmp_path / "store")
    src.mkdir()
    write(src, "a_v1.parquet", [("T1DM", "25", "31", "Female", "Male"), ("T1DM", "x", None, None, "Unknown"), (None, "5", "5", "Male", "Male")])
    write(src, "b_v1.parquet", [("GDM", "101", "0", "other", "Female")] * 3)
    assert run(spark, src, store) == 2
    same(spark, src, store)
    assert run(spark, src, store) == 0
    write(src, "c_v1.parquet", [("GDM", "30", "44", "Female", "Female")])
    write(src, "empty.parquet", [])
    pd.DataFrame({"disease": pd.array([], "string"), "Age": pd.array([], "string"), "Age_Chinese": pd.array([], "string"),
                  "Sex": pd.array([], "string"), "Sex_Chinese": pd.array([], "string")}).to_parquet(src / "empty.parquet", index=False)
    assert run(spark, src, store) == 2 and run(spark, src, store) == 0  # a file without rows is known, too
    same(spark, src, store)
    time.sleep(0.01)
    write(src, "b_v1.parquet", [("GDM", "7", "8", "Male", "Female")] * 5)  # changed
    os.remove(src / "a_v1.parquet")
    assert run(spark, src, store) == 1
    same(spark, src, store)


def test_nothing_is_scanned_when_nothing_changed(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    write(src, "a_v1.parquet", [("T1DM", "25", "31", "Female", "Male")])
    run(spark, src, store)
    monkeypatch.setattr(states.files, "scan", lambda *a, **k: pytest.fail("a file was scanned"))
    assert run(spark, src, store) == 0
    states.report(spark, store, str(src), AGE).count()


def test_updates_side_by_side_and_changed_definitions(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    write(src, "a_v1.parquet", [("T1DM", "25", "31", "Female", "Male")] * 4)
    with monkeypatch.context() as m:  # both list before either has written
        m.setattr(states, "_sessions", lambda *a: [])
        assert run(spark, src, store) == 1 and run(spark, src, store) == 1
    same(spark, src, store)
    wide = states.Profile("age", "band", ["disease"], {"Age": "try_cast(Age as double)"}, options={"width": 10})
    assert states.update(spark, store, str(src), [wide]) == 1 and states.update(spark, store, str(src), [wide]) == 0
    assert states.report(spark, store, str(src), wide).where("n > 0").select("band", "n").collect() == [("21-30", 4)]
    os.remove(sorted((tmp_path / "store").iterdir())[0] / "_SUCCESS")  # a session that broke off does not count
    same(spark, src, store)
