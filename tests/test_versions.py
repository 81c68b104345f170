"""The versions' commit log: one winner, whole versions, crashes at any point."""

import os
import threading

import pytest

from recordaudit.sources import files, versions


def ids(df):
    return sorted(r.id for r in df.collect())


def test_two_writers_of_one_version(spark, tmp_path):
    base = str(tmp_path / "ds")
    a, b = versions.begin(spark, base), versions.begin(spark, base)
    versions.commit(spark, a, "v1", lambda f: spark.range(3).write.parquet(f))
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, b, "v1", lambda f: spark.range(9).write.parquet(f))
    assert ids(versions.read(spark, base)) == [0, 1, 2] and [e.version for e in versions.log(spark, base)] == ["v1"]
    assert not any(os.scandir(f"{base}/_again")) and not any(os.scandir(f"{base}/_staged"))
    # a later run of the version replaces it; the old data stay for those that read them
    old = versions.read(spark, base)
    path = files.write_version(spark.range(5), base, "v1")
    assert ids(versions.read(spark, base, "v1")) == list(range(5)) == ids(spark.read.parquet(path)) and ids(old) == [0, 1, 2]


def test_many_writers_get_numbers_of_their_own(spark, tmp_path):
    base = str(tmp_path / "ds")
    start, failed, done = threading.Barrier(6), [], []

    def work(k):
        try:
            begun = versions.begin(spark, base)
            start.wait()
            done.append(versions.commit(spark, begun, f"v{k % 3}", lambda f: spark.range(k + 1).write.parquet(f)))
        except versions.VersionConflict:
            failed.append(k)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entries = versions.log(spark, base)
    assert [e.number for e in entries] == list(range(1, len(entries) + 1)) and len(done) == len(entries) and len(done) + len(failed) == 6
    assert {e.version for e in entries} == {"v0", "v1", "v2"}
    for e in entries:
        assert len(ids(spark.read.parquet(f"{base}/{e.path}"))) > 0


def test_a_crash_leaves_the_old_version(spark, tmp_path):
    base = str(tmp_path / "ds")
    files.write_version(spark.range(2), base, "v1")

    def broken(folder):
        spark.range(7).write.parquet(folder)
        raise OSError("the driver dies here")

    with pytest.raises(OSError):
        versions.commit(spark, versions.begin(spark, base), "v2", broken)
    (tmp_path / "ds" / "_log" / f"{2:020d}.json").write_text('{"version": "v2", "pa')  # an entry that was cut off
    assert files.current_version(spark, base) == "v1" and ids(versions.read(spark, base)) == [0, 1]
    files.write_version(spark.range(4), base, "v2")
    assert [e.number for e in versions.log(spark, base)] == [1, 3] and ids(versions.read(spark, base)) == [0, 1, 2, 3]
    assert ids(versions.read(spark, base, "v1")) == [0, 1]
    with pytest.raises(ValueError):
        versions.read(spark, base, "v9")


def test_reading_a_replaced_version_is_refused_too(spark, tmp_path):
    base = str(tmp_path / "ds")
    files.write_version(spark.range(2), base, "v1")
    again = files.write_version(spark.range(3), base, "v1")
    assert "_again" in again
    with pytest.raises(ValueError, match="refusing"):
        files.write_version(versions.read(spark, base, "v1"), base, "v1")


def test_old_datasets_without_a_log(spark, tmp_path):
    (tmp_path / "ds" / "_current").mkdir(parents=True)
    (tmp_path / "ds" / "_current" / "part-0.txt").write_text("v7\n")
    assert files.current_version(spark, str(tmp_path / "ds")) == "v7"
    assert files.current_version(spark, str(tmp_path / "none")) is None
