"""The ledger of answered requests: resumed runs, a killed driver, equal requests, compaction."""

import os
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recordaudit.operators import ledger

from .conftest import ROOT

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def logged(prompt, folder=None, fail=""):
    import os
    import uuid
    open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
    return None if fail and prompt.endswith(fail) else prompt.upper()


def asked(folder):
    return sorted(f.name.split("-")[0] for f in folder.iterdir())


def test_a_second_session_asks_only_what_is_not_answered(spark, tmp_path):
    grid = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit(1).alias("run"),
                                  F.lit("kept").alias("digest"))
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    path = str(tmp_path / "ledger")

    def run(folder, fail, options):
        import functools
        client = functools.partial(logged, folder=str(folder), fail=fail)
        return ledger.complete_with_ledger(grid, client, path, sampling=options, attempts=1, calls_per_task=7, sleep=lambda s: None)

    first = run(one, "3", None)
    assert len(asked(one)) == 40 and first.count() == 36
    second = run(two, "", None)
    assert asked(two) == ["p13", "p23", "p3", "p33"]
    assert {(r.prompt, r.answer, r.digest) for r in second.collect()} == {(f"p{i}", f"P{i}", "kept") for i in range(40)}
    assert run(two, "", None).count() == 40 and len(asked(two)) == 4


def test_options_keys_and_nulls_make_requests_different(spark, tmp_path):
    grid = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 1, None), ("a", 1, ""), (None, 1, "x")],
                                 "prompt string, run int, place string")
    d = ledger.request_digest(F.col("prompt"), {"run": F.col("run"), "place": F.col("place")}, {"n": 1})
    assert grid.where("prompt is not null").select(d.alias("d")).distinct().count() == 4
    other = ledger.request_digest(F.col("prompt"), {"run": F.col("run"), "place": F.col("place")}, {"n": 2})
    assert grid.where("prompt is not null").select(d.alias("d")).intersect(grid.select(other.alias("d"))).count() == 0
    calls = tmp_path / "calls"
    calls.mkdir()
    out = ledger.complete_with_ledger(grid, logged, str(tmp_path / "l"), keys=["run", "place"], sampling={"folder": str(calls)},
                                      keep_failed=True)
    rows = out.collect()
    assert len(rows) == 6 and len(asked(calls)) == 4  # equal requests are asked once, a null prompt never
    assert all(r.answer == "A" for r in rows if r.prompt) and [r.answer for r in rows if r.prompt is None] == [None]


def test_the_earliest_answer_holds_and_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for answers in ([("d1", "old"), ("d2", "x")], [("d1", "new"), ("d3", "y")], [("d4", "z")]):
        ledger._record(spark.createDataFrame(answers, "digest string, answer string"), path)
    os.remove(sorted((tmp_path / "ledger").iterdir())[2] / "_SUCCESS")  # a session that has not ended
    before = sorted(ledger.read_ledger(spark, path).collect())
    assert [tuple(r) for r in before] == [("d1", "old"), ("d2", "x"), ("d3", "y"), ("d4", "z")]
    assert ledger.compact(spark, path) == 2
    assert sorted(ledger.read_ledger(spark, path).collect()) == before
    assert len(os.listdir(path)) == 2 and ledger.compact(spark, path) == 0
    assert ledger.read_ledger(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("grid_rows", [60])
def test_a_killed_driver_loses_only_the_tasks_in_flight(spark, tmp_path, grid_rows):
    calls, path = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    script = textwrap.dedent(f"""
        import sys; sys.path.insert(0, {ROOT!r})
        from pyspark.sql import functions as F
        from recordaudit.session import local_session
        from recordaudit.operators import ledger

        def slow(prompt):
            import os, time, uuid
            time.sleep(0.15)
            open(os.path.join({str(calls)!r}, prompt + "-" + uuid.uuid4().hex), "w").close()
            return prompt.upper()

        spark = local_session(cores=2, shuffle_partitions=2)
        grid = spark.range({grid_rows}).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit(1).alias("run"))
        ledger.complete_with_ledger(grid, slow, {path!r}, calls_per_task=4).count()
    """)
    job = subprocess.Popen([sys.executable, "-c", script], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    deadline = time.time() + 120
    while len(list(calls.iterdir())) < 25 and time.time() < deadline and job.poll() is None:
        time.sleep(0.05)
    os.killpg(job.pid, signal.SIGKILL)
    job.wait()
    before = set(asked(calls))
    held = {r.answer.lower() for r in ledger.read_ledger(spark, path).collect()}
    assert held and held <= before and len(before) < grid_rows  # it died midway, committed tasks are kept
    again = tmp_path / "again"
    again.mkdir()
    grid = spark.range(grid_rows).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit(1).alias("run"))
    # options are part of a request, so the resumed client is given without any
    import functools
    out = ledger.complete_with_ledger(grid, functools.partial(logged, folder=str(again)), path, calls_per_task=4)
    assert {(r.prompt, r.answer) for r in out.collect()} == {(f"p{i}", f"P{i}") for i in range(grid_rows)}
    assert not held & set(asked(again)) and len(asked(again)) == grid_rows - len(held)
