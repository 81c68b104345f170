"""One call budget for all tasks."""

import functools
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recordaudit.operators import generate, ledger, throttle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stamped(prompt, folder=None):
    import os
    import time
    import uuid
    open(os.path.join(folder, f"{time.time()}-{uuid.uuid4().hex}"), "w").close()
    return prompt


def times(folder):
    return sorted(float(f.name.split("-")[0]) for f in folder.iterdir())


@pytest.mark.parametrize("parts,concurrency", [(1, 1), (16, 1), (16, 4)])
def test_calls_are_bounded_whatever_the_tasks(spark, tmp_path, parts, concurrency):
    calls = tmp_path / "calls"
    calls.mkdir()
    limit, window, n = 20, 0.5, 130
    budget = throttle.CallBudget(str(tmp_path / "budget"), limit, window, leases=8)
    grid = spark.range(n).select(F.col("id").cast("string").alias("prompt"))
    out = generate.batch_complete(grid, functools.partial(stamped, folder=str(calls)), output=str(tmp_path / "out"),
                                  partitions=parts, concurrency=concurrency, budget=budget)
    assert out.count() == n
    at = times(calls)
    assert len(at) == n and at[-1] - at[0] >= (n / limit - 2) * window
    for t in at:  # no stretch of a window's length holds more than two windows' calls
        assert sum(t <= x < t + window for x in at) <= 2 * limit


def test_a_window_s_leases_exist_once(tmp_path):
    now = [1000.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    made = Counter()
    tasks = [throttle.CallBudget(str(tmp_path), 7, 2.0, leases=3, clock=lambda: now[0], sleep=sleep) for _ in range(5)]
    for k in range(60):
        n = tasks[k % 5].take(1 + k % 2)
        made[int(now[0] // 2.0)] += n
    assert max(made.values()) <= 7 and slept and sum(made.values()) >= 60
    again = throttle.CallBudget(str(tmp_path), 7, 2.0, leases=3, clock=lambda: 1000.5, sleep=lambda s: (_ for _ in ()).throw(TimeoutError))
    with pytest.raises(TimeoutError):  # an attempt that starts anew finds the window used up
        again.take()


def test_old_windows_are_cleared_and_settings_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(throttle, "KEEP", 2)
    for t in range(6):
        throttle.CallBudget(str(tmp_path), 1, 1.0, clock=lambda t=t: float(t)).take()
    assert {f.name for f in tmp_path.iterdir()} == {"window-3", "window-4", "window-5"}
    with pytest.raises(ValueError):
        throttle.CallBudget("s3://bucket/x", 1)
    with pytest.raises(ValueError):
        throttle.CallBudget(str(tmp_path), 0)
    assert throttle.CallBudget("file:///tmp/x", 1).folder == "/tmp/x"


def test_retries_count_and_the_ledger_takes_a_budget(spark, tmp_path):
    budget = throttle.CallBudget(str(tmp_path / "b"), 1000, 60.0, leases=1000)
    grid = spark.range(3).select(F.col("id").cast("string").alias("prompt"), F.lit(1).alias("run"))

    def fails(prompt):
        raise RuntimeError("down")

    generate.batch_complete(grid, fails, output=str(tmp_path / "o"), attempts=4, sleep=lambda s: None, budget=budget, partitions=1).count()
    assert sum(1 for w in (tmp_path / "b").iterdir() for _ in w.iterdir()) == 12
    out = ledger.complete_with_ledger(grid, lambda p: p, str(tmp_path / "l"), budget=budget)
    assert out.count() == 3 and sum(1 for w in (tmp_path / "b").iterdir() for _ in w.iterdir()) == 15
