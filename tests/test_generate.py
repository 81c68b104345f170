"""Prompt grid and batch completion with an injected client."""

import sys

import pytest

from pyspark import cloudpickle
from pyspark.sql import functions as F

from recordaudit.operators import generate
from recordaudit.plans import jobs


def test_grid_shape_and_text(spark):
    prompts = spark.createDataFrame([(1, "About [CONDITION] at [LOCATION]"), (2, "Case {{CONDITION}}")],
                                    "prompt_id int, template string")
    conds = spark.createDataFrame([("flu", "{bg flu}"), ("cold", "{bg cold}")], "condition string, background string")
    locs = spark.createDataFrame([("Oslo",), ("Lima",), ("Pune",)], "location string")
    grid = generate.prompt_grid(prompts, conds, locations=locs, runs=4, suffix="T")
    assert grid.count() == 2 * 2 * 3 * 4
    r = grid.where("prompt_id = 1 and condition = 'flu' and location = 'Oslo' and run = 1").first()
    assert r.prompt == "About flu at Oslo\nbg flu\n\nT"
    r2 = grid.where("prompt_id = 2 and condition = 'cold'").first()
    assert r2.prompt.startswith("Case cold\nbg cold")


def test_grid_has_no_cap_and_plans_fast(spark):
    import time
    prompts = spark.createDataFrame([(1, "x [CONDITION]"), (2, "y [CONDITION]")], "prompt_id int, template string")
    conds = spark.range(20_000).select(F.col("id").cast("string").alias("condition"))
    t0 = time.perf_counter()
    grid = generate.prompt_grid(prompts, conds, background=None)
    assert time.perf_counter() - t0 < 5
    assert grid.count() == 40_000 and grid.select("prompt").distinct().count() == 40_000


def test_background_lookup_raises_on_a_missing_condition(spark):
    conds = spark.createDataFrame([("flu",), ("cold",)], "condition string")
    known = spark.createDataFrame([("flu", "bg")], "condition string, background string")
    assert generate.lookup_background(conds.where("condition = 'flu'"), known).first().background == "bg"
    with pytest.raises(Exception, match="no background for condition cold"):
        generate.lookup_background(conds, known).collect()


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the injected client travels by value


def flaky(prompt):
    if prompt.endswith("7"):
        raise RuntimeError("boom")
    if prompt.endswith("3"):
        return None
    return prompt.upper() + ". tail"


def test_batch_complete_failures_are_per_row(spark):
    grid = spark.range(20).select(F.col("id").alias("prompt_id"), F.lit(1).alias("run"),
                                  F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    out = generate.batch_complete(grid, flaky, attempts=2, sleep=lambda s: None, stop=["."])
    got = {r.prompt_id: r.answer for r in out.collect()}
    assert 7 not in got and 17 not in got and 3 not in got and 13 not in got
    assert got[1] == "P1" and len(got) == 16
    kept = generate.batch_complete(grid, flaky, attempts=1, sleep=lambda s: None, keep_failed=True)
    assert kept.count() == 20 and kept.where("answer is null").count() == 4


def test_complete_job_numbers_rows(spark):
    grid = spark.range(12).select((F.col("id") % 3).alias("prompt_id"), (F.col("id") / 3).cast("int").alias("run"),
                                  F.lit("x").alias("prompt"), (F.col("id") % 2).alias("grp"))
    out = jobs.complete(grid, lambda p: "ok", constants={"model_name": "m"}, number_by=["grp"],
                        sleep=lambda s: None).collect()
    for g in (0, 1):
        seqs = sorted(r.seq for r in out if r.grp == g)
        assert seqs == list(range(1, 7))
    assert {r.model_name for r in out} == {"m"}


def test_throttle_pauses_every_n_calls():
    import pyarrow as pa
    slept = []
    run = generate.completion_udf(lambda p: p + "!", sleep=slept.append, pause_every=10, pause=1.0,
                                  concurrency=3)
    batches = [pa.RecordBatch.from_pydict({"prompt": [f"p{i}" for i in range(25)]}), pa.RecordBatch.from_pydict({"prompt": ["a"] * 5})]
    out = list(run(iter(batches)))
    assert out[0].column("answer").to_pylist()[:2] == ["p0!", "p1!"] and out[1].num_rows == 5
    assert slept == [1.0, 1.0, 1.0]  # after calls 10, 20 and 30
    slept.clear()
    odd = [pa.RecordBatch.from_pydict({"prompt": ["x"] * 7}) for _ in range(3)]  # batch sizes not aligned with 10
    assert sum(b.num_rows for b in run(iter(odd))) == 21
    assert slept == [1.0, 1.0]  # after calls 10 and 20


def logged(prompt, folder=None):
    import os
    import uuid
    open(os.path.join(folder, uuid.uuid4().hex), "w").close()
    return prompt + "!"


def test_each_prompt_is_asked_once_and_keys_stay_exact(spark, tmp_path, monkeypatch):
    big = 9007199254740993
    grid = spark.createDataFrame([(big, "a"), (None, "b"), (3, None)], "k bigint, prompt string")
    calls = tmp_path / "calls"
    calls.mkdir()
    out = generate.batch_complete(grid, logged, output=str(tmp_path / "out"), keep_failed=True, sampling={"folder": str(calls)})
    for _ in range(2):  # evaluated twice, asked once; a null prompt is not asked
        assert {(r.k, r.prompt, r.answer) for r in out.collect()} == {(big, "a", "a!"), (None, "b", "b!"), (3, None, None)}
    assert len(list(calls.iterdir())) == 2
    monkeypatch.setattr(generate, "checkpoint_dir", lambda s: None)
    with pytest.raises(ValueError, match="output path"):
        generate.batch_complete(grid, logged)
