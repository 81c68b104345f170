"""Resumable completion: a durable ledger of answered requests.

A request is a prompt with its key columns (such as the run) and the sampling options; its
digest is the SHA-256 of all of them.  Answers are written to the ledger by Spark tasks of at
most ``calls_per_task`` requests, and a task's file is moved into the ledger when the task
commits, not when the job ends (version 2 of the file committer).  A driver that dies
midway therefore loses only the tasks in flight; the next run reads the ledger, leaves out
every request it holds (an anti-join on the digest) and asks the rest.

The ledger only grows: a session (one call) writes its own folder, and where two sessions that
ran side by side answered the same request, the earlier one's answer holds.  Failed requests are
not recorded, so they are asked again on the next run.  ``compact`` rewrites the sessions that ended
as one; it is the only step that removes files, and only after its own are committed.

Equal requests (same prompt, keys and options) are one request: asked once, answered alike.  A null
prompt is never asked.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import answer_schema, completion_udf, finish_answers
from .throttle import CallBudget

LEDGER_SCHEMA = "digest string, answer string, started bigint"
CALLS_PER_TASK = 100
#: A task's files appear in the folder when the task commits.
_COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def request_digest(prompt: Column, keys: Mapping[str, Column], sampling: Mapping[str, object] | None = None) -> Column:
    """SHA-256 over prompt, key columns (by name, nulls kept apart from empty texts) and sampling options."""
    fields = [prompt.alias("prompt"), *[c.alias(f"key.{name}") for name, c in sorted(keys.items())]]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(body, F.lit(json.dumps(dict(sampling or {}), sort_keys=True))), 256)


def _path(spark: SparkSession, uri: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _sessions(spark: SparkSession, ledger: str, ended: bool = False) -> list[str]:
    """The sessions' folders (one per call, not per request); ``ended``: only those whose job came to its end."""
    p, fs = _path(spark, ledger)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("session=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.toString() for f in found if not ended or fs.exists(done(f, "_SUCCESS")))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """digest, answer of every recorded request: one row each, the earliest session's answer.

    Files of tasks that were in flight when a driver died lie below ``_temporary`` and are not read."""
    found = _sessions(spark, ledger)
    if not found:
        return spark.createDataFrame([], LEDGER_SCHEMA).select("digest", "answer")
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(*found)
    return rows.groupBy("digest").agg(F.min(F.struct("started", "answer")).alias("first")).select("digest", "first.answer")


def _record(rows: DataFrame, ledger: str) -> None:
    started = time.time_ns()
    target = f"{ledger.rstrip('/')}/session={started:020d}-{uuid.uuid4().hex}"
    rows.select("digest", "answer", F.lit(started).cast("long").alias("started")).write.options(**_COMMIT_BY_TASK).parquet(target)


def pending_requests(grid: DataFrame, ledger: str, prompt: str = "prompt", keys: Iterable[str] = ("run",),
                     sampling: Mapping[str, object] | None = None) -> DataFrame:
    """digest, prompt of the grid's requests that the ledger does not hold, one row each."""
    digest = request_digest(F.col(prompt), {k: F.col(f"`{k}`") for k in keys}, sampling)
    asked = grid.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")) \
        .groupBy("digest").agg(F.min("prompt").alias("prompt"))
    return asked.join(read_ledger(grid.sparkSession, ledger).select("digest"), "digest", "left_anti")


def complete_with_ledger(grid: DataFrame, fn: Callable[..., str | None], ledger: str, prompt: str = "prompt",
                         keys: Iterable[str] = ("run",), answer: str = "answer", attempts: int = 3, delay: float = 2.0,
                         backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep, stop: Iterable[str] | None = None,
                         keep_failed: bool = False, concurrency: int = 1, pause_every: int = 0, pause: float = 1.0,
                         sampling: Mapping[str, object] | None = None, calls_per_task: int = CALLS_PER_TASK,
                         budget: CallBudget | None = None) -> DataFrame:
    """:func:`generate.batch_complete` that never asks a recorded request again.

    ``keys`` are the grid columns that make requests with one prompt different.  The result is the
    grid joined to the ledger: a request that failed now and before has a null answer (dropped
    unless ``keep_failed``)."""
    spark = grid.sparkSession
    names = list(keys)
    pending = pending_requests(grid, ledger, prompt, names, sampling)
    waiting = pending.count()
    if waiting:
        client = functools.partial(fn, **sampling) if sampling else fn
        run = completion_udf(client, "prompt", "answer", attempts, delay, backoff, sleep, concurrency, pause_every, pause, budget)
        dealt = pending.repartition(-(-waiting // calls_per_task), "digest")
        _record(dealt.mapInArrow(run, answer_schema(dealt.schema)).where("answer is not null"), ledger)
    known = read_ledger(spark, ledger).select(F.col("digest").alias("_digest"), F.col("answer").alias(answer))
    digest = request_digest(F.col(prompt), {k: F.col(f"`{k}`") for k in names}, sampling)
    out = grid.withColumn("_asked", F.when(F.col(prompt).isNotNull(), digest)).join(known, F.col("_asked") == F.col("_digest"), "left") \
        .drop("_asked", "_digest")
    return finish_answers(out, answer, stop, keep_failed)


def compact(spark: SparkSession, ledger: str, rows_per_file: int = 1_000_000) -> int:
    """Rewrite the ended sessions as one; the number of sessions that were replaced.

    The new session carries each answer's own start, so a reader that sees both sees the same answers.
    Sessions without an end (still running, or of a dead driver) stay as they are."""
    found = _sessions(spark, ledger, ended=True)
    if len(found) < 2:
        return 0
    first = spark.read.schema(LEDGER_SCHEMA).parquet(*found).groupBy("digest").agg(F.min(F.struct("started", "answer")).alias("f"))
    target = f"{ledger.rstrip('/')}/session={time.time_ns():020d}-{uuid.uuid4().hex}"
    n = first.count()
    first.select("digest", "f.answer", "f.started").repartition(max(1, -(-n // rows_per_file)), "digest").write.parquet(target)
    for folder in found:
        p, fs = _path(spark, folder)
        fs.delete(p, True)
    return len(found)
