"""Incremental batch completion with Structured Streaming.

Grid files dropped into ``source`` are answered micro-batch by micro-batch
and appended to a file sink.  The checkpoint records which files are done
and the file sink commits each micro-batch atomically, so after a driver
restart or a lost executor the job resumes at the first uncommitted batch:
answers already written are never requested from the model again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.generate import answer_schema, completion_udf, finish_answers
from ..operators.throttle import CallBudget


def complete_stream(spark: SparkSession, source: str, schema: T.StructType | str, fn: Callable[[str], str | None],
                    sink: str, checkpoint: str, prompt: str = "prompt", answer: str = "answer",
                    fmt: str = "parquet", max_files_per_trigger: int | None = None,
                    stop: Iterable[str] | None = None, keep_failed: bool = False, attempts: int = 3,
                    delay: float = 2.0, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep,
                    concurrency: int = 1, available_now: bool = True, pause_every: int = 0,
                    pause: float = 1.0, partition_by: Iterable[str] = (), budget: CallBudget | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops.

    ``partition_by`` lays the sink out per key (model / disease / language ...).
    Row numbering needs the finished set, so it is a batch step over the sink
    (``align.number_rows``), not part of the stream.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    grid = reader.load(source)
    run = completion_udf(fn, prompt, answer, attempts, delay, backoff, sleep, concurrency, pause_every, pause, budget)
    answered = finish_answers(grid.mapInArrow(run, answer_schema(grid.schema, answer)), answer, stop, keep_failed)
    writer = (answered.writeStream.format(fmt).outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
