"""Prompt grids and batch completion.

The grid is prompts x conditions (x locations) x runs.  Both sides are dealt to blocks by
a hash, and a pair of blocks is one cell of an equi-join: as many cells as the product
needs at ``GRID_CELL`` rows each, no cap, no driver copy.

Completion calls a caller-supplied ``fn(prompt) -> str | None`` from ``mapInArrow``;
the number of partitions bounds the concurrency.  Answers of a remote model are not
repeatable, so they are written once, to a given path or to the shared folder, and
read back: later stages never call the model again.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import assemble_prompt, cut_at_stop_tokens, fill_template, strip_braces
from ..session import checkpoint_dir
from .throttle import CallBudget

# Placeholders of the two prompt styles.
CONDITION_PLACEHOLDERS = ("[CONDITION]", "{{CONDITION}}")
LOCATION_PLACEHOLDER = "[LOCATION]"
# Sampling options of the reference's chat requests (passed through to ``fn``).
DEFAULT_SAMPLING = {"max_tokens": 512, "temperature": 0.9, "top_p": 0.7, "top_k": 50,
                    "frequency_penalty": 0.5, "n": 1}
GRID_CELL = 200_000  # rows that a pair of blocks of the grid makes


def cells(left: int, right: int, rows: int = GRID_CELL) -> tuple[int, int]:
    """(blocks of the left rows, blocks of the right rows) so that a pair of blocks makes about ``rows`` rows
    and the copies (left x right blocks + right x left blocks) are fewest."""
    want = max(1, -(-left * right // rows))
    by_right = min(max(round((want * right / max(left, 1)) ** 0.5), 1), max(right, 1), want)
    return min(-(-want // by_right), max(left, 1)), by_right


def _times(grid: DataFrame, table: DataFrame, n_grid: int, n_table: int) -> DataFrame:
    """Every row of ``grid`` with every row of ``table``: an equi-join on the cells of a block matrix that is
    sized from both inputs, so the tasks grow with the product."""
    a, b = cells(n_grid, n_table)

    def dealt(df: DataFrame, blocks: int, others: int, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields])
        return df.withColumn(own, F.pmod(row, F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = dealt(grid, a, b, "_i", "_j"), dealt(table, b, a, "_j", "_i")
    if a * b > int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(a * b, "_i", "_j"), right.repartition(a * b, "_i", "_j")
    return left.join(right, ["_i", "_j"]).drop("_i", "_j")


def lookup_background(conditions: DataFrame, backgrounds: DataFrame, condition: str = "condition",
                      background: str = "background") -> DataFrame:
    """Attach the background of each condition by a join; a condition without one raises when it is read."""
    b = backgrounds.select(F.col(condition).alias("_c"), F.col(background).alias(background)).dropDuplicates(["_c"])
    joined = conditions.drop(background).join(b, F.col(condition) == F.col("_c"), "left")
    missing = F.raise_error(F.concat(F.lit("no background for condition "), F.coalesce(F.col(condition), F.lit("NULL"))))
    return joined.withColumn(background, F.coalesce(F.col(background), missing.cast("string"))).drop("_c")


def prompt_grid(prompts: DataFrame, conditions: DataFrame, template: str = "template",
                condition: str = "condition", background: str | None = "background",
                locations: DataFrame | None = None, location: str = "location",
                runs: int = 1, suffix: str | Column | None = None,
                placeholders: Iterable[str] = CONDITION_PLACEHOLDERS,
                location_placeholder: str = LOCATION_PLACEHOLDER,
                line_sep: str = "\n", block_sep: str = "\n\n", carry: Iterable[str] = ()) -> DataFrame:
    """Every prompt template x condition (x location) x run, with the final prompt text.

    ``carry`` passes further condition columns through (e.g. the English
    disease name stored on Chinese rows as the shared key).
    Output: prompt columns, ``condition``, [``background``], [carried], [``location``],
    ``run`` (1..runs), ``prompt``.  The inputs are counted when the plan is built.
    """
    cond_cols = [condition] + ([background] if background else []) + list(carry)
    n, n_conditions = prompts.count(), conditions.count()
    grid = _times(prompts, conditions.select(*[F.col(c).cast("string").alias(c) for c in cond_cols]), n, n_conditions)
    if locations is not None:
        grid = _times(grid, locations.select(F.col(location).cast("string").alias(location)), n * n_conditions, locations.count())
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(int(runs)))).alias("run"))
    text = F.col(template)
    for ph in placeholders:
        text = fill_template(text, ph, F.col(condition))
    if locations is not None:
        text = fill_template(text, location_placeholder, F.col(location))
    bg = strip_braces(F.col(background)) if background else None
    suffix_col = F.lit(suffix) if isinstance(suffix, str) else suffix
    return grid.withColumn("prompt", assemble_prompt(text, bg, suffix_col, line_sep, block_sep))


def _call_with_retry(fn: Callable[[str], str | None], prompt, attempts: int, delay: float, backoff: float,
                     sleep: Callable[[float], None]):
    wait = delay
    for i in range(attempts):
        try:
            out = fn(prompt)
            return out if isinstance(out, str) else None
        except Exception:  # a failed call only loses this run
            if i + 1 < attempts:
                sleep(wait)
                wait *= backoff
    return None


def completion_udf(fn: Callable[[str], str | None], prompt: str = "prompt", answer: str = "answer",
                   attempts: int = 3, delay: float = 2.0, backoff: float = 2.0,
                   sleep: Callable[[float], None] = time.sleep, concurrency: int = 1,
                   pause_every: int = 0, pause: float = 1.0, budget: CallBudget | None = None):
    """The per-partition function for ``mapInArrow``: appends ``answer`` to each batch; the other
    columns pass untouched.  A null prompt gets a null answer without a call.

    With ``concurrency > 1`` each task keeps that many calls in flight (the
    calls are I/O bound); the answers keep the row order of the batch.
    ``pause_every`` > 0 throttles each task: after that many prompts it sleeps
    ``pause`` seconds (the reference pauses 1 s every 10 calls).  ``budget`` bounds the calls of all
    tasks together; every attempt counts.
    """
    def ask(p):
        if budget is not None:
            budget.take()
        return fn(p)

    def call(p):
        return None if p is None else _call_with_retry(ask, p, attempts, delay, backoff, sleep)

    def run(batches):
        pool = None
        if concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor
            pool = ThreadPoolExecutor(max_workers=concurrency)
        step = pause_every if pause_every > 0 else None
        done = 0
        try:
            for batch in batches:
                prompts = batch.column(prompt).to_pylist()
                answers, i = [], 0
                while i < len(prompts):
                    # a chunk never crosses the next pause point, whatever the batch sizes
                    n = step - done % step if step else len(prompts) - i
                    chunk = prompts[i:i + n]
                    answers += list(pool.map(call, chunk)) if pool else [call(p) for p in chunk]
                    done += len(chunk)
                    i += len(chunk)
                    if step and done % step == 0:
                        sleep(pause)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())],
                                                 names=[*batch.schema.names, answer])
        finally:
            if pool:
                pool.shutdown()

    return run


def answer_schema(schema: T.StructType, answer: str = "answer") -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(answer, T.StringType(), True)])


def finish_answers(out: DataFrame, answer: str = "answer", stop: Iterable[str] | None = None,
                   keep_failed: bool = False) -> DataFrame:
    """Cut answers at the first stop token and drop failed rows (unless kept)."""
    if stop:
        out = out.withColumn(answer, cut_at_stop_tokens(F.col(answer), stop))
    if not keep_failed:
        out = out.where(F.col(answer).isNotNull())
    return out


def batch_complete(grid: DataFrame, fn: Callable[..., str | None], prompt: str = "prompt",
                   answer: str = "answer", attempts: int = 3, delay: float = 2.0, backoff: float = 2.0,
                   sleep: Callable[[float], None] = time.sleep, partitions: int | None = None,
                   stop: Iterable[str] | None = None, keep_failed: bool = False, output: str | None = None,
                   concurrency: int = 1, pause_every: int = 0, pause: float = 1.0,
                   sampling: Mapping[str, object] | None = None, budget: CallBudget | None = None) -> DataFrame:
    """Call ``fn`` once per grid row; retries with back-off; null after the last
    failure (only that row is lost).  Failed rows are dropped unless
    ``keep_failed``; the answer is cut at the first ``stop`` token.
    ``partitions`` x ``concurrency`` bounds the calls in flight; ``pause_every``
    / ``pause`` throttle each task, ``budget`` all tasks together.  ``sampling`` options are passed to ``fn`` as keywords.

    The answers are written once, to ``output`` or to a new folder below the session's shared
    folder, and the result reads them back; without either this raises."""
    spark = grid.sparkSession
    target = output or (f"{checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}" if checkpoint_dir(spark) else None)
    if target is None:
        raise ValueError("answers cannot be repeated: give an output path or set spark.checkpoint.dir")
    client = functools.partial(fn, **sampling) if sampling else fn
    run = completion_udf(client, prompt, answer, attempts, delay, backoff, sleep, concurrency, pause_every, pause, budget)
    src = grid.repartition(partitions) if partitions else grid
    schema = answer_schema(grid.schema, answer)
    src.mapInArrow(run, schema).write.parquet(target)
    return finish_answers(spark.read.schema(schema).parquet(target), answer, stop, keep_failed)


def stamp(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Constant columns on every row (model name, language ...)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})
