"""Shared helpers: tables, shared-folder writes, vectorised byte tokenisation."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, never a
    recomputation of ``df``; readers prune columns."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ARROW_ROWS = 2000  # rows of whole documents in an Arrow batch of a stage (Spark's own default is 10,000)


def plain_names(stage):
    """Stage decorator: columns beyond those of ``documents`` travel under neutral names, so they cannot
    clash with what a stage adds; one that clashes with a new output column comes back as ``<name>_in``.

    The session's Arrow batches are held to ARROW_ROWS rows: every batch carries whole documents and exists
    several times between the JVM and the workers."""
    @functools.wraps(stage)
    def run(spark, docs, sf_dir, *args, **kw):
        batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(batch)) <= ARROW_ROWS:
            spark.conf.set(batch, str(ARROW_ROWS))
        extra = {f"_extra_{i}": c for i, c in enumerate(docs.columns) if c not in DOCUMENT_COLUMNS}
        safe = docs.toDF(*[c if c in DOCUMENT_COLUMNS else f"_extra_{i}" for i, c in enumerate(docs.columns)])
        out = stage(spark, safe, sf_dir, *args, **kw)
        new = {c for c in out.columns if c not in extra}
        return out.toDF(*[c if c in new else extra[c] + ("_in" if extra[c] in new else "") for c in out.columns])

    return run


@functools.lru_cache(1)
def _malloc_trim():
    """glibc's malloc_trim, None where the C library has none."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim_memory() -> None:
    """Gives freed memory of this worker back to the machine, which the executor's other processes share."""
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim is not None:
        trim(0)


def inline_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small parameter table as a native plan (a JSON literal, no Python rows)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")))


def smallest_by_hash(rows: DataFrame, group: str, h: Column, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` rows of every value of ``group`` (a few values) with the smallest hash, ties by ``order``.

    The groups are counted first, and only rows below a share of the hash range that holds about 4 n
    rows of their group are ranked, so what meets in one task does not grow with the input; where
    repeated hashes leave fewer than ``n``, the share grows."""
    rows = rows.withColumn("_hash", h)
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    factor = 4
    while sizes:
        share = F.lit(1.0)
        for value, size in sizes.items():
            share = F.when(F.col(group) == F.lit(value), F.lit(min(factor * n / size, 1.0))).otherwise(share)
        below = rows.where(F.col("_hash").cast("double") / 2.0 ** 64 + 0.5 <= share)
        got = {r[group]: r["n"] for r in below.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
        if factor * n >= max(sizes.values()) or all(got.get(v, 0) >= min(n, size) for v, size in sizes.items()):
            rows = below
            break
        factor *= 8
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_hash", *order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_hash")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared-folder URI, on any node."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------------------
# Byte-level tokenisation of whole Arrow batches
# ---------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the polynomial hash
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two rounds of xor-shift and odd multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row boundaries."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = cut[cut > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


_BLOCK = 1 << 17  # bytes: the block's arrays stay in a core's cache


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span data[s:e]: equal bytes give equal hashes.

    Prefix sums of byte * b**i modulo 2**64, taken block by block so memory stays
    at a few times the block; a span is normalised by the inverse power of its start.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    up, down = powers(_BLOCK), powers(_BLOCK, _INV)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + _BLOCK, "right")), lo + 1)
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a > _BLOCK:  # one span longer than a block
            up_here, down_here = powers(b - a), powers(1, _INV)
        else:
            up_here, down_here = up[:b - a], down
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up_here, out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * down_here[s]
        lo = hi
    return mix(out ^ (ends - starts).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    i = batch.schema.get_field_index(column)
    col = batch.column(i)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(int(np.searchsorted(off, off[lo] + limit, "right")) - 1, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


# Separators among multi-byte characters: Latin-1 signs (C2 A0..BF), general
# punctuation (E2 80..81 xx), CJK punctuation (E3 80 xx).
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def word_mask(data: np.ndarray) -> np.ndarray:
    """True at bytes of letters and digits (any script), False at white space, signs and punctuation."""
    inside = _WORD[data]
    n = len(data)
    for lead, second, size in ((0xC2, (0xA0, 0xBF), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(data[:n - size + 1] == lead) if n >= size else np.zeros(0, np.int64)
        at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
        for k in range(size):
            inside[at + k] = False
    return inside


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word tokens of a (lower-cased) string column.

    Returns (bytes, starts, ends, hashes, first): the words of row i are first[i]:first[i + 1]."""
    data, off = string_bytes(col)
    starts, ends = runs(word_mask(data), off)
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first): all runs of ``size`` words per row; a shorter row that has
    words gives one shingle of all of them.  Not deduplicated."""
    count = np.diff(first)
    out_count = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    total = int(out_first[-1])
    row = np.repeat(np.arange(len(count)), out_count)
    start = first[:-1][row] + np.arange(total) - out_first[:-1][row]
    length = np.minimum(count[row], size)
    h = length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for j in range(size):
        word = padded[start + j]
        h = np.where(j < length, mix(h ^ word) * _ODD + np.uint64(j + 1), h)
    return mix(h), out_first


def distinct_per_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every row, ascending."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(first)))
