"""Language-model scoring with a hierarchical Pitman-Yor model.

Words are dishes.  A context restaurant holds the words that follow a context, and every
previous word (and the start of a text) is a context with a restaurant of its own.  All
context restaurants share one parent, the restaurant of single words, whose base is uniform
over the V + 1 word types (one stands for all unknown words).  A word's probability
under a seating is

    P(w | u) = (n_uw - d t_uw) / (h + n_u) + (h + d t_u) / (h + n_u) * P(w)

with customers n, tables t, discount d and strength h; P(w) is the same formula in the
parent, whose customers are the tables of its children.  A context without customers gives P(w).

Training: tasks count (word, context) in their documents and deal the counts by the word's
hash to buckets, one packed row per task and bucket.  Words that hold at least 1/``FREQUENT``
of a sample's tokens are spread over all buckets by their contexts; that decides where their
dishes lie, not what is counted.  Seating is sampled by Gibbs with the customers'
places summed out: a dish's table count, given all others', has probability in proportion
to S(n, t) (the weight of all seatings of its n customers at t tables) times the weights of
t new tables in its context and of t customers of its word in the parent.  A round draws
every dish's count anew from that law, however many customers it has, a word's dishes one
after another; then the parent's.  Between rounds only the restaurants' totals are exchanged:
every bucket sends the tables of its contexts to the contexts' own buckets, which add them up
and answer (``exchange``); within a round other dishes' totals are held fixed.  A dish of one
customer has one table, so after the first exchange only contexts with larger dishes take part.
The predictive probabilities of the last ``SAMPLES`` rounds are averaged.

Scoring: a last exchange gives each bucket the totals of all its contexts.  Contexts with at
least 1/``CONTEXTS`` of all training tokens are known to every task.  Words with at least
1/``FREQUENT`` of them are scored after such contexts where the text is read, from a table of at
most FREQUENT x CONTEXTS probabilities; all other tokens go to their word's bucket, packed per
block of documents, and the sums return to the block.  A token whose context is not in its
word's bucket (so the word never followed it) takes the word's parent probabilities along to
the context's bucket.

Defined cases: null and empty texts have one token, the end; a null doc_id counts as the
empty string for the fold; repeated rows are each scored; without training tokens every
token gets the base 1.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, materialize, mix, new_folder, runs, slices, span_hashes, string_bytes, table, trim_memory
from .langid import FOLD, held_out

CONTEXTS = 4096  # contexts that every task knows are those with 1/CONTEXTS of all training tokens
FREQUENT = 1024
SPREAD_PART, SPREAD_LEAST = 32, 1000  # one document of so many is looked at for words to spread, which occur so often there
ROUNDS, SAMPLES = 4, 2
HOME_CONTEXTS = 8192  # a context's own bucket holds so many contexts at least; small vocabularies have fewer of them than words have buckets
BLOCKS = 32  # parts of a word's dishes that are drawn one after another
EXACT, TERMS, NODES, ROOT_NODES = 1024, 100, 65, 1 << 16
CELLS = 1 << 18  # size of the drawing arrays
DISCOUNT, STRENGTH = 0.75, 1.0  # context restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 1.0
END = np.uint64(0x6A09E667F3BCC909)
BEGIN = np.uint64(0xBB67AE8584CAA73B)  # the context of a text's first token
FLUSH_PAIRS = 1_000_000
FLUSH_BYTES = 2 << 20
BASE_ALPHA = 0.1
PASSES = 2  # shares of the documents whose tokens are dealt one after another
PART = 32  # a document's number in its task takes the low bits of a block or document key, the task's the high ones
UNITS = 1e9  # part sums of log10 probabilities travel as integers of this many units

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, contexts, first): a context is the hash of the previous word; the tokens of row i, the end included, are first[i]:first[i + 1]."""
    data, off = string_bytes(col)
    starts, ends = runs(~_SPACE[data], off)
    h = span_hashes(FOLD[data], starts, ends)
    count = np.diff(np.searchsorted(starts, off))
    first = np.concatenate([[0], np.cumsum(count + 1)])
    word = np.full(int(first[-1]), END, np.uint64)
    is_end = np.zeros(len(word), bool)
    is_end[first[1:] - 1] = True
    word[~is_end] = h
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = BEGIN
    return word, context, first


def numbered(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types, words, contexts): the different words, BEGIN after them, and the tokens' words and contexts as numbers of types."""
    types, w = np.unique(word, return_inverse=True)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[first[:-1]] = len(types)
    return np.append(types, BEGIN), w, u


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return (word >> np.uint64(33)).astype(np.int64) % buckets


def dish_bucket(word: np.ndarray, context: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    """The word's bucket; one by word and context for words in ``spread``."""
    out = bucket_of(word, buckets)
    often = np.flatnonzero(member(word, spread) >= 0)
    out[often] = bucket_of(mix(context[often] ^ mix(word[often])), buckets)
    return out


def home_count(v: int, buckets: int) -> int:
    """The contexts' own buckets for V words, so a bucket's message to one of them is not cut finer as buckets become many."""
    return max(min(v // HOME_CONTEXTS, buckets), 1)


def context_bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so contexts in order are in order of their buckets, too."""
    return (((context >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each x in ascending ``values``, -1 where it is not there."""
    out = np.full(len(x), -1)
    if not len(values):
        return out
    maybe = np.zeros(1 << 20, bool)
    maybe[(values >> np.uint64(44)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(x >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(values, x[hit]), len(values) - 1)
    out[hit] = np.where(values[k] == x[hit], k, -1)
    return out


def add_equal(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their summed counts."""
    order = np.argsort(code)
    code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.add.reduceat(n[order], new) if len(new) else np.zeros(0, np.int64)


def add_up(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers (below 2**53) by place."""
    return np.rint(np.bincount(at, n, size)).astype(np.int64)


def pack_pairs(w: np.ndarray, u: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Words once with their number of contexts; counts of one byte, larger ones in a list of their own."""
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    per = np.diff(np.append(at, len(w)))
    big = n >= 255
    return [w[at].tobytes(), pack_ints(per), u.astype(np.uint64).tobytes(), np.where(big, 255, n).astype(np.uint8).tobytes(),
            n[big].astype(np.int64).tobytes()]


def unpack_pairs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(parts[0], np.uint64), unpack_ints(parts[1])), np.frombuffer(parts[2], np.uint64), unpack_counts(parts)


def unpack_counts(parts: list[bytes]) -> np.ndarray:
    n = np.frombuffer(parts[3], np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(parts[4], np.int64)
    return n


def pack_tables(t: np.ndarray) -> bytes:
    """Counts of one byte each; larger ones follow as 64-bit integers in order.  The bytes between bring the length to
    4 k + 1, so a plain array of 32-bit counts cannot be taken for it."""
    big = t >= 255
    return np.where(big, 255, t).astype(np.uint8).tobytes() + bytes((1 - len(t)) % 4) + t[big].astype(np.int64).tobytes()


def unpack_tables(raw: bytes, n: int) -> np.ndarray:
    """Packed counts, or a plain array of 32-bit ones."""
    if len(raw) % 4 == 0:
        return np.frombuffer(raw, np.int32, n).astype(np.int64)
    t = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    t[t == 255] = np.frombuffer(raw, np.int64, offset=n + (1 - n) % 4)
    return t


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers in as many bytes each as the largest one needs (the first byte says how many)."""
    width = max((int(x.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ints(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.int64)


def pack_dishes(w: np.ndarray, u: np.ndarray, n: np.ndarray) -> list[bytes]:
    """As ``pack_pairs``, with the places of the contexts in a list of all contexts, which comes last."""
    contexts, at = np.unique(u, return_inverse=True)
    words, per, _, few, many = pack_pairs(w, u, n)
    return [words, per, pack_ints(at), few, many, contexts.tobytes()]


def merge_pairs(parts: list[list[bytes]]) -> list[bytes]:
    """``pack_dishes`` of the pairs of several ``pack_pairs``, their counts summed."""
    words, at = np.unique(np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts]), return_inverse=True)
    contexts, u = np.unique(np.concatenate([np.frombuffer(p[2], np.uint64) for p in parts]), return_inverse=True)
    w = np.repeat(at, np.concatenate([unpack_ints(p[1]) for p in parts]))
    code, n = add_equal(w * max(len(contexts), 1) + u, np.concatenate([unpack_counts(p) for p in parts]))
    w, u = np.divmod(code, max(len(contexts), 1))
    big = n >= 255
    return [words.tobytes(), pack_ints(np.bincount(w, minlength=len(words))), pack_ints(u), np.where(big, 255, n).astype(np.uint8).tobytes(),
            n[big].astype(np.int64).tobytes(), contexts.tobytes()]


BLOBS = ["x1", "x2", "x3", "x4", "x5", "x6"]
ROW_SCHEMA = "bucket int, kind int, block bigint, " + ", ".join(f"{b} binary" for b in BLOBS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, block, blobs...) as a batch; missing blobs are null."""
    full = [(*r, *[None] * (3 + len(BLOBS) - len(r))) for r in rows]
    cols = list(zip(*full, strict=True)) if full else [()] * (3 + len(BLOBS))
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * len(BLOBS)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "kind", "block", *BLOBS])


def _groups(batches: Iterator[pa.RecordBatch], key: str, shift: int = 0) -> Iterator[tuple[int, Iterator[dict]]]:
    """Consecutive rows with equal ``key`` (above its lowest ``shift`` bits), one row at a time."""
    import itertools

    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    return itertools.groupby(rows, lambda r: r[key] >> shift)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within, Spark removes a query's shuffle files as soon as its result has been written, and Arrow batches hold at
    most ARROW_ROWS rows, as they carry whole documents."""
    tidy, batch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in (tidy, batch)}
    spark.conf.set(tidy, "true")
    if not 0 < int(before[batch]) <= ARROW_ROWS:
        spark.conf.set(batch, str(ARROW_ROWS))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` written into the shared folder as a table bucketed by ``bucket``: joins of such tables do not shuffle."""
    spark = df.sparkSession
    entry = f"lm_{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.format("parquet").bucketBy(buckets, "bucket").option("path", new_folder(spark, name)).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the catalog's entry; the files are the query's
    return out


def per_row(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(row)`` gives the rows for every row, one at a time."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                out = run(r)
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(arrow))
                del r, out
                trim_memory()

    arrow = [(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")]
    return rows.mapInArrow(each, schema)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def spread_words(docs: DataFrame) -> np.ndarray:
    """Words with at least 1/FREQUENT of a sample's tokens.  They only decide how dishes are dealt, so the sample bears on
    no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                w, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
                many = n * 4 * FREQUENT >= n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(w[many].view(np.int64), 0)), pa.array(np.append(n[many], n.sum())),
                                                  pa.array(np.append(np.zeros(int(many.sum()), bool), True))], names=["w", "n", "whole"])

    some = docs.where(~held_out(F.col("doc_id"), 10, 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD_PART)) == 0)).select("text")
    sums = some.mapInArrow(run, "w bigint, n bigint, whole boolean").groupBy("w", "whole").agg(F.sum("n").alias("n"))
    with tidy_shuffles(docs.sparkSession):
        rows = sums.orderBy(F.desc("whole"), F.desc("n"), "w").limit(1 + FREQUENT).collect()
    return np.sort(np.array([r["w"] for r in rows[1:] if r["n"] >= max(rows[0]["n"] / FREQUENT, SPREAD_LEAST)], np.int64).view(np.uint64))


def count_corpus(docs: DataFrame, buckets: int, spread: np.ndarray) -> DataFrame:
    """(bucket, x1..x6, tally): the packed (word, context, count) of all training documents, one row per bucket, and its tokens,
    words that are not spread and tokens of spread words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (types, words, contexts, counts) of the pairs of a slice
        size = 0

        def flush() -> pa.RecordBatch:
            types, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            cut = np.cumsum([0, *[len(h[0]) for h in held]])
            w, u = (np.concatenate([at[x + h[k]] for x, h in zip(cut, held, strict=False)]) for k in (1, 2))
            code, n = add_equal(w * len(types) + u, np.concatenate([h[3] for h in held]))
            w, u = (types[x] for x in np.divmod(code, len(types)))
            b = dish_bucket(w, u, spread, buckets)
            order = np.argsort(b, kind="stable")
            w, u, n, b = w[order], u[order], n[order], b[order]
            cut = np.searchsorted(b, np.arange(buckets + 1))
            held.clear()
            return _rows([(k, 0, 0, *pack_pairs(w[x:y], u[x:y], n[x:y]))
                          for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x])

        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                word, _, first = tokens(batch.column("text"))
                types, w, u = numbered(word, first)
                code, n = np.unique(w * len(types) + u, return_counts=True)
                held.append((types, *np.divmod(code, len(types)), n))
                size += len(n)
                if size >= FLUSH_PAIRS:  # bounded memory: what has been counted goes out
                    yield flush()
                    size = 0
                    trim_memory()
        if held:
            yield flush()
            trim_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            parts = merge_pairs([[r[b] for b in BLOBS[:5]] for r in rows])
            words, n = np.frombuffer(parts[0], np.uint64), unpack_counts(parts)
            tally = [[n.sum(), (member(words, spread) < 0).sum()], by_spread(words, unpack_ints(parts[1]), n, spread)]
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, **dict(zip(BLOBS, parts, strict=True)), "tally": np.concatenate(tally).tobytes()}],
                                             pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in (*BLOBS, "tally")]]))
            del parts, words, n
            trim_memory()

    train = docs.where(~held_out(F.col("doc_id"), 10, 0)).select("text")
    dealt = train.mapInArrow(count, ROW_SCHEMA).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return bucketed(dealt.mapInArrow(merge, "bucket int, " + ", ".join(f"{x} binary" for x in (*BLOBS, "tally"))), "lm-counts", buckets)


class Seats:
    """Customers of many dishes at tables: tables in order of dish, with their sizes.  The seating customer by
    customer, which ``draw_tables`` is held against."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray):
        self.n = customers.astype(np.int64)
        self.t = np.minimum(tables, customers).astype(np.int64)
        self.dish = np.repeat(np.arange(len(self.n)), self.t)
        self.size = np.ones(len(self.dish), np.int64)
        first = np.cumsum(self.t) - self.t
        has = self.t > 0
        self.size[first[has]] = (self.n - self.t + 1)[has]

    def _tidy(self, opened: np.ndarray) -> None:
        keep = self.size > 0
        dish = np.concatenate([self.dish[keep], opened])
        size = np.concatenate([self.size[keep], np.ones(len(opened), np.int64)])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]

    def leave(self, who: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """One random customer of each dish in ``who`` (ascending) leaves; True where the table closes."""
        ends = np.cumsum(self.size)
        start = np.cumsum(self.n) - self.n
        at = np.searchsorted(ends, start[who] + (rng.random(len(who)) * self.n[who]).astype(np.int64), "right")
        self.size[at] -= 1
        closed = self.size[at] == 0
        self.n[who] -= 1
        self.t[who] -= closed
        self._tidy(np.zeros(0, np.int64))
        return closed

    def enter(self, who: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """One customer enters each dish in ``who``; ``fresh`` is the weight of a new table.  True where one opens."""
        old = self.n[who] - discount * self.t[who]
        opens = rng.random(len(who)) * (old + fresh) >= old
        sit = who[~opens]
        weight = np.cumsum(self.size - discount)
        start = np.concatenate([[0.0], weight])[np.searchsorted(self.dish, sit)]
        pick = np.searchsorted(weight, start + rng.random(len(sit)) * old[~opens], "right")
        last = np.searchsorted(self.dish, sit, "right") - 1
        np.add.at(self.size, np.minimum(np.maximum(pick, np.searchsorted(self.dish, sit)), last), 1)
        self.n[who] += 1
        self.t[who] += opens
        self._tidy(who[opens])
        return opens


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0: Stirling's series eight steps higher."""
    x = np.asarray(x, np.float64)
    y = x + 8
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(low)


@functools.lru_cache
def stirling_rows(discount: float) -> np.ndarray:
    """log S(n, t), n and t up to ``EXACT``, by recursion: S(n + 1, t) = S(n, t - 1) + (n - d t) S(n, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore"):
        for n in range(EXACT):
            out[n + 1] = out[n] + np.log(np.maximum(n - discount * t, 0))
            out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


@functools.lru_cache(4)
def _series(n: int, d: float) -> np.ndarray:
    """Factors of t (t - 1) ... (t - k + 1) / n**(d k) in the alternating series of P(n)."""
    k = np.arange(1, min(TERMS, int((n - 1) / d)) + 1)
    part = log_gamma(n - d * k) + log_gamma(1 + d * k) - log_gamma(k + 1) - log_gamma(n + 1) + d * k * np.log(n)
    return np.where(k % 2, 1, -1) * np.sin(np.pi * d * k) / np.pi * np.exp(part)


def _mean(x: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(log m, -d log m / dx): m is the mean of a Sibuya variable under the tilt 1 - e**x."""
    rest, left = -np.expm1(x), -np.expm1(d * x)
    return np.log(d) + np.log(rest) + (d - 1) * x - np.log(left), (1 - rest) / rest + 1 - d - d * (1 - left) / left


@functools.lru_cache(2)
def _tilts(d: float) -> tuple[np.ndarray, np.ndarray]:
    x = -np.geomspace(1e-9, 80, 4096)
    return _mean(x, d)[0], x


def log_stirling(n: int, t: np.ndarray, d: float) -> np.ndarray:
    """log S(n, t), the weight of all seatings of n customers at t tables.  S(n, t) = n! / (t! d**t) P(n), P the law
    of a sum of t Sibuya variables: an alternating series where one large table leads, else a saddle point."""
    if n <= EXACT:
        return stirling_rows(d)[n, t]
    t = np.asarray(t, np.float64)
    out = np.zeros(len(t))
    near = t <= 2.5 * n ** d
    if near.any():
        c = _series(n, d)
        falling = np.cumprod(np.maximum(t[near, None] - np.arange(len(c)), 0) / n ** d, axis=1)  # 2.5**TERMS at most
        out[near] = np.log(np.maximum(falling @ c, 1e-300))
    far = ~near & (t < n)
    if far.any():
        tt = t[far]
        want = np.log(n / tt)
        x = np.interp(want, *_tilts(d))
        for _ in range(3):  # Newton steps to the tilt whose mean is n / t
            mean, slope = _mean(x, d)
            x = np.clip(x + (mean - want) / slope, -80.0, -1e-12)
        y = np.exp(x)
        u = y ** d
        a, b = (1 - y) / y, u / (1 - u)
        k1, q = d * a * b, 1 + a - d * a * (1 + b)
        inner = a * (1 + a) - d * a * a * b
        q1 = a * (1 + a) - d * (1 + b) * inner
        q2 = a * (1 + a) * (1 + 2 * a) + d * d * a * b * (1 + b) * inner \
            - d * (1 + b) * (a * (1 + a) * (1 + 2 * a) - d * (2 * a * a * (1 + a) * b - d * a ** 3 * b * (1 + b)))
        k2 = k1 * q
        k3 = k2 * q + k1 * q1
        k4 = k3 * q + 2 * k2 * q1 + k1 * q2
        second = (k4 / k2 ** 2 / 8 - 5 * k3 ** 2 / k2 ** 3 / 24) / tt
        out[far] = tt * np.log1p(-u) - n * np.log1p(-y) - 0.5 * np.log(2 * np.pi * tt * k2) + np.log1p(np.clip(second, -0.5, 0.5))
    return np.where(t < n, out + log_gamma(n + 1) - log_gamma(t + 1) - t * np.log(d), 0.0)


def draw_tables(n: np.ndarray, step, weight, discount: float, rng: np.random.Generator) -> np.ndarray:
    """For every dish the tables of its n customers, t with probability in proportion to S(n, t) exp(weight(dish, t)):
    a draw from the law that moves of single customers have in the long run, whatever n is.  ``step(dish, t)`` is
    exp(weight(dish, t + 1) - weight(dish, t))."""
    out = np.ones(len(n), np.int64)
    rows, low = stirling_rows(discount), 1
    while low < EXACT:
        top = low * 2
        some = np.flatnonzero((n > low) & (n <= top))
        t = np.arange(1, top)
        for lo in range(0, len(some), CELLS // top):
            at = some[lo:lo + CELLS // top]
            p = np.ones((len(at), top))
            p[:, 1:] = step(at[:, None], t[None, :])
            if top <= 32:  # far from the limits of a double
                p = np.cumprod(p, axis=1) * np.exp(rows[:top + 1, 1:top + 1])[n[at]]
            else:
                p = np.cumsum(np.log(p), axis=1) + rows[n[at], 1:top + 1]
                p = np.exp(p - p.max(axis=1, keepdims=True))
            p = np.cumsum(p, axis=1)
            out[at] = 1 + (p <= rng.random((len(at), 1)) * p[:, -1:]).sum(axis=1)
        low = top
    for i in np.flatnonzero(n > EXACT).tolist():
        one = np.array([i])
        size = int(n[i])
        t = np.unique(np.rint(np.geomspace(1, size, NODES)).astype(np.int64))
        while True:  # nodes closer and closer around the law's mass
            p = log_stirling(size, t, discount) + weight(one, t)
            mass = np.flatnonzero(p > p.max() - 30)
            a, b = int(t[max(mass[0] - 1, 0)]), int(t[min(mass[-1] + 1, len(t) - 1)])
            if len(mass) > NODES // 2 or b - a <= len(t):
                break
            t = np.unique(np.rint(np.linspace(a, b, NODES)).astype(np.int64))
        whole = np.arange(a, b + 1)
        if b - a <= NODES:
            p, t = log_stirling(size, whole, discount) + weight(one, whole), whole
        p = np.cumsum(np.exp(np.interp(whole, t, p) - p.max()))
        out[i] = a + min(int((p <= rng.random() * p[-1]).sum()), b - a)
    return out


@functools.lru_cache(2)
class Root:
    """log Z(c): the weight of all seatings of a word's c customers in the parent, where a table has weight ``fresh``."""

    def __init__(self, fresh: float):
        rows = stirling_rows(ROOT_DISCOUNT)[:, 1:] + np.arange(1, EXACT + 1) * np.log(fresh)
        exact = np.concatenate([[0.0], np.logaddexp.reduce(rows[1:], axis=1)])
        node = np.unique(np.rint(np.geomspace(EXACT, ROOT_NODES, 40)).astype(np.int64))
        t, mean = np.arange(1, 257), []
        for c in node.tolist():  # expected tables, which hardly grow any more
            p = log_stirling(c, t, ROOT_DISCOUNT) + t * np.log(fresh)
            p = np.exp(p - p.max())
            mean.append((p * t).sum() / p.sum())
        c = np.arange(EXACT, ROOT_NODES)
        steps = np.log(c - ROOT_DISCOUNT * np.interp(np.log(c), np.log(node), mean) + fresh)
        self.z = np.concatenate([exact, exact[-1] + np.cumsum(steps)])
        self.shift = fresh - ROOT_DISCOUNT * mean[-1]
        self.ratio = np.exp(np.diff(self.z))

    def step(self, c: np.ndarray) -> np.ndarray:
        """Z(c + 1) / Z(c)."""
        if c.max() < ROOT_NODES:
            return self.ratio[c]
        return np.where(c < ROOT_NODES, self.ratio[np.minimum(c, ROOT_NODES - 1)], c + self.shift)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        out = self.z[np.minimum(c, ROOT_NODES)]
        far = c > ROOT_NODES
        if far.any():
            out[far] += log_gamma(c[far] + self.shift) - log_gamma(ROOT_NODES + self.shift)
        return out


def expected_tables(n: np.ndarray, fresh: np.ndarray, discount: float) -> np.ndarray:
    """A start for the sampler: the tables that customers would open one after another, on average."""
    t, done, some = np.ones(len(n)), np.ones(len(n)), np.flatnonzero(n > 1)
    while len(some):
        block = np.minimum(np.maximum(done[some] // 2, 1), n[some] - done[some])
        t[some] += block * fresh[some] / (fresh[some] + done[some] - discount * t[some])
        done[some] += block
        some = some[done[some] < n[some]]
    return np.clip(np.rint(t), 1, n)


class Bucket:
    """The dishes of one bucket: counts, seating, and the parent's seating of its words."""

    def __init__(self, parts: list[bytes]):
        if len(parts) == 5:
            parts = pack_dishes(*unpack_pairs(parts))
        self.words, per = np.frombuffer(parts[0], np.uint64), unpack_ints(parts[1])
        self.n, self.u, self.contexts = unpack_counts(parts), unpack_ints(parts[2]), np.frombuffer(parts[5], np.uint64)
        self.per, self.first = per, np.cumsum(per) - per
        self.word = np.repeat(np.arange(len(per)), per)
        self.count = np.add.reduceat(self.n, self.first) if len(per) else self.n

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of each context in this bucket."""
        return add_up(self.u, t, len(self.contexts))

    def open(self) -> np.ndarray:
        """Whether a context has a dish whose tables can change."""
        out = np.zeros(len(self.contexts), bool)
        out[self.u[self.n > 1]] = True
        return out

    def sample(self, state: tuple[bytes, bytes] | None, totals: dict, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """One round: (tables of each dish, parent tables of each word).  ``totals["tables"]`` are those of ``contexts``.
        The customers that a spread word has in the parent from other buckets are held fixed; its parent tables are 0 here."""
        spread, tokens_of, seated = totals.get("spread", NO_SPREAD)
        often = member(self.words, spread)
        apart = often >= 0
        base = 1.0 / (totals["V"] + 1)
        opening = STRENGTH + DISCOUNT * totals["tables"][self.u]
        root_open = (ROOT_STRENGTH + ROOT_DISCOUNT * totals["root_tables"]) * base
        norm = ROOT_STRENGTH + totals["root_customers"]
        if state is None:
            count = self.count.copy()
            count[apart] = tokens_of[often[apart]]
            p = (count + root_open) / norm
            t = np.ones(len(self.n), np.int64)
            some = np.flatnonzero(self.n > 1)
            t[some] = expected_tables(self.n[some], opening[some] * p[self.word[some]], DISCOUNT)
        else:
            t = unpack_tables(state[0], len(self.n))
        z = Root(root_open)
        c = np.add.reduceat(t, self.first)
        if apart.any():
            k = often[apart]
            others = c[apart] * tokens_of[k] // self.count[apart] if seated is None else seated[k]
            c[apart] = np.maximum(others, c[apart])
        # a word's dishes in random order, one after another; those of a word with more than BLOCKS in BLOCKS parts
        many = np.flatnonzero(self.n > 1)
        many = many[rng.permutation(len(many))]
        many = many[np.argsort(self.word[many], kind="stable")]
        dishes = np.bincount(self.word[many], minlength=len(c))
        turn = np.arange(len(many)) - (np.cumsum(dishes) - dishes)[self.word[many]]
        dishes = dishes[self.word[many]]
        turn = np.where(dishes > BLOCKS, turn * BLOCKS // np.maximum(dishes, 1), turn)
        order = np.argsort(turn, kind="stable")
        many, turn = many[order], turn[order]
        cut = np.searchsorted(turn, np.arange(BLOCKS + 1))
        for x, y in zip(cut, cut[1:], strict=False):
            who = many[x:y]
            others = STRENGTH / DISCOUNT + np.maximum(totals["tables"][self.u[who]] - t[who], 0)
            rest = c[self.word[who]] - t[who]
            parent = ROOT_STRENGTH + np.maximum(totals["root_customers"] - t[who], 0)

            def step(i: np.ndarray, k: np.ndarray) -> np.ndarray:
                return (others[i] + k) * DISCOUNT * z.step(rest[i] + k) / (parent[i] + k)

            def weight(i: np.ndarray, k: np.ndarray) -> np.ndarray:
                return log_gamma(others[i] + k) + k * np.log(DISCOUNT) + z(rest[i] + k) - log_gamma(parent[i] + k)

            new = draw_tables(self.n[who], step, weight, DISCOUNT, rng)
            np.add.at(c, self.word[who], new - t[who])
            t[who] = new
        t0 = draw_parent(np.where(apart, 1, c), totals, rng)
        return t, np.where(apart, 0, t0)


NO_SPREAD = (np.zeros(0, np.uint64), np.zeros(0, np.int64), None)  # (words, their tokens, their customers in the parent)


def draw_parent(c: np.ndarray, totals: dict, rng: np.random.Generator) -> np.ndarray:
    root_open = (ROOT_STRENGTH + ROOT_DISCOUNT * totals["root_tables"]) / (totals["V"] + 1)
    return draw_tables(c, lambda i, k: root_open, lambda i, k: k * np.log(root_open), ROOT_DISCOUNT, rng)


def by_spread(words: np.ndarray, per: np.ndarray, n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The sum of ``n`` over the dishes (``per`` word) of each spread word."""
    often = member(words, spread)
    out = np.zeros(len(spread), np.int64)
    out[often[often >= 0]] = np.add.reduceat(n, np.cumsum(per) - per)[often >= 0]
    return out


def sums(rows: DataFrame, column: str, spread: np.ndarray) -> tuple[int, int, np.ndarray]:
    """``column`` holds two numbers and one for each spread word; their sums over all rows."""
    size = len(spread) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                out += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(out)], names=["k", "n"])

    each = rows.select(column).mapInArrow(add, "k int, n bigint")
    got = {r["k"]: r["n"] for r in each.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # FREQUENT + 2 at most
    out = np.array([got.get(k, 0) for k in range(size)], np.int64)
    return int(out[0]), int(out[1]), out[2:]


def corpus_totals(counts: DataFrame, spread: np.ndarray) -> dict:
    """N, V and the tokens of spread words."""
    n, v, each = sums(counts, "tally", spread)
    return {"N": n, "V": v + int((each > 0).sum()), "spread": (spread, each, None)}


ENTRY_SCHEMA = "home int, bucket int, answered int, size int, h binary, v0 binary, v1 binary, v2 binary"
VALUES = ["v0", "v1", "v2"]


def entries(bucket: int, contexts: np.ndarray, values: list[np.ndarray], answered: np.ndarray, homes: int) -> list[dict]:
    """What a bucket sends to the buckets of its contexts (ascending): a row each with their hashes and values, first of
    those that are to be ``answered``."""
    cut = np.searchsorted(context_bucket(contexts, homes), np.arange(homes + 1))
    out = []
    for home in np.flatnonzero(np.diff(cut)).tolist():
        x, y = cut[home], cut[home + 1]
        at = x + np.argsort(~answered[x:y], kind="stable")
        out.append({"home": home, "bucket": bucket, "answered": int(answered[x:y].sum()), "size": len(at), "h": contexts[at].tobytes(),
                    **{v: pack_tables(n[at]) for v, n in zip(VALUES, values, strict=False)}})
    return out


def exchange(sent: DataFrame, buckets: int, width: int, hashes: bool, whole: bool) -> DataFrame:
    """Adds the values of every context up over the buckets.  The first ``answered`` contexts of a row come back with the
    sums in place of the values, and ``whole`` adds a row of bucket -1 with all contexts of a home."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _groups(batches, "home"):
            rows = list(rows)
            h, at = np.unique(np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows]), return_inverse=True)
            total = [add_up(at, np.concatenate([unpack_tables(r[v], r["size"]) for r in rows]), len(h)) for v in VALUES[:width]]
            out, x = [], 0
            for r in rows:
                here = at[x:x + r["answered"]]
                x += r["size"]
                if r["answered"]:
                    out.append({"home": home, "bucket": r["bucket"], "answered": len(here), "size": len(here), "h": r["h"][:8 * len(here)] if hashes else None,
                                **{v: pack_tables(n[here]) for v, n in zip(VALUES, total, strict=False)}})
            if whole:
                out.append({"home": home, "bucket": -1, "answered": 0, "size": len(h), "h": h.tobytes(),
                            **{v: pack_tables(n) for v, n in zip(VALUES, total, strict=False)}})
            yield pa.RecordBatch.from_pylist(out, schema)
            del rows, h, at, total, out
            trim_memory()

    schema = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ENTRY_SCHEMA.split(", ")])
    return sent.repartition(buckets, "home").sortWithinPartitions("home").mapInArrow(answer, ENTRY_SCHEMA)


def gather(answers: DataFrame, buckets: int, name: str, width: int, hashes: bool = False) -> DataFrame:
    """(bucket, h, v0, v1, v2): the answers of a bucket in order of its contexts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            rows = list(rows)
            row = {v: pack_tables(np.concatenate([unpack_tables(r[v], r["size"]) for r in rows])) for v in VALUES[:width]}
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "h": b"".join(r["h"] for r in rows) if hashes else None, **row}],
                                             pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("h", *VALUES)]]))

    dealt = answers.repartition(buckets, "bucket").sortWithinPartitions("bucket", "home")
    out = dealt.mapInArrow(join, "bucket int, h binary, v0 binary, v1 binary, v2 binary")
    return bucketed(out.select("bucket", *(["h"] if hashes else []), *VALUES[:width]), name, buckets)


def first_totals(counts: DataFrame, homes: int, buckets: int) -> DataFrame:
    """(bucket, h, v0, v1): the contexts of a bucket whose tables can change, with their customers and how many of their
    dishes have one customer."""

    def run(r: dict) -> list[dict]:
        b = Bucket([r[x] for x in BLOBS])
        return entries(r["bucket"], b.contexts, [b.tables(b.n), b.tables(b.n == 1)], b.open(), homes)

    return gather(exchange(per_row(counts, run, ENTRY_SCHEMA), buckets, 2, True, False), buckets, "lm-first", 2, True)


def sample_round(counts: DataFrame, state: DataFrame | None, fixed: DataFrame, moved: DataFrame | None, totals: dict, number: int,
                 buckets: int) -> DataFrame:
    """(bucket, t, t0, sums, seated): the seating after one more round in every bucket, the tables of its contexts, and its parent's
    customers, tables and customers of spread words."""
    none = F.lit(None).cast("binary")
    rows = counts.join(fixed.select("bucket", F.col("v0").alias("customers"), F.col("v1").alias("single")), "bucket", "left")
    if state is None:
        rows = rows.withColumns({"t": none, "t0": none, "moved": none})
    else:
        rows = rows.join(state.select("bucket", "t", "t0"), "bucket").join(moved.select("bucket", F.col("v0").alias("moved")), "bucket", "left")

    def run(r: dict) -> list[dict]:
        rng = np.random.default_rng([number, r["bucket"]])
        b = Bucket([r[x] for x in BLOBS])
        open_ = b.open()
        tables = np.zeros(len(b.contexts))
        if open_.any():
            size = int(open_.sum())
            # before the first seating: one table for every second customer
            tables[open_] = unpack_tables(r["customers"], size) / 2 if r["t"] is None else \
                unpack_tables(r["single"], size) + unpack_tables(r["moved"], size)
        t, t0 = b.sample((r["t"], r["t0"]) if r["t"] is not None else None, totals | {"tables": tables}, rng)
        seated = np.concatenate([[t.sum(), t0.sum()], by_spread(b.words, b.per, t, totals["spread"][0])])
        return [{"bucket": r["bucket"], "t": pack_tables(t), "t0": pack_tables(t0), "sums": pack_tables(b.tables(np.where(b.n > 1, t, 0))[open_]),
                 "seated": seated.astype(np.int64).tobytes()}]

    return bucketed(per_row(rows, run, "bucket int, t binary, t0 binary, sums binary, seated binary"), "lm-seating", buckets)


def move_totals(state: DataFrame, fixed: DataFrame, homes: int, buckets: int) -> DataFrame:
    """(bucket, v0): for the contexts of ``fixed`` the tables of dishes with several customers."""

    def run(r: dict) -> list[dict]:
        h = np.frombuffer(r["h"], np.uint64)
        return entries(r["bucket"], h, [unpack_tables(r["sums"], len(h))], np.ones(len(h), bool), homes)

    rows = state.select("bucket", "sums").join(fixed.select("bucket", "h"), "bucket")
    return gather(exchange(per_row(rows, run, ENTRY_SCHEMA), buckets, 1, False, False), buckets, "lm-moved", 1)


def seat_totals(state: DataFrame, totals: dict, number: int) -> dict:
    """Customers and tables of the parent; the tables of a spread word are drawn here."""
    spread, tokens_of, _ = totals["spread"]
    customers, tables, seated = sums(state, "seated", spread)
    t0 = draw_parent(np.maximum(seated, 1), totals, np.random.default_rng([number]))
    t0 = np.where(seated > 0, t0, 0)
    return {"root_customers": customers, "root_tables": tables + int(t0.sum()), "spread": (spread, tokens_of, seated), "spread_tables": t0}


def last_totals(counts: DataFrame, samples: list[tuple[DataFrame, dict]], homes: int, buckets: int) -> DataFrame:
    """All contexts of every bucket with their customers and their tables in each sample, and the rows of the homes."""

    def run(r: dict) -> list[dict]:
        b = Bucket([r[x] for x in BLOBS])
        values = [b.n, *[unpack_tables(r[f"t_{k}"], len(b.n)) for k in range(SAMPLES)]]
        return entries(r["bucket"], b.contexts, [b.tables(v) for v in values], np.ones(len(b.contexts), bool), homes)

    sent = per_row(model_rows(counts, samples), run, ENTRY_SCHEMA)
    with tidy_shuffles(counts.sparkSession):
        return materialize(exchange(sent, buckets, 1 + SAMPLES, False, True), "lm-contexts")


def hot_contexts(homes: DataFrame, n_all: int) -> tuple[np.ndarray, ...]:
    """(hashes, customers, tables of each sample) of the contexts with at least N / CONTEXTS customers."""

    def run(r: dict) -> list[dict]:
        h, size = np.frombuffer(r["h"], np.uint64).view(np.int64), r["size"]
        n, *t = (unpack_tables(r[v], size) for v in VALUES)
        often = np.flatnonzero(n >= max(n_all / CONTEXTS, 1))
        return [dict(zip(["h", *VALUES], map(int, x), strict=True)) for x in zip(h[often], n[often], *[x[often] for x in t], strict=True)]

    rows = per_row(homes, run, "h bigint, v0 bigint, v1 bigint, v2 bigint").collect()  # at most CONTEXTS rows
    rows.sort(key=lambda r: r["h"] % (1 << 64))
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), *[np.array([r[v] for r in rows], np.int64) for v in VALUES]


def train(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[tuple[DataFrame, dict]]]:
    """(counts, samples): the counts per bucket with the totals of its contexts, and the sampled seatings with theirs."""
    spread = spread_words(docs)
    counts = count_corpus(docs, buckets, spread)
    totals = corpus_totals(counts, spread)
    counts = counts.drop("tally")
    own = home_count(totals["V"], buckets)
    fixed = first_totals(counts, own, buckets)
    # before the first seating: parent customers for every second token, parent tables one per word
    totals |= {"root_customers": totals["N"] / 2, "root_tables": totals["V"]}
    state, moved, samples = None, None, []
    for number in range(ROUNDS):
        if state is not None:
            moved = move_totals(state, fixed, own, buckets)
        state = sample_round(counts, state, fixed, moved, totals, number, buckets)
        totals = totals | seat_totals(state, totals, number)
        samples.append((state, totals))
    samples = samples[-SAMPLES:]
    contexts = last_totals(counts, samples, own, buckets)
    homes = contexts.where("bucket = -1")
    hot, customers, *tables = hot_contexts(homes, totals["N"])
    samples = [(state, t | {"hot": hot, "customers": customers, "tables": tables[k], "homes": homes}) for k, (state, t) in enumerate(samples)]
    return counts.join(gather(contexts.where("bucket >= 0"), buckets, "lm-totals", 1 + SAMPLES), "bucket"), samples


class Predictor:
    """Averaged predictive probabilities of a bucket's words and of spread ones."""

    def __init__(self, parts: list[bytes], seatings: list[tuple[bytes, bytes]], shares: list[bytes], totals: list[dict]):
        self.b = b = Bucket(parts)
        self.key = b.word.astype(np.int64) * len(b.contexts) + b.u
        self.spread, tokens_of, _ = totals[0]["spread"]
        self.own = member(self.spread, b.words)
        self.count = np.concatenate([b.count, tokens_of])
        self.hot = totals[0]["hot"]
        customers, *tables = (unpack_tables(x, len(b.contexts)) for x in shares)
        self.norm = STRENGTH + np.concatenate([customers, totals[0]["customers"], [0]])  # the last one: a context without customers
        self.left, self.roots, self.shares = np.zeros(len(b.n)), [], []
        for (t, t0), tot, here in zip(seatings, totals, tables, strict=True):
            t, t0 = unpack_tables(t, len(b.n)), unpack_tables(t0, len(b.words))
            base = (ROOT_STRENGTH + ROOT_DISCOUNT * tot["root_tables"]) / (tot["V"] + 1)
            seated = np.concatenate([np.add.reduceat(t, b.first) if len(t) else t, tot["spread"][2], [0]])
            at_root = np.concatenate([t0, tot["spread_tables"], [0]])
            self.roots.append((seated - ROOT_DISCOUNT * at_root + base) / (ROOT_STRENGTH + tot["root_customers"]))  # the last one: an unknown word
            self.shares.append((STRENGTH + DISCOUNT * np.concatenate([here, tot["tables"], [0]])) / self.norm)
            self.left += (b.n - DISCOUNT * t) / len(totals)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where unknown; spread words follow the bucket's own."""
        often = member(words, self.spread)
        return np.where(often >= 0, len(self.b.words) + often, member(words, self.b.words))

    def place(self, context: np.ndarray) -> np.ndarray:
        """Number of each context, -1 where neither the bucket nor every task knows it."""
        hot = member(context, self.hot)
        here = member(context, self.b.contexts)
        return np.where(here >= 0, here, np.where(hot >= 0, len(self.b.contexts) + hot, -1))

    def probability(self, number: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.at_place(number, self.place(context.astype(np.uint64)))

    def at_place(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        size, width = len(self.b.words), len(self.b.contexts)
        out = sum(s[place] * r[number] for s, r in zip(self.shares, self.roots, strict=True)) / len(self.roots)
        if size:
            word = number.copy()
            far = number >= size
            word[far] = self.own[number[far] - size]
            key = word * width + place
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            dish = (word >= 0) & (place >= 0) & (place < width) & (self.key[at] == key)
            out = out + np.where(dish, self.left[at], 0.0) / self.norm[place]
        return out

    def parent(self, number: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words, by sample."""
        return np.stack([r[number] for r in self.roots], axis=1)


def model_rows(counts: DataFrame, samples: list[tuple[DataFrame, dict]]) -> DataFrame:
    """(bucket, x1..x6, v0.., t_0, t0_0, t_1, ...): everything a bucket needs to predict."""
    rows = counts
    for k, (state, _) in enumerate(samples):
        rows = rows.join(state.select("bucket", F.col("t").alias(f"t_{k}"), F.col("t0").alias(f"t0_{k}")), "bucket")
    return rows


def _predictor(r: dict | None, totals: list[dict]) -> Predictor:
    none = np.zeros(0, np.int64)
    if r is None:  # a bucket without training words
        return Predictor(pack_pairs(none.view(np.uint64), none.view(np.uint64), none), [(pack_tables(none),) * 2] * len(totals),
                         [pack_tables(none)] * (1 + len(totals)), totals)
    return Predictor([r[x] for x in BLOBS], [(r[f"t_{k}"], r[f"t0_{k}"]) for k in range(len(totals))],
                     [r[v] for v in VALUES[:1 + len(totals)]], totals)


def frequent_words(model: DataFrame, totals: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, probabilities by hot context) of the words with at least N / FREQUENT tokens."""
    least = max(totals[0]["N"] / FREQUENT, 1)
    hot = totals[0]["hot"]

    def run(r: dict) -> list[dict]:
        p = _predictor(r, totals)
        words = p.find(p.b.words)
        out = []
        for i in np.flatnonzero(p.count[words] >= least).tolist():
            x, y = p.b.first[i], p.b.first[i + 1] if i + 1 < len(p.b.first) else len(p.b.n)
            at = member(p.b.contexts[p.b.u[x:y]], hot)
            out.append({"word": int(p.b.words[i].view(np.int64)), "n": int(p.count[words[i]]), "parent": p.parent(words[i:i + 1]).tobytes(),
                        "at": at[at >= 0].astype(np.int64).tobytes(), "own": p.left[x:y][at >= 0].tobytes()})
        return out

    # the words' dishes in hot contexts: at most FREQUENT x CONTEXTS numbers
    rows = per_row(model, run, "word bigint, n bigint, parent binary, at binary, own binary").collect()
    words = np.unique(np.array([r["word"] for r in rows], np.int64).view(np.uint64))
    count, p = np.zeros(len(words), np.int64), np.zeros((len(words), len(hot)))
    norm = STRENGTH + totals[0]["customers"]
    shares = np.stack([(STRENGTH + DISCOUNT * t["tables"]) / norm for t in totals])
    seen = set()
    for r in rows:
        (k,) = member(np.array([r["word"]], np.int64).view(np.uint64), words)
        if k not in seen:
            seen.add(k)
            count[k] = r["n"]
            p[k] += np.frombuffer(r["parent"]) @ shares / len(totals)
        at = np.frombuffer(r["at"], np.int64)
        p[k, at] += np.frombuffer(r["own"]) / norm[at]
    return words, count, p


def score_documents(docs: DataFrame, counts: DataFrame, samples: list[tuple[DataFrame, dict]], buckets: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    homes = samples[0][1]["homes"]
    totals = [{k: v for k, v in t.items() if k != "homes"} for _, t in samples]
    n_all, v, width = totals[0]["N"], totals[0]["V"], len(totals)
    spread, hot = totals[0]["spread"][0], totals[0]["hot"]
    model = model_rows(counts, samples)
    words_, count_, p_ = frequent_words(model, totals)
    sent = spark.sparkContext.broadcast((words_, count_, np.log10(p_).astype(np.float32)))
    sent_totals = spark.sparkContext.broadcast(totals)
    floor = np.log10(n_all + BASE_ALPHA * (v + 1))

    def read(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count, log_p = sent.value
        base = np.log10(count + BASE_ALPHA) - floor
        block = (TaskContext.get().partitionId() * PASSES + number) << PART  # the task, and the number of the slice's first document in it
        for big in batches:
            for batch in slices(big, "text", 2 << 20):
                word, _, first = tokens(batch.column("text"))
                types, word, context = numbered(word, first)
                rows = batch.num_rows
                doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(first))
                often, place = member(types, words), member(types, hot)
                here = (often[word] >= 0) & (place[context] >= 0)
                at = often[word[here]]
                sums = [np.bincount(doc[here], x, rows) for x in (np.ones(len(at)), base[at], log_p[at, place[context[here]]])]
                ids = batch.column("doc_id")
                info = [np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(),
                        np.diff(first).astype(np.int64).tobytes(), *[s.astype(np.float64).tobytes() for s in sums]]
                out = [(int(mix(np.array([block], np.uint64))[0] % np.uint64(buckets)), 1, block, *info)]
                far = ~here
                out += pack_tokens(types, word[far], context[far], doc[far], place, spread, buckets, block)
                del word, context, doc, at, place, here, far
                yield _rows(out)
                block += rows
                trim_memory()

    def score(model_row: pa.Table, dealt: pa.Table) -> pa.Table:
        out, sums = [], []
        if dealt.num_rows:
            p = _predictor(next(iter(model_row.to_pylist()), None), sent_totals.value)
            rows = dealt.to_pylist()
            out = [tuple(r[c] for c in ["bucket", "kind", "block", *BLOBS]) for r in rows if r["kind"] == 1]
            for part in chunks([r for r in rows if r["kind"] == 2]):
                some, late = score_tokens(part, p, floor, home_count(v, buckets))
                sums.append(some)
                out += late
            out += part_rows(dealt["bucket"][0].as_py(), sums)
            del p, rows
            trim_memory()
        return pa.Table.from_batches([_rows(out)])

    def finish(home: pa.Table, dealt: pa.Table) -> pa.Table:
        out, sums = [], []
        if dealt.num_rows:
            r = next(iter(home.to_pylist()), None)
            h, values = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * (1 + width)
            if r is not None:
                h = np.frombuffer(r["h"], np.uint64)
                values = [unpack_tables(r[x], r["size"]) for x in VALUES[:1 + width]]
            customers, *tables = (np.append(x, 0) for x in values)  # the last one: a context without customers
            shares = np.stack([(STRENGTH + DISCOUNT * t) / (STRENGTH + customers) for t in tables], axis=1)
            for row in dealt.to_pylist():
                at = member(np.frombuffer(row["x1"], np.uint64), h)
                parent = np.frombuffer(row["x2"]).reshape(-1, width)
                log_p = -np.log10((shares[at] * parent).mean(axis=1))
                per = unpack_ints(row["x3"])
                doc, none = np.repeat(np.frombuffer(row["x5"], np.int64), per) + unpack_ints(row["x4"]), np.zeros(int(per.sum()))
                sums.append(add_parts([(doc, none, none, np.repeat(log_p, per))]))
            out = part_rows(dealt["bucket"][0].as_py(), sums)
        return pa.Table.from_batches([_rows(out)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block", PART):
            docs, sums = [], None
            for r in rows:  # those of the documents first, in order
                if r["kind"] == 1:
                    docs.append([np.frombuffer(r[b], t) for b, t in zip(
                        BLOBS, (np.int64, np.uint8, np.int64, np.float64, np.float64, np.float64), strict=True)])
                    continue
                if sums is None:
                    ids, null, size, *sums = map(np.concatenate, zip(*docs, strict=True))
                at = np.cumsum(unpack_ints(r["x1"]))
                for s, b, unit in zip(sums, BLOBS[1:], (1.0, -UNITS, -UNITS), strict=False):
                    s[at] += unpack_ints(r[b]) / unit
            if sums is None:
                ids, null, size, *sums = map(np.concatenate, zip(*docs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(size), pa.array(sums[0].astype(np.int64)),
                                              pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = None
    for number in range(PASSES):  # the tokens of one share of the documents on disk at a time

        share = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(PASSES)) == number)
        texts = share.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(read, number), ROW_SCHEMA)
        with tidy_shuffles(spark):
            rows = materialize(model.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(score, ROW_SCHEMA), "lm-scored")
        scored = rows if scored is None else scored.unionByName(rows)
    far = scored.where("kind = 3")
    late = homes.groupBy("home").cogroup(far.groupBy("bucket")).applyInArrow(finish, ROW_SCHEMA)
    task = F.shiftright("block", PART)
    back = scored.where("kind < 3").unionByName(late).repartition(buckets, task).sortWithinPartitions(task, "kind", "block", "bucket")
    out = back.mapInArrow(total, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def pack_tokens(types: np.ndarray, w: np.ndarray, u: np.ndarray, d: np.ndarray, place: np.ndarray, spread: np.ndarray, buckets: int,
                block: int) -> list[tuple]:
    """Tokens (word, context, document) dealt to the buckets of their dishes; words and contexts are numbers of ``types``, ``place``
    the places of types among the hot contexts.  A bucket's row has its words once; for each the number of different contexts,
    hot ones (by place, two bytes) before others; how many tokens have each; their documents."""
    if not len(w):
        return []
    hot_first = np.argsort(place < 0, kind="stable")
    rank = np.empty(len(types), np.int64)
    rank[hot_first] = np.arange(len(types))
    code = w * len(types) + rank[u]
    order = np.argsort(code)
    code, d = code[order], d[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    per_pair = np.diff(np.append(start, len(code)))
    word, context = np.divmod(code[start], len(types))  # of the pairs
    context = hot_first[context]
    bucket = dish_bucket(types[word], types[context], spread, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    start, per_pair, word, context, bucket = start[order], per_pair[order], word[order], context[order], bucket[order]
    ends = np.cumsum(per_pair)
    d = d[np.repeat(start - (ends - per_pair), per_pair) + np.arange(len(d))]
    new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (word[1:] != word[:-1])]))  # words of buckets
    is_hot = place[context] >= 0
    per = np.diff(np.append(new, len(word)))
    hot_per = np.add.reduceat(is_hot.astype(np.int64), new)
    out = []
    for k, x, y in spans(bucket):
        a, b = np.searchsorted(new, [x, y])
        c, here = context[x:y], is_hot[x:y]
        out.append((k, 2, block, types[word[new[a:b]]].tobytes(), pack_ints(np.concatenate([hot_per[a:b], per[a:b] - hot_per[a:b]])),
                    place[c[here]].astype(np.uint16).tobytes(), types[c[~here]].tobytes(), pack_ints(per_pair[x:y]),
                    pack_ints(d[ends[x] - per_pair[x]:ends[y - 1]])))
    return out


def unpack_tokens(r: dict, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, pairs of each, contexts of the pairs, tokens of each, documents of the tokens)"""
    words, per = np.frombuffer(r["x1"], np.uint64), unpack_ints(r["x2"])
    both = per.reshape(2, -1).T
    is_hot = np.repeat(np.tile([True, False], len(words)), both.ravel())
    context = np.empty(len(is_hot), np.uint64)
    context[is_hot] = hot[np.frombuffer(r["x3"], np.uint16)]
    context[~is_hot] = np.frombuffer(r["x4"], np.uint64)
    return words, both.sum(axis=1), context, unpack_ints(r["x5"]), unpack_ints(r["x6"])


def chunks(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of rows with about ``FLUSH_BYTES`` in all."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += sum(len(r[b]) for b in BLOBS)
        if size >= FLUSH_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def spans(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal keys."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return zip(key[new].tolist(), new.tolist(), np.append(new[1:], len(key)).tolist(), strict=True)


def add_parts(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """(document keys, known, base, log_p): the sums of several such by document."""
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, *[np.bincount(at, np.concatenate([p[k] for p in parts])) for k in (1, 2, 3)]


def part_rows(bucket: int, parts: list[tuple]) -> list[tuple]:
    """A row with the sums of the documents of each task that read them, so there are no more rows than pairs of tasks."""
    if not parts:
        return []
    key, known, *sums = add_parts(parts)
    doc = key & ((1 << PART) - 1)
    return [(bucket, 2, k << PART, pack_ints(np.diff(doc[x:y], prepend=0)), pack_ints(known[x:y]), *[pack_ints(np.rint(s[x:y] * UNITS)) for s in sums])
            for k, x, y in spans(key >> PART)]


def score_tokens(rows: list[dict], p: Predictor, floor: float, homes: int) -> tuple[tuple[np.ndarray, ...], list[tuple]]:
    """Sums by document of the tokens in ``rows`` of a bucket, and rows of the pairs whose context the bucket does not know: they go
    on to the context's bucket with the word's parent probabilities (kind 3: contexts, parents, tokens of each, their documents, blocks)."""
    words, per_word, context, per, d = (list(x) for x in zip(*[unpack_tokens(r, p.hot) for r in rows], strict=True))
    pairs = np.cumsum([0, *map(len, context)])
    toks = np.cumsum([0, *map(len, d)])
    number = np.repeat(p.find(np.concatenate(words)), np.concatenate(per_word))
    context, per, d = np.concatenate(context), np.concatenate(per), np.concatenate(d)
    place = p.place(context)
    far = place < 0
    c = np.where(number >= 0, p.count[number] if len(p.count) else 0, 0)
    log_p = np.where(far, 0.0, -np.log10(p.at_place(number, place)))
    known, base, log_p = (np.repeat(x, per) for x in ((number >= 0).astype(float), floor - np.log10(c + BASE_ALPHA), log_p))
    blocks = np.array([r["block"] for r in rows], np.int64)
    sums, out = add_parts([(np.repeat(blocks, np.diff(toks)) + d, known, base, log_p)]), []
    if far.any():
        at = np.flatnonzero(far)
        home = context_bucket(context[at], homes)
        at = at[np.argsort(home, kind="stable")]
        block = np.repeat(blocks, np.diff(pairs))[at]
        first = np.cumsum(per) - per
        for k, x, y in spans(np.sort(home)):
            some = at[x:y]
            size = per[some]
            token = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append((k, 3, 0, context[some].tobytes(), p.parent(number[some]).tobytes(), pack_ints(size), pack_ints(d[token]),
                        block[x:y].tobytes()))
    return sums, out


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts, samples = train(docs, buckets)
    return score_documents(docs, counts, samples, buckets)
