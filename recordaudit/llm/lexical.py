"""Ranked lexical search: many queries over all documents, with their common parts evaluated once.

Each item of the query set is scored against every document by an integer BM25-like sum over
the item's terms (repeats included) and gets its ``TOP`` best documents.  The steps:

1. Items are numbered in an order that puts alike ones side by side and cut into blocks of
   ``BLOCK_ITEMS``; a task per block mines its query-sharing DAG (:func:`mine`):

   * terms that occur in exactly the same items form a class, the largest term sets that are
     shared without loss;
   * the largest set of parts that two rows (items or earlier shared sets) have in common
     becomes a node of its own, used by every row that holds it, until no set saves additions.

2. One scan tokenises the documents and keeps the postings of the query terms (document, number
   of terms, term ids, occurrences) as a table; N, L and the document frequencies are
   aggregates over it.
3. A second pass evaluates the DAG over batches of postings: every class's partial accumulators
   are summed once from the postings, every node once from its parts, and an item adds up
   its few parts.  Tasks keep their best ``TOP`` per item; Spark ranks these, first by
   (item, salt), then by item.

Queries larger than ``SCAN_BYTES`` of DAGs take several scans, so what is broadcast is bounded.
All sums are 64-bit integers, so the order of additions does not matter.

Defined cases: a term is a maximal run of ASCII letters, digits and all characters beyond
ASCII; only A-Z are lower-cased.  Null and empty texts have no terms: as documents they count
nowhere and are never ranked, as items they return nothing.  Repeated document rows are
ranked each; repeated items get their rows each.  Equal scores: ascending doc_id, null last.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.align import dense_position
from .common import materialize, runs, slices, string_bytes, table

TOP = 10
BLOCK_ITEMS = 256
SCAN_BYTES = 32 << 20  # DAGs and terms that one scan evaluates
ROWS = 1024  # documents whose accumulators are held at once
LEAST_SHARED = 3  # parts: a smaller set in two rows saves no addition
SALTS = 32

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms as one string array, first): the terms of row i are first[i]:first[i + 1]."""
    data, off = string_bytes(col)
    inside = _TERM[data]
    starts, ends = runs(inside, off)
    text = data[inside]
    text[(text >= 65) & (text <= 90)] += 32
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text))
    return flat, np.searchsorted(starts, off)


# ---------------------------------------------------------------------------
# The query-sharing DAG
# ---------------------------------------------------------------------------

def mine(items: list[list[str]]) -> dict:
    """The sharing DAG of the items' terms (with repeats).

    ``classes``: per class {term: times}; ``rows``: per row its parts, in an order in which
    parts come first: part p < len(classes) is a class, else row p - len(classes);
    ``items``: the row of every item."""
    held: dict[tuple[str, int], int] = defaultdict(int)
    for k, words in enumerate(items):
        for term, times in Counter(words).items():
            for x in range(times):  # the x-th occurrence of a term is a part of its own
                held[term, x] |= 1 << k
    classes: dict[int, Counter] = defaultdict(Counter)
    for (term, _), mask in held.items():
        classes[mask][term] += 1
    masks = list(classes)
    n = len(items)
    parts = np.zeros((n, max(len(masks), 1)), np.float32)
    for c, mask in enumerate(masks):
        for k in range(n):
            parts[k, c] = mask >> k & 1
    parts = _shared(parts)
    # parts first: a row's depth is one more than that of its deepest part
    count = len(masks)
    order, state = [], [0] * len(parts)
    for top in range(len(parts)):
        stack = [top]
        while stack:
            r = stack[-1]
            if state[r] == 0:
                state[r] = 1
                stack += [int(p) - count + n for p in np.flatnonzero(parts[r, count:]) + count]
                continue
            stack.pop()
            if state[r] == 1:
                state[r] = 2
                order.append(r)
    place = {r: k for k, r in enumerate(order)}
    rows = [[int(p) if p < count else count + place[int(p) - count + n] for p in np.flatnonzero(parts[r])] for r in order]
    return {"classes": [dict(classes[m]) for m in masks], "rows": rows, "items": [place[k] for k in range(n)]}


def _shared(parts: np.ndarray) -> np.ndarray:
    """Rows x parts, with a row and a column more for every shared set that saves additions."""
    rows, width = parts.shape
    m = np.zeros((2 * rows, width + rows), np.float32)
    m[:rows, :width] = parts
    both = m[:rows] @ m[:rows].T
    np.fill_diagonal(both, 0)
    while True:
        a, b = divmod(int(both.argmax()), rows)
        if both[a, b] < LEAST_SHARED:
            return m[:rows, :width]
        common = np.flatnonzero(m[a] * m[b])
        users = np.flatnonzero(m[:rows, common].all(axis=1))
        if rows == len(m):
            m = np.pad(m, ((0, rows), (0, rows)))
        m[np.ix_(users, common)] = 0
        m[users, width] = 1
        m[rows, common] = 1
        rows, width = rows + 1, width + 1
        both = np.pad(both, ((0, 1), (0, 1)))
        changed = np.append(users, rows - 1)
        fresh = m[changed, :width] @ m[:rows, :width].T
        fresh[np.arange(len(changed)), changed] = 0
        both[changed] = fresh
        both[:, changed] = fresh.T


class Plan:
    """A mined block ready to score: classes by term id, rows in order."""

    def __init__(self, dag: dict, ids: dict[str, int], vocabulary: int):
        pairs = sorted((ids[t], c, x) for c, words in enumerate(dag["classes"]) for t, x in words.items())
        self.first = np.searchsorted([p[0] for p in pairs], np.arange(vocabulary + 1))
        self.cls = np.array([p[1] for p in pairs], np.int64)
        self.times = np.array([p[2] for p in pairs], np.int64)
        self.count = len(dag["classes"])
        self.rows = [np.array(r, np.int64) for r in dag["rows"]]
        self.items = np.array(dag["items"], np.int64)

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """items x n scores from postings (document row, term id, weighted part)."""
        acc = np.zeros((self.count + len(self.rows), n), np.int64)
        use = self.first[term + 1] - self.first[term]
        cut = np.cumsum(use)
        at = np.repeat(self.first[term] - cut + use, use) + np.arange(int(cut[-1]) if len(cut) else 0)
        np.add.at(acc.reshape(-1), self.cls[at] * n + np.repeat(row, use), np.repeat(part, use) * self.times[at])
        for k, parts in enumerate(self.rows):
            acc[self.count + k] = acc[parts].sum(axis=0)
        return acc[self.count + self.items]


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------

def mined_blocks(items: DataFrame) -> DataFrame:
    """block, dag (pickled: items, DAG), terms, bytes of every block of ``items`` (item_id, text)."""
    low = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
    alike = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_text"), F.array_min(low).alias("_alike"))
    numbered = dense_position(alike, ["_alike", "item_id", "_text"], name="_q", start=0)
    dealt = numbered.select(F.expr(f"_q div {BLOCK_ITEMS}").alias("block"), F.col("_q").alias("q"), "item_id", F.col("_text").alias("text"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("q")
        flat, first = terms(t.column("text"))
        words = flat.to_pylist()
        dag = mine([words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
        raw = pickle.dumps((t.column("q").to_pylist(), t.column("item_id").to_pylist(), dag))
        known = sorted(set(words))
        size = len(raw) + sum(map(len, known))
        return pa.table({"block": [t.column("block")[0].as_py()], "dag": [raw], "terms": pa.array([known], pa.list_(pa.string())), "bytes": [size]})

    return dealt.groupBy("block").applyInArrow(run, "block bigint, dag binary, terms array<string>, bytes bigint")


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms of the document), ids, tf (query terms and their occurrences) of rows with terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for big in batches:
            for batch in slices(big, "_text", 8 << 20):
                flat, first = terms(batch.column("_text"))
                n = np.diff(first)
                at = pc.index_in(flat, value_set=known)
                row = np.repeat(np.arange(len(n)), n)
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                key, tf = np.unique(row[hit] * len(known) + pc.drop_null(at).to_numpy().astype(np.int64), return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(known)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(cuts, pa.array((key % max(len(known), 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "ids", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")) \
        .mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tf array<int>")


class Best:
    """The TOP best documents of every item so far."""

    def __init__(self, n: int):
        self.floor = np.ones(n, np.int64)
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, null = np.concatenate([self.doc, doc[at]]), np.concatenate([self.null, null[at]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < TOP]
        self.item, self.score, self.doc, self.null = item[rank < TOP], score[keep], doc[keep], null[keep]
        full = rank[rank < TOP] == TOP - 1
        self.floor[self.item[full]] = self.score[full]


def scored(found: DataFrame, blocks: list[bytes], vocabulary: list[str], weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """q, item_id, doc_id, score: the best documents of every item in every task."""
    sent = found.sparkSession.sparkContext.broadcast((blocks, vocabulary, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, known, w = sent.value
        ids = {t: k for k, t in enumerate(known)}
        loaded = [pickle.loads(b) for b in raw]
        plans = [Plan(dag, ids, len(known)) for *_, dag in loaded]
        best = [Best(len(q)) for q, *_ in loaded]
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                batch = big.slice(lo, ROWS)
                n = batch.column("n").to_numpy()
                term = pc.list_flatten(batch.column("ids")).to_numpy().astype(np.int64)
                tf = pc.list_flatten(batch.column("tf")).to_numpy().astype(np.int64)
                row = pc.list_parent_indices(batch.column("ids")).to_numpy().astype(np.int64)
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                doc = batch.column("doc_id")
                null = doc.is_null().to_numpy(zero_copy_only=False)
                doc = doc.fill_null(0).to_numpy()
                for plan, b in zip(plans, best, strict=True):
                    b.add(plan.scores(row, term, part, batch.num_rows), doc, null)
        for (q, item, _), b in zip(loaded, best, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(q, np.int64)[b.item]), pa.array(item, pa.int64()).take(pa.array(b.item)),
                 pa.array(b.doc, mask=b.null), pa.array(b.score)], names=["q", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, "q bigint, item_id bigint, doc_id bigint, score bigint")


def ranked(best: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the TOP best rows per q."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    part = dealt.withColumn("r", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("r") <= TOP)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return part.withColumn("rank", rank).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    mined = materialize(mined_blocks(items), "lexical-dags")
    sizes = sorted((r["block"], r["bytes"]) for r in mined.select("block", "bytes").collect())  # a few numbers per block
    scans: list[list[int]] = [[]]
    held = 0
    for block, size in sizes:
        if scans[-1] and held + size > SCAN_BYTES:
            scans.append([])
            held = 0
        scans[-1].append(block)
        held += size
    out = None
    for blocks in scans:
        some = mined.where(F.col("block").isin(blocks)).orderBy("block").collect()
        known = sorted({t for r in some for t in r["terms"]})
        found = materialize(postings(docs, pa.array(known, pa.large_string())), "lexical-postings")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for r in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():  # query terms only
            df[r["id"]] = r["df"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        part = scored(found, [bytes(r["dag"]) for r in some], known, weight, n_docs, max(n_terms, 1))
        out = part if out is None else out.unionByName(part)
    return ranked(out)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM n) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
