"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document when tiles (non-overlapping common runs of
at least ``MIN_TILE`` words, in any order) cover at least ``COVERAGE`` of the item's
words; so a passage with its parts reordered is caught.

Seeds: running Karp-Rabin hashes of all runs of ``MIN_TILE`` words of a batch of
documents are probed against the benchmark's sorted seed hashes.  Pairs whose
seeds could not cover enough of the item are dropped (an upper bound, so nothing is
lost).  Tiling: seeds on one diagonal that follow each other are a maximal match;
the longest match is marked again and again, matches that meet marked words are cut
to their unmarked parts; at the end the tiles' words are compared as strings.  Where a
phrase repeats within both texts, the next longest match is found by running hashes of
its length instead of listing all hits, so memory stays linear.

The benchmark is a query set held against all documents in blocks of at most
``BLOCK_TOKENS`` words: each block is sent to the tasks (its size is bounded by the
block) and the documents pass it in one scan without a shuffle.  Memory per task: one
block plus a slice of a batch.

Defined cases: null or empty documents, and items with fewer than ``MIN_TILE`` words,
match nothing.  Repeated rows and ties are each reported; an empty benchmark gives an
empty result.  Words are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INV, _ODD, mix, plain_names, powers, slices, table, words

MIN_TILE = 4
COVERAGE = 0.5
BLOCK_TOKENS = 2_000_000
SEED_HITS = 1 << 20  # places of the block that rows of a batch are held against at once
HITS_PER_WORD = 64  # listed seed hits of a pair, per word of its two texts
PAIR_SCHEMA = ("doc_id bigint, item_id bigint, coverage double, matched_words bigint, item_words bigint, "
               "tiles bigint, longest_tile bigint")


def running_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all runs of ``size`` words that stay within a row, with their starts."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(n, _ODD), dtype=np.uint64)])
    h = mix((sums[size:] - sums[:-size]) * powers(n - size + 1, _INV))
    ends = np.repeat(first[1:], np.diff(first))  # end of the row of each word
    start = np.flatnonzero(np.arange(n - size + 1) + size <= ends[:n - size + 1])
    return h[start], start


class Block:
    """A block of benchmark items with its sorted seed hashes."""

    def __init__(self, ids: list, texts: list):
        data, starts, ends, hashes, first = words(pa.array([(t or "").lower() for t in texts], pa.string()))
        self.ids, self.first, self.hashes = ids, first, hashes
        self.words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        h, at = running_hashes(hashes, first, MIN_TILE)
        order = np.argsort(h, kind="stable")
        self.seeds, self.at = h[order], at[order]
        self.item = np.searchsorted(first, self.at, "right") - 1
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, row: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) whose seeds cover enough of the item, from the seed hashes of a batch in order of their rows.

        A row's hash counts once, so a row meets every place of the block at most once; rows are taken
        together up to SEED_HITS places."""
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        once = np.ones(len(h), bool)
        once[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[once], h[once]
        lo = np.searchsorted(self.seeds, h, "left")
        n = np.searchsorted(self.seeds, h, "right") - lo
        row, lo, n = row[n > 0], lo[n > 0], n[n > 0]
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        x = 0
        while x < len(begins):
            y = x + 1
            while y < len(begins) and total[begins[y + 1] if y + 1 < len(begins) else len(row)] - total[begins[x]] <= SEED_HITS:
                y += 1
            s, e = begins[x], begins[y] if y < len(begins) else len(row)
            which = np.repeat(lo[s:e] - (total[s:e] - total[s]), n[s:e]) + np.arange(int(total[e] - total[s]))
            r, j, item = np.repeat(row[s:e], n[s:e]), self.at[which], self.item[which]
            by = np.lexsort((j, item, r))
            r, j, item = r[by], j[by], item[by]
            group = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1])]))
            for g, stop in zip(group, [*group[1:], len(r)], strict=True):
                k = int(item[g])
                length = int(self.first[k + 1] - self.first[k])
                reach = np.zeros(length + 1, np.int32)
                seen = j[g:stop] - self.first[k]
                np.add.at(reach, seen, 1)
                np.add.at(reach, np.minimum(seen + MIN_TILE, length), -1)
                if (np.cumsum(reach)[:-1] > 0).sum() >= COVERAGE * length:
                    yield int(r[g]), k
            x = y

    def leaks(self, col: pa.Array) -> Iterator[tuple[int, int, float, int, int, int, int]]:
        """(row, item, coverage, matched, words, tiles, longest) of a lower-cased text column."""
        data, starts, ends, hashes, first = words(col)
        h, at = running_hashes(hashes, first, MIN_TILE)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        for row, k in self.candidates(np.searchsorted(first, at[maybe], "right") - 1, h[maybe]):
            a, b = int(first[row]), int(self.first[k])
            length = int(self.first[k + 1]) - b
            tiles = [(i, j, m) for i, j, m in common_tiles(hashes[a:first[row + 1]], self.hashes[b:b + length])
                     if all(data[starts[a + i + x]:ends[a + i + x]].tobytes() == self.words[b + j + x] for x in range(m))]
            matched = sum(m for _, _, m in tiles)
            if tiles and matched >= COVERAGE * length:
                yield (row, k, matched / length, matched, length, len(tiles), max(m for _, _, m in tiles))


def common_tiles(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """The greedy tiling (i, j, words) of two sequences of word hashes.

    Few seed hits are listed and taken from a heap; where a phrase repeats so often that the hits outgrow
    both sequences, the same tiles come from running hashes of whole lengths in linear memory."""
    ends = np.array([0, len(doc)]), np.array([0, len(item)])
    (hi, i), (hj, j) = running_hashes(doc, ends[0], MIN_TILE), running_hashes(item, ends[1], MIN_TILE)
    order = np.argsort(hj, kind="stable")
    lo = np.searchsorted(hj[order], hi, "left")
    n = np.searchsorted(hj[order], hi, "right") - lo
    if not n.sum():
        return []
    if n.sum() > HITS_PER_WORD * (len(doc) + len(item)):
        return long_tiling(doc, item)
    which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    i, j = np.repeat(i, n), j[order][which]
    by = np.lexsort((i, i - j))
    return tiling(i[by], j[by])


def long_tiling(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling by Karp-Rabin hashes of the longest unmarked common run, then the next longest.

    The length is found by bisection (a common run holds common runs of all smaller lengths).  All
    unmarked runs of that length are taken in order of (i, j): they overlap only among each other."""
    used_i, used_j = np.zeros(len(doc), bool), np.zeros(len(item), bool)

    def runs_of(size: int) -> tuple[np.ndarray, ...]:
        out = []
        for values, used in ((doc, used_i), (item, used_j)):
            h, at = running_hashes(values, np.array([0, len(values)]), size)
            marked = np.concatenate([[0], np.cumsum(used)])
            free = marked[at + size] == marked[at] if len(at) else np.zeros(0, bool)
            out += [h[free], at[free]]
        return tuple(out)

    def common(size: int) -> bool:
        hi, _, hj, _ = runs_of(size)
        return bool(np.isin(hj, hi).any())

    tiles: list[tuple[int, int, int]] = []
    top = min(len(doc), len(item))
    while top >= MIN_TILE:
        lo, hi = MIN_TILE - 1, top  # the longest common run is in (lo - 1, hi]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        if lo < MIN_TILE:
            break
        hi_, i, hj_, j = runs_of(lo)
        order = np.lexsort((j, hj_))
        hj_, j = hj_[order], j[order]
        both = np.isin(hi_, hj_)
        places = dict(zip(np.unique(hj_).tolist(), zip(*[np.searchsorted(hj_, np.unique(hj_), s).tolist() for s in ("left", "right")], strict=True), strict=True))
        next_of: dict[int, int] = {}
        free_from = 0
        for h, at in zip(hi_[both].tolist(), i[both].tolist(), strict=True):
            if at < free_from:
                continue
            x, stop = places[h]
            x = next_of.get(h, x)
            while x < stop and (used_j[j[x]] or used_j[j[x] + lo - 1]):
                x += 1
            next_of[h] = x
            if x < stop:
                tiles.append((at, int(j[x]), lo))
                used_i[at:at + lo] = True
                used_j[j[x]:j[x] + lo] = True
                free_from = at + lo
        top = lo - 1
    return tiles


def tiling(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed hits (i, j) in order of (i - j, i): tiles (i, j, words)."""
    diag = i - j
    start = np.flatnonzero(np.concatenate([[True], (diag[1:] != diag[:-1]) | (i[1:] != i[:-1] + 1)]))
    end = np.concatenate([start[1:], [len(i)]])
    heap = [(-int(e - s + MIN_TILE - 1), int(i[s]), int(j[s])) for s, e in zip(start, end, strict=True)]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    tiles = []
    while heap:
        m, a, b = heapq.heappop(heap)
        free = [x for x in range(-m) if a + x not in used_i and b + x not in used_j]
        if len(free) == -m:
            tiles.append((a, b, -m))
            used_i.update(range(a, a - m))
            used_j.update(range(b, b - m))
            continue
        run = 0
        for k, x in enumerate(free):  # the unmarked parts that are still long enough go back
            run += 1
            if k + 1 == len(free) or free[k + 1] != x + 1:
                if run >= MIN_TILE:
                    heapq.heappush(heap, (-run, a + x - run + 1, b + x - run + 1))
                run = 0
    return tiles


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items (item_id, text) in blocks of about BLOCK_TOKENS words, one block on the driver at a time."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", size.cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // BLOCK_TOKENS))
    for b in range(count):
        yield sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).select("item_id", "text").collect()


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document row, item) that reaches the coverage."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("_text"))
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in items], [r["text"] for r in items]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block(*sent.value)
            for big in batches:
                for batch in slices(big, "_text", 1 << 20):
                    found = list(block.leaks(batch.column("_text")))
                    if found:
                        row, item, *rest = (list(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(row, pa.int64())),
                             pa.array([block.ids[k] for k in item], pa.int64()), pa.array(rest[0], pa.float64()),
                             *[pa.array(x, pa.int64()) for x in rest[1:]]],
                            names=["doc_id", "item_id", "coverage", "matched_words", "item_words", "tiles", "longest_tile"])

        part = rows.mapInArrow(run, PAIR_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with their columns."""
    spark, columns = docs.sparkSession, docs.columns
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in items], [r["text"] for r in items]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block(*sent.value)
            for big in batches:
                for batch in slices(big, "_lower", 1 << 20):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[x[0] for x in block.leaks(batch.column("_lower"))]] = False
                    yield batch.filter(pa.array(keep)).select(columns)

        docs = docs.withColumn("_lower", F.lower("text")).mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@plain_names
def stage_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a leaked benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
