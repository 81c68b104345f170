"""SimHash near duplicates by BK-trees.

Steps:

1. Fingerprints, in Arrow batches: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
   ``SHINGLE`` space-joined words with repeats, XXH64 (seed 42) of each.  A bit of the 64 is 1
   where over half the hashes have it.  Equal fingerprints are one node from here on, so copies
   cost one row.
2. Shards.  The bits are cut into ``m`` blocks; two fingerprints that differ in at most
   ``RADIUS`` bits agree on some ``m - RADIUS`` of them, so they meet in the shard of those
   blocks' bits.  ``m`` follows the number of fingerprints (five blocks up to about 29 million).
3. Every shard is a BK-tree: a child hangs under its parent by their integer Hamming distance.
   A query at distance d of a node follows only the edges d - RADIUS .. d + RADIUS.  A
   shard with more fingerprints than a block is cut into blocks; each block's tree is sent to
   every block of its shard (as rows of an equi-join group, never a whole table), so no group
   grows beyond two blocks.  All trees of a slice are built and searched together in numpy.
4. Only connectivity is asked for: links join components while the search runs, and a query
   skips a subtree that lies wholly in its own component, so a dense group of near copies does
   not cost all its pairs.  A group returns one edge per linked node, not its pairs.
5. The edges are contracted to components in Spark.

Result: one row per document with its fingerprint (16 hex digits) and ``component_id``, the
smallest doc_id that is reachable over links (itself included).  Defined cases: fewer words
than a shingle are one shingle of all of them; a text without a word (null, empty, white
space) has the fingerprint zero, linked like any other; repeated rows share their component;
null doc_ids do not count as smallest, and a component of nulls only has a null id; an empty
table gives an empty result.  Texts of any length are hashed in pieces of bounded memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs, slices, string_bytes, table
from .neardup import components, small, with_lookup

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD = 4096  # fingerprints that a shard holds on average at most
BLOCK, MOST_BLOCKS, LARGEST_BLOCK = 1024, 64, 1 << 18  # a hot shard is cut into blocks
FLUSH = 1 << 16  # rows searched together
PAIRS = 1 << 18  # (query, node) pairs of a search at most, per chunk of queries
PIECE = 1 << 15  # shingles hashed at once


# ---------------------------------------------------------------------------
# Fingerprints
# ---------------------------------------------------------------------------

def shingle_spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the space-joined shingles of row i are the spans first[i]:first[i + 1]."""
    data, off = string_bytes(col)
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    inside = (data != 32) & ((data < 9) | (data > 13))
    starts, ends = runs(inside, off)
    row = np.searchsorted(off, starts, "right") - 1
    gap = ends[ends < off[1:][row]]  # the first white space after a word of the same row
    data[gap] = 32
    inside[gap] = True
    at = np.concatenate([[0], np.cumsum(inside)])
    starts, ends = at[starts], at[ends]
    count = np.bincount(row, minlength=len(off) - 1)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    out = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(out)])
    which = np.repeat(np.arange(len(out)), out)
    word = begin[which] + np.arange(first[-1]) - first[which]
    last = word + np.minimum(count[which], SHINGLE) - 1
    return data[inside], starts[word], ends[last], first


def fingerprint_rows(col: pa.Array) -> np.ndarray:
    """The SimHash of every row of a string column (uint64)."""
    data, starts, ends, first = shingle_spans(col)
    raw, digest = memoryview(data), xxhash.xxh64_intdigest
    ones = np.zeros((len(first) - 1, 64), np.int64)
    for lo in range(0, len(starts), PIECE):
        hi = min(lo + PIECE, len(starts))
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)),
                        np.uint64, hi - lo)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))
        rows = np.arange(i, j)
        rows = rows[first[rows + 1] > first[rows]]
        ones[rows] += np.add.reduceat(bits, np.maximum(first[rows] - lo, 0), axis=0, dtype=np.int64)
    over = 2 * ones > np.diff(first)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "_text", 1 << 20):
                fp = fingerprint_rows(batch.column("_text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")) \
        .mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------------------
# BK-trees
# ---------------------------------------------------------------------------

def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member of each node's component) after linking a[k] and b[k]."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


class Forest:
    """BK-trees of many groups: nodes ``fp``, group k holds nodes first[k]:first[k + 1] (distinct values)."""

    def __init__(self, fp: np.ndarray, first: np.ndarray):
        n = len(fp)
        self.fp, self.root = fp, np.arange(n)
        parent, label = np.full(n, -1), np.zeros(n, np.int64)
        self.levels = [first[:-1][np.diff(first) > 0]]
        todo = np.setdiff1d(np.arange(n), self.levels[0], assume_unique=True)
        at = np.repeat(first[:-1], np.diff(first))[todo]
        near: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):  # all nodes of one depth are placed together
            d = np.bitwise_count(fp[todo] ^ fp[at]).astype(np.int64)
            near.append((todo[d <= RADIUS], at[d <= RADIUS]))
            edge, take, back = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = todo[take]  # the first node that comes to a free edge stays there
            parent[child], label[child] = edge // 65, edge % 65
            self.levels.append(child)
            rest = np.ones(len(todo), bool)
            rest[take] = False
            todo, at = todo[rest], child[back][rest]
        self.parent = parent
        order = np.lexsort((label, parent))
        self.child = order[len(self.levels[0]):] if n else order
        self.edge = parent[self.child] * 65 + label[self.child]
        for a, b in near:
            self.link(a, b)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.root = unite(self.root, a, b)

    def same(self) -> np.ndarray:
        """The component that a node's whole subtree lies in, -1 where it lies in several."""
        out = self.root.copy()
        for nodes in self.levels[:0:-1]:
            up = self.parent[nodes]
            out[up[out[nodes] != out[up]]] = -1
        return out

    def search(self, query: np.ndarray, start: np.ndarray) -> None:
        """Link every ``query`` node to the nodes within RADIUS in the tree of root ``start``."""
        same = self.same()
        q, node = query, start
        while len(q):
            other = same[node] != self.root[q]  # a subtree of the query's own component adds nothing
            q, node = q[other], node[other]
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= RADIUS
            if hit.any():
                self.link(q[hit], node[hit])
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - RADIUS, 0), "left")
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + RADIUS, 64), "right")
            n = hi - lo
            cut = np.cumsum(n)
            node = self.child[np.repeat(lo - cut + n, n) + np.arange(cut[-1] if len(cut) else 0)]
            q = np.repeat(q, n)


def linked(fp: np.ndarray, tree: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root of its component) of rows in order of (group, tree): each group has one tree, searched
    by its own nodes, or two, the first searched by the nodes of the second."""
    cut = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (group[1:] != group[:-1]), [True]]))
    f = Forest(fp, cut)
    size, of = np.diff(cut), group[cut[:-1]]
    second = np.concatenate([[False], of[1:] == of[:-1]])
    alone = ~second & ~np.concatenate([second[1:], [False]])
    start = np.where(second, np.concatenate([[0], cut[:-2]]), cut[:-1])  # where a tree's nodes search
    wide = np.where(second, np.concatenate([[0], size[:-1]]), size)
    asks = np.repeat(alone | second, size) & (np.repeat(wide, size) > 1 - np.repeat(second, size))
    query = np.flatnonzero(asks)
    work = np.cumsum(np.repeat(wide, size)[query])
    lo = 0
    while lo < len(query):
        done = work[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(work, done + PAIRS, "right")), lo + 1)
        f.search(query[lo:hi], np.repeat(start, size)[query[lo:hi]])
        lo = hi
    hit = np.flatnonzero(f.root != np.arange(len(fp)))
    return fp[hit], fp[f.root[hit]]


# ---------------------------------------------------------------------------
# Shards
# ---------------------------------------------------------------------------

def shard_masks(n: int) -> list[int]:
    """The bit masks of the shards' keys for ``n`` fingerprints: all ways to keep m - RADIUS of m blocks."""
    m = RADIUS + 1
    while n > SHARD << (64 * (m - RADIUS) // m):
        m += 1
    cuts = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(blocks, m - RADIUS)]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def shard_groups(nodes: DataFrame, n: int) -> DataFrame:
    """Rows (shard, value, i, j, block, fp): group (shard, value, i, j) holds one block (i = j) or two of a shard."""
    keys = [F.struct(F.lit(k).alias("shard"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("value"))
            for k, m in enumerate(shard_masks(n))]
    rows = nodes.select("fp", F.inline(F.array(*keys)))
    hot = rows.groupBy("shard", "value").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    wide = F.least(F.greatest(F.ceil(F.col("m") / MOST_BLOCKS), F.lit(BLOCK)), F.lit(LARGEST_BLOCK))
    hot = small(materialize(hot.select("shard", "value", F.ceil(F.col("m") / wide).alias("blocks")), "simhash-hot"), 24)
    rows = rows.join(hot, ["shard", "value"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    return rows.withColumn("other", other).select(
        "shard", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")


def shard_edges(groups: DataFrame, parts: int) -> DataFrame:
    """(a, b): one edge per linked node of every group to its component's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def searched(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            group = np.concatenate([[0], np.cumsum(new)])
            a, b = linked(np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 4], group)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= FLUSH:
                rows = np.concatenate(held)
                last = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                held, size = [rows[cut:]], len(rows) - cut
                if cut:
                    yield searched(rows[:cut])
        if size:
            yield searched(np.concatenate(held))

    dealt = groups.repartition(parts, "shard", "value", "i", "j").sortWithinPartitions("shard", "value", "i", "j", "block")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sig = materialize(fingerprints(docs), "simhash-fingerprints")
    nodes = materialize(sig.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = materialize(shard_edges(shard_groups(nodes, nodes.count()), parts), "simhash-edges")
    member = components(edges, "simhash-components").join(nodes.withColumnRenamed("fp", "node"), "node")
    member = materialize(member, "simhash-members")
    least = materialize(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight")), "simhash-least")
    linked_fps = with_lookup(member.select("node", "root", "n"), least, "root", "component_id", member.count())
    alone = nodes.where("n > 1").join(member.select(F.col("node").alias("fp")), "fp", "left_anti")
    look = linked_fps.select(F.col("node").alias("fp"), "component_id", F.col("n").alias("weight")) \
        .unionByName(alone.select("fp", F.col("least").alias("component_id"), F.col("n").alias("weight")))
    out = with_lookup(sig, materialize(look, "simhash-lookup"), "fp", "component_id", sig.count())
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    rows = link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
