"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are linked when the Jaccard similarity of their five-word shingle sets
is at least 0.8.  The steps:

1. Every text is reduced to its shingle set (in Arrow batches) and a row with a
   hash of the set and ``BANDS`` keys of ``ROWS`` MinHash values each.  Texts with
   equal sets are one node from here on, so copies cost one row.
2. Nodes that share a band key are candidates.  Two sets at the threshold miss all
   bands with a chance of (1 - 0.8**6)**48, below 5e-7.  A bucket only links its
   members to its smallest one; buckets are joined to components by star
   contraction, so no pair is listed, however large a bucket is.
3. A component's nodes meet in blocks of at most ``BLOCK`` sets; a component with
   more is cut into blocks, and every pair of blocks is one group of rows.  Inside a
   group the MinHash values are compared ``STEP`` at a time, and a pair is dropped
   once the posterior probability that its similarity reaches the threshold (from a
   uniform prior) falls below ``TOLERANCE``; the others are verified exactly on the
   shingle sets.  A group returns per node the number of linked texts and one edge to
   the root of its local component, not the pairs.
4. The edges are contracted to classes; every document gets its class.

Results: one row per document with its class (the smallest doc_id of the class), the
number of documents in its class, and ``links``: how many other distinct texts are
linked to its text.  Defined cases: a text without a word (null, empty, signs only)
is linked to nothing and is a class of its own; a text of fewer than five words has
one shingle of all its words; words are runs of letters and digits, lower-cased.
Repeated rows are copies of one text: same class, no link.  Null doc_ids sort last
when the representative is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_per_row, materialize, mix, plain_names, shingles, slices, table, words

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 48, 6
STEP, STEPS = 32, 4  # MinHash values per round, rounds
TOLERANCE = 1e-9
BLOCK = 1024  # nodes
BLOCK_SHINGLES = 2_000_000
HEAVY = 1000  # a key with more than this part of all rows is heavy; there are fewer heavy keys than this
SMALL_BYTES = 48 << 20  # proven size up to which a lookup table is broadcast


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    return base[:n], base[n:] | np.uint64(1)


def minhash(values: np.ndarray, first: np.ndarray, n: int, salt: int, chunk: int = 1024) -> np.ndarray:
    """rows x n MinHash values (64 bits) of non-empty rows of shingle hashes."""
    xor, mul = _seeds(n, salt)
    rows = len(first) - 1
    out = np.full((rows, n), np.iinfo(np.uint64).max, np.uint64)
    lo = 0
    while lo < rows:
        hi = max(int(np.searchsorted(first, first[lo] + chunk, "right")) - 1, lo + 1)
        for a in range(int(first[lo]), int(first[hi]), 4 * chunk):  # a long row in several pieces
            b = min(a + 4 * chunk, int(first[hi]))
            cuts = first[lo:hi] - a if hi - lo > 1 else np.zeros(1, np.int64)
            v = values[a:b][None, :] ^ xor[:, None]
            v *= mul[:, None]
            part = np.minimum.reduceat(v, cuts, axis=1).T
            out[lo:hi] = np.minimum(out[lo:hi], part)
        lo = hi
    return out


def row_hash(values: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash per row of its (distinct) values; rows without values give 0."""
    terms = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix((terms[first[1:]] - terms[first[:-1]]) ^ (size * np.uint64(salt | 1))), 0)


def text_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per row of a lower-cased string column."""
    *_, hashes, first = words(col)
    return distinct_per_row(*shingles(hashes, first, SHINGLE))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (null without words), n (shingles), bands (array of keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "_text", 1 << 20):
                v, first = text_sets(batch.column("_text"))
                n = np.diff(first)
                node = row_hash(v, first, 0x51ED2701).view(np.int64)
                full = np.flatnonzero(n > 0)
                keys = np.zeros((len(full), BANDS), np.uint64)
                if len(full):
                    packed = np.concatenate([[0], np.cumsum(n[full])])
                    m = minhash(v, packed, BANDS * ROWS, 1).reshape(len(full), BANDS, ROWS)
                    keys += np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
                    for r in range(ROWS):
                        keys = mix(keys ^ m[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, mask=n == 0),
                     pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))],
                    names=["doc_id", "text_hash", "node", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.lower("text").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, n bigint, bands array<bigint>")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, with a broadcast hint where its counted size is below SMALL_BYTES;
    else the planner joins it by a shuffle (and splits skewed keys)."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def with_lookup(rows: DataFrame, look: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` left joined to ``look`` (key, value, weight); weight: how many rows have the key, of ``total``.

    Keys with more than a HEAVY-th of the rows (fewer than HEAVY of them) are broadcast; the others, none
    of which is hot, are joined by a shuffle."""
    heavy = F.col("weight") * HEAVY > F.lit(total)
    first = rows.join(F.broadcast(look.where(heavy).select(key, F.col(value).alias("_heavy"), F.lit(True).alias("_is"))), key, "left")
    light = first.where("_is is null").drop("_heavy", "_is").join(look.where(~heavy).select(key, value), key, "left")
    return first.where("_is").drop("_is").withColumnRenamed("_heavy", value).unionByName(light)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node of an edge.

    ``edges`` (a, b).  Alternating star contraction: large stars link every larger
    neighbour to the smallest one, small stars link the smaller ones; it ends when all
    edges are stars.  Every round is written out; its aggregates are partial."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("weight")).select("a", F.least("a", "m").alias("m"), "weight")
        total = 2 * e.count()
        large = with_lookup(both.where("b > a"), least, "a", "m", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(with_lookup(e, least, "a", "m", total).select("a", F.col("m").alias("b"))).where("a > b").distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("weight"))
        e = with_lookup(large, least, "a", "m", large.count()).select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        e = materialize(e, name)
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if state == seen and state[0] == state[2]:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal MinHash values among n for which a pair is kept.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m equal values,
    and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    tail, m = 0.0, 0
    while m <= n:
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
        m += 1
    return n


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) with all pairs of similarity >= THRESHOLD; ``right`` None: pairs i < j within ``left``."""
    a = left
    b = left if right is None else right

    def csr(sets):
        return np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), np.concatenate(sets)

    fa, va = csr(a)
    fb, vb = (fa, va) if right is None else csr(b)
    uniq, ids = np.unique(vb, return_inverse=True)
    sa, sb = np.diff(fa), np.diff(fb)
    t = float(THRESHOLD)
    ma = minhash(va, fa, STEP * STEPS, 77)
    mb = ma if right is None else minhash(vb, fb, STEP * STEPS, 77)
    need = [least_matches(STEP * (s + 1), t, TOLERANCE) for s in range(STEPS)]
    for i in range(len(a)):
        js = np.arange(i + 1 if right is None else 0, len(b))
        js = js[(sb[js] >= t * sa[i] - 1e-9) & (sa[i] >= t * sb[js] - 1e-9)]  # sizes bound the similarity
        equal = np.zeros(len(js), np.int64)
        for s in range(STEPS):
            if not len(js):
                break
            part = slice(s * STEP, (s + 1) * STEP)
            equal = equal + (mb[js, part] == ma[i, part]).sum(axis=1)
            keep = equal >= need[s]
            js, equal = js[keep], equal[keep]
        if not len(js):
            continue
        flag = np.zeros(len(uniq) + 1, np.int32)
        at = np.searchsorted(uniq, a[i])
        at[at == len(uniq)] = 0
        flag[at[uniq[at] == a[i]]] = 1
        if len(js) * 4 > len(b):
            inter = np.add.reduceat(flag[ids], fb[:-1])[js]
        else:
            size = sb[js]
            cut = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(fb[js] - cut[:-1], size) + np.arange(int(cut[-1]))
            inter = np.add.reduceat(flag[ids[pick]], cut[:-1])
        ok = inter * (THRESHOLD.denominator + THRESHOLD.numerator) >= THRESHOLD.numerator * (sa[i] + sb[js])
        if ok.any():
            yield i, js[ok]


class _Roots:
    """Union-find over the nodes of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def verify(grouped: DataFrame) -> DataFrame:
    """node, root, links of every linked node of every group.

    ``grouped``: rows (root, i, j, block, node, texts, shingles) of one group (root, i, j)
    lie together and in order of node."""

    def group(rows: list[tuple]) -> tuple[list[int], list[int], list[int]]:
        i, j = rows[0][1], rows[0][2]
        seen: dict[int, tuple] = {}
        for r in rows:
            seen.setdefault(r[4], r)  # repeated rows of one node count once
        rows = sorted(seen.values(), key=lambda r: (r[3], r[4]))
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        cut = sum(r[3] == i for r in rows) if i != j else len(rows)
        links, roots = np.zeros(len(rows), np.int64), _Roots(len(rows))
        weight = np.array([r[5] for r in rows], np.int64)
        pairs = linked_pairs(sets, None) if i == j else (
            linked_pairs(sets[:cut], sets[cut:]) if 0 < cut < len(rows) else iter(()))
        for x, ys in pairs:
            ys = ys if i == j else ys + cut
            links[x] += weight[ys].sum()
            links[ys] += weight[x]
            for y in ys:
                roots.join(x, int(y))
        hit = np.flatnonzero(links)
        return [rows[x][4] for x in hit], [rows[roots.find(int(x))][4] for x in hit], links[hit].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            if len(held) > 1:
                for o, part in zip(out, group(held), strict=True):
                    o.extend(part)
            held.clear()

        def batch_out():
            b = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "root", "links"])
            for o in out:
                o.clear()
            return b

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("root", "i", "j", "block", "node", "texts", "shingles")]
            for r in zip(*cols, strict=True):
                if held and held[0][:3] != r[:3]:
                    flush()
                held.append(r)
            if out[0]:
                yield batch_out()
        flush()
        yield batch_out()

    return grouped.mapInArrow(run, "node bigint, root bigint, links bigint")


def node_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, text_hash, node, ...) with the shingle set of each row as bytes."""
    extra = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "_text", 1 << 20):
                v, first = text_sets(batch.column("_text"))
                raw = [v[first[k]:first[k + 1]].tobytes() for k in range(len(first) - 1)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(raw, pa.binary())],
                                                 names=[*extra, "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.lower("text").alias("_text"))
    rows = rows.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = rows.join(small(wanted, 80), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))) \
        .select(*extra, "_text")
    schema = wanted.select(*extra).schema.add("shingles", "binary")
    return rows.mapInArrow(run, schema)


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, class_text, has_words, links of every row of ``docs`` (doc_id, text).

    (class_id, class_text) are doc_id and text hash of the class's representative."""
    sig = materialize(signatures(docs), "near-signatures")
    texts = sig.where("node is not null").groupBy("node", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))  # min skips nulls
    nodes = texts.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"),
                                      F.count(F.lit(1)).alias("texts"), F.min("n").alias("n"))
    nodes = materialize(nodes.select("node", "rep.doc_id", "rep.text_hash", "texts", "n"), "near-nodes")

    banded = sig.where("node is not null").select("node", F.explode("bands").alias("key"))
    least = materialize(banded.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top"))
                        .where("b <> top").select("key", "b"), "near-buckets")
    edges = banded.join(small(least, 32), "key").select(F.col("node").alias("a"), "b")
    comp = materialize(components(edges, "near-candidates"), "near-components")

    sizes = comp.join(nodes, "node").groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    sizes = small(materialize(sizes, "near-sizes"), 40)
    wanted = comp.join(sizes, "root").join(nodes, "node").select(
        "doc_id", "text_hash", "node", "texts", "root", blocks.alias("blocks"))
    wanted = materialize(wanted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-wanted")
    sets = node_shingles(docs, wanted)
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "node", "texts", "shingles")
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = paired.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    found = materialize(verify(grouped), "near-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")
    state = nodes.join(links, "node", "left").join(final, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash").alias("rep"),
        (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links"))
    classes = state.groupBy("root").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("m"))
    classes = small(materialize(classes.where("m > 1").drop("m"), "near-heads"), 32)  # classes of several nodes
    head = F.coalesce("head", "rep")
    state = state.join(classes, "root", "left").select(
        "node", "links", head["doc_id"].alias("class_id"), head["text_hash"].alias("class_text"))
    state = materialize(state, "near-state")
    return sig.select("doc_id", "text_hash", "node").join(state, "node", "left").select(
        "doc_id", "text_hash", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_text", "text_hash").alias("class_text"), F.col("node").isNotNull().alias("has_words"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


@plain_names
def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the representative stays (of rows that repeat it, one); texts
    without words all stay."""
    joined = materialize(join_documents(docs), "near-joined")
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_text"))
    gone = joined.where(F.col("has_words") & ~head).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    twice = joined.where(F.col("has_words") & head).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")) \
        .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    gone, twice = materialize(gone, "near-gone"), materialize(twice, "near-repeated")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(small(gone, 40), on, "left_anti")
    if twice.isEmpty():
        return rows.select(*docs.columns)
    once = rows.join(small(twice, 40), on, "left_anti")
    repeated = rows.join(small(twice, 40), on, "left_semi").dropDuplicates(["doc_id", "_hash"])
    return once.unionByName(repeated).select(*docs.columns)
