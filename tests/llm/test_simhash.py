"""SimHash, BK-trees and their components against brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from recordaudit.llm import catalog, common, simhash

from ..conftest import SF_SMALL


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    """The smallest member of the component of every fingerprint, by all pairs."""
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        if (a ^ b).bit_count() <= 4:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {f: find(f) for f in up}


def near_groups(rng, centers, members, flips):
    out = set()
    for c in rng.integers(0, 2**63, centers):
        for _ in range(members):
            x = int(c)
            for k in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(k)
            out.add(x)
    return out


def test_fingerprints_equal_single_hashes(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)  # texts go over several pieces
    texts = ["One two  THREE\tfour five", "a b", "A\nB", "", None, " \t\n", "x", "É é 日本 😀 w5 w6", "same " * 40, "Ab  cD\x1cx y z w v q"]
    got = simhash.fingerprint_rows(pa.array(texts))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]
    assert len(simhash.fingerprint_rows(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("pairs", [1, 100, 10**6])
def test_trees_give_the_components_of_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    groups = [near_groups(rng, 4, 40, 8), {7}, near_groups(rng, 1, 200, 3)]
    fp = np.array([x for g in groups for x in sorted(g, key=lambda v: v * 2654435761 % 2**32)], np.uint64)
    group = np.repeat([0, 1, 2], [len(g) for g in groups])
    a, b = simhash.linked(fp, np.zeros(len(fp), int), group)
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    for g in groups:
        want = brute_components(g)
        for x, y in itertools.combinations(sorted(g), 2):
            assert (want[x] == want[y]) == (root.get(x, x) == root.get(y, y))


def test_two_trees_of_a_group_link_across():
    fp = np.array([0b1111, 0, 1 << 60, (1 << 60) | 7, 1 << 30 | 0b11111 << 40], np.uint64)
    a, b = simhash.linked(fp, np.array([0, 0, 0, 1, 1]), np.zeros(5, int))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {0: 15, 1 << 60: 15, (1 << 60) | 7: 15}


def test_shards_keep_every_link():
    for n in (10, 10**8, 10**11):
        masks = simhash.shard_masks(n)
        rng = np.random.default_rng(n % 97)
        for _ in range(300):
            flips = 0
            for k in rng.choice(64, 4, replace=False):
                flips |= 1 << int(k)
            assert any(not flips & m for m in masks)
    assert len(simhash.shard_masks(10**8)) == 15


def test_hot_shards_are_cut_into_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "MOST_BLOCKS", 1000)
    rng = np.random.default_rng(5)
    fps = sorted(near_groups(rng, 2, 60, 6))
    nodes = spark.createDataFrame([(simhash._long(x),) for x in fps], "fp bigint")
    groups = simhash.shard_groups(nodes, len(fps))
    assert groups.groupBy("shard", "value", "i", "j").count().agg({"count": "max"}).first()[0] < len(fps)
    edges = simhash.shard_edges(groups, 4)
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in edges.collect():
        x, y = find(r.a % 2**64), find(r.b % 2**64)
        up[max(x, y)] = min(x, y)
    assert {x: find(x) for x in fps} == brute_components(fps)


def test_odd_rows(spark, frame):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    docs = frame([(9, None), (3, ""), (None, " \t"), (5, "alpha beta gamma delta"), (2, "ALPHA beta\ngamma  delta"),
                  (5, "alpha beta gamma delta"), (None, "nobody has this text at all today"), (7, long), (8, long)],
                 ).selectExpr("*", "1 fp", "2 component_id", "3 least", "4 weight")
    rows = simhash.link_documents(docs).collect()
    assert len(rows) == 9
    got = sorted((r.doc_id or -1, r.component_id) for r in rows if r.doc_id is not None)
    assert got == [(2, 2), (3, 3), (5, 2), (5, 2), (7, 7), (8, 7), (9, 3)]
    assert {r.component_id for r in rows if r.doc_id is None} == {3, None}
    assert simhash.link_documents(frame([])).count() == 0


def test_query_equals_brute_force(spark):
    docs = common.table(spark, SF_SMALL, "documents").collect()
    rows = {r.doc_id: r for r in catalog.QUERIES["op11_simhash"](spark, SF_SMALL).collect()}
    fp = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    root = brute_components(set(fp.values()))
    least = {}
    for i in sorted(fp):
        least.setdefault(root[fp[i]], i)
    assert len(rows) == len(docs)
    for i, f in fp.items():
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{f:016x}", least[root[f]])
