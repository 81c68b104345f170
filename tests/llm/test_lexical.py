"""Ranked search: the sharing DAG, brute force, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recordaudit.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items, top=10):
    """(item_id, rank, doc_id, score) for lists of (id, text)."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m))
                    for w in terms(text) if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def test_terms_are_the_pattern_s_matches():
    texts = ["Ab-c_d É9é!", "", None, "日本語、x", "\x00a\x7fB c", " ", "1.5 a1B2"]
    flat, first = lexical.terms(pa.array(texts))
    words = flat.to_pylist()
    assert [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [terms(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_dag_gives_the_items_back_and_shares(seed):
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(12)]
    items = [[f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 40)) if x < 200] + passage[: rng.integers(0, 13)] + ["twice"] * (k % 3)
             for k in range(25)] + [passage + passage, [], ["w1"] * 5]
    dag = lexical.mine(items)

    def full(part):
        if part < len(dag["classes"]):
            return Counter(dag["classes"][part])
        return sum((full(p) for p in dag["rows"][part - len(dag["classes"])]), Counter())

    for k, row in enumerate(dag["items"]):
        assert sum((full(p) for p in dag["rows"][row]), Counter()) == Counter(items[k])
    for k, parts in enumerate(dag["rows"]):
        assert all(p < len(dag["classes"]) + k for p in parts)  # parts come first
    assert sum(map(len, dag["rows"])) <= sum(len(set(i)) for i in items) + 2


def test_plan_scores_equal_plain_sums():
    items = [["a", "b", "c", "d", "a"], ["a", "b", "c", "d"], ["b", "c", "d", "e", "f"], ["f"], []]
    ids = {t: k for k, t in enumerate("abcdef")}
    plan = lexical.Plan(lexical.mine(items), ids, 6)
    rng = np.random.default_rng(1)
    part = rng.integers(0, 2**40, (7, 6)) * (rng.random((7, 6)) < 0.6)
    row, term = np.nonzero(part)
    got = plan.scores(row, term, part[row, term], 7)
    assert np.array_equal(got, [[sum(part[r, ids[t]] for t in i) for r in range(7)] for i in items])


def test_odd_rows_ties_and_repeats(spark, frame, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(lexical, "SCAN_BYTES", 1)  # one block a scan
    monkeypatch.setattr(lexical, "ROWS", 4)
    long = " ".join(f"w{i % 611}" for i in range(50_000))
    docs = [(3, "red fox runs"), (1, "RED fox; runs"), (None, "red fox runs"), (2, "red fox runs"), (2, "red fox runs"), (7, None), (8, ""),
            (9, "..."), (10, "blue whale"), (11, long), *[(20 + k, f"fox number {k}") for k in range(15)]]
    items = [(1, "Fox red"), (1, "Fox red"), (2, None), (3, "?!"), (4, "absent words"), (5, "w5 w5 w6 whale"), (None, "blue")]
    df = frame(docs).selectExpr("*", "1 q", "2 item_id", "3 n", "4 ids")
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id or -1, r.rank, r.doc_id or -1, r.score) for r in got) \
        == sorted((i or -1, k, d or -1, s) for i, k, d, s in brute(docs, items))
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(df, none).count() == 0
    assert lexical.search(frame([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0
