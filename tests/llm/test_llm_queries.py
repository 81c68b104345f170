"""Queries against their SQL or a brute-force version over the whole small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest

from recordaudit.llm import catalog, common, pieces

from ..conftest import SF_ORACLE, SF_SMALL
from ..oracle_harness import compare, duck


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in common.table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    r = compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF_ORACLE, duck(SF_ORACLE))
    assert r["ok"], r


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_decontamination_finds_what_is_contained(spark, docs):
    got = {(r.doc_id, r.item_id): r.coverage for r in catalog.QUERIES["op2_decontamination"](spark, SF_SMALL).collect()}
    items = {r.item_id: words(r.text) for r in common.table(spark, SF_SMALL, "benchmark").collect()}
    want = {(d["doc_id"], i) for d in docs for i, w in items.items()
            if len(w) >= 4 and " " + " ".join(w) + " " in " " + " ".join(words(d["text"])) + " "}
    assert want <= set(got) and all(got[k] == 1.0 for k in want)
    for d, i in set(got) - want:  # the others share at least half of the item's words with the document
        assert len(set(items[i]) & set(words(docs[d]["text"]))) >= 0.4 * len(set(items[i]))


def test_fingerprints_estimate_generalised_jaccard(spark, docs):
    rows = {r.doc_id: r for r in catalog.QUERIES["op3_fingerprints"](spark, SF_SMALL).collect()}
    assert len(rows) == len(docs)

    def jaccard(a, b):
        a, b = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    off = []
    by_text = collections.defaultdict(set)
    for d, nxt in zip(docs, docs[1:] + docs[:1], strict=True):
        r, t = rows[d["doc_id"]], d["text"]
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt["text"][:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, nxt["text"])]
        by_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.45


def test_language_on_held_out_documents(spark):
    rows = catalog.QUERIES["op4_language_id"](spark, SF_ORACLE).collect()
    lang = {r.doc_id: r.lang for r in common.table(spark, SF_ORACLE, "documents").collect()}
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_model_base_score_and_gain(spark, docs):
    rows = {r.doc_id: r for r in catalog.QUERIES["op5_language_model"](spark, SF_SMALL).collect()}

    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})) + [None]

    count = collections.Counter()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 10:
            count.update(toks(d["text"]))
    n, v = sum(count.values()), len(count)
    for d in docs:
        r, w = rows[d["doc_id"]], toks(d["text"])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_secrets_are_found_where_they_are(spark):
    docs = common.table(spark, SF_ORACLE, "documents").collect()  # the smallest table holds no secret
    got = {(r.doc_id, r.start, r.length) for r in catalog.QUERIES["op6_secret_scan"](spark, SF_ORACLE).collect()}
    want = set()
    for d in docs:
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=.\-])AKIA[0-9A-Z]{16}(?![A-Za-z0-9+/_=.\-])|(?i:token = \")([0-9a-fA-F]{40})(?=\")", d["text"]):
            g = 1 if m.group(1) else 0
            want.add((d["doc_id"], m.start(g), m.end(g) - m.start(g)))
    assert want and want <= got
    assert len(got - want) <= 0.1 * len(got) + 1


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = {r.doc_id: r for r in catalog.QUERIES["op8_near_duplicates"](spark, SF_SMALL).collect()}

    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.defaultdict(set)
    text = {d["doc_id"]: d["text"] for d in docs}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
            if text[a] != text[b]:
                links[a].add(text[b])
                links[b].add(text[a])
    for i in sets:
        assert (rows[i].class_id, rows[i].links) == (find(i), len(links[i])), i


def test_sentencepiece_equals_the_library(spark, docs):
    spm = pytest.importorskip("sentencepiece")
    sp = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = {r.doc_id: r for r in catalog.QUERIES["op9_sentencepiece"](spark, SF_SMALL).collect()}
    for d in docs:
        assert rows[d["doc_id"]].ids == sp.encode(d["text"]) and rows[d["doc_id"]].round_trip


def test_sharding_balances_rows_and_leaves_no_gap(spark, docs):
    rows = catalog.QUERIES["op10_sharding"](spark, SF_SMALL).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert len(rows) == len(docs) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in rows:
        raw = docs[r.doc_id]["text"].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
