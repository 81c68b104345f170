"""Cross-tokenizer alignment against plain loops over single texts."""

import hashlib
from collections import Counter, defaultdict

import pytest

from recordaudit.llm import catalog, common, crosstok

from ..conftest import SF_SMALL

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def models(spark):
    return crosstok.read_models(spark)


@pytest.fixture(scope="module")
def tokenizers(models):
    from tokenizers import Tokenizer

    t = crosstok.Tokenizers(models)
    t.single = Tokenizer.from_str(models[0])  # the vocabulary file's own library
    t.single.encode_special_tokens = True
    return t


def brute(t, texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    rows, holds = [], Counter()
    for text in texts:
        links, groups = [], []
        if text:
            a = t.single.encode(" " + text, add_special_tokens=False).ids
            b = t.b.encode(text)
            sides = []
            for ids, known in ((a, t.a_bytes), (b, t.b_bytes)):
                at, spans = 0, []
                for i in ids:
                    n = len(known[i].as_py())
                    spans.append((at, at + n, i))
                    at += n
                sides.append(spans)
            raw = (" " + text).encode()
            if all(b"".join(known[i].as_py() for i in ids) == raw for ids, known in ((a, t.a_bytes), (b, t.b_bytes))):
                cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
                lo = 0
                for hi in cuts:
                    groups.append([[i for s, e, i in side if lo <= s and e <= hi] for side in sides])
                    lo = hi
                links = [(x, y) for s, e, x in sides[0] for u, v, y in sides[1] if s < v and u < e]
        holds.update(set(links))
        rows.append((links, groups))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for links, groups in rows:
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links),
                    hashlib.sha256(printed.encode()).hexdigest() if groups else ""))
    return out


def test_ids_equal_the_library_of_the_vocabulary_file(tokenizers):
    texts = [f" a{c}b1{c}2 {c}{c} !{c}?  {c} '{c}{c}s\n{c}\t " for c in map(chr, [*range(0x3500), *range(0x3500, 0x110000, 61)])
             if not 0xD800 <= ord(c) < 0xE000]
    texts += ["x" * 5000, "ab" * 3000, " " * 4000, "\n " * 900, "<|endoftext|> </s>", "I'll they'RE 've"]
    want = tokenizers.single.encode_batch([" " + t for t in texts], add_special_tokens=False)
    for t, mine, e in zip(texts, tokenizers.a_ids(texts), want, strict=True):
        assert mine.tolist() == e.ids, t


ODD = [None, "", " ", "a", "Hello  world, <|endoftext|> </s> <0x41>", "日本語 text 😀 naïve", "▁ under", "tab\tand\nlines \n x",
       "Hello  world, <|endoftext|> </s> <0x41>", "\x00nul", "don't 123 4567 ---- ....", "é" * 30, "a b c"]


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id))]


def test_odd_rows_equal_plain_loops(spark, frame, models, tokenizers):
    docs = frame([(k, t) for k, t in enumerate(ODD)]).selectExpr("*", "1 row", "2 kind", "3 pairs", "4 n_a")
    assert rows_of(crosstok.align_documents(docs, models)) == brute(tokenizers, ODD)
    assert crosstok.align_documents(frame([]), models).count() == 0
    (r,) = crosstok.align_documents(frame([(None, None)]), models).collect()
    assert (r.doc_id, r.n_a, r.count_sum, r.groups_sha256) == (None, 0, 0, "")


def test_rare_pairs_come_by_the_shuffle(spark, frame, models, tokenizers, monkeypatch):
    texts = [*ODD, *[f"the cat sat on mat number {k} again and again" for k in range(8)]]
    for head in (1, 40):
        monkeypatch.setattr(crosstok, "HEAD", head)
        assert rows_of(crosstok.align_documents(frame(list(enumerate(texts))), models)) == brute(tokenizers, texts)


def test_long_texts_in_parts(tokenizers, monkeypatch):
    texts = [("Some words, don't cut  here\n or here; naïve 123 " * 40).strip(), "x" * 500, "short one", "bad ▁ " + "some words " * 60]
    want = crosstok.align_texts(tokenizers, texts)
    monkeypatch.setattr(crosstok, "LONGEST", 37)
    monkeypatch.setattr(crosstok, "SLICE", 90)
    assert len(tokenizers.parts(texts[0])) > 10 and " ".join(tokenizers.parts(texts[0])) == texts[0]
    got = crosstok.align_texts(tokenizers, texts)
    assert (got[0] == want[0]).all() and got[1] == want[1] and got[2].equals(want[2])
    assert want[1][3] == "" and want[1][0] != ""


def test_partial_counts_are_given_out_in_pieces(spark, frame, models, tokenizers, monkeypatch):
    monkeypatch.setattr(crosstok, "HELD", 10)
    monkeypatch.setattr(crosstok, "SLICE", 30)
    texts = [f"some words of text {k % 3} and more {k}" for k in range(12)]
    assert rows_of(crosstok.align_documents(frame(list(enumerate(texts))).coalesce(1), models)) == brute(tokenizers, texts)


def test_query_equals_plain_loops(spark, tokenizers):
    docs = sorted(common.table(spark, SF_SMALL, "documents").collect(), key=lambda r: r.doc_id)
    short = [d for d in docs if len(d.text or "") < 3000]
    want = brute(tokenizers, [d.text if len(d.text or "") < 3000 else None for d in docs])
    rows = {r.doc_id: r for r in catalog.QUERIES["op12_cross_tokenizer"](spark, SF_SMALL).collect()}
    assert len(rows) == len(docs)
    by = {d.doc_id: w for d, w in zip(docs, want, strict=True)}
    for d in short:
        r, w = rows[d.doc_id], by[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[:4], w[6])
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows.values())
