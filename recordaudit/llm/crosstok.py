"""Cross-tokenizer alignment.

Every text is encoded by two tokenizers: A (byte-level BPE, of space + text) and B (SentencePiece
BPE, of text; it adds the space itself).  Both cut the same bytes, so byte offsets at which tokens
of A and B both end cut the tokens into groups, and an A and a B token are linked where their
byte ranges overlap.  An id pair counts the documents that hold it linked.

First pass (``mapInArrow``; per slice of texts, on Arrow tables): the token lists are flattened
with their parent indices; cumulative sums of the token lengths, restarted per text, give the ends; a full
outer hash join of the two token tables on (text, end) gives one row per overlap, in which
the missing side is the next token that ends later; ``group_by`` gives the pairs of a
document and the partial document counts of a task, which Spark merges.

Second pass: the documents' pairs meet the merged counts.  Pairs that hold more than a
``HEAD``-th of all (document, pair) rows - fewer than ``HEAD``, whatever the corpus - are sent to
the tasks as sorted arrays; the others, none of which is hot, by a shuffled join.  The highest count per
A id has at most as many rows as A's vocabulary.

Memory: texts beyond ``LONGEST`` characters are encoded in parts, cut at single spaces between word
characters, which no token of either tokenizer spans (B's vocabulary is checked for that); a
text without such a space is one part.

Defined cases: a text that is null or empty, or whose bytes the tokens of A or B do not give back (such
as texts with U+2581), has no tokens: zeros and an empty ``groups_sha256``.  Repeated rows count each.
Strings of special tokens inside texts are plain text.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, slices, table

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST = 1 << 18  # characters of a part
SLICE = 1 << 20  # bytes of text worked on at once
HELD = 1 << 20  # distinct pairs of a task's partial counts before they are given out
HEAD = 1 << 19  # pairs that are sent to the tasks at most
SHIFT = 20  # a pair is (A id << SHIFT) + B id

# Fixed value: how byte-level vocabularies of this kind cut texts into words.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\w) (?=\w)")
DOC_SCHEMA = ("kind int, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              "groups_sha256 string, pairs array<bigint>, times array<bigint>")


# ---------------------------------------------------------------------------
# Tokenizers
# ---------------------------------------------------------------------------

def read_models(spark, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> tuple[str, bytes]:
    """The two vocabulary files, read through Spark."""
    raw = [bytes(spark.read.format("binaryFile").load(p if "://" in p else f"file://{p}").first()["content"])
           for p in (byte_model, piece_model)]
    return raw[0].decode(), raw[1]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the
    other bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens.

    A's vocabulary file is a list of byte-level merges in order of their ids, so its ids are the ranks
    that tiktoken merges by; special tokens are left out, their strings are plain text."""

    def __init__(self, models: tuple[str, bytes]):
        import sentencepiece
        import tiktoken

        model = json.loads(models[0])
        special = {t["content"] for t in model["added_tokens"]}
        merged = [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        pre = model["pre_tokenizer"]
        if merged != sorted(merged) or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["normalizer"]:
            raise ValueError("only byte-level vocabularies with merges in order of their ids are supported")
        alphabet = byte_alphabet()
        entries = {i: bytes(alphabet[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in special}
        width = max(entries, default=-1) + 1
        self.a = tiktoken.Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models[1])
        self.a_bytes = pa.array([entries.get(k, b"") for k in range(width)], pa.large_binary())
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                                 for k, p in enumerate(pieces)], pa.large_binary())
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.width = max(width, len(pieces))
        #: ids in decimal with what may follow them in a list of groups
        self.printed = pa.array([f"{k}{end}".encode() for end in (",", "|", ";", "") for k in range(self.width)], pa.large_binary())

    def a_ids(self, parts: list[str]) -> list[np.ndarray]:
        return [self.a.encode_to_numpy(" " + p, disallowed_special=()) for p in parts]

    def parts(self, text: str) -> list[str]:
        """``text`` cut into parts that are encoded alone: each follows a single space that it leaves out."""
        out, at = [], 0
        while self.cuts and len(text) - at > LONGEST:
            m = _CUT.search(text, at + LONGEST)
            if m is None:
                break
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]


# ---------------------------------------------------------------------------
# One slice
# ---------------------------------------------------------------------------

class _Side:
    """The flattened tokens of one tokenizer over all parts."""

    def __init__(self, ids: list, known: pa.Array):
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
        self.ids, self.part = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
        count = np.diff(cuts)
        self.first = cuts.astype(np.int64)
        text = known.take(self.ids)
        sums = np.concatenate([[0], pc.cumulative_sum(pc.binary_length(text)).to_numpy()]) if len(text) else np.zeros(1, np.int64)
        self.edge = sums[self.first]  # first byte of every part
        self.end = pa.array(sums[1:] - np.repeat(self.edge[:-1], count))  # restarted per part
        buf = text.buffers()[2]
        self.bytes = memoryview(buf).cast("B") if buf is not None else memoryview(b"")

    def same(self, k: int, want: bytes) -> bool:
        return self.edge[k + 1] - self.edge[k] == len(want) and self.bytes[self.edge[k]:self.edge[k + 1]] == want


def align_parts(t: Tokenizers, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[memoryview], pa.Table]:
    """ok, (n_a, n_b, n_groups, n_links) and the printed groups of every part; (part, pair) of every link."""
    a = _Side(t.a_ids(parts), t.a_bytes)
    b = _Side(t.b.encode(parts, num_threads=1), t.b_bytes)
    ok = np.array([a.same(k, want) and b.same(k, want) for k, want in enumerate((" " + p).encode() for p in parts)], bool)
    tables = []
    for side, name in ((a, "a"), (b, "b")):
        keep = pa.array(ok).take(side.part)
        row = pa.array(np.arange(len(side.ids)))
        tables.append(pa.table({"part": side.part, "end": side.end, name: row}).filter(keep))
    both = tables[0].join(tables[1], ["part", "end"], join_type="full outer", use_threads=False) \
        .sort_by([("part", "ascending"), ("end", "ascending")]).combine_chunks()
    shared = pc.and_(both["a"].is_valid(), both["b"].is_valid())
    x, y = (pc.fill_null_backward(both[c]) for c in ("a", "b"))  # the token that covers the bytes up to the end
    pair = pc.add(pc.shift_left(a.ids.take(x.combine_chunks()).cast(pa.int64()), SHIFT), b.ids.take(y.combine_chunks()).cast(pa.int64()))
    part = both["part"].to_numpy()
    n = len(parts)
    at = np.flatnonzero(shared.to_numpy())
    size = np.stack([np.where(ok, np.diff(a.first), 0), np.where(ok, np.diff(b.first), 0),
                     np.bincount(part[at], minlength=n), np.bincount(part, minlength=n)], axis=1)
    return ok, size, _printed(t, a, b, ok, both.filter(shared)), pa.table({"part": both["part"], "pair": pair})


def _printed(t: Tokenizers, a: _Side, b: _Side, ok: np.ndarray, shared: pa.Table) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of every part: all tokens' texts are taken from one table in their printed order."""
    last_a, last_b = shared["a"].to_numpy(), shared["b"].to_numpy()  # the last token of each side in every group
    n_a, n_b = len(a.ids), len(b.ids)
    keep_a, keep_b = np.repeat(ok, np.diff(a.first)), np.repeat(ok, np.diff(b.first))
    ia, ib = np.flatnonzero(keep_a), np.flatnonzero(keep_b)
    ends_a, ends_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    ends_a[last_a] = ends_b[last_b] = 1
    ga, gb = (np.cumsum(ends_a) - ends_a)[ia], (np.cumsum(ends_b) - ends_b)[ib]  # the group of every kept token
    end_a, end_b = np.cumsum(keep_a)[last_a], np.cumsum(keep_b)[last_b]  # kept tokens up to the end of each group
    code_a, code_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    code_a[last_a] = 1
    code_b[last_b] = 2
    full = ok & (np.diff(b.first) > 0)
    code_b[b.first[1:][full] - 1] = 3
    index = np.zeros(len(ia) + len(ib), np.int64)
    before_b, before_a = np.concatenate([[0], end_b]), np.concatenate([[0], end_a])
    index[np.arange(len(ia)) + before_b[ga]] = code_a[ia] * t.width + a.ids.to_numpy()[ia]
    index[np.arange(len(ib)) + before_a[gb + 1]] = code_b[ib] * t.width + b.ids.to_numpy()[ib]
    text = t.printed.take(pa.array(index))
    off = np.frombuffer(text.buffers()[1], np.int64)[:len(index) + 1] if len(index) else np.zeros(1, np.int64)
    raw = memoryview(text.buffers()[2]) if len(index) else memoryview(b"")
    size = np.where(ok, np.diff(a.first) + np.diff(b.first), 0)
    edge = off[np.concatenate([[0], np.cumsum(size)])]
    return [raw[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]


def align_texts(t: Tokenizers, texts: list[str | None]) -> tuple[np.ndarray, list[str], pa.Table]:
    """Per text (n_a, n_b, n_groups, n_links) and the digest of its groups; (text, pair, times), in order of the texts."""
    ok, size, digest = np.ones(len(texts), bool), np.zeros((len(texts), 4), np.int64), [hashlib.sha256() for _ in texts]
    todo = [(k, p) for k, text in enumerate(texts) if text for p in t.parts(text)]
    counted: list[pa.Table] = []
    lo = 0
    while lo < len(todo):  # as many parts at a time as fit in a slice
        hi, held = lo + 1, len(todo[lo][1])
        while hi < len(todo) and held + len(todo[hi][1]) <= SLICE:
            held += len(todo[hi][1])
            hi += 1
        which = np.array([k for k, _ in todo[lo:hi]])
        fine, sizes, printed, links = align_parts(t, [p for _, p in todo[lo:hi]])
        np.logical_and.at(ok, which, fine)
        np.add.at(size, which, sizes)
        for j, (k, text) in enumerate(zip(which.tolist(), printed, strict=True)):
            if j + lo and todo[j + lo - 1][0] == k:
                digest[k].update(b";")
            digest[k].update(text)
        links = links.set_column(0, "text", pa.array(which).take(links["part"].combine_chunks()))
        counted.append(links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]))
        lo = hi
    if not counted:
        return size, [""] * len(texts), pa.table({"text": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    ok &= np.array([bool(x) for x in texts], bool)
    links = pa.concat_tables(counted).group_by(["text", "pair"], use_threads=False).aggregate([("count_all", "sum")]) \
        .rename_columns(["text", "pair", "times"])
    links = links.filter(pa.array(ok).take(links["text"].combine_chunks())).sort_by([("text", "ascending"), ("pair", "ascending")])
    size[~ok] = 0
    return size, [d.hexdigest() if fine else "" for d, fine in zip(digest, ok, strict=True)], links


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------

def aligned(docs: DataFrame, models: tuple[str, bytes]) -> DataFrame:
    """DOC_SCHEMA: kind 0, one row per document with its pairs; kind 1, partial document counts of pairs."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def lists(table: pa.Table, cuts: np.ndarray) -> list[pa.Array]:
        at = pa.array(cuts.astype(np.int32))
        return [pa.ListArray.from_arrays(at, table[c].combine_chunks()) for c in ("pair", "times")]

    def counts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            table = table.rename_columns(["pair", "times"]).combine_chunks()
            cuts = np.append(np.arange(0, table.num_rows, 1 << 16), table.num_rows)
            n = len(cuts) - 1
            zero = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), zero, zero, zero, zero, zero, zero, pa.array([""] * n),
                                              *lists(table, cuts)], names=[c.split()[0] for c in DOC_SCHEMA.split(", ")])

    def merged(partial: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(partial).group_by("pair", use_threads=False).aggregate([("count_all", "sum")]) \
            .rename_columns(["pair", "count_all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(sent.value)
        row = TaskContext.get().partitionId() << 40
        partial: list[pa.Table] = []
        for big in batches:
            for batch in slices(big, "_text", SLICE):
                size, digest, links = align_texts(t, batch.column("_text").to_pylist())
                n = batch.num_rows
                cuts = np.searchsorted(links["text"].to_numpy(), np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_id"),
                     *[pa.array(np.ascontiguousarray(c)) for c in size.T], pa.array(digest), *lists(links, cuts)],
                    names=[c.split()[0] for c in DOC_SCHEMA.split(", ")])
                row += n
                partial.append(links.group_by("pair", use_threads=False).aggregate([([], "count_all")]))
                if sum(p.num_rows for p in partial) > HELD:
                    partial = [merged(partial)]
                    if partial[0].num_rows > HELD // 2:
                        yield from counts(partial.pop())
        if partial:
            yield from counts(merged(partial))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, DOC_SCHEMA)


def with_head(rows: DataFrame, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """row, n_best, count_sum over the head's pairs, and the other pairs of every row."""
    sent = rows.sparkSession.sparkContext.broadcast((keys, counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            lists, n = batch.column("pairs"), batch.num_rows
            pair = pc.list_flatten(lists).to_numpy()
            times = pc.list_flatten(batch.column("times")).to_numpy()
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            for out, value in zip(sums, (best, counts), strict=True):
                np.add.at(out, row[hit], times[hit] * value[at[hit]])
            cuts = pa.array(np.searchsorted(row[~hit], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(s) for s in sums],
                 *[pa.ListArray.from_arrays(cuts, pa.array(v[~hit])) for v in (pair, times)]],
                names=["row", "n_best", "count_sum", "pairs", "times"])

    return rows.select("row", "pairs", "times").mapInArrow(
        run, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")


def align_documents(docs: DataFrame, models: tuple[str, bytes]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sizes, the groups' digest, ``n_best`` and ``count_sum``."""
    spark = docs.sparkSession
    path = new_folder(spark, "crosstok-aligned")
    aligned(docs, models).write.partitionBy("kind").parquet(path)
    done = spark.read.schema(DOC_SCHEMA).parquet(path)
    partial = done.where("kind = 1").select(F.inline(F.arrays_zip("pairs", "times")))
    counts = materialize(partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "crosstok-counts")
    side_a = F.shiftright("pair", SHIFT)
    most = counts.groupBy(side_a.alias("a")).agg(F.max("n").alias("most"))  # at most one row per id of A
    counts = counts.join(F.broadcast(most), side_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    counts = materialize(counts, "crosstok-best")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_head = F.col("n") * HEAD > F.lit(total)
    head = counts.where(is_head).toArrow().sort_by("pair")  # fewer than HEAD rows
    rows = done.where("kind = 0").drop("kind")
    summed = materialize(with_head(rows, *[head[c].to_numpy() for c in ("pair", "n", "best")]), "crosstok-head")
    rest = summed.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair") \
        .join(counts.where(~is_head), "pair").groupBy("row") \
        .agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(summed.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), read_models(spark))
