"""Language identification by a byte convolutional network.

The text's UTF-8 bytes (A-Z folded) are cut into fixed windows; a window passes an
embedding of bytes, filters of widths 2, 3 and 4, a ReLU, max pooling over the
window and a softmax.  Training (numpy, Adam) runs on the driver on a bounded
sample: ``per_lang`` documents of every language, the smallest by a hash of
doc_id, one window each from a hashed place in the text.  Prediction covers every
byte of every text, a batch of windows at a time; a document's probabilities are
the mean over its windows weighted by their letter bytes.

For prediction the filters are folded into tables over single bytes and byte
pairs, so a position costs three row gathers instead of a matrix product.

Defined cases: a null text, or one without letters, gets ``und`` with score 0.  A
null ``lang`` is never learnt from.  With no labelled text at all every document
gets ``und``.  A null ``doc_id`` is not held out.  Repeated rows get equal results,
ties between languages go to the first in order of name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, slices, string_bytes, table

WINDOW = 512
WIDTHS = (2, 3, 4)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, np.int32)
LETTER[97:123] = 1
LETTER[128:] = 1
SEPARATE = 0.25  # of the training windows, a quarter is also shown cut short


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW folded bytes, zero-padded; first window of each row and the end)."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // WINDOW)))])
    out = np.zeros((int(first[-1]), WINDOW), np.uint8)
    flat = out.reshape(-1)
    for i, n in enumerate(size):
        at = int(first[i]) * WINDOW
        flat[at:at + n] = data[offsets[i]:offsets[i + 1]]
    return FOLD[out], first


def init(classes: int, dim: int, filters: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"embed": rng.normal(0, 0.5, (256, dim)), "out": rng.normal(0, 0.1, (filters * len(WIDTHS), classes)),
         "out_b": np.zeros(classes)}
    for k in WIDTHS:
        w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * dim), (k, dim, filters))
        w[f"bias{k}"] = np.zeros(filters)
    return {k: v.astype(np.float32) for k, v in w.items()}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of a batch; only the pooled positions pass a gradient back."""
    n = len(x)
    emb = w["embed"][x]  # n, WINDOW, dim
    pooled, where = [], []
    for k in WIDTHS:
        span = WINDOW - k + 1
        a = sum(emb[:, j:j + span] @ w[f"conv{k}"][j] for j in range(k)) + w[f"bias{k}"]
        at = a.argmax(axis=1)  # n, filters
        where.append(at)
        pooled.append(np.take_along_axis(a, at[:, None, :], 1)[:, 0])
    h_raw = np.concatenate(pooled, 1)
    h = np.maximum(h_raw, 0)
    p = softmax(h @ w["out"] + w["out_b"])
    loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
    d = p.copy()
    d[np.arange(n), y] -= 1
    d /= n
    g = {"out": h.T @ d, "out_b": d.sum(0), "embed": np.zeros_like(w["embed"])}
    dh = (d @ w["out"].T) * (h_raw > 0)
    f = w["bias2"].shape[0]
    rows = np.arange(n)[:, None]
    for i, k in enumerate(WIDTHS):
        dk = dh[:, i * f:(i + 1) * f]  # n, filters
        g[f"bias{k}"] = dk.sum(0)
        g[f"conv{k}"] = np.zeros_like(w[f"conv{k}"])
        for j in range(k):
            sym = x[rows, where[i] + j]  # n, filters
            g[f"conv{k}"][j] = np.einsum("nfd,nf->df", w["embed"][sym], dk)
            np.add.at(g["embed"], sym, dk[:, :, None] * w[f"conv{k}"][j].T[None])
    return loss, g


def train(x: np.ndarray, y: np.ndarray, classes: int, dim: int = 8, filters: int = 8, epochs: int = 10,
          batch: int = 64, rate: float = 4e-3, seed: int = 1) -> dict[str, np.ndarray]:
    """Adam on windows ``x`` (n x WINDOW bytes) and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    w = init(classes, dim, filters, rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(a) for k, a in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            idx = order[lo:lo + batch]
            xb = x[idx]
            short = rng.random(len(idx)) < SEPARATE  # short texts must work, too
            if short.any():
                xb = xb.copy()
                for r in np.flatnonzero(short):
                    xb[r, int(rng.integers(16, WINDOW)):] = 0
            _, g = gradients(w, xb, y[idx])
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w


class Network:
    """The trained network with its filters folded into byte and byte-pair tables."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w
        one = {k: [w["embed"] @ w[f"conv{k}"][j] for j in range(k)] for k in WIDTHS}  # 256 x filters

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        self.f = w["bias2"].shape[0]
        self.head = np.ascontiguousarray(np.concatenate([pair(*one[2]), pair(*one[3][:2]), pair(*one[4][:2])], 1))
        self.tail3 = np.ascontiguousarray(one[3][2])
        self.tail4 = pair(*one[4][2:])
        self.bias = np.concatenate([w[f"bias{k}"] for k in WIDTHS])

    def probabilities(self, x: np.ndarray, chunk: int = 32) -> np.ndarray:
        out = np.empty((len(x), len(self.w["out_b"])), np.float32)
        f = self.f
        for lo in range(0, len(x), chunk):
            b = x[lo:lo + chunk]
            pairs = b[:, :-1].astype(np.intp) * 256 + b[:, 1:]
            a = self.head[pairs]  # n, WINDOW - 1, 3 filters
            a3 = a[:, :-1, f:2 * f]
            a3 += self.tail3[b[:, 2:]]
            a4 = a[:, :-2, 2 * f:]
            a4 += self.tail4[pairs[:, 2:]]
            pooled = np.concatenate([a[:, :, :f].max(axis=1), a3.max(axis=1), a4.max(axis=1)], 1) + self.bias
            out[lo:lo + chunk] = softmax(np.maximum(pooled, 0) @ self.w["out"] + self.w["out_b"])
        return out


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def training_windows(docs: DataFrame, per_lang: int = 700) -> list:
    """At most ``per_lang`` different (lang, hash, piece) rows per language, those of the smallest hashes of id and text.

    Languages are counted first; only rows below a share of the hash range that holds about
    4 ``per_lang`` rows of their language are looked at, more where too few of them have letters, so what
    is gathered does not grow with the input and most texts are only hashed."""
    h = F.xxhash64("doc_id", "text", F.lit(11))
    size = F.char_length("text")
    piece = F.substring("text", (F.pmod(F.col("h"), F.greatest(size - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    base = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    factor, kept = 4, {}
    while sizes:
        share = F.lit(1.0)
        for lang, n in sizes.items():
            share = F.when(F.col("lang") == F.lit(lang), F.lit(min(factor * per_lang / n, 1.0))).otherwise(share)
        below = base.select("lang", "text", h.alias("h")).where(F.col("h").cast("double") / 2.0 ** 64 + 0.5 <= share)
        rows = below.where(F.col("text").rlike(r"\p{L}")).select("lang", "h", piece.alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
        kept = {lang: [] for lang in sizes}
        for r in rows.distinct().collect():  # factor x per_lang x languages rows, more or less
            kept[r["lang"]].append((r["lang"], r["h"], r["piece"]))
        if all(len(kept[lang]) >= per_lang or factor * per_lang >= n for lang, n in sizes.items()):
            break
        factor *= 8
    return sorted(x for rows in kept.values() for x in sorted(rows)[:per_lang])


def fit(docs: DataFrame, per_lang: int = 700) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, weights), learnt from ``lang`` and ``text`` of the documents that are not held out."""
    rows = training_windows(docs, per_lang)
    if not rows:
        return [], None
    langs = sorted({r[0] for r in rows})
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, _, piece) in enumerate(rows):
        raw = np.frombuffer(piece.encode()[:WINDOW], np.uint8)
        x[i, :len(raw)] = raw
    y = np.array([langs.index(r[0]) for r in rows])
    return langs, train(FOLD[x], y, len(langs))


def predict(docs: DataFrame, model: tuple[list[str], dict | None], columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (must not clash) plus ``lang_pred`` and ``score``, for every row."""
    langs, weights = model
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if weights is None:
        return rows.select(*columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        names = np.array(langs, dtype=object)
        for big in batches:
            for batch in slices(big, "_text", 2 << 20):
                data, off = string_bytes(batch.column("_text"))
                x, first = windows(data, off)
                p = net.probabilities(x)
                weight = LETTER[x].sum(axis=1).astype(np.float64)
                total = np.add.reduceat(weight, first[:-1])
                mean = np.add.reduceat(p * weight[:, None], first[:-1], axis=0) / np.maximum(total, 1)[:, None]
                best = mean.argmax(axis=1)
                known = batch.column("_letters").to_numpy(zero_copy_only=False) & (total > 0)
                score = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                pred = np.where(known, names[best], "und")
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in columns], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*columns, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@plain_names
def stage_language(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Pipeline stage: documents without a recognised language go."""
    out = predict(docs, fit(docs), docs.columns)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*docs.columns)
