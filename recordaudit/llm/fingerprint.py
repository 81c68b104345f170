"""Document fingerprints by consistent weighted sampling.  Native DataFrame operations only.

A text is a weighted set: its white-space separated words, lower-cased, each weighted by
its count.  For sample k every word draws, from hashes of (word, k) alone, r and c from
Gamma(2, 1) and b uniform; with weight w

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

and the sample is the (word, t) with the least a.  Two texts agree in a sample with
probability equal to their generalised Jaccard similarity, sum of min / sum of max of the
weights; the likeness of two fingerprints is the share of samples that agree.

Words are counted inside the row (the runs of its sorted words), so no word is shuffled: the texts are dealt once, by blocks of doc_id, which the
window for the next document needs anyway, and the SAMPLES minima per text are one
aggregate over fixed-width buffers on the same partitioning.  The block bounds are
quantiles of doc_id, written into the plan as literals.  The last document of a block
takes the next block's first one from a table of one row per block.

Defined cases: a null text counts as empty; texts without a word share one sentinel word, so
they are alike (1) and unlike any other (0); null doc_ids come first; rows with equal doc_id
are ordered by a hash of their text; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLES = 32
DIGITS = 8  # hex digits of a sample


def with_blocks(docs: DataFrame, key: str, blocks: int) -> DataFrame:
    """``docs`` with ``_block``: the number of bounds (quantiles of ``key``) below the key."""
    fractions = [i / blocks for i in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx(key, fractions, 20 * blocks).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return docs.withColumn("_block", F.lit(0))
    lits = F.array(*[F.lit(b) for b in bounds])
    return docs.withColumn("_block", F.coalesce(F.size(F.filter(lits, lambda b: b < F.col(key))), F.lit(0)))


def word_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``_word``, ``_n``: one row per distinct word of a text (a text without words: one
    empty word).  The runs of the sorted words are found inside the row."""
    sorted_words = texts.select(*keys, F.sort_array(F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), "")).alias("_words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_words") - 1),
                      lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    begun = sorted_words.select(*keys, "_words", F.when(F.size("_words") > 0, starts).alias("_starts"))
    runs = F.transform("_starts", lambda b, j: F.struct(
        F.get("_words", b).alias("w"), (F.coalesce(F.get("_starts", j + 1), F.size("_words")) - b).alias("n")))
    empty = F.array(F.struct(F.lit("").alias("w"), F.lit(1).alias("n")))
    return begun.select(*keys, F.inline(F.coalesce(runs, empty)).alias("_word", "_n"))


def sample(term: Column, ln_w: Column, k: int) -> Column:
    """Sample k of one word as a long: ln a in the high bits, the (word, t) tag in the low 32."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))

    def uniform(h: Column, shift: int, bits: int) -> Column:
        part = F.shiftrightunsigned(h, shift) if shift else h
        return (part.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -bits)

    r = -F.log(uniform(x, 0, 32) * uniform(x, 32, 32))
    ln_c = F.log(-F.log(uniform(y, 0, 24) * uniform(y, 24, 24)))
    b = uniform(y, 48, 16)
    t = F.floor(ln_w / r + b)
    ln_a = ln_c - r * (t - b + F.lit(1.0))
    tag = F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF))
    # 30 bits of ln a in steps of 2**-20, order kept; ties go to the smaller tag
    return F.shiftleft(((ln_a + F.lit(500.0)) * F.lit(float(1 << 20))).cast("long"), 32).bitwiseOR(tag)


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` plus ``fp``, the samples of each key's text as hex digits.  One row per key, grouped on
    the partitioning that ``texts`` has if its keys are among ``keys``."""
    terms = word_counts(texts, keys, text).select(
        *keys, F.xxhash64("_word").alias("_h"), F.log(F.col("_n").cast("double")).alias("_lw"))
    minima = terms.groupBy(*keys).agg(*[F.min(sample(F.col("_h"), F.col("_lw"), k)).alias(f"_s{k}") for k in range(samples)])
    parts = [F.lpad(F.lower(F.hex(F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)))), DIGITS, "0") for k in range(samples)]
    return minima.select(*keys, F.concat(*parts).alias("fp"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [F.when(F.substring(a, k * DIGITS + 1, DIGITS) == F.substring(b, k * DIGITS + 1, DIGITS), 1).otherwise(0)
            for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def with_next(rows: DataFrame, value: str, name: str, order: list[str], heads: DataFrame) -> DataFrame:
    """Add ``name``: ``value`` of the next row in (block, order), from ``heads`` (_block, _head) at a block's end."""
    w = Window.partitionBy("_block").orderBy(*order)
    # the window's partitioning serves the join; the planner broadcasts the heads only below its own size bound
    return rows.withColumn("_lead", F.lead(F.struct(F.col(value).alias("v"))).over(w)) \
        .join(heads, "_block", "left") \
        .withColumn(name, F.when(F.col("_lead").isNull(), F.col("_head")).otherwise(F.col("_lead.v"))).drop("_lead", "_head")


def next_heads(firsts: DataFrame, value: str) -> DataFrame:
    """(_block, _head): the ``value`` of the first row of the following block that has rows (the last: the
    first).  One row per block."""
    rows = sorted((r["_block"], i) for i, r in enumerate(firsts.select("_block").distinct().collect()))
    order = [b for b, _ in rows]
    if not order:
        return firsts.select("_block", F.col(value).alias("_head"))
    before = {order[(i + 1) % len(order)]: b for i, b in enumerate(order)}
    pairs = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])
    return firsts.select(pairs[F.col("_block")].alias("_block"), F.col(value).alias("_head"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_blocks(rows, "doc_id", blocks).withColumn("_order", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_order")
    firsts = materialize(rows.groupBy("_block").agg(F.min_by("text", order).alias("text")), "fingerprint-heads")
    w = Window.partitionBy("_block").orderBy("doc_id", "_order")
    numbered = with_next(rows.withColumn("_rn", F.row_number().over(w)), "text", "_next", ["doc_id", "_order"], next_heads(firsts, "text"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = numbered.withColumns({"n_chars": n.cast("long"), "_edited": F.concat(
        F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))}) \
        .withColumn("edited_sha256", F.sha2(F.encode("_edited", "UTF-8"), 256))
    keys = ["_block", "_rn", "doc_id", "n_chars", "edited_sha256"]
    sides = edited.select(*keys, F.posexplode(F.array("text", "_edited")).alias("_side", "_body"))
    both = fingerprints(sides, [*keys, "_side"], "_body", samples)
    pairs = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.col("fp"))).alias("fingerprint"),
                                    F.max(F.when(F.col("_side") == 1, F.col("fp"))).alias("edited_fingerprint"))
    done = materialize(pairs, "fingerprint-rows")
    heads = next_heads(done.where("_rn = 1").select("_block", "fingerprint"), "fingerprint")
    out = with_next(done, "fingerprint", "_next_fp", ["_rn"], heads)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
                      likeness("fingerprint", "_next_fp", samples).alias("near_next"))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
