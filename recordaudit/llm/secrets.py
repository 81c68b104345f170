"""Secret scan with a random forest against false positives.  Native DataFrame
operations and Spark ML only.

1. Candidates: runs of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/_=.-]`` that
   are not plain words, found by one anchored pattern per text; with start, and the
   text to the left and right.  A run is cut after ``NAME=`` and around a known format
   inside it, and its closing full stops are left out, so the value stands alone.
   Besides, whatever stands directly after a key word with assignment or quotes is a
   candidate, of any length and with any signs (in quotes also with blanks); runs within
   it are not reported apart.
2. Features: length, character transitions (between classes of characters, and between
   vowels and consonants among letters), shares of digits and capitals, variety,
   dictionary coverage, path signs, neighbouring key words, assignment and quotes.  The
   dictionary holds the most frequent words of all documents, counted by a sketch that is
   merged map-side (``approx_top_k``), so no word list is shuffled.
3. Labelled findings: candidates that a format decides (key formats with a fixed prefix,
   or a quoted value assigned to a key word: secret; numbers, addresses, words, UUIDs,
   placeholders: no secret), plus a few built-in examples of both kinds, so a corpus
   without secrets can be scanned, too.  At most ``SAMPLE`` of each label are learnt from,
   the smallest by a hash.  Own labelled findings can be passed instead.
4. A random forest judges every candidate; those with probability >= 0.5 are findings.

Defined cases: null and empty texts have no candidates; offsets count code points from
0; repeated rows are each reported; a secret that occurs twice in a text is two findings.
The secret itself is returned as its SHA-256.  The redaction replaces findings where they
are, and every other occurrence of those with at least ``MIN_LENGTH`` characters (a short
one may be part of a common word).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain_names, smallest_by_hash, table
from .neardup import small

MIN_LENGTH = 16
CONTEXT = 40
SAMPLE = 3000
DICTIONARY = 300
CHARS = r"[A-Za-z0-9+/_=.\-]"
MASK = "[SECRET]"
FEATURES = ["length", "switches", "alternation", "digits", "capitals", "variety", "coverage", "path", "key_word",
            "assigned", "quoted"]
#: Formats with a fixed prefix.
KNOWN = (r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk-[A-Za-z0-9_\-]{20,}$|^xox[abprs]-[A-Za-z0-9\-]{10,}$"
         r"|^AIza[A-Za-z0-9_\-]{35}$|^eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-.]{16,}$")
#: The same inside a run, bounded by signs.
KNOWN_INSIDE = r"(?<![A-Za-z0-9])(" + KNOWN.replace("^", "").replace("$", "") + r")(?![A-Za-z0-9])"
KEY_NAME = r"(?=[tspakbc])(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api_?key|access_?key|private_?key|auth|bearer|credential|key)(?:_[A-Za-z0-9]+)*"
KEY_WORD = rf"(?i){KEY_NAME}[\"' ]*\s*[:=]?\s*[\"']?$"
#: A value (group 1) directly after a key word: quoted, or assigned and up to a blank, quote or separator ("&" after "=" only).
NAMED = (rf"(?i:{KEY_NAME})(?:[\"']?[ \t]{{0,8}}[:=][ \t]{{0,8}}[\"']?|[ \t]{{1,8}}[\"'])"
         r"((?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=:[ \t]{0,8}[\"']?)[^\s\"'=,;<>()\[\]{}][^\s\"',;<>()\[\]{}]*"
         r"|[^\s\"'=,;&<>()\[\]{}][^\s\"',;&<>()\[\]{}]*)")
ASSIGNED = r"[:=]\s*[\"']?$"
#: No secret: numbers and dates, addresses, plain or hyphenated words, UUIDs, placeholders.
HARMLESS = (r"^[0-9.\-+/]+$|^[A-Za-z0-9_.\-]+\.(com|org|net|html?|php|pdf|jpg|png)$|^[A-Za-z]+([.\-_/=+][A-Za-z]*)*$"
            r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|(?i)example|xxxx|placeholder|(.)\1{7}")


def candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` plus candidate, start, before, after: one row per candidate.

    Patterns cut a text into parts that follow each other and end with a run or a value, so offsets are
    running sums and contexts come from the neighbouring parts: the work grows with the text, however
    many candidates it has."""
    # values after key words: the text is cut at key names first (a cheap pattern), every part begins with one
    texts = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text")) \
        .withColumn("_has", F.regexp_count("_text", F.lit(NAMED)) > 0) \
        .where(F.col("_has") | F.col("_text").rlike(rf"{CHARS}{{{MIN_LENGTH}}}")).withColumn("_row", F.monotonically_increasing_id())
    texts = materialize(texts, "secret-texts")  # the row numbers are written with the rows
    keep = [*columns, "_row", "_has"]

    found = texts.withColumn("_parts", F.regexp_extract_all("_text", F.lit(rf"\G(?s:.*?)(?<!{CHARS}){CHARS}{{{MIN_LENGTH},}}"), F.lit(0)))
    rows = parts_of(found.where(F.size("_parts") > 0), keep, 3).withColumn("_run", F.regexp_extract("part", rf"{CHARS}+$", 0))
    gap = F.substr("part", F.lit(1), F.char_length("part") - F.char_length("_run"))
    rows = rows.select(*keep, "_run", (F.col("end") - F.char_length("_run")).alias("_at"), "right", F.right(F.concat("left", gap), F.lit(CONTEXT)).alias("left"))
    # cut after names and around known formats; the pieces follow each other, too
    cut = F.regexp_replace(F.regexp_replace("_run", KNOWN_INSIDE, "\0$1\0"), r"(=+)(?=\x00?[.]*[^=.\x00])", "\0$1\0")
    rows = rows.withColumn("_parts", F.split(cut, r"\x00")).withColumnsRenamed({"left": "_left", "right": "_right"}).withColumn("_text", F.col("_run"))
    rows = parts_of(rows, [*keep, "_at", "_left", "_right"], CONTEXT)
    rows = rows.withColumn("candidate", F.regexp_replace("part", "[.]+$", "")).where(F.char_length("candidate") >= MIN_LENGTH) \
        .where(~F.col("candidate").rlike(r"^[A-Za-z]?[a-z]+[.\-]*$")) \
        .select(*keep, "candidate", (F.col("_at") + F.col("end") - F.char_length("part")).cast("long").alias("start"),
                F.right(F.concat("_left", "left"), F.lit(CONTEXT)).alias("before"),
                F.left(F.concat(F.regexp_extract("part", "[.]+$", 0), "right", "_right"), F.lit(CONTEXT)).alias("after"))

    named = texts.where("_has")
    named = named.withColumn("_parts", F.regexp_extract_all("_text", F.lit(rf"\G(?s:.*?){NAMED}"), F.lit(0))) \
        .withColumn("_values", F.regexp_extract_all("_text", F.lit(rf"\G(?s:.*?){NAMED}"), F.lit(1)))
    values = parts_of(named, [*keep, "_values"], 12).withColumn("_value", F.get("_values", F.col("place")))
    values = values.withColumn("candidate", F.regexp_replace("_value", "[.]+$", "")).where("candidate <> ''").select(
        *keep, "candidate", (F.col("end") - F.char_length("_value")).cast("long").alias("start"),
        F.right(F.concat("left", F.substr("part", F.lit(1), F.char_length("part") - F.char_length("_value"))), F.lit(CONTEXT)).alias("before"),
        F.left(F.concat(F.regexp_extract("_value", "[.]+$", 0), "right"), F.lit(CONTEXT)).alias("after"))

    # runs that begin within a value are not reported apart: per text, the furthest end of the values so far
    both = rows.where("_has").withColumn("_is", F.lit(False)).unionByName(values.withColumn("_is", F.lit(True)))
    so_far = Window.partitionBy("_row").orderBy("start", F.col("_is").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.max(F.when(F.col("_is"), F.col("start") + F.char_length("candidate"))).over(so_far)
    both = both.withColumn("_far", ends).where(F.col("_is") | F.col("_far").isNull() | (F.col("_far") <= F.col("start")))
    out = [*columns, "candidate", "start", "before", "after"]
    return rows.where("not _has").select(*out).unionByName(both.select(*out))


def parts_of(rows: DataFrame, keep: list[str], reach: int) -> DataFrame:
    """``keep`` plus place, part, end, left, right: the ``_parts`` of ``_text``, which follow each other from its
    start; left and right are CONTEXT characters (all, where there are fewer) around a part, taken from the
    ``reach`` parts on either side and the rest of the text."""
    step = 256  # running sums in two levels: an array never grows element by element beyond this
    rows = rows.withColumn("_sizes", F.transform("_parts", lambda p: F.char_length(p)))
    rows = rows.withColumn("_blocks", F.sequence(F.lit(0), F.greatest(F.floor((F.size("_sizes") - 1) / step), F.lit(0)).cast("int")))
    block = lambda b: F.slice("_sizes", b * step + 1, F.lit(step))
    grow = lambda acc, n: F.struct((acc["end"] + n).alias("end"), F.concat(acc["ends"], F.array(acc["end"] + n)).alias("ends"))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("_sums", F.transform("_blocks", lambda b: F.aggregate(block(b), F.lit(0), lambda x, n: x + n)))
    rows = rows.withColumn("_heads", F.aggregate("_sums", F.struct(F.lit(0).alias("end"), none.alias("ends")), grow)["ends"])
    rows = rows.withColumn("_ends", F.flatten(F.transform("_blocks", lambda b: F.aggregate(
        block(b), F.struct((F.get("_heads", b) - F.get("_sums", b)).alias("end"), none.alias("ends")), grow)["ends"])))
    rest = F.substr("_text", F.coalesce(F.element_at("_ends", -1), F.lit(0)) + 1)
    rows = rows.withColumn("_all", F.concat("_parts", F.array(F.left(rest, F.lit(CONTEXT)))))

    def around(p: Column, i: Column) -> Column:
        left = F.transform(F.slice("_all", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), lambda x: F.right(x, F.lit(CONTEXT)))
        right = F.transform(F.slice("_all", i + 2, F.lit(reach)), lambda x: F.left(x, F.lit(CONTEXT)))
        return F.struct(i.alias("place"), p.alias("part"), F.get("_ends", i).alias("end"),
                        F.right(F.array_join(left, ""), F.lit(CONTEXT)).alias("left"), F.left(F.array_join(right, ""), F.lit(CONTEXT)).alias("right"))

    return rows.select(*keep, F.inline(F.transform("_parts", around)))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more in all documents."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where(F.char_length("w") >= 3)
    top = words.agg(F.expr(f"approx_top_k(w, {size}, {size * 20})").alias("t")).first()["t"]
    return [r[0] for r in top or []]


def share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.char_length("candidate")


def features(found: DataFrame, words: list[str]) -> DataFrame:
    size = F.char_length("candidate")
    kinds = F.translate(F.regexp_replace("candidate", "[^A-Za-z0-9]", "-"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-",
                        "U" * 26 + "l" * 26 + "d" * 10 + "s")
    switch = F.regexp_count(kinds, F.lit("(?=Ul|Ud|Us|lU|ld|ls|dU|dl|ds|sU|sl|sd)"))
    vowels = F.translate(F.lower("candidate"), "aeiouybcdfghjklmnpqrstvwxz", "v" * 6 + "c" * 20)
    alternate = F.regexp_count(vowels, F.lit("(?=vc|cv)"))
    covered = F.lit(0.0)
    if words:
        pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
        covered = (size - F.char_length(F.regexp_replace(F.lower("candidate"), pattern, ""))) / size
    return found.withColumns({
        "length": size.cast("double"), "switches": switch / size, "alternation": alternate / size,
        "digits": share("[0-9]"), "capitals": share("[A-Z]"),
        "variety": F.size(F.array_distinct(F.split("candidate", ""))) / size, "coverage": covered,
        "path": (F.regexp_count("candidate", F.lit("[/.]")) + F.col("before").rlike(r"(://|www\.|[/@])\S*$").cast("int")).cast("double"),
        "key_word": F.col("before").rlike(KEY_WORD).cast("double"),
        "assigned": F.col("before").rlike(ASSIGNED).cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double")})


def format_label() -> Column:
    """1 or 0 where a format decides, else null."""
    named = F.col("before").rlike(KEY_WORD) & F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']") \
        & F.col("candidate").rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=\-]{20,}$")
    phrase = F.col("before").rlike(KEY_WORD) & F.col("candidate").rlike(f"^[A-Za-z]{{{MIN_LENGTH},}}$")  # the forest judges it
    return F.when(F.col("candidate").rlike(HARMLESS) & ~phrase, 0.0).when(F.col("candidate").rlike(KNOWN) | named, 1.0)


def examples(spark) -> DataFrame:
    """Built-in labelled findings, derived from hashes and a few frames by rule."""
    frames = [{"b": b, "a": a, "y": y} for b, a, y in (
        ("token = \"", "\"", 1), ("api_key: '", "'", 1), ("password=", " ", 1), ("see ", " and", 0), ("https://host/", " ", 0))]
    n = spark.range(40).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"),
                               F.explode(F.from_json(F.lit(json.dumps(frames)), "array<struct<b string, a string, y int>>")).alias("f"))
    secret = F.when(F.col("id") % 2 == 0, F.substring("h", 1, 40)).otherwise(F.substring(F.base64(F.unhex("h")), 1, 32))
    plain = F.when(F.col("id") % 2 == 0, F.translate(F.substring("h", 1, 16), "abcdef", "012345")) \
        .otherwise(F.concat(F.translate(F.substring("h", 1, 18), "0123456789", "aeioutnrsl"), F.lit(".html")))
    long = n.select(F.when(F.col("f.y") == 1, secret).otherwise(plain).alias("candidate"), F.col("f.b").alias("before"),
                    F.col("f.a").alias("after"), F.col("f.y").cast("double").alias("label"))
    return long.unionAll(short_examples(spark))


def short_examples(spark) -> DataFrame:
    """Values after a key word: passwords of 8 to 15 characters with signs and long passphrases; plain words and numbers."""
    frames = [{"b": b, "a": a} for b, a in (("password = \"", "\""), ("pwd: ", " "), ("secret='", "'"), ("key=", "&"))]
    n = spark.range(40).select("id", F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 256).alias("h"),
                               F.explode(F.from_json(F.lit(json.dumps(frames)), "array<struct<b string, a string>>")).alias("f"))
    size = (F.col("id") % 8).cast("int")
    letters = F.translate("h", "0123456789abcdef", "aeioutnrslaeiodm")
    password = F.concat(F.upper(F.substring(letters, 1, 1)), F.substr(letters, F.lit(2), size + 3), F.substring("h", 20, 3),
                        F.element_at(F.array(*[F.lit(c) for c in "!#$%@*?^"]), size + 1), (F.col("id") % 10).cast("string"))
    phrase = F.substr(letters, F.lit(1), size + 16)
    word = F.substr(letters, F.lit(30), size + 2)
    number = F.substr(F.translate("h", "abcdef", "012345"), F.lit(1), size % 4 + 1)
    kinds = F.array(*[F.struct(c.alias("c"), F.lit(y).alias("y")) for c, y in ((password, 1.0), (phrase, 1.0), (word, 0.0), (number, 0.0))])
    return n.select(F.explode(kinds).alias("k"), "f").select(F.col("k.c").alias("candidate"), F.col("f.b").alias("before"),
                                                             F.col("f.a").alias("after"), F.col("k.y").alias("label"))


def fit(found: DataFrame, words: list[str], labelled: DataFrame | None = None, trees: int = 24, depth: int = 6):
    """The forest, learnt from a bounded sample of labelled findings (candidate, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled is None:
        known = found.withColumn("label", format_label()).where("label is not null").select("candidate", "before", "after", "label")
        picked = smallest_by_hash(known, "label", F.xxhash64("candidate", "before", "after"), SAMPLE, ["candidate", "before", "after"])
        labelled = examples(found.sparkSession).unionByName(picked)
    rows = materialize(features(labelled, words).select("label", *FEATURES), "secret-sample")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.orderBy("label", *FEATURES).coalesce(1))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol="label", featuresCol="features")
    return forest.fit(rows)


def judge(found: DataFrame, words: list[str], model) -> DataFrame:
    """``found`` plus probability of being a secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(features(found, words))
    model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_y")
    out = model.transform(rows)
    return out.withColumn("probability", vector_to_array("_p")[1]).drop("_features", "_p", "_raw", "_y", *FEATURES)


def scan(docs: DataFrame, columns: list[str], threshold: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Findings: ``columns``, start, candidate, probability."""
    found = materialize(candidates(docs, columns), "secret-candidates")  # one pass over the texts
    words = dictionary(docs)
    return judge(found, words, fit(found, words, labelled)).where(F.col("probability") >= threshold)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"),
                        F.sha2(F.encode("candidate", "UTF-8"), 256).alias("secret_sha256"), F.round("probability", 6).alias("probability"))


def hidden(text: str, spans: str, width: int = 4096) -> Column:
    """``text`` with the (at, size) ``spans`` (last first) masked: pieces of ``width`` characters, each rebuilt for
    the spans in it only; the mask stands where a span begins."""

    def masked(piece: Column, i: Column) -> Column:
        base = i * width
        here = F.filter(spans, lambda x: (x["at"] < base + width) & (x["at"] + x["size"] > base))
        return F.aggregate(here, piece, lambda t, x: F.concat(
            F.substr(t, F.lit(1), F.greatest(x["at"] - base, F.lit(0))), F.when(x["at"] >= base, F.lit(MASK)).otherwise(F.lit("")),
            F.substr(t, F.greatest(x["at"] + x["size"] - base, F.lit(0)) + 1)))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), masked), "")


@plain_names
def stage_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every finding is masked in its text (and n_chars follows); all documents stay."""
    key = F.xxhash64("text")
    found = scan(docs.withColumn("_key", key), ["doc_id", "_key"])
    spans = F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("at"), F.char_length("candidate").alias("size"))), asc=False)
    everywhere = F.when(F.char_length("candidate") >= MIN_LENGTH, F.col("candidate"))
    masks = found.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set(everywhere), asc=False).alias("_secrets"), spans.alias("_spans"))
    masks = materialize(masks, "secret-masks").withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    rows = docs.withColumn("_key", key).join(small(masks, 200), (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(
        F.aggregate("_secrets", hidden("text", "_spans"), lambda t, s: F.replace(t, s, F.lit(MASK))))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*docs.columns)
