"""Labels by substring against a table of aliases, of any size.

A text takes the label of an alias that occurs in it.  Every alias is blocked by one of its
n-grams, the one that the fewest aliases have; a text meets only the aliases whose n-gram it
contains (an equi-join), and only those are looked for in it.  Distinct texts are labelled once and
the labels joined back, so a text that a third of the rows share costs one row.

Which alias wins: the smallest ``order`` where a column of that name is given (the first rule of
a list), then the longest alias, then the first by text.  Letters match in any case.  Defined
cases: null and empty aliases match nothing; one alias with several labels takes the first of
them; a text without a match, or null, has a null label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # characters; shorter aliases are blocked by themselves


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def blocked_aliases(aliases: DataFrame, alias: str = "alias", label: str = "label", order: str | None = None) -> DataFrame:
    """alias (lower case), label, order, gram, size: one row per alias with its blocking n-gram."""
    rank = F.col(order).cast("double") if order else F.lit(0.0)
    rows = aliases.select(F.lower(F.col(alias)).alias("alias"), F.col(label).cast("string").alias("label"), rank.alias("order")) \
        .where("alias <> ''").groupBy("alias").agg(F.min(F.struct("order", "label")).alias("first")) \
        .select("alias", "first.label", "first.order", F.least(F.char_length("alias"), F.lit(GRAM)).alias("size"))
    grams = _grams(F.col("alias"), GRAM)
    for n in range(GRAM - 1, 0, -1):
        grams = F.when(F.col("size") == n, _grams(F.col("alias"), n)).otherwise(grams)
    each = rows.select("alias", F.explode(grams).alias("gram"))
    count = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(count, "gram").groupBy("alias").agg(F.min(F.struct("n", "gram")).alias("least"))
    return rows.join(rarest.select("alias", "least.gram"), "alias")


def label_by_aliases(df: DataFrame, column: str, aliases: DataFrame, alias: str = "alias", label: str = "label",
                     order: str | None = None, name: str = "label") -> DataFrame:
    """``df`` with the label of the winning alias in ``column`` as ``name``."""
    table = blocked_aliases(aliases, alias, label, order)
    texts = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("string").alias("_text")).distinct() \
        .select("_text", F.sha2(F.encode("_text", "UTF-8"), 256).alias("_id"), F.lower("_text").alias("_low"))
    sizes = F.array(*[F.struct(F.lit(n).alias("size"), _grams(F.col("_low"), n).alias("grams")) for n in range(1, GRAM + 1)])
    found = texts.select("_id", F.inline(sizes)).select("_id", "size", F.explode("grams").alias("gram")) \
        .join(table.select("alias", "label", "order", "size", "gram"), ["size", "gram"]).drop("size", "gram")
    best = texts.select("_id", "_text", "_low").join(found, "_id").where(F.col("_low").contains(F.col("alias"))) \
        .groupBy("_text").agg(F.min(F.struct("order", (-F.char_length("alias")).alias("short"), "alias", "label")).alias("_best")) \
        .select("_text", F.col("_best.label").alias("_label"))
    out = df.join(best, F.col(f"`{column}`").cast("string") == F.col("_text"), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return out.select(*kept, F.col("_label").alias(name))
