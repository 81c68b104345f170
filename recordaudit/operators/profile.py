"""Distributions and value audits (DataFrame -> DataFrame).

Plan shape used throughout: one ``groupBy`` whose aggregate holds one
conditional count per domain value (20 age bands, 3 genders ...).  Spark runs
it as partial + final hash aggregate, so each map task ships at most one row
per group however skewed the groups are; the domain rows are then produced by
``inline`` of a fixed-size array.  Zero-filled bands therefore need no domain
table, no join and no cross product.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.age import is_invalid
from ..functions.text import count_pct_cell, round_half_even
from ..session import freeze

# The reference's banding is 20 right-closed bands of 5 years.
BAND_WIDTH, BAND_LOW, BAND_HIGH = 5, 0, 100
GENDER_DOMAIN = ["Female", "Male", "Unknown"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pct(n: Column, total: Column) -> Column:
    return F.try_divide(n.cast("double"), total.cast("double")) * F.lit(100.0)


# ---------------------------------------------------------------------------
# Banding
# ---------------------------------------------------------------------------
def band_index(c: Column | str, width: float = BAND_WIDTH, low: float = BAND_LOW,
               high: float = BAND_HIGH) -> Column:
    """0-based index of the right-closed band (low, low+w], ..., lowest edge included.

    Outside ``[low, high]`` or null -> null.  (Spark's Bucketizer and
    ``width_bucket`` are left-closed, so they are not used.)
    """
    x = _c(c).cast("double")
    return (
        F.when(x.between(low, low + width), F.lit(0))
        .when((x > low + width) & (x <= high), (F.ceil((x - F.lit(low)) / F.lit(width)) - 1).cast("int"))
    )


def band_labels(width: int = BAND_WIDTH, low: int = BAND_LOW, high: int = BAND_HIGH,
                style: str = "upper") -> list[str]:
    """``upper``: '1-5', '6-10', ... ; ``lower``: '0-4', '5-9', ... (same bands)."""
    starts = range(low, high, width)
    if style == "upper":
        return [f"{s + 1}-{s + width}" for s in starts]
    if style == "lower":
        return [f"{s}-{s + width - 1}" for s in starts]
    raise ValueError(f"unknown label style {style!r}")


def _keys_not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond) if keys else df


def binned_distribution(df: DataFrame, values: str | Mapping[str, Column | str], by: Sequence[str] = (),
                        width: int = BAND_WIDTH, low: int = BAND_LOW, high: int = BAND_HIGH,
                        label_style: str = "upper", denominator: str = "all") -> DataFrame:
    """Count and share of rows per band, per group, every band present.

    ``values`` is one column name or ``{name: column}`` for several columns
    profiled in the same single aggregate.  Share denominator: all rows of
    the group (``'all'``) or rows with a numeric value (``'non_null'``).
    Null group keys are dropped (pandas ``groupby`` default).
    Returns ``by..., [column], band_idx, band, n, pct, cell``.
    """
    multi = not isinstance(values, str)
    cols = dict(values) if multi else {values: values}
    keys = list(by)
    # Rows are counted per (group, column, band) -- partial aggregation, a few small rows per group
    # and task -- and only the counted rows are spread over the full domain.
    pairs = []
    for j, col in enumerate(cols.values()):
        x = _c(col).cast("double")
        pairs.append(F.struct(F.lit(j).alias("_col"), band_index(x, width, low, high).alias("_band"), x.isNotNull().alias("_num")))
    src = _keys_not_null(df, keys).select(*[F.col(k) for k in keys], F.inline(F.array(*pairs)))
    counted = src.groupBy(*keys, "_col", "_band", "_num").agg(F.count(F.lit(1)).alias("_n"))
    return band_report(counted, keys, list(cols) if multi else None, band_labels(width, low, high, label_style), denominator)


def band_report(counted: DataFrame, keys: Sequence[str], names: Sequence[str] | None, labels: Sequence[str],
                denominator: str = "all") -> DataFrame:
    """The report of :func:`binned_distribution` from counts ``keys..., _col, _band, _num, _n``, which may
    come in parts: counts of one group, column and band are added up."""
    counted = counted.groupBy(*keys, "_col", "_band").agg(
        F.sum("_n").alias("_n"), F.sum(F.when(F.col("_num"), F.col("_n")).otherwise(0)).alias("_nums"))
    total = F.sum("_n") if denominator == "all" else F.sum("_nums")
    per = counted.groupBy(*keys, "_col").agg(
        total.alias("_total"), F.map_from_entries(F.collect_list(F.when(F.col("_band").isNotNull(), F.struct("_band", "_n")))).alias("_m"))
    bands = F.array(*[F.struct(F.lit(i).alias("band_idx"), F.lit(label).alias("band")) for i, label in enumerate(labels)])
    shown = [F.get(F.array(*[F.lit(n) for n in names]), F.col("_col")).alias("column")] if names else []
    long = per.select(*keys, *shown, "_total", "_m", F.inline(bands)) \
        .withColumn("n", F.coalesce(F.try_element_at("_m", F.col("band_idx")), F.lit(0)).cast("bigint"))
    pct = _pct(F.col("n"), F.col("_total"))
    return long.select(*keys, *(["column"] if names else []), "band_idx", "band", "n",
                       round_half_even(pct, 2).alias("pct"), count_pct_cell(F.col("n"), pct).alias("cell"))


def category_distribution(df: DataFrame, value: Column | str, by: Sequence[str] = (),
                          domain: Sequence[str] = tuple(GENDER_DOMAIN)) -> DataFrame:
    """Count and share per category of a fixed domain, per group, zero-filled.

    The denominator is every row of the group, including null and off-domain
    values.  Returns ``by..., category_idx, category, n, pct, cell``.
    """
    keys = list(by)
    src = _keys_not_null(df, keys).select(*[F.col(k) for k in keys], _c(value).alias("_v"))
    v = F.col("_v")
    aggs = [F.count(F.lit(1)).alias("_total"), *[F.count_if(v == F.lit(d)).alias(f"_n{i}") for i, d in enumerate(domain)]]
    return category_report(src.groupBy(*keys).agg(*aggs), keys, domain)


def category_report(counted: DataFrame, keys: Sequence[str], domain: Sequence[str]) -> DataFrame:
    """The report of :func:`category_distribution` from one row per group: ``_total`` and ``_n0, _n1, ...``."""
    items = [F.struct(F.lit(i).alias("category_idx"), F.lit(d).alias("category"), F.col(f"_n{i}").alias("n")) for i, d in enumerate(domain)]
    long = counted.select(*keys, "_total", F.inline(F.array(*items)))
    pct = _pct(F.col("n"), F.col("_total"))
    return long.select(*keys, "category_idx", "category", "n",
                       round_half_even(pct, 2).alias("pct"), count_pct_cell(F.col("n"), pct).alias("cell"))


def reindex_counts(counts: DataFrame, category: str, domain: Sequence[str], n: str = "n",
                   by: Sequence[str] = ()) -> DataFrame:
    """Zero-fill already counted categories to a fixed domain (no join)."""
    keys = list(by)
    aggs = [F.coalesce(F.sum(F.when(F.col(category) == F.lit(d), F.col(n))), F.lit(0)).cast("bigint").alias(f"_n{i}")
            for i, d in enumerate(domain)]
    items = [F.struct(F.lit(i).alias("category_idx"), F.lit(d).alias(category), F.col(f"_n{i}").alias(n))
             for i, d in enumerate(domain)]
    return counts.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*items)))


# ---------------------------------------------------------------------------
# Frequencies and distinct values
# ---------------------------------------------------------------------------
def value_frequency(df: DataFrame, value: str, by: Sequence[str] = (), dropna: bool = False,
                    sort: bool = True) -> DataFrame:
    """Count and share of each value (nulls as a value unless ``dropna``).

    The share denominator is a scalar subquery without groups, else the
    per-group totals of the counted table (a small aggregate AQE can broadcast);
    no ``OVER ()`` window pulls the distinct values into one task.
    Returns ``by..., value, n, pct``.
    """
    keys = list(by)
    src = _keys_not_null(df, keys)
    if dropna:
        src = src.filter(F.col(value).isNotNull())
    # the counted table is materialized once; totals come from it, not from a second scan
    counts = freeze(src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
        counts = counts.join(totals, keys)
    else:
        counts = counts.withColumn("_total", counts.select(F.sum("n")).scalar())
    out = counts.select(*keys, value, "n", round_half_even(_pct(F.col("n"), F.col("_total")), 2).alias("pct"))
    return out.orderBy(*keys, F.desc("n"), F.asc_nulls_first(value)) if sort else out


def distinct_values(df: DataFrame, value: str, by: Sequence[str] = (), sort: bool = False) -> DataFrame:
    """Distinct values (null kept as a value), optionally sorted."""
    out = df.select(*by, value).distinct()
    return out.orderBy(*by, F.asc_nulls_first(value)) if sort else out


def top_k_distinct(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """First ``k`` of the sorted distinct non-null values (a top-k report)."""
    return df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(value).limit(k)


def valid_ratio(df: DataFrame, columns: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-null count / row count in percent (0 when empty), one row per column."""
    cols = list(columns)
    keys = list(by)
    aggs = [F.count(F.lit(1)).alias("_total")] + [F.count(c).alias(f"_v{i}") for i, c in enumerate(cols)]
    items = [F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("valid")) for i, c in enumerate(cols)]
    long = df.groupBy(*keys).agg(*aggs).select(*keys, "_total", F.inline(F.array(*items)))
    pct = F.coalesce(_pct(F.col("valid"), F.col("_total")), F.lit(0.0))
    return long.select(*keys, "column", "valid", F.col("_total").alias("total"),
                       round_half_even(pct, 2).alias("valid_pct"))


def invalid_values(df: DataFrame, value: str, lo: float = 0, hi: float = 120, by: Sequence[str] = (),
                   text: bool = False) -> DataFrame:
    """Distinct values that are not a number inside ``[lo, hi]`` (null included), with counts."""
    bad = df.filter(is_invalid(F.col(value), lo, hi, text=text))
    return bad.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def invalid_ratio(df: DataFrame, value: str, lo: float = 0, hi: float = 120, by: Sequence[str] = (),
                  text: bool = False) -> DataFrame:
    """Invalid rows / all rows per group."""
    bad = is_invalid(F.col(value), lo, hi, text=text)
    agg = df.groupBy(*by).agg(F.count_if(bad).alias("invalid"), F.count(F.lit(1)).alias("total"))
    return agg.withColumn("invalid_pct", round_half_even(_pct(F.col("invalid"), F.col("total")), 2))


# ---------------------------------------------------------------------------
# Cleaning reports
# ---------------------------------------------------------------------------
def cleaning_before_after(df: DataFrame, raw: str, cleaned: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distribution of raw values (nulls kept) and of cleaned values (nulls dropped).

    One scan: the records are aggregated once by ``(raw, cleaned)``, that
    (small) aggregate is materialized, and both stages and their totals are
    derived from it.  Returns ``by..., stage, value, n, pct``.
    """
    keys = list(by)
    pairs = freeze(df.groupBy(*keys, F.col(raw).cast("string").alias("_raw"), cleaned.cast("string").alias("_clean"))
                   .agg(F.count(F.lit(1)).alias("_n")))
    before = pairs.groupBy(*keys, F.col("_raw").alias("value")).agg(F.sum("_n").alias("n"))
    after = pairs.where(F.col("_clean").isNotNull()) \
        .groupBy(*keys, F.col("_clean").alias("value")).agg(F.sum("_n").alias("n"))
    out = []
    for stage, part in (("before", before), ("after", after)):
        if keys:
            totals = part.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
            cond = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]  # a null key is a group, too
            part = part.join(totals, cond)
        else:
            part = part.withColumn("_total", part.select(F.sum("n")).scalar())
        out.append(part.select(*keys, F.lit(stage).alias("stage"), "value", F.col("n").cast("bigint").alias("n"),
                               round_half_even(_pct(F.col("n"), F.col("_total")), 2).alias("pct")))
    return out[0].unionByName(out[1])


def cleaning_audit(df: DataFrame, raw: str, cleaned: Column, matched: Column | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Each distinct non-null raw value (per ``by`` keys) with its cleaned value, count and rule hit."""
    cols = [*[F.col(k) for k in by], F.col(raw).alias("raw"), cleaned.alias("cleaned")]
    if matched is not None:
        cols.append(matched.alias("matched"))
    return df.where(F.col(raw).isNotNull()).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
