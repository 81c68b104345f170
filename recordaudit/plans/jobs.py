"""Composite jobs: the end-to-end audits a user runs, built from the operators.

Each job is a plan over one DataFrame of all models / files; nothing loops over files or
groups on the driver.  Some jobs run small Spark jobs while the plan is built: range
bounds for numbering, pivot values, and the written answers of a completion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.age import clean_age_v1, clean_age_v2, digits_only, first_number, numeric_coerce, range_mask, to_int
from ..functions.gender import clean_gender, gender_rule_matched
from ..functions.text import text_length
from ..operators import align, contingency, coverage, generate, ledger, profile, reshape


# C1 / C2 -------------------------------------------------------------------
def coverage_summary(df: DataFrame, model: str = "model_name",
                     pairs: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    return coverage.coverage_counts(df, model, pairs)


KEY_METRICS = ["Model"] + [f"{lang}: {c}" for lang in ("English", "Chinese")
                           for c in ("Both", "Only age with Both", "Only gender with Both", "Neither")] + [
    f"{lang}_LMS_{r}_Ratio" for lang in ("English", "Chinese") for r in ("Both", "Both_Age", "Both_Sex")]


def coverage_report(summary: DataFrame, total: int | None = coverage.DEFAULT_SAMPLE_SIZE,
                    key_metrics_only: bool = False) -> DataFrame:
    out = coverage.coverage_ratios(summary, total)
    if key_metrics_only:
        out = out.select(*[F.col(f"`{c}`") for c in KEY_METRICS if c in out.columns])
    return out


# C3 ------------------------------------------------------------------------
def location_report(df: DataFrame, gazetteer: DataFrame, home, model: str = "model_name",
                    position: str | None = None, **kw) -> tuple[DataFrame, DataFrame | None]:
    summary = coverage.location_summary(df, gazetteer, home, model=model, **kw)
    detail = coverage.out_of_home_rows(df, gazetteer, home, position, model=model) if position else None
    return summary, detail


# C4 / C5 -------------------------------------------------------------------
def _keys(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def age_profile(df: DataFrame, columns: Sequence[str] = ("Age", "Age_Chinese"), group: str | Sequence[str] = "disease",
                coerce: bool = True, label_style: str = "upper", denominator: str = "all",
                wide: bool = False) -> DataFrame:
    """Banded age distribution per group for each age column (one aggregate).

    ``group``: one key or several, e.g. ``["model_name", "disease"]`` or ``["file_name", "disease"]``
    for a table per model or file; the wide form spreads the last key over columns."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    values = {c: (numeric_coerce(F.col(c)) if coerce and c in text else F.col(c)) for c in columns}
    long = profile.binned_distribution(df, values, by=_keys(group), label_style=label_style, denominator=denominator)
    if not wide:
        return long
    return reshape.pivot_report(long, [*_keys(group)[:-1], "column", "band_idx", "band"], _keys(group)[-1])


def gender_profile(df: DataFrame, columns: Sequence[str] = ("Sex", "Sex_Chinese"), group: str | Sequence[str] = "disease",
                   domain: Sequence[str] = tuple(profile.GENDER_DOMAIN), wide: bool = False) -> DataFrame:
    """Female/Male/Unknown distribution per group (one key or several) for each gender column."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("_value"))
                      for c in columns])
    keys = _keys(group)
    long_in = df.select(*[F.col(k) for k in keys], F.inline(items))
    long = profile.category_distribution(long_in, "_value", by=["column", *keys], domain=domain)
    if not wide:
        return long
    return reshape.pivot_report(long, [*keys[:-1], "column", "category_idx", "category"], keys[-1])


# C6 / C7 / C8 --------------------------------------------------------------
def clean_ages(df: DataFrame, columns: Sequence[str] = ("Age", "Age_Chinese"), version: str = "v2") -> DataFrame:
    """Replace each present age column in place with its cleaned integer."""
    present = [c for c in columns if c in df.columns]
    fn: Callable[[Column], Column] = clean_age_v2 if version == "v2" else (lambda c: to_int(clean_age_v1(c)))
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in present})


def clean_ages_legacy(df: DataFrame, zh: str = "Age_Chinese", en: str = "Age") -> DataFrame:
    """The older chain: digits-only + range mask on the Chinese column, first
    number on the English column, then both to integer."""
    cols = {}
    if zh in df.columns:
        cols[zh] = to_int(range_mask(digits_only(F.col(zh))))
    if en in df.columns:
        cols[en] = to_int(first_number(F.col(en)))
    return df.withColumns(cols)


def clean_genders(df: DataFrame, columns: Sequence[str] = ("Sex", "Sex_Chinese"), rules: str = "merged") -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_gender(F.col(f"`{c}`"), rules) for c in present})


def gender_cleaning_reports(df: DataFrame, column: str, rules: str = "merged",
                            by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Before/after table and audit of a gender column, per ``by`` keys (model, file ...)."""
    cleaned = clean_gender(F.col(column), rules)
    return (profile.cleaning_before_after(df, column, cleaned, by=by),
            profile.cleaning_audit(df, column, cleaned, gender_rule_matched(F.col(column), rules), by=by))


# C10 -----------------------------------------------------------------------
def add_lengths(df: DataFrame, columns: Iterable[str] = ("English_a", "Chinese_a"),
                null_length: int | None = 3) -> DataFrame:
    return df.withColumns({f"{c}_length": text_length(F.col(c), null_length) for c in columns})


def token_report(df: DataFrame, columns: Sequence[str] = ("English_a_tokens", "Chinese_a_tokens"),
                 model: str = "model_name") -> DataFrame:
    return contingency.token_summary(df, columns, model)


# C13 / C14 -----------------------------------------------------------------
def complete(grid: DataFrame, fn, constants: Mapping[str, object] | None = None,
             number_by: Sequence[str] = (), number_order: Sequence[str] = ("prompt_id", "run"),
             number_name: str = "seq", resume: str | None = None, keys: Sequence[str] = ("run",), **kw) -> DataFrame:
    """Batch completion, constant columns, then 1-based numbering per output group.

    With ``resume`` (a ledger folder) requests that the ledger holds are not asked again; ``keys`` make
    requests with one prompt different."""
    if resume is not None:
        out = ledger.complete_with_ledger(grid, fn, resume, keys=keys, **kw)
    else:
        out = generate.batch_complete(grid, fn, **kw)
    if constants:
        out = generate.stamp(out, constants)
    return align.number_rows(out, list(number_order), list(number_by), name=number_name)


PAIRED_ORDER = ["index", "English", "English_a", "Chinese", "Chinese_a", "model_name", "disease"]


def pair_languages(en: DataFrame, zh: DataFrame, how: str = "key",
                   on: Sequence[str] = ("model_name", "disease", "prompt_id", "run"),
                   order_by: Sequence[str] = (), join: str = "inner",
                   columns_order: Sequence[str] = tuple(PAIRED_ORDER)) -> DataFrame:
    """Bilingual table: keyed (default) or positional pairing, 0-based ``index``,
    then the fixed column order restricted to the columns available."""
    paired = align.pair(en, zh, how=how, on=on, order_by=order_by, join=join, position="_pos", coalesce=("model_name", "disease"))
    if how == "position":
        paired = paired.withColumn("index", F.col("_pos") - 1).drop("_pos")
    else:
        paired = align.number_rows(paired, list(on), name="index", start=0)
    ordered = [c for c in columns_order if c in paired.columns]
    rest = [c for c in paired.columns if c not in ordered]
    return paired.select(*[F.col(f"`{c}`") for c in ordered + rest])


# C15 -----------------------------------------------------------------------
def value_audit(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lo: float = 0,
                hi: float = 120) -> dict[str, DataFrame]:
    """Frequency, distinct values and invalid values of several columns in long form."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in columns])
    long = df.select(*by, F.inline(items))
    keys = [*by, "column"]
    return {
        "frequency": profile.value_frequency(long, "value", keys),
        "distinct": profile.distinct_values(long, "value", keys),
        "invalid": profile.invalid_values(long, "value", lo, hi, keys, text=True),
        "invalid_ratio": profile.invalid_ratio(long, "value", lo, hi, keys, text=True),
    }
