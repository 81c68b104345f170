"""Field coverage, coverage ratios and gazetteer matching per model.

Everything is one scan of the records and one ``groupBy(model)`` of
conditional counts (partial aggregation on the map side, so a model holding a
third of all rows costs nothing extra).  Gazetteer membership is an
existence flag from a left join to the *distinct* cleaned names, broadcast
only after a size check.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.age import age_present
from ..functions.gender import gender_present
from ..functions.text import fixed2, round_half_even, strip_admin_suffix

# The four coverage cases and the report's language pairs.
BOTH, ONLY_AGE, ONLY_GENDER, NEITHER = (
    "Both age and gender", "Only age", "Only gender", "Neither age nor gender")
CASE_COLUMNS = [("Both", BOTH), ("Only age", ONLY_AGE), ("Only gender", ONLY_GENDER), ("Neither", NEITHER)]
DEFAULT_PAIRS = {"English": ("Age", "Sex"), "Chinese": ("Age_Chinese", "Sex_Chinese")}
# The ratio job divides by a fixed sample size per model.
DEFAULT_SAMPLE_SIZE = 3000
LOCATION_LEVELS = ("Province", "City", "District")


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def coverage_case(age: Column, sex: Column) -> Column:
    """Both / Only age / Only gender / Neither for one (age, gender) pair."""
    a, s = age_present(age), gender_present(sex)
    return (F.when(a & s, F.lit(BOTH)).when(a, F.lit(ONLY_AGE))
            .when(s, F.lit(ONLY_GENDER)).otherwise(F.lit(NEITHER)))


def coverage_counts(df: DataFrame, model: str = "model_name",
                    pairs: Mapping[str, tuple[str, str]] | None = None, total: str | None = None) -> DataFrame:
    """Per model, how many rows carry age and gender, per language pair.

    Columns ``Model, <label>: Both, <label>: Only age, <label>: Only gender,
    <label>: Neither`` for every label; a missing column counts as all null.
    ``total`` names an extra row-count column from the same aggregate.
    """
    pairs = dict(pairs or DEFAULT_PAIRS)
    # one projected case per row and language, then plain comparisons in the aggregate
    cases = [coverage_case(_col_or_null(df, age), _col_or_null(df, sex)).alias(f"_case{i}")
             for i, (age, sex) in enumerate(pairs.values())]
    src = df.select(F.col(model).alias("Model"), *cases)
    aggs = [F.count(F.lit(1)).alias(total)] if total else []
    for i, label in enumerate(pairs):
        for short, full in CASE_COLUMNS:
            aggs.append(F.count_if(F.col(f"_case{i}") == F.lit(full)).alias(f"{label}: {short}"))
    out = src.groupBy("Model").agg(*aggs)
    return out.orderBy("Model")


def coverage_ratios(summary: DataFrame, total: int | None = DEFAULT_SAMPLE_SIZE,
                    labels: Iterable[str] = ("English", "Chinese")) -> DataFrame:
    """Shares of rows with age (incl. both), gender (incl. both) and both.

    ``total`` is the fixed sample size of the reference (3000); ``None``
    divides by the model's own row count.  Adds ``*_Formatted`` text copies
    (2 decimals) of every ``Ratio``/``Accuracy`` column.
    """
    out = summary
    for lab in labels:
        both, age, sex, neither = (F.col(f"`{lab}: {c}`") for c in ("Both", "Only age", "Only gender", "Neither"))
        denom = F.lit(float(total)) if total is not None else (both + age + sex + neither).cast("double")
        out = out.withColumns({
            f"{lab}: Only age with Both": age + both,
            f"{lab}: Only gender with Both": sex + both,
        })
        out = out.withColumns({
            f"{lab}_LMS_Both_Ratio": F.try_divide(both.cast("double"), denom),
            f"{lab}_LMS_Both_Age_Ratio": F.try_divide((age + both).cast("double"), denom),
            f"{lab}_LMS_Both_Sex_Ratio": F.try_divide((sex + both).cast("double"), denom),
        })
    return with_formatted(out)


def with_formatted(df: DataFrame, markers: Iterable[str] = ("Accuracy", "Ratio")) -> DataFrame:
    """Text copy ``<col>_Formatted`` (2 decimals) of every column whose name has a marker."""
    marks = list(markers)
    targets = [c for c in df.columns if any(m in c for m in marks) and not c.endswith("_Formatted")]
    return df.withColumns({f"{c}_Formatted": fixed2(F.col(f"`{c}`")) for c in targets})


def location_accuracy(summary: DataFrame, total: int = DEFAULT_SAMPLE_SIZE,
                      labels: Iterable[str] = ("English", "Chinese")) -> DataFrame:
    """``<label>_<Level>_Accuracy`` = correct / total * 100; an absent column counts 0."""
    cols = {}
    for lab in labels:
        for level in LOCATION_LEVELS:
            src = f"{lab}: {level} Correct"
            correct = F.col(f"`{src}`") if src in summary.columns else F.lit(0)
            cols[f"{lab}_{level}_Accuracy"] = F.try_divide(F.coalesce(correct, F.lit(0)).cast("double"),
                                                           F.lit(float(total))) * 100.0
    return summary.withColumns(cols)


def percentage_columns(df: DataFrame, total: str = "Total_Samples", keep: Sequence[str] = ("Model",)) -> DataFrame:
    """``<col>_Percentage`` = col / total * 100, 2 decimals, for every other column."""
    skip = set(keep) | {total}
    cols = {f"{c}_Percentage": round_half_even(F.try_divide(F.col(f"`{c}`").cast("double"), F.col(total)) * 100.0, 2)
            for c in df.columns if c not in skip}
    return df.withColumns(cols)


# ---------------------------------------------------------------------------
# Gazetteer matching
# ---------------------------------------------------------------------------
def _name_set(gazetteer: DataFrame, column: str) -> DataFrame:
    return (gazetteer.select(strip_admin_suffix(F.col(column)).alias("_name"))
            .where(F.col(column).isNotNull()).distinct())


def _flag(df: DataFrame, key: Column, names: DataFrame, flag: str) -> DataFrame:
    """Existence flag: left join to a distinct name set (no fan-out); the planner's byte
    threshold and AQE pick the join.  Rows without a key get a key of their own each, so
    they do not meet in one task of a shuffle join."""
    keyed = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))))
    right = names.select(F.col("_name").alias("_key"), F.lit(True).alias(flag))
    return keyed.join(right, "_key", "left").drop("_key") \
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def location_flags(df: DataFrame, gazetteer: DataFrame, home: DataFrame | Sequence[str] | None = None,
                   places: Mapping[str, str] | None = None, levels: Mapping[str, str] | None = None) -> DataFrame:
    """Row-level flags: cleaned province/city/district found in the gazetteer, and
    district found but not in the home list.

    ``places`` maps level -> record column (default ``Province_Chinese`` ...);
    ``levels`` maps level -> gazetteer column (default 省 / 地级市 / 县区).
    Adds ``_m_province, _m_city, _m_district, _district_clean, _out_of_home``.
    """
    places = dict(places or {"Province": "Province_Chinese", "City": "City_Chinese", "District": "District_Chinese"})
    levels = dict(levels or {"Province": "省", "City": "地级市", "District": "县区"})
    out = df
    for level in LOCATION_LEVELS:
        col = _col_or_null(df, places[level])
        out = _flag(out, strip_admin_suffix(col), _name_set(gazetteer, levels[level]), f"_m_{level.lower()}")
    district = _col_or_null(df, places["District"])
    out = out.withColumn("_district_clean", F.when(district.isNotNull(), strip_admin_suffix(district)))
    if home is None:
        in_home = F.lit(False)
    elif isinstance(home, DataFrame):
        home_names = home.select(strip_admin_suffix(F.col(home.columns[0])).alias("_name")).distinct()
        out = _flag(out, F.col("_district_clean"), home_names, "_home")
        in_home = F.col("_home")
    else:  # both forms of the home list are cleaned like the districts
        in_home = F.col("_district_clean").isin([strip_admin_suffix(F.lit(h)) for h in home])
    out = out.withColumn("_out_of_home", F.col("_district_clean").isNotNull() & ~in_home & F.col("_m_district"))
    return out.drop("_home") if "_home" in out.columns else out


def location_summary(df: DataFrame, gazetteer: DataFrame, home: DataFrame | Sequence[str] | None = None,
                     model: str = "model_name", label: str = "Chinese", address: str = "Address_Chinese",
                     places: Mapping[str, str] | None = None, levels: Mapping[str, str] | None = None,
                     percentages: bool = True) -> DataFrame:
    """Per model: rows, presence of address/province/city/district, gazetteer
    matches per level, and districts outside the home list.

    Rows are first counted per (model, places); the joins see each combination of places once."""
    places = dict(places or {"Province": "Province_Chinese", "City": "City_Chinese", "District": "District_Chinese"})
    names = {lv: f"_p{i}" for i, lv in enumerate(LOCATION_LEVELS)}
    counted = df.groupBy(F.col(model).alias("Model"), *[_col_or_null(df, places[lv]).alias(c) for lv, c in names.items()]) \
        .agg(F.count(F.lit(1)).alias("_n"), F.count(_col_or_null(df, address)).alias("_a"))
    flagged = location_flags(counted, gazetteer, home, names, levels)

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("_n")).otherwise(0))

    aggs = [F.sum("_n").alias("Total_Samples"), F.sum("_a").alias(f"{label}_Address")]
    aggs += [total(F.col(names[lv]).isNotNull()).alias(f"{label}_{lv}") for lv in LOCATION_LEVELS]
    aggs += [total(F.col(f"_m_{lv.lower()}")).alias(f"Matched_{lv}") for lv in LOCATION_LEVELS]
    aggs.append(total(F.col("_out_of_home")).alias("Out_Of_Home_Districts"))
    out = flagged.groupBy("Model").agg(*aggs)
    return percentage_columns(out) if percentages else out


def out_of_home_rows(df: DataFrame, gazetteer: DataFrame, home: DataFrame | Sequence[str] | None,
                     position: str, model: str | None = None, places: Mapping[str, str] | None = None,
                     levels: Mapping[str, str] | None = None, index_base: int = 1) -> DataFrame:
    """Detail listing of rows whose district is known but outside the home list.

    ``position`` is a stored 0-based row position; ``Index`` = position + ``index_base``.
    """
    flagged = location_flags(df, gazetteer, home, places, levels)
    cols = ([F.col(model).alias("Model")] if model else []) + [
        (F.col(position) + F.lit(index_base)).alias("Index"), F.col("_district_clean").alias("District")]
    return flagged.where(F.col("_out_of_home")).select(*cols)
