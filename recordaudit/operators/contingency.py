"""Gender contingency tables, the 2x2 chi-square against real counts, and
length/token summaries per model.

Counts flow straight from records: one scan, one aggregate holding a female
and a male conditional count per language, then ``inline`` to one row per
(model, language, group).  The "real" table is a handful of rows per group,
joined on the group key (AQE broadcasts it at runtime when it is small).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import CHI2_1_CRITICAL_05, chi2_pvalue_dof1, chi_square_2x2, is_degenerate, significant
from ..functions.text import cell_count, fixed2, label_by_substring, param_size, sci4
from .aliases import label_by_aliases

REAL_BLOCKS = 8
DEFAULT_GENDER_COLUMNS = {"English": "Sex", "Chinese": "Sex_Chinese"}


def gender_counts(df: DataFrame, model: str = "model_name", group: str = "disease",
                  columns: Mapping[str, Column | str] | None = None,
                  female: str = "Female", male: str = "Male") -> DataFrame:
    """Female and male counts per (model, language, group) from cleaned gender columns.

    Returns ``model, language, <group>, female, male, total``.
    """
    cols = dict(columns or DEFAULT_GENDER_COLUMNS)
    proj = [(F.col(c) if isinstance(c, str) else c).alias(f"_g{i}") for i, c in enumerate(cols.values())]
    src = df.where(F.col(group).isNotNull()).select(F.col(model).alias("model"), F.col(group), *proj)
    aggs, items = [F.count(F.lit(1)).alias("_total")], []
    for i, lang in enumerate(cols):
        v = F.col(f"_g{i}")
        aggs += [F.count_if(v == F.lit(female)).alias(f"_f{i}"), F.count_if(v == F.lit(male)).alias(f"_m{i}")]
        items.append(F.struct(F.lit(lang).alias("language"), F.col(f"_f{i}").alias("female"),
                              F.col(f"_m{i}").alias("male")))
    agg = src.groupBy("model", F.col(group)).agg(*aggs)
    return agg.select("model", group, "_total", F.inline(F.array(*items))) \
        .select("model", "language", group, "female", "male", F.col("_total").alias("total"))


def attach_real(counts: DataFrame, real: DataFrame, group: str = "disease", real_group: str = "disease",
                aliases: DataFrame | None = None, real_female: str = "female", real_male: str = "male",
                alias_rules: Mapping[str, Sequence[str]] | None = None, alias_contains: bool = False) -> DataFrame:
    """Real-world counts beside the model's, optionally through an alias table
    (``aliases``: columns ``alias``, ``<real_group>``; e.g. 'Type 1 diabetes' -> 'T1DM'; with
    ``alias_contains`` an alias need only occur in the group's name, see ``aliases.label_by_aliases``)
    or substring rules (``{'T1DM': ['type 1', 't1dm']}``).

    The frame is every real group x (model, language) plus the model's groups without a
    partner: a group that the model never produced has counts 0, one without real counts has
    null real counts (``chi_square_table`` calls it ``missing``)."""
    r = real.select(F.col(real_group).alias("_rg"), F.col(real_female).cast("bigint").alias("real_female"),
                    F.col(real_male).cast("bigint").alias("real_male"))
    c = counts
    if alias_rules:
        c = c.withColumn("_rg", label_by_substring(F.col(group), dict(alias_rules)))
    elif aliases is not None and alias_contains:
        order = "order" if "order" in aliases.columns else None
        c = label_by_aliases(c, group, aliases, label=real_group, order=order, name="_rg").withColumn("_rg", F.coalesce("_rg", F.col(group)))
    elif aliases is not None:
        a = aliases.select(F.col("alias").alias("_alias"), F.col(real_group).alias("_ag"))
        c = c.join(a, c[group] == a["_alias"], "left") \
            .withColumn("_rg", F.coalesce(F.col("_ag"), F.col(group))).drop("_alias", "_ag")
    else:
        c = c.withColumn("_rg", F.col(group))
    # every (model, language) meets every real group, as an equi-join on hashed blocks
    heads = c.select("model", "language").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(REAL_BLOCKS - 1))))
    frame = heads.join(r.withColumn("_block", F.pmod(F.hash("_rg"), F.lit(REAL_BLOCKS))), "_block").drop("_block")
    keys = ["model", "language", "_rg"]
    values = [x for x in c.columns if x not in (*keys, group)]
    out = frame.withColumnRenamed("_rg", "_fg").alias("f").join(
        c.alias("c"), (F.col("f.model").eqNullSafe(F.col("c.model"))) & (F.col("f.language") == F.col("c.language"))
        & (F.col("f._fg") == F.col("c._rg")), "full_outer")
    filled = [F.coalesce(F.col(f"c.{x}"), F.lit(0)).alias(x) if x in ("female", "male", "total") else F.col(f"c.{x}").alias(x)
              for x in values]
    return out.select(F.coalesce("c.model", "f.model").alias("model"), F.coalesce("c.language", "f.language").alias("language"),
                      F.coalesce(f"c.{group}", "f._fg").alias(group), *filled, "f.real_female", "f.real_male")


def chi_square_table(table: DataFrame, a: str = "real_female", b: str = "real_male",
                     c: str = "female", d: str = "male", with_p: bool = True, digits: int = 6,
                     alpha: float = 0.05, expected: bool = False) -> DataFrame:
    """Add ``chi2, dof, status`` (and ``p_value, p_text, significant``) to each row;
    ``expected`` adds the four expected counts (``expected_<column>``).

    Rows with a zero margin get ``status='degenerate'``, rows with a null count
    ``'missing'``, both with null statistics; the other rows are unaffected (the reference
    stops the whole file there).  ``significant`` compares with ``alpha`` (0.05: on the
    statistic itself; any other level needs ``with_p``).
    """
    A, B, C, D = (F.col(x) for x in (a, b, c, d))
    out = table.withColumn("_chi2", chi_square_2x2(A, B, C, D))
    chi2 = F.col("_chi2")
    out = out.withColumns({
        "chi2": F.rint(chi2 * F.lit(10.0**digits)) / F.lit(10.0**digits),
        "dof": F.lit(1),
        "status": F.when(A.isNull() | B.isNull() | C.isNull() | D.isNull(), F.lit("missing"))
        .when(is_degenerate(A, B, C, D), F.lit("degenerate")).otherwise(F.lit("ok")),
        # p < 0.05 for one degree of freedom, decided natively on the statistic
        "significant": chi2 > F.lit(CHI2_1_CRITICAL_05),
    })
    if with_p:
        out = out.withColumn("p_value", F.when(chi2.isNotNull(), chi2_pvalue_dof1(chi2)))
        out = out.withColumn("p_text", sci4(F.col("p_value")))
    if alpha != 0.05:
        if not with_p:
            raise ValueError("a level other than 0.05 needs the p-value")
        out = out.withColumn("significant", significant(F.col("p_value"), alpha))
    if expected:
        n = (A + B + C + D).cast("double")
        out = out.withColumns({f"expected_{x}": F.try_divide(row * col, n) for x, row, col in (
            (a, A + B, A + C), (b, A + B, B + D), (c, C + D, A + C), (d, C + D, B + D))})
    return out.drop("_chi2")


def gender_chi_square(df: DataFrame, real: DataFrame, model: str = "model_name", group: str = "disease",
                      columns: Mapping[str, Column | str] | None = None, aliases: DataFrame | None = None,
                      real_group: str = "disease", with_p: bool = True,
                      alias_rules: Mapping[str, Sequence[str]] | None = None, alpha: float = 0.05,
                      expected: bool = False) -> DataFrame:
    """Records -> counts -> join real -> 2x2 test, for every model x language x group."""
    counts = gender_counts(df, model, group, columns)
    joined = attach_real(counts, real, group, real_group, aliases, alias_rules=alias_rules)
    return chi_square_table(joined, with_p=with_p, alpha=alpha, expected=expected)


# How the disease names of the records map to the real table's groups.
DEFAULT_ALIAS_RULES = {"T1DM": ["type 1", "t1dm", "1型"], "T2DM": ["type 2", "t2dm", "2型"],
                       "GDM": ["gestational", "gdm", "妊娠"]}


def counts_from_report(report: DataFrame, label: str = "gender", groups: Sequence[str] | None = None,
                       file_name: str = "file_name", marker: str = "_v", group: str = "disease") -> DataFrame:
    """Model counts from the models' own wide reports (one file per model and language): the model and
    language from the file name, one column per group, cells ``n`` or ``"n (p%)"``.

    Returns ``model, language, <group>, female, male, total`` like :func:`gender_counts`."""
    from ..sources.files import language_from_file, model_before

    keyed = report.withColumns({"model": model_before(F.col(file_name), marker), "language": language_from_file(F.col(file_name))})
    cols = list(groups) if groups is not None else [c for c in report.columns if c not in (label, file_name)]
    long = _label_counts(keyed, ["model", "language"], label, cols, group)
    return long.withColumn("total", F.col("female") + F.col("male"))


def _label_counts(report: DataFrame, keys: list[str], label: str, groups: Sequence[str], group: str) -> DataFrame:
    """female and male per (keys, group) of a wide report, its labels read by the gender rules."""
    from ..functions.gender import clean_gender

    sexed = report.select(*keys, clean_gender(F.col(label).cast("string"), "merged").alias("_label"),
                          *[F.col(f"`{c}`").cast("string").alias(c) for c in groups])
    long = sexed.unpivot([*keys, "_label"], list(groups), group, "_cell").withColumn("_n", cell_count(F.col("_cell")))
    return long.groupBy(*keys, group).agg(*[
        F.coalesce(F.sum(F.when(F.col("_label") == F.lit(sex), F.col("_n"))), F.lit(0)).cast("bigint").alias(sex.lower())
        for sex in ("Female", "Male")])


def chi_square_from_reports(report: DataFrame, real: DataFrame, group: str = "disease", label: str = "gender",
                            file_name: str = "file_name", **kw) -> DataFrame:
    """Model reports + real counts -> the 2x2 tests (see :func:`gender_chi_square`)."""
    counts = counts_from_report(report, label, file_name=file_name, group=group)
    rules = kw.pop("alias_rules", DEFAULT_ALIAS_RULES)
    real_group = kw.pop("real_group", group)
    return chi_square_table(attach_real(counts, real, group, real_group, alias_rules=rules), **kw)


def real_from_report(report: DataFrame, label: str = "gender", groups: Sequence[str] | None = None,
                     group: str = "disease") -> DataFrame:
    """Real-world counts from a wide report: a ``label`` column naming the row
    (Female / Male ...) and one column per group whose cells are numbers or
    ``"n (p%)"``.  Labels are read by the merged gender rules; a missing cell counts 0.
    Returns ``<group>, female, male``."""
    cols = list(groups) if groups is not None else [c for c in report.columns if c != label]
    return _label_counts(report, [], label, cols, group)


# ---------------------------------------------------------------------------
# Lengths and tokens
# ---------------------------------------------------------------------------
def mean_std_text(x: Column) -> Column:
    """``"m ± s"`` with 2 decimals; an undefined part (no values, or one value for
    the std) prints ``nan``."""
    nan = F.lit("nan")
    return F.concat(F.coalesce(fixed2(F.avg(x)), nan), F.lit(" ± "), F.coalesce(fixed2(F.stddev_samp(x)), nan))


def token_summary(df: DataFrame, columns: Sequence[str], model: str = "model_name",
                  key: str | None = None, position: str | None = None,
                  sort_by_size: bool = True) -> DataFrame:
    """Mean ± sample std of each token column per model, nulls skipped.

    With ``key`` (e.g. a file column) rows are grouped by it and the model name
    is the one on the first row (``min_by(model, position)``).  Sorted by the
    parameter size written in the model name, largest first.
    """
    if key is None:
        out = df.groupBy(F.col(model).alias(model)).agg(*[mean_std_text(F.col(c)).alias(c.lower()) for c in columns])
    else:
        first = F.min_by(F.col(model), F.col(position)) if position else F.min(F.col(model))
        out = df.groupBy(key).agg(first.alias(model), *[mean_std_text(F.col(c)).alias(c.lower()) for c in columns]) \
            .drop(key)
    if sort_by_size:
        out = out.orderBy(F.desc(param_size(F.col(model))), F.col(model))
    return out
