"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole driver tables (or views Spark derives from them) and
runs the library operators on them; the oracle is independent SQL for the
same result (every registered query has one).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import age as A
from ..functions import gender as G
from ..functions.text import null_tokens, text_length
from ..operators import aliases, align, contingency, coverage, generate, ledger, profile, reshape, states
from ..session import checkpoint_dir
from ..sources import catalogue, files, rescue, versions
from . import fixtures as X
from . import jobs
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return X.table(spark, d, name)


REC = f"with {X.SQL_RECORDS}"
PCT = O.pct


# --- banded and categorical distributions -----------------------------------
@register("binned_distribution_by_group",
          "select * from " + O.banded("lineitem", ["l_returnflag"], "l_quantity"))
def binned_distribution_by_group(spark, d):
    return profile.binned_distribution(T(spark, d, "lineitem"), "l_quantity", by=["l_returnflag"])


@register("binned_distribution_global", "select band_idx, band, n, pct, cell from " + O.banded("part", [], "p_size"))
def binned_distribution_global(spark, d):
    return profile.binned_distribution(T(spark, d, "part"), "p_size")


_WIDE_LONG = ("(select * from (select l_returnflag, 'l_quantity' as \"column\", * exclude (l_returnflag) from "
              + O.banded("(select l_returnflag, l_quantity as v from lineitem)", ["l_returnflag"], "v")
              + ") union all select * from (select l_returnflag, 'discount_pct' as \"column\", * exclude (l_returnflag) from "
              + O.banded("(select l_returnflag, l_discount * 100 as v from lineitem)", ["l_returnflag"], "v") + "))")


@register("binned_distribution_wide",
          f"""select "column", band_idx, band,
                max(case when l_returnflag = 'A' then cell end) as "A",
                max(case when l_returnflag = 'N' then cell end) as "N",
                max(case when l_returnflag = 'R' then cell end) as "R"
              from {_WIDE_LONG} w group by "column", band_idx, band""")
def binned_distribution_wide(spark, d):
    li = T(spark, d, "lineitem")
    long = profile.binned_distribution(li, {"l_quantity": F.col("l_quantity"),
                                            "discount_pct": F.col("l_discount") * 100}, by=["l_returnflag"])
    return reshape.pivot_report(long, ["column", "band_idx", "band"], "l_returnflag")


PRIORITY_DOMAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "9-UNSEEN"]
_DOM_VALUES = ", ".join(f"({i}, {O.lit(v)})" for i, v in enumerate(PRIORITY_DOMAIN))


@register("category_distribution_by_group", f"""
  with t as (select o_orderstatus, count(*) as _total from orders where o_orderstatus is not null group by 1),
  c as (select o_orderstatus, o_orderpriority as category, count(*) as n from orders group by 1, 2),
  d(category_idx, category) as (values {_DOM_VALUES})
  select t.o_orderstatus, cast(d.category_idx as integer) as category_idx, d.category,
    cast(coalesce(c.n, 0) as bigint) as n, {O.r2(PCT('coalesce(c.n, 0)', 't._total'))} as pct,
    {O.cell('coalesce(c.n, 0)', PCT('coalesce(c.n, 0)', 't._total'))} as cell
  from t cross join d left join c on c.o_orderstatus = t.o_orderstatus and c.category = d.category""")
def category_distribution_by_group(spark, d):
    return profile.category_distribution(T(spark, d, "orders"), "o_orderpriority", by=["o_orderstatus"],
                                         domain=PRIORITY_DOMAIN)


# --- frequencies, distinct values, validity ---------------------------------
@register("value_frequency", f"""{REC}
  select sex_raw, count(*) as n, {O.r2(PCT('count(*)', '(select count(*) from records)'))} as pct
  from records group by sex_raw""")
def value_frequency(spark, d):
    return profile.value_frequency(X.records(spark, d), "sex_raw")


@register("value_frequency_non_null", f"""
  select lang, count(*) as n, {O.r2(PCT('count(*)', '(select count(lang) from documents)'))} as pct
  from documents where lang is not null group by lang""")
def value_frequency_non_null(spark, d):
    return profile.value_frequency(T(spark, d, "documents"), "lang", dropna=True)


@register("distinct_values", f"{REC} select distinct age_raw from records")
def distinct_values(spark, d):
    return profile.distinct_values(X.records(spark, d), "age_raw")


@register("top_k_distinct", f"{REC} select distinct age_raw from records where age_raw is not null "
                            "order by age_raw limit 10")
def top_k_distinct(spark, d):
    return profile.top_k_distinct(X.records(spark, d), "age_raw", 10)


_VR_COLS = ["age_raw", "sex_raw", "age_zh_raw", "sex_zh_raw", "addr_raw"]


@register("valid_ratio", REC + " select * from (" + " union all ".join(
    f"""select model_name, '{c}' as "column", count({c}) as valid, count(*) as total,
        {O.r2(f"coalesce(cast(count({c}) as double) / nullif(count(*), 0) * 100, 0)")} as valid_pct
        from records group by model_name""" for c in _VR_COLS) + ")")
def valid_ratio(spark, d):
    return profile.valid_ratio(X.records(spark, d), _VR_COLS, by=["model_name"])


@register("invalid_values", "select c_acctbal, count(*) as n from customer "
                            "where not coalesce(c_acctbal between 0 and 120, false) group by c_acctbal")
def invalid_values(spark, d):
    return profile.invalid_values(T(spark, d, "customer"), "c_acctbal", 0, 120)


@register("invalid_ratio", f"""{REC}
  select model_name, cast(count_if(not coalesce({O.numeric('age_zh_raw')} between 0 and 120, false)) as bigint) as invalid,
    count(*) as total,
    {O.r2(PCT(f"count_if(not coalesce({O.numeric('age_zh_raw')} between 0 and 120, false))", 'count(*)'))} as invalid_pct
  from records group by model_name""")
def invalid_ratio(spark, d):
    return profile.invalid_ratio(X.records(spark, d), "age_zh_raw", 0, 120, by=["model_name"], text=True)


@register("range_mask", "select c_custkey, case when c_acctbal between 0 and 120 then c_acctbal end as acctbal_masked "
                        "from customer")
def range_mask(spark, d):
    return T(spark, d, "customer").select("c_custkey", A.range_mask(F.col("c_acctbal"), 0, 120).alias("acctbal_masked"))


# --- cleaners ---------------------------------------------------------------
def _two(spark, d, fn):
    return X.records(spark, d).select("rid", fn(F.col("age_raw")).alias("age_en"), fn(F.col("age_zh_raw")).alias("age_zh"))


def _two_sql(fn) -> str:
    return f"{REC} select rid, {fn('age_raw')} as age_en, {fn('age_zh_raw')} as age_zh from records"


@register("clean_age_v1", _two_sql(O.age_v1))
def clean_age_v1(spark, d):
    return _two(spark, d, A.clean_age_v1)


@register("clean_age_v2", _two_sql(O.age_v2))
def clean_age_v2(spark, d):
    return _two(spark, d, A.clean_age_v2)


@register("age_digits_only", _two_sql(O.digits_only))
def age_digits_only(spark, d):
    return _two(spark, d, A.digits_only)


@register("age_first_number", _two_sql(O.first_number))
def age_first_number(spark, d):
    return _two(spark, d, A.first_number)


@register("numeric_coerce", _two_sql(O.numeric))
def numeric_coerce(spark, d):
    return _two(spark, d, A.numeric_coerce)


def _sex(spark, d, fn):
    return X.records(spark, d).select("rid", fn(F.col("sex_raw")).alias("sex_en"), fn(F.col("sex_zh_raw")).alias("sex_zh"))


def _sex_sql(fn) -> str:
    return f"{REC} select rid, {fn('sex_raw')} as sex_en, {fn('sex_zh_raw')} as sex_zh from records"


@register("clean_gender_en", _sex_sql(O.gender_en))
def clean_gender_en(spark, d):
    return _sex(spark, d, G.clean_gender_en)


@register("clean_gender_zh", _sex_sql(O.gender_zh))
def clean_gender_zh(spark, d):
    return _sex(spark, d, G.clean_gender_zh)


@register("clean_gender_merged", _sex_sql(O.gender_merged))
def clean_gender_merged(spark, d):
    return _sex(spark, d, G.clean_gender_merged)


@register("cleaning_before_after", f"""{REC},
  b as (select cast(sex_zh_raw as varchar) as value, count(*) as n from records group by 1),
  a as (select {O.gender_merged('sex_zh_raw')} as value, count(*) as n from records group by 1)
  select 'before' as stage, value, cast(n as bigint) as n, {O.r2(PCT('n', '(select sum(n) from b)'))} as pct from b
  union all
  select 'after' as stage, value, cast(n as bigint) as n, {O.r2(PCT('n', '(select sum(n) from a)'))} as pct from a""")
def cleaning_before_after(spark, d):
    return profile.cleaning_before_after(X.records(spark, d), "sex_zh_raw", G.clean_gender_merged(F.col("sex_zh_raw")))


@register("cleaning_audit", f"""{REC}
  select sex_zh_raw as raw, {O.gender_zh('sex_zh_raw')} as cleaned, {O.gender_zh_matched('sex_zh_raw')} as matched,
    count(*) as n
  from records where sex_zh_raw is not null group by 1, 2, 3""")
def cleaning_audit(spark, d):
    rec = X.records(spark, d)
    return profile.cleaning_audit(rec, "sex_zh_raw", G.clean_gender_zh(F.col("sex_zh_raw")),
                                  G.gender_rule_matched(F.col("sex_zh_raw"), "zh"))


# --- coverage ---------------------------------------------------------------
PAIRS = {"English": ("age_raw", "sex_raw"), "Chinese": ("age_zh_raw", "sex_zh_raw")}


def _case_sql(a: str, s: str) -> str:
    ap, sp = O.age_present(a), O.gender_present(s)
    return f"(case when {ap} and {sp} then 'B' when {ap} then 'A' when {sp} then 'G' else 'N' end)"


_COV_COLS = ",\n    ".join(
    f"cast(count_if({_case_sql(a, s)} = '{k}') as bigint) as \"{lab}: {name}\""
    for lab, (a, s) in PAIRS.items() for k, name in (("B", "Both"), ("A", "Only age"), ("G", "Only gender"), ("N", "Neither")))
SQL_COVERAGE = f"cov as (select model_name as \"Model\",\n    {_COV_COLS}\n  from records group by model_name)"


@register("coverage_counts", f"{REC}, {SQL_COVERAGE} select * from cov")
def coverage_counts(spark, d):
    return jobs.coverage_summary(X.records(spark, d), pairs=PAIRS)


def _ratio_sql(total: str = "3000.0") -> str:
    cols = []
    for lab in ("English", "Chinese"):
        b, a, g = f'"{lab}: Both"', f'"{lab}: Only age"', f'"{lab}: Only gender"'
        cols += [f'{a} + {b} as "{lab}: Only age with Both"', f'{g} + {b} as "{lab}: Only gender with Both"']
    ratios = []
    for lab in ("English", "Chinese"):
        b, a, g = f'"{lab}: Both"', f'"{lab}: Only age"', f'"{lab}: Only gender"'
        for name, expr in (("Both", b), ("Both_Age", f"({a} + {b})"), ("Both_Sex", f"({g} + {b})")):
            ratios.append((f"{lab}_LMS_{name}_Ratio", f"cast({expr} as double) / {total}"))
    cols += [f'{e} as "{n}"' for n, e in ratios]
    cols += [f'{O.fixed2(e)} as "{n}_Formatted"' for n, e in ratios]
    return "select *, " + ", ".join(cols) + " from cov"


@register("coverage_ratios", f"{REC}, {SQL_COVERAGE} {_ratio_sql()}")
def coverage_ratios(spark, d):
    return jobs.coverage_report(coverage_counts(spark, d))


_LEVELS = ("Province", "City", "District")


def _loc_sql(percentages: bool) -> str:
    flags = f"""{X.SQL_PLACES}, {X.SQL_GAZETTEER}, {X.SQL_HOME},
  f as (select *, {O.strip_suffix('Province_Chinese')} in (select {O.strip_suffix('"省"')} from gaz where "省" is not null) as mp,
    {O.strip_suffix('City_Chinese')} in (select {O.strip_suffix('"地级市"')} from gaz where "地级市" is not null) as mc,
    {O.strip_suffix('District_Chinese')} in (select {O.strip_suffix('"县区"')} from gaz where "县区" is not null) as md,
    {O.strip_suffix('District_Chinese')} in (select {O.strip_suffix('name')} from home) as mh
    from places),
  s as (select model_name as "Model", count(*) as "Total_Samples", count(Address_Chinese) as "Chinese_Address",
    count(Province_Chinese) as "Chinese_Province", count(City_Chinese) as "Chinese_City",
    count(District_Chinese) as "Chinese_District", cast(count_if(coalesce(mp, false)) as bigint) as "Matched_Province",
    cast(count_if(coalesce(mc, false)) as bigint) as "Matched_City",
    cast(count_if(coalesce(md, false)) as bigint) as "Matched_District",
    cast(count_if(District_Chinese is not null and not coalesce(mh, false) and coalesce(md, false)) as bigint)
      as "Out_Of_Home_Districts"
    from f group by model_name)"""
    if not percentages:
        return flags
    cnt = ["Chinese_Address"] + [f"Chinese_{lv}" for lv in _LEVELS] + [f"Matched_{lv}" for lv in _LEVELS] + ["Out_Of_Home_Districts"]
    pcts = ", ".join(f'{O.r2(PCT(chr(34) + c + chr(34), chr(34) + "Total_Samples" + chr(34)))} as "{c}_Percentage"' for c in cnt)
    return flags + f", sp as (select *, {pcts} from s)"


@register("gazetteer_match", f"with {_loc_sql(True)} select * from sp")
def gazetteer_match(spark, d):
    return coverage.location_summary(X.places(spark, d), X.gazetteer(spark, d), X.home(spark, d))


@register("out_of_home_rows", f"""with {_loc_sql(False)}
  select model_name as "Model", pid + 1 as "Index", {O.strip_suffix('District_Chinese')} as "District" from f
  where District_Chinese is not null and not coalesce(mh, false) and coalesce(md, false)""")
def out_of_home_rows(spark, d):
    return coverage.out_of_home_rows(X.places(spark, d), X.gazetteer(spark, d), X.home(spark, d), "pid",
                                     model="model_name")


@register("location_accuracy", f"""with {_loc_sql(False)}
  select "Model", "Matched_Province" as "Chinese: Province Correct", "Matched_City" as "Chinese: City Correct",
    "Matched_District" as "Chinese: District Correct",
    cast(0 as double) as "English_Province_Accuracy", cast(0 as double) as "English_City_Accuracy",
    cast(0 as double) as "English_District_Accuracy",
    cast("Matched_Province" as double) / 3000 * 100 as "Chinese_Province_Accuracy",
    cast("Matched_City" as double) / 3000 * 100 as "Chinese_City_Accuracy",
    cast("Matched_District" as double) / 3000 * 100 as "Chinese_District_Accuracy"
  from s""")
def location_accuracy(spark, d):
    s = coverage.location_summary(X.places(spark, d), X.gazetteer(spark, d), X.home(spark, d), percentages=False)
    s = s.select("Model", *[F.col(f"Matched_{lv}").alias(f"Chinese: {lv} Correct") for lv in _LEVELS])
    return coverage.location_accuracy(s)


@register("percentage_columns", f"""{REC}, {SQL_COVERAGE},
  tot as (select model_name, count(*) as "Total_Samples" from records group by model_name)
  select cov.*, tot."Total_Samples", """ + ", ".join(
    f'{O.r2(PCT(chr(34) + f"{lab}: {c}" + chr(34), "tot.\"Total_Samples\""))} as "{lab}: {c}_Percentage"'
    for lab in ("English", "Chinese") for c in ("Both", "Only age", "Only gender", "Neither"))
          + ' from cov join tot on cov."Model" = tot.model_name')
def percentage_columns(spark, d):
    cov = coverage.coverage_counts(X.records(spark, d), pairs=PAIRS, total="Total_Samples")
    return coverage.percentage_columns(cov)


# --- contingency and chi-square ---------------------------------------------
def _clean_sex() -> dict:
    return {"English": G.clean_gender_merged(F.col("sex_raw")), "Chinese": G.clean_gender_merged(F.col("sex_zh_raw"))}

SQL_COUNTS = f"""cnt as (
  select model_name as model, l.language, disease,
    cast(count_if(l.g = 'Female') as bigint) as female, cast(count_if(l.g = 'Male') as bigint) as male
  from (select model_name, disease, 'English' as language, {O.gender_merged('sex_raw')} as g from records
        union all
        select model_name, disease, 'Chinese' as language, {O.gender_merged('sex_zh_raw')} as g from records) l
  where disease is not null group by model_name, l.language, disease),
  tot as (select model_name as model, disease, count(*) as total from records where disease is not null group by 1, 2)"""


@register("contingency_counts", f"""{REC}, {SQL_COUNTS}
  select cnt.model, language, cnt.disease, female, male, total from cnt join tot using (model, disease)""")
def contingency_counts(spark, d):
    return contingency.gender_counts(X.records(spark, d), "model_name", "disease", _clean_sex())


def _chi_sql() -> str:
    a, b, c, dd = "cast(real_female as double)", "cast(real_male as double)", "cast(female as double)", "cast(male as double)"
    n = f"({a} + {b} + {c} + {dd})"

    def term(o, e):
        e = f"({e})"
        diff = f"abs({o} - {e})"
        corr = f"({diff} - least(0.5, {diff}))"
        return f"({corr} * {corr} / {e})"

    chi = " + ".join([term(a, f"({a} + {b}) * ({a} + {c}) / {n}"), term(b, f"({a} + {b}) * ({b} + {dd}) / {n}"),
                      term(c, f"({c} + {dd}) * ({a} + {c}) / {n}"), term(dd, f"({c} + {dd}) * ({b} + {dd}) / {n}")])
    degenerate = f"(({a} + {b}) = 0 or ({c} + {dd}) = 0 or ({a} + {c}) = 0 or ({b} + {dd}) = 0)"
    return f"""{REC}, {X.SQL_REAL}, {SQL_COUNTS},
  j as (select cnt.model, language, cnt.disease, cnt.female, cnt.male, total, r.female as real_female, r.male as real_male
        from cnt join tot using (model, disease) join reals r on r.disease = cnt.disease),
  x as (select *, case when not {degenerate} then {chi} end as _chi2 from j)
  select model, language, disease, female, male, total, real_female, real_male,
    round_even(_chi2 * 1000000, 0) / 1000000 as chi2, 1 as dof,
    case when {degenerate} then 'degenerate' else 'ok' end as status,
    _chi2 > 3.841458820694124 as significant
  from x"""


@register("chi_square_2x2", _chi_sql())
def chi_square_2x2(spark, d):
    return contingency.gender_chi_square(X.records(spark, d), X.real(spark, d), columns=_clean_sex(), with_p=False)


@register("chi_square_from_report", _chi_sql())
def chi_square_from_report(spark, d):
    """Same test, with the real counts read back from a wide "n (p%)" report."""
    orders = T(spark, d, "orders").withColumn(
        "gender", F.when(F.col("o_orderstatus") == "F", "Female").when(F.col("o_orderstatus") == "O", "Male")
        .otherwise("Unknown"))
    long = profile.category_distribution(orders, "gender", by=["o_orderpriority"])
    wide = reshape.pivot_report(long, ["category"], "o_orderpriority").withColumnRenamed("category", "gender")
    real = contingency.real_from_report(wide, label="gender")
    return contingency.gender_chi_square(X.records(spark, d), real, columns=_clean_sex(), with_p=False)


def _chi_p_sql() -> str:
    base = _chi_sql()
    head, tail = base.rsplit("select model, language, disease, female, male, total, real_female, real_male,", 1)
    x = "sqrt(_chi2 / 2.0)"
    return (head + "select model, language, disease, female, male, total, real_female, real_male," + tail.rstrip()
            .replace("\n  from x", "") + f",\n    printf('%.4e', {O.erfc(x)}) as p_text\n  from x")


@register("chi_square_p", _chi_p_sql())
def chi_square_p(spark, d):
    """With the p-value, reported as the reference reports it: ``%.4e`` text (the raw
    double stays in the library output; engines differ in the last bits of exp)."""
    return contingency.gender_chi_square(X.records(spark, d), X.real(spark, d), columns=_clean_sex(),
                                         with_p=True).drop("p_value")


@register("unpivot_report", f"""{REC},
  g as (select disease, {O.gender_merged('sex_raw')} as v from records where disease is not null),
  t as (select disease, count(*) as _total from g group by 1),
  c as (select disease, v, count(*) as n from g group by 1, 2),
  dom(category_idx, category) as (values (0, 'Female'), (1, 'Male'), (2, 'Unknown'))
  select cast(dom.category_idx as integer) as category_idx, dom.category, t.disease,
    {O.cell('coalesce(c.n, 0)', PCT('coalesce(c.n, 0)', 't._total'))} as cell, cast(coalesce(c.n, 0) as bigint) as n
  from t cross join dom left join c on c.disease = t.disease and c.v = dom.category""")
def unpivot_report(spark, d):
    rec = X.records(spark, d).withColumn("Sex", G.clean_gender_merged(F.col("sex_raw")))
    wide = jobs.gender_profile(rec, ["Sex"], "disease", wide=True).drop("column")
    return reshape.report_counts(wide, ["category_idx", "category"], variable="disease", value="cell")


# --- lengths and tokens -----------------------------------------------------
def _mean_std_sql(x: str) -> str:
    return f"coalesce({O.fixed2(f'avg({x})')}, 'nan') || ' ± ' || coalesce({O.fixed2(f'stddev_samp({x})')}, 'nan')"


@register("token_mean_std", f"""
  select source as model_name,
    {_mean_std_sql("case when lang = 'en' then n_chars end")} as english_a_tokens,
    {_mean_std_sql("case when lang <> 'en' then n_chars end")} as chinese_a_tokens
  from documents group by source""")
def token_mean_std(spark, d):
    docs = T(spark, d, "documents").select(
        F.col("source").alias("model_name"),
        F.when(F.col("lang") == "en", F.col("n_chars")).alias("English_a_tokens"),
        F.when(F.col("lang") != "en", F.col("n_chars")).alias("Chinese_a_tokens"))
    return jobs.token_report(docs)


@register("text_length", "select doc_id, cast(length(coalesce(text, 'nan')) as integer) as text_length from documents")
def text_length_docs(spark, d):
    return T(spark, d, "documents").select("doc_id", text_length(F.col("text")).alias("text_length"))


@register("text_length_turns", "select conv_id, turn, cast(length(coalesce(text, 'nan')) as integer) as text_length "
                               "from conversations")
def text_length_turns(spark, d):
    return jobs.add_lengths(T(spark, d, "conversations").select("conv_id", "turn", "text"), ["text"]) \
        .select("conv_id", "turn", F.col("text_length"))


# --- positional / keyed alignment -------------------------------------------
@register("copy_column_strict", """
  with s as (select row_number() over (order by doc_id) as pos, lang from documents),
  t as (select row_number() over (order by n_chars, doc_id) as pos, doc_id, source from documents)
  select t.pos, t.doc_id, t.source, s.lang from t join s using (pos)""")
def copy_column_strict(spark, d):
    docs = T(spark, d, "documents")
    return align.copy_column_strict(docs.select("doc_id", "lang"), docs.select("doc_id", "source", "n_chars"),
                                    "lang", ["doc_id"], ["n_chars", "doc_id"]).drop("n_chars")


@register("copy_column_left", """
  with s as (select row_number() over (order by doc_id) as pos, quality from labels),
  t as (select row_number() over (order by doc_id) as pos, doc_id, lang from documents)
  select t.pos, t.doc_id, t.lang, s.quality from t left join s using (pos)""")
def copy_column_left(spark, d):
    return align.copy_column_left(T(spark, d, "labels").select("doc_id", "quality"),
                                  T(spark, d, "documents").select("doc_id", "lang"), "quality", ["doc_id"], ["doc_id"])


@register("copy_column_skip", """
  with s as (select row_number() over (order by doc_id) as pos, quality from labels),
  tg as (select 'documents' as target, doc_id from documents union all select 'labels' as target, doc_id from labels),
  ok as (select target from tg group by target having count(*) = (select count(*) from labels)),
  t as (select row_number() over (partition by target order by doc_id) as pos, target, doc_id from tg
        where target in (select target from ok))
  select t.pos, t.target, t.doc_id, s.quality from t join s using (pos)""")
def copy_column_skip(spark, d):
    docs = T(spark, d, "documents").select(F.lit("documents").alias("target"), "doc_id")
    labels = T(spark, d, "labels")
    targets = docs.unionByName(labels.select(F.lit("labels").alias("target"), "doc_id"))
    return align.copy_column_skip(labels.select("doc_id", "quality"), targets, "quality", "target",
                                  ["doc_id"], ["doc_id"])


@register("dataset_pairs", """
  with l as (select split_part(name, '_', 1) as key, max(name) as source_name from
              (select distinct source || '_' || lang || '_v3.2.parquet' as name from documents) group by 1),
  r as (select split_part(name, '_', 1) as key, max(name) as target_name from
        (select distinct 'src' || cast(conv_id % 25 as varchar) || '_turns_v4.1.parquet' as name from conversations)
        group by 1)
  select key, source_name, target_name from l join r using (key)""")
def dataset_pairs(spark, d):
    left = T(spark, d, "documents").select(F.concat_ws("_", "source", "lang", F.lit("v3.2.parquet")).alias("file_name"))
    right = T(spark, d, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string"), F.lit("_turns_v4.1.parquet")).alias("file_name"))
    return align.dataset_pairs(left.distinct(), right.distinct())


_PAIR_SQL = """
  with u as (select row_number() over (order by conv_id, turn) as pos, conv_id, turn, text from conversations
             where role = 'user'),
  a as (select row_number() over (order by conv_id, turn) as pos, conv_id, turn, text from conversations
        where role = 'assistant')
  select coalesce(u.pos, a.pos) as pos, u.conv_id as conv_id_q, u.turn as turn_q, u.text as text_q,
    a.conv_id as conv_id_a, a.turn as turn_a, a.text as text_a
  from u {join} join a on u.pos = a.pos"""


def _turns(spark, d, role):
    return T(spark, d, "conversations").where(F.col("role") == role).select("conv_id", "turn", "text")


@register("pair_truncate", _PAIR_SQL.format(join="inner"))
def pair_truncate(spark, d):
    return align.pair(_turns(spark, d, "user"), _turns(spark, d, "assistant"), how="position",
                      order_by=["conv_id", "turn"], join="inner", suffixes=("_q", "_a"))


@register("pair_pad", _PAIR_SQL.format(join="full outer"))
def pair_pad(spark, d):
    return align.pair(_turns(spark, d, "user"), _turns(spark, d, "assistant"), how="position",
                      order_by=["conv_id", "turn"], join="full", suffixes=("_q", "_a"))


@register("pair_by_key", """
  select u.conv_id, u.turn, u.text as text_q, a.text as text_a
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'""")
def pair_by_key(spark, d):
    asst = _turns(spark, d, "assistant").withColumn("turn", F.col("turn") - 1)
    return align.pair(_turns(spark, d, "user"), asst, how="key", on=["conv_id", "turn"], suffixes=("_q", "_a"))


@register("union_all_by_name", """
  select o_orderkey, o_orderstatus, o_totalprice, cast(null as varchar) as o_orderpriority from orders where o_orderstatus = 'F'
  union all select o_orderkey, o_orderstatus, null, o_orderpriority from orders where o_orderstatus = 'O'
  union all select o_orderkey, o_orderstatus, null, null from orders where o_orderstatus = 'P'""")
def union_all_by_name(spark, d):
    o = T(spark, d, "orders")
    return align.union_all_by_name([
        o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice"),
        o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        o.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus"),
    ])


# --- prompt grid and completion ---------------------------------------------
GRID_SUFFIX = "Template for output:\nAge:\nSex:"
_TEMPLATE = "' Condition: [CONDITION]. Location: [LOCATION].'"


def _grid(spark, d, runs=2):
    prompts = T(spark, d, "benchmark").select(F.col("item_id").alias("prompt_id"),
                                              F.concat(F.col("text"), F.expr(_TEMPLATE)).alias("template"))
    conditions = T(spark, d, "region").select(F.col("r_name").alias("condition"),
                                             F.concat(F.lit("{Background of "), F.col("r_name"), F.lit("}")).alias("background"))
    locations = T(spark, d, "nation").select(F.col("n_name").alias("location"))
    return generate.prompt_grid(prompts, conditions, locations=locations, runs=runs, suffix=GRID_SUFFIX) \
        .drop("template")


_GRID_SQL = f"""grid as (
  select b.item_id as prompt_id, r_name as condition, '{{Background of ' || r_name || '}}' as background,
    n_name as location, cast(t.run as integer) as run,
    replace(replace(replace(b.text || {_TEMPLATE}, '[CONDITION]', r_name), '{{{{CONDITION}}}}', r_name), '[LOCATION]', n_name)
      || chr(10) || translate('{{Background of ' || r_name || '}}', '{{}}', '') || chr(10) || chr(10)
      || {O.lit(GRID_SUFFIX)} as prompt
  from benchmark b, region, nation, range(1, 3) t(run))"""


@register("prompt_grid", f"with {_GRID_SQL} select * from grid")
def prompt_grid(spark, d):
    return _grid(spark, d)


def mirror_completion(prompt: str) -> str | None:
    """Deterministic stand-in client for the check: the reversed prompt, and a
    failed call (None) for prompts whose length is a multiple of 7."""
    if len(prompt) % 7 == 0:
        return None
    return prompt[::-1]


@register("batch_complete", f"""with {_GRID_SQL},
  ok as (select prompt_id, condition, location, run, split_part(reverse(prompt), '.', 1) as answer
         from grid where length(prompt) % 7 <> 0)
  select *, row_number() over (partition by condition, location order by prompt_id, run) as seq from ok""")
def batch_complete(spark, d):
    grid = _grid(spark, d).select("prompt_id", "condition", "location", "run", "prompt")
    out = jobs.complete(grid, mirror_completion, number_by=["condition", "location"],
                        number_order=["prompt_id", "run"], stop=["."], sleep=lambda s: None)
    return out.drop("prompt")


def first_session(prompt: str) -> str | None:
    """A client of which every call on a prompt of odd length fails."""
    return None if len(prompt) % 2 else "1 " + prompt[::-1]


def second_session(prompt: str) -> str | None:
    return None if len(prompt) % 7 == 0 else "2 " + prompt[::-1]


@register("batch_complete_resumed", f"""with {_GRID_SQL}
  select prompt_id, condition, location, run,
    split_part(case when length(prompt) % 2 = 0 then '1 ' else '2 ' end || reverse(prompt), '.', 1) as answer
  from grid where length(prompt) % 2 = 0 or length(prompt) % 7 <> 0""")
def batch_complete_resumed(spark, d):
    """Two sessions on one ledger: the second asks only what the first did not answer."""
    grid = _grid(spark, d).select("prompt_id", "condition", "location", "run", "prompt")
    path = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for client in (first_session, second_session):
        out = ledger.complete_with_ledger(grid, client, path, attempts=1, sleep=lambda s: None, stop=["."], calls_per_task=2000)
    return out.drop("prompt")


# --- sources ----------------------------------------------------------------
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]


def _scan_sql() -> str:
    has = {"text": ["documents", "benchmark", "conversations"], "doc_id": ["documents", "labels"], "o_orderkey": ["orders"],
           "html": ["pages"], "n_name": ["nation"]}
    parts = [f"select '{t}.parquet' as file_name, '{t}' as table_name, count(*) as n, "
             + ", ".join(f"count({c}) as n_{c}" if t in ts else f"cast(0 as bigint) as n_{c}" for c, ts in has.items())
             + f" from {t}" for t in DRIVER_TABLES]
    return " union all ".join(parts)


@register("scan_with_file_keys", _scan_sql())
def scan_with_file_keys(spark, d):
    """Files of different schemas in one frame: columns of several tables are read and counted per file."""
    df = files.scan(spark, d, glob="*.parquet", keys={"table_name": files.model_from_file(F.col("file_name"))})
    return df.groupBy("file_name", "table_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("text", "doc_id", "o_orderkey", "html", "n_name")])


# Spark's names of the types that the tables' columns have, from DuckDB's
_TYPE_SQL = """replace(replace(replace(replace(replace(replace(lower(t), 'varchar', 'string'), 'integer', 'int'),
  'timestamp', 'timestamp_ntz'), 'float[]', 'array<float>'), 'double[]', 'array<double>'), 'real', 'float')"""


def _described(table: str) -> str:
    return (f"select '{table}.parquet' as file_name, column_name as c, {_TYPE_SQL.replace('lower(t)', 'lower(column_type)')} as t, "
            f"row_number() over () as i from (describe select * from {table})")


_DESCRIBED = " union all ".join(_described(t) for t in DRIVER_TABLES)
_COUNTED = " union all ".join(f"select '{t}.parquet' as file_name, count(*) as n from {t}" for t in DRIVER_TABLES)


def _tables(spark, d):
    """The catalogue of the tables' footers, a row per table."""
    folders = [f for some in catalogue.table_folders(spark, d, "*.parquet")[1:] for f in some]
    return catalogue.entries(catalogue.catalogue(spark, d, glob="*.parquet"), folders)


@register("file_catalogue", f"""
  select file_name, n as n_rows, string_agg(c, ',' order by i) as columns, string_agg(t, ',' order by i) as types
  from ({_DESCRIBED}) join ({_COUNTED}) using (file_name) group by file_name, n""")
def file_catalogue(spark, d):
    """Rows, columns and types of every table, from the footers of its file or part files."""
    cat = _tables(spark, d)
    return cat.select(F.substring_index("path", "/", -1).alias("file_name"), F.col("rows").alias("n_rows"),
                      F.array_join("columns.name", ",").alias("columns"), F.array_join("columns.type", ",").alias("types"))


@register("schema_union", f"""
  select c as "column", string_agg(distinct t, ',' order by t) as types, count(*) as files,
    case when count(distinct t) = 1 then min(t)
         when bool_and(t in ('tinyint', 'smallint', 'int', 'bigint')) then 'bigint'
         when bool_and(t in ('tinyint', 'smallint', 'int', 'double')) then 'double' end as type
  from ({_DESCRIBED}) group by c""")
def schema_union(spark, d):
    """The union of all tables' schemas: per column its types, files and the type that holds them."""
    union = catalogue.schema_union(_tables(spark, d).withColumn("error", F.lit(None).cast("string")))
    return union.select("column", F.array_join("types", ",").alias("types"), "files", "type")


_LINE_SQL = """'{"id":' || cast(c_custkey as varchar(20)) || ',"segment":"' || c_mktsegment || '","nation":' ||
  case when c_custkey % 10 = 7 then '"x"}' when c_custkey % 10 = 3 then cast(c_nationkey as varchar(20))
       else cast(c_nationkey as varchar(20)) || '}' end"""


@register("record_rescue", f"""
  select c_custkey as id, c_mktsegment as segment, c_nationkey as nation, cast(null as varchar) as record, cast(null as varchar) as reason
  from customer where c_custkey % 10 not in (3, 7)
  union all select null, null, null, {_LINE_SQL}, 'does not fit the schema' from customer where c_custkey % 10 in (3, 7)""")
def record_rescue(spark, d):
    """JSON lines of which some are cut off or of a wrong type: sound records and quarantine together."""
    base = f"{checkpoint_dir(spark)}/rescue-{uuid.uuid4().hex}"
    T(spark, d, "customer").select(F.expr(_LINE_SQL).alias("value")).write.text(f"{base}/lines")
    good = rescue.rescue(spark, f"{base}/lines", f"{base}/store", "json", "id bigint, segment string, nation int")
    return good.drop(files.FILE_NAME).unionByName(rescue.quarantined(spark, f"{base}/store").select("record", "reason"), allowMissingColumns=True)


@register("alias_labels", """with al as (
    select alias, min(label) as label from (
      select split_part(p_name, ' ', 1) as alias, 'quality' as label from part union all select split_part(p_name, ' ', 2), 'thing' from part
      union all select upper(p_type), 'type' from part) where alias <> '' group by alias),
  hit as (select n.p_name, l.label || ':' || lower(l.alias) as label,
      row_number() over (partition by n.p_name order by length(l.alias) desc, lower(l.alias), l.label) as place
    from (select distinct p_name from part) n join al l on contains(lower(n.p_name), lower(l.alias)))
  select p.p_partkey, p.p_name, h.label from part p left join hit h on h.p_name = p.p_name and h.place = 1""")
def alias_labels(spark, d):
    """Part names labelled by the longest alias in them; the aliases are the words and types of all parts."""
    part = T(spark, d, "part")
    words = F.array(*[F.struct(F.split_part("p_name", F.lit(" "), F.lit(k)).alias("alias"), F.lit(what).alias("kind")) for k, what in ((1, "quality"), (2, "thing"))],
                    F.struct(F.upper("p_type").alias("alias"), F.lit("type").alias("kind")))
    table = part.select(F.inline(words)).select("alias", F.concat("kind", F.lit(":"), F.lower("alias")).alias("label"))
    return aliases.label_by_aliases(part.select("p_partkey", "p_name"), "p_name", table)


@register("profile_states", "select *, '2,1,0' as files_read from " + O.banded("lineitem", ["l_linestatus"], "l_quantity"))
def profile_states(spark, d):
    """The banded profile of three files (each in parts) from stored counts: two files, then a third is added, then nothing is new."""
    base = f"{checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    spec = states.Profile("quantity", "band", ["l_linestatus"], {"l_quantity": "l_quantity"})
    read = []
    for flags in (["A", "R"], ["N"], []):
        for f in flags:
            part = T(spark, d, "lineitem").where(F.col("l_returnflag") == f)
            part.write.parquet(f"{base}/files/flag-{f}.parquet")  # a folder of part files, written by many tasks
        read.append(states.update(spark, f"{base}/store", f"{base}/files", [spec], glob="*.parquet"))
    return states.report(spark, f"{base}/store", f"{base}/files", spec, glob="*.parquet").drop("column").withColumn("files_read", F.lit(",".join(map(str, read))))


@register("versioned_dataset", """
  select n_nationkey, n_name || '!' as name, n_regionkey, 'v2' as version, cast(2 as integer) as entries, true as second_writer_lost from nation""")
def versioned_dataset(spark, d):
    """Two versions of a table; a second writer of the latter that began earlier loses and changes nothing."""
    base = f"{checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}"
    files.write_version(T(spark, d, "nation"), base, "v1")
    slow = versions.begin(spark, base)
    files.write_version(versions.read(spark, base, "v1").select("n_nationkey", F.concat("n_name", F.lit("!")).alias("name"), "n_regionkey"), base, "v2")
    lost = False
    try:
        versions.commit(spark, slow, "v2", lambda folder: T(spark, d, "nation").limit(1).write.parquet(folder))
    except versions.VersionConflict:
        lost = True
    return versions.read(spark, base).withColumns({"version": F.lit(versions.current(spark, base).version),
                                                   "entries": F.lit(len(versions.log(spark, base))), "second_writer_lost": F.lit(lost)})


@register("null_tokens", f"{REC} select rid, {O.null_tokens('addr_raw')} as address from records")
def null_tokens_q(spark, d):
    return X.records(spark, d).select("rid", null_tokens(F.col("addr_raw")).alias("address"))


@register("schema_guard", "select doc_id, lang, source, n_chars, cast(null as varchar) as quality from documents")
def schema_guard(spark, d):
    return files.require_columns(T(spark, d, "documents"), ["doc_id", "lang", "source"], ["n_chars", "quality"])


# --- composite profiles -----------------------------------------------------
@register("age_profile", f"""{REC},
  v as (select disease, {O.age_v2('age_raw')} as a_en, {O.age_v2('age_zh_raw')} as a_zh from records)
  select * from (
    select disease, 'Age' as "column", * exclude (disease) from {O.banded('(select disease, a_en from v)', ['disease'], 'a_en')}
    union all
    select disease, 'Age_Chinese' as "column", * exclude (disease)
    from {O.banded('(select disease, a_zh from v)', ['disease'], 'a_zh')})""")
def age_profile(spark, d):
    rec = X.records(spark, d).withColumnsRenamed({"age_raw": "Age", "age_zh_raw": "Age_Chinese"})
    return jobs.age_profile(jobs.clean_ages(rec), ["Age", "Age_Chinese"], "disease")


@register("gender_profile", f"""{REC},
  g as (select disease, 'Sex' as "column", {O.gender_merged('sex_raw')} as v from records where disease is not null
        union all
        select disease, 'Sex_Chinese' as "column", {O.gender_merged('sex_zh_raw')} as v from records where disease is not null),
  t as (select "column", disease, count(*) as _total from g group by 1, 2),
  c as (select "column", disease, v, count(*) as n from g group by 1, 2, 3),
  dom(category_idx, category) as (values (0, 'Female'), (1, 'Male'), (2, 'Unknown'))
  select t."column", t.disease, cast(dom.category_idx as integer) as category_idx, dom.category,
    cast(coalesce(c.n, 0) as bigint) as n, {O.r2(PCT('coalesce(c.n, 0)', 't._total'))} as pct,
    {O.cell('coalesce(c.n, 0)', PCT('coalesce(c.n, 0)', 't._total'))} as cell
  from t cross join dom left join c on c."column" = t."column" and c.disease = t.disease and c.v = dom.category""")
def gender_profile(spark, d):
    rec = X.records(spark, d).withColumnsRenamed({"sex_raw": "Sex", "sex_zh_raw": "Sex_Chinese"})
    return jobs.gender_profile(jobs.clean_genders(rec), ["Sex", "Sex_Chinese"], "disease")


# --- more composite jobs under the gate ---------------------------------------
@register("clean_ages_legacy", f"""{REC}
  select rid, cast(case when {O.digits_only('age_zh_raw')} between 0 and 120 then {O.digits_only('age_zh_raw')} end as integer)
      as age_zh, cast({O.first_number('age_raw')} as integer) as age_en
  from records""")
def clean_ages_legacy(spark, d):
    rec = X.records(spark, d).withColumnsRenamed({"age_raw": "Age", "age_zh_raw": "Age_Chinese"})
    return jobs.clean_ages_legacy(rec).select("rid", F.col("Age_Chinese").alias("age_zh"), F.col("Age").alias("age_en"))


@register("age_valid_ratio", f"""{REC},
  v as (select model_name, {O.age_v2('age_raw')} as a_en, {O.age_v2('age_zh_raw')} as a_zh from records)
  select * from (
    select model_name, 'Age' as "column", count(a_en) as valid, count(*) as total,
      {O.r2(PCT('count(a_en)', 'count(*)'))} as valid_pct from v group by model_name
    union all
    select model_name, 'Age_Chinese' as "column", count(a_zh) as valid, count(*) as total,
      {O.r2(PCT('count(a_zh)', 'count(*)'))} as valid_pct from v group by model_name)""")
def age_valid_ratio(spark, d):
    rec = X.records(spark, d).withColumnsRenamed({"age_raw": "Age", "age_zh_raw": "Age_Chinese"})
    return profile.valid_ratio(jobs.clean_ages(rec), ["Age", "Age_Chinese"], by=["model_name"])


@register("value_audit_frequency", f"""{REC},
  l as (select model_name, 'age_raw' as "column", cast(age_raw as varchar) as value from records
        union all select model_name, 'sex_raw' as "column", cast(sex_raw as varchar) as value from records),
  c as (select model_name, "column", value, count(*) as n from l group by 1, 2, 3)
  select model_name, "column", value, n,
    {O.r2(PCT('n', 'sum(n) over (partition by model_name, "column")'))} as pct from c""")
def value_audit_frequency(spark, d):
    return jobs.value_audit(X.records(spark, d), ["age_raw", "sex_raw"], by=["model_name"])["frequency"]


@register("coverage_key_metrics", f"{REC}, {SQL_COVERAGE} select " + ", ".join(
    f'"{c}"' for c in jobs.KEY_METRICS) + f" from ({_ratio_sql()})")
def coverage_key_metrics(spark, d):
    return jobs.coverage_report(coverage_counts(spark, d), key_metrics_only=True)


@register("pair_languages_indexed", """
  with u as (select conv_id, turn, text as "English_a" from conversations where role = 'user'),
  a as (select conv_id, turn - 1 as turn, text as "Chinese_a" from conversations where role = 'assistant'),
  j as (select u.conv_id, u.turn, "English_a", "Chinese_a" from u join a on u.conv_id = a.conv_id and u.turn = a.turn)
  select row_number() over (order by conv_id, turn) - 1 as "index", "English_a", "Chinese_a", conv_id, turn from j""")
def pair_languages_indexed(spark, d):
    conv = T(spark, d, "conversations")
    en = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("English_a"))
    zh = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Chinese_a"))
    return jobs.pair_languages(en, zh, how="key", on=["conv_id", "turn"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("age_profile_wide", f"""{REC},
  v as (select disease, {O.age_v2('age_raw')} as a_en from records),
  b as {O.banded('(select disease, a_en from v)', ['disease'], 'a_en')}
  select band_idx, band, """ + ", ".join(
    f"max(case when disease = '{p}' then cell end) as \"{p}\"" for p in _PRIORITIES) + """
  from b group by band_idx, band""")
def age_profile_wide(spark, d):
    rec = jobs.clean_ages(X.records(spark, d).withColumnRenamed("age_raw", "Age"), ["Age"])
    long = jobs.age_profile(rec, ["Age"], "disease")
    return reshape.pivot_report(long, ["band_idx", "band"], "disease")


@register("gender_profile_wide", f"""{REC},
  g as (select disease, {O.gender_merged('sex_zh_raw')} as v from records where disease is not null),
  t as (select disease, count(*) as _total from g group by 1),
  c as (select disease, v, count(*) as n from g group by 1, 2),
  dom(category_idx, category) as (values (0, 'Female'), (1, 'Male'), (2, 'Unknown')),
  l as (select t.disease, cast(dom.category_idx as integer) as category_idx, dom.category,
          {O.cell('coalesce(c.n, 0)', PCT('coalesce(c.n, 0)', 't._total'))} as cell
        from t cross join dom left join c on c.disease = t.disease and c.v = dom.category)
  select category_idx, category, """ + ", ".join(
    f"max(case when disease = '{p}' then cell end) as \"{p}\"" for p in _PRIORITIES) + """
  from l group by category_idx, category""")
def gender_profile_wide(spark, d):
    rec = X.records(spark, d).withColumn("Sex_Chinese", G.clean_gender_merged(F.col("sex_zh_raw")))
    return jobs.gender_profile(rec, ["Sex_Chinese"], "disease", wide=True).drop("column")


@register("shape_report", """
  select "column", "type", (select count(*) from documents) as n_rows, 5 as n_columns
  from (values ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'),
               ('n_chars', 'bigint')) s("column", "type")""")
def shape_report(spark, d):
    return files.shape_report(T(spark, d, "documents"))


@register("coverage_ratios_actual", f"{REC}, {SQL_COVERAGE} " + _ratio_sql(
    total='cast(("English: Both" + "English: Only age" + "English: Only gender" + "English: Neither") as double)'))
def coverage_ratios_actual(spark, d):
    """Ratios over each model's own row count instead of the fixed 3000."""
    return jobs.coverage_report(coverage_counts(spark, d), total=None)


@register("age_profile_lower_non_null", f"""{REC},
  v as (select disease, {O.age_v2('age_zh_raw')} as a_zh from records)
  select * from {O.banded('(select disease, a_zh from v)', ['disease'], 'a_zh', total='count(_x)', style='lower')}""")
def age_profile_lower_non_null(spark, d):
    rec = jobs.clean_ages(X.records(spark, d).withColumnRenamed("age_zh_raw", "Age_Chinese"), ["Age_Chinese"])
    return profile.binned_distribution(rec, "Age_Chinese", by=["disease"], label_style="lower", denominator="non_null")


@register("reindex_counts", """
  with c as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2),
  s as (select distinct o_orderstatus from orders),
  d(category_idx, o_orderpriority) as (values """ + ", ".join(f"({i}, {O.lit(v)})" for i, v in enumerate(PRIORITY_DOMAIN)) + """)
  select s.o_orderstatus, cast(d.category_idx as integer) as category_idx, d.o_orderpriority,
    cast(coalesce(c.n, 0) as bigint) as n
  from s cross join d left join c on c.o_orderstatus = s.o_orderstatus and c.o_orderpriority = d.o_orderpriority""")
def reindex_counts(spark, d):
    counts = T(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return profile.reindex_counts(counts, "o_orderpriority", PRIORITY_DOMAIN, by=["o_orderstatus"])


PRIORITY_RULES = {"URGENT": ["urgent"], "HIGH": ["high"], "MEDIUM": ["medium"], "NOT SPECIFIED": ["not spec"],
                  "LOW": ["low"]}


@register("chi_square_alias_rules", _chi_sql())
def chi_square_alias_rules(spark, d):
    """Real counts keyed by a different spelling ('URGENT'), matched by substring rules."""
    real = T(spark, d, "orders").groupBy(F.substring("o_orderpriority", 3, 100).alias("disease")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("female"), F.count_if(F.col("o_orderstatus") == "O").alias("male"))
    return contingency.gender_chi_square(X.records(spark, d), real, columns=_clean_sex(), with_p=False,
                                         alias_rules=PRIORITY_RULES)


FLAGSHIP = "coverage_ratios"


# --- keys from names, per-model profiles, the full chi-square frame -----------------
NAME_SQL = "source || '/' || lang || '-7.5B_sex_' || case when doc_id % 3 = 0 then 'Chinese' else 'en' end || '_v3.0.xlsx'"


@register("name_keys", f"""
  with n as (select doc_id, {NAME_SQL} as name from documents)
  select doc_id, regexp_replace(name, '(_v[0-9.]+)?\\.[A-Za-z]+$', '') as model, split_part(name, '_sex_', 1) as before,
    case when lower(name) like '%chinese%' then 'Chinese' else 'English' end as language,
    replace(name, '_v3.0', '_v3.2') as next_name, lower(name) like '%_sex\\_e%' escape '\\' as is_english_report,
    7.5::double as size, replace(replace(name, '/', '_'), ':', '_') as safe, 'm' as stamped
  from n""")
def name_keys(spark, d):
    """Model, language, version, size and path-safe name from dataset names, and a stamped constant."""
    from ..functions.text import param_size, safe_name
    name = F.concat("source", F.lit("/"), "lang", F.lit("-7.5B_sex_"),
                    F.when(F.col("doc_id") % 3 == 0, "Chinese").otherwise("en"), F.lit("_v3.0.xlsx"))
    n = T(spark, d, "documents").select("doc_id", name.alias("name"))
    c = F.col("name")
    out = n.select("doc_id", files.model_from_file(c).alias("model"), files.model_before(c, "_sex_").alias("before"),
                   files.language_from_file(c).alias("language"), files.rewrite_version(c, [("_v3\\.0", "_v3.2")]).alias("next_name"),
                   files.name_matches(c, ["_SEX_e"]).alias("is_english_report"), param_size(c).alias("size"), safe_name(c).alias("safe"))
    return generate.stamp(out, {"stamped": "m"})


@register("age_profile_by_model", f"""{REC},
  v as (select model_name, disease, {O.age_v2('age_raw')} as a_en, {O.age_v2('age_zh_raw')} as a_zh from records)
  select * from (
    select model_name, disease, 'Age' as "column", * exclude (model_name, disease)
    from {O.banded('(select model_name, disease, a_en from v)', ['model_name', 'disease'], 'a_en')}
    union all
    select model_name, disease, 'Age_Chinese' as "column", * exclude (model_name, disease)
    from {O.banded('(select model_name, disease, a_zh from v)', ['model_name', 'disease'], 'a_zh')})""")
def age_profile_by_model(spark, d):
    rec = X.records(spark, d).withColumnsRenamed({"age_raw": "Age", "age_zh_raw": "Age_Chinese"})
    return jobs.age_profile(jobs.clean_ages(rec), ["Age", "Age_Chinese"], ["model_name", "disease"])


@register("gender_profile_by_model", f"""{REC},
  g as (select model_name, disease, {O.gender_merged('sex_zh_raw')} as v from records where model_name is not null and disease is not null),
  t as (select model_name, disease, count(*) as _total from g group by all),
  c as (select model_name, disease, v, count(*) as n from g group by all),
  dom(category_idx, category) as (values (0, 'Female'), (1, 'Male'), (2, 'Unknown'))
  select 'Sex_Chinese' as "column", t.model_name, t.disease, cast(dom.category_idx as integer) as category_idx, dom.category,
    cast(coalesce(c.n, 0) as bigint) as n, {O.r2(PCT('coalesce(c.n, 0)', 't._total'))} as pct,
    {O.cell('coalesce(c.n, 0)', PCT('coalesce(c.n, 0)', 't._total'))} as cell
  from t cross join dom left join c on c.model_name = t.model_name and c.disease = t.disease and c.v = dom.category""")
def gender_profile_by_model(spark, d):
    rec = X.records(spark, d).withColumnRenamed("sex_zh_raw", "Sex_Chinese")
    return jobs.gender_profile(jobs.clean_genders(rec, ["Sex_Chinese"]), ["Sex_Chinese"], ["model_name", "disease"])


@register("cleaning_audit_by_model", f"""{REC}
  select model_name, sex_zh_raw as raw, {O.gender_merged('sex_zh_raw')} as cleaned, count(*) as n
  from records where sex_zh_raw is not null group by all""")
def cleaning_audit_by_model(spark, d):
    return jobs.gender_cleaning_reports(X.records(spark, d), "sex_zh_raw", by=["model_name"])[1].drop("matched")


@register("chi_square_full_frame", f"""{REC}, {X.SQL_REAL}, {SQL_COUNTS},
  r as (select * from reals where disease <> '5-LOW' union all select 'EXTRA', 10, 0),
  f as (select * from (select distinct model, language from cnt) cross join r)
  select coalesce(c.model, f.model) as model, coalesce(c.language, f.language) as language, coalesce(c.disease, f.disease) as disease,
    coalesce(c.female, 0) as female, coalesce(c.male, 0) as male, cast(f.female as bigint) as real_female, cast(f.male as bigint) as real_male,
    case when f.female is null then 'missing' when f.disease = 'EXTRA' or c.female + c.male = 0 then 'degenerate' else 'ok' end as status
  from f full join cnt c on c.model is not distinct from f.model and c.language = f.language and c.disease = f.disease""")
def chi_square_full_frame(spark, d):
    """A group without real counts, and a real group that no model produced."""
    real = X.real(spark, d).where("disease <> '5-LOW'").unionByName(
        spark.range(1).selectExpr("'EXTRA' as disease", "10L as female", "0L as male"))
    out = contingency.gender_chi_square(X.records(spark, d), real, columns=_clean_sex(), with_p=False)
    return out.select("model", "language", "disease", "female", "male", "real_female", "real_male", "status")


@register("value_audit_distinct", f"""{REC}
  select distinct 'age_raw' as "column", age_raw as value from records union all
  select distinct 'sex_raw', sex_raw from records""")
def value_audit_distinct(spark, d):
    return jobs.value_audit(X.records(spark, d), ["age_raw", "sex_raw"])["distinct"]
