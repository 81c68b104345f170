"""DuckDB SQL text of the rules, for the side-by-side correctness check.

These generate independent SQL (RE2 regexes, DuckDB functions) for the same
semantics the Spark expressions implement; only the fixed word lists are
shared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..functions import gender as G
from ..functions.text import ASCII_DIGITS, NULL_TOKENS, PY_WHITESPACE, UNICODE_DIGITS

ND = r"\p{Nd}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(items: Sequence[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {lit(PY_WHITESPACE)})"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def ascii_num(x: str, typ: str = "bigint") -> str:
    return f"try_cast(translate({x}, {lit(UNICODE_DIGITS)}, {lit(ASCII_DIGITS)}) as {typ})"


def r2(x: str) -> str:
    """numpy round(x, 2) = rint(x*100)/100."""
    return f"(round_even(({x}) * 100, 0) / 100)"


def pct(n: str, total: str) -> str:
    return f"(cast({n} as double) / {total} * 100)"


def cell(n: str, p: str) -> str:
    return f"(cast({n} as varchar) || ' (' || cast({r2(p)} as varchar) || '%)')"


def fixed2(x: str) -> str:
    """Two decimals of the exact binary value (C formatting)."""
    return f"printf('%.2f', {x})"


# --- ages -------------------------------------------------------------------
YEARS = f"^({ND}+)岁"
YEARS_OLD = rf"(?i)^({ND}+)\s*years? old"
RANGE = f"^({ND}+)-({ND}+)"
PLUS = f"^({ND}+)多岁"


def _ext(s: str, pattern: str, g: int = 1) -> str:
    return ascii_num(f"regexp_extract({s}, {lit(pattern)}, {g})")


def age_v1(x: str) -> str:
    s = strip(x)
    mid = f"cast(floor(({_ext(s, RANGE, 1)} + {_ext(s, RANGE, 2)}) / 2) as bigint)"
    return f"""(case when {s} is null then null
      when regexp_matches({s}, '^{ND}+$') then {ascii_num(s)}
      when regexp_matches({s}, {lit(YEARS)}) then {_ext(s, YEARS)}
      when regexp_matches({s}, {lit(YEARS_OLD)}) then {_ext(s, YEARS_OLD)}
      when regexp_matches({s}, {lit(RANGE)}) then {mid}
      when regexp_matches({s}, {lit(PLUS)}) then {_ext(s, PLUS)}
      when contains({s}, '个月') or contains({s}, '周龄') then cast(0 as bigint)
      else null end)"""


def age_v2(x: str) -> str:
    s = strip(x)
    mid = f"cast(floor(({_ext(s, RANGE, 1)} + {_ext(s, RANGE, 2)}) / 2) as bigint)"
    first = _ext(s, f"({ND}+)")
    raw = f"""(case when {s} is null then null
      when regexp_matches({s}, '^{ND}+$') then (case when {ascii_num(s)} between 0 and 120 then {ascii_num(s)} end)
      when regexp_matches({s}, {lit(YEARS)}) then {_ext(s, YEARS)}
      when regexp_matches({s}, {lit(YEARS_OLD)}) then {_ext(s, YEARS_OLD)}
      when regexp_matches({s}, {lit(RANGE)}) then {mid}
      when regexp_matches({s}, {lit(PLUS)}) then {_ext(s, PLUS)}
      when regexp_matches({s}, '{ND}') and {first} between 0 and 120 then {first}
      when contains({s}, '个月') or contains({s}, '周') or contains({s}, '天') then cast(0 as bigint)
      else null end)"""
    return f"cast(case when {raw} between 0 and 120 then {raw} end as integer)"


def digits_only(x: str) -> str:
    k = f"regexp_replace(cast({x} as varchar), '[^0-9.]', '', 'g')"
    return rf"(case when regexp_matches({k}, '^([0-9]+\.?[0-9]*|\.[0-9]+)$') then try_cast({k} as double) end)"


def first_number(x: str) -> str:
    v = ascii_num(f"regexp_extract({x}, '({ND}+)', 1)", "double")
    return f"(case when {v} between 0 and 120 then {v} end)"


def numeric(x: str) -> str:
    return (rf"(case when regexp_matches({x}, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') "
            f"then try_cast(trim({x}) as double) end)")


def age_present(x: str) -> str:
    return (rf"coalesce({x} is not null and lower({x}) <> 'unknown' and "
            rf"regexp_matches({x}, '^({ND}+\.?{ND}*|\.{ND}+)$'), false)")


def gender_present(x: str) -> str:
    return f"coalesce({x} is not null and lower({x}) <> 'unknown' and not regexp_matches({x}, '^{ND}+$'), false)"


# --- genders ----------------------------------------------------------------
def gender_list(x: str, male: Sequence[str], female: Sequence[str]) -> str:
    s = norm(x)
    return (f"(case when {x} is null then 'Unknown' when {s} in {in_list(male)} then 'Male' "
            f"when {s} in {in_list(female)} then 'Female' else 'Unknown' end)")


def gender_en(x: str) -> str:
    return gender_list(x, G.EN_MALE, G.EN_FEMALE)


def gender_zh(x: str) -> str:
    return gender_list(x, G.ZH_MALE, G.ZH_FEMALE)


def gender_merged(x: str) -> str:
    s = norm(x)
    fem = list(G.MERGED_FEMALE) + [p + "." for p in G.MERGED_FEMALE]
    mal = list(G.MERGED_MALE) + [p + "." for p in G.MERGED_MALE]
    fp, mp = f"strpos({s}, '女性')", f"strpos({s}, '男性')"
    return (f"(case when {x} is null then 'Unknown' when {s} in {in_list(fem)} then 'Female' "
            f"when {s} in {in_list(mal)} then 'Male' "
            f"when {fp} > 0 and {mp} > 0 then (case when {fp} < {mp} then 'Female' else 'Male' end) "
            f"when {fp} > 0 then 'Female' when {mp} > 0 then 'Male' else 'Unknown' end)")


def gender_zh_matched(x: str) -> str:
    return f"coalesce({norm(x)} in {in_list(list(G.ZH_MALE) + list(G.ZH_FEMALE))}, false)"


def null_tokens(x: str) -> str:
    return f"(case when {x} in {in_list(NULL_TOKENS)} then null else {x} end)"


SUFFIX = "(特别行政区|自治州|地区|省|市|区|县|盟)$"


def strip_suffix(x: str) -> str:
    return f"regexp_replace({x}, {lit(SUFFIX)}, '')"


# --- bands ------------------------------------------------------------------
def band_idx(x: str, width: int = 5, low: int = 0, high: int = 100) -> str:
    return (f"(case when {x} between {low} and {low + width} then 0 "
            f"when {x} > {low + width} and {x} <= {high} then cast(ceil(({x} - {low}) / {width}) - 1 as integer) end)")


def band_domain(style: str = "upper", width: int = 5, n: int = 20) -> str:
    if style == "upper":
        lab = f"cast(i * {width} + 1 as varchar) || '-' || cast(i * {width} + {width} as varchar)"
    else:
        lab = f"cast(i * {width} as varchar) || '-' || cast(i * {width} + {width - 1} as varchar)"
    return f"(select cast(i as integer) as band_idx, {lab} as band from range({n}) r(i))"


def banded(src: str, keys: Sequence[str], value: str, total: str = "count(*)", style: str = "upper") -> str:
    """Long banded distribution of ``value`` over ``src`` per ``keys`` (zero-filled)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join_keys = " and ".join(f"c.{x} is not distinct from t.{x}" for x in keys)
    on = ("c.band_idx = d.band_idx" + (" and " + join_keys if keys else ""))
    notnull = " and ".join(f"{x} is not null" for x in keys) or "true"
    return f"""(with b as (select {kc}{band_idx(value)} as band_idx, {value} as _x from {src} where {notnull}),
  t as (select {kc}{total} as _total from b {"group by " + k if keys else ""}),
  c as (select {kc}band_idx, count(*) as n from b where band_idx is not null group by {kc}band_idx)
  select {", ".join("t." + x for x in keys)}{", " if keys else ""}d.band_idx, d.band, cast(coalesce(c.n, 0) as bigint) as n,
    {r2(pct("coalesce(c.n, 0)", "t._total"))} as pct, {cell("coalesce(c.n, 0)", pct("coalesce(c.n, 0)", "t._total"))} as cell
  from t cross join {band_domain(style)} d left join c on {on})"""


def erfc(x: str) -> str:
    """Same series / continued fraction as the Spark expression, with list_reduce."""
    from ..functions.stats import CF_TERMS, SERIES_TERMS, SWITCH
    inv = repr(1.0 / math.sqrt(math.pi))
    two_inv = repr(2.0 * (1.0 / math.sqrt(math.pi)))
    series = (f"list_reduce(range(0, {SERIES_TERMS}), lambda acc, n: {{'t': acc.t * (-({x} * {x})) / (n + 1), "
              f"'s': acc.s + acc.t / (2 * n + 1)}}, {{'t': cast({x} as double), 's': cast(0 as double)}}).s")
    fraction = f"list_reduce(range({CF_TERMS}, 0, -1), lambda acc, k: {x} + (k / 2.0) / acc, cast({x} as double))"
    return (f"(case when {x} is null then null when {x} < {SWITCH} then 1.0 - {two_inv} * {series} "
            f"else exp(-({x} * {x})) * {inv} / {fraction} end)")
