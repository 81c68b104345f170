"""Age text cleaners and presence tests (Column -> Column).

Rule order is the whole semantics: every cleaner is one ``CASE WHEN`` chain,
first matching rule wins, exactly like the reference's early returns.  ``\\d``
and ``\\s`` run with ``(?U)`` so Unicode digits and spaces behave as in Python's
``re``; every Unicode decimal digit is mapped to ASCII before a cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_text, ascii_digits, py_strip

# Patterns of the age cleaners, anchored at the start (re.match).
DIGITS_ONLY = r"(?U)^\d+$"
YEARS_SUFFIX = r"(?U)^(\d+)岁"              # "25岁", "50岁以上", "25岁左右"
YEARS_OLD = r"(?U)(?i)^(\d+)\s*years? old"  # "25 years old", any case
AGE_RANGE = r"(?U)^(\d+)-(\d+)"             # "25-34岁", "30-50岁之间" -> midpoint
AGE_PLUS = r"(?U)^(\d+)多岁"                # "30多岁" -> 30
FIRST_NUMBER = r"(?U)(\d+)"
MONTHS_V1 = ["个月", "周龄"]                 # infant ages -> 0 (v1)
MONTHS_V2 = ["个月", "周", "天"]              # infant ages -> 0 (v2)
AGE_MIN, AGE_MAX = 0, 120
# A number that pandas.to_numeric accepts (ASCII digits only).
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Digits with at most one dot ("25", "25.5", ".5", "25.").
DOTTED_DIGITS = r"(?U)^(\d+\.?\d*|\.\d+)$"


def _num(s: Column) -> Column:
    return ascii_digits(s).try_cast("bigint")


def _group(s: Column, pattern: str, i: int = 1) -> Column:
    return _num(F.regexp_extract(s, pattern, i))


def _midpoint(s: Column) -> Column:
    # try_add: an absurd range ("9223372036854775807-9") gives null instead of an ANSI overflow error
    return F.floor(F.try_add(_group(s, AGE_RANGE, 1), _group(s, AGE_RANGE, 2)) / F.lit(2)).cast("bigint")


def _contains_any(s: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.coalesce(s.contains(w), F.lit(False))
    return cond


def clean_age_v1(c: Column | str) -> Column:
    """First cleaner: digits, N岁…, N years old, A-B (midpoint), N多岁, months -> 0, else null."""
    s = py_strip(c)
    return (
        F.when(s.isNull(), F.lit(None).cast("bigint"))
        .when(s.rlike(DIGITS_ONLY), _num(s))
        .when(s.rlike(YEARS_SUFFIX), _group(s, YEARS_SUFFIX))
        .when(s.rlike(YEARS_OLD), _group(s, YEARS_OLD))
        .when(s.rlike(AGE_RANGE), _midpoint(s))
        .when(s.rlike(AGE_PLUS), _group(s, AGE_PLUS))
        .when(_contains_any(s, MONTHS_V1), F.lit(0).cast("bigint"))
    )


def clean_age_v2(c: Column | str, mask: bool = True) -> Column:
    """Second cleaner: pure digits must be in range; same rules; then the first
    number anywhere if in range; then months/weeks/days -> 0.  With ``mask`` the
    0..120 range mask and the integer cast of the cleaning step follow."""
    s = py_strip(c)
    digits = _num(s)
    first = _group(s, FIRST_NUMBER)
    raw = (
        F.when(s.isNull(), F.lit(None).cast("bigint"))
        .when(s.rlike(DIGITS_ONLY), F.when(digits.between(AGE_MIN, AGE_MAX), digits))
        .when(s.rlike(YEARS_SUFFIX), _group(s, YEARS_SUFFIX))
        .when(s.rlike(YEARS_OLD), _group(s, YEARS_OLD))
        .when(s.rlike(AGE_RANGE), _midpoint(s))
        .when(s.rlike(AGE_PLUS), _group(s, AGE_PLUS))
        .when(s.rlike(FIRST_NUMBER) & first.between(AGE_MIN, AGE_MAX), first)
        .when(_contains_any(s, MONTHS_V2), F.lit(0).cast("bigint"))
    )
    if not mask:
        return raw
    # the range mask as a lookup in AGE_MIN..AGE_MAX (null outside): it names the rules' result once,
    # so the rules are not evaluated again
    return F.get(F.sequence(F.lit(int(AGE_MIN)), F.lit(int(AGE_MAX))), (raw - F.lit(int(AGE_MIN))).try_cast("int"))


def digits_only(c: Column | str) -> Column:
    """Drop everything but ``0-9`` and ``.``, then read a number (``'25-34岁'`` -> 2534.0)."""
    kept = F.regexp_replace(as_text(c), r"[^0-9.]", "")
    return F.when(kept.rlike(r"^(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def first_number(c: Column | str, lo: float = AGE_MIN, hi: float = AGE_MAX) -> Column:
    """First run of digits anywhere, as double, kept only inside ``[lo, hi]``."""
    s = as_text(c)
    v = ascii_digits(F.regexp_extract(s, FIRST_NUMBER, 1)).try_cast("double")
    return F.when(v.between(lo, hi), v)


def numeric_coerce(c: Column | str) -> Column:
    """``pandas.to_numeric(errors='coerce')`` on text: bad values become null."""
    s = as_text(c)
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def to_int(c: Column | str) -> Column:
    """Float -> int by truncation, null kept."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("int")


def range_mask(c: Column | str, lo: float = AGE_MIN, hi: float = AGE_MAX) -> Column:
    """Keep the value when ``lo <= x <= hi`` else null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.between(lo, hi), col)


def is_invalid(c: Column | str, lo: float = AGE_MIN, hi: float = AGE_MAX, text: bool = False) -> Column:
    """Not a number inside ``[lo, hi]``; null counts as invalid.  With ``text`` the
    value is first read as a number (a number stored as text is then valid)."""
    col = F.col(c) if isinstance(c, str) else c
    num = numeric_coerce(col) if text else col
    return ~F.coalesce(num.between(lo, hi), F.lit(False))


def age_present(c: Column | str) -> Column:
    """Coverage rule: not null, not 'unknown', digits with at most one dot."""
    s = as_text(c)
    return F.coalesce(
        s.isNotNull() & (F.lower(s) != F.lit("unknown")) & s.rlike(DOTTED_DIGITS), F.lit(False)
    )
