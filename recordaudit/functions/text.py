"""String, number-format and null-token expressions (Column -> Column).

All of these compile to JVM expressions inside whole-stage codegen; none of
them calls Python per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for equal results)
# ---------------------------------------------------------------------------
# Null tokens that the spreadsheet/CSV reader of the reference turns into NaN
# (the pandas default na_values list), matched exactly.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Administrative suffixes removed once from the end of a place name.
ADMIN_SUFFIX_PATTERN = r"(省|市|区|县|自治州|盟|地区|特别行政区)$"
# Text standing for a missing value when a length is taken (Python str(None-like NaN)).
NULL_TEXT = "nan"
# Every Unicode decimal digit (what Python's \\d and int() accept) and its ASCII
# value, built by rule; full-width digits are among them.
UNICODE_DIGITS = "".join(chr(c) for c in range(0x80, 0x110000) if chr(c).isdecimal())
ASCII_DIGITS = "".join(str(unicodedata.decimal(ch)) for ch in UNICODE_DIGITS)
# Characters Python's str.strip() removes: derived from str.isspace (29 code points,
# incl. the ASCII separators 0x1c-0x1f and the ideographic space).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def as_text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def py_strip(c: Column | str) -> Column:
    """Trim all Unicode white space at both ends (Python ``str.strip()``); a plain
    character-set trim, no regex."""
    return F.btrim(as_text(c), F.lit(PY_WHITESPACE))


def norm_lower(c: Column | str) -> Column:
    """``str(x).strip().lower()``; null stays null."""
    return F.lower(py_strip(c))


def ascii_digits(c: Column) -> Column:
    """Map every Unicode decimal digit (full-width, Arabic-Indic ...) to ASCII so a
    cast reads it as Python's int() would."""
    return F.translate(c, UNICODE_DIGITS, ASCII_DIGITS)


def null_tokens(c: Column | str, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Ingest rule: a string equal to one of ``tokens`` becomes NULL."""
    s = as_text(c)
    return F.when(s.isin(list(tokens)), F.lit(None).cast("string")).otherwise(s)


def strip_admin_suffix(c: Column | str, pattern: str = ADMIN_SUFFIX_PATTERN) -> Column:
    """Remove one administrative suffix at the end of a place name."""
    return F.regexp_replace(as_text(c), pattern, "")


def round_half_even(x: Column, digits: int = 2) -> Column:
    """``numpy.round``: ``rint(x * 10^d) / 10^d`` (not Spark's half-up ``round``)."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def count_pct_cell(n: Column, pct: Column) -> Column:
    """Report cell ``"12 (3.0%)"`` from a count and an unrounded percentage."""
    return F.concat(n.cast("string"), F.lit(" ("), round_half_even(pct, 2).cast("string"), F.lit("%)"))


def cell_count(c: Column | str) -> Column:
    """Count back out of a ``"n (p%)"`` cell; plain numbers pass through."""
    s = as_text(c)
    from_cell = F.regexp_extract(s, r"(?U)(\d+)\s*\(", 1)
    return F.coalesce(ascii_digits(from_cell).try_cast("bigint"), py_strip(s).try_cast("double").try_cast("bigint"))


def param_size(c: Column | str, case_insensitive: bool = False) -> Column:
    """Parameter count in billions written in a model name (``7B`` -> 7.0); 0 if none."""
    pattern = r"(?U)(\d+\.?\d*)[Bb]" if case_insensitive else r"(?U)(\d+\.?\d*)B"
    size = F.regexp_extract(as_text(c), pattern, 1)
    return F.coalesce(ascii_digits(size).try_cast("double"), F.lit(0.0))


def safe_name(c: Column | str) -> Column:
    """Path-safe model name: ``/`` and ``:`` become ``_``."""
    return F.translate(as_text(c), "/:", "__")


def text_length(c: Column | str, null_length: int | None = 3) -> Column:
    """Characters (code points) of the text; a null counts as ``'nan'`` by default."""
    s = as_text(c)
    if null_length is None:
        return F.length(s)
    return F.coalesce(F.length(s), F.lit(null_length)).cast("int")


def fill_template(template: Column, placeholder: str, value: Column) -> Column:
    """Literal (not regex) placeholder substitution."""
    return F.replace(template, F.lit(placeholder), value)


def strip_braces(c: Column | str) -> Column:
    return F.translate(as_text(c), "{}", "")


def assemble_prompt(prefix: Column, background: Column | None, suffix: Column | None,
                    line_sep: str = "\n", block_sep: str = "\n\n") -> Column:
    """``prefix + line_sep + background`` then the output template after ``block_sep``."""
    head = prefix if background is None else F.concat(prefix, F.lit(line_sep), background)
    if suffix is None:
        return head
    return F.concat(head, F.lit(block_sep), suffix)


def cut_at_stop_tokens(c: Column | str, stop: Iterable[str], literal: bool = True) -> Column:
    """Keep the text before the first stop token (regex alternation when ``literal=False``)."""
    tokens = list(stop)
    if not tokens:
        return as_text(c)
    parts = [rf"\Q{t}\E" for t in tokens] if literal else tokens
    return F.split(as_text(c), "|".join(parts), 2).getItem(0)


def _python_float_text(x: Column, formatted: Column) -> Column:
    """Null stays null (Java would print "null"); NaN / infinities print as Python does."""
    d = x.cast("double")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("nan"))
            .when(d == float("inf"), F.lit("inf"))
            .when(d == float("-inf"), F.lit("-inf"))
            .otherwise(formatted))


def fixed2(x: Column) -> Column:
    """Text with 2 decimals of the exact binary value (``f'{x:.2f}'``): 0.015, which is stored a little
    below, is ``0.01``; only values that lie exactly in the middle (0.125) go to the even neighbour.

    The fraction times 100 is rounded to a double; its rounding error, exact by splitting the fraction
    into halves whose products need no rounding, decides where the product says "one half"."""
    d = x.cast("double")
    size = F.abs(d)
    whole = F.floor(size)  # a long: exact below 2**62
    part = size - whole.cast("double")
    shifted = part * 134217729.0  # 2**27 + 1
    high = shifted - (shifted - part)
    product = part * 100.0
    error = (high * 100.0 - product) + (part - high) * 100.0
    down = F.floor(product)
    rest = product - down.cast("double")
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0.0) | ((error == 0.0) & (down % 2 == 1))))
    cents = down + up.cast("long")  # 0 to 100
    sign = F.when(d.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, (whole + F.when(cents == 100, 1).otherwise(0)).cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))
    return _python_float_text(x, F.when(size < float(1 << 62), text).otherwise(F.format_string("%.2f", d)))


def sci4(x: Column) -> Column:
    """Scientific text with 4 decimals (``f'{x:.4e}'``)."""
    return _python_float_text(x, F.format_string("%.4e", x.cast("double")))


def label_by_substring(c: Column | str, rules: "dict[str, Iterable[str]]", default: Column | None = None) -> Column:
    """First label whose needles occur in the lower-cased text (e.g. 'Type 1 diabetes'
    -> 'T1DM' for needles 'type 1' / 't1dm'); otherwise ``default`` (the text itself)."""
    s = as_text(c)
    low = F.lower(s)
    out = None
    for label, needles in rules.items():
        cond = F.lit(False)
        for n in needles:
            cond = cond | F.coalesce(low.contains(n.lower()), F.lit(False))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    fallback = s if default is None else default
    return fallback if out is None else out.otherwise(fallback)
