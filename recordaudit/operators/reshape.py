"""Long <-> wide report reshaping.

The long form ``(group, category, n, pct, cell)`` is canonical; the wide
report (one column per group) is a pivot of it, and reading a wide report
back is an unpivot plus :func:`cell_count`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_count
from ..session import freeze


def pivot_report(long: DataFrame, index: Sequence[str], columns: str, cell: str = "cell",
                 values: Sequence | None = None) -> DataFrame:
    """Rows = ``index``, one column per value of ``columns``, holding ``cell``.

    Pass ``values`` to fix the column order.  Without them Spark first runs a
    distinct job over the pivot input; the (small) long report is materialized
    once so that job and the pivot do not both recompute the upstream plan.
    """
    if values is None:
        long = freeze(long)
    grouped = long.groupBy(*index)
    pivoted = grouped.pivot(columns, list(values)) if values is not None else grouped.pivot(columns)
    # rows in domain order (band / category index), like the reference's sorted report
    return pivoted.agg(F.max(cell)).orderBy(*[F.col(f"`{c}`") for c in index])


def unpivot_report(wide: DataFrame, index: Sequence[str], columns: Sequence[str] | None = None,
                   variable: str = "group", value: str = "cell") -> DataFrame:
    """Wide report back to ``index..., variable, value``; every cell read as text."""
    cols = list(columns) if columns is not None else [c for c in wide.columns if c not in index]
    as_text = wide.select(*index, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return as_text.unpivot(list(index), cols, variable, value)


def report_counts(wide: DataFrame, index: Sequence[str], columns: Sequence[str] | None = None,
                  variable: str = "group", value: str = "cell") -> DataFrame:
    """Unpivot a ``"n (p%)"`` report and parse the counts back out (``n``)."""
    long = unpivot_report(wide, index, columns, variable, value)
    return long.withColumn("n", cell_count(F.col(value)))


def project_available(df: DataFrame, order: Sequence[str], rest: bool = False) -> DataFrame:
    """Columns of ``order`` that exist, in that order (optionally followed by the rest)."""
    cols = [c for c in order if c in df.columns]
    if rest:
        cols += [c for c in df.columns if c not in cols]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def select_matching(df: DataFrame, markers: Sequence[str], keep: Sequence[str] = (), require_all: bool = False) -> DataFrame:
    """``keep`` columns plus every column whose name contains any (or all) of ``markers``."""
    test = all if require_all else any
    cols = list(keep) + [c for c in df.columns if c not in keep and test(m in c for m in markers)]
    return df.select(*[F.col(f"`{c}`") for c in cols])
