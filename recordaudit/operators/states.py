"""Profiles that are kept up to date file by file.

Banded, categorical and coverage profiles are sums of counts, so the counts of a file never
change while the file does not.  :func:`update` lists the dataset, reads only the files that the store
does not know (by path, length and modification time), and adds their counts; :func:`merged`
adds up the counts of the files that the dataset holds now.  Files that changed or went away
drop out because their old identity is no longer listed.  A table in part files (a folder that ``glob`` names)
is kept up to date part by part and counts as one file.

The store is a folder of sessions, one per update, each written by one Spark job that appears whole
(its ``_SUCCESS`` counts) and holds the counts and one row per file that was read, so files
without rows are known, too.  Where two updates ran side by side and read the same file, the
first session's counts hold.  A profile's definition is part of the identity: a changed one is
computed anew.  Counts are one row per (file, group, column, band or category), so a run over
unchanged files reads the store and no record.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogue, files
from . import coverage, profile

STATE = ("path string, length bigint, modified timestamp, definition string, profile string, keys array<string>, "
         "part int, slot int, numeric boolean, n bigint")
_FILE = "(file)"  # the profile name of the row that marks a file as read


@dataclass(frozen=True)
class Profile:
    """What to count.  ``columns`` are text names to expressions over the records (SQL text, so a definition can be compared).

    kind ``band``: bands of numeric columns; ``category``: the values of ``domain``; ``coverage``: the
    four age and gender cases, with columns ``{label: (age, gender)}``."""

    name: str
    kind: str
    by: Sequence[str]
    columns: Mapping[str, str | tuple[str, str]]
    domain: Sequence[str] = tuple(profile.GENDER_DOMAIN)
    label_style: str = "upper"
    denominator: str = "all"
    options: Mapping[str, float] = field(default_factory=dict)  # width, low, high of the bands

    def definition(self) -> str:
        text = repr((self.kind, list(self.by), list(self.columns.items()), list(self.domain) if self.kind == "category" else None,
                     sorted(self.options.items())))
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def slots(self) -> list[Column]:
        """(part, slot, numeric) of a row for every column; slot null: outside all bands or categories."""
        out = []
        for part, expr in enumerate(self.columns.values()):
            if self.kind == "band":
                x = F.expr(expr).cast("double")
                slot, numeric = profile.band_index(x, **self.options), x.isNotNull()
            elif self.kind == "category":
                v = F.expr(expr)
                slot = F.coalesce(*[F.when(v == F.lit(d), F.lit(i)) for i, d in enumerate(self.domain)])
                numeric = F.lit(False)
            elif self.kind == "coverage":
                case = coverage.coverage_case(*[F.expr(e) for e in expr])
                slot = F.coalesce(*[F.when(case == F.lit(full), F.lit(i)) for i, (_, full) in enumerate(coverage.CASE_COLUMNS)])
                numeric = F.lit(False)
            else:
                raise ValueError(f"unknown profile {self.kind!r}")
            out.append(F.struct(F.lit(part).alias("part"), slot.alias("slot"), numeric.alias("numeric")))
        return out


def _counts(records: DataFrame, p: Profile) -> DataFrame:
    keys = F.array(*[F.col(f"`{k}`").cast("string") for k in p.by]) if p.by else F.array().cast("array<string>")
    rows = records
    if p.kind != "coverage":  # null groups are dropped there, and kept here
        for k in p.by:
            rows = rows.where(F.col(f"`{k}`").isNotNull())
    return rows.select("file_path", keys.alias("keys"), F.inline(F.array(*p.slots()))) \
        .groupBy("file_path", "keys", "part", "slot", "numeric").agg(F.count(F.lit(1)).alias("n")) \
        .withColumns({"profile": F.lit(p.name), "definition": F.lit(p.definition())})


def _sessions(spark: SparkSession, store: str) -> list[str]:
    jvm = spark._jvm.org.apache.hadoop.fs
    base = jvm.Path(store)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("session-")]
    return sorted(f.toString() for f in found if fs.exists(jvm.Path(f, "_SUCCESS")))


def _stored(spark: SparkSession, store: str) -> DataFrame:
    found = _sessions(spark, store)
    if not found:
        return spark.createDataFrame([], STATE + ", session string")
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.schema(STATE).parquet(*found).select("*", session.alias("session"))


def _listed(spark: SparkSession, path: str | Sequence[str], glob: str | None, recursive: bool) -> DataFrame:
    rows = catalogue.listing(spark, path, glob, recursive)
    return rows.select("path", "length", "modified")


def update(spark: SparkSession, store: str, path: str | Sequence[str], profiles: Sequence[Profile], fmt: str = "parquet",
           glob: str | None = None, recursive: bool = False, prepare: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Add the counts of files that are new or changed; how many files were read (a folder of part files is one).

    ``prepare`` maps the scanned records (with ``file_name`` and ``file_path``) to those that are counted."""
    known = _stored(spark, store).where(F.col("profile") == _FILE).select("path", "length", "modified", "definition").distinct()
    wanted = hashlib.sha256("".join(sorted(p.name + p.definition() for p in profiles)).encode()).hexdigest()[:16]
    fresh = _listed(spark, path, glob, recursive).join(known.where(F.col("definition") == wanted), ["path", "length", "modified"], "left_anti")
    flat, keyed = catalogue.table_folders(spark, path, glob, recursive)[1:]
    entry = F.coalesce(catalogue.holder(F.col("path"), [*flat, *keyed]), F.col("path"))
    found = fresh.select("path", entry.alias("entry")).collect()  # two short strings per file to read
    paths = [r["path"] for r in found]
    if not paths:
        return 0
    records = files.scan(spark, paths, fmt, with_path=True, tables=(flat, keyed))
    records = prepare(records) if prepare else records
    counts = None
    for p in profiles:
        part = _counts(records, p)
        counts = part if counts is None else counts.unionByName(part)
    fresh = fresh.withColumn("_plain", catalogue.plain(F.col("path")))
    rows = counts.withColumn("_plain", catalogue.plain(catalogue.decoded(F.col("file_path")))).join(fresh, "_plain").select(*[c.split()[0] for c in STATE.split(", ")])
    marks = fresh.select("path", "length", "modified", F.lit(wanted).alias("definition"), F.lit(_FILE).alias("profile"),
                         F.array().cast("array<string>").alias("keys"), F.lit(0).alias("part"), F.lit(0).alias("slot"), F.lit(False).alias("numeric"),
                         F.lit(0).cast("long").alias("n"))
    rows.unionByName(marks).write.parquet(f"{store.rstrip('/')}/session-{time.time_ns():020d}-{uuid.uuid4().hex}")
    return len({r["entry"] for r in found})


def merged(spark: SparkSession, store: str, path: str | Sequence[str], p: Profile, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """keys, part, slot, numeric, n over the files that the dataset holds now."""
    rows = _stored(spark, store).where((F.col("profile") == p.name) & (F.col("definition") == p.definition()))
    identity = ["path", "length", "modified"]
    rows = rows.join(_listed(spark, path, glob, recursive), identity, "left_semi")
    first = rows.groupBy(*identity).agg(F.min("session").alias("session"))  # of updates that ran side by side
    return rows.join(first, [*identity, "session"]).groupBy("keys", "part", "slot", "numeric").agg(F.sum("n").alias("n"))


def report(spark: SparkSession, store: str, path: str | Sequence[str], p: Profile, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """The profile's report, as a full run over the files gives it (group keys as text)."""
    rows = merged(spark, store, path, p, glob, recursive)
    keys = list(p.by)
    rows = rows.select(*[F.col("keys")[i].alias(k) for i, k in enumerate(keys)], "part", "slot", "numeric", "n")
    if p.kind == "band":
        labels = profile.band_labels(**{k: int(v) for k, v in p.options.items()}, style=p.label_style)
        counted = rows.withColumnsRenamed({"part": "_col", "slot": "_band", "numeric": "_num", "n": "_n"})
        return profile.band_report(counted, keys, list(p.columns), labels, p.denominator)
    if p.kind == "category":
        named = rows.withColumn("column", F.get(F.array(*[F.lit(c) for c in p.columns]), F.col("part")))
        per = named.groupBy(*keys, "column").agg(F.sum("n").alias("_total"), *[
            F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(f"_n{i}") for i in range(len(p.domain))])
        return profile.category_report(per, [*keys, "column"], list(p.domain))
    cells = [F.coalesce(F.sum(F.when((F.col("part") == i) & (F.col("slot") == j), F.col("n"))), F.lit(0)).alias(f"{label}: {short}")
             for i, label in enumerate(p.columns) for j, (short, _) in enumerate(coverage.CASE_COLUMNS)]
    return rows.groupBy(F.col(keys[0]).alias("Model")).agg(*cells).orderBy("Model")
