"""Scans and sinks.

One DataFrame over all files of a dataset, with the file name kept as a
column (``_metadata.file_name``) and model / language / version keys derived
from it as expressions -- instead of one table per file.  Schemas are
declared; messy columns are strings.  Sinks never overwrite the path being
read: every cleaning step commits a new version (``versions``).
"""

from __future__ import annotations

import csv
import functools
import gzip
import re
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import null_tokens
from . import catalogue, versions

FILE_NAME = "file_name"


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, length`` of every file (a listing; contents are not read)."""
    return catalogue.listing(spark, path, glob, recursive).select("path", "length")


def corrupt_files(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", glob: str | None = None,
                  recursive: bool = False) -> DataFrame:
    """``path, reason`` of every file that cannot be read to its end (full paths).

    Tasks read the files whole (one at a time, up to 2 GB each): parquet files by their row
    groups, text formats through gzip where the name says so, down to their last byte."""
    def reason(name: str, raw: bytes) -> str | None:
        try:
            if fmt == "parquet":
                import pyarrow.parquet as pq

                f = pq.ParquetFile(pa.BufferReader(raw))
                for g in range(f.num_row_groups):
                    f.read_row_group(g)
            else:
                (gzip.decompress(raw) if name.endswith(".gz") else raw).decode("utf-8")
        except Exception as e:
            return f"{type(e).__name__}: {e}"[:300]
        return None

    def check(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                why = reason(r["path"], r["content"])
                if why is not None:
                    yield pa.RecordBatch.from_pylist([{"path": r["path"], "reason": why}], pa.schema([("path", pa.string()), ("reason", pa.string())]))

    return catalogue.loaded(lambda: spark.read.format("binaryFile"), spark, path, glob, recursive, lambda df: df.select("path", "content")) \
        .mapInArrow(check, "path string, reason string")


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of a (possibly compressed) text file, through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    try:
        source = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("\ufeff")


def _by_header(spark: SparkSession, path: str | Sequence[str], paths: Sequence[str], fmt: str, glob: str | None,
               recursive: bool) -> dict[tuple[str, ...], list[str]]:
    """The files per list of columns, from the catalogue that tasks build.

    Only for formats without a catalogue, and for stores that only Spark can open, does the driver read
    the headers itself."""
    wanted = set(paths)
    if fmt in ("parquet", "csv", "json") and all(catalogue.tasks_can_open(p) for p in paths[:1]):
        cat = catalogue.catalogue(spark, path, fmt, glob, recursive)
        out: dict[tuple[str, ...], list[str]] = {}
        for r in catalogue.headers(cat).collect():
            out.setdefault(tuple(r["names"]), []).extend(p for p in r["paths"] if p in wanted)
        rest = wanted - {p for some in out.values() for p in some}
        if rest:
            raise ValueError(f"{len(rest)} files without a readable header, such as {sorted(rest)[:5]}")
        return {names: some for names, some in out.items() if some}
    out = {}
    for p in paths:
        if fmt == "csv":
            names = tuple(next(csv.reader([_first_line(spark, p)]), []))
        else:
            names = tuple(spark.read.format(fmt).load(p).columns)
        out.setdefault(names, []).append(p)
    return out


def scan(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
         schema: T.StructType | str | None = None, glob: str | None = None, recursive: bool = False,
         ignore_corrupt: bool = False, options: Mapping[str, str] | None = None,
         keys: Mapping[str, Column] | None = None, required: Iterable[str] = (), on_missing: str = "raise",
         with_path: bool = False, tables: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """Read every file of ``path`` (optionally filtered by ``glob``) into one frame with a
    ``file_name`` column and derived ``keys`` (expressions over ``file_name``).

    A folder right below ``path`` that ``glob`` names is a table in part files: its rows carry the
    folder's name as ``file_name``.  Files with different columns are united by name: CSV files by their own header each,
    parquet files by their merged schemas; a column that a file lacks is null there.  A
    corrupt file is an error; with ``ignore_corrupt`` whole bad files are left out
    (:func:`corrupt_files` lists them, to be written as a report).  ``with_path`` adds the full
    path as ``file_path``.  Where ``path`` is a list of files, ``tables`` names the folders that they may lie in
    (those without and with ``key=value`` folders).  ``required`` columns are checked per file: ``on_missing='raise'``, or ``'skip'`` to leave such files out."""
    need = list(required)
    if ignore_corrupt or fmt == "csv" and schema is None or need:
        paths = [r["path"] for r in list_files(spark, path, glob, recursive).collect()]  # one short string per file
        if ignore_corrupt:
            bad = {r["path"] for r in corrupt_files(spark, path, fmt, glob, recursive).select("path").collect()}
            paths = [p for p in paths if p not in bad]
        if not paths:
            raise ValueError(f"no readable file in {path}")
    else:
        paths = None

    flat, keyed = tables or catalogue.table_folders(spark, path, glob, recursive)[1:]
    folders = [*flat, *keyed]

    def reader(names: tuple[str, ...] | None = None) -> DataFrameReader:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        elif names is not None:
            reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        if fmt == "csv":
            reader = reader.option("header", "true").option("enforceSchema", "true" if names is not None else "false")
        if fmt == "parquet":
            reader = reader.option("mergeSchema", "true")
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        return reader

    def named(df: DataFrame) -> DataFrame:
        name = F.col("_metadata.file_name")
        if folders:
            held = catalogue.holder(catalogue.decoded(F.col("_metadata.file_path")), folders)
            name = F.coalesce(F.substring_index(held, "/", -1), name)
        return df.withColumns({FILE_NAME: name} | ({"file_path": F.col("_metadata.file_path")} if with_path else {}))

    def read(some: Sequence[str], names: tuple[str, ...] | None = None) -> DataFrame:
        below = {k: [p for p in some if p.startswith(f"{k}/")] for k in keyed}
        rest = sorted(set(some).difference(*below.values()))
        parts = [named(reader(names).load(rest))] if rest else []
        parts += [named(reader(names).option("basePath", k).load(own)) for k, own in below.items() if own]  # with its keys
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    if need or fmt == "csv" and schema is None:
        groups = _by_header(spark, path, paths, fmt, glob, recursive)
        lacking = {p: sorted(set(need) - set(names)) for names, some in groups.items() for p in some if set(need) - set(names)}
        if lacking and on_missing == "raise":
            raise ValueError(f"missing required columns: {lacking}")
        groups = {names: some for names, some in groups.items() if not set(need) - set(names)}
        if not groups:
            raise ValueError(f"no file of {path} has the columns {need}")
        if fmt == "csv" and schema is None:
            parts = [read(some, names) for names, some in groups.items()]
            df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        else:
            df = read([p for some in groups.values() for p in some])
    else:
        df = read(paths) if paths is not None else read(path) if tables else catalogue.loaded(reader, spark, path, glob, recursive, named)
    return df.withColumns(dict(keys)) if keys else df


def model_from_file(file_name: Column, suffix_pattern: str = r"(_v[0-9.]+)?\.[A-Za-z]+$") -> Column:
    """Model key = file name without the version tag and extension."""
    return F.regexp_replace(file_name, suffix_pattern, "")


def model_before(file_name: Column, marker: str, sep: str = "_") -> Column:
    """Model = text before ``marker`` when present, else before the first ``sep``."""
    return F.when(F.instr(file_name, marker) > 0, F.substring_index(file_name, marker, 1)) \
        .otherwise(F.substring_index(file_name, sep, 1))


def language_from_file(file_name: Column, marker: str = "chinese") -> Column:
    """'Chinese' when the lower-cased name contains ``marker``, else 'English'."""
    return F.when(F.lower(file_name).contains(marker), F.lit("Chinese")).otherwise(F.lit("English"))


def name_matches(file_name: Column, needles: Iterable[str]) -> Column:
    """Case-insensitive OR of substring tests on a dataset name."""
    low = F.lower(file_name)
    cond = F.lit(False)
    for n in needles:
        cond = cond | low.contains(n.lower())
    return cond


def rewrite_version(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ordered regex rewrites to a dataset name (``_v3.0`` -> ``_v3.2`` ...)."""
    out = name
    for pattern, repl in rules:
        out = F.regexp_replace(out, pattern, repl)
    return out


def skipped_files(spark: SparkSession, path: str, read: DataFrame, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Files listed under ``path`` that produced no rows in ``read`` (unreadable or empty), by name.
    ``read`` with a ``file_path`` column is compared by full path instead."""
    folders = [f for some in catalogue.table_folders(spark, path, glob, recursive)[1:] for f in some]
    listed = list_files(spark, path, glob, recursive).select(
        F.col("path").alias("file_path"), catalogue.entry_name(F.col("path"), folders).alias(FILE_NAME))
    by = "file_path" if "file_path" in read.columns else FILE_NAME
    out = listed.join(read.select(by).distinct(), by, "left_anti").select(FILE_NAME, *(["file_path"] if by == "file_path" else []))
    return out.distinct() if folders and by == FILE_NAME else out  # a table in part files is one entry


def require_columns(df: DataFrame, required: Iterable[str], optional: Iterable[str] = (),
                    on_missing: str = "raise") -> DataFrame | None:
    """Schema guard: required columns must exist (``'raise'`` or ``'skip'`` -> None);
    optional columns are kept when present and added as null when absent."""
    req, opt = list(required), list(optional)
    missing = [c for c in req if c not in df.columns]
    if missing:
        if on_missing == "skip":
            return None
        raise ValueError(f"missing required columns: {missing}")
    cols = [F.col(f"`{c}`") for c in req]
    cols += [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in opt]
    return df.select(*cols)


def normalize_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Ingest rule of the spreadsheet reader: null tokens in string columns become NULL."""
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields
                                                        if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_tokens(F.col(f"`{c}`")) for c in names})


def shape_report(df: DataFrame) -> DataFrame:
    """Rows, column count and each column's type, as a small frame."""
    spark = df.sparkSession
    types = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                  "column string, type string")
    rows = df.select(F.count(F.lit(1))).scalar()
    return types.withColumns({"n_rows": rows, "n_columns": F.lit(len(df.columns))})


def load_bundle(spark: SparkSession, directory: str, names: Iterable[str], fmt: str = "parquet",
                schemas: Mapping[str, T.StructType | str] | None = None) -> dict[str, DataFrame]:
    """Named tables of one bundle (the sheets of a workbook), one path per name."""
    out = {}
    for n in names:
        reader = spark.read.format(fmt)
        if schemas and n in schemas:
            reader = reader.schema(schemas[n])
        if fmt == "csv":
            reader = reader.option("header", "true")
        out[n] = reader.load(f"{directory.rstrip('/')}/{n}.{fmt}" if fmt != "delta" else f"{directory}/{n}")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Single-file report sink (reports are a few rows per model)."""
    w = df.coalesce(1).write.mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet",
                      mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """One output directory per key combination (model / group / language ...), in one pass over the plan.

    Rows are rebalanced by the keys: at run time Spark gives a key's rows to one task, splits the
    tasks that grow beyond the advisory partition size and joins small ones, so a hot key spreads
    and a cold key is one file.  No file has more than ``rows_per_file`` rows.
    """
    keys = ", ".join(f"`{k.replace('`', '``')}`" for k in partition_by)
    out = df.sparkSession.sql(f"SELECT /*+ REBALANCE({keys}) */ * FROM {{df}}", df=df)
    w = out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def _local(path: str) -> str:
    """Drop a ``file:`` scheme so local and URI forms compare equal."""
    return re.sub(r"^file:/+", "/", path)


def reads_below(df: DataFrame, target: str) -> bool:
    """Whether the plan's scans read ``target`` or something in it (whole path segments; the
    scans' root paths, not their files)."""
    roots: list[str] = []

    def walk(node) -> None:
        if node.getClass().getSimpleName() == "LogicalRelation" and hasattr(node.relation(), "location"):
            paths = node.relation().location().rootPaths()
            roots.extend(paths.apply(i).toString() for i in range(paths.size()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().analyzed())
    want = _local(target).rstrip("/").split("/")
    parts = [_local(r).rstrip("/").split("/") for r in roots]
    return any(p[:len(want)] == want or want[:len(p)] == p for p in parts)


def current_version(spark: SparkSession, base: str) -> str | None:
    """The version that the log of ``base`` ends with, or None."""
    entry = versions.current(spark, base)
    if entry is not None:
        return entry.version
    try:  # datasets written before there was a log
        row = spark.read.text(f"{base.rstrip('/')}/_current").first()
    except Exception:
        return None
    return row["value"] if row else None


def write_version(df: DataFrame, base: str, version: str, partition_by: Sequence[str] = (),
                  fmt: str = "parquet") -> str:
    """Write a cleaning step's output as a version of ``base`` and commit it to the log; its path.

    Refuses to replace a version the plan itself reads.  The data appear whole or not at all: a
    failed job leaves the old version current, rerunning it is idempotent, and of two writers of
    one version the slower gets a ``versions.VersionConflict``."""
    spark = df.sparkSession
    begun = versions.begin(spark, base)
    held = {f"version={version}"} | {e.path for e in versions.log(spark, base) if e.version == version}
    if any(reads_below(df, f"{begun.base}/{p}") for p in held):
        raise ValueError("refusing to overwrite the version being read; write a new version")

    def write(folder: str) -> None:
        if partition_by:
            write_partitioned(df, folder, partition_by, fmt)
        else:
            df.write.format(fmt).save(folder)

    return f"{begun.base}/{versions.commit(spark, begun, version, write).path}"
