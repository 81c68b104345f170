"""Catalogue of a dataset's files, built by tasks from footers and first lines.

The driver lists the files; tasks open each one, read its parquet footer or its header line (never
the rows) and return one row per file: columns with types, rows, and the error of a file that
cannot be opened.  JSON lines have no header, so their keys are collected by a distributed pass
over the records.  Everything further is an aggregate over that small table: the files per header,
the files that lack a required column, and the union of all schemas.

The union is associative: per column the numbers' widest type wins (tinyint < smallint < int <
bigint, float < double, int < double, date < timestamp_ntz), equal types stay, and types without a common one
are a conflict that is listed with its files instead of being resolved by order.

A table that tasks wrote is a folder of part files: where the glob names a folder right below the path,
its files belong to the dataset and carry the folder's name (``entries`` adds their rows up again).

Defined cases: files of zero bytes hold nothing and are not listed; a header with repeated names
keeps them; a file that cannot be opened has ``error`` and no columns; no files give an empty
catalogue.
"""

from __future__ import annotations

import csv
import functools
import json
import re
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, length bigint, columns array<struct<name: string, type: string>>, rows bigint, header string, error string"
# Types that hold every value of the ones before them.
WIDENING = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("tinyint", "smallint", "int", "double"), ("date", "timestamp_ntz"))
FILES_PER_TASK = 256


def table_folders(spark: SparkSession, path: str | Sequence[str], glob: str | None, recursive: bool = False) -> tuple[list[str], list[str], list[str]]:
    """(files, folders, folders with ``key=value`` folders in them) right below ``path`` that ``glob`` names.

    Empty lists where none of them is a folder (then Spark's own file filter finds all) or ``recursive``
    asks for single files at any depth."""
    files: list[str] = []
    flat: list[str] = []
    keyed: list[str] = []
    if not glob or recursive:
        return files, flat, keyed
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for p in [path] if isinstance(path, str) else path:
        base = jvm.Path(p)
        fs = base.getFileSystem(conf)
        found = list(fs.globStatus(jvm.Path(base, glob)) or ())
        if not found and not isinstance(path, str) and fs.isFile(base) and jvm.GlobFilter(glob).accept(base):
            found = [fs.getFileStatus(base)]
        for s in found:
            if s.getPath().getName().startswith(("_", ".")):
                continue
            if not s.isDirectory():
                files.append(s.getPath().toString())
            elif any(c.isDirectory() and "=" in c.getPath().getName() for c in fs.listStatus(s.getPath())):
                keyed.append(s.getPath().toString())
            else:
                flat.append(s.getPath().toString())
    return (files, flat, keyed) if flat or keyed else ([], [], [])


def loaded(reader: Callable[[], DataFrameReader], spark: SparkSession, path: str | Sequence[str], glob: str | None, recursive: bool,
           then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The dataset by a reader, ``then`` applied to what it loads; folders that ``glob`` names are read whole.

    Folders with ``key=value`` folders are loaded each on its own (partition columns hold for a whole
    load) and united by name."""
    files, flat, keyed = table_folders(spark, path, glob, recursive)
    if not flat and not keyed:
        r = reader()
        r = r.option("pathGlobFilter", glob) if glob else r
        r = r.option("recursiveFileLookup", "true") if recursive else r
        return then(r.load(path if isinstance(path, str) else list(path)))
    parts = [then(reader().load(some)) for some in [files + flat, *[[k] for k in keyed]] if some]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def holder(path: Column, folders: Iterable[str]) -> Column:
    """The one of ``folders`` that a file lies in (full path, schemes' slashes single), null elsewhere."""
    def same(text: str) -> str:
        return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", text)

    where = F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    out = F.lit(None).cast("string")
    for root in sorted({same(f).rsplit("/", 1)[0] + "/" for f in folders}, key=len):  # the longest holds
        rest = F.substr(where, F.lit(len(root) + 1))
        out = F.when(where.startswith(root) & rest.contains("/"), F.concat(F.lit(root), F.substring_index(rest, "/", 1))).otherwise(out)
    return out


def entry_name(path: Column, folders: Iterable[str]) -> Column:
    """The name of the folder that holds a file, of the file itself where none of ``folders`` does."""
    return F.substring_index(F.coalesce(holder(path, folders), path), "/", -1)


def listing(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, length, modified`` of every file (a listing; contents are not read)."""
    return loaded(lambda: spark.read.format("binaryFile"), spark, path, glob, recursive,
                  lambda df: df.select("path", "length", F.col("modificationTime").alias("modified")))


def decoded(uri: Column) -> Column:
    """The path as listings show it, of a ``_metadata.file_path`` (which is percent-encoded)."""
    return F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def plain(path: Column) -> Column:
    """A path without the spellings of the local scheme's slashes."""
    return F.regexp_replace(path, "^file:/+", "/")


def opened(path: str):
    """(file system, path in it) for tasks; raises where only Spark knows the scheme."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if "/" in scheme or not rest:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def tasks_can_open(path: str) -> bool:
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def first_line(path: str, encoding: str = "utf-8") -> str:
    """The first line of a (possibly compressed, by its name) text file; reads in small pieces up to it."""
    system, where = opened(path)
    raw = b""
    with system.open_input_stream(where, compression="detect") as f:
        while b"\n" not in raw:
            more = f.read(1 << 14)
            if not more:
                break
            raw += more
    return raw.split(b"\n", 1)[0].decode(encoding).removesuffix("\r").removeprefix("﻿")


def _parquet(path: str) -> tuple[list[dict], int]:
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    system, where = opened(path)
    with system.open_input_file(where) as f:
        meta = pq.read_metadata(f)
    own = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if own:
        fields = [(x.name, x.dataType) for x in T.StructType.fromJson(json.loads(own)).fields]
    else:
        fields = [(x.name, from_arrow_type(x.type, prefer_timestamp_ntz=True)) for x in meta.schema.to_arrow_schema()]
    return [{"name": n, "type": t.simpleString()} for n, t in fields], meta.num_rows


def catalogue(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", glob: str | None = None,
              recursive: bool = False, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One row per file: path, length, columns, rows (parquet only), header (the line, CSV only), error."""
    files = listing(spark, path, glob, recursive).select("path", "length")
    if fmt == "json":
        return _json_catalogue(spark, files, path, glob, recursive)
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"no catalogue for {fmt}")

    def look(name: str, length: int) -> dict:
        out = {"path": name, "length": length, "columns": None, "rows": None, "header": None, "error": None}
        try:
            if fmt == "parquet":
                out["columns"], out["rows"] = _parquet(name)
            else:
                out["header"] = first_line(name)
                names = next(csv.reader([out["header"]], delimiter=delimiter, quotechar=quote), [])
                out["columns"] = [{"name": n, "type": "string"} for n in names]
        except Exception as e:  # the file's own fault, reported with its name
            out["error"] = f"{type(e).__name__}: {e}"[:300]
        return out

    arrow = pa.schema([("path", pa.string()), ("length", pa.int64()),
                       ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
                       ("rows", pa.int64()), ("header", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [look(p, n) for p, n in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.repartition(max(2, -(-files.count() // FILES_PER_TASK)), "path").mapInArrow(run, SCHEMA)


def _json_catalogue(spark: SparkSession, files: DataFrame, path, glob: str | None, recursive: bool) -> DataFrame:
    lines = loaded(lambda: spark.read.format("text"), spark, path, glob, recursive, lambda df: df.select(
        decoded(F.col("_metadata.file_path")).alias("_path"), F.json_object_keys("value").alias("keys")))
    named = lines.select("_path", F.explode("keys").alias("name")).distinct().groupBy("_path") \
        .agg(F.sort_array(F.collect_list(F.struct("name", F.lit("string").alias("type")))).alias("columns"))
    return files.join(named, plain(F.col("path")) == plain(F.col("_path")), "left").select("path", "length", F.coalesce("columns", F.array().cast(named.schema["columns"].dataType)).alias("columns"),
                                                   F.lit(None).cast("long").alias("rows"), F.lit(None).cast("string").alias("header"),
                                                   F.lit(None).cast("string").alias("error"))


def unreadable(cat: DataFrame) -> DataFrame:
    """path, error of the files that could not be opened."""
    return cat.where("error is not null").select("path", "error")


def lacking(cat: DataFrame, required: Iterable[str]) -> DataFrame:
    """path, missing: the readable files that do not have all ``required`` columns."""
    need = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    missing = F.array_sort(F.array_except(need, F.col("columns.name")))
    return cat.where("error is null").select("path", missing.alias("missing")).where(F.size("missing") > 0)


def headers(cat: DataFrame) -> DataFrame:
    """names, header, files, paths: the readable files per list of column names."""
    return cat.where("error is null").groupBy(F.col("columns.name").alias("names"), "header").agg(F.count(F.lit(1)).alias("files"), F.sort_array(F.collect_list("path")).alias("paths"))


def _holds(types: Column) -> Column:
    """The narrowest type that holds all of a set of type names, or null."""
    out = F.when(F.size(types) == 1, types[0])
    for chain in WIDENING:
        for k in range(1, len(chain)):
            out = out.when(F.size(F.array_except(types, F.array(*[F.lit(t) for t in chain[:k + 1]]))) == 0, F.lit(chain[k]))
    return out


def schema_union(cat: DataFrame) -> DataFrame:
    """column, type (null: conflict), types, files, place (smallest position) over all readable files."""
    each = cat.where("error is null").select(F.posexplode("columns").alias("place", "c"))
    merged = each.groupBy(F.col("c.name").alias("column")).agg(
        F.sort_array(F.collect_set("c.type")).alias("types"), F.count(F.lit(1)).alias("files"), F.min("place").alias("place"))
    return merged.select("column", _holds(F.col("types")).alias("type"), "types", "files", "place")


def entries(cat: DataFrame, folders: Iterable[str]) -> DataFrame:
    """The readable files of a catalogue with those of a folder as one: path, rows, columns (the union, each by its widest type)."""
    sound = cat.where("error is null").withColumn("path", F.coalesce(holder(F.col("path"), folders), F.col("path")))
    each = sound.select("path", F.posexplode("columns").alias("place", "c")).groupBy("path", F.col("c.name").alias("name")).agg(
        F.sort_array(F.collect_set("c.type")).alias("types"), F.min("place").alias("place"))
    columns = each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", _holds(F.col("types")).alias("type")))),
                                                   lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("columns"))
    none = F.array().cast("array<struct<name: string, type: string>>")
    return sound.groupBy("path").agg(F.sum("rows").alias("rows")).join(columns, "path", "left") \
        .select("path", "rows", F.coalesce("columns", none).alias("columns"))


def union_schema(cat: DataFrame) -> T.StructType:
    """The union as a schema, columns by (place, name); raises on conflicts with the types in question."""
    rows = schema_union(cat).orderBy("place", "column").collect()  # one row per column name
    bad = {r["column"]: r["types"] for r in rows if r["type"] is None}
    if bad:
        raise ValueError(f"columns with types that have none in common: {bad}")
    return T.StructType([T.StructField(r["column"], T._parse_datatype_string(r["type"])) for r in rows])


