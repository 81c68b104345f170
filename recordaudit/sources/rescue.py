"""Record-level rescue: what can be read is read, the rest goes to a quarantine, nothing is lost silently.

Text formats (CSV, JSON lines): every line is a record.  Spark's permissive parser keeps a line
that does not fit the schema as it stands; such lines, and lines that are no UTF-8, go to the
quarantine, and the next line is read as usual.  A file whose stream breaks off (a cut gzip file) gives
the lines before the break, and its end is listed as one quarantined place.

Parquet: the unit is a row group.  Tasks read every group of every file once; files without a fault
are then scanned by Spark as usual, of the others the sound groups are read group by group.  A
quarantined group carries its number of rows from the footer, so sound plus quarantined rows
are the footers' total.  A file without a readable footer is one quarantined place of unknown size.

``Rescued.good`` has the schema's columns and ``file_name``; ``Rescued.quarantine`` has path, place
(row group), record (the line), rows and reason.  Memory: one line, or one row group of one file per task;
files of any size.  Fields with line breaks are not records of one line: read such files with
``files.scan`` and ``multiLine``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue

FILE_NAME = "file_name"
QUARANTINE = "path string, place int, record string, rows bigint, reason string"
_DAMAGED = "_damaged_record"
_ARROW = pa.schema([("path", pa.string()), ("place", pa.int32()), ("record", pa.string()), ("rows", pa.int64()), ("reason", pa.string())])


class Rescued(NamedTuple):
    good: DataFrame
    quarantine: DataFrame


def broken_streams(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """QUARANTINE rows of text files whose (compressed) stream cannot be read to its end; read in pieces."""

    def fault(name: str) -> str | None:
        try:
            system, where = catalogue.opened(name)
            with system.open_input_stream(where, compression="detect") as f:
                while f.read(1 << 20):
                    pass
        except Exception as e:  # the file's own fault, reported with its name
            return f"{type(e).__name__}: {e}"[:300]
        return None

    def run(batches):
        for batch in batches:
            found = [(p, fault(p)) for p in batch.column("path").to_pylist()]
            rows = [{"path": p, "place": None, "record": None, "rows": None, "reason": f"stream breaks off: {why}"} for p, why in found if why]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return catalogue.listing(spark, path, glob, recursive).select("path").mapInArrow(run, QUARANTINE)


def rescue_text(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", schema: T.StructType | str | None = None,
                glob: str | None = None, recursive: bool = False, options: Mapping[str, str] | None = None) -> Rescued:
    """Good records and quarantine of line-based files.

    CSV files are read under their own headers: without ``schema`` all columns are strings and files
    with other headers are united by name; with it, a column takes the type the schema gives its name.  A line that
    repeats its file's header is no record.  JSON types are inferred from the lines that parse, unless
    given.  ``options`` go to the parser (``sep``, ``quote``, ...)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rules = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _DAMAGED} | dict(options or {})

    folders = [f for some in catalogue.table_folders(spark, path, glob, recursive)[1:] for f in some]

    def reader(fmt: str):
        return spark.read.format(fmt).option("ignoreCorruptFiles", "true")

    def lines(raw: DataFrame) -> DataFrame:
        where = catalogue.decoded(F.col("_metadata.file_path"))
        name = F.coalesce(F.substring_index(catalogue.holder(where, folders), "/", -1), F.col("_metadata.file_name")) if folders else F.col("_metadata.file_name")
        return raw.select(F.rtrim(F.ltrim("value", F.lit("\ufeff")), F.lit("\r")).alias("line"), name.alias(FILE_NAME), where.alias("path")) \
            .where(F.trim("line") != "")

    def parsed(rows: DataFrame, fields: list[T.StructField], parse) -> DataFrame:
        whole = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in [*fields, T.StructField(_DAMAGED, T.StringType())])
        text = F.is_valid_utf8("line")
        rows = rows.withColumns({"_text": text, "_row": F.when(text, parse(F.col("line"), whole, rules))})
        return rows.select("*", *[F.col("_row").getField(f.name).alias(f.name) for f in fields])

    if fmt == "json":
        fields = (schema or catalogue.loaded(lambda: reader("json").option("mode", "DROPMALFORMED"), spark, path, glob, recursive).schema).fields
        rows = parsed(catalogue.loaded(lambda: reader("text"), spark, path, glob, recursive, lines), list(fields), F.from_json)
    else:
        sep = rules.get("sep", rules.get("delimiter", ","))
        cat = catalogue.catalogue(spark, path, fmt, glob, recursive, sep, rules.get("quote", '"'))
        types = {f.name: f for f in schema.fields} if schema else {}
        groups = catalogue.headers(cat).collect()  # one row per header
        rows = parsed(spark.createDataFrame([], f"line string, {FILE_NAME} string, path string"), list(schema.fields) if schema else [], F.from_csv)
        for g in groups:
            names = [n if n not in g["names"][:k] else f"{n}_{k}" for k, n in enumerate(g["names"])]  # a repeated name counts on
            own = [types.get(n, T.StructField(n, T.StringType())) for n in names]
            part = parsed(lines(reader("text").load(list(g["paths"]))).where(F.col("line") != g["header"]), own, F.from_csv)
            rows = rows.withColumn("_row", F.col(f"_row.{_DAMAGED}")).unionByName(
                part.withColumn("_row", F.col(f"_row.{_DAMAGED}")), allowMissingColumns=True).withColumn("_row", F.struct(F.col("_row").alias(_DAMAGED)))
        fields = [T.StructField(c, T.StringType()) for c in rows.columns if c not in ("line", FILE_NAME, "path", "_text", "_row")]
        fields = list(schema.fields) if schema else fields
    sound = F.col("_text") & F.col(f"_row.{_DAMAGED}").isNull()
    good = rows.where(sound).select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in fields], FILE_NAME)
    bad = rows.where(~sound).select(
        "path", F.lit(None).cast("int").alias("place"), F.make_valid_utf8("line").alias("record"), F.lit(1).cast("long").alias("rows"),
        F.when(F.col("_text"), "does not fit the schema").otherwise("not UTF-8").alias("reason"))
    return Rescued(good, bad.unionByName(broken_streams(spark, path, glob, recursive)))


def _groups(spark: SparkSession, path: str | Sequence[str], glob: str | None, recursive: bool) -> DataFrame:
    """QUARANTINE columns for every row group of every file; ``reason`` is null where it can be read."""

    def run(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = []
                try:
                    system, where = catalogue.opened(name)
                    with system.open_input_file(where) as f:
                        file = pq.ParquetFile(f)
                        for g in range(file.num_row_groups):
                            why = None
                            try:
                                file.read_row_group(g, use_threads=False)
                            except Exception as e:  # this group's fault
                                why = f"{type(e).__name__}: {e}"[:300]
                            rows.append({"path": name, "place": g, "record": None, "rows": file.metadata.row_group(g).num_rows, "reason": why})
                except Exception as e:  # no footer
                    rows = [{"path": name, "place": None, "record": None, "rows": None, "reason": f"{type(e).__name__}: {e}"[:300]}]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return catalogue.listing(spark, path, glob, recursive).select("path").mapInArrow(run, QUARANTINE)


def rescue_parquet(spark: SparkSession, path: str | Sequence[str], store: str, glob: str | None = None, recursive: bool = False) -> Rescued:
    """Good rows and quarantine of parquet files; the row groups' states are written below ``store`` once."""
    target = f"{store.rstrip('/')}/row-groups"
    _groups(spark, path, glob, recursive).write.mode("overwrite").parquet(target)
    states = spark.read.schema(QUARANTINE).parquet(target)
    bad = states.where("reason is not null")
    by_file = states.groupBy("path").agg(F.count("reason").alias("faults"), F.count(F.when(F.col("reason").isNull(), 1)).alias("sound"))
    whole = [r["path"] for r in by_file.where("faults = 0 and sound > 0").select("path").collect()]  # one short string per file
    hurt = by_file.where("faults > 0 and sound > 0").select("path")
    cat = catalogue.catalogue(spark, path, "parquet", glob, recursive).join(by_file.where("sound > 0").select("path"), "path", "left_semi")
    schema = catalogue.union_schema(cat)
    scan = spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)
    folders = [f for some in catalogue.table_folders(spark, path, glob, recursive)[1:] for f in some]
    held = F.substring_index(catalogue.holder(catalogue.decoded(F.col("_metadata.file_path")), folders), "/", -1)
    scan = scan.withColumn(FILE_NAME, F.coalesce(held, F.col("_metadata.file_name")) if whole else F.lit(None).cast("string"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def read(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for name, place, entry in zip(*[batch.column(c).to_pylist() for c in ("path", "place", FILE_NAME)], strict=True):
                system, where = catalogue.opened(name)
                with system.open_input_file(where) as f:
                    t = pq.ParquetFile(f).read_row_group(place, use_threads=False)
                cols = [t[x.name].cast(x.type) if x.name in t.column_names else pa.nulls(t.num_rows, x.type) for x in arrow]
                file = pa.array([entry] * t.num_rows, pa.string())
                yield from pa.table([*cols, file], names=[*arrow.names, FILE_NAME]).to_batches()

    sound = states.where("reason is null").join(hurt, "path", "left_semi") \
        .select("path", "place", catalogue.entry_name(F.col("path"), folders).alias(FILE_NAME))
    rest = sound.repartition("path", "place").mapInArrow(read, T.StructType([*schema.fields, T.StructField(FILE_NAME, T.StringType())]))
    return Rescued(scan.unionByName(rest), bad)


def rescue(spark: SparkSession, path: str | Sequence[str], store: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
           glob: str | None = None, recursive: bool = False, options: Mapping[str, str] | None = None) -> DataFrame:
    """The good records; the quarantine is written to ``store``/quarantine (read it with :func:`quarantined`)."""
    out = rescue_parquet(spark, path, store, glob, recursive) if fmt == "parquet" else \
        rescue_text(spark, path, fmt, schema, glob, recursive, options)
    out.quarantine.write.mode("overwrite").parquet(f"{store.rstrip('/')}/quarantine")
    return out.good


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).parquet(f"{store.rstrip('/')}/quarantine")
