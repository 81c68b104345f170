"""Positional and keyed alignment of tables, numbering, unions.

Spark rows have no order, so a position is always derived from an explicit
ordering key by :func:`dense_position`: range buckets, found by binary search in a table of bounds, row
numbers within a bucket, and the buckets' counts turned into offsets.  The only
derived state is one row per (bucket, group), so no single-partition window ever
holds the data, whatever the group sizes, and nothing is written.
Keyed alignment (the default for pairing) is a plain equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(name: str) -> str:
    return f"`{name}`"


def _range_bounds(keyed: DataFrame, keys: Sequence[str], parts: int, per_part: int = 20) -> DataFrame:
    """One row, one sorted array ``bounds`` of at most ``parts - 1`` rows of ``keys`` that cut the table
    into parts of similar size.

    They are every ``size / parts``-th of the distinct rows whose hash of the tie-breaker falls into the
    share of the hash range that holds about ``parts * per_part`` rows, so they depend on the rows
    alone; repeated rows count once.  Picked once and kept as a local relation."""
    total = keyed.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = (F.xxhash64("_tie", F.lit(17)).cast("double") / float(2 ** 64) + 0.5) * total
    sample = keyed.select(*keys).where(share < parts * per_part).distinct()
    found = sample.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("found"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda i: F.get("found", (i * F.size("found") / parts).cast("int")))
    thin = found.select(F.slice(cut, 1, F.when(F.size("found") > 0, parts - 1).otherwise(0)).alias("bounds"))
    return keyed.sparkSession.createDataFrame(thin.toArrow(), thin.schema)


def _bucket(placed: DataFrame, row: Column, bounds: DataFrame, parts: int) -> DataFrame:
    """``_bucket``: the number of bounds at or below ``row``, by a binary search of one projection per
    halving; the plan grows with the logarithm of ``parts``."""
    placed = placed.withColumn("_bucket", F.lit(0))
    for k in reversed(range(max(parts - 1, 0).bit_length())):
        at = F.get(bounds.scalar(), F.col("_bucket") + F.lit((1 << k) - 1))  # null beyond the last bound
        placed = placed.withColumn("_bucket", F.col("_bucket") + F.when(at <= row, 1 << k).otherwise(0))
    return placed


def dense_position(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                   name: str = "pos", start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based (``start``) row number in ``order_by`` order,
    restarted for every ``partition_by`` group -- a distributed ``row_number``.

    The order is ``partition_by + order_by`` and then a hash of the whole row, so it is total
    but for identical rows, and ties spread over tasks.  A distributed prefix sum: range bounds are
    picked once from a sample, a row's bucket is found in their sorted table by binary search, row numbers
    run within a bucket, and the buckets' counts (one row per bucket and group) give the offsets.
    The bounds are a table of their own, so plan and build time do not grow with them, and the rows
    come out the same however often the plan is evaluated, without a checkpoint.
    """
    keys = [*partition_by, *order_by]
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(_q(f.name)) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = df.withColumns({f"_k{i}": F.col(_q(k)) for i, k in enumerate(keys)} | {"_tie": F.xxhash64(*hashed)})
    cols = [f"_k{i}" for i in range(len(keys))] + ["_tie"]
    placed = _bucket(keyed, F.struct(*cols), _range_bounds(keyed, cols, parts), parts)
    groups = cols[:len(partition_by)]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_bucket", *groups).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(F.col("_bucket").alias("_ob"), *[F.col(g).alias(f"_o{g}") for g in groups],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket", *groups).orderBy(*cols)))
    cond = [F.col("_bucket") == F.col("_ob")] + [F.col(g).eqNullSafe(F.col(f"_o{g}")) for g in groups]
    pos = F.col("_off") + F.col("_row") + F.lit(start - 1)
    return numbered.join(offsets, cond).select(*[F.col(_q(c)) for c in df.columns if c != name], pos.alias(name))


def number_rows(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                name: str = "seq", start: int = 1) -> DataFrame:
    """1-based (or 0-based with ``start=0``) numbering per output group."""
    return dense_position(df, order_by, partition_by, name=name, start=start)


def copy_column_strict(source: DataFrame, target: DataFrame, column: str,
                       source_order: Sequence[str], target_order: Sequence[str]) -> DataFrame:
    """Copy ``column`` by row position; the row counts must be equal else raise."""
    ns, nt = source.count(), target.count()
    if ns != nt:
        raise ValueError(f"row counts differ: source {ns}, target {nt}")
    return copy_column_left(source, target, column, source_order, target_order, how="inner")


def copy_column_left(source: DataFrame, target: DataFrame, column: str, source_order: Sequence[str],
                     target_order: Sequence[str], how: str = "left") -> DataFrame:
    """Copy ``column`` by position; extra target rows get null, extra source rows drop."""
    s = dense_position(source.select(*[F.col(_q(c)) for c in dict.fromkeys([*source_order, column])]),
                       source_order, name="_pos").select("_pos", F.col(_q(column)).alias("_copy"))
    t = dense_position(target, target_order, name="_pos")
    out = t.join(s, "_pos", how)
    cols = [c for c in target.columns]
    projected = [F.col("_copy").alias(column) if c == column else F.col(_q(c)) for c in cols]
    if column not in cols:
        projected.append(F.col("_copy").alias(column))
    return out.select("_pos", *projected).withColumnRenamed("_pos", "pos")


def copy_column_skip(source: DataFrame, targets: DataFrame, column: str, target_key: str,
                     source_order: Sequence[str], target_order: Sequence[str]) -> DataFrame:
    """Copy ``column`` by position into every target group (``target_key``) whose
    row count equals the source's; other target groups are skipped."""
    n_src = source.select(F.count(F.lit(1))).scalar()
    sizes = targets.groupBy(target_key).agg(F.count(F.lit(1)).alias("_n"))
    eligible = sizes.where(F.col("_n") == n_src).agg(F.collect_set(target_key)).scalar()  # names of target groups
    kept = targets.where(F.array_contains(eligible, F.col(_q(target_key))))
    s = dense_position(source.select(*[F.col(_q(c)) for c in dict.fromkeys([*source_order, column])]),
                       source_order, name="_pos").select("_pos", F.col(_q(column)).alias("_copy"))
    t = dense_position(kept, target_order, partition_by=[target_key], name="_pos")
    cols = [F.col("_copy").alias(column) if c == column else F.col(_q(c)) for c in targets.columns]
    if column not in targets.columns:
        cols.append(F.col("_copy").alias(column))
    return t.join(s, "_pos", "inner").select(F.col("_pos").alias("pos"), *cols)


def _suffixed(df: DataFrame, shared: set[str], suffix: str, keys: Iterable[str]) -> list[Column]:
    keyset = set(keys)
    return [F.col(_q(c)).alias(c + suffix if c in shared else c) for c in df.columns if c not in keyset]


def pair(left: DataFrame, right: DataFrame, how: str = "key", on: Sequence[str] = (),
         order_by: Sequence[str] = (), right_order_by: Sequence[str] | None = None,
         join: str = "inner", suffixes: tuple[str, str] = ("", "_zh"), position: str = "pos",
         coalesce: Sequence[str] = ()) -> DataFrame:
    """Side-by-side pairing of two tables (e.g. English and Chinese answers).

    ``how='key'``: equi-join on ``on`` (stored keys; no positional drift when
    rows failed on one side).  ``how='position'``: join on the dense position in
    ``order_by`` -- ``join='inner'`` truncates to the shorter table, ``'full'``
    pads with null.  Columns present on both sides get ``suffixes``, but for
    those in ``coalesce`` (key-like columns such as the model): one column, the left
    value where there is one, else the right.
    """
    jt = {"inner": "inner", "full": "full_outer", "left": "left"}[join]
    if how == "position":
        l = dense_position(left, order_by, name=position)
        r = dense_position(right, right_order_by or order_by, name=position)
        keys = [position]
    elif how == "key":
        l, r, keys = left, right, list(on)
    else:
        raise ValueError(f"unknown pairing {how!r}")
    shared = (set(l.columns) & set(r.columns)) - set(keys)
    lcols = _suffixed(l, shared, suffixes[0], keys)
    rcols = _suffixed(r, shared, suffixes[1], keys)
    la, ra = l.select(*[F.col(_q(k)) for k in keys], *lcols), r.select(*[F.col(_q(k)).alias(f"_r_{k}") for k in keys], *rcols)
    cond = [F.col(_q(k)) == F.col(_q(f"_r_{k}")) for k in keys]
    out = la.join(ra, cond, jt)
    key_cols = [F.coalesce(F.col(_q(k)), F.col(_q(f"_r_{k}"))).alias(k) for k in keys]
    # rows that only the right side has: unsuffixed key-like columns take the right side's value
    filled = {c: F.coalesce(F.col(_q(c)), F.col(_q(c + suffixes[1]))).alias(c) for c in coalesce if c in shared and not suffixes[0]}
    return out.select(*key_cols, *[filled.get(c, F.col(_q(c))) for c in la.columns if c not in keys],
                      *[F.col(_q(c)) for c in ra.columns if not c.startswith("_r_")
                        and c.removesuffix(suffixes[1]) not in filled])


def union_all_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Union all by column name; columns missing in a frame are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix_key(name: Column, sep: str = "_") -> Column:
    """Default dataset key: the text before the first ``sep``."""
    return F.substring_index(name, sep, 1)


def dataset_pairs(left: DataFrame, right: DataFrame, name: str = "file_name",
                  key: Callable[[Column], Column] = prefix_key) -> DataFrame:
    """Pair two catalogues of dataset names on a derived key; a key listed more
    than once on a side resolves to its largest name (deterministic)."""
    l = left.select(key(F.col(name)).alias("key"), F.col(name).alias("source_name")) \
        .groupBy("key").agg(F.max("source_name").alias("source_name"))
    r = right.select(key(F.col(name)).alias("key"), F.col(name).alias("target_name")) \
        .groupBy("key").agg(F.max("target_name").alias("target_name"))
    return l.join(r, "key", "inner")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Intersection of the key sets of two tables."""
    return left.select(key).intersect(right.select(key))
