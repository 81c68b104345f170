"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring; a row's hash walks clockwise to the
next point.  Each shard has a capacity; the rows that overflow a full shard
continue clockwise to the next point, and so on.  With ``slack=0`` the capacities
add up to the row count and differ by at most one, so the balance is exact; with
``slack=e`` a shard takes up to (1 + e) times the mean, and fewer rows leave their
home shard.  Native DataFrame operations only.

The walk is done on counts, not rows: the ring has 2**16 cells, the rows of a cell
are counted (one partial aggregate), the cells' counts add up to the counts of the
points, and the clockwise walk over shards x vnodes points gives, for each point,
intervals (first rank, last rank -> shard, first slot).  A row then needs only its
rank at its point: the offset of its cell plus its row number within the cell, in
ring order.  So no task holds a shard, only a cell (1/65,536 of the rows), and both
lookup tables have a proven size (65,536 cells; at most 2 * shards * vnodes
intervals).  A cell is hot only if very many rows agree in key and text and size.

Nulls: a null key hashes like a row without key (its text and size still spread
it); a null text counts as empty.  Repeated rows get distinct slots.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import inline_table, materialize

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; one shard per cell (the first)."""
    points: dict[int, tuple[int, int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big")
            cell = h >> (64 - CELL_BITS)
            points[cell] = min(points.get(cell, (h, s)), (h, s))
    return [(cell, points[cell][1]) for cell in sorted(points)]


def ring_cells(points: list[tuple[int, int]]) -> list[dict]:
    """Segments of cells per point: lo..hi walk clockwise to the point (hi is its cell);
    the segment past the last point belongs to the first one and comes before it."""
    out = []
    for p, (cell, _) in enumerate(points):
        lo = points[p - 1][0] + 1 if p else 0
        out.append({"point": p, "lo": lo, "hi": cell, "shift": 0})
    if points[-1][0] + 1 < CELLS:
        out.append({"point": 0, "lo": points[-1][0] + 1, "hi": CELLS - 1, "shift": -CELLS})
    return out


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """slack 0: floor or ceiling of the mean, adding up to ``total``; else (1 + slack) * mean, rounded up."""
    if slack:
        return [max(1, -int(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(points: list[tuple[int, int]], counts: list[int], room: list[int]) -> list[dict]:
    """The clockwise walk on counts: intervals of ranks per point with shard and first slot.

    Round 0 offers every point's rows to its own shard, in ring order; round r offers
    what is left to the shard of the r-th point clockwise."""
    room, used, n = list(room), [0] * len(room), len(points)
    left = {p: (0, c) for p, c in enumerate(counts) if c}  # next rank, rows left
    out = []
    for step in range(n):
        if not left:
            break
        for p in sorted(left):
            shard = points[(p + step) % n][1]
            rank, rest = left[p]
            take = min(rest, room[shard])
            if take:
                out.append({"point": p, "first": rank, "last": rank + take - 1, "shard": shard, "slot0": used[shard]})
                room[shard] -= take
                used[shard] += take
                if take == rest:
                    del left[p]
                else:
                    left[p] = (rank + take, rest - take)
    if left:
        raise ValueError("the shards' capacity is below the number of rows")
    return out


def bounded_ring(rows: DataFrame, ring_hash: Column, order: list[str], shards: int = 24, vnodes: int = 64,
                 slack: float = 0.0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 within a shard).

    ``ring_hash``: a 64-bit hash of the key; ``order``: columns that order rows of
    equal hash (identical rows may swap slots).  ``rows`` should be narrow and
    written out (it is read twice)."""
    spark = rows.sparkSession
    points = ring_points(shards, vnodes)
    hashed = rows.withColumn("_hash", ring_hash) \
        .withColumn("_cell", F.shiftrightunsigned("_hash", 64 - CELL_BITS).cast("int"))
    cells = inline_table(spark, ring_cells(points), "point int, lo int, hi int, shift int") \
        .select("point", "shift", F.explode(F.sequence("lo", "hi")).alias("_cell"))
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"))
    in_point = Window.partitionBy("point").orderBy(F.col("_cell") + F.col("shift"))
    cells = materialize(
        cells.join(counts, "_cell", "inner")
        .select("_cell", "point", "n", (F.sum("n").over(in_point) - F.col("n")).alias("_before")), "ring-cells")
    per_point = [0] * len(points)
    for r in cells.groupBy("point").agg(F.sum("n").alias("n")).collect():  # at most shards * vnodes rows
        per_point[r["point"]] = r["n"]
    total = sum(per_point)
    plan = walk(points, per_point, capacities(total, shards, slack))
    plan_df = inline_table(spark, plan, "point int, first bigint, last bigint, shard int, slot0 bigint")
    in_cell = Window.partitionBy("_cell").orderBy("_hash", *[F.col(f"`{c}`") for c in order])
    ranked = hashed.withColumn("_row", F.row_number().over(in_cell) - 1) \
        .join(F.broadcast(cells.select("_cell", "point", "_before")), "_cell") \
        .withColumn("_rank", F.col("_before") + F.col("_row"))
    r, p = ranked.alias("r"), F.broadcast(plan_df).alias("p")
    return r.join(p, (F.col("r.point") == F.col("p.point")) & F.col("r._rank").between(F.col("p.first"), F.col("p.last"))) \
        .select(*[F.col(f"r.`{c}`") for c in rows.columns], F.col("p.shard").alias(shard),
                (F.col("p.slot0") + F.col("r._rank") - F.col("p.first")).cast("long").alias(slot))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """All documents in ``shards`` shards under the law ``rows`` (counts at most one apart)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                         F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    narrow = materialize(narrow, "shard-rows")  # the texts are read once
    ring = F.xxhash64("doc_id", "text_crc32", "size")
    out = bounded_ring(narrow, ring, ["doc_id", "text_crc32", "size"], shards, vnodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard_documents(table(spark, sf_dir, "documents"))
