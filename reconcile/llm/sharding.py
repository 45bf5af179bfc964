"""Sharding along a Hilbert curve over metadata. DataFrame functions only.

Source, language and length of each document are quantised to a grid; the
documents are ordered by the grid cell's place on the Hilbert curve through the
grid and cut into runs of equal row counts (law ``rows``). Neighbours on the
curve are close in every dimension, so each shard covers a small box of
metadata and a filter on any dimension skips most files.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from reconcile.llm.storage import salted_lookup

LAW = "rows"
#: Bits of each dimension's grid: 2^15 cells in all. Parts that a cell is dealt over for ranking.
BITS, PARTS = 5, 256


@cache
def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state of a Hilbert curve for (state, corner), flat.

    A state is the corner where the curve enters a cube and the axis along
    which it leaves. The corners of a cube are visited in Gray code order,
    turned so that each small cube starts next to where the one before ended.
    """
    corners, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    gray = [i ^ (i >> 1) for i in range(corners)]
    enters = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, corners)]
    # The axis along which the curve crosses small cube i: by the number of low set (or clear) bits of i.
    ones = [next(b for b in range(dims + 1) if not i >> b & 1) for i in range(corners)]
    along = [0] + [(ones[i - 1] if i % 2 == 0 else ones[i]) % dims for i in range(1, corners)]
    digits, states = [0] * dims * corners * corners, [0] * dims * corners * corners
    for entry in range(corners):
        for axis in range(dims):
            for i in range(corners):
                at = (axis * corners + entry) * corners + (turn(gray[i], axis + 1) ^ entry)
                digits[at] = i
                states[at] = (axis + along[i] + 1) % dims * corners + (entry ^ turn(enters[i], axis + 1))
    return digits, states


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the grid point with these coordinates (integers of so many bits)."""
    dims = len(coordinates)
    digits, states = (F.array(*map(F.lit, table)) for table in curve_steps(dims))
    corner_at = []
    for bit in reversed(range(bits)):
        corner = F.lit(0)
        for axis, value in enumerate(coordinates):
            corner = corner.bitwiseOR(F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), axis))
        corner_at.append(corner)

    def step(walk: Column, corner: Column) -> Column:
        at = walk["state"] * F.lit(1 << dims) + corner
        index = walk["index"] * F.lit(1 << dims) + F.get(digits, at).cast("long")
        return F.struct(index.alias("index"), F.get(states, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*corner_at), start, step)["index"]


def quantile_bins(df: DataFrame, column: str, spread: str, bins: int) -> DataFrame:
    """df with ``<column>_bin``: where the middle row of its value is among all rows in order of the value."""
    ordered = Window.partitionBy().orderBy(F.col(column).asc_nulls_first())  # the distinct values only
    below = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    bin_of = F.floor((below + F.col("n") / 2) * bins / F.sum("n").over(Window.partitionBy())).cast("int")
    return salted_lookup(df, counts.select(column, bin_of.alias(f"{column}_bin")), column, F.col(spread))


def shard(docs: DataFrame, shards: int = 40, law: str = LAW) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve_index of every row of docs.

    Row counts of shards differ by one at most; slots run from 0 in curve order.
    Rows of a cell follow in the order of a hash of doc_id, then of doc_id, size
    and checksum. A null text has size 16 and no checksum; null source and
    language come first in their dimension. Repeated rows get slots of their
    own; an empty table gives no rows.
    """
    if law != LAW:
        raise ValueError("runs of the curve are cut by rows")
    rows = docs.select(
        "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("mixed", F.xxhash64(F.lit("shard"), "doc_id"))
    for column in ("source", "lang"):
        rows = quantile_bins(rows, column, "mixed", 1 << BITS)
    # Half octaves of length; the last bin takes all longer ones.
    length_bin = F.least(F.floor(2 * F.log2(F.col("size") / 16)), F.lit((1 << BITS) - 1)).cast("int")
    index = hilbert_index([F.col("source_bin"), F.col("lang_bin"), length_bin])
    rows = rows.withColumn("curve_index", index).withColumn("part", F.shiftrightunsigned("mixed", 64 - PARTS.bit_length() + 1))
    # Ranks over the whole order: cells before (at most 2^15 rows), parts of the cell before, rows of the part before.
    parts = rows.groupBy("curve_index", "part").agg(F.count("*").alias("n"))
    cells = parts.groupBy("curve_index").agg(F.sum("n").alias("n"))
    everything = Window.partitionBy()
    before = everything.orderBy("curve_index").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"), F.sum("n").over(everything).alias("total"))
    in_cell = Window.partitionBy("curve_index").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_start", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).join(cells, "curve_index")
    starts = starts.select("curve_index", "part", (F.col("cell_start") + F.col("part_start")).alias("start"), "total")
    order = Window.partitionBy("curve_index", "part").orderBy("mixed", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(order) - 1).join(starts, ["curve_index", "part"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("nth"))
    exact = F.expr(f"cast((rank * {shards}) div total as int)")
    slot = F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", exact).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )
