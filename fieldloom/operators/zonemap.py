"""Zone maps: the interval of values of every block, under several tilings, and tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.grid import BLOCKS, DIMS, Grid, block_id, block_index, morton, quotient, with_blocks
from fieldloom.operators.order import before, parted, ranked

KEYS = ["step", "block_id", *BLOCKS]


def zone_map(voxels: DataFrame, grid: Grid, tiling: str = "uniform", value: str = "f") -> DataFrame:
    """(step, block_id, b0, b1, b2, lo, hi, n): one aggregation, partial before its only shuffle."""
    return with_blocks(voxels, grid, tiling).groupBy(*KEYS).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def dual_zone_map(voxels: DataFrame, grid: Grid, value: str = "f") -> DataFrame:
    """The aligned and the shifted tiling in one pass: each voxel counts for two blocks."""
    tilings = []
    for tiling in ("uniform", "stagger"):
        b = [block_index(F.col(d), n, tiling) for d, n in zip(DIMS, grid.block)]
        tilings.append(F.struct(F.lit(tiling).alias("tiling"), block_id(grid.block_counts(tiling), b).alias("block_id"), *(x.alias(name) for x, name in zip(b, BLOCKS))))
    both = voxels.select("step", value, F.explode(F.array(*tilings)).alias("at")).select("step", "at.*", value)
    return both.groupBy("tiling", *KEYS).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def two_level(zones: DataFrame, blocks_per_side: int) -> DataFrame:
    """Intervals of large blocks from those of small ones."""
    big = [quotient(F.col(b), blocks_per_side).cast("int").alias(b) for b in BLOCKS]
    return zones.select("step", *big, "lo", "hi", "n").groupBy("step", *BLOCKS).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def step_stats(zones: DataFrame) -> DataFrame:
    """(step, lo, hi, n) from a zone map."""
    return zones.groupBy("step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def error_bound(stats: DataFrame, relative: float) -> DataFrame:
    """One row: the global range and the absolute error that a relative one allows."""
    out = stats.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.withColumn("abs_err", F.lit(relative) * (F.col("hi") - F.col("lo")))


def gap_intervals(voxels: DataFrame, grid: Grid, value: str = "f") -> DataFrame:
    """(step, block_id, mask, lo, hi, n) of the gaps beside a block: bit a of ``mask`` is set where the gap is between the block and its next along dimension a.

    A gap holds the two planes of voxels that face each other; along the other dimensions it is
    as wide as the block.  Masks 1..7 give three faces, three edges and a corner.
    """
    out = voxels
    for i, (d, n, count) in enumerate(zip(DIMS, grid.block, grid.counts)):
        own, local = quotient(F.col(d), n).cast("int"), F.col(d) % n
        place = F.array(
            F.struct(own.alias("b"), F.lit(0).alias("m")),
            F.when((local == n - 1) & (own + 1 < count), F.struct(own.alias("b"), F.lit(1 << i).alias("m"))),
            F.when((local == 0) & (own > 0), F.struct((own - 1).alias("b"), F.lit(1 << i).alias("m"))),
        )
        out = out.withColumn(f"p{i}", F.explode(F.filter(place, lambda x: x.isNotNull())))
    out = out.withColumn("mask", sum((F.col(f"p{i}.m") for i in range(3)), F.lit(0))).where("mask > 0")
    c0, c1, _ = grid.counts
    out = out.withColumn("block_id", F.col("p0.b").cast("long") + F.col("p1.b").cast("long") * c0 + F.col("p2.b").cast("long") * (c0 * c1))
    return out.groupBy("step", "block_id", "mask").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def octree(zones: DataFrame, grid: Grid) -> DataFrame:
    """(step, level, morton, lo, hi, n): a roll-up over Morton prefixes; level 0 has the blocks."""
    levels = max(1, max(grid.counts) - 1).bit_length()
    keyed = zones.withColumn("key", morton(*(F.col(b) for b in BLOCKS))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    keyed = keyed.withColumn("morton", F.expr("shiftright(key, 3 * level)"))
    return keyed.groupBy("step", "level", "morton").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def with_skip_reason(zones: DataFrame) -> DataFrame:
    """``zones`` with why an ordered index would keep a block in its side list: its low is zero, or an earlier block of the step has the same low.

    Zero lows, which may be most of a field's, need no comparison; of the other lows, those that
    stand twice are found by an aggregation, and only they are joined back.
    """
    reason = lambda c: c.cast("string").alias("skip_reason")
    zero, rest = zones.where("lo = 0").select("*", reason(F.lit("zero_low"))), zones.where("lo is null or lo <> 0")
    twice = rest.groupBy("step", "lo").agg(F.min("block_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("step", "lo", "first")
    listed = rest.join(twice, ["step", "lo"], "left").select(*zones.columns, reason(F.when(F.col("block_id") > F.col("first"), "duplicate_low")))
    return zero.union(listed)


def running_high(zones: DataFrame) -> DataFrame:
    """``zones`` with max_high: the largest high among the step's intervals that are not above this one in (lo, block_id) order.

    Steps are cut to ranges of that order, whose number grows with the blocks; a small table has the
    highs of the ranges before.
    """
    parts = parted(zones, ["step"], ["lo", "block_id"])
    within = Window.partitionBy("step", "part").orderBy("lo", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(before(parts, ["step"], F.max("hi"), "max"), ["step", "part"]).withColumn("max_high", F.greatest(F.max("hi").over(within), F.col("before")))
    return out.select(*zones.columns, "max_high")


def level_positions(zones: DataFrame) -> DataFrame:
    """(step, block_id, rank, depth): where a block stands in its step by low, and the depth of that place in a balanced tree's level order."""
    return ranked(zones.select("step", "block_id", "lo"), ["step"], ["lo", "block_id"]).select("step", "block_id", "rank", depth("rank").alias("depth"))


def depth(rank: str) -> Column:
    """The level of a rank in level order."""
    return (F.length(F.bin(F.col(rank))) - 1).cast("int")
