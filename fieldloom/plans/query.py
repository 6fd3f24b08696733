"""Value-range, isovalue and two-field queries, planned as filters and semi-joins over zone maps.

A query first finds the steps, then the blocks whose interval meets the range, and only then
touches values.  Blocks come from the aligned tiling and, mapped back, from the one shifted by
half a block; together they hold the owner of every cell that the range crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.grid import BLOCKS, Grid, block_id, stagger_to_uniform, with_blocks
from fieldloom.operators.blocks import expand_neighbours
from fieldloom.operators.order import before, parted
from fieldloom.operators.zonemap import gap_intervals, step_stats, zone_map


def overlaps(lo, hi, error: float = 0.0) -> Column:
    """Whether the interval (lo, hi) of a row, widened by ``error``, meets [lo, hi]: closed at both ends."""
    return (F.col("lo") - error <= hi) & (F.col("hi") + error >= lo)


class RangeQuery:
    """Values within [lo, hi]; an isovalue is the range [v, v].

    ``error`` widens a zone map that was stored with a bounded error.  ``zones`` and ``shifted`` are
    stored intervals of the aligned and of the shifted blocks; without them they are made from all voxels.
    """

    def __init__(self, voxels: DataFrame | None, grid: Grid, lo: float, hi: float, value: str = "f", error: float = 0.0, zones: DataFrame | None = None, shifted: DataFrame | None = None):
        self.voxels, self.grid, self.lo, self.hi, self.value, self.error, self.shifted = voxels, grid, lo, hi, value, error, shifted
        self.zones = zone_map(voxels, grid, "uniform", value) if zones is None else zones

    @classmethod
    def of_index(cls, index, lo: float, hi: float, value: str = "f", voxels: DataFrame | None = None) -> "RangeQuery":
        """The query by a stored index's intervals of both tilings: no voxel is read for choosing blocks."""
        return cls(voxels, index.grid, lo, hi, value, zones=index.zones(value), shifted=index.zones(value, "stagger"))

    def steps(self) -> DataFrame:
        """Steps whose range meets the query's; step ranges are exact, so they aren't widened."""
        return step_stats(self.zones).where(overlaps(self.lo, self.hi)).select("step")

    def blocks(self) -> DataFrame:
        """Aligned blocks that meet the range."""
        return self.zones.where(overlaps(self.lo, self.hi, self.error)).select("step", *BLOCKS, "block_id")

    def core(self, tiling: str = "stagger") -> DataFrame:
        """Aligned blocks that meet the range, and those under shifted blocks that do."""
        stored = self.shifted if tiling == "stagger" else None
        shifted = (zone_map(self.voxels, self.grid, tiling, self.value) if stored is None else stored).where(overlaps(self.lo, self.hi, self.error))
        mapped = stagger_to_uniform(shifted, self.grid, tiling).select("step", *BLOCKS, "block_id")
        return self.blocks().union(mapped).distinct()

    def with_gaps(self) -> DataFrame:
        """(step, block_id): blocks that meet the range, and those beside whose gaps to the next do."""
        gaps = gap_intervals(self.voxels, self.grid, self.value).where(overlaps(self.lo, self.hi, self.error)).select("step", "block_id")
        return self.blocks().select("step", "block_id").union(gaps).distinct()

    def expanded(self, tiling: str = "stagger") -> DataFrame:
        """The core and its neighbours."""
        return expand_neighbours(self.core(tiling), self.grid)

    def values(self) -> DataFrame:
        """The voxels within the range: blocks are chosen by the zone map before values are compared."""
        hits = self.blocks().select("step", "block_id")
        placed = with_blocks(self.voxels, self.grid)
        return placed.join(hits, ["step", "block_id"], "left_semi").where(F.col(self.value).between(self.lo, self.hi)).select(*self.voxels.columns)


def candidate_steps(f: RangeQuery, g: RangeQuery) -> DataFrame:
    """Steps whose ranges meet both fields'."""
    return f.steps().join(g.steps(), "step", "left_semi")


def both(f: RangeQuery, g: RangeQuery) -> DataFrame:
    """Core blocks of a two-field query: those in both fields' cores."""
    return f.core().join(g.core().select("step", "block_id"), ["step", "block_id"], "left_semi").select("step", *BLOCKS, "block_id")


def octree_blocks(tree: DataFrame, grid: Grid, lo: float, hi: float) -> DataFrame:
    """(step, morton) of blocks that meet the range, found level by level from the root: each level is joined only where its parent met."""
    levels = max(1, max(grid.counts) - 1).bit_length()
    hits = tree.where((F.col("level") == levels) & overlaps(lo, hi)).select("step", "morton")
    for level in range(levels - 1, -1, -1):
        parents = hits.select("step", F.col("morton").alias("parent"))
        below = tree.where((F.col("level") == level) & overlaps(lo, hi)).select("step", "morton", F.shiftright("morton", 3).alias("parent"))
        hits = below.join(parents, ["step", "parent"], "left_semi").select("step", "morton")
    return hits


def batch_counts(zones: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query, n) blocks that meet each of the ranges (query, qlo, qhi), whose ends aren't reversed.

    A block misses a range if it ends before the range begins, or begins after it ends, and no block
    does both.  So those that meet it are the blocks with low <= qhi less those with high < qlo: two
    ranks, for which lows and highs (each different one a row, with its count) and the ranges' ends
    stand in one order, cut into ranges of rows.  No block is paired with a range.
    """
    at = lambda which, v, tie, query, n: (F.lit(which).alias("which"), v.cast("double").alias("v"), F.lit(tie).alias("tie"), query.cast("long").alias("query"), n.cast("long").alias("n"))
    none, one = F.lit(None), F.count(F.lit(1))
    # an end that equals the range's counts in the first rank and not in the second
    ends = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("lo").alias("v"), F.lit(0).alias("tie")), F.struct(F.lit(1).alias("which"), F.col("hi").alias("v"), F.lit(1).alias("tie"))))
    rows = zones.where("lo is not null and hi is not null").select(ends.alias("end")).groupBy("end").agg(one.alias("n"))
    rows = rows.select("end.which", F.col("end.v").cast("double").alias("v"), "end.tie", none.cast("long").alias("query"), "n")
    for which, v, tie in ((0, "qhi", 1), (1, "qlo", 0)):
        rows = rows.union(ranges.select(*at(which, F.col(v), tie, F.col("query"), F.lit(0))))
    order = ["v", "tie", "query"]
    parts = parted(rows, ["which"], order)
    within = F.sum("n").over(Window.partitionBy("which", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("rank", within).where("query is not null").join(before(parts, ["which"], F.sum("n"), "sum"), ["which", "part"])
    rank = F.col("rank") + F.col("before")
    return ranks.groupBy("query").agg(F.sum(F.when(F.col("which") == 0, rank).otherwise(-rank)).cast("long").alias("n"))


def random_ranges(rows: DataFrame, number: str, first: float, last: float, share: float | None = None) -> DataFrame:
    """(query, qlo, qhi): a range for each row, random by its number: both ends, or the place of one of this share of all.

    Places are those of a linear congruence, so a row's range is the same in every run.
    """
    place = lambda i: ((F.col(number).cast("long") * 2 + i) * 1103515245 + 12345) % 2147483648 / 2147483648.0
    a, b = (F.lit(first) + place(i) * (last - first) for i in (1, 2))
    if share is not None:
        b = a + share * (last - first)
    return rows.select(F.col(number).cast("long").alias("query"), F.least(a, b).alias("qlo"), F.greatest(a, b).alias("qhi"))


def block_number(grid: Grid) -> Column:
    return block_id(grid.counts)
