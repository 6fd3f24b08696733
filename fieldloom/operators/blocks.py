"""Block form of a field and back, neighbourhoods, and values at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.grid import BLOCKS, DIMS, Grid, block_id, near, offset_in_block, quotient, with_blocks
from fieldloom.operators import halo
from fieldloom.operators.halo import CORNERS  # noqa: F401


def to_blocks(voxels: DataFrame, grid: Grid, value: str = "f") -> DataFrame:
    """(step, block_id, offsets, values), values in the order of their place in the block.  A block is of bounded size, so is its row."""
    placed = with_blocks(voxels, grid).withColumn("offset", offset_in_block(grid.block))
    rows = placed.groupBy("step", "block_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(value).alias("value")))).alias("cells"))
    return rows.select("step", "block_id", F.col("cells.offset").alias("offsets"), F.col("cells.value").alias("values"))


def from_blocks(blocks: DataFrame, grid: Grid) -> DataFrame:
    """(step, d0, d1, d2, f) from block form."""
    cells = blocks.select("step", "block_id", F.explode(F.arrays_zip("offsets", "values")).alias("cell")).select("step", "block_id", "cell.offsets", "cell.values")
    c0, c1, _ = grid.counts
    n0, n1, n2 = grid.block
    at = [F.col("block_id") % c0, quotient(F.col("block_id"), c0) % c1, quotient(F.col("block_id"), c0 * c1)]
    inner = [quotient(F.col("offsets"), n1 * n2), quotient(F.col("offsets"), n2) % n1, F.col("offsets") % n2]
    return cells.select("step", *((b * n + o).cast("int").alias(d) for b, n, o, d in zip(at, (n0, n1, n2), inner, DIMS)), F.col("values").alias("f"))


def point_values(points: DataFrame, blocks: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (with step, d0, d1, d2) with the value there, null where there is none: one join of points and blocks by block."""
    placed = with_blocks(points, grid).withColumn("offset", offset_in_block(grid.block)).drop(*BLOCKS)
    joined = placed.join(blocks, ["step", "block_id"], "left")
    at = F.array_position("offsets", F.col("offset"))
    return joined.select(*points.columns, F.when(at > 0, F.element_at("values", at.cast("int"))).alias("value"))


def clamped(d: Column, size: int) -> Column:
    """A coordinate moved to the nearest one inside."""
    return F.greatest(F.lit(0), F.least(d, F.lit(size - 1)))


def extrapolated(v1: Column, v2: Column) -> Column:
    """The value one step beyond v1, on the line from v2."""
    return 2 * v1 - v2


def clamped_values(points: DataFrame, blocks: DataFrame, grid: Grid) -> DataFrame:
    """``points`` with the value there, or for points outside the volume that of the nearest place inside."""
    inside = points.withColumns({f"_{d}": F.col(d) for d in DIMS} | {d: clamped(F.col(d), n) for d, n in zip(DIMS, grid.shape)})
    found = point_values(inside, blocks, grid)
    return found.select(*(F.col(f"_{c}").alias(c) if c in DIMS else c for c in points.columns), "value")


def extrapolated_values(points: DataFrame, blocks: DataFrame, grid: Grid) -> DataFrame:
    """``points`` with the value there, or for points outside, how many steps ever along a dimension, on the line through the two nearest places inside.

    Where several coordinates are outside, the changes along their dimensions add up.  Each point
    asks for four places, which meet the blocks in one join.
    """
    near = [clamped(F.col(d), n) for d, n in zip(DIMS, grid.shape)]
    beyond = [F.col(d) - c for d, c in zip(DIMS, near)]
    number = F.monotonically_increasing_id()
    # towards the middle: one step back from the side that the point is beyond
    asked = [F.struct(*(c.alias(d) for c, d in zip(near, DIMS)), F.lit(1.0).alias("w"))]
    for i, (c, far, n) in enumerate(zip(near, beyond, grid.shape)):
        if n > 1:
            by = F.abs(far).cast("double")
            asked.append(F.when(far != 0, F.struct(*((c - F.signum(far).cast("int") if k == i else near[k]).alias(d) for k, d in enumerate(DIMS)), (-by).alias("w"))))
            asked.append(F.when(far != 0, F.struct(*(near[k].alias(d) for k, d in enumerate(DIMS)), by.alias("w"))))
    numbered = points.withColumn("_n", number)
    spread = numbered.withColumn("_p", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())))
    spread = spread.select(*(F.col(c).alias(f"_{c}") for c in points.columns), "_n", "step", *(F.col(f"_p.{d}").alias(d) for d in DIMS), F.col("_p.w").alias("_w"))
    found = point_values(spread, blocks, grid)
    summed = found.groupBy("_n", *(f"_{c}" for c in points.columns)).agg(F.sum(F.col("value") * F.col("_w")).alias("value"), F.count(F.lit(1)).alias("asked"), F.count("value").alias("there"))
    return summed.select(*(F.col(f"_{c}").alias(c) for c in points.columns), F.when(F.col("asked") == F.col("there"), F.col("value")).alias("value"))


def log10_floored(values: Column, floor: float = 1e-6) -> Column:
    """Base-10 logarithms of an array's values, those below ``floor`` counting as it."""
    return F.transform(values, lambda v: F.log10(F.greatest(v, F.lit(floor))))


def range_filtered(blocks: DataFrame, lo: float, hi: float) -> DataFrame:
    """Blocks with their values within [lo, hi] alone, and without those that keep none."""
    inside = F.filter(F.arrays_zip("offsets", "values"), lambda c: c["values"].between(lo, hi))
    out = blocks.withColumn("cells", inside).where(F.size("cells") > 0)
    return out.select("step", "block_id", F.col("cells.offsets").alias("offsets"), F.col("cells.values").alias("values"))


def expand_neighbours(blocks: DataFrame, grid: Grid) -> DataFrame:
    """The blocks of (step, b0, b1, b2) and their up to 26 neighbours in the same step."""
    out = blocks.select("step", *BLOCKS)
    for b, count in zip(BLOCKS, grid.counts):
        out = out.withColumn(b, F.explode(near(F.col(b), count)))
    return out.distinct().withColumn("block_id", block_id(grid.counts))


def cells(voxels: DataFrame, fields: tuple[str, ...] = ("f",)) -> DataFrame:
    """(step, d0, d1, d2, f0..f7, ...): the corner values of every cell whose eight corners exist, named by its least corner."""
    corner = ", ".join(f"{f}{k} double" for f in fields for k in range(8))
    return halo.run(halo.chunks(voxels, fields), halo.corner_values(fields), f"{halo.PLACE}, {corner}", fields)


def smoothed(voxels: DataFrame, sigma: float = 1.0, value: str = "f") -> DataFrame:
    """(step, d0, d1, d2, smooth): 3 x 3 x 3 Gaussian means, their weights renormalised over the neighbours that exist."""
    return halo.run(halo.chunks(voxels, (value,), 1, 1), halo.smoothing(sigma, value), f"{halo.PLACE}, smooth double", (value,), 1, 1)


def gradients(voxels: DataFrame, value: str = "f") -> DataFrame:
    """(step, d0, d1, d2, g0, g1, g2): differences of the neighbours before and after along each dimension, halved; one-sided at the border."""
    return halo.run(halo.chunks(voxels, (value,), 1, 1), halo.gradients(value), f"{halo.PLACE}, g0 double, g1 double, g2 double", (value,), 1, 1)
