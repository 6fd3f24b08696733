"""Addressing of gridded fields as column expressions.

A field has three dimensions, the last of which varies fastest within an array.  Blocks tile
it; block numbers count the first dimension fastest.  All functions return Columns, so an
address costs nothing but arithmetic in the plan that uses it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("d0", "d1", "d2")
BLOCKS = ("b0", "b1", "b2")


@dataclass(frozen=True)
class Grid:
    """Shape of a step and of its blocks; edge blocks may be ragged."""

    shape: tuple[int, int, int]
    block: tuple[int, int, int] = (4, 4, 4)

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(math.ceil(n / b) for n, b in zip(self.shape, self.block))

    @property
    def half(self) -> tuple[int, ...]:
        return tuple(b // 2 for b in self.block)

    @property
    def volume(self) -> int:
        return math.prod(self.shape)

    def block_counts(self, tiling: str = "uniform") -> tuple[int, ...]:
        """Blocks along each dimension: the shifted tiling has one more, the merged one does not."""
        if tiling == "stagger":
            return tuple(stagger_index_of(n - 1, b) + 1 for n, b in zip(self.shape, self.block))
        if tiling == "stagger_merged":
            return tuple(merged_index_of(n - 1, b) + 1 for n, b in zip(self.shape, self.block))
        return self.counts


def stagger_index_of(d: int, block: int) -> int:
    half = block // 2
    return 0 if d < half else 1 + (d - half) // block


def merged_index_of(d: int, block: int) -> int:
    half = block // 2
    return 0 if d < half + block else (d - half) // block


def quotient(a: Column, b: int) -> Column:
    """Whole-number quotient, in whole numbers throughout, so large positions stay exact."""
    return F.call_function("div", a, F.lit(b))


def coordinates(p: Column, shape) -> list[Column]:
    """Coordinates of a position, last dimension fastest."""
    _, n1, n2 = shape
    return [quotient(p, n1 * n2).cast("int").alias("d0"), (quotient(p, n2) % n1).cast("int").alias("d1"), (p % n2).cast("int").alias("d2")]


def position(shape, d=None) -> Column:
    d0, d1, d2 = d or [F.col(x) for x in DIMS]
    return (d0.cast("long") * shape[1] + d1) * shape[2] + d2


def coordinates_first_fastest(p: Column, shape) -> list[Column]:
    n0, n1, _ = shape
    return [(p % n0).cast("int").alias("d0"), (quotient(p, n0) % n1).cast("int").alias("d1"), quotient(p, n0 * n1).cast("int").alias("d2")]


def block_index(d: Column, block: int, tiling: str = "uniform") -> Column:
    """The block of a coordinate under a tiling."""
    if tiling == "uniform":
        return quotient(d, block).cast("int")
    half = block // 2
    if tiling == "stagger":
        return F.when(d < half, 0).otherwise(1 + quotient(d - half, block)).cast("int")
    if tiling == "stagger_merged":
        return F.when(d < half + block, 0).otherwise(quotient(d - half, block)).cast("int")
    raise ValueError(tiling)


def block_id(counts, b=None) -> Column:
    """Block number, first dimension fastest."""
    b0, b1, b2 = b or [F.col(x) for x in BLOCKS]
    return b0.cast("long") + b1.cast("long") * counts[0] + b2.cast("long") * (counts[0] * counts[1])


def block_coordinates(i: Column, counts) -> list[Column]:
    c0, c1, _ = counts
    return [(i % c0).cast("int").alias("b0"), (quotient(i, c0) % c1).cast("int").alias("b1"), quotient(i, c0 * c1).cast("int").alias("b2")]


def offset_in_block(block) -> Column:
    """Place of a voxel within its aligned block, last dimension fastest."""
    d0, d1, d2 = (F.col(x) % b for x, b in zip(DIMS, block))
    return ((d0 * block[1] + d1) * block[2] + d2).cast("int")


def with_blocks(voxels: DataFrame, grid: Grid, tiling: str = "uniform") -> DataFrame:
    """``voxels`` with b0, b1, b2 and block_id of a tiling."""
    out = voxels.withColumns({b: block_index(F.col(d), n, tiling) for b, d, n in zip(BLOCKS, DIMS, grid.block)})
    return out.withColumn("block_id", block_id(grid.block_counts(tiling)))


def global_block_id(step: Column, i: Column, counts) -> Column:
    """Block number counted through all steps."""
    return step.cast("long") * math.prod(counts) + i


def swap_axis_order(i: Column, counts) -> Column:
    """A first-fastest number as the last-fastest number of the same block."""
    b = block_coordinates(i, counts)
    return (b[0].cast("long") * counts[1] + b[1]) * counts[2] + b[2]


def covered_uniform(b: Column, block: int, count: int, size: int, tiling: str = "stagger") -> Column:
    """Array of the aligned blocks that a shifted block touches along one dimension."""
    half = block // 2
    if tiling == "stagger":
        low = F.when(b == 0, 0).otherwise((b - 1) * block + half)
        high = F.when(b == 0, half - 1).otherwise(b * block + half - 1)
    else:
        low = F.when(b == 0, 0).otherwise(b * block + half)
        high = F.when(b == 0, half + block - 1).otherwise((b + 1) * block + half - 1)
    last = F.least(quotient(F.least(high, F.lit(size - 1)), block), F.lit(count - 1))
    return F.sequence(quotient(low, block).cast("int"), last.cast("int"))


def stagger_to_uniform(blocks: DataFrame, grid: Grid, tiling: str = "stagger") -> DataFrame:
    """The aligned blocks under each shifted block of (step, b0, b1, b2): at most eight rows each."""
    out = blocks.select("step", *(F.col(b).alias(f"s{i}") for i, b in enumerate(BLOCKS)))
    for i, (b, n, c, size) in enumerate(zip(BLOCKS, grid.block, grid.counts, grid.shape)):
        out = out.withColumn(b, F.explode(covered_uniform(F.col(f"s{i}"), n, c, size, tiling)))
    return out.withColumn("block_id", block_id(grid.counts))


def near(b: Column, count: int, offsets: tuple[int, ...] = (-1, 0, 1)) -> Column:
    """Array of the numbers at these offsets from ``b`` that are within 0 and ``count``."""
    return F.filter(F.array(*[b + o for o in offsets]), lambda x: (x >= 0) & (x < count))


def related_uniform(blocks: DataFrame, grid: Grid) -> DataFrame:
    """Each shifted block with the aligned blocks it may be predicted from: those at offsets 0 and -1 along every dimension that exist."""
    out = blocks
    for i, (b, c) in enumerate(zip(BLOCKS, grid.counts)):
        out = out.withColumn(f"u{i}", F.explode(near(F.col(b), c, (-1, 0))))
    return out


def _spread(x: Column) -> Column:
    x = x.cast("long").bitwiseAND(0x1FFFFF)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits of three numbers of at most 21 bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def _compact(m: Column) -> Column:
    m = m.bitwiseAND(F.lit(0x1249249249249249))
    for shift, mask in ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF)):
        m = m.bitwiseOR(F.shiftright(m, shift)).bitwiseAND(F.lit(mask))
    return m


def morton_decode(m: Column) -> list[Column]:
    return [_compact(m if i == 0 else F.shiftright(m, i)).cast("int") for i in range(3)]


def hilbert_bits(counts) -> int:
    """Bits of the smallest power-of-two cube that encloses a grid."""
    return max(1, max(counts) - 1).bit_length()


def hilbert(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Place on the Hilbert curve of a cube of 2^bits, by Skilling's transposition.

    Each bit's step needs the last one's result several times over, which an expression would
    copy; whole batches of NumPy integers do it in place.
    """

    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(np.stack([a, b, c]).astype(np.int64), bits))

    return key(x, y, z)


def hilbert_keys(v: np.ndarray, bits: int) -> np.ndarray:
    v = v.copy()
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i in range(3):
            high = (v[i] >> q & 1).astype(bool)
            swap = np.where(high, 0, (v[0] ^ v[i]) & low)
            v[0] ^= np.where(high, low, swap)
            v[i] ^= swap if i else 0
    v[1] ^= v[0]
    v[2] ^= v[1]
    flip = np.zeros_like(v[0])
    for q in range(bits - 1, 0, -1):
        flip ^= np.where(v[2] >> q & 1, (1 << q) - 1, 0)
    v ^= flip
    out = np.zeros_like(v[0])
    for q in range(bits - 1, -1, -1):
        for i in range(3):
            out = out << 1 | v[i] >> q & 1
    return out


def hilbert_points(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``hilbert_keys``."""
    v = np.zeros((3, len(keys)), np.int64)
    for q in range(bits):
        for i in range(3):
            v[i] |= (keys >> (3 * q + 2 - i) & 1) << q
    t = v[2] >> 1
    v[2] ^= v[1]
    v[1] ^= v[0]
    v[0] ^= t
    for q in range(1, bits):
        low = (1 << q) - 1
        for i in (2, 1, 0):
            high = (v[i] >> q & 1).astype(bool)
            swap = np.where(high, 0, (v[0] ^ v[i]) & low)
            v[0] ^= np.where(high, low, swap)
            v[i] ^= swap if i else 0
    return v
