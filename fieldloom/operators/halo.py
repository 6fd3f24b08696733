"""Chunks with a halo: what cells, smoothing, gradients and surfaces are computed from.

A voxel goes to its own chunk and, near a face, edge or corner, to the neighbours whose halo it
is in, so a task holds whole chunks and works on them as dense arrays.  With a chunk of 16 voxels
a side and a halo of one plane a fifth more values move than there are; with blocks of 4 a side,
as they are stored, 125 for each 64.  Places without a voxel are NaN, and so is a missing value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.grid import DIMS, quotient

#: Side of a chunk.
CHUNK = 16
CHUNKS = ("c0", "c1", "c2")
#: Values that a kernel holds at a time, of each field.
HELD_VALUES = 1 << 18
#: Corners of a cell as offsets of (d2, d1, d0), bottom ring then top ring.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
Shape = tuple[int, int, int]


def chunks(voxels: DataFrame, fields: tuple[str, ...] = ("f",), before: int = 0, after: int = 1, size: Shape | int = CHUNK) -> DataFrame:
    """(step, c0, c1, c2, offsets, fields...): chunks with so many planes of their neighbours; offsets count within the chunk and its halo.

    A chunk that has nothing but halo may occur; it owns no voxel.
    """
    size = (size,) * 3 if isinstance(size, int) else size
    out = voxels.select("step", *DIMS, *(F.col(f).cast("double").alias(f) for f in fields))
    for i, (d, n) in enumerate(zip(DIMS, size)):
        own, local = quotient(F.col(d), n).cast("int"), (F.col(d) % n).cast("int")
        place = lambda c, at: F.struct(c.alias("c"), at.alias("at"))
        places = [place(own, local + before)]
        if after:
            places.append(F.when((local < after) & (own > 0), place(own - 1, local + (n + before))))
        if before:
            places.append(F.when(local >= n - before, place(own + 1, local - (n - before))))
        out = out.withColumn(f"p{i}", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())))
    e1, e2 = (n + before + after for n in size[1:])
    offset = ((F.col("p0.at") * e1 + F.col("p1.at")) * e2 + F.col("p2.at")).cast("int")
    rows = out.select("step", *(F.col(f"p{i}.c").alias(c) for i, c in enumerate(CHUNKS)), offset.alias("offset"), *fields)
    rows = rows.groupBy("step", *CHUNKS).agg(F.collect_list(F.struct("offset", *(F.coalesce(f, F.lit(float("nan"))).alias(f) for f in fields))).alias("cells"))
    return rows.select("step", *CHUNKS, F.col("cells.offset").alias("offsets"), *(F.col(f"cells.{f}").alias(f) for f in fields))


class Dense:
    """Some chunks as arrays: ``step``, ``origin`` (the first owned voxel of each), and ``values`` by field, with their halo."""

    def __init__(self, batch: pa.RecordBatch, fields: tuple[str, ...], size: Shape, before: int, after: int):
        self.size, self.before, self.after = size, before, after
        n, extent = batch.num_rows, tuple(x + before + after for x in size)
        self.step = batch.column("step").to_numpy()
        self.origin = np.stack([batch.column(c).to_numpy().astype(np.int64) * s for c, s in zip(CHUNKS, size)], 1)
        lists = batch.column("offsets")
        row = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
        at = row * int(np.prod(extent)) + np.asarray(lists.flatten())
        self.values = {}
        for f in fields:
            out = np.full(n * int(np.prod(extent)), np.nan)
            out[at] = np.asarray(batch.column(f).flatten())
            self.values[f] = out.reshape(n, *extent)

    def shifted(self, field: str, at: Shape = (0, 0, 0)) -> np.ndarray:
        """The values at an offset from every owned place."""
        return self.values[field][(slice(None), *(slice(self.before + o, self.before + o + n) for o, n in zip(at, self.size)))]

    def corners(self, field: str) -> list[np.ndarray]:
        """The corner values of the cells that owned places are the least corners of."""
        return [self.shifted(field, (z, y, x)) for x, y, z in CORNERS]

    def places(self, where: np.ndarray) -> dict[str, np.ndarray]:
        """step, d0, d1, d2 of the owned places chosen."""
        which, *local = np.nonzero(where)
        return {"step": self.step[which], **{d: (self.origin[which, i] + local[i]).astype(np.int32) for i, d in enumerate(DIMS)}}


def run(parts: DataFrame, kernel: Callable[[Dense], dict[str, np.ndarray]], schema: str, fields: tuple[str, ...] = ("f",), before: int = 0, after: int = 1, size: Shape | int = CHUNK) -> DataFrame:
    """The columns that ``kernel`` makes of some chunks at a time."""
    size = (size,) * 3 if isinstance(size, int) else size
    held = max(1, HELD_VALUES // int(np.prod([n + before + after for n in size])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, held):
                columns = kernel(Dense(batch.slice(lo, held), fields, size, before, after))
                if columns and len(next(iter(columns.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    return parts.select("step", *CHUNKS, "offsets", *fields).mapInArrow(work, schema)


PLACE = "step long, d0 int, d1 int, d2 int"


def whole(corners: list[np.ndarray]) -> np.ndarray:
    """Which cells have all their corners."""
    return np.isfinite(sum(corners))


def corner_values(fields: tuple[str, ...], wanted: Callable[[Dense, np.ndarray], np.ndarray] | None = None):
    """Cells with their corner values: f0..f7 and so on."""

    def kernel(dense: Dense) -> dict[str, np.ndarray]:
        corners = {f: dense.corners(f) for f in fields}
        full = np.logical_and.reduce([whole(c) for c in corners.values()])
        if wanted is not None:
            full &= wanted(dense, full)
        return dense.places(full) | {f"{f}{k}": c[full] for f in fields for k, c in enumerate(corners[f])}

    return kernel


def smoothing(sigma: float, field: str):
    """3 x 3 x 3 Gaussian means, their weights renormalised over the neighbours that exist."""

    def kernel(dense: Dense) -> dict[str, np.ndarray]:
        own = np.isfinite(dense.shifted(field))
        total, weight = np.zeros(own.shape), np.zeros(own.shape)
        for at in product((-1, 0, 1), repeat=3):
            v, w = dense.shifted(field, at), 2.718281828459045 ** (-sum(o * o for o in at) / (2 * sigma**2))
            there = np.isfinite(v)
            total += np.where(there, v * w, 0.0)
            weight += there * w
        return dense.places(own) | {"smooth": total[own] / weight[own]}

    return kernel


def gradient(before: np.ndarray, own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Half the difference of the neighbours before and after; one-sided where one is missing, zero where both are."""
    has, has_after = np.isfinite(before), np.isfinite(after)
    one = np.where(has, before - own, np.where(has_after, own - after, 0.0))
    return np.where(has & has_after, (before - after) / 2, one)


def step_along(axis: int, by: int) -> Shape:
    return tuple(by if i == axis else 0 for i in range(3))


def gradients(field: str):
    def kernel(dense: Dense) -> dict[str, np.ndarray]:
        v = dense.shifted(field)
        own = np.isfinite(v)
        return dense.places(own) | {f"g{i}": gradient(dense.shifted(field, step_along(i, -1)), v, dense.shifted(field, step_along(i, 1)))[own] for i in range(3)}

    return kernel
