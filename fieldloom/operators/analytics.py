"""Scatterplots and statistics of fields."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldloom.functions.grid import BLOCKS, Grid, near
from fieldloom.operators import halo
from fieldloom.operators.blocks import cells
from fieldloom.operators.order import before, parted
from fieldloom.sources.store import stored

#: Pairs of corners along each dimension of a cell: the edges that are parallel to it.
EDGES = {0: ((0, 4), (1, 5), (2, 6), (3, 7)), 1: ((0, 3), (1, 2), (4, 7), (5, 6)), 2: ((0, 1), (3, 2), (4, 5), (7, 6))}
#: The shares of the largest values that thresholds are given for.
TOP_SHARES = (1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 5e-2, 1e-1)


def _sum(columns: list):
    return reduce(lambda a, b: a + b, columns)


def cell_gradient(corners: list, axis: int):
    """The mean of a cell's four differences along a dimension."""
    return _sum([corners[b] - corners[a] for a, b in EDGES[axis]]) / 4


def scatterplot(voxels: DataFrame, f_range: tuple[float, float], g_range: tuple[float, float], resolution: int = 256) -> DataFrame:
    """(bin_f, bin_g, density): each cell that meets both ranges adds the inverse of the size of grad f x grad g to the bin of its mean values.

    Cells whose gradients are parallel are left out.  Means outside the ranges count in the border bins.
    """
    return scatterplot_of_chunks(halo.chunks(voxels, ("f", "g")), f_range, g_range, resolution)


def scatterplot_of_chunks(parts: DataFrame, f_range: tuple[float, float], g_range: tuple[float, float], resolution: int = 256, size=halo.CHUNK) -> DataFrame:
    """The scatterplot of chunks with a halo after them: a task sums its chunks' bins, of which at most resolution^2 leave it at a time."""

    def kernel(dense: halo.Dense) -> dict[str, np.ndarray]:
        corners = {x: dense.corners(x) for x in "fg"}
        met = halo.whole(corners["f"]) & halo.whole(corners["g"])
        for x, (lo, hi) in (("f", f_range), ("g", g_range)):
            with np.errstate(invalid="ignore"):
                met &= (np.minimum.reduce(corners[x]) <= hi) & (np.maximum.reduce(corners[x]) >= lo)
        at = {x: [v[met] for v in c] for x, c in corners.items()}
        (f0, f1, f2), (g0, g1, g2) = ([cell_gradient(at[x], i) for i in range(3)] for x in "fg")
        area = np.sqrt((f1 * g2 - f2 * g1) ** 2 + (f2 * g0 - f0 * g2) ** 2 + (f0 * g1 - f1 * g0) ** 2)
        full = area >= 1e-12
        bins = []
        for x, (lo, hi) in (("f", f_range), ("g", g_range)):
            mean = np.clip(_sum(at[x])[full] / 8, lo, hi)
            bins.append(np.minimum(np.floor((mean - lo) / ((hi - lo) / resolution)), resolution - 1).astype(np.int64))
        which, own = np.unique(bins[0] * resolution + bins[1], return_inverse=True)
        return {"bin_f": (which // resolution).astype(np.int32), "bin_g": (which % resolution).astype(np.int32), "density": np.bincount(own, 1 / area[full], len(which))}

    found = halo.run(parts, kernel, "bin_f int, bin_g int, density double", ("f", "g"), size=size)
    return found.groupBy("bin_f", "bin_g").agg(F.sum("density").alias("density"))


_ODD = [sum(c) % 2 == 1 for c in halo.CORNERS]
#: A cell's division into five tetrahedra, by corners: each corner of even parity with its three neighbours, and the four of odd parity.
TETRAHEDRA = tuple(tuple(k for k, c in enumerate(halo.CORNERS) if sum(a != b for a, b in zip(c, even)) <= 1) for even, odd in zip(halo.CORNERS, _ODD) if not odd) + (tuple(k for k, odd in enumerate(_ODD) if odd),)


def _areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed areas of triangles."""
    return ((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])) / 2


def _fill(image: np.ndarray, x: np.ndarray, y: np.ndarray, density: np.ndarray) -> None:
    """Adds a triangle's density to each pixel whose middle it covers, for all triangles at once."""
    area = _areas(x, y)
    x0, y0 = (np.maximum(0, np.ceil(z.min(1) - 0.5)).astype(int) for z in (x, y))
    x1, y1 = (np.minimum(len(image) - 1, np.floor(z.max(1) - 0.5)).astype(int) for z in (x, y))
    left = (np.abs(area) > 1e-12) & (x1 >= x0) & (y1 >= y0)
    x, y, area, density, x0, y0, x1, y1 = (z[left] for z in (x, y, area, density, x0, y0, x1, y1))
    for dx in range(int((x1 - x0).max(initial=-1)) + 1):
        for dy in range(int((y1 - y0)[x0 + dx <= x1].max(initial=-1)) + 1):
            on = np.flatnonzero((x0 + dx <= x1) & (y0 + dy <= y1))
            u, v, sign = x0[on] + dx + 0.5, y0[on] + dy + 0.5, np.sign(area[on])
            inside = np.ones(len(on), bool)
            for j, k in ((0, 1), (1, 2), (2, 0)):
                inside &= ((x[on, k] - x[on, j]) * (v - y[on, j]) - (y[on, k] - y[on, j]) * (u - x[on, j])) * sign >= 0
            np.add.at(image, (x0[on][inside] + dx, y0[on][inside] + dy), density[on][inside])


def scatterplot_by_tetrahedra(voxels: DataFrame, f_range: tuple[float, float], g_range: tuple[float, float], resolution: int = 64) -> DataFrame:
    """(bin_f, bin_g, density): each cell's tetrahedra, mapped to (f, g) where both vary linearly, fill the bins whose middle they cover.

    A tetrahedron's volume spreads evenly over its image, which its four faces cover twice.
    """
    (f0, f1), (g0, g1) = f_range, g_range

    def run(batches):
        for pdf in batches:
            f = (pdf[[f"f{k}" for k in range(8)]].to_numpy() - f0) / (f1 - f0) * resolution
            g = (pdf[[f"g{k}" for k in range(8)]].to_numpy() - g0) / (g1 - g0) * resolution
            image = np.zeros((resolution, resolution))
            for tet, share in zip(TETRAHEDRA, (1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 3)):
                faces = [[tet[i] for i in range(4) if i != skip] for skip in range(4)]
                total = np.sum([np.abs(_areas(f[:, t], g[:, t])) for t in faces], 0)
                for t in faces:
                    _fill(image, f[:, t], g[:, t], share / np.maximum(total, 1e-12))
            at = np.nonzero(image)
            yield pd.DataFrame({"bin_f": at[0], "bin_g": at[1], "density": image[at]})

    spread = cells(voxels, ("f", "g")).mapInPandas(run, "bin_f int, bin_g int, density double")
    return spread.groupBy("bin_f", "bin_g").agg(F.sum("density").alias("density"))


#: Below which the cross product of the gradients, a face's image and a triangle's image count as nothing, and how far beside a triangle a pixel's middle may lie: fixed values of the depth-weighted image.
FLAT, FLAT_IMAGE, BESIDE = 1e-12, 1e-10, 1e-6


def _fill_linear(image: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> None:
    """Adds to each pixel whose middle a triangle covers what its corners' numbers give there, where that is positive."""
    area = 2 * _areas(x, y)
    left = np.abs(area) >= FLAT_IMAGE
    x, y, d, area = x[left], y[left], d[left], area[left]
    x0, y0 = (np.maximum(0, np.floor(z.min(1))).astype(int) for z in (x, y))
    x1, y1 = (np.minimum(len(image) - 1, np.ceil(z.max(1))).astype(int) for z in (x, y))
    for dx in range(int((x1 - x0).max(initial=-1)) + 1):
        wide = np.flatnonzero(x0 + dx <= x1)
        for dy in range(int((y1 - y0)[wide].max(initial=-1)) + 1):
            on = wide[y0[wide] + dy <= y1[wide]]
            u, v, own = x0[on] + dx + 0.5, y0[on] + dy + 0.5, (x[on], y[on])
            w = [((own[0][:, j] - u) * (own[1][:, k] - v) - (own[0][:, k] - u) * (own[1][:, j] - v)) / area[on] for j, k in ((1, 2), (2, 0))]
            w.append(1 - w[0] - w[1])
            depth = w[0] * d[on, 0] + w[1] * d[on, 1] + w[2] * d[on, 2]
            inside = (np.minimum.reduce(w) >= -BESIDE) & (depth > 0)
            np.add.at(image, (x0[on][inside] + dx, y0[on][inside] + dy), depth[inside])


def depth_scatterplot(voxels: DataFrame, f_range: tuple[float, float], g_range: tuple[float, float], resolution: int = 256) -> DataFrame:
    """(bin_f, bin_g, density): the image of each cell's tetrahedra, weighed by how deep they are where f and g are constant, over the size of grad f x grad g.

    Where both fields vary linearly, the depth of a tetrahedron from a corner to the face across,
    along grad f x grad g, over that product's size, is its sixfold volume over the doubled area of
    the face's image; so a corner's weight comes from areas in (f, g) alone.  A corner whose face
    has no image has no weight.  Corners are moved into the ranges before they are drawn, as two
    triangles that begin at the corner of least f.
    """
    (f0, f1), (g0, g1) = f_range, g_range
    at = np.array([(c[2], c[1], c[0]) for c in halo.CORNERS], float)

    def kernel(dense: halo.Dense) -> dict[str, np.ndarray]:
        corners = {x: dense.corners(x) for x in "fg"}
        met = halo.whole(corners["f"]) & halo.whole(corners["g"])
        cell = {x: np.stack([v[met] for v in c], 1) for x, c in corners.items()}
        image = np.zeros((resolution, resolution))
        for tet in TETRAHEDRA:
            f, g = cell["f"][:, tet], cell["g"][:, tet]
            hit = (f.max(1) >= f0) & (f.min(1) <= f1) & (g.max(1) >= g0) & (g.min(1) <= g1)
            f, g = f[hit], g[hit]
            e = at[list(tet[1:])] - at[tet[0]]
            volume = abs(np.linalg.det(e))
            df, dg = f[:, 1:] - f[:, :1], g[:, 1:] - g[:, :1]
            pair = lambda i, j: df[:, i] * dg[:, j] - df[:, j] * dg[:, i]
            normal = (pair(0, 1)[:, None] * e[2] + pair(1, 2)[:, None] * e[0] + pair(2, 0)[:, None] * e[1]) / volume
            cross = np.sqrt((normal * normal).sum(1))
            weight = np.zeros(f.shape)
            for i in range(4):
                a, b, c = (k for k in range(4) if k != i)
                face = np.abs((f[:, b] - f[:, a]) * (g[:, c] - g[:, a]) - (f[:, c] - f[:, a]) * (g[:, b] - g[:, a]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    weight[:, i] = np.where(face < FLAT * cross, 0.0, volume / face)
            full = cross >= FLAT
            order = np.argsort(f[full], axis=1, kind="stable")
            x, y, d = (np.take_along_axis(v[full], order, 1) for v in ((np.clip(f, f0, f1) - f0) / ((f1 - f0) / resolution), (np.clip(g, g0, g1) - g0) / ((g1 - g0) / resolution), weight))
            for corner in ([0, 1, 2], [0, 2, 3]):
                _fill_linear(image, x[:, corner], y[:, corner], d[:, corner])
        which = np.nonzero(image)
        return {"bin_f": which[0].astype(np.int32), "bin_g": which[1].astype(np.int32), "density": image[which]}

    found = halo.run(halo.chunks(voxels, ("f", "g")), kernel, "bin_f int, bin_g int, density double", ("f", "g"))
    return found.groupBy("bin_f", "bin_g").agg(F.sum("density").alias("density"))


def pearson(pairs: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """One row: the correlation of two columns, its denominator kept from zero by 1e-10."""
    return pairs.agg((F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b) + 1e-10)).alias("r"))


#: Size parameter of the quantile sketch, and by how much of all rows a place may lie beside where the sketch has it:
#: several times the sketch's error, so that a second look is rare.
SKETCH_K, SKETCH_SLACK = 1024, 0.01


def top_thresholds(values: DataFrame, column: str = "f", shares: tuple[float, ...] = TOP_SHARES) -> DataFrame:
    """(share, rank, threshold): the value at place floor(share * n) from the top, exactly.

    A mergeable sketch of quantiles, made in one pass with the count, narrows each place to a range
    of values; a second pass counts what lies above each range and keeps the different values
    within them, about 2 * ``SKETCH_SLACK`` of all for each share, of which the place is picked.
    Where a sketch was off by more, which the counts tell, the place is looked for among all values.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    sketch = F.kll_sketch_agg_double("v", F.lit(SKETCH_K))
    first = v.where("not isnan(v)").agg(sketch.alias("s"), F.count(F.lit(1)).alias("numbers")).crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    first = stored(first, "sketch")
    counts = first.select("numbers", "n").first()
    n, numbers = counts["n"], counts["numbers"]
    if not n:
        return values.sparkSession.createDataFrame([], "share double, rank long, threshold double")
    ranks = [min(int(np.floor(x * n)), n - 1) for x in shares]
    if not numbers:
        return _ordered_thresholds(v, "v", shares)
    # NaN is above all numbers; places are from the top
    at = [1 - (r - (n - numbers) + 0.5) / numbers for r in ranks]
    ends = [(min(1.0, max(0.0, p - SKETCH_SLACK)), min(1.0, max(0.0, p + SKETCH_SLACK))) for p in at]
    found = first.select(*(F.kll_sketch_get_quantile_double("s", F.lit(float(e))).alias(f"q{i}{j}") for i, pair in enumerate(ends) for j, e in enumerate(pair))).first()
    within = [(F.col("v") >= float(found[f"q{i}0"]) if e[0] > 0 else F.lit(True)) & (F.col("v") <= float(found[f"q{i}1"]) if e[1] < 1 else F.lit(True)) for i, e in enumerate(ends)]
    above = [F.count(F.when(F.col("v") > float(found[f"q{i}1"]), 1)) if e[1] < 1 else F.count(F.when(F.lit(False), 1)) for i, e in enumerate(ends)]
    seen = Observation()
    some = v.observe(seen, *(x.alias(f"above{i}") for i, x in enumerate(above)), *(F.count(F.when(x, 1)).alias(f"within{i}") for i, x in enumerate(within)))
    labels = F.array_compact(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(within))))
    kept = stored(some.where(reduce(lambda a, b: a | b, within)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.explode(labels)), "within")
    missed = [i for i, r in enumerate(ranks) if not seen.get[f"above{i}"] <= r < seen.get[f"above{i}"] + seen.get[f"within{i}"]]
    asked = values.sparkSession.createDataFrame([(i, float(x), r, r - seen.get[f"above{i}"]) for i, (x, r) in enumerate(zip(shares, ranks)) if i not in missed], "i int, share double, rank long, place long")
    parts = parted(kept, ["i"], [F.desc("v")])
    ends_of = parts.join(before(parts, ["i"], F.sum("n"), "sum"), ["i", "part"]).withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("i", "part").orderBy(F.desc("v"))))
    out = ends_of.join(F.broadcast(asked), "i").where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n"))).select("share", "rank", F.col("v").alias("threshold"))  # a row for each share
    return out.union(_ordered_thresholds(v, "v", tuple(shares[i] for i in missed))) if missed else out


def _ordered_thresholds(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """The same from all different values, cut into ranges whose number grows with them, of which one is ordered only if a place is in it."""
    counted = values.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    parts = parted(counted, [], [F.desc("v")])
    sums = parts.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each range, and one for all
    through = sums.withColumn("through", F.sum("n").over(Window.orderBy("part"))).crossJoin(F.broadcast(sums.agg(F.sum("n").alias("total"))))
    asked = values.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    places = through.crossJoin(F.broadcast(asked)).withColumn("rank", F.least(F.floor(F.col("share") * F.col("total")), F.col("total") - 1).cast("long"))
    places = places.where((F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("n")))
    places = stored(places.select("share", "rank", "part", (F.col("rank") - F.col("through") + F.col("n")).alias("place")), "places")  # one row for each share
    ends = parts.join(F.broadcast(places.select("part").distinct()), "part", "left_semi").withColumn("end", F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("v"))))
    return ends.join(F.broadcast(places), "part").where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n"))).select("share", "rank", F.col("v").alias("threshold"))


def isovalues(lo: float, hi: float, n: int) -> list[float]:
    """Evenly spaced values through a range, its ends left out."""
    return [lo + (hi - lo) * i / (n + 1) for i in range(1, n + 1)]


def log_uniform_isovalues(largest: float, n: int, seed: int = 42) -> list[float]:
    """``n`` values of each sign, their logarithms uniform between 1e-6 of the largest and the largest."""
    sizes = 10 ** np.random.default_rng(seed).uniform(np.log10(largest * 1e-6), np.log10(largest), 2 * n)
    return [float(x) for x in np.concatenate([sizes[:n], -sizes[n:]])]


def spread_isovalues(largest: float, n: int, seed: int = 42) -> list[float]:
    """Like ``log_uniform_isovalues``, from the places of a linear congruence, which any engine can work out."""
    sizes = [largest * 10 ** (-6 * (((i + seed) * 1103515245 + 12345) % 2147483648) / 2147483648) for i in range(2 * n)]
    return sizes[:n] + [-x for x in sizes[n:]]


def even_isovalues(largest: float, n: int) -> list[float]:
    """``n`` values of each sign, their logarithms evenly spaced from 1e-6 of the largest to the largest."""
    sizes = [largest * 10 ** (-6 * (1 - i / max(1, n - 1))) for i in range(n)]
    return sizes + [-x for x in sizes]


def _running(steps: DataFrame, values: list[float]) -> DataFrame:
    """(i, isovalue, blocks) of (i, d), changes of the number of blocks at the i-th value; as many rows as values."""
    steps = steps.groupBy("i").agg(F.sum("d").alias("d"))
    rows = steps.sparkSession.createDataFrame(list(enumerate(values)), "i int, isovalue double").join(steps, "i", "left")
    return rows.select("i", "isovalue", F.coalesce(F.sum("d").over(Window.orderBy("i")), F.lit(0)).cast("long").alias("blocks"))


def _reach(zones: DataFrame, values: list[float]) -> DataFrame:
    """``zones`` with a and b: they hold the values of the numbers from a to below b."""
    table = F.array(*map(F.lit, values))
    place = lambda x, after: F.size(F.filter(table, lambda v: (v <= x) if after else (v < x)))
    return zones.withColumns({"a": place(F.col("lo"), False), "b": place(F.col("hi"), True)}).where("a < b")


def _ends(reach: DataFrame) -> DataFrame:
    return reach.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.lit(1).alias("d")), F.struct(F.col("b").alias("i"), F.lit(-1).alias("d")))).alias("s")).select("s.i", "s.d")


def selectivity(zones: DataFrame, values: list[float]) -> DataFrame:
    """(i, isovalue, blocks): how many blocks' intervals hold each of the values.

    No block meets a value in a join: each adds one where the values that it holds begin and
    takes one where they end, and a running sum over the values counts.
    """
    values = sorted(values)
    return _running(_ends(_reach(zones, values)), values)


def expanded_selectivity(zones: DataFrame, grid: Grid, values: list[float]) -> DataFrame:
    """(i, isovalue, blocks, expanded): also how many blocks hold the value or have a neighbour that does.

    Each block takes its reach of values to its 26 neighbours; where the reaches that meet at a
    block overlap, each adds only what those before it in order leave.
    """
    values = sorted(values)
    reach = _reach(zones, values).select("step", *BLOCKS, "a", "b")
    wide = reach
    for x, count in zip(BLOCKS, grid.counts):
        wide = wide.withColumn(x, F.explode(near(F.col(x), count)))
    # at most 27 rows in a window
    earlier = F.coalesce(F.max("b").over(Window.partitionBy("step", *BLOCKS).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = wide.withColumn("a", F.greatest(F.col("a"), earlier)).where("a < b")
    expanded = _running(_ends(added), values).select("i", F.col("blocks").alias("expanded"))
    return _running(_ends(reach), values).join(expanded, "i")


def quality(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: mean squared error, signal-to-noise ratio against the largest original, largest error."""
    out = pairs.agg(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))).alias("mse"), F.max(a).alias("most"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_error"))
    ratio = F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(F.col("most") * F.col("most") / F.col("mse")))
    return out.select("mse", ratio.alias("psnr"), "max_error")


def within_bound(pairs: DataFrame, bound: float, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.agg(F.bool_and(F.abs(F.col(a) - F.col(b)) <= bound).alias("within"))


def has_duplicates(rows: DataFrame, column: str) -> DataFrame:
    """One row: whether a value stands in the column twice."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") > 1).alias("duplicates"))
