"""Isosurfaces: crossings of cell edges, triangles, and properties of meshes.

Triangles of the 256 cases aren't listed but follow from a rule: on each face the surface's
segments separate the corners at or above the isovalue one by one, segments of all faces join
to loops, and each loop is a fan of triangles.  Neighbouring cells see the same face alike, so
surfaces have no gaps.  A vertex belongs to a grid edge, by which it is shared across cells.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.grid import DIMS
from fieldloom.operators import halo
from fieldloom.operators.halo import CORNERS
from fieldloom.sources.store import stored

#: The corners of each face in ring order, seen from outside.
FACES = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7))
#: The ends of each edge.
EDGE_ENDS = tuple(sorted({tuple(sorted((f[i], f[(i + 1) % 4]))) for f in FACES for i in range(4)}))
_EDGE = {e: i for i, e in enumerate(EDGE_ENDS)}


@lru_cache(256)
def case_triangles(case: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles, by edges, of the cell whose corner k is at or above the isovalue if bit k is set."""
    following = {}
    for face in FACES:
        inside = [case >> c & 1 for c in face]
        for i in range(4):
            # a run of inside corners that ends at corner i of the ring: the segment around the run
            if inside[i] and not inside[(i + 1) % 4]:
                j = i
                while inside[(j - 1) % 4]:
                    j -= 1
                leave = _EDGE[tuple(sorted((face[i], face[(i + 1) % 4])))]
                enter = _EDGE[tuple(sorted((face[j % 4], face[(j - 1) % 4])))]
                following[leave] = enter
    out, left = [], dict(following)
    while left:
        start, at = min(left), None
        loop = [start]
        at = left.pop(start)
        while at != start:
            loop.append(at)
            at = left.pop(at)
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return tuple(out)


def _cases(iso: float, field: str):
    """Which cells the surface may cross, and their cases."""

    def of(dense: halo.Dense) -> tuple[np.ndarray, np.ndarray]:
        corners = dense.corners(field)
        case = np.zeros(corners[0].shape, np.int32)
        for k, v in enumerate(corners):
            with np.errstate(invalid="ignore"):
                case |= (v >= iso).astype(np.int32) << k
        return halo.whole(corners), case

    return of


def case_histogram(voxels: DataFrame, iso: float, field: str = "f") -> DataFrame:
    """(step, case_id, n)"""
    cases = _cases(iso, field)

    def kernel(dense: halo.Dense) -> dict[str, np.ndarray]:
        full, case = cases(dense)
        which, n = np.unique(np.stack([np.broadcast_to(dense.step[:, None, None, None], full.shape)[full], case[full]]), axis=1, return_counts=True)
        return {"step": which[0], "case_id": which[1].astype(np.int32), "n": n}

    found = halo.run(halo.chunks(voxels, (field,)), kernel, "step long, case_id int, n long", (field,))
    return found.groupBy("step", "case_id").agg(F.sum("n").alias("n"))


def active_cells(parts: DataFrame, iso: float, field: str = "f", size=halo.CHUNK) -> DataFrame:
    """(step, d0, d1, d2, case_id): the cells of chunks that the surface crosses."""
    cases = _cases(iso, field)

    def kernel(dense: halo.Dense) -> dict[str, np.ndarray]:
        full, case = cases(dense)
        met = full & (case > 0) & (case < 255)
        return dense.places(met) | {"case_id": case[met]}

    return halo.run(parts, kernel, f"{halo.PLACE}, case_id int", (field,), size=size)


def edge_vertices(voxels: DataFrame, iso: float, value: str = "f", normals: bool = False) -> DataFrame:
    """(step, d0, d1, d2, axis, x0, x1, x2[, n0, n1, n2]): where the surface crosses grid edges, named by their lower end and dimension.

    A vertex lies at w = (iso - v1) / (v2 - v1) between the ends; its normal is the gradient there,
    between the gradients of the ends, not brought to length one.
    """

    def kernel(dense: halo.Dense) -> dict[str, np.ndarray]:
        parts, v1 = [], dense.shifted(value)
        for axis in range(3):
            v2 = dense.shifted(value, halo.step_along(axis, 1))
            crossed = np.isfinite(v1) & np.isfinite(v2)
            with np.errstate(invalid="ignore"):
                crossed &= (v1 >= iso) != (v2 >= iso)
                w = ((iso - v1) / (v2 - v1))[crossed]
            at = dense.places(crossed)
            row = at | {"axis": np.full(len(w), axis, np.int32)} | {f"x{i}": at[d] + (w if i == axis else 0.0) for i, d in enumerate(DIMS)}
            for i in range(3) if normals else ():
                ends = []
                for by in (0, 1):
                    o = np.array(halo.step_along(axis, by))
                    ends.append(halo.gradient(*(dense.shifted(value, tuple(o + halo.step_along(i, k))) for k in (-1, 0, 1)))[crossed])
                row[f"n{i}"] = ends[0] + w * (ends[1] - ends[0])
            parts.append(row)
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    halos = (1, 2) if normals else (0, 1)
    columns = ", ".join(f"{x}{i} double" for x in ("x", "n")[: 1 + normals] for i in range(3))
    return halo.run(halo.chunks(voxels, (value,), *halos), kernel, f"{halo.PLACE}, axis int, {columns}", (value,), *halos)


def case_table(spark) -> DataFrame:
    """(case_id, triangles): how many triangles each case has."""
    return spark.createDataFrame([(c, len(case_triangles(c))) for c in range(256)], "case_id int, triangles int")


def mesh_stats(voxels: DataFrame, iso: float) -> DataFrame:
    """(step, cells, triangles, vertices) of the surface."""
    counts = case_histogram(voxels, iso).where("case_id not in (0, 255)").join(F.broadcast(case_table(voxels.sparkSession)), "case_id")  # 256 rows
    counts = counts.groupBy("step").agg(F.sum("n").alias("cells"), F.sum(F.col("n") * F.col("triangles")).alias("triangles"))
    vertices = edge_vertices(voxels, iso).groupBy("step").agg(F.count(F.lit(1)).alias("vertices"))
    return counts.join(vertices, "step", "left")


def triangle_table() -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(case, k, three edges as offsets of their lower end and their dimension), of all 256 cases: about 800 rows."""
    ends = [(CORNERS[a], CORNERS[b]) for a, b in EDGE_ENDS]
    edges = [(*(min(a[2 - i], b[2 - i]) for i in range(3)), next(i for i in range(3) if a[2 - i] != b[2 - i])) for a, b in ends]
    return [(case, k, [edges[e] for e in tri]) for case in range(256) for k, tri in enumerate(case_triangles(case))]


def triangles(voxels: DataFrame, iso: float) -> DataFrame:
    """(step, d0, d1, d2, k, a, b, c): triangles of each cell by their vertices' grid edges, each a string ``d0,d1,d2,axis``."""
    return triangles_of_cells(active_cells(halo.chunks(voxels), iso))


def triangles_of_cells(active: DataFrame) -> DataFrame:
    """Cells' triangles, by a join with the table of cases."""
    rows = [(case, k, *(x for e in tri for x in e)) for case, k, tri in triangle_table()]
    names = [f"{v}{x}" for v in "abc" for x in ("0", "1", "2", "axis")]
    table = active.sparkSession.createDataFrame(rows, "case_id int, k int, " + ", ".join(f"{n} int" for n in names))
    vertex = [F.concat_ws(",", *(F.col(d) + F.col(f"{v}{i}") for i, d in enumerate(DIMS)), F.col(f"{v}axis")).alias(v) for v in "abc"]
    return active.join(F.broadcast(table), "case_id").select("step", *DIMS, "k", *vertex)  # about 800 rows


def boundary_edges(mesh: DataFrame) -> DataFrame:
    """(step, a, b): sides that one triangle alone has; a surface's holes and its rim."""
    sides = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    used = mesh.select("step", F.explode(sides).alias("s")).groupBy("step", F.col("s.a").alias("a"), F.col("s.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return used.where("n = 1").drop("n")


#: How much farther a third vertex may be looked for when no near one is left.
WIDER = 5.0


def fill_holes(mesh: DataFrame, vertices: DataFrame, cell: float = 2.0, rounds: int | None = None) -> DataFrame:
    """(step, a, b, c): triangles that close a surface's holes, from sides that one triangle alone has.

    In each round a side takes the nearest vertex of another such side within twice its length or
    two cells, which meets it in a join by cubes of space; triangles that claim the same side, or
    a side that two triangles have by then, give way to the one of smallest (distance, names).
    Rounds go on until no side finds a triangle that isn't there yet; as no triangle comes twice, they
    end.  ``rounds`` stops before that, where a caller wants a part: ``fill_report`` tells what is
    left open.  Surfaces of ``triangles`` have no holes but at the volume's rim: this is for others'
    meshes.
    """
    there = stored(mesh.select("step", F.array_sort(F.array("a", "b", "c")).alias("t")).distinct(), "triangles")
    at = stored(vertices.select("step", F.concat_ws(",", *DIMS, "axis").alias("v"), "x0", "x1", "x2"), "hole-vertices")
    sides, added = stored(boundary_edges(mesh), "sides"), None
    wider, done = 1.0, 0
    while not sides.isEmpty() and (rounds is None or done < rounds):
        done += 1
        reach = cell * 4 * wider  # no side of a cell is longer than its diagonal
        ends = sides
        for v in "ab":
            ends = ends.join(at.select("step", F.col("v").alias(v), *(F.col(f"x{i}").alias(f"{v}{i}") for i in range(3))), ["step", v])
        middle = [((F.col(f"a{i}") + F.col(f"b{i}")) / 2).alias(f"m{i}") for i in range(3)]
        length = F.sqrt(sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(3)), F.lit(0.0)))
        ends = ends.select("step", "a", "b", *middle, F.least(F.greatest(length * 2, F.lit(cell * 2)) * wider, F.lit(reach)).alias("near"))
        rim = sides.select("step", F.explode(F.array("a", "b")).alias("v")).distinct().join(at, ["step", "v"])
        cube = lambda x: F.floor(F.col(x) / reach)
        asking = ends
        for i in range(3):
            asking = asking.withColumn(f"q{i}", F.explode(F.sequence(cube(f"m{i}") - 1, cube(f"m{i}") + 1)))
        asked = rim.select("step", "v", "x0", "x1", "x2", *(cube(f"x{i}").alias(f"q{i}") for i in range(3)))
        far = F.sqrt(sum(((F.col(f"m{i}") - F.col(f"x{i}")) ** 2 for i in range(3)), F.lit(0.0)))
        pairs = asking.join(asked, ["step", "q0", "q1", "q2"]).where((F.col("v") != F.col("a")) & (F.col("v") != F.col("b"))).withColumn("far", far).where(F.col("far") <= F.col("near"))
        best = pairs.groupBy("step", "a", "b").agg(F.min(F.struct("far", "v")).alias("m")).select("step", "a", "b", "m.far", "m.v")
        best = best.select("step", "far", F.array_sort(F.array("a", "b", "v")).alias("t")).groupBy("step", "t").agg(F.min("far").alias("far"))
        best = best.join(there, ["step", "t"], "left_anti")
        claims = best.select("step", "t", "far", F.explode(F.array(*[F.struct(F.col("t")[i].alias("a"), F.col("t")[j].alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))])).alias("s"))
        winners = claims.groupBy("step", "s").agg(F.min(F.struct("far", "t")).alias("m"))
        fit = claims.join(winners, ["step", "s"]).groupBy("step", "t").agg(F.bool_and(F.col("t") == F.col("m.t")).alias("fit")).where("fit")
        fit = stored(fit.select("step", F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c")), "filled")
        if fit.isEmpty():
            if wider > 1:
                break
            wider = WIDER
            continue
        added = fit if added is None else added.union(fit)
        there = there.union(fit.select("step", F.array("a", "b", "c").alias("t")))
        # sides of the new triangles count with those that are open: what then has two is closed
        new = fit.select("step", F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("s")).select("step", "s.a", "s.b")
        sides = stored(sides.union(new).groupBy("step", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n"), "sides")
    return added if added is not None else mesh.select("step", "a", "b", "c").limit(0)


def fill_report(mesh: DataFrame, vertices: DataFrame, cell: float = 2.0, rounds: int | None = None) -> DataFrame:
    """(step, triangles, open_sides, filled, left_open): what filling did, and the sides that one triangle alone has before and after it."""
    filled = stored(fill_holes(mesh, vertices, cell, rounds).select("step", "a", "b", "c"), "filling")
    whole = mesh.select("step", "a", "b", "c")
    count = lambda df, name: df.groupBy("step").agg(F.count(F.lit(1)).alias(name))
    out = count(whole, "triangles")
    for df, name in ((boundary_edges(whole), "open_sides"), (filled, "filled"), (boundary_edges(whole.union(filled)), "left_open")):
        out = out.join(count(df, name), "step", "left")
    return out.na.fill(0)


def degenerate(mesh: DataFrame) -> DataFrame:
    """Triangles two of whose vertices are one."""
    return mesh.where("a = b or b = c or c = a")
