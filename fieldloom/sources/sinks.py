"""Stored fields and indexes, and exports of bounded results to other programs' formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.order import ranked
from fieldloom.sources.store import stored


def write_field(df: DataFrame, path: str) -> None:
    """A table partitioned by step; rows of a partition stand in block order where they have one, so a block's rows share row groups."""
    order = [c for c in ("block_id", "d0", "d1", "d2") if c in df.columns]
    out = df.repartition("step", *([F.floor(F.col("block_id") / 4096)] if "block_id" in order else []))
    out.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy("step").parquet(path)


def write_intervals(df: DataFrame, path: str) -> None:
    df.select("lo", "hi").write.mode("overwrite").csv(path)


def write_numbers(df: DataFrame, path: str, column: str = "f") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_image(density: DataFrame, path: str, resolution: tuple[int, int]) -> None:
    """A dense scatterplot: two 64-bit sizes, then doubles; the image is as large as its resolution says, not as the field."""
    image = np.zeros(resolution)
    for r in density.collect():
        image[r["bin_f"], r["bin_g"]] = r["density"]
    with open(path, "wb") as f:
        f.write(struct.pack("<qq", *resolution))
        image.tofile(f)


def _planes(voxels: DataFrame, shape: tuple[int, int, int], value: str) -> Iterator[np.ndarray]:
    """The planes of one step along the first dimension, in order, one at a time on the driver; absent voxels are NaN."""
    at = (F.col("d1").cast("long") * shape[2] + F.col("d2")).alias("at")
    rows = voxels.groupBy("d0").agg(F.collect_list(F.struct(at, F.col(value).cast("double").alias("v"))).alias("c")).select("d0", F.col("c.at").alias("at"), F.col("c.v").alias("v")).orderBy("d0")
    following = 0
    for r in rows.toLocalIterator():
        for _ in range(following, r["d0"]):
            yield np.full(shape[1:], np.nan)
        plane = np.full(shape[1] * shape[2], np.nan)
        plane[r["at"]] = r["v"]
        following = r["d0"] + 1
        yield plane.reshape(shape[1:])
    for _ in range(following, shape[0]):
        yield np.full(shape[1:], np.nan)


def write_raw(voxels: DataFrame, path: str, shape: tuple[int, int, int], dtype: str = "<f8", value: str = "f") -> None:
    """One step as a headerless array of this type and byte order, a plane at a time."""
    with open(path, "wb") as f:
        for plane in _planes(voxels, shape, value):
            f.write(plane.astype(dtype).tobytes())


def write_vtk_volume(voxels: DataFrame, path: str, shape: tuple[int, int, int], value: str = "f") -> None:
    """One step as legacy VTK structured points, big-endian single precision, a plane at a time."""
    with open(path, "wb") as f:
        f.write(f"# vtk DataFile Version 3.0\nvolume\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {shape[2]} {shape[1]} {shape[0]}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {int(np.prod(shape))}\nSCALARS {value} float 1\nLOOKUP_TABLE default\n".encode())
        for plane in _planes(voxels, shape, value):
            f.write(plane.astype(">f4").tobytes())


def write_vti(voxels: DataFrame, path: str, shape: tuple[int, int, int], value: str = "f", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> None:
    """One step as VTK image data, numbers as text, a plane at a time."""
    extent = " ".join(f"0 {n - 1}" for n in reversed(shape))
    with open(path, "w") as f:
        f.write(f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="{extent}" Origin="0 0 0" Spacing="{" ".join(map(str, spacing))}">\n<Piece Extent="{extent}">\n<PointData Scalars="{value}">\n<DataArray type="Float64" Name="{value}" format="ascii">\n')
        for plane in _planes(voxels, shape, value):
            for line in plane:
                f.write(" ".join(map(repr, line.tolist())) + "\n")
        f.write("</DataArray>\n</PointData>\n<CellData>\n</CellData>\n</Piece>\n</ImageData>\n</VTKFile>\n")


def write_vtk_mesh(vertices: DataFrame, mesh: DataFrame, path: str) -> None:
    """One step's surface as legacy VTK polygons, with the vertices' normals where they have any.

    Vertices are numbered and joined to the triangles in Spark; the driver holds a partition of
    rows at a time.
    """
    name = F.concat_ws(",", "d0", "d1", "d2", "axis").alias("name")
    normals = [c for c in ("n2", "n1", "n0") if c in vertices.columns]
    numbered = stored(ranked(vertices.select("d0", "d1", "d2", "axis", "x2", "x1", "x0", *normals, name), [], ["d0", "d1", "d2", "axis"], "number"), "vertices")
    corners = mesh.select("d0", "d1", "d2", "k", "a", "b", "c")
    for v in "abc":
        corners = corners.join(numbered.select(F.col("name").alias(v), (F.col("number") - 1).alias(f"n{v}")), v)
    corners = stored(corners.select("d0", "d1", "d2", "k", "na", "nb", "nc"), "polygons")
    points, polygons = numbered.count(), corners.count()
    with open(path, "w") as f:
        f.write(f"# vtk DataFile Version 3.0\nsurface\nASCII\nDATASET POLYDATA\nPOINTS {points} double\n")
        for r in numbered.orderBy("number").select("x2", "x1", "x0").toLocalIterator():
            f.write(f"{r[0]} {r[1]} {r[2]}\n")
        f.write(f"POLYGONS {polygons} {4 * polygons}\n")
        for r in corners.orderBy("d0", "d1", "d2", "k").select("na", "nb", "nc").toLocalIterator():
            f.write(f"3 {r[0]} {r[1]} {r[2]}\n")
        if normals:
            f.write(f"POINT_DATA {points}\nNORMALS normals double\n")
            for r in numbered.orderBy("number").select(*normals).toLocalIterator():
                f.write(f"{r[0]} {r[1]} {r[2]}\n")
