"""Stored volumes as a data source: headerless arrays and HDF5 datasets, a file or several for each step.

    spark.read.format("field_volume").option("shape", "64,64,64").option("dtype", ">f4").load(folder)

gives (step, d0, d1, d2, f).  A file's name ends in its step's number, and in the plane that it begins
with where a step is cut into several files: ``temperature-12.raw``, ``12.planes-256.raw``.  Tasks read
byte ranges of whole planes; filters on the step choose files before any is opened, and filters on d0
choose planes, so bytes beside them aren't read.  Paths are of any store that pyarrow opens.  Without a
filter's push-down (``register`` turns it on for the session) Spark filters the rows itself.

``write`` makes such files from a table: tasks write files of some planes each, and nothing passes
through the driver.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from fieldloom.functions.grid import quotient
from fieldloom.sources.raw import _h5py

#: Bytes of a task's part of a file, about, and values that it hands on at once.
SLAB_BYTES, BATCH_VALUES = 32 << 20, 1 << 18
#: The end of a file's name: a step, and the first plane of a part.
NAME = re.compile(r"(\d+)(?:\.planes-(\d+))?\.\w+$")


@dataclass
class Slab(InputPartition):
    """Planes ``first`` to ``last`` (not included) of a step, in a file that begins with plane ``begins``."""

    path: str
    step: int
    begins: int
    first: int
    last: int


def _holds(f: Filter, value: int) -> bool:
    if isinstance(f, In):
        return value in f.value
    return {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shape = options["path"], tuple(map(int, options["shape"].split(","))) if "shape" in options else None
        self.dtype, self.dataset = np.dtype(options.get("dtype", "<f8")), options.get("dataset")
        if self.dataset is None and self.shape is None:
            raise ValueError("a headerless volume needs a shape")
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of step and d0 with numbers; leaves the others to Spark."""
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and f.attribute in (("step",), ("d0",)) and all(isinstance(v, int) for v in values):
                self.kept.append(f)
            else:
                yield f

    def _allows(self, column: str, value: int) -> bool:
        return all(_holds(f, value) for f in self.kept if f.attribute == (column,))

    def partitions(self) -> list[Slab]:
        """Slabs of the files of the steps asked for; the sizes of those files alone are looked at."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        out = []
        for info in sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path):
            name = NAME.search(posixpath.basename(info.path))
            if name is None or posixpath.basename(info.path)[0] in "._" or not self._allows("step", int(name[1])):
                continue
            begins = int(name[2] or 0)
            item, planes = self._planes(info)
            wide = max(1, SLAB_BYTES // max(1, item))
            wanted = [p for p in range(begins, begins + planes) if self._allows("d0", p)]
            # neighbouring planes make a slab
            for p in wanted:
                last = out[-1] if out else None
                if last and last.path == info.path and last.last == p and p - last.first < wide:
                    last.last += 1
                else:
                    out.append(Slab(info.path, int(name[1]), begins, p, p + 1))
        return out

    def _planes(self, info) -> tuple[int, int]:
        """Bytes of a plane and the number of planes of a file."""
        if self.dataset is not None:
            with _h5py().File(info.path) as f:
                shape = f[self.dataset].shape
            return int(np.prod(shape[1:])) * 8, shape[0]
        plane = self.shape[1] * self.shape[2] * self.dtype.itemsize
        if info.size % plane or info.size > plane * self.shape[0]:
            raise ValueError(f"{info.path} has {info.size} bytes, no whole planes of {plane} up to {self.shape[0]}")
        return plane, info.size // plane

    def read(self, slab: Slab | None) -> Iterator[pa.RecordBatch]:
        if slab is None:  # Spark reads once where there is nothing to read
            return
        for first, planes in self._values(slab):
            n, n1, n2 = planes.shape
            at = np.arange(planes.size)
            columns = [np.full(planes.size, slab.step), (first + at // (n1 * n2)).astype(np.int32), (at // n2 % n1).astype(np.int32), (at % n2).astype(np.int32), planes.ravel().astype(np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["step", "d0", "d1", "d2", "f"])

    def _values(self, slab: Slab) -> Iterator[tuple[int, np.ndarray]]:
        """Some planes at a time, with the number of the first."""
        if self.dataset is not None:
            with _h5py().File(slab.path) as f:
                for p in range(slab.first, slab.last):
                    yield p, np.asarray(f[self.dataset][p - slab.begins])[None]
            return
        _, n1, n2 = self.shape
        plane = n1 * n2 * self.dtype.itemsize
        some = max(1, BATCH_VALUES // (n1 * n2))
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(slab.path) as f:
            for p in range(slab.first, slab.last, some):
                n = min(some, slab.last - p)
                yield p, np.frombuffer(f.read_at(n * plane, (p - slab.begins) * plane), self.dtype).reshape(n, n1, n2)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "field_volume"

    def schema(self) -> str:
        return "step long, d0 int, d1 int, d2 int, f double"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and turns on the push-down of filters to such sources."""
    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, shape: tuple[int, int, int] | None = None, dtype: str = "<f8", dataset: str | None = None) -> DataFrame:
    """(step, d0, d1, d2, f) of the volumes in a folder or file."""
    register(spark)
    reader = spark.read.format("field_volume").option("dtype", dtype)
    if shape is not None:
        reader = reader.option("shape", ",".join(map(str, shape)))
    return (reader if dataset is None else reader.option("dataset", dataset)).load(path)


def write(voxels: DataFrame, path: str, shape: tuple[int, int, int], dtype: str = "<f8", value: str = "f") -> DataFrame:
    """Writes every step as headerless files of whole planes, about ``SLAB_BYTES`` each; returns (step, first, path, bytes) of the files.

    Absent voxels are NaN.  A file is written under a name of its own and then renamed, so a task that
    runs twice leaves one whole file.
    """
    n0, n1, n2 = shape
    kind = np.dtype(dtype)
    planes = max(1, min(n0, SLAB_BYTES // (n1 * n2 * kind.itemsize)))
    slab = quotient(F.col("d0"), planes).cast("int").alias("slab")
    at = ((F.col("d0").cast("long") % planes * n1 + F.col("d1")) * n2 + F.col("d2")).alias("at")
    rows = voxels.select(F.col("step").cast("long").alias("step"), slab, at, F.col(value).cast("double").alias("v"))

    def written(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        key, held = None, None

        def done():
            first = key[1] * planes
            held_planes = held[: min(planes, n0 - first) * n1 * n2].astype(kind)
            name = f"{root}/{key[0]}.planes-{first}.raw"
            own = f"{root}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(own) as f:
                f.write(held_planes.tobytes())
            store.move(own, name)
            return first, name, held_planes.nbytes

        def row(file):
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([file[0]], pa.int32()), pa.array([file[1]]), pa.array([file[2]])], ["step", "first", "path", "bytes"])

        for b in batches:
            step, slab, at, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("step", "slab", "at", "v"))
            cuts = np.concatenate([[0], np.flatnonzero((step[1:] != step[:-1]) | (slab[1:] != slab[:-1])) + 1, [len(step)]]) if len(step) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if (own := (int(step[lo]), int(slab[lo]))) != key:
                    if key is not None:
                        yield row(done())
                    key, held = own, np.full(planes * n1 * n2, np.nan)
                held[at[lo:hi]] = v[lo:hi]
        if key is not None:
            yield row(done())

    return rows.repartition("step", "slab").sortWithinPartitions("step", "slab").mapInArrow(written, "step long, first int, path string, bytes long")
