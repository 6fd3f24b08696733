"""A stored index: blocks with a halo beside the intervals of their values, which queries read by pushed filters.

A block is a row: its number, its own values as an array, those of the planes after it as another,
the interval of its own values (``f_lo``, ``f_hi``) and that of the cells it owns (``f_cell_lo``,
``f_cell_hi``).  Files are partitioned by step.  Within a step blocks lie by the class of their
interval's length (a power of two) and then by low: intervals of one class and of about one low
have about one high too, so both ends of a range prune, whatever the lengths that a field mixes.  Row
groups and pages are small; a filter on an interval skips files, row groups and pages by their
statistics, and arrays are read of blocks that are left.  Intervals of the tiling shifted by half a
block are a table beside it, in the same order, and an octree over the blocks is a table with a
partition for each level, in the order of Morton keys, so a node's blocks are a run of keys.  Ranges
of steps are a table of their own, which prunes partitions before.  As a block's halo has all its cells, what is computed from cells needs no
neighbours and no shuffle of values.

An index stays: its folder has a manifest with the grid, the fields and what tells the table that it
was made from.  A later session opens it by its folder, and ``current`` builds it again when the
table's files are others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.functions.grid import BLOCKS, DIMS, Grid, block_id, morton, quotient, with_blocks
from fieldloom.operators import analytics, halo, mesh
from fieldloom.sources.store import exists, fingerprint, new_build, publish, published

#: Of the manifest and the tables' layout.
VERSION = 3
#: Bytes of a row group, and rows of a page.
GROUP_BYTES, PAGE_ROWS = 4 << 20, 128
#: Blocks of a file, at most and (where there are threads for more files) at least, about.
FILE_BLOCKS, LEAST_BLOCKS = 1 << 16, 1 << 12
#: Steps whose ranges (some 50 bytes each) the manifest has and the driver may hold; those of more are joined, and prune partitions as the query runs.
HELD_STEPS = 4096
#: Nodes of an octree's level that the driver may hold, and runs of keys that a filter may name.
HELD_NODES, RUNS = 4096, 64

_TABLES = ("blocks", "shifted", "octree", "steps")


def length_class(lo: Column, hi: Column) -> Column:
    """The power of two below an interval's length; intervals of no length are a class below all."""
    return F.when(hi > lo, F.floor(F.log2(hi - lo))).otherwise(-2000).cast("int")


def _files(spark: SparkSession, blocks: int) -> int:
    """How many ranges so many blocks are written in: as many as their number calls for, and no fewer than threads if they aren't tiny."""
    return max(1, -(-blocks // FILE_BLOCKS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // LEAST_BLOCKS))


def _laid_out(rows: DataFrame, blocks: int, first: str, path: str) -> None:
    """Writes rows by step, class of length and low, in as many files as their number calls for."""
    by = ["step", f"{first}_class", f"{first}_lo", "block_id"]
    rows = rows.withColumn(f"{first}_class", length_class(F.col(f"{first}_lo"), F.col(f"{first}_hi")))
    writer = rows.repartitionByRange(_files(rows.sparkSession, blocks), *by).sortWithinPartitions(*by).write.partitionBy("step")
    writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").parquet(path)


def runs_of(nodes: list[tuple[int, int]], most: int = RUNS) -> list[tuple[int, int, int]]:
    """(step, first, last): neighbouring keys of a step as runs, at most so many: the runs with the smallest gaps between them are put together."""
    runs: list[list[int]] = []
    for step, key in sorted(nodes):
        if runs and runs[-1][0] == step and runs[-1][2] + 1 >= key:
            runs[-1][2] = key
        else:
            runs.append([step, key, key])
    gaps = sorted((b[1] - a[2], i) for i, (a, b) in enumerate(zip(runs, runs[1:])) if a[0] == b[0])
    for i in sorted((i for _, i in gaps[: max(0, len(runs) - most)]), reverse=True):
        runs[i][2] = runs.pop(i + 1)[2]
    return [tuple(r) for r in runs]


class FieldIndex:
    """The stored index of a field in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, published(spark, path)
        if self.manifest is None or self.manifest["version"] != VERSION:
            raise ValueError(f"no index of this version in {path}")
        self.build_path, self.fields = self.manifest["build"], tuple(self.manifest["fields"])
        self.grid = Grid(tuple(self.manifest["shape"]), tuple(self.manifest["block"]))
        self.schemas = {name: StructType.fromJson(x) for name, x in self.manifest["schemas"].items()}
        self.held = self.manifest["steps"]
        self._tables: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        """A table of the build, whose files are listed once: a build's files never change."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(self.schemas[name]).parquet(f"{self.build_path}/{name}")
        return self._tables[name]

    @classmethod
    def current(cls, spark: SparkSession, path: str, tables: list[str], make) -> "FieldIndex":
        """The index in ``path`` of these tables as they are now: built by ``make`` () -> (voxels, grid, fields) where there is none, or one of other files."""
        seen = fingerprint(spark, *tables)
        old = published(spark, path)
        if old is None or old["version"] != VERSION or old["source"] != seen or not exists(spark, f"{old['build']}/steps/_SUCCESS"):
            voxels, grid, names = make()
            return cls.build(voxels, grid, path, names, seen)
        return cls(spark, path)

    @classmethod
    def build(cls, voxels: DataFrame, grid: Grid, path: str, fields: tuple[str, ...] = ("f",), source: str = "") -> "FieldIndex":
        """Writes the blocks, with one shuffle of voxels to their blocks and one of blocks to files, the shifted intervals and the steps, and publishes them."""
        spark, into = voxels.sparkSession, new_build(path)
        e1, e2 = (n + 1 for n in grid.block[1:])
        b = [F.col(c).alias(x) for c, x in zip(halo.CHUNKS, BLOCKS)]
        out = halo.chunks(voxels, fields, 0, 1, grid.block).select("step", *b, "offsets", *fields)
        n0, n1, n2 = grid.block
        inner = lambda o: (quotient(o, e1 * e2) < n0) & (quotient(o, e2) % e1 < n1) & (o % e2 < n2)
        both = F.array_sort(F.arrays_zip("offsets", *fields))
        out = out.withColumn("own", F.filter(both, lambda c: inner(c["offsets"]))).withColumn("beside", F.filter(both, lambda c: ~inner(c["offsets"])))
        place = lambda o: ((quotient(o, e1 * e2) * n1 + quotient(o, e2) % e1) * n2 + o % e2).cast("int")
        # a block's own values stand in order of place, so places are kept of blocks alone that lack some
        out = out.withColumn("own_places", F.when(F.size("own") < n1 * n2 * n0, F.transform("own.offsets", place))).withColumn("beside_offsets", F.col("beside.offsets"))
        for f in fields:
            out = out.withColumns({f"{f}_own": F.col(f"own.{f}"), f"{f}_beside": F.col(f"beside.{f}"), f"{f}_cell_lo": F.array_min(f), f"{f}_cell_hi": F.array_max(f)})
            out = out.withColumns({f"{f}_lo": F.array_min(f"{f}_own"), f"{f}_hi": F.array_max(f"{f}_own"), f"{f}_n": F.size(f"{f}_own").cast("long")})
        out = out.drop("own", "beside", "offsets", *fields).where(F.col(f"{fields[0]}_n") > 0).withColumn("block_id", block_id(grid.counts))
        blocks = -(-voxels.count() // (n0 * n1 * n2))
        _laid_out(out, blocks, fields[0], f"{into}/blocks")
        ends = [x for f in fields for x in (F.min(f).alias(f"{f}_lo"), F.max(f).alias(f"{f}_hi"), F.count(f).alias(f"{f}_n"))]
        shifted = with_blocks(voxels, grid, "stagger").groupBy("step", "block_id", *BLOCKS).agg(*ends)
        _laid_out(shifted, blocks, fields[0], f"{into}/shifted")
        ranges = [x for f in fields for x in (F.min(f"{f}_lo").alias(f"{f}_lo"), F.max(f"{f}_hi").alias(f"{f}_hi"), F.sum(f"{f}_n").alias(f"{f}_n"))]
        written = spark.read.parquet(f"{into}/blocks").withColumn("step", F.col("step").cast("long"))
        levels = max(1, max(grid.counts) - 1).bit_length()
        keyed = written.select("step", morton(*(F.col(x) for x in BLOCKS)).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), *(f"{f}_{x}" for f in fields for x in ("lo", "hi", "n")))
        tree = keyed.groupBy("level", "step", F.expr("shiftright(key, 3 * level)").alias("morton")).agg(*ranges)
        by = ["level", "step", "morton"]
        writer = tree.repartitionByRange(_files(spark, blocks), *by).sortWithinPartitions(*by).write.partitionBy("level")
        writer.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{into}/octree")
        written.groupBy("step").agg(*ranges).coalesce(1).write.parquet(f"{into}/steps")
        tables = {name: spark.read.parquet(f"{into}/{name}") for name in _TABLES}
        steps = [r.asDict() for r in tables["steps"].limit(HELD_STEPS + 1).collect()]
        nodes = {str(r["level"]): r["n"] for r in tables["octree"].groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        manifest = {"version": VERSION, "nodes": nodes, "build": into, "source": source, "shape": grid.shape, "block": grid.block, "fields": fields, "steps": steps if len(steps) <= HELD_STEPS else None}
        publish(spark, path, manifest | {"schemas": {name: json.loads(t.schema.json()) for name, t in tables.items()}})
        return cls(spark, path)

    def blocks(self) -> DataFrame:
        return self._read("blocks").withColumn("step", F.col("step").cast("long"))

    def steps(self, **ranges: tuple[float, float]) -> DataFrame:
        """Steps whose range meets every field's: candidates of all fields, by the stored table."""
        out = self._read("steps")
        for f, (lo, hi) in ranges.items():
            out = out.where((F.col(f"{f}_lo") <= hi) & (F.col(f"{f}_hi") >= lo))
        return out.select("step")

    def zones(self, field: str = "f", tiling: str = "uniform") -> DataFrame:
        """The zone map of the aligned or of the shifted (``stagger``) blocks, as stored: arrays aren't read."""
        rows = self._read("blocks" if tiling == "uniform" else "shifted").withColumn("step", F.col("step").cast("long"))
        return rows.select("step", "block_id", *BLOCKS, F.col(f"{field}_lo").alias("lo"), F.col(f"{field}_hi").alias("hi"), F.col(f"{field}_n").alias("n"))

    def candidates(self, met: Column, **ranges: tuple[float, float]) -> DataFrame:
        """Blocks that ``met`` holds for, of the steps that meet the ranges: partitions are pruned by the steps, row groups and pages by the intervals."""
        out, kind = self._read("blocks").where(met), self.schemas["blocks"]["step"].dataType
        if self.held is not None:
            meets = lambda r: all(r[f"{f}_lo"] <= hi and r[f"{f}_hi"] >= lo for f, (lo, hi) in ranges.items())
            out = out.where(F.col("step").isin([r["step"] for r in self.held if meets(r)]))
        else:
            out = out.join(self.steps(**ranges).select(F.col("step").cast(kind).alias("step")), "step", "left_semi")
        return out.withColumn("step", F.col("step").cast("long"))

    def meeting(self, lo: float, hi: float, field: str = "f") -> DataFrame:
        """The blocks whose own values' interval meets the range."""
        return self.candidates((F.col(f"{field}_lo") <= hi) & (F.col(f"{field}_hi") >= lo), **{field: (lo, hi)})

    def values(self, lo: float, hi: float, field: str = "f") -> DataFrame:
        """(step, d0, d1, d2, field): the voxels within the range."""
        return self.values_of(self.meeting(lo, hi, field), lo, hi, field)

    def values_of(self, hit: DataFrame, lo: float, hi: float, field: str = "f") -> DataFrame:
        """The voxels within the range of these blocks."""
        _, n1, n2 = self.grid.block
        cells = hit.select("step", *BLOCKS, "own_places", F.posexplode(f"{field}_own").alias("k", field)).where(F.col(field).between(lo, hi))
        place = F.coalesce(F.element_at("own_places", F.col("k") + 1), "k")
        cells = cells.select("step", *BLOCKS, place.alias("place"), field)
        inner = [quotient(F.col("place"), n1 * n2), quotient(F.col("place"), n2) % n1, F.col("place") % n2]
        return cells.select("step", *((F.col(b) * n + o).cast("int").alias(d) for b, n, o, d in zip(BLOCKS, self.grid.block, inner, DIMS)), field)

    def octree_nodes(self, level: int, lo: float, hi: float, field: str = "f") -> DataFrame:
        """(step, morton) of a level's nodes that meet the range; other levels' files aren't listed for it."""
        met = (F.col("level") == level) & (F.col(f"{field}_lo") <= hi) & (F.col(f"{field}_hi") >= lo)
        return self._read("octree").where(met).select("step", "morton")

    def octree_blocks(self, lo: float, hi: float, field: str = "f") -> DataFrame:
        """(step, morton) of the blocks that meet the range, by the stored tree.

        The lowest level whose nodes the driver may hold gives the nodes that meet the range, and
        those give runs of keys, which are pushed down to the blocks: pages beside the runs aren't
        read.  Where even the roots are too many, or their runs are, intervals alone prune.
        """
        level = min((int(k) for k, n in self.manifest["nodes"].items() if n <= HELD_NODES), default=None)
        out = self.octree_nodes(0, lo, hi, field)
        if not level:
            return out
        runs = runs_of([tuple(r) for r in self.octree_nodes(level, lo, hi, field).collect()])
        if len(runs) > RUNS:
            return out
        within = F.lit(False)
        for step, first, last in runs:
            within = within | ((F.col("step") == step) & (F.col("morton") >= first << (3 * level)) & (F.col("morton") < (last + 1) << (3 * level)))
        return out.where(within)

    def observed_values(self, lo: float, hi: float, field: str = "f") -> tuple[DataFrame, Observation]:
        """``values`` with an observation, which has the number of blocks that met the range once the rows have been read."""
        seen = Observation()
        return self.values_of(self.meeting(lo, hi, field).observe(seen, F.count(F.lit(1)).alias("blocks_hit")), lo, hi, field), seen

    def _chunks(self, hit: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        """Blocks as chunks with a plane of halo: own values and those beside them in one array."""
        n0, n1, n2 = self.grid.block
        e1, e2 = n1 + 1, n2 + 1
        full = F.array(*(F.lit((i * e1 + j) * e2 + k) for i in range(n0) for j in range(n1) for k in range(n2)))
        some = F.transform("own_places", lambda p: ((quotient(p, n1 * n2) * e1 + quotient(p, n2) % n1) * e2 + p % n2).cast("int"))
        offsets = F.concat(F.when(F.col("own_places").isNull(), full).otherwise(some), "beside_offsets")
        return hit.select("step", *(F.col(x).alias(c) for x, c in zip(BLOCKS, halo.CHUNKS)), offsets.alias("offsets"), *(F.concat(f"{f}_own", f"{f}_beside").alias(f) for f in fields))

    def _cells_meet(self, field: str, lo: float, hi: float) -> Column:
        return (F.col(f"{field}_cell_lo") <= hi) & (F.col(f"{field}_cell_hi") >= lo)

    def scatterplot(self, f_range: tuple[float, float], g_range: tuple[float, float], resolution: int = 256) -> DataFrame:
        """The scatterplot from the blocks whose cells meet both ranges."""
        hit = self.candidates(self._cells_meet("f", *f_range) & self._cells_meet("g", *g_range), f=f_range, g=g_range)
        return analytics.scatterplot_of_chunks(self._chunks(hit, ("f", "g")), f_range, g_range, resolution, self.grid.block)

    def triangles(self, iso: float, field: str = "f") -> DataFrame:
        """The isosurface from the blocks whose cells it crosses."""
        hit = self.candidates(self._cells_meet(field, iso, iso), **{field: (iso, iso)})
        return mesh.triangles_of_cells(mesh.active_cells(self._chunks(hit, (field,)), iso, field, self.grid.block))


def candidate_blocks(index: FieldIndex, f_range: tuple[float, float], g_range: tuple[float, float]) -> DataFrame:
    """(step, block_id): aligned blocks that meet both ranges, of the steps that meet both."""
    both = (F.col("f_lo") <= f_range[1]) & (F.col("f_hi") >= f_range[0]) & (F.col("g_lo") <= g_range[1]) & (F.col("g_hi") >= g_range[0])
    return index.candidates(both, f=f_range, g=g_range).select("step", "block_id")
