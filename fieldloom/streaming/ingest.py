"""Fields that arrive in pieces: each micro-batch adds its blocks' intervals to the stored zone map.

A step's voxels may come in any number of batches, in any order, late ones after those of later
steps.  A batch stores for each block that it touches the interval of its own voxels and which voxels
they are, a bit for each place, so batches merge by minimum, maximum and union: a voxel that comes
twice counts once, and a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.grid import BLOCKS, DIMS, Grid, block_id, block_index, quotient
from fieldloom.sources.store import new_build, publish, published

#: Places of a block in one number of the seen ones.
WORD = 64
KEYS = ["tiling", "step", "block_id", *BLOCKS]


def pieces(voxels: DataFrame, grid: Grid, value: str = "f") -> DataFrame:
    """(tiling, step, block_id, b0, b1, b2, word, lo, hi, seen) of both tilings: intervals of what is here of a block's ``word``-th ``WORD`` places, and which places have a value.

    Each voxel counts for two blocks, in one aggregation.
    """
    tilings = []
    for tiling in ("uniform", "stagger"):
        b = [block_index(F.col(d), n, tiling) for d, n in zip(DIMS, grid.block)]
        # blocks are no larger than a block's sides, so places are told apart by coordinates modulo the sides
        tilings.append(F.struct(F.lit(tiling).alias("tiling"), block_id(grid.block_counts(tiling), b).alias("block_id"), *(x.alias(name) for x, name in zip(b, BLOCKS))))
    place = (F.col("d0") % grid.block[0] * grid.block[1] + F.col("d1") % grid.block[1]) * grid.block[2] + F.col("d2") % grid.block[2]
    both = voxels.where(F.col(value).isNotNull()).select("step", value, quotient(place, WORD).cast("int").alias("word"), (place % WORD).cast("int").alias("bit"), F.explode(F.array(*tilings)).alias("at"))
    return both.select("at.tiling", "step", "at.block_id", *(f"at.{b}" for b in BLOCKS), "word", value, "bit").groupBy(*KEYS, "word").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("seen"))


def merged(parts: DataFrame) -> DataFrame:
    """Pieces of one block and word put together."""
    return parts.groupBy(*KEYS, "word").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("seen").alias("seen"))


def index_stream(spark: SparkSession, folder: str, schema: str, grid: Grid, into: str, checkpoint: str) -> StreamingQuery:
    """Indexes files of voxels as they arrive in ``folder``."""

    def add(batch: DataFrame, number: int) -> None:
        pieces(batch, grid).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, into: str) -> DataFrame:
    """All pieces: those put together before, and those of the batches since."""
    m = published(spark, into)
    since = spark.read.option("basePath", into).parquet(f"{into}/batch=*")
    if m is None:
        return since.drop("batch")
    return spark.read.parquet(m["build"]).unionByName(since.where(F.col("batch") > m["batch"]).drop("batch"))


def indexed(spark: SparkSession, into: str) -> DataFrame:
    """(tiling, step, block_id, b0, b1, b2, lo, hi, n): the zone maps of what has arrived."""
    words = merged(_parts(spark, into))
    return words.groupBy(*KEYS).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.bit_count("seen")).cast("long").alias("n"))


def compact(spark: SparkSession, into: str) -> None:
    """Puts the pieces of all batches so far together in one table, so reading costs what blocks do and not what batches did."""
    build, last = new_build(into), spark.read.option("basePath", into).parquet(f"{into}/batch=*").agg(F.max("batch")).first()[0]
    merged(_parts(spark, into)).write.parquet(build)
    publish(spark, into, {"build": build, "batch": last})
