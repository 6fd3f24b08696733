"""Fields derived from the given tables: long form (step, d0, d1, d2, f, g), and block form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.grid import Grid, coordinates, quotient

#: The least side of a step of events, and how many steps there are at least beyond that.
LEAST_SIDE, LEAST_STEPS = 8, 2
#: Block of the order-line field, whose shape is neither cubic nor divisible.
LINE_GRID = Grid((50, 11, 9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """A cube whose side is the largest power of two that gives ``LEAST_STEPS`` steps, at any number of events."""
    n, side = table(spark, sf_dir, "events").count(), LEAST_SIDE
    while (2 * side) ** 3 * LEAST_STEPS <= n:
        side *= 2
    return Grid((side,) * 3)


def event_field(spark: SparkSession, sf_dir: str, grid: Grid | None = None) -> tuple[DataFrame, Grid]:
    """All events as voxels, numbered by event_id; f is their value, g the number of their user.  The last step may be incomplete."""
    grid = grid or event_grid(spark, sf_dir)
    events = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("g"))
    step = quotient(F.col("event_id"), grid.volume).cast("long").alias("step")
    return events.select(step, *coordinates(F.col("event_id") % grid.volume, grid.shape), F.col("value").alias("f"), "g"), grid


def line_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """All order lines on a grid of quantity, discount and tax, a step for each year: f is the mean price, g the number of lines.

    Prices are summed in whole cents, so the mean doesn't depend on the order of summation.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("step"), (F.col("l_quantity") - 1).cast("int").alias("d0"), F.round(F.col("l_discount") * 100).cast("int").alias("d1"),
        F.round(F.col("l_tax") * 100).cast("int").alias("d2"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    grouped = lines.groupBy("step", "d0", "d1", "d2").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    return grouped.select("step", "d0", "d1", "d2", (F.col("cents") / (F.col("n") * 100)).alias("f"), F.col("n").cast("double").alias("g")), LINE_GRID


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as blocks of 4 x 4 x 4 single-precision values: (step, block_id, values)."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("step"), F.col("vec_id").alias("block_id"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))


def list_variables(spark: SparkSession) -> list[str]:
    """Names of the fields registered in the session's catalogue."""
    return sorted(t.name for t in spark.catalog.listTables())


def safe_name(field: str) -> str:
    """A field's name as a file name."""
    return field.strip("/").replace("/", "_")
