"""Ranks within large groups: rows are cut by range, so no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.store import stored

#: Rows of a range, about.
RANGE_ROWS = 1 << 18


def ranges_of(spark, n: int) -> int:
    """How many ranges ``n`` rows are cut into: a task for each thread that queries use, and more as rows call for them."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1024 + 1), -(-n // RANGE_ROWS))


def parted(rows: DataFrame, keys: list[str], by: list[str | Column]) -> DataFrame:
    """``rows`` with ``part``, a number of ranges of (keys, by) that ascends with them; their number grows with the rows.

    Rows are written once before, so that what counts them, what samples them for the ranges and
    what deals them out doesn't compute them three times.
    """
    by = [F.col(b) if isinstance(b, str) else b for b in by]
    held = stored(rows, "rows")
    dealt = held.repartitionByRange(ranges_of(rows.sparkSession, held.count()), *(F.col(k) for k in keys), *by)
    return stored(dealt.withColumn("part", F.spark_partition_id()), "parts")


def before(parts: DataFrame, keys: list[str], total: Column, of: str) -> DataFrame:
    """(keys, part, of): the sum or maximum of a group's parts before each; as many rows as groups and ranges."""
    window = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "part").agg(total.alias("total"))
    over = F.max("total").over(window) if of == "max" else F.coalesce(F.sum("total").over(window), F.lit(0))
    return totals.select(*keys, "part", over.alias("before"))


def ranked(rows: DataFrame, keys: list[str], by: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 within ``keys``, in the order of ``by``."""
    parts = parted(rows, keys, by)
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*by))
    joined = parts.withColumn("own", own).join(before(parts, keys, F.count(F.lit(1)), "sum"), [*keys, "part"])
    return joined.select(*rows.columns, (F.col("before") + F.col("own")).cast("long").alias(name))
