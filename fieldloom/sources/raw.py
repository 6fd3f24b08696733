"""Headerless arrays, interval tables and numbers as text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.grid import coordinates


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "<f8", step: int = 0) -> DataFrame:
    """(step, d0, d1, d2, f) of a headerless array; ``dtype`` gives size and byte order.

    Hadoop splits the file at multiples of one line along the last dimension, whose byte
    offset is its position, so a file of any size is read in parallel from any store.
    """
    item, line = np.dtype(dtype).itemsize, shape[2]
    conf = {"fixedlengthinputformat.record.length": str(item * line)}
    lines = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    raw = spark.createDataFrame(lines.map(lambda kv: (kv[0], bytearray(kv[1]))), "at long, line binary")

    def decode(batches):
        for pdf in batches:
            values = np.frombuffer(b"".join(bytes(x) for x in pdf["line"]), dtype).astype(np.float64)
            start = np.repeat(pdf["at"].to_numpy() // item, line) + np.tile(np.arange(line), len(pdf))
            yield pd.DataFrame({"p": start, "f": values})

    return raw.mapInPandas(decode, "p long, f double").select(F.lit(step).cast("long").alias("step"), *coordinates(F.col("p"), shape), "f")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(low, high) of headerless comma-separated text."""
    return spark.read.csv(path, schema="low double, high double")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """A number for each line of text."""
    return spark.read.text(path).select(F.col("value").cast("double").alias("value"))


def read_hdf5(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A three-dimensional dataset, one task for each plane of the first dimension; needs h5py and the file's path on the executors.

    The driver opens nothing: a task tells the number of planes.
    """

    def planes_of(batches):
        for pdf in batches:
            with _h5py().File(path) as f:
                yield pd.DataFrame({"n": [f[dataset].shape[0]] * len(pdf)})

    def planes(batches):
        for pdf in batches:
            with _h5py().File(path) as f:
                for d0 in pdf["id"]:
                    plane = np.asarray(f[dataset][int(d0)])
                    d1, d2 = np.indices(plane.shape)
                    yield pd.DataFrame({"step": 0, "d0": int(d0), "d1": d1.ravel(), "d2": d2.ravel(), "f": plane.ravel().astype(float)})

    n = spark.range(1, numPartitions=1).mapInPandas(planes_of, "n long").first()["n"]
    return spark.range(n, numPartitions=max(1, n)).mapInPandas(planes, "step long, d0 int, d1 int, d2 int, f double")


def _h5py():
    try:
        import h5py
    except ImportError as error:
        raise NotImplementedError("h5py isn't installed") from error
    return h5py


def read_steps(spark: SparkSession, path: str, steps: list[int] | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """A stored field, partitioned by step; only the steps asked for are read."""
    df = spark.read.parquet(path)
    if steps is not None:
        df = df.where(F.col("step").isin(steps))
    if begin is not None:
        df = df.where(F.col("step") >= begin)
    return df.where(F.col("step") <= end) if end is not None else df
