"""Error-bounded coding of a zone map, and back from the stored codes alone.

Lows are a chain along an order of the blocks: each is predicted by the one before as it will be
restored.  Highs are predicted from what the decoder has too: a chain of their own, or the bin of
highs that is expected of the restored low's bin.  Shifted blocks can be predicted from the restored
aligned blocks that they touch.  A restored end is off by the error bound at most, so queries on
restored zone maps widen by it.

Codes can stay: ``save`` publishes them with what decoding needs, and a later session opens them and
answers from them alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.grid import BLOCKS, Grid, hilbert, hilbert_bits, related_uniform
from fieldloom.operators import codec
from fieldloom.operators.order import ranked
from fieldloom.operators.zonemap import depth
from fieldloom.sources.store import exists, fingerprint, new_build, publish, published, stored

KEYS = ["step", "level"]
#: Of the manifest of saved codes.
VERSION = 1


@dataclass
class CodedIndex:
    """(step, level, segment, place, block_id, low_code, low_outlier, high_code, high_outlier), and what highs are expected of lows."""

    codes: DataFrame
    bound: float
    order: str
    bins: DataFrame | None = None
    bin_count: int = 100
    path: str | None = None

    def save(self, folder: str, source: str = "") -> None:
        """Writes codes (two bytes each, a partition for each step, in order of place) and the bins, and publishes them; ``source`` tells the table they were made from."""
        spark, into = self.codes.sparkSession, new_build(folder)
        short = lambda c: F.col(c).cast("short").alias(c)
        codes = self.codes.select(*KEYS, "segment", "place", "block_id", short("low_code"), "low_outlier", short("high_code"), "high_outlier")
        codes.repartition("step", "level", "segment").sortWithinPartitions("step", "level", "segment", "place").write.partitionBy("step").option("compression", "zstd").parquet(f"{into}/codes")
        if self.bins is not None:
            self.bins.write.parquet(f"{into}/bins")
        publish(spark, folder, {"version": VERSION, "build": into, "source": source, "bound": self.bound, "order": self.order, "binned": self.bins is not None, "bin_count": self.bin_count})

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "CodedIndex":
        """The codes that ``folder`` has now."""
        m = published(spark, folder)
        if m is None or m["version"] != VERSION:
            raise ValueError(f"no codes of this version in {folder}")
        codes = spark.read.parquet(f"{m['build']}/codes").select(F.col("step").cast("long").alias("step"), "level", "segment", "place", "block_id", F.col("low_code").cast("int").alias("low_code"), "low_outlier", F.col("high_code").cast("int").alias("high_code"), "high_outlier")
        return cls(codes, m["bound"], m["order"], spark.read.parquet(f"{m['build']}/bins") if m["binned"] else None, m["bin_count"], m["build"])

    @classmethod
    def current(cls, spark: SparkSession, folder: str, tables: list[str], make: Callable[[], "CodedIndex"]) -> "CodedIndex":
        """The codes in ``folder`` of these tables as they are now: made where there are none, or those of other files."""
        seen, m = fingerprint(spark, *tables), published(spark, folder)
        if m is None or m["version"] != VERSION or m["source"] != seen or not exists(spark, f"{m['build']}/codes/_SUCCESS"):
            make().save(folder, seen)
        return cls.open(spark, folder)

    def blocks(self, lo: float, hi: float) -> DataFrame:
        """(step, block_id) of the blocks that may meet [lo, hi], from the codes alone: restored intervals, widened by the bound."""
        wide = self.bound * (1 + 1e-7)
        return decompress_index(self).where((F.col("lo") - wide <= hi) & (F.col("hi") + wide >= lo)).select("step", "block_id")


def ordered(zones: DataFrame, order: str, grid: Grid | None = None) -> DataFrame:
    """(step, level, p, block_id, lo, hi): the place of each block in an order.

    ``rows`` takes block numbers as they are, ``hilbert`` the curve through the grid; ``level``
    takes blocks by low, level by level of a balanced tree, so levels double in length.
    """
    zones = zones.select("step", "block_id", *(b for b in BLOCKS if b in zones.columns), "lo", "hi")
    if order == "level":
        out = ranked(zones, ["step"], ["lo", "block_id"]).withColumn("level", depth("rank").cast("long"))
        return out.select(*KEYS, (F.col("rank") - F.expr("shiftleft(1L, int(level))")).alias("p"), "block_id", "lo", "hi")
    key = F.col("block_id") if order == "rows" else hilbert(*(F.col(b) for b in BLOCKS), hilbert_bits(grid.counts))
    out = ranked(zones.withColumn("key", key).select("step", "key", "block_id", "lo", "hi"), ["step"], ["key", "block_id"])
    return out.select("step", F.lit(0).cast("long").alias("level"), (F.col("rank") - 1).alias("p"), "block_id", "lo", "hi")


def _first_codes(rows: DataFrame, value: str, bound: float) -> DataFrame:
    """The chain of the levels' first values: as many as levels, some forty a step."""
    return codec.quantize_chain(rows.where("p = 0"), ["step"], "level", value, bound)


def _seeds(firsts: DataFrame, bound: float) -> DataFrame:
    """(step, level, seed): what a level's first value is predicted from, the restored first value of the level before."""
    restored = codec.dequantize_chain(firsts, ["step"], bound)
    return restored.select("step", (F.col("segment") * codec.SEGMENT + F.col("place") + 1).alias("level"), F.col("value").alias("seed"))


def _chain(rows: DataFrame, value: str, bound: float) -> DataFrame:
    """(KEYS, segment, place, block_id, code, outlier): within a level from value to value; its first from the first of the level before."""
    return codec.quantize_chain(rows, KEYS, "p", value, bound, seeds=_seeds(_first_codes(rows, value, bound), bound), carry=["block_id"])


def _unchained(codes: DataFrame, bound: float) -> DataFrame:
    """``codes`` with value.  The first values' codes are a chain of their own, which gives the seeds."""
    firsts = codes.where("segment = 0 and place = 0").select("step", F.floor(F.col("level") / codec.SEGMENT).alias("segment"), (F.col("level") % codec.SEGMENT).cast("int").alias("place"), "code", "outlier")
    return codec.dequantize_chain(codes, KEYS, bound, _seeds(firsts, bound))


def _expected(binned: DataFrame) -> DataFrame:
    """(low_bin, predicted, l0, l1): a row for each bin of lows."""
    mean = codec.expected_high(binned)
    edges = binned.agg(*(F.first(x).alias(x) for x in ("l0", "l1", "high_first", "high_width")))
    return mean.crossJoin(F.broadcast(edges)).select("low_bin", (F.col("high_first") + (F.col("expected_bin") + 0.5) * F.col("high_width")).alias("predicted"), "l0", "l1")  # one row of four numbers


def compress_index(zones: DataFrame, bound: float, order: str = "level", highs: str = "bins", grid: Grid | None = None, bins: int = 100) -> CodedIndex:
    """Both ends of all intervals as codes; ``highs`` is ``bins`` or ``chain``."""
    rows = stored(ordered(zones, order, grid), "ordered")
    lows = stored(_chain(rows, "lo", bound), "lows")
    lows = lows.withColumnsRenamed({"code": "low_code", "outlier": "low_outlier"})
    place = [*KEYS, "segment", "place", "block_id"]
    if highs == "chain":
        own = _chain(rows, "hi", bound).withColumnsRenamed({"code": "high_code", "outlier": "high_outlier"})
        return CodedIndex(stored(lows.join(own, place), "codes"), bound, order)
    restored = _unchained(lows.withColumnsRenamed({"low_code": "code", "low_outlier": "outlier"}), bound).select("step", "block_id", F.col("value").alias("lo"))
    binned = codec.low_high_bins(restored.join(rows.select("step", "block_id", "hi"), ["step", "block_id"]), bins, edges=True)
    table = stored(_expected(binned), "bins")
    own = binned.join(F.broadcast(table.select("low_bin", "predicted")), "low_bin", "left").withColumn("high_code", codec.code(F.col("hi"), F.col("predicted"), bound))  # a row for each bin
    own = own.select("step", "block_id", "high_code", F.when(F.col("high_code") == 0, F.col("hi")).alias("high_outlier"))
    return CodedIndex(stored(lows.join(own, ["step", "block_id"]).select(*place, "low_code", "low_outlier", "high_code", "high_outlier"), "codes"), bound, order, table, bins)


def decompress_index(coded: CodedIndex, bins: int | None = None) -> DataFrame:
    """(step, block_id, lo, hi) from the codes."""
    bins = bins or coded.bin_count
    place = [*KEYS, "segment", "place", "block_id"]
    lows = _unchained(coded.codes.select(*place, F.col("low_code").alias("code"), F.col("low_outlier").alias("outlier"), "high_code", "high_outlier"), coded.bound).withColumnRenamed("value", "lo")
    if coded.bins is None:
        own = coded.codes.select(*place, F.col("high_code").alias("code"), F.col("high_outlier").alias("outlier"))
        return lows.select(*place, "lo").join(_unchained(own, coded.bound).select(*place, F.col("value").alias("hi")), place).select("step", "block_id", "lo", "hi")
    edges = coded.bins.agg(F.first("l0").alias("l0"), F.first("l1").alias("l1"))
    placed = lows.crossJoin(F.broadcast(edges)).withColumn("low_bin", codec.bin_of(F.col("lo"), F.col("l0"), F.col("l1"), bins))  # one row
    joined = placed.join(F.broadcast(coded.bins.select("low_bin", "predicted")), "low_bin", "left")
    return joined.select("step", "block_id", "lo", codec.decoded(F.col("high_code"), F.col("predicted"), coded.bound, F.col("high_outlier")).alias("hi"))


def compress_shifted(shifted: DataFrame, restored: DataFrame, grid: Grid, bound: float) -> DataFrame:
    """(step, block_id, b0, b1, b2, low_code, low_outlier, high_code, high_outlier) of shifted blocks, against restored aligned ones."""
    out = shifted.join(_related_means(shifted, restored, grid), ["step", "block_id"], "left")
    for name, x in (("low", "lo"), ("high", "hi")):
        c = codec.code(F.col(x), F.col(f"mean_{x}"), bound)
        out = out.withColumns({f"{name}_code": c, f"{name}_outlier": F.when(c == 0, F.col(x))})
    return out.select("step", "block_id", *BLOCKS, "low_code", "low_outlier", "high_code", "high_outlier")


def decompress_shifted(coded: DataFrame, restored: DataFrame, grid: Grid, bound: float) -> DataFrame:
    """(step, block_id, lo, hi)"""
    out = coded.join(_related_means(coded, restored, grid), ["step", "block_id"], "left")
    return out.select("step", "block_id", *(codec.decoded(F.col(f"{name}_code"), F.col(f"mean_{x}"), bound, F.col(f"{name}_outlier")).alias(x) for name, x in (("low", "lo"), ("high", "hi"))))


def _related_means(shifted: DataFrame, restored: DataFrame, grid: Grid) -> DataFrame:
    """(step, block_id, mean_lo, mean_hi): means of the up to eight aligned blocks, summed in one order so that both sides have the same."""
    keys = restored.select("step", *(F.col(b).alias(f"u{i}") for i, b in enumerate(BLOCKS)), F.col("lo").alias("near_lo"), F.col("hi").alias("near_hi"))
    joined = related_uniform(shifted.select("step", "block_id", *BLOCKS), grid).join(keys, ["step", "u0", "u1", "u2"])
    near = F.array_sort(F.collect_list(F.struct("u0", "u1", "u2", "near_lo", "near_hi")))
    grouped = joined.groupBy("step", "block_id").agg(near.alias("near"))
    mean = lambda x: F.aggregate(F.col(f"near.near_{x}"), F.lit(0.0), lambda a, v: a + v) / F.size("near")
    return grouped.select("step", "block_id", mean("lo").alias("mean_lo"), mean("hi").alias("mean_hi"))


def outliers(codes: DataFrame) -> DataFrame:
    """(step, codes, outliers): how many codes of lows and highs a step has, and how many of them are outliers."""
    return codes.groupBy("step").agg((F.count(F.lit(1)) * 2).alias("codes"), F.sum((F.col("low_code") == 0).cast("long") + (F.col("high_code") == 0).cast("long")).alias("outliers"))
