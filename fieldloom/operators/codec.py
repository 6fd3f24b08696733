"""Error-bounded coding of values and intervals.

A code is 8192 plus or minus the number of double error bounds between a value and its
prediction; 0 stands for an outlier, which is kept as it is.  Codes against a given prediction
are plain column expressions.  A chain, in which each prediction is the last reconstructed
value, is folded within segments of bounded length, each of which begins with an outlier, and
is decoded by a running sum.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.functions.grid import quotient

#: The middle code and how many error bounds a prediction may be off: fixed values of the coding.
MIDDLE, REACH = 8192, 16383
#: Values of a chain's segment.
SEGMENT = 4096
#: Radius of the block coding.
BLOCK_RADIUS = 512


def code(x: Column, predicted: Column, bound: float | Column) -> Column:
    """The code of a value; 0 where it is an outlier, as everything is without a bound."""
    bound = F.lit(bound) if not isinstance(bound, Column) else bound
    diff = x - predicted
    state = F.floor((F.floor(F.abs(diff) / bound) + 1) / 2)
    signed = F.when(diff < 0, MIDDLE - state).otherwise(MIDDLE + state)
    return F.when((bound > 0) & predicted.isNotNull() & (F.abs(diff) < REACH * bound), signed).otherwise(0).cast("int")


def decoded(code_: Column, predicted: Column, bound: float | Column, outlier: Column) -> Column:
    bound = F.lit(bound) if not isinstance(bound, Column) else bound
    return F.when(code_ == 0, outlier).otherwise(predicted + 2 * bound * (code_ - MIDDLE))


def uniform_code(x: Column, bound: float) -> Column:
    """The nearest multiple of twice the bound, as a whole number: fixed-accuracy coding without a prediction."""
    return F.floor(x / (2 * bound) + 0.5).cast("long")


def chain_codes(values: np.ndarray, bound: float, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and reconstruction of many chains at once, a chain in each row; NaN ends a row.

    All chains' first values are coded, then all second ones, and so on.  ``seed`` has what a
    chain's first value is predicted from, or NaN.
    """
    values = np.asarray(values, np.float64)
    flat = values.ndim == 1
    values = values[None] if flat else values
    codes, out = np.zeros(values.shape, np.int32), values.copy()
    last = np.full(len(values), np.nan) if seed is None else np.asarray(seed, np.float64).copy()
    for i in range(values.shape[1]):
        x = values[:, i]
        with np.errstate(invalid="ignore", over="ignore"):
            diff = x - last
            coded = (np.abs(diff) < REACH * bound) & (bound > 0)
            state = np.floor((np.floor(np.abs(diff) / bound if bound > 0 else diff) + 1) / 2)
        signed = np.where(coded, np.where(diff < 0, -state, state), 0)
        codes[:, i] = np.where(coded, MIDDLE + signed, 0)
        last = np.where(coded, last + 2 * bound * signed, x)
        out[:, i] = last
    return (codes[0], out[0]) if flat else (codes, out)


def padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as the rows of a matrix, filled up with NaN, and their lengths."""
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    inside = np.arange(n.max(initial=0)) < n[:, None]
    out = np.full(inside.shape, np.nan)
    out[inside] = np.asarray(lists.flatten())
    return out, n


def unpadded(matrix: np.ndarray, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    inside = np.arange(matrix.shape[1]) < lengths[:, None]
    values = pa.array(matrix[inside], mask=None if missing is None else missing[inside])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def quantize_chain(rows: DataFrame, keys: list[str], order: str, value: str, bound: float, segment: int = SEGMENT, seeds: DataFrame | None = None, carry: list[str] = []) -> DataFrame:
    """(keys, segment, place, [carry,] code, outlier) of ``value`` along ``order``, a whole number from 0 within ``keys``.

    A segment becomes one row, of bounded length, and a task codes all its segments side by side.
    ``seeds`` (keys, seed) has what the first value of ``keys`` is predicted from.
    """
    placed = rows.select(*keys, quotient(F.col(order), segment).cast("long").alias("segment"), F.struct((F.col(order) % segment).cast("int").alias("place"), *carry, F.col(value).cast("double").alias("value")).alias("c"))
    lines = placed.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list("c")).alias("c"))
    if seeds is None:
        lines = lines.withColumn("seed", F.lit(None).cast("double"))
    else:
        first = seeds.select(*keys, F.lit(0).cast("long").alias("segment"), "seed")
        lines = lines.join(first, [*keys, "segment"], "left")
    lines = lines.select(*keys, "segment", "seed", F.col("c.place").alias("places"), *(F.col(f"c.{x}").alias(f"carry_{x}") for x in carry), F.col("c.value").alias("values"))
    names = [*keys, "segment", "places", *(f"carry_{x}" for x in carry)]

    def fold(batches):
        for b in batches:
            values, n = padded(b.column("values"))
            codes, _ = chain_codes(values, bound, b.column("seed").to_numpy(zero_copy_only=False).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), unpadded(codes, n), unpadded(values, n, codes != 0)], [*names, "codes", "outliers"])

    schema = StructType([*(f for f in lines.schema if f.name in names), *StructType.fromDDL("codes array<int>, outliers array<double>")])
    zipped = F.arrays_zip("places", *(f"carry_{x}" for x in carry), "codes", "outliers")
    out = lines.select(*names, "seed", "values").mapInArrow(fold, schema).select(*keys, "segment", F.explode(zipped).alias("z"))
    return out.select(*keys, "segment", F.col("z.places").alias("place"), *(F.col(f"z.carry_{x}").alias(x) for x in carry), F.col("z.codes").alias("code"), F.col("z.outliers").alias("outlier"))


def dequantize_chain(codes: DataFrame, keys: list[str], bound: float, seeds: DataFrame | None = None) -> DataFrame:
    """``codes`` with value: an outlier, or a seed, begins a run, and the steps after it add up."""
    line = Window.partitionBy(*keys, "segment").orderBy("place")
    runs = codes.withColumn("run", F.sum(F.when(F.col("code") == 0, 1).otherwise(0)).over(line))
    run = Window.partitionBy(*keys, "segment", "run").orderBy("place")
    steps = F.sum(F.when(F.col("code") == 0, 0).otherwise(F.col("code") - MIDDLE)).over(run)
    begins = F.first("outlier").over(run)
    if seeds is not None:
        runs = runs.join(seeds, keys, "left")
        begins = F.coalesce(begins, F.col("seed"))
    return runs.withColumn("value", begins + 2 * bound * steps).select(*codes.columns, "value")


def bin_of(x: Column, first: Column, last: Column, bins: int) -> Column:
    """The equal-width bin of a value; what lies outside counts in the border bins."""
    return F.greatest(F.lit(0), F.least(F.floor((x - first) / (last - first) * bins), F.lit(bins - 1))).cast("int")


def low_high_bins(zones: DataFrame, bins: int = 100, edges: bool = False) -> DataFrame:
    """``zones`` with low_bin and high_bin: equal-width bins of lows and of highs over all blocks; with ``edges``, l0 and l1 too."""
    stats = zones.agg(F.min("lo").alias("l0"), (F.max("lo") + 1e-6).alias("l1"), F.min("hi").alias("h0"), (F.max("hi") + 1e-6).alias("h1"))
    # one row of four numbers
    out = zones.crossJoin(F.broadcast(stats))
    place = lambda x, a, b: bin_of(F.col(x), F.col(a), F.col(b), bins)
    out = out.withColumns({"low_bin": place("lo", "l0", "l1"), "high_bin": place("hi", "h0", "h1"), "high_width": (F.col("h1") - F.col("h0")) / bins, "high_first": F.col("h0")})
    return out.drop("h0", "h1") if edges else out.drop("l0", "l1", "h0", "h1")


def bin_counts(binned: DataFrame) -> DataFrame:
    return binned.groupBy("low_bin", "high_bin").agg(F.count(F.lit(1)).alias("n"))


def expected_high(binned: DataFrame) -> DataFrame:
    """(low_bin, expected_bin): the mean bin of highs, rounded down, for each bin of lows; at most as many rows as bins."""
    return binned.groupBy("low_bin").agg(F.floor(F.avg("high_bin")).cast("int").alias("expected_bin"))


def compress_highs(zones: DataFrame, bound: float, bins: int = 100) -> DataFrame:
    """(step, block_id, code, outlier, restored): highs coded against the middle of the bin expected from their low."""
    binned = low_high_bins(zones, bins)
    joined = binned.join(F.broadcast(expected_high(binned)), "low_bin", "left")  # at most ``bins`` rows
    predicted = F.col("high_first") + (F.col("expected_bin") + 0.5) * F.col("high_width")
    out = joined.withColumn("predicted", predicted).withColumn("code", code(F.col("hi"), F.col("predicted"), bound))
    out = out.withColumn("outlier", F.when(F.col("code") == 0, F.col("hi")))
    return out.select("step", "block_id", "code", "outlier", decoded(F.col("code"), F.col("predicted"), bound, F.col("outlier")).alias("restored"))


def stagger_prediction(shifted: DataFrame, uniform: DataFrame, related: DataFrame, value: str = "hi") -> DataFrame:
    """(step, block_id, value, predicted): shifted blocks' values against the mean of the aligned blocks they touch."""
    keys = uniform.select("step", *(F.col(f"b{i}").alias(f"u{i}") for i in range(3)), F.col(value).alias("near"))
    joined = related.join(keys, ["step", "u0", "u1", "u2"], "left")
    return joined.groupBy("step", "block_id").agg(F.first(value).alias(value), F.avg("near").alias("predicted"))


def entropy_bits(codes: DataFrame, column: str = "code") -> DataFrame:
    """One row: how many codes, different codes, and the bits that their frequencies call for."""
    counts = codes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total))  # one row
    return shares.agg(F.max("total").alias("codes"), F.count(F.lit(1)).alias("symbols"), F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))), 4).alias("bits"))


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a Huffman code for at most 2 * MIDDLE symbols; a lone symbol takes one bit."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
    lengths = dict.fromkeys(counts, int(len(counts) == 1))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, i, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return lengths


def huffman_bits(codes: DataFrame, column: str = "code") -> DataFrame:
    """(code, n, length): frequencies, whose number the coding bounds, and the lengths of their Huffman code."""
    counts = codes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    lengths = huffman_lengths({r[column]: r["n"] for r in counts.collect()})
    table = codes.sparkSession.createDataFrame(list(lengths.items()), f"{column} int, length int")
    return counts.join(F.broadcast(table), column)


def encode_blocks(values: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs, magnitudes (0 marks a value kept as it is) and bits of many blocks, a block in each row, each value predicted by the one before."""
    signs, sizes, last = np.zeros(values.shape, bool), np.zeros(values.shape, np.int32), np.zeros(len(values))
    for i in range(values.shape[1]):
        x = values[:, i]
        with np.errstate(invalid="ignore", over="ignore"):
            state = np.floor((np.floor(np.abs(x - last) / bound) + 1) / 2) if bound > 0 else np.full(len(x), BLOCK_RADIUS)
            coded = state < BLOCK_RADIUS - 1
        state = np.where(coded, state, 0)
        signs[:, i] = coded & (x < last)
        sizes[:, i] = np.where(coded, state + 1, 0)
        last = np.where(coded, last + 2 * bound * np.where(x < last, -state, state), x)
    most = sizes.max(1, initial=0)
    return signs, sizes, np.where(most > 0, np.floor(np.log2(np.maximum(most, 1))) + 1, 0).astype(np.int32)


def decode_blocks(signs: np.ndarray, sizes: np.ndarray, kept: np.ndarray, bound: float) -> np.ndarray:
    """The values of many blocks; ``kept`` has the kept values at their places."""
    out, last = np.zeros(sizes.shape), np.zeros(len(sizes))
    for i in range(sizes.shape[1]):
        state = sizes[:, i] - 1
        last = np.where(sizes[:, i] > 0, last + 2 * bound * np.where(signs[:, i], -state, state), kept[:, i])
        out[:, i] = last
    return out


def compress_blocks(blocks: DataFrame, bound: float) -> DataFrame:
    """(step, block_id, bits, signs, sizes, kept) of (step, block_id, values)."""

    def run(batches):
        for b in batches:
            values, n = padded(b.column("values"))
            signs, sizes, bits = encode_blocks(values, bound)
            inside = np.arange(values.shape[1]) < n[:, None]
            plain = (sizes == 0) & inside
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(plain.sum(1))]), pa.int32()), pa.array(values[plain]))
            yield pa.RecordBatch.from_arrays([b.column("step"), b.column("block_id"), pa.array(bits), pa.array([np.packbits(s[:m]).tobytes() for s, m in zip(signs, n.tolist())], pa.binary()), unpadded(sizes, n), kept], ["step", "block_id", "bits", "signs", "sizes", "kept"])

    return blocks.select("step", "block_id", "values").mapInArrow(run, "step long, block_id long, bits int, signs binary, sizes array<int>, kept array<double>")


def decompress_blocks(coded: DataFrame, bound: float) -> DataFrame:
    """(step, block_id, values)."""

    def run(batches):
        for b in batches:
            sizes, n = padded(b.column("sizes"))
            inside = np.arange(sizes.shape[1]) < n[:, None]
            sizes = np.where(inside, sizes, 1).astype(np.int32)
            signs, kept = np.zeros(sizes.shape, bool), np.zeros(sizes.shape)
            for row, m, raw in zip(signs, n.tolist(), b.column("signs")):
                row[:m] = np.unpackbits(np.frombuffer(raw.as_py(), np.uint8), count=m)
            kept[(sizes == 0) & inside] = np.asarray(b.column("kept").flatten())
            yield pa.RecordBatch.from_arrays([b.column("step"), b.column("block_id"), unpadded(decode_blocks(signs, sizes, kept, bound), n)], ["step", "block_id", "values"])

    return coded.select("step", "block_id", "signs", "sizes", "kept").mapInArrow(run, "step long, block_id long, values array<double>")


#: The neighbours of a place that its prediction takes, as steps back along each dimension, and their signs.
NEIGHBOURS = [(back, 1 if sum(back) % 2 else -1) for back in product((0, 1), repeat=3) if sum(back)]


def _diagonals(shape: tuple[int, int, int]) -> list[tuple[np.ndarray, ...]]:
    """Places of a block by the sum of their coordinates: those of one sum need only those of smaller ones."""
    at = np.indices(shape).reshape(3, -1)
    return [tuple(at[:, at.sum(0) == k]) for k in range(sum(shape) - 2)]


def _cube_prediction(restored: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """What the restored neighbours before some places give there, in many blocks: exact where a block is a sum of functions of two coordinates.  ``restored`` has a plane of zeros before each dimension."""
    out = 0.0
    for back, sign in NEIGHBOURS:
        out = out + sign * restored[(slice(None), *(x + 1 - b for x, b in zip(places, back)))]
    return out


def encode_cubes(values: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes and restored values of blocks (block, i, j, k): each value against its up to seven restored neighbours, a diagonal of all blocks at a time.

    A code is ``BLOCK_RADIUS`` and so many double bounds; 0 is an outlier, kept as it is.  What isn't
    a number counts as 0 for its neighbours.
    """
    shape = values.shape[1:]
    restored, codes, out = np.zeros((len(values), *(n + 1 for n in shape))), np.zeros(values.shape, np.int32), values.copy()
    for places in _diagonals(shape):
        x, predicted = values[(slice(None), *places)], _cube_prediction(restored, places)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            steps = np.floor((x - predicted) / (2 * bound) + 0.5) if bound > 0 else np.full(x.shape, np.inf)
            back = predicted + 2 * bound * steps
            coded = (np.abs(steps) < BLOCK_RADIUS) & (np.abs(back - x) <= bound)
        codes[(slice(None), *places)] = np.where(coded, BLOCK_RADIUS + np.where(coded, steps, 0), 0)
        out[(slice(None), *places)] = back = np.where(coded, back, x)
        restored[(slice(None), *(p + 1 for p in places))] = np.where(np.isfinite(back), back, 0.0)
    return codes, out


def decode_cubes(codes: np.ndarray, kept: np.ndarray, bound: float) -> np.ndarray:
    """Blocks from their codes; ``kept`` has the outliers in their places."""
    shape = codes.shape[1:]
    restored, out = np.zeros((len(codes), *(n + 1 for n in shape))), np.zeros(codes.shape)
    for places in _diagonals(shape):
        c, k = codes[(slice(None), *places)], kept[(slice(None), *places)]
        back = np.where(c == 0, k, _cube_prediction(restored, places) + 2 * bound * (c - BLOCK_RADIUS))
        out[(slice(None), *places)] = back
        restored[(slice(None), *(p + 1 for p in places))] = np.where(np.isfinite(back), back, 0.0)
    return out


def _of_shape(lists: pa.ListArray, shape: tuple[int, int, int], null) -> tuple[np.ndarray, np.ndarray]:
    """Which lists fill a block of this shape, and their values."""
    right = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == int(np.prod(shape)))
    return right, np.array(lists.take(pa.array(right)).flatten().fill_null(null).to_numpy(zero_copy_only=False)).reshape(len(right), *shape)


def compress_cubes(blocks: DataFrame, bound: float, shape: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """(step, block_id, codes, kept) of (step, block_id, values), last dimension fastest.  Blocks that don't fill the shape are kept as they are, without codes; a null value is NaN."""

    def run(batches):
        for b in batches:
            right, values = _of_shape(b.column("values"), shape, np.nan)
            codes, _ = encode_cubes(values.astype(np.float64), bound)
            flat, raw = (x.reshape(len(right), int(np.prod(shape))) for x in (codes, values))
            kept, found = [None if v is None else [float("nan") if x is None else x for x in v] for v in b.column("values").to_pylist()], [None] * b.num_rows
            for i, c, v in zip(right.tolist(), flat, raw):
                found[i], kept[i] = c, v[c == 0]
            yield pa.RecordBatch.from_arrays([b.column("step"), b.column("block_id"), pa.array(found, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.float64()))], ["step", "block_id", "codes", "kept"])

    return blocks.select("step", "block_id", F.col("values").cast("array<double>").alias("values")).mapInArrow(run, "step long, block_id long, codes array<int>, kept array<double>")


def decompress_cubes(coded: DataFrame, bound: float, shape: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """(step, block_id, values)"""

    def run(batches):
        for b in batches:
            right, codes = _of_shape(b.column("codes"), shape, 0)
            kept, out = np.zeros(codes.shape), b.column("kept").to_pylist()
            at = pa.array(right)
            kept[codes == 0] = b.column("kept").take(at).flatten().to_numpy(zero_copy_only=False)
            for i, v in zip(right.tolist(), decode_cubes(codes, kept, bound).reshape(len(right), int(np.prod(shape)))):
                out[i] = v
            yield pa.RecordBatch.from_arrays([b.column("step"), b.column("block_id"), pa.array(out, pa.list_(pa.float64()))], ["step", "block_id", "values"])

    return coded.select("step", "block_id", "codes", "kept").mapInArrow(run, "step long, block_id long, values array<double>")


def bit_width(largest: Column) -> Column:
    """Bits that numbers up to ``largest`` take."""
    return F.greatest(F.lit(1), F.ceil(F.log2(largest + 1))).cast("int")


def pack_bits(numbers: np.ndarray, width: int) -> bytes:
    """Numbers in ``width`` bits each, least significant first."""
    bits = numbers.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=width * count).reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1)
