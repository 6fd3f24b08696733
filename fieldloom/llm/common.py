"""Helpers shared by the operators: durable intermediate tables and byte-level views of text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that one NumPy step works on, in arrays many times its size; a longer document is a step of its own.
STEP_BYTES = 1 << 18
#: The white space of every word and line rule here.
SPACE = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  A temporary one takes its place only where it is unset and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(given)
    return given


def own_columns(docs: DataFrame, results: list[str]) -> list[str]:
    """The columns of ``docs`` that an operator's results (in any case) don't replace."""
    names = {x.lower() for x in results}
    return [c for c in docs.columns if c.lower() not in names]


def schema_of(docs: DataFrame, columns: list[str], results: str) -> StructType:
    """These columns of ``docs`` and those of ``results``."""
    return StructType([StructField(c, docs.schema[c].dataType) for c in columns] + StructType.fromDDL(results).fields)


def set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and a struct ``_fl_row`` of all other columns, so no result of an operator meets a column's name."""
    others = own_columns(docs, ["doc_id", "text"])
    return docs.select("doc_id", "text", F.struct(F.lit(None).cast("int").alias("_fl_none"), *(F.col(f"`{c}`") for c in others)).alias("_fl_row"))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns to the system what Arrow and the C library have freed but hold, and the powers of a text longer than a step."""
    for i, p in enumerate(_POWERS):
        _POWERS[i] = p[: STEP_BYTES + 1].copy() if len(p) > STEP_BYTES + 1 else p
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """``run``, for mapInArrow, whose worker keeps nothing of a task: workers serve other tasks and stages later, and what they hold counts as the executor's memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges of about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every bit of ``h``."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * P^i before each position."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever they stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the index of its first word (one more at the end)."""
    n = len(data)
    space = _IS_SPACE[data]
    first = np.ones(n + 1, bool)
    first[1:] = np.append(space[:-1], True) if n else True
    first[offsets] = True
    starts = np.flatnonzero(~space & first[:n])
    last = np.ones(n, bool)
    if n:
        last[:-1] = space[1:]
        inner = offsets[(offsets > 0) & (offsets <= n)]
        last[inner - 1] = True
    ends = np.flatnonzero(~space & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)
