"""The intervals that Parquet keeps in its footers: a zone map of files and row groups that costs no scan of values."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Files of a task, about.
TASK_FILES = 64


def zones(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, row_group, column, lo, hi, rows, nulls) of numeric columns of all Parquet files below ``path``.

    Spark lists the files; a task opens the footers of some of them, in any store that pyarrow
    opens.  A row group without statistics of a column, as one of nothing but nulls has none, has
    null ends, which rule nothing out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    files = files.repartition(max(1, files.count() // TASK_FILES))

    def read(batches):
        for batch in batches:
            out = []
            for name in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(name if "://" in name else name.replace("file:/", "file:///", 1))
                with store.open_input_file(place) as f:
                    meta = pq.ParquetFile(f).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in columns:
                        stats = group.column(at[c]).statistics if c in at else None
                        ends = (float(stats.min), float(stats.max)) if stats is not None and stats.has_min_max else (None, None)
                        out.append((name, g, c, *ends, group.num_rows, stats.null_count if stats is not None and stats.has_null_count else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], ["path", "row_group", "column", "lo", "hi", "rows", "nulls"])

    return files.mapInArrow(read, "path string, row_group int, column string, lo double, hi double, rows long, nulls long")
