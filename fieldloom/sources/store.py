"""Tables that queries share: written once to the folder that driver and executors share, and structures that stay.

A structure that stays (an index, its codes) is a folder of builds.  Each build writes tables of its
own, and a manifest that is renamed into place at last makes it the folder's current one: a reader
sees a whole build or none, and one that still reads the build before isn't disturbed.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Builds of a structure that stay: the current one and those that readers may still hold.
KEPT_BUILDS = 2
#: Files of a table that the driver lists to tell it from a rewritten one.
LISTED_FILES = 1000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder takes its place only where it is unset and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: what stands there is decided once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store the path names."""
    fs, place = _place(spark, path)
    return fs.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def fingerprint(spark: SparkSession, *tables: str) -> str:
    """What tells these folders or files from rewritten ones: names, sizes and times of all their files, which aren't opened.

    The driver lists up to ``LISTED_FILES``; Spark lists more.
    """
    if sum(_place(spark, t)[0].getContentSummary(_place(spark, t)[1]).getFileCount() for t in tables) <= LISTED_FILES:
        found, todo = [], [_place(spark, t)[1] for t in tables]
        while todo:
            place = todo.pop()
            for x in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place):
                if x.isDirectory():
                    todo.append(x.getPath())
                else:
                    found.append(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(tables))
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return "-".join(str(x) for x in files.agg(F.count(F.lit(1)), F.coalesce(F.sum(one), F.lit(0))).first())


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes): how many files stand below ``path``, and their bytes; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def new_build(folder: str) -> str:
    """The name of a build in ``folder``, not yet published."""
    return f"{folder.rstrip('/')}/build-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Makes ``manifest`` (whose ``build`` names its tables) the current one by a rename, and drops builds before the last ``KEPT_BUILDS``.

    Of two writers at a time one takes the next number and the other the number after it.
    """
    fs, place = _place(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(place, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    while True:
        number = max(_numbers(spark, folder), default=0) + 1
        target = _place(spark, f"{folder}/manifest-{number:012d}.json")[1]
        if not fs.exists(target) and fs.rename(place, target):
            break
    numbers = sorted(_numbers(spark, folder))
    for old in numbers[:-KEPT_BUILDS]:
        name = f"{folder}/manifest-{old:012d}.json"
        build = _manifest(spark, name)["build"]
        if build not in [_manifest(spark, f"{folder}/manifest-{n:012d}.json")["build"] for n in numbers[-KEPT_BUILDS:]]:
            fs.delete(_place(spark, build)[1], True)
        fs.delete(_place(spark, name)[1], False)


def published(spark: SparkSession, folder: str) -> dict | None:
    """The folder's current manifest, if there is one."""
    last = max(_numbers(spark, folder), default=None)
    return None if last is None else _manifest(spark, f"{folder}/manifest-{last:012d}.json")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, place = _place(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
    return [int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m]


def _manifest(spark: SparkSession, path: str) -> dict:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
