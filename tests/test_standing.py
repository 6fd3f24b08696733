"""Structures that stay: the stored index and its layout, saved codes, and what notices a rewritten table."""

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from test_engine import smooth_field, volume

from fieldloom.functions import grid as G
from fieldloom.operators import analytics, indexcodec, order, zonemap
from fieldloom.plans import catalog, query, standing
from fieldloom.plans import index as plans_index
from fieldloom.plans.index import FieldIndex, length_class
from fieldloom.sources import footers, store, volumes


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def own_tables(spark, sf_dir, tmp_path):
    """A folder with a copy of the events, which tests rewrite."""
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/t/events.parquet")
    return f"{tmp_path}/t"


def test_rewritten_table_is_noticed(spark, own_tables):
    """Index and codes are built once, opened by later calls, and built again for other rows."""
    scan = lambda: rows(catalog.range_scan(spark, own_tables))
    assert rows(catalog.range_indexed(spark, own_tables)) == scan() == rows(standing.saved_codes_query(spark, own_tables))
    first = catalog.stored_index(spark, own_tables)
    assert catalog.stored_index(spark, own_tables).build_path == first.build_path
    events = store.stored(spark.read.parquet(f"{own_tables}/events.parquet"), "events")
    for times in (0.95, 1.2, 1.5):
        events.withColumn("value", F.col("value") * times).write.mode("overwrite").parquet(f"{own_tables}/events.parquet")
        spark.catalog.refreshByPath(f"{own_tables}/events.parquet")
        assert rows(catalog.range_indexed(spark, own_tables)) == scan() == rows(standing.saved_codes_query(spark, own_tables)) != []
    # builds before the last two are gone
    assert not store.exists(spark, first.build_path)
    assert len(store._numbers(spark, first.path)) == store.KEPT_BUILDS


def test_second_session_answers_from_what_is_saved(spark, own_tables, tmp_path):
    """Another session opens index and codes by their folders, when the table is gone."""
    expected, candidates = rows(catalog.range_indexed(spark, own_tables)), rows(standing.saved_codes_candidates(spark, own_tables))
    path, codes = catalog.stored_index(spark, own_tables).path, standing.standing_folder(spark, own_tables, "codes")
    spark.range(0).write.mode("overwrite").parquet(f"{own_tables}/events.parquet")
    other: SparkSession = spark.newSession()
    index = FieldIndex(other, path)
    assert rows(index.values(catalog.LO, catalog.HI)) == expected and index.grid == G.Grid((8, 8, 8)) and index.fields == ("f", "g")
    coded = indexcodec.CodedIndex.open(other, codes)
    assert rows(coded.blocks(catalog.LO, catalog.HI)) == candidates and coded.bound == standing.BOUND
    exact = index.zones().where(query.overlaps(catalog.LO, catalog.HI)).select("step", "block_id")
    assert set(rows(exact)) <= set(candidates)
    with pytest.raises(ValueError):
        FieldIndex(other, f"{tmp_path}/none")


def test_publishing_is_whole(spark, tmp_path):
    """A build without a manifest is none; of two manifests the later one counts."""
    folder = f"{tmp_path}/s"
    assert store.published(spark, folder) is None
    spark.range(3).write.parquet(f"{folder}/build-x")
    assert store.published(spark, folder) is None
    for k in range(4):
        store.publish(spark, folder, {"build": f"{folder}/build-{k}", "k": k})
    assert store.published(spark, folder)["k"] == 3 and sorted(store._numbers(spark, folder)) == [3, 4]


def scanned(df):
    """Rows that the scans of a query gave, by Spark's own counts."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
        elif p.nodeName().startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
            if "QueryStage" in p.nodeName():
                todo.append(p.plan())
    return total


def test_both_ends_prune(spark, tmp_path, monkeypatch):
    """Of a smooth field of which some blocks have long intervals, a range reads at most twice the blocks that it hits.  Pages are small, as the field is."""
    monkeypatch.setattr(plans_index, "PAGE_ROWS", 16)
    side = 64
    z, y, x = np.meshgrid(*(np.arange(side),) * 3, indexing="ij")
    f = np.sin(z / 11.0) + np.cos(y / 13.0) * np.sin(x / 17.0)
    spikes = np.random.default_rng(1).random(f.shape) < 0.002
    f[spikes] -= 40
    index = FieldIndex.build(volume(spark, f), G.Grid((side,) * 3), f"{tmp_path}/index")
    zones = index.zones().cache()
    # beside the hits, each class of lengths reads a page or two in part
    for lo, hi in ((1.45, 1.75), (-0.1, 0.1), (1.2, 1.25)):
        hit = zones.where(query.overlaps(lo, hi)).count()
        assert 0 < hit and scanned(index.meeting(lo, hi).select("block_id")) <= 2 * hit, (lo, hi)
    assert rows(index.values(1.45, 1.75)) == rows(volume(spark, f).where(F.col("f").between(1.45, 1.75)).select("step", *G.DIMS, "f"))


def test_length_classes(spark):
    got = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (1.0, 2.9), (1.0, 3.0), (0.0, 1e-3), (-1e300, 1e300)], "lo double, hi double").select(length_class(F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in got] == [-2000, 0, 0, 1, -10, 997]


def test_counts_by_ranks(spark):
    """Ranges against intervals with ties, nulls and one end that a third of all share; rows are linear in both."""
    rng = np.random.default_rng(2)
    lo = np.where(rng.random(900) < 0.34, 0.0, rng.integers(0, 50, 900).astype(float))
    intervals = [(float(a), float(a + b)) for a, b in zip(lo, rng.integers(0, 20, 900))] + [(None, None)] * 5
    ranges = [(q, float(a), float(a + b)) for q, (a, b) in enumerate(zip(rng.integers(-5, 75, 60), rng.integers(0, 9, 60)))] + [(99, 0.0, 0.0), (98, 5.0, 5.0), (97, -9.0, 99.0)]
    zones = spark.createDataFrame(intervals, "lo double, hi double")
    got = query.batch_counts(zones, spark.createDataFrame(ranges, "query long, qlo double, qhi double")).collect()
    assert {r["query"]: r["n"] for r in got} == {q: sum(l is not None and l <= b and h >= a for l, h in intervals) for q, a, b in ranges}
    none = query.batch_counts(zones.limit(0), spark.createDataFrame(ranges, "query long, qlo double, qhi double")).collect()
    assert {r["n"] for r in none} == {0} and len(none) == len(ranges)


def test_ranges_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 500)
    parts = [order.parted(spark.range(n).select((F.col("id") % 7).alias("k"), "id"), ["k"], ["id"]).select("part").distinct().count() for n in (4000, 8000, 16000)]
    assert parts[1] >= 1.7 * parts[0] and parts[2] >= 1.7 * parts[1]


def test_side_list_of_equal_lows(spark):
    data = [(s, b, float(v), 9.0) for s in range(2) for b, v in enumerate([0, 0, 0, 3, 3, 5, 3, 0, 7])] + [(2, 0, None, None), (2, 1, None, None)]
    zones = spark.createDataFrame(data, "step long, block_id long, lo double, hi double")
    got = {(r["step"], r["block_id"]): r["skip_reason"] for r in zonemap.with_skip_reason(zones).collect()}
    assert got == {(s, b): "zero_low" if v == 0 else "duplicate_low" if b in (4, 6) and s < 2 else None for s, b, v, _ in data}


@pytest.mark.parametrize("dtype", ["<f8", ">f4", "<f4"])
def test_volumes_in_files(spark, tmp_path, monkeypatch, dtype):
    """Several files of several steps; only the steps and planes asked for are read, and files of other steps aren't even looked at."""
    shape, path = (7, 5, 6), f"{tmp_path}/v"
    f = [smooth_field(shape, k).astype(dtype).astype(float) for k in range(3)]
    voxels = volume(spark, f[0]).union(volume(spark, f[1], step=1)).union(volume(spark, f[2], step=12)).where("step <> 1 or d0 <> 3 or d1 <> 2")
    monkeypatch.setattr(volumes, "SLAB_BYTES", 3 * 30 * np.dtype(dtype).itemsize)
    files = volumes.write(voxels, path, shape, dtype).collect()
    assert sorted((r["step"], r["first"]) for r in files) == [(s, p) for s in (0, 1, 12) for p in (0, 3, 6)]
    read = lambda: volumes.read(spark, path, shape, dtype)
    assert rows(read().where("not isnan(f)")) == rows(voxels.select("step", *G.DIMS, "f")) and read().where("isnan(f)").count() == 6
    (tmp_path / "v" / "1.planes-0.raw").write_bytes(b"short")
    for where in ("step = 12", "step > 1", "step in (0, 12) and d0 between 2 and 3", "step >= 12 and d0 = 6 and f > 0 and d2 <> 1", "step <= 0 and d0 < 1", "step = 5"):
        found = read().where(where)
        assert rows(found) == rows(voxels.where(where).select("step", *G.DIMS, "f")), where
    with pytest.raises(Exception, match="no whole planes"):
        read().count()
    # a file of a whole step, by a name of the user's own
    f[0].astype(dtype).tofile(tmp_path / "pressure-40.bin")
    assert rows(volumes.read(spark, f"{tmp_path}/pressure-40.bin", shape, dtype)) == rows(volume(spark, f[0], step=40).select("step", *G.DIMS, "f"))


def test_slabs_hold_what_filters_leave(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    for step in (1, 2, 3):
        np.zeros((10, 4, 4)).tofile(tmp_path / f"{step}.raw")
    reader = volumes.VolumeReader({"path": str(tmp_path), "shape": "10,4,4"})
    left = list(reader.pushFilters([In(("step",), (1, 3)), GreaterThanOrEqual(("d0",), 4), LessThan(("d0",), 7), EqualTo(("d1",), 2), EqualTo(("f",), 0.0)]))
    assert len(left) == 2 and [(s.step, s.first, s.last) for s in reader.partitions()] == [(1, 4, 7), (3, 4, 7)]
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 48


def test_hdf5_source(spark, tmp_path, monkeypatch):
    """A stand-in for h5py, which isn't installed, tells what is opened."""
    class File(dict):
        def __init__(self, path):
            super().__init__(d=np.load(path))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setattr(volumes, "_h5py", lambda: type("h5py", (), {"File": File}))
    values = smooth_field((4, 3, 5))
    np.save(tmp_path / "6.npy", values)
    reader = volumes.VolumeReader({"path": str(tmp_path), "dataset": "d"})
    assert list(reader.pushFilters([])) == []
    batches = [b for s in reader.partitions() for b in reader.read(s)]
    got = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
    assert got == rows(volume(spark, values, step=6).select("step", *G.DIMS, "f"))


def test_footers_tell_the_intervals(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("step"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("v"), F.lit(None).cast("double").alias("none"), F.col("id").cast("int").alias("i"))
    df.repartition(4).write.partitionBy("step").parquet(f"{tmp_path}/t")
    got = footers.zones(spark, f"{tmp_path}/t", ["v", "none", "i", "missing"]).cache()
    assert {r["column"] for r in got.where("lo is null").collect()} == {"none", "missing"}
    ends = got.groupBy("column").agg(F.min("lo"), F.max("hi"), F.sum("rows"), F.sum("nulls")).collect()
    true = df.agg(F.min("v"), F.max("v")).first()
    assert {r[0]: tuple(r[1:]) for r in ends if r[0] in "vi"} == {"v": (*true, 1000, 200), "i": (0.0, 999.0, 1000, 0)}


def test_octree_reads_pages_of_hit_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans_index, "PAGE_ROWS", 16)
    monkeypatch.setattr(plans_index, "HELD_NODES", 200)
    side = 64
    z, y, x = np.indices((side,) * 3)
    f = np.exp(-((z - 20.0) ** 2 + (y - 40.0) ** 2 + (x - 10.0) ** 2) / 60)
    index = FieldIndex.build(volume(spark, f).union(volume(spark, f / 4, step=1)), G.Grid((side,) * 3), f"{tmp_path}/index")
    assert index.manifest["nodes"] == {str(k): 2 * 8 ** (4 - k) for k in range(5)}
    for lo, hi in ((0.5, 0.9), (0.2, 0.24), (7, 8), (-1, 2)):
        true = index.zones().where(query.overlaps(lo, hi)).select("step", G.morton(*(F.col(b) for b in G.BLOCKS)).alias("morton"))
        found = index.octree_blocks(lo, hi)
        assert rows(found) == rows(true)
    assert scanned(index.octree_blocks(0.5, 0.9)) < 400 < index.zones().count() / 10
    monkeypatch.setattr(plans_index, "HELD_NODES", 0)
    assert rows(index.octree_blocks(0.2, 0.24)) == rows(index.zones().where(query.overlaps(0.2, 0.24)).select("step", G.morton(*(F.col(b) for b in G.BLOCKS)).alias("morton")))


def test_runs_of_keys():
    assert plans_index.runs_of([(0, 5), (0, 4), (1, 6), (0, 9), (0, 6)]) == [(0, 4, 6), (0, 9, 9), (1, 6, 6)]
    many = [(0, 10 * k) for k in range(9)] + [(0, 83), (1, 0)]
    merged = plans_index.runs_of(many, 4)
    assert len(merged) == 4 and all(any(s == a and lo <= k <= hi for a, lo, hi in merged) for s, k in many) and (0, 80, 83) in [(s, max(a, 80), b) for s, a, b in merged]


def test_observed_blocks(spark, own_tables):
    index = catalog.stored_index(spark, own_tables)
    found, seen = index.observed_values(catalog.LO, catalog.HI)
    n = found.count()
    assert n == catalog.range_scan(spark, own_tables).count() and seen.get["blocks_hit"] == index.zones().where(query.overlaps(catalog.LO, catalog.HI)).count()


def test_stored_sizes(spark, own_tables):
    """Bytes are those of the files, and codes take fewer than the intervals that they stand for."""
    got = {r["name"]: r for r in standing.stored_sizes(spark, own_tables).collect()}
    assert set(got) == {"blocks", "shifted", "octree", "steps", "codes"} and all(r["bytes"] > 0 and r["files"] > 0 for r in got.values())
    files = [f for f in (spark.sparkContext._jvm.java.io.File(catalog.stored_index(spark, own_tables).build_path.removeprefix("file:") + "/steps").listFiles()) if f.getName().endswith(".parquet")]
    assert got["steps"]["bytes"] == sum(f.length() for f in files)


def test_even_isovalues():
    got = analytics.even_isovalues(100.0, 7)
    assert np.allclose(got[:7], [1e-4, 1e-3, 1e-2, 0.1, 1, 10, 100]) and got[6] == 100.0 and got[7:] == [-x for x in got[:7]] and analytics.even_isovalues(3.0, 1)[1] == -analytics.even_isovalues(3.0, 1)[0]


@pytest.mark.parametrize("listed", [0, 1000])
def test_fingerprints(spark, own_tables, monkeypatch, listed):
    """The driver's listing and Spark's both tell a rewritten table, an added file and another table."""
    monkeypatch.setattr(store, "LISTED_FILES", listed)
    path = f"{own_tables}/events.parquet"
    first = store.fingerprint(spark, path)
    assert store.fingerprint(spark, path) == first
    spark.range(5).write.mode("append").parquet(path)
    second = store.fingerprint(spark, path)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert len({first, second, store.fingerprint(spark, path), store.fingerprint(spark, path, f"{catalog.stored_index(spark, '/root/testdata/sf0.001').build_path}/steps")}) == 4
