"""Properties of the field engine that SQL doesn't show: inverses, bounds, odd shapes, files, streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import grid as G
from fieldloom.operators import analytics, blocks, codec, halo, indexcodec, mesh, order, zonemap
from fieldloom.plans import query
from fieldloom.plans.index import FieldIndex
from fieldloom.sources import fields, raw, sinks
from fieldloom.streaming.ingest import compact, index_stream, indexed, merged, pieces

SCHEMA = "step long, d0 int, d1 int, d2 int, f double, g double"


def volume(spark, values, other=None, step=0):
    at = np.indices(values.shape).reshape(3, -1).T
    other = values if other is None else other
    rows = [(step, *map(int, p), float(values[tuple(p)]), float(other[tuple(p)])) for p in at]
    return spark.createDataFrame(rows, SCHEMA)


def smooth_field(shape, phase=0.0):
    x, y, z = np.indices(shape)
    return np.sin(x / 3 + phase) + np.cos(y / 4) * np.sin(z / 5 + phase)


@pytest.mark.parametrize("bits", range(1, 7))
def test_hilbert_is_a_walk_through_all_cells(bits):
    cells = np.indices((1 << bits,) * 3).reshape(3, -1)
    keys = G.hilbert_keys(cells, bits)
    order = np.argsort(keys)
    assert sorted(keys) == list(range(8**bits))
    assert (np.abs(np.diff(cells[:, order])).sum(0) == 1).all()
    assert (G.hilbert_points(keys, bits) == cells).all()


def test_morton_of_large_coordinates(spark):
    rows = [(0, 0, 0), (2097151, 0, 5), (1, 2097150, 3), (123456, 654321, 2097151)]
    df = spark.createDataFrame(rows, "x int, y int, z int").withColumn("m", G.morton(F.col("x"), F.col("y"), F.col("z")))
    for r in df.select("*", *(c.alias(n) for c, n in zip(G.morton_decode(F.col("m")), "abc"))).collect():
        assert (r["a"], r["b"], r["c"]) == (r["x"], r["y"], r["z"])
        assert r["m"] == sum((v >> i & 1) << 3 * i + k for k, v in enumerate((r["x"], r["y"], r["z"])) for i in range(21))


@pytest.mark.parametrize("shape", [(8, 8, 8), (13, 7, 9), (5, 4, 1)])
@pytest.mark.parametrize("tiling", ["stagger", "stagger_merged"])
def test_shifted_blocks_map_to_the_blocks_of_their_voxels(spark, shape, tiling):
    grid = G.Grid(shape)
    voxels = volume(spark, np.zeros(shape))
    both = G.with_blocks(voxels, grid, tiling).select("step", *(F.col(f"b{i}").alias(f"s{i}") for i in range(3)), *G.DIMS)
    true = G.with_blocks(both, grid).select("step", "s0", "s1", "s2", "block_id").distinct()
    mapped = G.stagger_to_uniform(zonemap.zone_map(voxels, grid, tiling), grid, tiling).select("step", "s0", "s1", "s2", "block_id")
    assert sorted(map(tuple, true.collect())) == sorted(map(tuple, mapped.collect()))


def test_position_round_trip(spark):
    shape = (3, 5, 7)
    df = spark.range(105).select("id", *G.coordinates(F.col("id"), shape))
    assert df.where(G.position(shape) != F.col("id")).isEmpty()
    back = spark.range(105).select("id", *G.block_coordinates(F.col("id"), shape)).where(G.block_id(shape) != F.col("id"))
    assert back.isEmpty()
    first = spark.range(105).select("id", *G.coordinates_first_fastest(F.col("id"), shape))
    assert first.where(F.col("d0") + F.col("d1") * 3 + F.col("d2") * 15 != F.col("id")).isEmpty()


@pytest.mark.parametrize("shape", [(16, 16, 16), (13, 7, 9)])
def test_indexed_queries_equal_scans(spark, shape):
    grid, voxels = G.Grid(shape), volume(spark, smooth_field(shape), smooth_field(shape, 1.0))
    for lo, hi in ((-0.2, 0.1), (0.7, 0.7), (5, 6)):
        q = query.RangeQuery(voxels, grid, lo, hi)
        assert sorted(map(tuple, q.values().collect())) == sorted(map(tuple, voxels.where(F.col("f").between(lo, hi)).collect()))
    needed = query.RangeQuery(voxels, grid, 0.3, 0.3).expanded().select("step", "block_id")
    near = G.with_blocks(voxels, grid).join(needed, ["step", "block_id"], "left_semi").select(*voxels.columns)
    assert sorted(map(tuple, mesh.triangles(near, 0.3).collect())) == sorted(map(tuple, mesh.triangles(voxels, 0.3).collect()))


@pytest.mark.parametrize("shape", [(30, 20, 17), (4, 4, 4), (5, 1, 9)])
def test_stored_index_equals_scans(spark, tmp_path, shape):
    """Values, surfaces and scatterplots from the stored index, on shapes that blocks don't divide, and what the plans push down."""
    f, g = smooth_field(shape), smooth_field(shape, 1.0)
    voxels = volume(spark, f, g).union(volume(spark, f + 9, g, step=1)).repartition(4)
    index = FieldIndex.build(voxels, G.Grid(shape), f"{tmp_path}/index", ("f", "g"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for lo, hi in ((-0.2, 0.1), (0.7, 0.7), (50, 60), (-99, 99)):
        assert rows(index.values(lo, hi)) == rows(voxels.where(F.col("f").between(lo, hi)).select("step", *G.DIMS, "f"))
    assert rows(index.zones("g")) == rows(zonemap.zone_map(voxels, G.Grid(shape), value="g").select("step", "block_id", *G.BLOCKS, "lo", "hi", "n"))
    assert rows(index.triangles(0.3)) == rows(mesh.triangles(voxels, 0.3))
    mine, true = (df.select("bin_f", "bin_g", F.round("density", 6)) for df in (index.scatterplot((-1, 1), (-1, 1), 8), analytics.scatterplot(voxels, (-1, 1), (-1, 1), 8)))
    assert rows(mine) == rows(true)
    assert [r["step"] for r in index.steps(f=(8, 99), g=(-9, 9)).collect()] == [1]
    plan = index.values(8, 99)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(f_lo,99" in plan and "GreaterThanOrEqual(f_hi,8" in plan and "ReadSchema: struct<b0:int,b1:int,b2:int,own_places:array<int>,f_own:array<double>" in plan
    assert "PartitionFilters: []" not in plan and "PartitionFilters" in plan
    held, index.held = index.held, None  # as of very many steps
    plan = index.values(8, 99)._jdf.queryExecution().toString()
    assert rows(index.values(8, 99)) == rows(voxels.where(F.col("f").between(8, 99)).select("step", *G.DIMS, "f")) and "dynamicpruning" in plan.lower() and len(held) == 2


def test_halo_moves_few_values(spark):
    """Values that move, as multiples of the voxels, for cells and for smoothing, in blocks of 4 and chunks of 16."""
    n = 48
    voxels = spark.range(n**3).select(F.lit(0).cast("long").alias("step"), *G.coordinates(F.col("id"), (n, n, n)), F.rand(1).alias("f"))
    moved = lambda *a, **k: halo.chunks(voxels, ("f",), *a, **k).agg(F.sum(F.size("f"))).first()[0] / n**3
    assert moved(0, 1, size=4) < 2 and moved(1, 1, size=4) < 3.4 and moved() < 1.2 and moved(1, 1) < 1.4


def test_smoothing_and_gradients_of_ragged_chunks(spark):
    """Against sums over neighbours, with gaps in the volume and across borders of chunks."""
    values = np.random.default_rng(4).normal(size=(18, 17, 5))
    values[3, 4, 2] = values[15, 16, 0] = np.nan
    voxels = volume(spark, values).where(~F.isnan("f"))
    got = {(r["d0"], r["d1"], r["d2"]): r["smooth"] for r in blocks.smoothed(voxels).collect()}
    slopes = {(r["d0"], r["d1"], r["d2"]): (r["g0"], r["g1"], r["g2"]) for r in blocks.gradients(voxels).collect()}
    at = lambda p: values[p] if all(0 <= x < n for x, n in zip(p, values.shape)) and np.isfinite(values[p]) else None
    assert got.keys() == slopes.keys() == {p for p in np.ndindex(values.shape) if at(p) is not None}
    for p in got:
        near = [(at(tuple(np.add(p, o))), np.exp(-(np.array(o) ** 2).sum() / 2)) for o in np.ndindex(3, 3, 3) for o in [tuple(np.array(o) - 1)]]
        near = [(v, w) for v, w in near if v is not None]
        assert abs(got[p] - sum(v * w for v, w in near) / sum(w for _, w in near)) < 1e-9
        for i in range(3):
            a, b = (at(tuple(np.add(p, k * np.eye(3, dtype=int)[i]))) for k in (-1, 1))
            expected = (a - b) / 2 if a is not None and b is not None else a - values[p] if a is not None else values[p] - b if b is not None else 0
            assert abs(slopes[p][i] - expected) < 1e-12


def test_normals_lie_between_the_gradients_of_the_ends(spark):
    values = smooth_field((18, 6, 7))
    voxels = volume(spark, values)
    slopes = {(r["d0"], r["d1"], r["d2"]): np.array([r["g0"], r["g1"], r["g2"]]) for r in blocks.gradients(voxels).collect()}
    found = mesh.edge_vertices(voxels, 0.2, normals=True).collect()
    assert len(found) > 50
    for r in found:
        p = (r["d0"], r["d1"], r["d2"])
        q = tuple(np.add(p, np.eye(3, dtype=int)[r["axis"]]))
        w = (0.2 - values[p]) / (values[q] - values[p])
        assert np.allclose([r["n0"], r["n1"], r["n2"]], slopes[p] * (1 - w) + slopes[q] * w)
    assert mesh.edge_vertices(voxels, 0.2).count() == len(found)


def test_ranks_and_running_highs_of_ranges(spark):
    """Steps of many ranges, with ties."""
    rng = np.random.default_rng(5)
    rows = [(s, i, float(rng.integers(0, 40)), float(rng.normal())) for s in range(3) for i in range(400 * (s + 1))]
    df = spark.createDataFrame(rows, "step long, block_id long, lo double, hi double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = {(r["step"], r["block_id"]): r["rank"] for r in order.ranked(df, ["step"], ["lo", "block_id"]).collect()}
        highs = {(r["step"], r["block_id"]): r["max_high"] for r in zonemap.running_high(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in range(3):
        most = -np.inf
        for k, (_, i, _, hi) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))):
            most = max(most, hi)
            assert ranks[s, i] == k + 1 and highs[s, i] == most


@pytest.mark.parametrize("kind", [("level", "bins"), ("level", "chain"), ("rows", "chain"), ("hilbert", "bins")])
def test_index_codes(spark, kind):
    """Lows are coded as a plain chain codes them, and all ends are restored within the bound, from the codes alone."""
    grid = G.Grid((20, 12, 8))
    zones = zonemap.zone_map(volume(spark, smooth_field((20, 12, 8))), grid)
    coded = indexcodec.compress_index(zones, 0.01, *kind, grid, 20)
    back = indexcodec.decompress_index(coded, 20).withColumnsRenamed({"lo": "l", "hi": "h"})
    joined = zones.join(back, ["step", "block_id"])
    assert joined.count() == 30 and joined.where((F.abs(F.col("lo") - F.col("l")) > 0.0100001) | (F.abs(F.col("hi") - F.col("h")) > 0.0100001)).isEmpty()
    rows = sorted(indexcodec.ordered(zones, kind[0], grid).collect(), key=lambda r: (r["level"], r["p"]))
    codes = {(r["level"], r["place"]): r["low_code"] for r in coded.codes.collect()}
    seeds, first = {}, None
    for level in sorted({r["level"] for r in rows}):
        chain = [r["lo"] for r in rows if r["level"] == level]
        expected, _ = codec.chain_codes(np.array([chain]), 0.01, np.array([np.nan if first is None else first]))
        assert [codes[level, k] for k in range(len(chain))] == expected[0].tolist()
        first = codec.chain_codes(np.array([chain[:1]]), 0.01, np.array([np.nan if first is None else first]))[1][0, 0]
    assert indexcodec.outliers(coded.codes).first()["codes"] == 60 and not seeds


def test_shifted_codes(spark):
    grid, voxels = G.Grid((13, 9, 10)), volume(spark, smooth_field((13, 9, 10)))
    shifted, zones = zonemap.zone_map(voxels, grid, "stagger"), zonemap.zone_map(voxels, grid)
    coded = indexcodec.compress_shifted(shifted, zones, grid, 0.02)
    back = indexcodec.decompress_shifted(coded, zones, grid, 0.02).withColumnsRenamed({"lo": "l", "hi": "h"})
    joined = shifted.join(back, ["step", "block_id"])
    assert joined.count() == shifted.count() and joined.where((F.abs(F.col("lo") - F.col("l")) > 0.0200001) | (F.abs(F.col("hi") - F.col("h")) > 0.0200001)).isEmpty()


def test_holes_are_filled(spark):
    """A surface without some of its triangles: no side is left that one triangle alone has."""
    values = np.full((9, 9, 9), -5.0)
    values[2:7, 2:7, 2:7] = 1.0
    voxels = volume(spark, values)
    whole = mesh.triangles(voxels, 0.0)
    torn = whole.where("not (d0 = 6 and d1 = 4 and d2 = 4 and k = 0) and not (d0 = 1 and d1 between 3 and 4 and d2 = 3)")
    lost = whole.count() - torn.count()
    assert lost > 2 and not mesh.boundary_edges(torn).isEmpty()
    vertices = mesh.edge_vertices(voxels, 0.0)
    added = mesh.fill_holes(torn, vertices)
    assert 0 < added.count() <= 2 * lost
    assert mesh.boundary_edges(torn.select("step", "a", "b", "c").union(added)).isEmpty()
    assert mesh.fill_holes(whole, vertices).isEmpty()


def test_filling_ends_and_tells_what_is_left(spark):
    """A plane of squares without some: filling ends by itself, and a stop before that is reported."""
    name = lambda i, j: f"{i},{j},0,0"
    at = [(0, i, j, 0, 0, float(i), float(j), 0.0) for i in range(7) for j in range(7)]
    vertices = spark.createDataFrame(at, "step long, d0 int, d1 int, d2 int, axis int, x0 double, x1 double, x2 double")
    gone = {(1, 1), (1, 2), (3, 3), (4, 3), (4, 4), (2, 5)}
    faces = [(0, name(i, j), *rest) for i in range(6) for j in range(6) if (i, j) not in gone for rest in ((name(i + 1, j), name(i, j + 1)),)]
    faces += [(0, name(i + 1, j), name(i + 1, j + 1), name(i, j + 1)) for i in range(6) for j in range(6) if (i, j) not in gone]
    mesh_ = spark.createDataFrame(faces, "step long, a string, b string, c string")
    whole = mesh.fill_report(mesh_, vertices, 1.0).first()
    part = mesh.fill_report(mesh_, vertices, 1.0, rounds=1).first()
    assert whole["triangles"] == len(faces) and whole["open_sides"] > 24 and whole["filled"] >= part["filled"] > 0 and part["left_open"] > 0
    added = [tuple(sorted(r[1:])) for r in mesh.fill_holes(mesh_, vertices, 1.0).collect()]
    assert len(added) == len(set(added)) and not set(added) & {tuple(sorted(x[1:])) for x in faces}


def test_hdf5_by_planes(spark, tmp_path):
    """With a stand-in for h5py, which isn't installed: planes are read by tasks, and without it the reader says so."""
    values = smooth_field((3, 4, 5)).astype("f4")
    np.save(tmp_path / "a.npy", values)
    with pytest.raises(Exception, match="h5py isn't installed"):
        raw.read_hdf5(spark, f"{tmp_path}/a.npy", "group/x").collect()
    (tmp_path / "h5py.py").write_text("import numpy as np\nclass File(dict):\n    def __init__(self, path):\n        self['group/x'] = np.load(path)\n    def __enter__(self):\n        return self\n    def __exit__(self, *a):\n        pass\n")
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    got = raw.read_hdf5(spark, f"{tmp_path}/a.npy", "group/x").collect()
    assert len(got) == 60 and all(np.float32(r["f"]) == values[r["d0"], r["d1"], r["d2"]] for r in got)


def test_names_of_fields(spark):
    voxels = volume(spark, np.zeros((2, 2, 2)))
    voxels.createOrReplaceTempView("pressure_test")
    assert "pressure_test" in fields.list_variables(spark) and fields.safe_name("/data/fields/B/y") == "data_fields_B_y"
    assert query.RangeQuery(voxels.limit(0), G.Grid((2, 2, 2)), 0.0, 1.0).core().isEmpty()


def plain_raster(x, y, density, image):
    """A triangle's density at each pixel whose middle it covers."""
    cross = lambda a, b, p, q: (x[b] - x[a]) * (q - y[a]) - (y[b] - y[a]) * (p - x[a])
    area = cross(0, 1, x[2], y[2])
    for i in range(len(image)):
        for j in range(len(image)):
            if abs(area) > 2e-12 and all(cross(a, b, i + 0.5, j + 0.5) * np.sign(area) >= 0 for a, b in ((0, 1), (1, 2), (2, 0))):
                image[i, j] += density


def test_tetrahedra_against_a_plain_raster(spark):
    f, g = np.random.default_rng(7).random((2, 3, 3, 3))
    image, n = np.zeros((12, 12)), 12
    for d in np.ndindex(2, 2, 2):
        at = [tuple(np.add(d, (c[2], c[1], c[0]))) for c in halo.CORNERS]
        for tet, share in zip(analytics.TETRAHEDRA, (1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 3)):
            faces = [[f[at[t]] * n for t in tet if t != s] for s in tet], [[g[at[t]] * n for t in tet if t != s] for s in tet]
            total = sum(abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) / 2 for x, y in zip(*faces))
            for x, y in zip(*faces):
                plain_raster(x, y, share / total, image)
    got = np.zeros((12, 12))
    for r in analytics.scatterplot_by_tetrahedra(volume(spark, f, g), (0, 1), (0, 1), 12).collect():
        got[r["bin_f"], r["bin_g"]] = r["density"]
    assert np.allclose(got, image) and got.sum() > 1


def test_widened_index_misses_nothing(spark):
    grid, voxels = G.Grid((12, 12, 12)), volume(spark, smooth_field((12, 12, 12)))
    zones = zonemap.zone_map(voxels, grid)
    coded = codec.compress_highs(zones, 0.05)
    restored = zones.drop("hi").join(coded.select("step", "block_id", F.col("restored").alias("hi")), ["step", "block_id"])
    assert restored.join(zones.select("block_id", F.col("hi").alias("true")), "block_id").where(F.abs(F.col("hi") - F.col("true")) > 0.0500001).isEmpty()
    exact = {r["block_id"] for r in query.RangeQuery(voxels, grid, 0.5, 0.6).blocks().collect()}
    wide = {r["block_id"] for r in query.RangeQuery(voxels, grid, 0.5, 0.6, error=0.0500001, zones=restored).blocks().collect()}
    assert exact <= wide


def plain_chain(values, bound, seed=None):
    """Codes of a chain, value by value."""
    out, last = [], seed
    for x in values:
        code = 0
        if last is not None and bound > 0 and abs(x - last) < codec.REACH * bound:
            state = int(abs(x - last) // bound + 1) // 2
            code = codec.MIDDLE + (state if x >= last else -state)
            last = last + 2 * bound * (code - codec.MIDDLE)
        else:
            last = x
        out.append(code)
    return out


def test_chain_codes(spark):
    rng = np.random.default_rng(0)
    lists = [rng.normal(size=500).cumsum(), np.array([0.0, 1e9, -1e9, 3, 3, 3]), np.full(10, 2.5), np.zeros(0)]
    for values in lists:
        codes, back = codec.chain_codes(values, 0.01)
        assert (np.abs(back - values) <= 0.0100001).all() and codes.tolist() == plain_chain(values.tolist(), 0.01)
    assert (codec.chain_codes(np.full(5, 1.0), 0.0)[0] == 0).all()
    matrix, n = codec.padded(pa.array([x.tolist() for x in lists], pa.list_(pa.float64())))
    codes, _ = codec.chain_codes(matrix, 0.01, np.array([0.5, np.nan, 2.4, np.nan]))
    assert [c[:m].tolist() for c, m in zip(codes, n)] == [plain_chain(x.tolist(), 0.01, seed) for x, seed in zip(lists, (0.5, None, 2.4, None))]
    rows = spark.createDataFrame([(s, i, float(v)) for s in range(2) for i, v in enumerate(rng.normal(size=50).cumsum())], "step long, p long, f double")
    codes = codec.quantize_chain(rows, ["step"], "p", "f", 0.01, segment=16)
    back = codec.dequantize_chain(codes, ["step"], 0.01).select("step", (F.col("segment") * 16 + F.col("place")).alias("p"), "value")
    joined = rows.join(back, ["step", "p"])
    assert joined.count() == 100 and joined.where(F.abs(F.col("f") - F.col("value")) > 0.0100001).isEmpty()


@pytest.mark.parametrize("bound", [1e-3, 10.0, 0.0])
def test_block_codes(spark, bound):
    rng = np.random.default_rng(1)
    lists = [rng.normal(size=64), np.concatenate([np.zeros(5), [1e12], rng.normal(size=10)]), np.zeros(0), np.array([-3.0, -3.0, 900.0])]
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(lists)], "step long, block_id long, values array<double>")
    coded = codec.compress_blocks(df, bound)
    for r in codec.decompress_blocks(coded, bound).collect():
        values = lists[r["block_id"]]
        assert len(r["values"]) == len(values) and (np.abs(np.array(r["values"]) - values) <= bound * 1.000001 + 1e-12).all()
    for r in coded.collect():
        last, kept = 0.0, list(r["kept"])
        for x, size in zip(lists[r["block_id"]], r["sizes"]):
            state = int(abs(x - last) // bound + 1) // 2 if bound > 0 else codec.BLOCK_RADIUS
            assert size == (state + 1 if state < codec.BLOCK_RADIUS - 1 else 0)
            last = last + 2 * bound * (-state if x < last else state) if size else kept.pop(0)
        assert not kept and max(r["sizes"], default=0) < 1 << r["bits"] or not r["bits"]


def test_bits_and_huffman():
    numbers = np.array([0, 5, 7, 1, 6])
    assert (codec.unpack_bits(codec.pack_bits(numbers, 3), 3, 5) == numbers).all() and len(codec.pack_bits(numbers, 3)) == 2
    lengths = codec.huffman_lengths({1: 8, 2: 4, 3: 2, 4: 1, 5: 1})
    assert lengths == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4} and codec.huffman_lengths({7: 3}) == {7: 1}


def test_case_triangles_close_up():
    """Sides of a case's triangles are used twice inside, and once on a face; complements have the same boundary."""
    for case in range(256):
        sides = {}
        for t in mesh.case_triangles(case):
            for i in range(3):
                s = tuple(sorted((t[i], t[(i + 1) % 3])))
                sides[s] = sides.get(s, 0) + 1
        crossed = {e for e, (a, b) in enumerate(mesh.EDGE_ENDS) if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in mesh.case_triangles(case) for e in t} == crossed
        for (a, b), n in sides.items():
            on_face = any({*mesh.EDGE_ENDS[a], *mesh.EDGE_ENDS[b]} <= set(f) for f in mesh.FACES)
            assert n == 2 or (n == 1 and on_face)


def test_surfaces_have_no_gaps(spark):
    """A surface inside the volume is closed; noise makes every ambiguous face occur."""
    values = np.random.default_rng(2).normal(size=(9, 9, 9))
    values[[0, -1]] = values[:, [0, -1]] = values[:, :, [0, -1]] = -5
    found = mesh.triangles(volume(spark, values), 0.1)
    assert found.count() > 500 and mesh.boundary_edges(found).isEmpty() and mesh.degenerate(found).isEmpty()
    stats = mesh.mesh_stats(volume(spark, values), 0.1).collect()[0]
    assert stats["triangles"] == found.count()
    used = found.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct().count()
    assert used == stats["vertices"]


def test_depth_weighted_image_by_geometry(spark):
    """Depths by rays from corners to the planes across, along the cross product of the gradients, drawn pixel by pixel."""
    f, g = np.random.default_rng(11).random((2, 3, 3, 4))
    n, (f0, f1), (g0, g1) = 9, (0.2, 0.9), (-0.1, 0.8)
    image = np.zeros((n, n))
    for d in np.ndindex(2, 2, 3):
        at = [tuple(np.add(d, (c[2], c[1], c[0]))) for c in halo.CORNERS]
        for tet in analytics.TETRAHEDRA:
            p, u, v = np.array([at[k] for k in tet], float), np.array([f[at[k]] for k in tet]), np.array([g[at[k]] for k in tet])
            if u.max() < f0 or u.min() > f1 or v.max() < g0 or v.min() > g1:
                continue
            slopes = [np.linalg.solve(p[1:] - p[0], x[1:] - x[0]) for x in (u, v)]
            normal = np.cross(*slopes)
            size = np.linalg.norm(normal)
            depth = []
            for i in range(4):
                a, b, c = np.delete(p, i, 0)
                plane = np.cross(b - a, c - a)
                depth.append(abs((a - p[i]) @ plane / (normal / size @ plane)))
            x, y = (np.clip(u, f0, f1) - f0) / (f1 - f0) * n, (np.clip(v, g0, g1) - g0) / (g1 - g0) * n
            order = np.argsort(u, kind="stable")
            for tri in (order[[0, 1, 2]], order[[0, 2, 3]]):
                m = np.array([x[tri], y[tri], np.ones(3)])
                if abs(np.linalg.det(m)) < 1e-10:
                    continue
                for i, j in np.ndindex(n, n):
                    w = np.linalg.solve(m, [i + 0.5, j + 0.5, 1])
                    if w.min() >= -1e-6 and w @ np.array(depth)[tri] > 0:
                        image[i, j] += w @ np.array(depth)[tri] / size
    got = np.zeros((n, n))
    for r in analytics.depth_scatterplot(volume(spark, f, g), (f0, f1), (g0, g1), n).collect():
        got[r["bin_f"], r["bin_g"]] = r["density"]
    assert np.allclose(got, image, rtol=1e-6) and (got > 0).sum() > 40


@pytest.mark.parametrize("shape", [(4, 4, 4), (3, 5, 2)])
def test_cubes(spark, shape):
    """Blocks in three dimensions come back within the bound, outliers and what isn't a number as they are; blocks of other sizes too."""
    rng, size = np.random.default_rng(8), int(np.prod(shape))
    wild = rng.normal(size=size) * np.where(rng.random(size) < 0.2, 1e6, 0.01)
    rows = [(0, 0, list(map(float, wild))), (0, 1, [float(x) for x in np.where(rng.random(size) < 0.2, np.nan, rng.random(size))]), (0, 2, [1.0, 2.0]), (0, 3, []), (0, 4, None), (0, 5, [7.0] * size), (0, 6, [None if k == 3 else float("inf") if k == 5 else 0.5 for k in range(size)])]
    df = spark.createDataFrame(rows, "step long, block_id long, values array<double>")
    coded = codec.compress_cubes(df, 1e-3, shape)
    back = {r["block_id"]: r["values"] for r in codec.decompress_cubes(coded, 1e-3, shape).collect()}
    for _, i, v in rows:
        if v is None:
            assert back[i] is None
        else:
            assert np.allclose(np.array(v, float), np.array(back[i], float), rtol=0, atol=1.0000001e-3, equal_nan=True) and len(v) == len(back[i])
    kept = {r["block_id"]: r["kept"] for r in coded.collect()}
    assert len(kept[5]) == 1 and len(kept[2]) == 2 and len(kept[0]) > 5
    assert all(c == 0 for r in codec.compress_cubes(df, 0.0, shape).where("codes is not null").collect() for c in r["codes"])


def test_cubes_of_a_smooth_field_take_fewer_codes(spark):
    shape = (16, 16, 16)
    blocks_ = blocks.to_blocks(volume(spark, smooth_field(shape)), G.Grid(shape)).select("step", "block_id", "values")
    bound = 1e-3
    cubes = {c for r in codec.compress_cubes(blocks_, bound).collect() for c in r["codes"]}
    lines = {(s, bool(b)) for r in codec.compress_blocks(blocks_, bound).collect() for s, b in zip(r["sizes"], np.unpackbits(np.frombuffer(r["signs"], np.uint8)))}
    assert len(cubes) < 0.6 * len(lines)


def test_tetrahedra_spread_all_volume(spark):
    """Where f and g vary alone, all the volume lands in the image."""
    x, y, _ = np.indices((5, 5, 5)).astype(float)
    image = analytics.scatterplot_by_tetrahedra(volume(spark, x, y), (0, 4.1), (0, 4.3), 97)
    assert abs(image.agg(F.sum("density")).first()[0] / 64 - 1) < 0.05


def test_selectivity_equals_counting(spark):
    rng = np.random.default_rng(3)
    lo = rng.normal(size=200)
    zones = spark.createDataFrame([(float(a), float(a + b)) for a, b in zip(lo, rng.random(200))], "lo double, hi double")
    pairs = [(r["lo"], r["hi"]) for r in zones.collect()]
    values = analytics.isovalues(-3, 3, 20) + analytics.log_uniform_isovalues(3.0, 5)
    for r in analytics.selectivity(zones, values).collect():
        assert r["blocks"] == sum(a <= r["isovalue"] <= b for a, b in pairs)


def test_top_thresholds_with_ties(spark):
    values = [1.0] * 50 + [2.0] * 30 + [3.0] * 5 + list(np.linspace(4, 5, 40))
    df = spark.createDataFrame([(float(v),) for v in values], "f double")
    ordered = sorted(values, reverse=True)
    for r in analytics.top_thresholds(df, shares=(1e-6, 0.1, 0.4, 0.7, 0.99)).collect():
        assert r["threshold"] == ordered[min(int(r["share"] * len(values)), len(values) - 1)]
    assert analytics.top_thresholds(df.limit(0)).count() == 0


def test_top_thresholds_by_sketch(spark, monkeypatch):
    """Ties, NaN, nulls, few rows, and sketches that are off, which a look at all values makes up for."""
    rng = np.random.default_rng(4)
    kinds = {"many": rng.normal(size=30_000), "ties": rng.integers(0, 4, 5000).astype(float), "nan": np.where(rng.random(3000) < 0.02, np.nan, rng.random(3000)), "one": np.array([2.5]), "all nan": np.array([np.nan] * 3)}
    for slack in (analytics.SKETCH_SLACK, 0.0):
        monkeypatch.setattr(analytics, "SKETCH_SLACK", slack)
        for name, x in kinds.items():
            df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "f double")
            top = sorted(x, key=lambda v: (not np.isnan(v), -v if not np.isnan(v) else 0))
            got = {r["share"]: (r["rank"], repr(r["threshold"])) for r in analytics.top_thresholds(df).collect()}
            assert got == {s: (k := min(int(np.floor(s * len(x))), len(x) - 1), repr(float(top[k]))) for s in analytics.TOP_SHARES}, (name, slack)
    assert analytics.top_thresholds(spark.createDataFrame([], "f double")).count() == 0


def test_constant_and_negative_fields(spark):
    grid = G.Grid((8, 8, 8))
    constant = volume(spark, np.full((8, 8, 8), -2.5))
    zones = zonemap.zone_map(constant, grid)
    assert {(r["lo"], r["hi"], r["n"]) for r in zones.collect()} == {(-2.5, -2.5, 64)}
    assert codec.compress_highs(zones, 0.0).where("code <> 0 or restored <> -2.5").isEmpty()
    assert zonemap.running_high(zones).where("max_high <> -2.5").isEmpty()
    quality = analytics.quality(constant.select(F.col("f").alias("a"), F.col("f").alias("b"))).first()
    assert quality["psnr"] == float("inf") and quality["max_error"] == 0


def test_point_reads_and_blocks(spark):
    grid, voxels = G.Grid((6, 5, 7)), volume(spark, smooth_field((6, 5, 7)))
    stored = blocks.to_blocks(voxels, grid)
    got = blocks.point_values(voxels.select("step", *G.DIMS, "f"), stored, grid)
    assert got.where("f <> value or value is null").isEmpty()
    assert blocks.point_values(spark.createDataFrame([(0, 6, 0, 0)], "step long, d0 int, d1 int, d2 int"), stored, grid).first()["value"] is None
    ends = spark.range(1).select(blocks.clamped(F.lit(-3), 6).alias("a"), blocks.clamped(F.lit(9), 6).alias("b"), blocks.extrapolated(F.lit(3.0), F.lit(2.0)).alias("c")).first()
    assert tuple(ends) == (0, 5, 4.0)


@pytest.mark.parametrize("dtype", ["<f8", ">f8", "<f4", ">f4"])
def test_raw_files(spark, tmp_path, dtype):
    values = smooth_field((5, 4, 6)).astype(dtype)
    values.tofile(tmp_path / "a.bin")
    got = raw.read_raw(spark, f"file://{tmp_path}/a.bin", (5, 4, 6), dtype).collect()
    assert len(got) == 120 and all(r["f"] == float(values[r["d0"], r["d1"], r["d2"]]) for r in got)


def test_text_files(spark, tmp_path):
    zones = spark.createDataFrame([(-2.5, 1e-310), (0.0, 3.0)], "lo double, hi double")
    sinks.write_intervals(zones, f"{tmp_path}/i")
    assert sorted(map(tuple, raw.read_intervals(spark, f"{tmp_path}/i").collect())) == [(-2.5, 1e-310), (0.0, 3.0)]
    sinks.write_numbers(zones, f"{tmp_path}/n", "lo")
    assert sorted(r["value"] for r in raw.read_numbers(spark, f"{tmp_path}/n").collect()) == [-2.5, 0.0]


def test_stored_fields_read_steps_alone(spark, tmp_path):
    df = G.with_blocks(volume(spark, np.zeros((4, 4, 4))).union(volume(spark, np.ones((4, 4, 4)), step=3)), G.Grid((4, 4, 4)))
    sinks.write_field(df, f"{tmp_path}/f")
    assert {r["step"] for r in raw.read_steps(spark, f"{tmp_path}/f", [3]).select("step").distinct().collect()} == {3}
    plan = raw.read_steps(spark, f"{tmp_path}/f", begin=1, end=5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(step" in plan


def test_exports(spark, tmp_path):
    voxels = volume(spark, smooth_field((4, 5, 6)))
    sinks.write_vtk_volume(voxels, tmp_path / "v.vtk", (4, 5, 6))
    data = (tmp_path / "v.vtk").read_bytes()
    assert b"DIMENSIONS 6 5 4" in data and np.allclose(np.frombuffer(data[-480:], ">f4").reshape(4, 5, 6), smooth_field((4, 5, 6)), atol=1e-6)
    sinks.write_raw(voxels, tmp_path / "v.bin", (4, 5, 6), ">f4")
    assert np.allclose(np.fromfile(tmp_path / "v.bin", ">f4").reshape(4, 5, 6), smooth_field((4, 5, 6)), atol=1e-6)
    back = raw.read_raw(spark, f"file://{tmp_path}/v.bin", (4, 5, 6), ">f4")
    assert back.join(voxels.withColumnRenamed("f", "v"), list(G.DIMS)).where(F.abs(F.col("f") - F.col("v")) < 1e-6).count() == 120
    sinks.write_vti(voxels.where("d0 <> 2"), tmp_path / "v.vti", (4, 5, 6))
    import xml.etree.ElementTree as tree

    data = tree.parse(tmp_path / "v.vti").getroot().find("ImageData")
    numbers = np.array(data.find("Piece/PointData/DataArray").text.split(), float).reshape(4, 5, 6)
    assert data.get("WholeExtent") == "0 5 0 4 0 3" and np.isnan(numbers[2]).all() and np.array_equal(numbers[3], smooth_field((4, 5, 6))[3])
    image = analytics.scatterplot(volume(spark, *[np.random.default_rng(i).random((4, 4, 4)) for i in (0, 1)]), (0, 1), (0, 1), 16)
    sinks.write_image(image, tmp_path / "i.bin", (16, 16))
    assert (tmp_path / "i.bin").stat().st_size == 16 + 8 * 256
    found = mesh.triangles(voxels, 0.2)
    sinks.write_vtk_mesh(mesh.edge_vertices(voxels, 0.2, normals=True), found, tmp_path / "m.vtk")
    text = (tmp_path / "m.vtk").read_text()
    n = mesh.edge_vertices(voxels, 0.2).count()
    assert text.count("\n3 ") == found.count() and f"POINTS {n} double" in text and len(text.split("NORMALS normals double\n")[1].splitlines()) == n
    lines = text.splitlines()[5:]
    corners = [tuple(map(int, x.split()[1:])) for x in lines[n + 1 : n + 1 + found.count()]]
    assert {i for c in corners for i in c} == set(range(n))


def test_stream_indexes_pieces_as_they_come(spark, tmp_path):
    """One step over three batches, one file of which comes again under another name, and a late voxel that widens its block."""
    grid, values = G.Grid((8, 8, 8)), smooth_field((8, 8, 8))
    whole, other = volume(spark, values), volume(spark, values + 3, step=1)
    thirds = [whole.where(F.pmod(F.xxhash64("d0", "d1", "d2"), F.lit(3)) == k).coalesce(1) for k in range(3)]
    late = spark.createDataFrame([(1, 0, 0, 0, -50.0, 0.0)], SCHEMA)
    out = f"{tmp_path}/out"
    for k, part in enumerate([thirds[0].union(other.where("d0 > 0 or d1 > 0 or d2 > 0")), thirds[1], thirds[2].union(thirds[0]), late]):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        index_stream(spark, f"{tmp_path}/in", SCHEMA, grid, out, f"{tmp_path}/cp").awaitTermination()
        if k == 1:
            compact(spark, out)
    all_of = zonemap.dual_zone_map(whole.union(other.where("d0 > 0 or d1 > 0 or d2 > 0")).union(late), grid)
    rows = lambda df: sorted(map(tuple, df.select(*all_of.columns).collect()))
    assert rows(indexed(spark, out)) == rows(all_of)
    before = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]
    compact(spark, out)
    assert rows(indexed(spark, out)) == rows(all_of) and len(before) == 4


def test_blocks_of_many_places(spark):
    """A block of more places than a number has bits."""
    grid, values = G.Grid((8, 8, 8), (8, 8, 8)), smooth_field((8, 8, 8))
    parts = [pieces(volume(spark, values).where(f"d0 % 3 = {k}"), grid) for k in (0, 1, 1)]
    got = merged(parts[0].union(parts[1]).union(parts[2])).where("tiling = 'uniform'").agg(F.min("lo"), F.max("hi"), F.sum(F.bit_count("seen")), F.count(F.lit(1))).first()
    kept = values[[i for i in range(8) if i % 3 < 2]]
    assert tuple(got) == (kept.min(), kept.max(), kept.size, 6)
