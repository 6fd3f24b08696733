"""Registered queries on structures that stay: saved codes, and codes themselves beside SQL that makes them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import grid as G
from fieldloom.operators import analytics, codec, halo, indexcodec, mesh
from fieldloom.plans import catalog, query
from fieldloom.plans.catalog import BINS, HI, LO, register, stored_index
from fieldloom.sources import fields, footers, volumes
from fieldloom.sources.store import fingerprint, new_build, publish, published, shared_folder, stored, stored_bytes

#: Error bound of the registered codes.
BOUND = 0.5


def standing_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a structure made from the tables in ``sf_dir``, the same for every session that shares a checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


# codes of both ends of all intervals


def _coded(v: str, before: str) -> tuple[str, str]:
    """SQL for whether ``v`` is coded against ``before``, and by how many double bounds."""
    state = f"floor((floor(abs({v} - {before}) / CAST({BOUND} AS DOUBLE)) + 1) / 2)"
    return f"({before} IS NOT NULL AND abs({v} - {before}) < {codec.REACH} * CAST({BOUND} AS DOUBLE))", f"(CASE WHEN {v} - {before} < 0 THEN -{state} ELSE {state} END)"


def _fold(name: str, ordered: str, value: str) -> list[str]:
    """SQL of a chain along places ``p`` within (step, level) of a table: code, last value as predicted from, and the beginning and steps that restore it.

    The first values of the levels are a chain of their own, which gives what each level begins from.
    """
    near, signed = _coded("l.v", "r.last")
    near_first, signed_first = _coded("l.v", "(x.b + x.k)")
    step = f"CASE WHEN {near} THEN {codec.MIDDLE} + {signed} ELSE 0 END AS code, CASE WHEN {near} THEN r.last + {signed} ELSE l.v END AS last, CASE WHEN {near} THEN r.b ELSE l.v END AS b, CASE WHEN {near} THEN r.k + {signed} ELSE 0 END AS k"
    return [
        f"{name}l AS (SELECT step, level, p // {codec.SEGMENT} AS segment, p % {codec.SEGMENT} AS place, block_id, {value} AS v FROM {ordered})",
        f"{name}f AS (SELECT step, level, CAST(0 AS DOUBLE) AS code, v AS last, v AS b, CAST(0 AS DOUBLE) AS k FROM {name}l WHERE level = 0 AND segment = 0 AND place = 0 UNION ALL SELECT l.step, l.level, {step} FROM {name}f r JOIN {name}l l ON l.step = r.step AND l.level = r.level + 1 AND l.segment = 0 AND l.place = 0)",
        f"{name}r AS (SELECT l.step, l.level, l.segment, l.place, l.block_id, l.v, CASE WHEN {near_first} THEN {codec.MIDDLE} + {signed_first} ELSE 0 END AS code, CASE WHEN {near_first} THEN x.b + x.k + {signed_first} ELSE l.v END AS last, CASE WHEN {near_first} THEN x.b + x.k ELSE l.v END AS b, CASE WHEN {near_first} THEN {signed_first} ELSE 0 END AS k FROM {name}l l LEFT JOIN {name}f x ON x.step = l.step AND x.level = l.level - 1 AND l.segment = 0 WHERE l.place = 0"
        f" UNION ALL SELECT l.step, l.level, l.segment, l.place, l.block_id, l.v, {step} FROM {name}r r JOIN {name}l l ON l.step = r.step AND l.level = r.level AND l.segment = r.segment AND l.place = r.place + 1)",
    ]


_ORDERS = {
    "rows": ["o AS (SELECT step, 0 AS level, row_number() OVER (PARTITION BY step ORDER BY block_id) - 1 AS p, block_id, lo, hi FROM zu)"],
    "level": ["o0 AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY lo, block_id) AS rank FROM zu)", "o AS (SELECT step, CAST(floor(log2(rank)) AS BIGINT) AS level, rank - (CAST(1 AS BIGINT) << CAST(floor(log2(rank)) AS BIGINT)) AS p, block_id, lo, hi FROM o0)"],
    "hilbert": [*catalog._hilbert_sql(), f"o0 AS (SELECT step, block_id, {catalog._HILBERT} AS hilbert FROM h)", "o AS (SELECT step, 0 AS level, row_number() OVER (PARTITION BY step ORDER BY hilbert) - 1 AS p, block_id, lo, hi FROM o0 JOIN zu USING (step, block_id))"],
}
_BY_CHAIN = "both_ends AS (SELECT step, a.block_id, CAST(a.code AS INTEGER) AS low_code, CASE WHEN a.code = 0 THEN a.v END AS low_outlier, CAST(b.code AS INTEGER) AS high_code, CASE WHEN b.code = 0 THEN b.v END AS high_outlier, a.b + a.k AS lo, b.b + b.k AS hi FROM lor a JOIN hir b USING (step, level, segment, place))"
_BY_BINS = [
    "low AS (SELECT r.step, r.block_id, r.code, r.v, r.b + r.k AS lo, zu.hi FROM lor r JOIN zu USING (step, block_id))",
    "st AS (SELECT min(lo) AS l0, max(lo) + 1e-6 AS l1, min(hi) AS h0, max(hi) + 1e-6 AS h1 FROM low)",
    f"bn AS (SELECT low.*, st.*, greatest(0, least(floor((lo - l0) / (l1 - l0) * {BINS}), {BINS - 1})) AS low_bin, greatest(0, least(floor((hi - h0) / (h1 - h0) * {BINS}), {BINS - 1})) AS high_bin FROM low, st)",
    f"pr AS (SELECT bn.*, h0 + (e.x + 0.5) * ((h1 - h0) / {BINS}) AS predicted FROM bn JOIN (SELECT low_bin, floor(avg(high_bin)) AS x FROM bn GROUP BY low_bin) e USING (low_bin))",
    "hc AS (SELECT *, CASE WHEN {0} THEN {1} + {2} ELSE 0 END AS high FROM pr)".format(_coded("hi", "predicted")[0], codec.MIDDLE, _coded("hi", "predicted")[1]),
    f"both_ends AS (SELECT step, block_id, CAST(code AS INTEGER) AS low_code, CASE WHEN code = 0 THEN v END AS low_outlier, CAST(high AS INTEGER) AS high_code, CASE WHEN high = 0 THEN hi END AS high_outlier, lo, CASE WHEN high = 0 THEN hi ELSE predicted + (high - {codec.MIDDLE}) END AS hi FROM hc)",
]


def _codes_sql(order: str, highs: str) -> list[str]:
    """``both_ends``: the codes and restored ends of all blocks in an order."""
    return [catalog._VOX, catalog._ZU, *_ORDERS[order], *_fold("lo", "o", "lo"), *([*_fold("hi", "o", "hi"), _BY_CHAIN] if highs == "chain" else _BY_BINS)]


def _codes(name: str, order: str, highs: str) -> None:
    @register(name, *_codes_sql(order, highs), select="SELECT step, block_id, low_code, low_outlier, high_code, high_outlier FROM both_ends", recursive=True)
    def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = stored_index(spark, sf_dir)
        return indexcodec.compress_index(index.zones(), BOUND, order, highs, index.grid, BINS).codes.select("step", "block_id", "low_code", "low_outlier", "high_code", "high_outlier")


for _order, _highs in (("level", "bins"), ("level", "chain"), ("rows", "bins"), ("rows", "chain"), ("hilbert", "chain")):
    _codes(f"index_codes_{_order}_{_highs}", _order, _highs)


_RESTORED = f"SELECT step, CAST(block_id % c AS INTEGER) AS b0, CAST(block_id // c % c AS INTEGER) AS b1, CAST(block_id // (c * c) AS INTEGER) AS b2, lo, hi FROM both_ends, s"
_NEAR = "near AS (SELECT zs.step, zs.block_id, any_value(zs.lo) AS lo, any_value(zs.hi) AS hi, list_sum(list(u.lo ORDER BY u.b0, u.b1, u.b2)) / count(u.lo) AS mean_lo, list_sum(list(u.hi ORDER BY u.b0, u.b1, u.b2)) / count(u.hi) AS mean_hi FROM zs LEFT JOIN un u ON u.step = zs.step AND u.b0 BETWEEN zs.b0 - 1 AND zs.b0 AND u.b1 BETWEEN zs.b1 - 1 AND zs.b1 AND u.b2 BETWEEN zs.b2 - 1 AND zs.b2 GROUP BY zs.step, zs.block_id)"


def _one(v: str) -> str:
    near, signed = _coded(v, f"mean_{v}")
    return f"CAST(CASE WHEN {near} THEN {codec.MIDDLE} + {signed} ELSE 0 END AS INTEGER)"


@register("index_codes_shifted", *_codes_sql("hilbert", "chain"), catalog._ZS, f"un AS ({_RESTORED})", _NEAR, select=f"SELECT step, block_id, {_one('lo')} AS low_code, {_one('hi')} AS high_code FROM near", recursive=True)
def index_codes_shifted(spark, sf_dir):
    """Codes of the shifted blocks' ends against the restored aligned blocks that each touches."""
    index = stored_index(spark, sf_dir)
    restored = indexcodec.decompress_index(indexcodec.compress_index(index.zones(), BOUND, "hilbert", "chain", index.grid))
    restored = stored(restored.select("step", *G.block_coordinates(restored["block_id"], index.grid.counts), "lo", "hi"), "restored")
    return indexcodec.compress_shifted(index.zones(tiling="stagger"), restored, index.grid, BOUND).select("step", "block_id", "low_code", "high_code")


# saved codes


def saved_codes(spark: SparkSession, sf_dir: str) -> indexcodec.CodedIndex:
    """The saved codes of the event field, coded again when its table has been rewritten."""

    def make():
        index = stored_index(spark, sf_dir)
        return indexcodec.compress_index(index.zones(), BOUND, "level", "bins", index.grid, BINS)

    return indexcodec.CodedIndex.current(spark, standing_folder(spark, sf_dir, "codes"), [f"{sf_dir}/events.parquet"], make)


@register("saved_codes_candidates", *_codes_sql("level", "bins"), select=f"SELECT step, block_id FROM both_ends WHERE lo - {BOUND * (1 + 1e-7)} <= {HI} AND hi + {BOUND * (1 + 1e-7)} >= {LO}", recursive=True)
def saved_codes_candidates(spark, sf_dir):
    """Blocks that may meet a range, from saved codes alone."""
    return saved_codes(spark, sf_dir).blocks(LO, HI)


@register("saved_codes_query", catalog._VOX, select=f"SELECT step, d0, d1, d2, f FROM vox WHERE f BETWEEN {LO} AND {HI}")
def saved_codes_query(spark, sf_dir):
    """Values of a range: saved codes choose the blocks, of which the stored index has the values."""
    near = saved_codes(spark, sf_dir).blocks(LO, HI)
    index = stored_index(spark, sf_dir)
    return index.values_of(index.meeting(LO, HI).join(near, ["step", "block_id"], "left_semi"), LO, HI)


@register("stored_sizes")
def stored_sizes(spark, sf_dir):
    """(name, files, bytes, percent): what the index's tables and the saved codes take on disk, and as a share of the events' files.  SQL doesn't see files."""
    index, codes = stored_index(spark, sf_dir), saved_codes(spark, sf_dir)
    tables = {name: f"{index.build_path}/{name}" for name in index.schemas} | {"codes": f"{codes.path}/codes"}
    whole = stored_bytes(spark, f"{sf_dir}/events.parquet").select(F.col("bytes").alias("whole"))
    rows = None
    for name, path in tables.items():
        row = stored_bytes(spark, path).select(F.lit(name).alias("name"), "files", "bytes")
        rows = row if rows is None else rows.union(row)
    return rows.crossJoin(F.broadcast(whole)).select("name", "files", "bytes", F.round(100.0 * F.col("bytes") / F.col("whole"), 3).alias("percent"))  # one row


# volumes in files


def raw_volumes(spark: SparkSession, sf_dir: str, dtype: str) -> tuple[str, G.Grid]:
    """The folder of the event field's steps as headerless files, written again when the table has been rewritten, and its grid."""
    place, seen = standing_folder(spark, sf_dir, f"volumes-{dtype.strip('<>')}"), fingerprint(spark, f"{sf_dir}/events.parquet")
    voxels, grid = catalog._events(spark, sf_dir)
    old = published(spark, place)
    if old is None or old["source"] != seen:
        build = new_build(place)
        files = volumes.write(voxels, build, grid.shape, dtype).count()
        publish(spark, place, {"build": build, "source": seen, "files": files})
    return published(spark, place)["build"], grid


@register("volume_scan", catalog._VOX, select="SELECT step, d0, d1, d2, f FROM vox WHERE step >= 1 AND d0 BETWEEN 2 AND 5 AND f > 10")
def volume_scan(spark, sf_dir):
    """Files of double precision: steps and planes are chosen before bytes are read, values afterwards."""
    path, grid = raw_volumes(spark, sf_dir, "<f8")
    return volumes.read(spark, path, grid.shape).where("step >= 1 and d0 between 2 and 5 and f > 10 and not isnan(f)")


@register("volume_scan_single", catalog._VOX, select="SELECT step, d0, d1, d2, CAST(CAST(f AS FLOAT) AS DOUBLE) AS f FROM vox WHERE step IN (0, 2)")
def volume_scan_single(spark, sf_dir):
    """Files of big-endian single precision."""
    path, grid = raw_volumes(spark, sf_dir, ">f4")
    return volumes.read(spark, path, grid.shape, ">f4").where("step in (0, 2) and not isnan(f)")


# metadata and observations


@register("footer_steps", catalog._VOX, select=f"SELECT step, min(f) AS lo, max(f) AS hi FROM vox GROUP BY step HAVING min(f) <= {HI} AND max(f) >= {LO}")
def footer_steps(spark, sf_dir):
    """Steps that meet a range, from the footers of the index's files alone."""
    found = footers.zones(spark, f"{stored_index(spark, sf_dir).build_path}/blocks", ["f_lo", "f_hi"])
    step = F.regexp_extract("path", r"/step=(-?\d+)/", 1).cast("long").alias("step")
    ranges = found.groupBy(step).agg(F.min(F.when(F.col("column") == "f_lo", F.col("lo"))).alias("lo"), F.max(F.when(F.col("column") == "f_hi", F.col("hi"))).alias("hi"))
    return ranges.where(query.overlaps(LO, HI))


@register("footer_rows", catalog._VOX, catalog._ZU, select="SELECT step, count(*) AS n, CAST(0 AS BIGINT) AS nulls FROM zu GROUP BY step")
def footer_rows(spark, sf_dir):
    """Rows and nulls of each step's blocks, from footers."""
    found = footers.zones(spark, f"{stored_index(spark, sf_dir).build_path}/blocks", ["f_lo"])
    return found.groupBy(F.regexp_extract("path", r"/step=(-?\d+)/", 1).cast("long").alias("step")).agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"))


@register("observed_range", catalog._VOX, catalog._ZU, select=f"SELECT (SELECT count(*) FROM zu) AS blocks, (SELECT count(*) FROM zu WHERE lo <= {HI} AND hi >= {LO}) AS blocks_hit, (SELECT count(*) FROM vox WHERE f BETWEEN {LO} AND {HI}) AS n_values")
def observed_range(spark, sf_dir):
    """How many blocks a range query touched, as observed while it ran, and how many values it gave."""
    index = stored_index(spark, sf_dir)
    found, seen = index.observed_values(LO, HI)
    n = found.count()
    return index._read("blocks").agg(F.count(F.lit(1)).alias("blocks")).select("blocks", F.lit(seen.get["blocks_hit"]).alias("blocks_hit"), F.lit(n).cast("long").alias("n_values"))


# scatterplots weighed by depth

_DEPTH_PIXELS = 24
_TETS = ", ".join(f"({t}, {', '.join(str(k + 1) for k in tet)})" for t, tet in enumerate(analytics.TETRAHEDRA))
_EDGE = "[{}]".format(", ".join(f"[{', '.join(str(float(c)) for c in reversed(corner))}]" for corner in halo.CORNERS))


def _depth_sql(f_range: tuple[float, float], g_range: tuple[float, float], n: int) -> tuple[list[str], str]:
    """SQL of ``depth_scatterplot``: a row for each tetrahedron, then for each of its two triangles, then for each pixel of their boxes."""
    (f0, f1), (g0, g1) = ((f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)") for a, b in (f_range, g_range))
    pair = lambda i, j: f"((f{i} - f0) * (g{j} - g0) - (f{j} - f0) * (g{i} - g0))"
    side = lambda i, a: f"(p[k{i}][{a}] - p[k0][{a}])"
    normal = [f"({pair(1, 2)} * {side(3, a)} + {pair(2, 3)} * {side(1, a)} + {pair(3, 1)} * {side(2, a)}) / volume" for a in (1, 2, 3)]
    face = lambda a, b, c: f"abs((f{b} - f{a}) * (g{c} - g{a}) - (f{c} - f{a}) * (g{b} - g{a}))"
    faces = [face(*(k for k in range(4) if k != i)) for i in range(4)]
    weight = [f"CASE WHEN {x} < {analytics.FLAT} * size THEN 0 ELSE volume / {x} END" for x in faces]
    scaled = lambda x, lo, hi: f"(greatest({lo}, least({hi}, {x})) - {lo}) / (({hi} - {lo}) / {n})"
    corner = ", ".join(f"{{'f': f{i}, 'i': {i}, 'x': {scaled(f'f{i}', f0, f1)}, 'y': {scaled(f'g{i}', g0, g1)}, 'd': {weight[i]}}}" for i in range(4))
    w = lambda j, k: f"((x{j} - px - 0.5 :: DOUBLE) * (y{k} - py - 0.5 :: DOUBLE) - (x{k} - px - 0.5 :: DOUBLE) * (y{j} - py - 0.5 :: DOUBLE)) / area"
    box = lambda x: f"unnest(range(CAST(greatest(0, floor(least({x}0, {x}1, {x}2))) AS BIGINT), CAST(least({n - 1}, ceil(greatest({x}0, {x}1, {x}2))) AS BIGINT) + 1)) AS p{x}"
    ctes = [
        f"tets(tet, k0, k1, k2, k3) AS (VALUES {_TETS})",
        f"lists AS (SELECT [{', '.join(f'f{k}' for k in range(8))}] AS fs, [{', '.join(f'g{k}' for k in range(8))}] AS gs, {_EDGE} AS p FROM cells)",
        f"t0 AS (SELECT p, CAST(CASE WHEN tet < 4 THEN 1 ELSE 2 END AS DOUBLE) AS volume, k0, k1, k2, k3, {', '.join(f'{x}s[k{i}] AS {x}{i}' for x in 'fg' for i in range(4))} FROM lists, tets)",
        f"t1 AS (SELECT *, sqrt(pow({normal[0]}, 2) + pow({normal[1]}, 2) + pow({normal[2]}, 2)) AS size FROM t0 WHERE greatest(f0, f1, f2, f3) >= {f0} AND least(f0, f1, f2, f3) <= {f1} AND greatest(g0, g1, g2, g3) >= {g0} AND least(g0, g1, g2, g3) <= {g1})",
        f"t2 AS (SELECT list_sort([{corner}]) AS c FROM t1 WHERE size >= {analytics.FLAT})",
        f"t3 AS (SELECT {', '.join(f'c[CASE WHEN part = 0 THEN {a} ELSE {b} END].{v} AS {v}{i}' for i, (a, b) in enumerate(((1, 1), (2, 3), (3, 4))) for v in 'xyd')} FROM t2, (SELECT unnest([0, 1]) AS part))",
        f"t4 AS (SELECT *, {box('x')} FROM (SELECT *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS area FROM t3) WHERE abs(area) >= {analytics.FLAT_IMAGE})",
        f"t5 AS (SELECT *, {box('y')} FROM t4)",
        f"t6 AS (SELECT px, py, d0, d1, d2, {w(1, 2)} AS w0, {w(2, 0)} AS w1 FROM t5)",
    ]
    inside = f"w0 >= -{analytics.BESIDE} AND w1 >= -{analytics.BESIDE} AND 1 - w0 - w1 >= -{analytics.BESIDE} AND w0 * d0 + w1 * d1 + (1 - w0 - w1) * d2 > 0"
    return ctes, f"SELECT CAST(px AS INTEGER) AS bin_f, CAST(py AS INTEGER) AS bin_g, round(sum(w0 * d0 + w1 * d1 + (1 - w0 - w1) * d2), 6) AS density FROM t6 WHERE {inside} GROUP BY px, py"


_DEPTH = _depth_sql(catalog.F_RANGE, catalog.G_RANGE, _DEPTH_PIXELS)


@register("csp_depth", catalog._VOX, catalog._corner_join("fg"), *_DEPTH[0], select=_DEPTH[1])
def csp_depth(spark, sf_dir):
    return analytics.depth_scatterplot(catalog._events(spark, sf_dir)[0], catalog.F_RANGE, catalog.G_RANGE, _DEPTH_PIXELS).withColumn("density", F.round("density", 6))


# blocks coded in three dimensions

_CUBE_BOUND = 1e-3
_AT = lambda back: f"restored[i + 1 - {16 * back[0] + 4 * back[1] + back[2]}]"
_HAS = lambda back: " AND ".join(f"{x} > 0" for x, b in zip(("i // 16", "i // 4 % 4", "i % 4"), back) if b)
_CUBE_PREDICTED = " + ".join(f"{sign} * CASE WHEN {_HAS(back)} THEN {_AT(back)} ELSE 0 END" for back, sign in codec.NEIGHBOURS)
_CUBE_FOLD = f"""r AS (SELECT vec_id, 0 AS i, CAST([] AS DOUBLE[]) AS restored, CAST([] AS INTEGER[]) AS codes FROM embeddings UNION ALL
        SELECT vec_id, i + 1, list_append(restored, CASE WHEN coded THEN back ELSE x END), list_append(codes, CAST(CASE WHEN coded THEN {codec.BLOCK_RADIUS} + steps ELSE 0 END AS INTEGER))
        FROM (SELECT *, abs(steps) < {codec.BLOCK_RADIUS} AND abs(back - x) <= {_CUBE_BOUND}::DOUBLE AS coded FROM (SELECT *, predicted + {2 * _CUBE_BOUND}::DOUBLE * steps AS back FROM (SELECT *, floor((x - predicted) / {2 * _CUBE_BOUND}::DOUBLE + 0.5::DOUBLE) AS steps
        FROM (SELECT vec_id, i, restored, codes, CAST(embedding[i + 1] AS DOUBLE) AS x, CAST({_CUBE_PREDICTED} AS DOUBLE) AS predicted FROM r JOIN embeddings USING (vec_id) WHERE i < len(embedding))))))"""


@register("cube_codes", _CUBE_FOLD, select="SELECT vec_id AS block_id, unnest(range(0, 64)) AS place, unnest(codes) AS code, round(unnest(restored), 9) + 0 AS restored FROM r WHERE i = 64", recursive=True)
def cube_codes(spark, sf_dir):
    """Codes of blocks against up to seven neighbours of each value, and the blocks restored from them."""
    coded = stored(codec.compress_cubes(fields.embedding_blocks(spark, sf_dir), _CUBE_BOUND), "cubes")
    back = codec.decompress_cubes(coded, _CUBE_BOUND).select("block_id", "values")
    both = coded.join(back, "block_id").select("block_id", F.posexplode(F.arrays_zip("codes", "values")).alias("place", "c"))
    return both.select("block_id", F.col("place").cast("long").alias("place"), F.col("c.codes").alias("code"), (F.round("c.values", 9) + 0.0).alias("restored"))


# meshes with holes


@register("mesh_fill_report")
def mesh_fill_report(spark, sf_dir):
    """The event field's surface without a triangle of each cell on its diagonal: how many triangles fill its holes, and what stays open.  A greedy choice, round by round, is beyond SQL; tests hold it on small meshes."""
    voxels, _ = catalog._events(spark, sf_dir)
    surface = mesh.triangles(voxels, catalog.ISO).where("not (d0 = d1 and k = 0)")
    return mesh.fill_report(stored(surface.select("step", "a", "b", "c"), "holed"), mesh.edge_vertices(voxels, catalog.ISO))


# selectivity of isovalues evenly spaced by logarithm

_EVEN = "v AS (SELECT (SELECT greatest(max(abs(lo)), max(abs(hi))) FROM zu) * pow(10, -6 * (1 - (i % 500) / CAST(499 AS DOUBLE))) * CASE WHEN i < 500 THEN 1 ELSE -1 END AS isovalue FROM (SELECT unnest(range(0, 1000)) AS i))"


@register("selectivity_even", catalog._VOX, catalog._ZU, _EVEN, catalog._NUMBERED, "m AS (SELECT i, step, b0, b1, b2 FROM x JOIN zu ON lo <= isovalue AND hi >= isovalue)",
    "w AS (SELECT DISTINCT i, step, b0 + p AS b0, b1 + q AS b1, b2 + r AS b2 FROM m, s, (SELECT unnest([-1, 0, 1]) AS p) a, (SELECT unnest([-1, 0, 1]) AS q) b, (SELECT unnest([-1, 0, 1]) AS r) e WHERE b0 + p BETWEEN 0 AND c - 1 AND b1 + q BETWEEN 0 AND c - 1 AND b2 + r BETWEEN 0 AND c - 1)",
    select="SELECT x.i, coalesce(k.n, 0) AS blocks, coalesce(j.n, 0) AS expanded FROM x LEFT JOIN (SELECT i, count(*) AS n FROM m GROUP BY i) k USING (i) LEFT JOIN (SELECT i, count(*) AS n FROM w GROUP BY i) j USING (i)")
def selectivity_even(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    zones = index.zones()
    largest = zones.agg(F.greatest(F.max(F.abs("lo")), F.max(F.abs("hi")))).first()[0]
    return analytics.expanded_selectivity(zones, index.grid, analytics.even_isovalues(largest, 500)).select("i", "blocks", "expanded")
