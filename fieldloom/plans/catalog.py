"""The registered queries of the field engine, each with the SQL that says the same over the given tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import grid as G
from fieldloom.operators import analytics, blocks, codec, indexcodec, mesh, zonemap
from fieldloom.plans import query
from fieldloom.plans.index import FieldIndex, candidate_blocks
from fieldloom.sources import fields, raw, sinks
from fieldloom.sources.store import shared_folder, stored

#: Parameters of the registered queries.
LO, HI, ISO, ERROR, RELATIVE = 250.0, 300.0, 100.0, 5.0, 1e-3
F_RANGE, G_RANGE, RESOLUTION, BINS = (100.0, 300.0), (20.0, 400.0), 64, 100
ISOVALUES = 50

_VOX = """
    s AS (SELECT max(k) AS s, CAST(max(k) // 4 AS INTEGER) AS c FROM (SELECT unnest([8, 16, 32, 64, 128, 256, 512, 1024]) AS k) sides, (SELECT count(*) AS n FROM events) WHERE k = 8 OR CAST(k AS BIGINT) * k * k * 2 <= n),
    vox AS (SELECT event_id // (s * s * s) AS step, CAST(event_id // (s * s) % s AS INTEGER) AS d0, CAST(event_id // s % s AS INTEGER) AS d1, CAST(event_id % s AS INTEGER) AS d2, value AS f, CAST(user_id AS DOUBLE) AS g FROM events, s)"""


def _zones(name: str, index: str, count: str, value: str = "f") -> str:
    b = ", ".join(f"CAST({index.format(d=f'd{i}')} AS INTEGER) AS b{i}" for i in range(3))
    return f"""
    {name}_b AS (SELECT vox.*, {b} FROM vox),
    {name} AS (SELECT step, CAST(b0 + b1 * ({count}) + b2 * ({count}) * ({count}) AS BIGINT) AS block_id, b0, b1, b2, min({value}) AS lo, max({value}) AS hi, count({value}) AS n FROM {name}_b, s GROUP BY ALL)"""


_UNIFORM, _STAGGER, _MERGED = "{d} // 4", "CASE WHEN {d} < 2 THEN 0 ELSE 1 + ({d} - 2) // 4 END", "CASE WHEN {d} < 6 THEN 0 ELSE ({d} - 2) // 4 END"
_ZU, _ZS, _ZM = _zones("zu", _UNIFORM, "c"), _zones("zs", _STAGGER, "c + 1"), _zones("zm", _MERGED, "c")
_ZGU, _ZGS = _zones("zgu", _UNIFORM, "c", "g"), _zones("zgs", _STAGGER, "c + 1", "g")


def _covered(zones: str, merged: bool = False) -> str:
    """Aligned blocks under shifted ones."""
    def axis(i):
        low = f"CASE WHEN z.b{i} = 0 THEN 0 ELSE {'z.b%d * 4 + 2' % i if merged else '(z.b%d - 1) * 4 + 2' % i} END"
        high = f"CASE WHEN z.b{i} = 0 THEN {5 if merged else 1} ELSE {'(z.b%d + 1) * 4 + 1' % i if merged else 'z.b%d * 4 + 1' % i} END"
        return f"u{i} BETWEEN ({low}) // 4 AND least(least({high}, s - 1) // 4, c - 1)"

    u = ", ".join(f"(SELECT unnest(range(0, 8)) AS u{i}) AS t{i}" for i in range(3))
    return f"SELECT z.step, z.b0 AS s0, z.b1 AS s1, z.b2 AS s2, CAST(u0 AS INTEGER) AS b0, CAST(u1 AS INTEGER) AS b1, CAST(u2 AS INTEGER) AS b2, CAST(u0 + u1 * c + u2 * c * c AS BIGINT) AS block_id FROM ({zones}) z, s, {u} WHERE {axis(0)} AND {axis(1)} AND {axis(2)}"


def _core(u: str, st: str, lo: float, hi: float) -> str:
    meets = f"lo <= {hi} AND hi >= {lo}"
    return f"SELECT step, b0, b1, b2, block_id FROM {u} WHERE {meets} UNION SELECT step, b0, b1, b2, block_id FROM ({_covered(f'SELECT * FROM {st} WHERE {meets}')})"


def _corner_join(fields_: str = "f") -> str:
    """All cells with their corners, by an eightfold self-join."""
    names = ", ".join(f"v{k}.{x} AS {x}{k}" for x in fields_ for k in range(8))
    joins = " ".join(f"JOIN vox v{k} ON v{k}.step = v0.step AND v{k}.d0 = v0.d0 + {z} AND v{k}.d1 = v0.d1 + {y} AND v{k}.d2 = v0.d2 + {x}" for k, (x, y, z) in enumerate(blocks.CORNERS) if k)
    return f"cells AS (SELECT v0.step, v0.d0, v0.d1, v0.d2, {names} FROM vox v0 {joins})"


_CASE = " + ".join(f"CASE WHEN f{k} >= {ISO} THEN {1 << k} ELSE 0 END" for k in range(8))

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, *ctes: str, select: str | None = None, recursive: bool = False):
    """Registers a query and, with ``select``, its SQL over the named expressions."""

    def keep(function):
        QUERIES[name] = function
        if select:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} {select}" if ctes else select
        return function

    return keep


def _events(spark: SparkSession, sf_dir: str):
    return fields.event_field(spark, sf_dir)


def stored_index(spark: SparkSession, sf_dir: str) -> FieldIndex:
    """The index of the event field in the shared folder: built when there is none, or one of a table that has been rewritten since."""
    place = f"{shared_folder(spark)}/field-index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return FieldIndex.current(spark, place, [f"{sf_dir}/events.parquet"], lambda: (*_events(spark, sf_dir), ("f", "g")))


def _zone(spark: SparkSession, sf_dir: str, tiling: str = "uniform", value: str = "f"):
    voxels, grid = _events(spark, sf_dir)
    return zonemap.zone_map(voxels, grid, tiling, value), grid


# ranges


@register("range_scan", _VOX, select=f"SELECT step, d0, d1, d2, f FROM vox WHERE f BETWEEN {LO} AND {HI}")
def range_scan(spark, sf_dir):
    return _events(spark, sf_dir)[0].where(F.col("f").between(LO, HI)).drop("g")


@register("range_indexed", _VOX, select=f"SELECT step, d0, d1, d2, f FROM vox WHERE f BETWEEN {LO} AND {HI}")
def range_indexed(spark, sf_dir):
    return stored_index(spark, sf_dir).values(LO, HI)


@register("range_semi_join", _VOX, select=f"SELECT step, d0, d1, d2, f FROM vox WHERE f BETWEEN {LO} AND {HI}")
def range_semi_join(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels.drop("g"), grid, LO, HI, zones=stored_index(spark, sf_dir).zones()).values()


@register("index_zones", _VOX, _ZU, select="SELECT * FROM zu")
def index_zones(spark, sf_dir):
    return stored_index(spark, sf_dir).zones()


@register("index_steps", _VOX, select=f"SELECT step FROM vox GROUP BY step HAVING min(f) <= {F_RANGE[1]} AND max(f) >= {F_RANGE[0]} AND min(g) <= {G_RANGE[1]} AND max(g) >= {G_RANGE[0]}")
def index_steps(spark, sf_dir):
    return stored_index(spark, sf_dir).steps(f=F_RANGE, g=G_RANGE)


@register("index_candidates", _VOX, _ZU, _ZGU, select=f"SELECT zu.step, zu.block_id FROM zu JOIN zgu ON zu.step = zgu.step AND zu.block_id = zgu.block_id WHERE zu.lo <= {F_RANGE[1]} AND zu.hi >= {F_RANGE[0]} AND zgu.lo <= {G_RANGE[1]} AND zgu.hi >= {G_RANGE[0]}")
def index_candidates(spark, sf_dir):
    return candidate_blocks(stored_index(spark, sf_dir), F_RANGE, G_RANGE)


@register("candidate_steps", _VOX, select="SELECT step FROM vox GROUP BY step HAVING min(f) <= 560 AND max(f) >= 340 AND min(g) <= 50 AND max(g) >= 0")
def candidate_steps(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.candidate_steps(query.RangeQuery(voxels, grid, 340.0, 560.0), query.RangeQuery(voxels, grid, 0.0, 50.0, value="g"))


@register("step_prefilter", _VOX, _ZU, select=f"SELECT step FROM zu GROUP BY step HAVING min(lo) <= {HI} AND max(hi) >= {LO}")
def step_prefilter(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels, grid, LO, HI).steps()


@register("overlap_blocks", _VOX, _ZU, select=f"SELECT step, b0, b1, b2, block_id FROM zu WHERE lo <= {HI} AND hi >= {LO}")
def overlap_blocks(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels, grid, LO, HI).blocks()


@register("overlap_blocks_widened", _VOX, _ZU, select=f"SELECT step, b0, b1, b2, block_id FROM zu WHERE lo - {ERROR} <= {HI} AND hi + {ERROR} >= {LO}")
def overlap_blocks_widened(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels, grid, LO, HI, error=ERROR).blocks()


@register("dual_index_core", _VOX, _ZU, _ZS, select=_core("zu", "zs", LO, HI))
def dual_index_core(spark, sf_dir):
    return query.RangeQuery.of_index(stored_index(spark, sf_dir), LO, HI).core()


@register("iso_core", _VOX, _ZU, _ZS, select=_core("zu", "zs", ISO, ISO))
def iso_core(spark, sf_dir):
    return query.RangeQuery.of_index(stored_index(spark, sf_dir), ISO, ISO).core()


@register(
    "neighbor_expand", _VOX, _ZU, _ZS, f"core AS ({_core('zu', 'zs', 450.0, 1e9)})",
    select="SELECT DISTINCT step, CAST(b0 + x AS INTEGER) AS b0, CAST(b1 + y AS INTEGER) AS b1, CAST(b2 + z AS INTEGER) AS b2, CAST(b0 + x + (b1 + y) * c + (b2 + z) * c * c AS BIGINT) AS block_id FROM core, s, (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS y) b, (SELECT unnest([-1, 0, 1]) AS z) e WHERE b0 + x BETWEEN 0 AND c - 1 AND b1 + y BETWEEN 0 AND c - 1 AND b2 + z BETWEEN 0 AND c - 1",
)
def neighbor_expand(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels, grid, 450.0, 1e9).expanded()


@register("bivariate_core", _VOX, _ZU, _ZS, _ZGU, _ZGS, f"cf AS ({_core('zu', 'zs', *F_RANGE)})", f"cg AS ({_core('zgu', 'zgs', *G_RANGE)})", select="SELECT cf.* FROM cf SEMI JOIN cg ON cf.step = cg.step AND cf.block_id = cg.block_id")
def bivariate_core(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return query.both(query.RangeQuery.of_index(index, *F_RANGE), query.RangeQuery.of_index(index, *G_RANGE, value="g"))


_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS query, n_nationkey * 20.0 AS qlo, n_nationkey * 20.0 + 10 + n_regionkey AS qhi FROM nation"


@register("range_batch", _VOX, _ZU, select=f"SELECT q.query, count(zu.lo) AS n FROM ({_NATIONS}) q LEFT JOIN zu ON zu.lo <= q.qhi AND zu.hi >= q.qlo GROUP BY q.query")
def range_batch(spark, sf_dir):
    nations = fields.table(spark, sf_dir, "nation")
    ranges = nations.select(F.col("n_nationkey").cast("long").alias("query"), (F.col("n_nationkey") * 20.0).alias("qlo"), (F.col("n_nationkey") * 20.0 + 10 + F.col("n_regionkey")).alias("qhi"))
    return query.batch_counts(stored_index(spark, sf_dir).zones(), ranges)


def _place(i: int) -> str:
    return f"(((CAST(n_nationkey AS BIGINT) * 2 + {i}) * 1103515245 + 12345) % 2147483648 / CAST(2147483648 AS DOUBLE))"


@register("random_ranges", _VOX, _ZU, f"q AS (SELECT CAST(n_nationkey AS BIGINT) AS query, 500 * {_place(1)} AS a, 500 * {_place(2)} AS b FROM nation)", select="SELECT q.query, count(zu.lo) AS n FROM q LEFT JOIN zu ON zu.lo <= greatest(a, b) AND zu.hi >= least(a, b) GROUP BY q.query")
def random_ranges(spark, sf_dir):
    return query.batch_counts(stored_index(spark, sf_dir).zones(), query.random_ranges(fields.table(spark, sf_dir, "nation"), "n_nationkey", 0.0, 500.0))


@register("random_share_ranges", _VOX, _ZU, f"q AS (SELECT CAST(n_nationkey AS BIGINT) AS query, 500 * {_place(1)} AS a FROM nation)", select="SELECT q.query, count(zu.lo) AS n FROM q LEFT JOIN zu ON zu.lo <= a + 50 AND zu.hi >= a GROUP BY q.query")
def random_share_ranges(spark, sf_dir):
    return query.batch_counts(stored_index(spark, sf_dir).zones(), query.random_ranges(fields.table(spark, sf_dir, "nation"), "n_nationkey", 0.0, 500.0, 0.1))


_WIDE = "wide AS (SELECT DISTINCT step, b0 + x AS b0, b1 + y AS b1, b2 + z AS b2 FROM core, s, (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS y) b, (SELECT unnest([-1, 0, 1]) AS z) e WHERE b0 + x BETWEEN 0 AND c - 1 AND b1 + y BETWEEN 0 AND c - 1 AND b2 + z BETWEEN 0 AND c - 1)"


@register("expansion_ratio", _VOX, _ZU, _ZS, f"core AS ({_core('zu', 'zs', 450.0, 1e9)})", _WIDE, select="SELECT h.n AS hit, w.n AS expanded, t.n AS blocks, round(100.0 * h.n / t.n, 6) AS hit_percent, round(100.0 * w.n / t.n, 6) AS expanded_percent FROM (SELECT count(*) AS n FROM core) h, (SELECT count(*) AS n FROM wide) w, (SELECT count(*) AS n FROM zu) t")
def expansion_ratio(spark, sf_dir):
    q = query.RangeQuery.of_index(stored_index(spark, sf_dir), 450.0, 1e9)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # three rows of one number
    out = count(q.core(), "hit").crossJoin(F.broadcast(count(q.expanded(), "expanded"))).crossJoin(F.broadcast(count(q.zones, "blocks")))
    return out.select("*", *(F.round(100.0 * F.col(c) / F.col("blocks"), 6).alias(f"{c}_percent") for c in ("hit", "expanded")))


@register("expansion_count", _VOX, _ZU, _ZS, f"core AS ({_core('zu', 'zs', 450.0, 1e9)})",
    "wide AS (SELECT DISTINCT step, b0 + x AS b0, b1 + y AS b1, b2 + z AS b2 FROM core, s, (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS y) b, (SELECT unnest([-1, 0, 1]) AS z) e WHERE b0 + x BETWEEN 0 AND c - 1 AND b1 + y BETWEEN 0 AND c - 1 AND b2 + z BETWEEN 0 AND c - 1)",
    select="SELECT w.step, count(*) AS expanded, count(core.step) AS core, count(*) - count(core.step) AS added FROM wide w LEFT JOIN core USING (step, b0, b1, b2) GROUP BY w.step")
def expansion_count(spark, sf_dir):
    q = query.RangeQuery.of_index(stored_index(spark, sf_dir), 450.0, 1e9)
    core = q.core().select("step", "block_id", F.lit(1).alias("own"))
    wide = q.expanded().join(core, ["step", "block_id"], "left").groupBy("step").agg(F.count(F.lit(1)).alias("expanded"), F.count("own").alias("core"))
    return wide.withColumn("added", F.col("expanded") - F.col("core"))


# zone maps

for _name, _tiling, _cte, _table in (("zonemap_uniform", "uniform", _ZU, "zu"), ("zonemap_stagger", "stagger", _ZS, "zs"), ("zonemap_stagger_merged", "stagger_merged", _ZM, "zm")):
    register(_name, _VOX, _cte, select=f"SELECT * FROM {_table}")(lambda spark, sf_dir, t=_tiling: _zone(spark, sf_dir, t)[0])

for _name, _tiling, _cte, _table in (("stagger_to_uniform", "stagger", _ZS, "zs"), ("stagger_merged_to_uniform", "stagger_merged", _ZM, "zm")):

    @register(_name, _VOX, _cte, select=_covered(f"SELECT * FROM {_table}", _table == "zm"))
    def _mapped(spark, sf_dir, tiling=_tiling):
        zones, grid = _zone(spark, sf_dir, tiling)
        return G.stagger_to_uniform(zones, grid, tiling)


@register("zonemap_dual", _VOX, _ZU, _ZS, select="SELECT 'uniform' AS tiling, * FROM zu UNION ALL SELECT 'stagger', * FROM zs")
def zonemap_dual(spark, sf_dir):
    return zonemap.dual_zone_map(*_events(spark, sf_dir))


@register("zonemap_two_level", _VOX, _ZU, select="SELECT step, CAST(b0 // 2 AS INTEGER) AS b0, CAST(b1 // 2 AS INTEGER) AS b1, CAST(b2 // 2 AS INTEGER) AS b2, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n FROM zu GROUP BY 1, 2, 3, 4")
def zonemap_two_level(spark, sf_dir):
    return zonemap.two_level(_zone(spark, sf_dir)[0], 2)


_LINES = """
    lines AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS step, CAST(l_quantity - 1 AS INTEGER) AS d0, CAST(round(l_discount * 100) AS INTEGER) AS d1, CAST(round(l_tax * 100) AS INTEGER) AS d2, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
    vox AS (SELECT step, d0, d1, d2, CAST(sum(cents) AS DOUBLE) / (count(*) * 100) AS f, CAST(count(*) AS DOUBLE) AS g FROM lines GROUP BY step, d0, d1, d2)"""


@register("zonemap_ragged", _LINES, select="SELECT step, CAST(d0 // 4 + d1 // 4 * 13 + d2 // 4 * 39 AS BIGINT) AS block_id, CAST(d0 // 4 AS INTEGER) AS b0, CAST(d1 // 4 AS INTEGER) AS b1, CAST(d2 // 4 AS INTEGER) AS b2, min(f) AS lo, max(f) AS hi, count(f) AS n FROM vox GROUP BY ALL")
def zonemap_ragged(spark, sf_dir):
    return zonemap.zone_map(*fields.line_field(spark, sf_dir))


@register("zonemap_embeddings", select="SELECT CAST(0 AS BIGINT) AS step, vec_id AS block_id, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def zonemap_embeddings(spark, sf_dir):
    b = fields.embedding_blocks(spark, sf_dir)
    return b.select("step", "block_id", F.array_min("values").alias("lo"), F.array_max("values").alias("hi"), F.size("values").cast("long").alias("n"))


@register("zonemap_balances", select="SELECT c_custkey // 64 AS block_id, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer GROUP BY 1")
def zonemap_balances(spark, sf_dir):
    customers = fields.table(spark, sf_dir, "customer")
    return customers.groupBy(G.quotient(F.col("c_custkey"), 64).alias("block_id")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count(F.lit(1)).alias("n"))


@register("step_stats", _VOX, select="SELECT step, min(f) AS lo, max(f) AS hi, count(f) AS n FROM vox GROUP BY step")
def step_stats(spark, sf_dir):
    return zonemap.step_stats(_zone(spark, sf_dir)[0])


@register("error_bound", _VOX, select=f"SELECT min(f) AS lo, max(f) AS hi, {RELATIVE} * (max(f) - min(f)) AS abs_err FROM vox")
def error_bound(spark, sf_dir):
    return zonemap.error_bound(zonemap.step_stats(_zone(spark, sf_dir)[0]), RELATIVE)


_PLACE = ", ".join(f"(SELECT unnest([0, 1, 2]) AS o{i}) t{i}" for i in range(3))
_GAP_B = [f"CASE WHEN o{i} = 2 THEN d{i} // 4 - 1 ELSE d{i} // 4 END" for i in range(3)]
_GAP_OK = [f"(o{i} = 0 OR (o{i} = 1 AND d{i} % 4 = 3 AND d{i} // 4 + 1 < c) OR (o{i} = 2 AND d{i} % 4 = 0 AND d{i} >= 4))" for i in range(3)]


_GAPS = f"gaps AS (SELECT step, CAST({_GAP_B[0]} + ({_GAP_B[1]}) * c + ({_GAP_B[2]}) * c * c AS BIGINT) AS block_id, CAST(CASE WHEN o0 > 0 THEN 1 ELSE 0 END + CASE WHEN o1 > 0 THEN 2 ELSE 0 END + CASE WHEN o2 > 0 THEN 4 ELSE 0 END AS INTEGER) AS mask, min(f) AS lo, max(f) AS hi FROM vox, s, {_PLACE} WHERE {' AND '.join(_GAP_OK)} AND o0 + o1 + o2 > 0 GROUP BY ALL)"


@register("gap_union", _VOX, _ZU, _GAPS, select="SELECT step, block_id FROM zu WHERE lo <= 1e9 AND hi >= 400 UNION SELECT step, block_id FROM gaps WHERE lo <= 1e9 AND hi >= 400")
def gap_union(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels, grid, 400.0, 1e9).with_gaps()


@register("gap_intervals", _VOX, select=f"SELECT step, CAST({_GAP_B[0]} + ({_GAP_B[1]}) * c + ({_GAP_B[2]}) * c * c AS BIGINT) AS block_id, CAST(CASE WHEN o0 > 0 THEN 1 ELSE 0 END + CASE WHEN o1 > 0 THEN 2 ELSE 0 END + CASE WHEN o2 > 0 THEN 4 ELSE 0 END AS INTEGER) AS mask, min(f) AS lo, max(f) AS hi, count(f) AS n FROM vox, s, {_PLACE} WHERE {' AND '.join(_GAP_OK)} AND o0 + o1 + o2 > 0 GROUP BY ALL")
def gap_intervals(spark, sf_dir):
    return zonemap.gap_intervals(*_events(spark, sf_dir))


def _bits(x: str, shift: int) -> str:
    return " + ".join(f"((CAST({x} AS BIGINT) >> {i}) & 1) * {1 << (3 * i + shift)}" for i in range(4))


_MORTON = f"{_bits('b0', 0)} + {_bits('b1', 1)} + {_bits('b2', 2)}"


@register("morton_keys", _VOX, _ZU, select=f"SELECT step, block_id, {_MORTON} AS morton, b0 AS x, b1 AS y, b2 AS z FROM zu")
def morton_keys(spark, sf_dir):
    zones, _ = _zone(spark, sf_dir)
    keyed = zones.select("step", "block_id", G.morton(*(F.col(b) for b in G.BLOCKS)).alias("morton"))
    return keyed.select("*", *(c.alias(n) for c, n in zip(G.morton_decode(F.col("morton")), "xyz")))


def _hilbert_sql() -> list[str]:
    """The steps of the curve's transposition, a table each, for grids of at most eight blocks a side."""
    out = ["h0 AS (SELECT step, block_id, CASE WHEN c = 8 THEN 3 WHEN c = 4 THEN 2 ELSE 1 END AS bits, CAST(b0 AS BIGINT) AS v0, CAST(b1 AS BIGINT) AS v1, CAST(b2 AS BIGINT) AS v2 FROM zu, s)"]
    for q in (2, 1):
        low = (1 << q) - 1
        for i in range(3):
            swap = f"CASE WHEN bits <= {q} OR (v{i} >> {q}) & 1 = 1 THEN 0 ELSE xor(v0, v{i}) & {low} END"
            new = [f"xor(v0, CASE WHEN bits > {q} AND (v{i} >> {q}) & 1 = 1 THEN {low} ELSE {swap} END) AS v0", *(f"xor(v{k}, {swap}) AS v{k}" if k == i else f"v{k}" for k in (1, 2))]
            out.append(f"h{len(out)} AS (SELECT step, block_id, bits, {', '.join(new)} FROM h{len(out) - 1})")
    out.append(f"h{len(out)} AS (SELECT step, block_id, bits, v0, xor(v1, v0) AS v1, xor(v2, xor(v1, v0)) AS v2 FROM h{len(out) - 1})")
    flip = "xor(CASE WHEN bits > 2 AND (v2 >> 2) & 1 = 1 THEN 3 ELSE 0 END, CASE WHEN bits > 1 AND (v2 >> 1) & 1 = 1 THEN 1 ELSE 0 END)"
    out.append(f"h AS (SELECT step, block_id, {', '.join(f'xor(v{k}, {flip}) AS v{k}' for k in range(3))} FROM h{len(out) - 1})")
    return out


_HILBERT = " + ".join(f"((v{i} >> {q}) & 1) * {1 << (3 * q + 2 - i)}" for q in range(3) for i in range(3))


@register("hilbert_keys", _VOX, _ZU, *_hilbert_sql(), select=f"SELECT step, block_id, {_HILBERT} AS hilbert FROM h")
def hilbert_keys(spark, sf_dir):
    zones, grid = _zone(spark, sf_dir)
    return zones.select("step", "block_id", G.hilbert(*(F.col(b) for b in G.BLOCKS), G.hilbert_bits(grid.counts)).alias("hilbert"))


@register("octree_levels", _VOX, _ZU, f"k AS (SELECT *, {_MORTON} AS m FROM zu)", "l AS (SELECT unnest(range(0, CASE WHEN c = 8 THEN 4 WHEN c = 4 THEN 3 ELSE 2 END)) AS level FROM s)", select="SELECT step, CAST(level AS INTEGER) AS level, m >> (3 * level) AS morton, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n FROM k, l GROUP BY ALL")
def octree_levels(spark, sf_dir):
    return zonemap.octree(*_zone(spark, sf_dir))


@register("octree_query", _VOX, _ZU, select=f"SELECT step, {_MORTON} AS morton FROM zu WHERE lo <= {HI} AND hi >= {LO}")
def octree_query(spark, sf_dir):
    return stored_index(spark, sf_dir).octree_blocks(LO, HI)


@register("octree_descent", _VOX, _ZU, select=f"SELECT step, {_MORTON} AS morton FROM zu WHERE lo <= {HI} AND hi >= {LO}")
def octree_descent(spark, sf_dir):
    """As ``octree_query``, by joins from level to level: the way for trees of any number of roots."""
    index = stored_index(spark, sf_dir)
    tree = index._read("octree").select("step", "level", "morton", F.col("f_lo").alias("lo"), F.col("f_hi").alias("hi"))
    return query.octree_blocks(tree, index.grid, LO, HI)


@register("skipped_intervals", _VOX, _ZU, select="SELECT *, CASE WHEN lo = 0 THEN 'zero_low' WHEN row_number() OVER (PARTITION BY step, lo ORDER BY block_id) > 1 THEN 'duplicate_low' END AS skip_reason FROM zu")
def skipped_intervals(spark, sf_dir):
    return zonemap.with_skip_reason(stored_index(spark, sf_dir).zones())


@register("max_high", _VOX, _ZU, select="SELECT *, max(hi) OVER (PARTITION BY step ORDER BY lo, block_id ROWS UNBOUNDED PRECEDING) AS max_high FROM zu")
def max_high(spark, sf_dir):
    return zonemap.running_high(_zone(spark, sf_dir)[0])


@register("level_positions", _VOX, _ZU, "r AS (SELECT step, block_id, row_number() OVER (PARTITION BY step ORDER BY lo, block_id) AS rank FROM zu)", select="SELECT *, CAST(floor(log2(rank)) AS INTEGER) AS depth FROM r")
def level_positions(spark, sf_dir):
    return zonemap.level_positions(_zone(spark, sf_dir)[0])


@register("overlap_by_depth", _VOX, _ZU, "r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY lo, block_id) AS rank FROM zu)", select=f"SELECT step, CAST(floor(log2(rank)) AS INTEGER) AS depth, count(*) AS n FROM r WHERE lo <= {HI} AND hi >= {LO} GROUP BY ALL")
def overlap_by_depth(spark, sf_dir):
    zones = _zone(spark, sf_dir)[0]
    hits = zones.where(query.overlaps(LO, HI)).select("step", "block_id")
    return zonemap.level_positions(zones).join(hits, ["step", "block_id"], "left_semi").groupBy("step", "depth").agg(F.count(F.lit(1)).alias("n"))


@register("skipped_overlap", _VOX, _ZU, "k AS (SELECT *, CASE WHEN lo = 0 THEN 'zero_low' WHEN row_number() OVER (PARTITION BY step, lo ORDER BY block_id) > 1 THEN 'duplicate_low' END AS skip_reason FROM zu)", select=f"SELECT coalesce(skip_reason, 'none') AS reason, count(*) AS n FROM k WHERE lo - {ERROR} <= {HI} AND hi + {ERROR} >= {LO} GROUP BY ALL")
def skipped_overlap(spark, sf_dir):
    listed = zonemap.with_skip_reason(stored_index(spark, sf_dir).zones()).where(query.overlaps(LO, HI, ERROR))
    return listed.groupBy(F.coalesce("skip_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("ragged_core", _LINES, "z AS (SELECT step, d0 // 4 AS b0, d1 // 4 AS b1, d2 // 4 AS b2, min(f) AS lo, max(f) AS hi FROM vox GROUP BY ALL)", "t AS (SELECT step, CASE WHEN d0 < 2 THEN 0 ELSE 1 + (d0 - 2) // 4 END AS s0, CASE WHEN d1 < 2 THEN 0 ELSE 1 + (d1 - 2) // 4 END AS s1, CASE WHEN d2 < 2 THEN 0 ELSE 1 + (d2 - 2) // 4 END AS s2, min(f) AS lo, max(f) AS hi FROM vox GROUP BY ALL)",
    "u AS (SELECT DISTINCT step, b0, b1, b2 FROM z WHERE lo <= 21000 AND hi >= 20000 UNION SELECT DISTINCT t.step, x.b0, y.b1, w.b2 FROM t, (SELECT unnest(range(0, 13)) AS b0) x, (SELECT unnest(range(0, 3)) AS b1) y, (SELECT unnest(range(0, 3)) AS b2) w WHERE lo <= 21000 AND hi >= 20000 AND x.b0 IN (s0 - 1, s0) AND y.b1 IN (s1 - 1, s1) AND w.b2 IN (s2 - 1, s2) AND (s0 > 0 OR x.b0 = 0) AND (s1 > 0 OR y.b1 = 0) AND (s2 > 0 OR w.b2 = 0) AND x.b0 * 4 <= 49 AND NOT (x.b0 = s0 AND s0 * 4 > 49) AND NOT (y.b1 = s1 AND s1 * 4 > 10) AND NOT (w.b2 = s2 AND s2 * 4 > 8))",
    select="SELECT step, CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, CAST(b2 AS INTEGER) AS b2, CAST(b0 + b1 * 13 + b2 * 39 AS BIGINT) AS block_id FROM u")
def ragged_core(spark, sf_dir):
    voxels, grid = fields.line_field(spark, sf_dir)
    return query.RangeQuery(voxels, grid, 20000.0, 21000.0).core()


@register("interval_sort_by_max", _VOX, _ZU, select="SELECT step, block_id, lo, hi FROM zu ORDER BY hi")
def interval_sort_by_max(spark, sf_dir):
    return _zone(spark, sf_dir)[0].select("step", "block_id", "lo", "hi").orderBy("hi")


@register("shuffled_blocks", _VOX, _ZU, select="SELECT step, block_id FROM zu")
def shuffled_blocks(spark, sf_dir):
    return _zone(spark, sf_dir)[0].select("step", "block_id").orderBy(F.xxhash64("step", "block_id", F.lit(42)))


@register("duplicate_lows", _VOX, _ZU, select="SELECT count(*) > count(DISTINCT lo) AS duplicates FROM zu")
def duplicate_lows(spark, sf_dir):
    return analytics.has_duplicates(_zone(spark, sf_dir)[0], "lo")


@register("global_block_ids", _VOX, _ZU, select="SELECT step, block_id, step * c * c * c + block_id AS global_id, CAST((b0 * c + b1) * c + b2 AS BIGINT) AS last_fastest FROM zu, s")
def global_block_ids(spark, sf_dir):
    zones, grid = _zone(spark, sf_dir)
    return zones.select("step", "block_id", G.global_block_id(F.col("step"), F.col("block_id"), grid.counts).alias("global_id"), G.swap_axis_order(F.col("block_id"), grid.counts).alias("last_fastest"))


# blocks and points


@register("volume_to_blocks", _VOX, _ZU, select="SELECT step, CAST(b0 + b1 * c + b2 * c * c AS BIGINT) AS block_id, count(*) AS n, sum((d0 % 4 * 16 + d1 % 4 * 4 + d2 % 4 + 1) * CAST(floor(f * 100) AS BIGINT)) :: BIGINT AS checksum FROM zu_b, s GROUP BY ALL")
def volume_to_blocks(spark, sf_dir):
    b = blocks.to_blocks(*_events(spark, sf_dir))
    total = F.aggregate(F.arrays_zip("offsets", "values"), F.lit(0).cast("long"), lambda a, x: a + (x["offsets"] + 1) * F.floor(x["values"] * 100))
    return b.select("step", "block_id", F.size("values").cast("long").alias("n"), total.alias("checksum"))


@register("blocks_to_volume", _VOX, select="SELECT step, d0, d1, d2, f FROM vox")
def blocks_to_volume(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return blocks.from_blocks(blocks.to_blocks(voxels, grid), grid)


_POINTS = "points AS (SELECT o_orderkey, o_orderkey % 3 AS step, CAST(o_orderkey % 37 % s AS INTEGER) AS d0, CAST(o_orderkey % 41 % s AS INTEGER) AS d1, CAST(o_orderkey % 43 % s AS INTEGER) AS d2 FROM orders, s)"


@register("point_lookup", _VOX, _POINTS, select="SELECT p.*, vox.f AS value FROM points p LEFT JOIN vox USING (step, d0, d1, d2)")
def point_lookup(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    key, side = F.col("o_orderkey"), grid.shape[0]
    points = fields.table(spark, sf_dir, "orders").select("o_orderkey", (key % 3).alias("step"), *((key % m % side).cast("int").alias(d) for m, d in zip((37, 41, 43), G.DIMS)))
    return blocks.point_values(points, blocks.to_blocks(voxels, grid), grid)


_OUTSIDE = "points AS (SELECT o_orderkey, o_orderkey % 3 AS step, CAST(o_orderkey % 37 % (s + 4) - 2 AS INTEGER) AS d0, CAST(o_orderkey % 41 % (s + 4) - 2 AS INTEGER) AS d1, CAST(o_orderkey % 43 % (s + 4) - 2 AS INTEGER) AS d2 FROM orders, s)"
_CLAMP = "greatest(0, least(p.d{i}, s - 1))"


def _outside(spark, sf_dir, grid):
    key, side = F.col("o_orderkey"), grid.shape[0]
    return fields.table(spark, sf_dir, "orders").select("o_orderkey", (key % 3).alias("step"), *((key % m % (side + 4) - 2).cast("int").alias(d) for m, d in zip((37, 41, 43), G.DIMS)))


@register("point_lookup_clamped", _VOX, _OUTSIDE, select=f"SELECT p.*, vox.f AS value FROM points p CROSS JOIN s LEFT JOIN vox ON vox.step = p.step AND {' AND '.join(f'vox.d{i} = {_CLAMP.format(i=i)}' for i in range(3))}")
def point_lookup_clamped(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return blocks.clamped_values(_outside(spark, sf_dir, grid), blocks.to_blocks(voxels, grid), grid)


def _beyond(i: int) -> str:
    """What a coordinate outside adds along its dimension."""
    c, sign = _CLAMP.format(i=i), f"sign(p.d{i} - {_CLAMP.format(i=i)})"
    on = " AND ".join(f"w.d{k} = {_CLAMP.format(i=k)}" + (f" - {sign}" if k == i else "") for k in range(3))
    return f"CASE WHEN p.d{i} = {c} THEN 0.0 ELSE abs(p.d{i} - {c}) * (v.f - (SELECT w.f FROM vox w WHERE w.step = p.step AND {on})) END"


@register("point_lookup_extrapolated", _VOX, _OUTSIDE, select=f"SELECT p.*, round(v.f + {' + '.join(map(_beyond, range(3)))}, 6) AS value FROM points p CROSS JOIN s LEFT JOIN vox v ON v.step = p.step AND {' AND '.join(f'v.d{i} = {_CLAMP.format(i=i)}' for i in range(3))}")
def point_lookup_extrapolated(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    return blocks.extrapolated_values(_outside(spark, sf_dir, grid), blocks.to_blocks(voxels, grid), grid).withColumn("value", F.round("value", 6))


@register("positions_first_fastest", _VOX, select="SELECT event_id, CAST(event_id % (s * s * s) % s AS INTEGER) AS d0, CAST(event_id % (s * s * s) // s % s AS INTEGER) AS d1, CAST(event_id % (s * s * s) // (s * s) AS INTEGER) AS d2 FROM events, s")
def positions_first_fastest(spark, sf_dir):
    _, grid = _events(spark, sf_dir)
    return fields.table(spark, sf_dir, "events").select("event_id", *G.coordinates_first_fastest(F.col("event_id") % grid.volume, grid.shape))


def _kept(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("stored_steps", _VOX, select="SELECT step, d0, d1, d2, f FROM vox WHERE step BETWEEN 1 AND 2")
def stored_steps(spark, sf_dir):
    """A field stored by step, of which some steps are read."""
    voxels, grid = _events(spark, sf_dir)
    sinks.write_field(G.with_blocks(voxels, grid), path := _kept(spark, "field"))
    return raw.read_steps(spark, path, begin=1, end=2).select(F.col("step").cast("long").alias("step"), *G.DIMS, "f")


@register("intervals_text", _VOX, _ZU, select="SELECT lo AS low, hi AS high FROM zu")
def intervals_text(spark, sf_dir):
    sinks.write_intervals(_zone(spark, sf_dir)[0], path := _kept(spark, "intervals"))
    return raw.read_intervals(spark, path)


@register("numbers_text", _VOX, select="SELECT f AS value FROM vox")
def numbers_text(spark, sf_dir):
    sinks.write_numbers(_events(spark, sf_dir)[0], path := _kept(spark, "numbers"))
    return raw.read_numbers(spark, path)


@register("empty_index", _VOX, _ZU, select="SELECT step, block_id FROM zu WHERE false")
def empty_index(spark, sf_dir):
    """A query of a field without voxels finds nothing."""
    voxels, grid = _events(spark, sf_dir)
    return query.RangeQuery(voxels.where("f < -1e300"), grid, LO, HI).core().select("step", "block_id")


@register("block_range_filter", _VOX, _ZU, select=f"SELECT step, CAST(b0 + b1 * c + b2 * c * c AS BIGINT) AS block_id, count(*) AS n, min(f) AS lo, max(f) AS hi FROM zu_b, s WHERE f BETWEEN {LO} AND {HI} GROUP BY ALL")
def block_range_filter(spark, sf_dir):
    kept = blocks.range_filtered(blocks.to_blocks(*_events(spark, sf_dir)), LO, HI)
    return kept.select("step", "block_id", F.size("values").cast("long").alias("n"), F.array_min("values").alias("lo"), F.array_max("values").alias("hi"))


@register("log10_blocks", select="SELECT vec_id AS block_id, list_max(list_transform(embedding, lambda v: round(log10(greatest(CAST(v AS DOUBLE), 1e-6)), 6))) AS most, list_min(list_transform(embedding, lambda v: round(log10(greatest(CAST(v AS DOUBLE), 1e-6)), 6))) AS least FROM embeddings")
def log10_blocks(spark, sf_dir):
    logs = fields.embedding_blocks(spark, sf_dir).select("block_id", F.transform(blocks.log10_floored(F.col("values")), lambda v: F.round(v, 6)).alias("v"))
    return logs.select("block_id", F.array_max("v").alias("most"), F.array_min("v").alias("least"))


_OFFSETS = ", ".join(f"(SELECT unnest([-1, 0, 1]) AS o{i}) t{i}" for i in range(3))


@register("gauss_smooth", _VOX, f"w AS (SELECT o0, o1, o2, exp(-(o0 * o0 + o1 * o1 + o2 * o2) / 2.0) AS w FROM {_OFFSETS})", select="SELECT a.step, a.d0, a.d1, a.d2, round(sum(b.f * w) / sum(w), 6) AS smooth FROM vox a, w JOIN vox b ON b.step = a.step AND b.d0 = a.d0 + o0 AND b.d1 = a.d1 + o1 AND b.d2 = a.d2 + o2 GROUP BY ALL")
def gauss_smooth(spark, sf_dir):
    return blocks.smoothed(_events(spark, sf_dir)[0]).withColumn("smooth", F.round("smooth", 6))


def _gradient(i: int) -> str:
    line = f"(PARTITION BY step, {', '.join(f'd{k}' for k in range(3) if k != i)} ORDER BY d{i})"
    lag, lead = f"lag(f) OVER {line}", f"lead(f) OVER {line}"
    return f"CASE WHEN {lag} IS NOT NULL AND {lead} IS NOT NULL THEN ({lag} - {lead}) / 2 WHEN {lag} IS NOT NULL THEN {lag} - f WHEN {lead} IS NOT NULL THEN f - {lead} ELSE 0.0 END AS g{i}"


@register("gradients", _VOX, select=f"SELECT step, d0, d1, d2, {', '.join(map(_gradient, range(3)))} FROM vox")
def gradients(spark, sf_dir):
    return blocks.gradients(_events(spark, sf_dir)[0])


# codes


def _code_sql(x: str, p: str, bound: str) -> str:
    state = f"floor((floor(abs({x} - {p}) / {bound}) + 1) / 2)"
    return f"CAST(CASE WHEN {bound} > 0 AND abs({x} - {p}) < {codec.REACH} * {bound} THEN {codec.MIDDLE} + CASE WHEN {x} - {p} < 0 THEN -{state} ELSE {state} END ELSE 0 END AS INTEGER)"


_AGAINST_LOW = f"q AS (SELECT v.step, v.d0, v.d1, v.d2, f, lo, {_code_sql('f', 'lo', '0.05')} AS code FROM vox v JOIN zu ON v.step = zu.step AND v.d0 // 4 = b0 AND v.d1 // 4 = b1 AND v.d2 // 4 = b2)"


def _against_low(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    zones = zonemap.zone_map(voxels, grid).select("step", "block_id", "lo")
    return G.with_blocks(voxels, grid).join(zones, ["step", "block_id"]).withColumn("code", codec.code(F.col("f"), F.col("lo"), 0.05))


@register("quantize_independent", _VOX, _ZU, _AGAINST_LOW, select="SELECT step, d0, d1, d2, code FROM q")
def quantize_independent(spark, sf_dir):
    return _against_low(spark, sf_dir).select("step", *G.DIMS, "code")


@register("dequantize_independent", _VOX, _ZU, _AGAINST_LOW, select=f"SELECT step, d0, d1, d2, CASE WHEN code = 0 THEN f ELSE lo + CAST(0.1 AS DOUBLE) * (code - {codec.MIDDLE}) END AS value FROM q")
def dequantize_independent(spark, sf_dir):
    q = _against_low(spark, sf_dir)
    return q.select("step", *G.DIMS, codec.decoded(F.col("code"), F.col("lo"), 0.05, F.col("f")).alias("value"))


def _restored(spark, sf_dir):
    q = _against_low(spark, sf_dir)
    return q.select(F.col("f").alias("a"), codec.decoded(F.col("code"), F.col("lo"), 0.05, F.col("f")).alias("b"))


_RESTORED = f"r AS (SELECT f AS a, CASE WHEN code = 0 THEN f ELSE lo + CAST(0.1 AS DOUBLE) * (code - {codec.MIDDLE}) END AS b FROM q)"


@register("quality", _VOX, _ZU, _AGAINST_LOW, _RESTORED, select="SELECT round(avg((a - b) * (a - b)), 9) AS mse, round(10 * log10(max(a) * max(a) / avg((a - b) * (a - b))), 6) AS psnr, max(abs(a - b)) AS max_error FROM r")
def quality(spark, sf_dir):
    return analytics.quality(_restored(spark, sf_dir)).select(F.round("mse", 9).alias("mse"), F.round("psnr", 6).alias("psnr"), "max_error")


@register("within_bound", _VOX, _ZU, _AGAINST_LOW, _RESTORED, select="SELECT bool_and(abs(a - b) <= 0.0500001) AS within FROM r")
def within_bound(spark, sf_dir):
    return analytics.within_bound(_restored(spark, sf_dir), 0.0500001)


def _chain(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    rows = voxels.select("step", G.position(grid.shape).alias("p"), "f")
    return rows, codec.quantize_chain(rows, ["step"], "p", "f", 0.05)


_LINE = "line AS (SELECT step, ((CAST(d0 AS BIGINT) * s + d1) * s + d2) // 4096 AS segment, CAST(((CAST(d0 AS BIGINT) * s + d1) * s + d2) % 4096 AS INTEGER) AS place, f FROM vox, s)"
_STATE = "floor((floor(abs(l.f - r.last) / CAST(0.05 AS DOUBLE)) + 1) / 2)"
_NEAR = f"abs(l.f - r.last) < {codec.REACH} * CAST(0.05 AS DOUBLE)"
_SIGNED = f"CASE WHEN l.f - r.last < 0 THEN -{_STATE} ELSE {_STATE} END"
_FOLD = f"r AS (SELECT step, segment, place, 0 AS code, f AS last FROM line WHERE place = 0 UNION ALL SELECT l.step, l.segment, l.place, CAST(CASE WHEN {_NEAR} THEN {codec.MIDDLE} + {_SIGNED} ELSE 0 END AS INTEGER), CASE WHEN {_NEAR} THEN r.last + CAST(0.1 AS DOUBLE) * ({_SIGNED}) ELSE l.f END FROM r JOIN line l ON l.step = r.step AND l.segment = r.segment AND l.place = r.place + 1)"


@register("quantize_chain", _VOX, _LINE, _FOLD, select="SELECT step, segment, place, code, CASE WHEN code = 0 THEN last END AS outlier FROM r", recursive=True)
def quantize_chain(spark, sf_dir):
    return _chain(spark, sf_dir)[1]


@register("chain_round_trip", _VOX, select="SELECT step, count(*) AS n, true AS within FROM vox GROUP BY step")
def chain_round_trip(spark, sf_dir):
    rows, codes = _chain(spark, sf_dir)
    back = codec.dequantize_chain(codes, ["step"], 0.05).select("step", (F.col("segment") * codec.SEGMENT + F.col("place")).alias("p"), "value")
    return rows.join(back, ["step", "p"], "left").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.abs(F.col("f") - F.col("value")) <= 0.0500001), F.lit(False)).alias("within"))


_STATS = "st AS (SELECT min(lo) AS l0, max(lo) + 1e-6 AS l1, min(hi) AS h0, max(hi) + 1e-6 AS h1 FROM zu)"
_BINNED = f"b AS (SELECT zu.*, st.*, CAST(greatest(0, least(floor((lo - l0) / (l1 - l0) * {BINS}), {BINS - 1})) AS INTEGER) AS low_bin, CAST(greatest(0, least(floor((hi - h0) / (h1 - h0) * {BINS}), {BINS - 1})) AS INTEGER) AS high_bin FROM zu, st)"
_EXPECTED = "e AS (SELECT low_bin, CAST(floor(avg(high_bin)) AS INTEGER) AS expected_bin FROM b GROUP BY low_bin)"
_PREDICTED = f"p AS (SELECT b.*, h0 + (expected_bin + 0.5) * ((h1 - h0) / {BINS}) AS predicted FROM b JOIN e USING (low_bin))"
_CODED = f"k AS (SELECT *, {_code_sql('hi', 'predicted', '0.5')} AS code FROM p)"


@register("bin_counts", _VOX, _ZU, _STATS, _BINNED, select="SELECT low_bin, high_bin, count(*) AS n FROM b GROUP BY low_bin, high_bin")
def bin_counts(spark, sf_dir):
    return codec.bin_counts(codec.low_high_bins(_zone(spark, sf_dir)[0], BINS))


@register("expected_high", _VOX, _ZU, _STATS, _BINNED, _EXPECTED, select="SELECT * FROM e")
def expected_high(spark, sf_dir):
    return codec.expected_high(codec.low_high_bins(_zone(spark, sf_dir)[0], BINS))


@register("index_compress", _VOX, _ZU, _STATS, _BINNED, _EXPECTED, _PREDICTED, _CODED, select=f"SELECT step, block_id, code, CASE WHEN code = 0 THEN hi END AS outlier, round(CASE WHEN code = 0 THEN hi ELSE predicted + 2 * 0.5 * (code - {codec.MIDDLE}) END, 9) AS restored FROM k")
def index_compress(spark, sf_dir):
    return codec.compress_highs(_zone(spark, sf_dir)[0], 0.5, BINS).withColumn("restored", F.round("restored", 9))


@register("index_code_entropy", _VOX, _ZU, _STATS, _BINNED, _EXPECTED, _PREDICTED, _CODED, "n AS (SELECT code, count(*) AS n, sum(count(*)) OVER () AS total FROM k GROUP BY code)", select="SELECT CAST(max(total) AS BIGINT) AS codes, count(*) AS symbols, round(sum(-n * log2(n / total)), 4) AS bits FROM n")
def index_code_entropy(spark, sf_dir):
    return codec.entropy_bits(codec.compress_highs(_zone(spark, sf_dir)[0], 0.5, BINS))


@register("uniform_quantize", _VOX, select="SELECT step, d0, d1, d2, CAST(floor(f / CAST(0.1 AS DOUBLE) + 0.5) AS BIGINT) AS code FROM vox")
def uniform_quantize(spark, sf_dir):
    return _events(spark, sf_dir)[0].select("step", *G.DIMS, codec.uniform_code(F.col("f"), 0.05).alias("code"))


@register("stagger_prediction_slice", _VOX, _ZU, _ZS, select="SELECT zs.step, zs.block_id, round(any_value(zs.hi) - avg(zu.hi), 9) AS diff FROM s, zs LEFT JOIN zu ON zu.step = zs.step AND zu.b0 BETWEEN zs.b0 - 1 AND zs.b0 AND zu.b1 BETWEEN zs.b1 - 1 AND zs.b1 AND zu.b2 BETWEEN zs.b2 - 1 AND zs.b2 WHERE zs.b1 = c // 2 GROUP BY zs.step, zs.block_id")
def stagger_prediction_slice(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    shifted = zonemap.zone_map(voxels, grid, "stagger").where(F.col("b1") == grid.counts[1] // 2)
    out = codec.stagger_prediction(shifted, zonemap.zone_map(voxels, grid), G.related_uniform(shifted, grid))
    return out.select("step", "block_id", F.round(F.col("hi") - F.col("predicted"), 9).alias("diff"))


@register("index_huffman")
def index_huffman(spark, sf_dir):
    return codec.huffman_bits(codec.compress_highs(_zone(spark, sf_dir)[0], 0.5, BINS))


@register("stagger_predict", _VOX, _ZU, _ZS, select="SELECT zs.step, zs.block_id, any_value(zs.hi) AS hi, round(avg(zu.hi), 9) AS predicted FROM zs LEFT JOIN zu ON zu.step = zs.step AND zu.b0 BETWEEN zs.b0 - 1 AND zs.b0 AND zu.b1 BETWEEN zs.b1 - 1 AND zs.b1 AND zu.b2 BETWEEN zs.b2 - 1 AND zs.b2 GROUP BY zs.step, zs.block_id")
def stagger_predict(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    shifted = zonemap.zone_map(voxels, grid, "stagger")
    out = codec.stagger_prediction(shifted, zonemap.zone_map(voxels, grid), G.related_uniform(shifted, grid))
    return out.withColumn("predicted", F.round("predicted", 9))


@register("block_codec_round_trip", select="SELECT vec_id AS block_id, CAST(len(embedding) AS BIGINT) AS n, true AS within FROM embeddings")
def block_codec_round_trip(spark, sf_dir):
    original = fields.embedding_blocks(spark, sf_dir)
    back = codec.decompress_blocks(codec.compress_blocks(original, 1e-3), 1e-3).select("block_id", F.col("values").alias("back"))
    joined = original.join(back, "block_id", "left")
    worst = F.array_max(F.transform(F.arrays_zip("values", "back"), lambda x: F.abs(x["values"] - x["back"])))
    return joined.select("block_id", F.size("back").cast("long").alias("n"), (worst <= 1.000001e-3).alias("within"))


_BLOCK_LINE = "e AS (SELECT vec_id, embedding FROM embeddings)"
_BLOCK_FOLD = f"""r AS (SELECT vec_id, 0 AS i, CAST(0 AS DOUBLE) AS last, CAST(0 AS BIGINT) AS size FROM e UNION ALL
        SELECT vec_id, i + 1, CASE WHEN state < {codec.BLOCK_RADIUS - 1} THEN last + CAST(0.002 AS DOUBLE) * CASE WHEN x < last THEN -state ELSE state END ELSE x END, CASE WHEN state < {codec.BLOCK_RADIUS - 1} THEN CAST(state AS BIGINT) + 1 ELSE 0 END
        FROM (SELECT vec_id, i, last, CAST(embedding[i + 1] AS DOUBLE) AS x, floor((floor(abs(CAST(embedding[i + 1] AS DOUBLE) - last) / CAST(0.001 AS DOUBLE)) + 1) / 2) AS state FROM r JOIN e USING (vec_id) WHERE i < len(embedding)))"""
_BLOCK_SIZES = "b AS (SELECT vec_id, CASE WHEN max(size) = 0 THEN 0 ELSE CAST(floor(log2(max(size))) AS INTEGER) + 1 END AS bits, count(*) AS n, count(*) FILTER (size = 0) AS kept FROM r WHERE i > 0 GROUP BY vec_id)"


@register("block_codec_sizes", _BLOCK_LINE, _BLOCK_FOLD, _BLOCK_SIZES, select="SELECT CAST(bits AS INTEGER) AS bits, count(*) AS blocks, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(bits * n + n + 64 * kept) AS BIGINT) AS total_bits FROM b GROUP BY bits", recursive=True)
def block_codec_sizes(spark, sf_dir):
    coded = codec.compress_blocks(fields.embedding_blocks(spark, sf_dir), 1e-3)
    return coded.groupBy("bits").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("kept")).alias("kept"), F.sum(F.col("bits") * F.size("sizes") + F.size("sizes") + 64 * F.size("kept")).alias("total_bits"))


@register("id_bit_sizes", _VOX, _ZU, select="SELECT step, count(*) AS blocks, CAST(greatest(1, ceil(log2(max(block_id) + 1))) AS INTEGER) AS width, CAST(count(*) * greatest(1, ceil(log2(max(block_id) + 1))) AS BIGINT) AS bits FROM zu GROUP BY step")
def id_bit_sizes(spark, sf_dir):
    out = _zone(spark, sf_dir)[0].groupBy("step").agg(F.count(F.lit(1)).alias("blocks"), codec.bit_width(F.max("block_id")).alias("width"))
    return out.withColumn("bits", F.col("blocks") * F.col("width"))


def _index_round_trip(name: str, order: str, highs: str) -> None:
    @register(name, _VOX, _ZU, select="SELECT step, count(*) AS blocks, true AS within FROM zu GROUP BY step")
    def round_trip(spark, sf_dir):
        zones, grid = _zone(spark, sf_dir)
        return _within(zones, indexcodec.decompress_index(indexcodec.compress_index(zones, 0.5, order, highs, grid, BINS), BINS))


def _within(zones: DataFrame, restored: DataFrame) -> DataFrame:
    """(step, blocks, within): whether both ends of all intervals are restored within the bound."""
    back = restored.select("step", "block_id", F.col("lo").alias("l"), F.col("hi").alias("h"))
    near = (F.abs(F.col("lo") - F.col("l")) <= 0.5000001) & (F.abs(F.col("hi") - F.col("h")) <= 0.5000001)
    return zones.join(back, ["step", "block_id"], "left").groupBy("step").agg(F.count(F.lit(1)).alias("blocks"), F.bool_and(F.coalesce(near, F.lit(False))).alias("within"))


for _name, _order, _highs in (("index_level_bins", "level", "bins"), ("index_level_chain", "level", "chain"), ("index_rows_bins", "rows", "bins"), ("index_hilbert_chain", "hilbert", "chain")):
    _index_round_trip(_name, _order, _highs)


@register("index_shifted", _VOX, _ZS, select="SELECT step, count(*) AS blocks, true AS within FROM zs GROUP BY step")
def index_shifted(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    zones, shifted = zonemap.zone_map(voxels, grid), stored(zonemap.zone_map(voxels, grid, "stagger"), "shifted")
    restored = indexcodec.decompress_index(indexcodec.compress_index(zones, 0.5, "hilbert", "chain", grid))
    restored = stored(restored.select("step", *G.block_coordinates(F.col("block_id"), grid.counts), "lo", "hi"), "restored")
    return _within(shifted, indexcodec.decompress_shifted(indexcodec.compress_shifted(shifted, restored, grid, 0.5), restored, grid, 0.5))


@register("index_restored_query", _VOX, _ZU, select=f"SELECT step, block_id FROM zu WHERE lo <= {HI} AND hi >= {LO}")
def index_restored_query(spark, sf_dir):
    """Blocks by the coded index, widened by its bound, of which the true ones are told by the stored index."""
    zones, grid = _zone(spark, sf_dir)
    restored = indexcodec.decompress_index(indexcodec.compress_index(zones, 0.5, "level", "bins", grid, BINS), BINS)
    near = restored.where(query.overlaps(LO, HI, 0.5000001)).select("step", "block_id")
    return stored_index(spark, sf_dir).zones().where(query.overlaps(LO, HI)).join(near, ["step", "block_id"], "left_semi").select("step", "block_id")


@register("coded_block_fetch", select="SELECT vec_id AS block_id, CAST(len(embedding) AS BIGINT) AS n, true AS within FROM embeddings WHERE list_max(embedding) >= 0.35")
def coded_block_fetch(spark, sf_dir):
    """Blocks are coded and stored beside their range; those that meet the query's are read and decoded."""
    original = fields.embedding_blocks(spark, sf_dir)
    coded = codec.compress_blocks(original, 1e-3).join(original.select("block_id", F.array_max("values").alias("hi")), "block_id")
    kept = stored(coded.orderBy("hi"), "coded").where("hi >= cast(0.35 as float)")
    back = codec.decompress_blocks(kept, 1e-3).select("block_id", F.col("values").alias("back"))
    worst = F.array_max(F.transform(F.arrays_zip("values", "back"), lambda x: F.abs(x["values"] - x["back"])))
    return original.join(back, "block_id").select("block_id", F.size("back").cast("long").alias("n"), (worst <= 1.000001e-3).alias("within"))


@register("index_size", _VOX, _ZU, _ZS, select="SELECT v.data_bytes, z.index_bytes, z.index_bytes / v.data_bytes AS ratio FROM (SELECT count(*) * 8 AS data_bytes FROM vox) v, (SELECT count(*) * 24 AS index_bytes FROM (SELECT lo FROM zu UNION ALL SELECT lo FROM zs)) z")
def index_size(spark, sf_dir):
    dual = zonemap.dual_zone_map(*_events(spark, sf_dir))
    out = dual.agg((F.sum(F.when(F.col("tiling") == "uniform", F.col("n"))) * 8).alias("data_bytes"), (F.count(F.lit(1)) * 24).alias("index_bytes"))
    return out.withColumn("ratio", F.col("index_bytes") / F.col("data_bytes"))


# statistics


@register("top_thresholds", _VOX, "r AS (SELECT f, row_number() OVER (ORDER BY f DESC) - 1 AS k, count(*) OVER () AS n FROM vox)", "p AS (SELECT unnest([1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 5e-2, 1e-1])::DOUBLE AS share)", select="SELECT share, k AS rank, f AS threshold FROM r JOIN p ON k = least(CAST(floor(share * n) AS BIGINT), n - 1)")
def top_thresholds(spark, sf_dir):
    return analytics.top_thresholds(_events(spark, sf_dir)[0])


@register("pearson_minmax", _VOX, _ZU, select="SELECT round(covar_pop(lo, hi) / sqrt(var_pop(lo) * var_pop(hi) + 1e-10), 9) AS r FROM zu")
def pearson_minmax(spark, sf_dir):
    return analytics.pearson(_zone(spark, sf_dir)[0]).select(F.round("r", 9).alias("r"))


@register("selectivity_curve", _VOX, _ZU, f"x AS (SELECT CAST(i - 1 AS INTEGER) AS i, l + (h - l) * i / {ISOVALUES + 1} AS isovalue FROM (SELECT unnest(range(1, {ISOVALUES + 1})) AS i), (SELECT min(lo) AS l, max(hi) AS h FROM zu))", select="SELECT i, isovalue, count(zu.lo) AS blocks FROM x LEFT JOIN zu ON lo <= isovalue AND hi >= isovalue GROUP BY i, isovalue")
def selectivity_curve(spark, sf_dir):
    zones = _zone(spark, sf_dir)[0]
    ends = zones.agg(F.min("lo"), F.max("hi")).first()
    return analytics.selectivity(zones, analytics.isovalues(ends[0], ends[1], ISOVALUES))


_LOG = "v AS (SELECT (SELECT max(hi) FROM zu) * pow(10, -6 * (((i + 42) * 1103515245 + 12345) % 2147483648) / CAST(2147483648 AS DOUBLE)) * CASE WHEN i < 500 THEN 1 ELSE -1 END AS isovalue FROM (SELECT unnest(range(0, 1000)) AS i))"
_NUMBERED = "x AS (SELECT CAST(row_number() OVER (ORDER BY isovalue) - 1 AS INTEGER) AS i, isovalue FROM v)"


@register("selectivity_log", _VOX, _ZU, _LOG, _NUMBERED, "m AS (SELECT i, step, b0, b1, b2 FROM x JOIN zu ON lo <= isovalue AND hi >= isovalue)",
    "w AS (SELECT DISTINCT i, step, b0 + p AS b0, b1 + q AS b1, b2 + r AS b2 FROM m, s, (SELECT unnest([-1, 0, 1]) AS p) a, (SELECT unnest([-1, 0, 1]) AS q) b, (SELECT unnest([-1, 0, 1]) AS r) e WHERE b0 + p BETWEEN 0 AND c - 1 AND b1 + q BETWEEN 0 AND c - 1 AND b2 + r BETWEEN 0 AND c - 1)",
    select="SELECT x.i, coalesce(k.n, 0) AS blocks, coalesce(j.n, 0) AS expanded FROM x LEFT JOIN (SELECT i, count(*) AS n FROM m GROUP BY i) k USING (i) LEFT JOIN (SELECT i, count(*) AS n FROM w GROUP BY i) j USING (i)")
def selectivity_log(spark, sf_dir):
    zones, grid = _zone(spark, sf_dir)
    largest = zones.agg(F.max("hi")).first()[0]
    return analytics.expanded_selectivity(zones, grid, analytics.spread_isovalues(largest, 500)).select("i", "blocks", "expanded")


# scatterplots


def _csp(f_range, g_range, resolution) -> str:
    mean = {x: f"({' + '.join(f'{x}{k}' for k in range(8))}) / 8" for x in "fg"}
    grads = ", ".join(f"({' + '.join(f'({x}{b} - {x}{a})' for a, b in analytics.EDGES[i])}) / 4 AS {x}_{i}" for x in "fg" for i in range(3))
    meets = " AND ".join(f"least({', '.join(f'{x}{k}' for k in range(8))}) <= {hi} AND greatest({', '.join(f'{x}{k}' for k in range(8))}) >= {lo}" for x, (lo, hi) in (("f", f_range), ("g", g_range)))
    cross = " + ".join(f"pow(f_{a} * g_{b} - f_{b} * g_{a}, 2)" for a, b in ((1, 2), (2, 0), (0, 1)))
    place = lambda x, lo, hi: f"CAST(least(floor((greatest({lo}, least(m{x}, {hi})) - {lo}) / (({hi} - {lo}) / CAST({resolution} AS DOUBLE))), {resolution - 1}) AS INTEGER)"
    return f"SELECT {place('f', *f_range)} AS bin_f, {place('g', *g_range)} AS bin_g, round(sum(1 / size), 6) AS density FROM (SELECT *, sqrt({cross}) AS size FROM (SELECT {mean['f']} AS mf, {mean['g']} AS mg, {grads} FROM cells WHERE {meets})) WHERE size >= 1e-12 GROUP BY ALL"


@register("csp_raw", _VOX, _corner_join("fg"), select=_csp(F_RANGE, G_RANGE, RESOLUTION))
def csp_raw(spark, sf_dir):
    return analytics.scatterplot(_events(spark, sf_dir)[0], F_RANGE, G_RANGE, RESOLUTION).withColumn("density", F.round("density", 6))


@register("csp_indexed", _VOX, _corner_join("fg"), select=_csp(F_RANGE, G_RANGE, RESOLUTION))
def csp_indexed(spark, sf_dir):
    return stored_index(spark, sf_dir).scatterplot(F_RANGE, G_RANGE, RESOLUTION).withColumn("density", F.round("density", 6))


@register("csp_semi_join", _VOX, _corner_join("fg"), select=_csp(F_RANGE, G_RANGE, RESOLUTION))
def csp_semi_join(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    core = query.both(query.RangeQuery(voxels, grid, *F_RANGE), query.RangeQuery(voxels, grid, *G_RANGE, value="g"))
    needed = blocks.expand_neighbours(core, grid).select("step", "block_id")
    near = G.with_blocks(voxels, grid).join(needed, ["step", "block_id"], "left_semi").select(*voxels.columns)
    return analytics.scatterplot(near, F_RANGE, G_RANGE, RESOLUTION).withColumn("density", F.round("density", 6))


_PIXELS = 32
_FACES = ", ".join(f"({t}, CAST({1 if t < 4 else 2} AS DOUBLE) / 6, {', '.join(str(tet[i] + 1) for i in range(4) if i != skip)})" for t, tet in enumerate(analytics.TETRAHEDRA) for skip in range(4))
_SCALED = ", ".join(f"[{', '.join(f'({x}{k} - {x}_lo) / ({x}_hi - {x}_lo) * {_PIXELS}' for k in range(8))}] AS {x}s" for x in "fg")
_CROSS = lambda j, k: f"((x{k} - x{j}) * (py + 0.5 :: DOUBLE - y{j}) - (y{k} - y{j}) * (px + 0.5 :: DOUBLE - x{j})) * sign(area) >= 0"


@register(
    "csp_tetrahedra", _VOX, _corner_join("fg"), "ends AS (SELECT min(f) AS f_lo, max(f) AS f_hi, min(g) AS g_lo, max(g) AS g_hi FROM vox)",
    f"scaled AS (SELECT row_number() OVER () AS cell, {_SCALED} FROM cells, ends)",
    f"faces(tet, share, a, b, c) AS (VALUES {_FACES})",
    "parts AS (SELECT cell, tet, share, fs[a] AS x0, fs[b] AS x1, fs[c] AS x2, gs[a] AS y0, gs[b] AS y1, gs[c] AS y2 FROM scaled, faces)",
    "sized AS (SELECT *, ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS area FROM parts)",
    "dense AS (SELECT *, share / greatest(sum(abs(area)) OVER (PARTITION BY cell, tet), 1e-12) AS density FROM sized)",
    f"columns AS (SELECT *, unnest(range(CAST(greatest(0, ceil(least(x0, x1, x2) - 0.5 :: DOUBLE)) AS BIGINT), CAST(least({_PIXELS - 1}, floor(greatest(x0, x1, x2) - 0.5 :: DOUBLE)) AS BIGINT) + 1)) AS px FROM dense WHERE abs(area) > 1e-12)",
    f"pixels AS (SELECT *, unnest(range(CAST(greatest(0, ceil(least(y0, y1, y2) - 0.5 :: DOUBLE)) AS BIGINT), CAST(least({_PIXELS - 1}, floor(greatest(y0, y1, y2) - 0.5 :: DOUBLE)) AS BIGINT) + 1)) AS py FROM columns)",
    select=f"SELECT CAST(px AS INTEGER) AS bin_f, CAST(py AS INTEGER) AS bin_g, round(sum(density), 6) AS density FROM pixels WHERE {_CROSS(0, 1)} AND {_CROSS(1, 2)} AND {_CROSS(2, 0)} GROUP BY px, py",
)
def csp_tetrahedra(spark, sf_dir):
    voxels = _events(spark, sf_dir)[0]
    f0, f1, g0, g1 = voxels.agg(F.min("f"), F.max("f"), F.min("g"), F.max("g")).first()
    return analytics.scatterplot_by_tetrahedra(voxels, (f0, f1), (g0, g1), _PIXELS).withColumn("density", F.round("density", 6))


# surfaces


@register("mc_case_histogram", _VOX, _corner_join(), select=f"SELECT step, CAST({_CASE} AS INTEGER) AS case_id, count(*) AS n FROM cells GROUP BY ALL")
def mc_case_histogram(spark, sf_dir):
    return mesh.case_histogram(_events(spark, sf_dir)[0], ISO)


def _vertex(i: int) -> str:
    x = ", ".join(f"v1.d{k} + {'(%s - v1.f) / (v2.f - v1.f)' % ISO if k == i else '0.0'} AS x{k}" for k in range(3))
    on = " AND ".join(f"v2.d{k} = v1.d{k} + {int(k == i)}" for k in range(3))
    return f"SELECT v1.step, v1.d0, v1.d1, v1.d2, CAST({i} AS INTEGER) AS axis, {x} FROM vox v1 JOIN vox v2 ON v1.step = v2.step AND {on} WHERE (v1.f >= {ISO}) <> (v2.f >= {ISO})"


@register("mc_edge_vertices", _VOX, select=" UNION ALL ".join(map(_vertex, range(3))))
def mc_edge_vertices(spark, sf_dir):
    return mesh.edge_vertices(_events(spark, sf_dir)[0], ISO)


_ACTIVE = f"active AS (SELECT step, d0, d1, d2, {_CASE} AS case_id FROM cells)"
_TABLE = "tri(case_id, k, " + ", ".join(f"{v}{i}" for v in "abc" for i in range(4)) + ") AS (VALUES " + ", ".join(f"({case}, {k}, {', '.join(str(x) for e in edges for x in e)})" for case, k, edges in mesh.triangle_table()) + ")"
_NAMES = ", ".join(f"concat_ws(',', d0 + {v}0, d1 + {v}1, d2 + {v}2, {v}3) AS {v}" for v in "abc")
_MESH = f"mesh AS (SELECT step, d0, d1, d2, CAST(k AS INTEGER) AS k, {_NAMES} FROM active JOIN tri USING (case_id))"


@register("mc_mesh_stats", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT step, a.n AS cells, t.n AS triangles, u.n AS vertices FROM (SELECT step, count(*) AS n FROM active WHERE case_id NOT IN (0, 255) GROUP BY step) a JOIN (SELECT step, count(*) AS n FROM mesh GROUP BY step) t USING (step) JOIN (SELECT step, count(*) AS n FROM (" + " UNION ALL ".join(map(_vertex, range(3))) + ") GROUP BY step) u USING (step)")
def mc_mesh_stats(spark, sf_dir):
    return mesh.mesh_stats(_events(spark, sf_dir)[0], ISO)


@register("mc_triangles", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT * FROM mesh")
def mc_triangles(spark, sf_dir):
    return mesh.triangles(_events(spark, sf_dir)[0], ISO)


@register("mc_triangles_indexed", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT * FROM mesh")
def mc_triangles_indexed(spark, sf_dir):
    return stored_index(spark, sf_dir).triangles(ISO)


@register("mc_triangles_semi_join", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT * FROM mesh")
def mc_triangles_semi_join(spark, sf_dir):
    voxels, grid = _events(spark, sf_dir)
    needed = query.RangeQuery(voxels, grid, ISO, ISO).expanded().select("step", "block_id")
    near = G.with_blocks(voxels, grid).join(needed, ["step", "block_id"], "left_semi").select(*voxels.columns)
    return mesh.triangles(near, ISO)


@register("mc_degenerate", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT step, count(*) AS triangles, count(*) FILTER (a = b OR b = c OR c = a) AS degenerate FROM mesh GROUP BY step")
def mc_degenerate(spark, sf_dir):
    found = stored(mesh.triangles(_events(spark, sf_dir)[0], ISO), "triangles")
    lost = mesh.degenerate(found).groupBy("step").agg(F.count(F.lit(1)).alias("d"))
    return found.groupBy("step").agg(F.count(F.lit(1)).alias("triangles")).join(lost, "step", "left").select("step", "triangles", F.coalesce("d", F.lit(0)).alias("degenerate"))


@register("mesh_boundary_edges", _VOX, _corner_join(), _ACTIVE, _TABLE, _MESH, select="SELECT step, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT step, a AS x, b AS y FROM mesh UNION ALL SELECT step, b, c FROM mesh UNION ALL SELECT step, c, a FROM mesh) GROUP BY 1, 2, 3 HAVING count(*) = 1")
def mesh_boundary_edges(spark, sf_dir):
    return mesh.boundary_edges(mesh.triangles(_events(spark, sf_dir)[0], ISO))


def _normal(i: int) -> str:
    n = ", ".join(f"round(p.g{k} + (({ISO} - p.f) / (q.f - p.f)) * (q.g{k} - p.g{k}), 6) AS n{k}" for k in range(3))
    on = " AND ".join(f"q.d{k} = p.d{k} + {int(k == i)}" for k in range(3))
    return f"SELECT p.step, p.d0, p.d1, p.d2, CAST({i} AS INTEGER) AS axis, {n} FROM slopes p JOIN slopes q ON p.step = q.step AND {on} WHERE (p.f >= {ISO}) <> (q.f >= {ISO})"


@register("mc_edge_normals", _VOX, f"slopes AS (SELECT step, d0, d1, d2, f, {', '.join(map(_gradient, range(3)))} FROM vox)", select=" UNION ALL ".join(map(_normal, range(3))))
def mc_edge_normals(spark, sf_dir):
    found = mesh.edge_vertices(_events(spark, sf_dir)[0], ISO, normals=True)
    return found.select("step", *G.DIMS, "axis", *(F.round(f"n{i}", 6).alias(f"n{i}") for i in range(3)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values within a range, by way of the zone map."""
    return range_indexed(spark, sf_dir)
