"""Queries over planes of 32x32 samples, each of sixteen vectors, and their SQL twins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import fidelity
from tessera.operators import planes as P
from tessera.plans.catalogue import COEF, HIGH, LOW, MIDDLE, PX, lift_sql, quant_sql, query
from tessera.sources import tables

SIDE, GROUP, STREAM = 32, 10, 8

_PL = f"""{PX},
pn AS (SELECT frame // 16 AS plane, frame % 16 // 4 * 8 + y AS y, frame % 4 * 8 + x AS x, v FROM px),
grid AS (SELECT plane, y, x FROM (SELECT DISTINCT plane FROM pn), (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x)),
pl AS (SELECT g.plane, g.y, g.x, coalesce(p.v, 0) AS v FROM grid g LEFT JOIN pn p USING (plane, y, x)),
arr AS (SELECT plane, list(v ORDER BY y, x) AS a FROM pl GROUP BY plane),
two AS (SELECT n.plane, n.a, b.a AS b FROM arr n JOIN arr b ON b.plane = n.plane - 1 AND b.plane // {STREAM} = n.plane // {STREAM}),
px2 AS (SELECT plane, a, b, unnest(range(1024)) AS p FROM two)"""


def _at(a: str, y: str, x: str, side: int = 32) -> str:
    """A sample of an array, by the edge's beyond it."""
    return f"{a}[greatest(0, least({side - 1}, {y})) * {side} + greatest(0, least({side - 1}, {x})) + 1]"


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assemble(tables.blocks(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_before(_planes(spark, sf_dir), STREAM).where("before is not null")


def _samples(found: DataFrame, *names: str) -> DataFrame:
    """(plane, position, names): arrays as rows."""
    zipped = F.arrays_zip(*names)
    return found.select("plane", F.posexplode(zipped).alias("position", "s")).select("plane", "position", *(F.col(f"s.{n}").alias(n) for n in names))


def _with(found: DataFrame, schema: str, kernel) -> DataFrame:
    """``kernel`` gets plane, samples and samples before as arrays; (plane, ...)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x = P.array(batch.column("coef"), SIDE, SIDE)
        before = P.array(batch.column("before"), SIDE, SIDE) if "before" in batch.schema.names else None
        return [batch.column("plane"), *kernel(batch.column("plane").to_numpy(), x, before)]

    return P.mapped(found, f"plane long, {schema}", run)


# Pyramid

_PYRAMID = f"""{_PL},
{lift_sql('fr', 'pl', 'y', 'x', 16, 'plane')}, {lift_sql('fine', 'fr', 'x', 'y', 16, 'plane')}, l1 AS (SELECT plane, y, x, v FROM fine WHERE y < 16 AND x < 16),
{lift_sql('mr', 'l1', 'y', 'x', 8, 'plane')}, {lift_sql('middle', 'mr', 'x', 'y', 8, 'plane')}, l0 AS (SELECT plane, y, x, v FROM middle WHERE y < 8 AND x < 8)"""


@query(f"""WITH {_PYRAMID}, every AS (SELECT plane, 2 AS layer, y, x, v, 32 AS w, y < 16 AND x < 16 AS low FROM fine UNION ALL SELECT plane, 1, y, x, v, 16, y < 8 AND x < 8 FROM middle UNION ALL SELECT plane, 0, y, x, v, 8, false FROM l0)
SELECT plane, CAST(layer AS INT) AS layer, CAST(y * w + x AS INT) AS position, CASE WHEN low THEN 0 ELSE v END AS v FROM every""")
def plane_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.layers(_planes(spark, sf_dir))
    each = F.array(*(F.struct(F.lit(k).alias("layer"), F.col(f"layer{k}").alias("coef")) for k in range(3)))
    return found.select("plane", F.explode(each).alias("e")).select("plane", "e.layer", F.posexplode("e.coef").alias("position", "v"))


@query(f"""WITH {_PYRAMID}, every AS (SELECT plane, y, x, v, 32 AS side FROM pl UNION ALL SELECT plane, y, x, v, 16 FROM l1 UNION ALL SELECT plane, y, x, v, 8 FROM l0)
SELECT plane, CAST(side AS INT) AS side, CAST(y * side + x AS INT) AS position, v FROM every WHERE side = CASE WHEN plane % 3 = 0 OR plane % 5 = 0 THEN 8 WHEN plane % 3 = 1 OR plane % 7 = 0 THEN 16 ELSE 32 END""")
def plane_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plane up to its highest layer (plane % 3); every fifth has lost its middle layer, every seventh its finest one."""
    plane = F.col("plane")
    sent = P.layers(_planes(spark, sf_dir)).withColumn("highest", (plane % 3).cast("int")).withColumn("layer1", F.when(plane % 5 != 0, F.col("layer1"))).withColumn("layer2", F.when(plane % 7 != 0, F.col("layer2")))
    return P.rebuild(sent).select("plane", "side", F.posexplode("coef").alias("position", "v"))


# Edges

_STARTS = [-5, 3, 11, 27]


def _edge_sql(clamp) -> str:
    starts = ", ".join(map(str, _STARTS))
    y, x = clamp("(r + p // 8)"), clamp("(c + p % 8)")
    return f"""WITH {_PL}, s AS (SELECT plane, a, r, c, unnest(range(64)) AS p FROM arr, (SELECT unnest([{starts}]) AS r), (SELECT unnest([{starts}]) AS c))
SELECT plane, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(p AS INT) AS position, a[{y} * 32 + {x} + 1] AS v FROM s"""


def _edges(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    return P.read_blocks(_planes(spark, sf_dir), _STARTS, rule=rule).select("plane", "row", "col", F.posexplode("coef").alias("position", "v"))


@query(_edge_sql(lambda i: f"greatest(0, least(31, {i}))"))
def edge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, P.replicated)


@query(_edge_sql(lambda i: f"greatest(0, least(31, CASE WHEN {i} >= 32 THEN 63 - {i} ELSE abs({i}) END))"))
def mirrored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, P.mirrored)


@query(f"WITH {_PL} SELECT plane, CAST(y * 29 + x AS INT) AS position, v FROM pl WHERE y < 27 AND x < 29")
def cropped_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes put together from their blocks, and cropped."""
    blocks = P.read_blocks(_planes(spark, sf_dir), [0, 8, 16, 24])
    return P.write_blocks(blocks, 29, 27).select("plane", F.posexplode("coef").alias("position", "v"))


# Between samples

_Y, _X = "(p // 32)", "(p % 32)"


@query(f"""WITH {_PL}, s AS (SELECT plane, a, plane % 2 AS r, plane // 2 % 2 AS fx, plane // 4 % 2 AS fy, plane % 4 AS rx, plane // 4 % 4 AS ry, unnest(range(1024)) AS p FROM arr),
n AS (SELECT plane, p, r, fx, fy, rx, ry, {_at('a', _Y, _X)} AS v, {_at('a', _Y, f'{_X} + fx')} AS hx, {_at('a', f'{_Y} + fy', _X)} AS hy, {_at('a', f'{_Y} + fy', f'{_X} + fx')} AS hd, {_at('a', _Y, f'{_X} + 1')} AS qx, {_at('a', f'{_Y} + 1', _X)} AS qy, {_at('a', f'{_Y} + 1', f'{_X} + 1')} AS qd FROM s)
SELECT plane, CAST(p AS INT) AS position, CASE WHEN fx + fy = 0 THEN v WHEN fx + fy = 2 THEN (v + hx + hy + hd + 1 + r) >> 2 WHEN fx = 1 THEN (v + hx + r) >> 1 ELSE (v + hy + r) >> 1 END AS half,
 CASE WHEN rx + ry = 0 THEN v ELSE ((4 - rx) * (4 - ry) * v + rx * (4 - ry) * qx + (4 - rx) * ry * qy + rx * ry * qd + 7 + r) >> 4 END AS quarter FROM n""")
def between_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(plane, x, _):
        return [P.lists(P.half_samples(x, plane // 2 % 2, plane // 4 % 2, plane % 2)), P.lists(P.quarter_samples(x, plane % 4, plane // 4 % 4, plane % 2))]

    return _samples(_with(_planes(spark, sf_dir), "half array<long>, quarter array<long>", kernel), "half", "quarter")


def _fir_sql(taps: np.ndarray, bits: int, side: int, block: int, source: str) -> str:
    """The motion-compensated residual of planes ``a`` after ``b``, with three vectors for their blocks."""
    table = "[" + ", ".join(str(list(map(int, t))) for t in taps) + "]"
    low, across = (1 << bits) - 1, side // block
    y, x = f"(p // {side})", f"(p % {side})"
    down, right = f"{y} + (dy >> {bits})", f"{x} + (dx >> {bits})"
    terms = " + ".join(f"cy[{j + 1}] * cx[{i + 1}] * {_at('b', f'{down} + {j - 1}', f'{right} + {i - 1}', side)}" for j in range(4) for i in range(4))
    return f"""{source}, k AS (SELECT plane, a, b, p, least({y} // {block} * {across} + {x} // {block}, 2) AS k FROM samples),
vec AS (SELECT plane, a, b, p, (plane * 7 + k * 5) % 41 - 20 AS dx, (plane * 3 + k * 11) % 37 - 18 AS dy FROM k),
tap AS (SELECT *, {table}[(dx & {low}) + 1] AS cx, {table}[(dy & {low}) + 1] AS cy FROM vec)
SELECT plane, CAST(p AS INT) AS position, a[p + 1] - (({terms} + 31 + plane % 2) >> 6) AS residual, a[p + 1] AS back FROM tap"""


def _vectors(pairs: DataFrame) -> DataFrame:
    """Three vectors a plane; the last block has the last one too."""
    plane, k = F.col("plane"), F.array(F.lit(0), F.lit(1), F.lit(2))
    return pairs.withColumn("dx", F.transform(k, lambda i: (plane * 7 + i * 5) % 41 - 20)).withColumn("dy", F.transform(k, lambda i: (plane * 3 + i * 11) % 37 - 18)).withColumn("rounding", plane % 2)


@query(f"WITH {_fir_sql(P.LUMA_TAPS, 2, 32, 16, _PL + ', samples AS (SELECT plane, a, b, p FROM px2)')}")
def motion_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(P.compensate(_vectors(_pairs(spark, sf_dir)), 16, SIDE, P.LUMA_TAPS), "residual", "back")


_HALVED = "list_transform(range(256), lambda i: {a}[i // 16 * 64 + i % 16 * 2 + 1])"


@query(f"WITH {_fir_sql(P.CHROMA_TAPS, 3, 16, 8, _PL + f', samples AS (SELECT plane, {_HALVED.format(a="a")} AS a, {_HALVED.format(a="b")} AS b, unnest(range(256)) AS p FROM two)')}")
def motion_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda c: F.filter(c, lambda v, p: (p % 2 == 0) & (S.div(p, 32) % 2 == 0))
    halved = _pairs(spark, sf_dir).select("plane", even("coef").alias("coef"), even("before").alias("before"))
    return _samples(P.compensate(_vectors(halved), 8, 16, P.CHROMA_TAPS), "residual", "back")


_PLACES = [(0, 0), (0, 12), (0, 24), (12, 0), (12, 24), (24, 0), (24, 12), (24, 24)]


@query(f"""WITH {_PL}, s AS (SELECT plane, p, a, b, plane % 23 - 11 AS dx, plane % 17 - 8 AS dy, a[p + 1] AS v, b[p + 1] AS w FROM px2),
probe AS (SELECT plane, CAST(sum((SELECT count(*) FROM (VALUES {', '.join(f'({y}, {x})' for y, x in _PLACES)}) t(ty, tx) WHERE {_Y} BETWEEN ty AND ty + 7 AND {_X} BETWEEN tx AND tx + 7) * abs(v - w)) AS BIGINT) // 512 AS probes FROM s GROUP BY plane),
sparse0 AS (SELECT plane, p, a, b, dx, dy, {P.LUMA_TAPS.tolist()}[(dx & 3) + 1] AS cx, {P.LUMA_TAPS.tolist()}[(dy & 3) + 1] AS cy FROM s WHERE {_Y} % 8 = 0 AND {_X} % 2 = 0),
sparse AS (SELECT plane, CAST(sum(abs(a[p + 1] - (({' + '.join(f"cy[{j + 1}] * cx[{i + 1}] * " + _at('b', f'{_Y} + (dy >> 2) + {j - 1}', f'{_X} + (dx >> 2) + {i - 1}') for j in range(4) for i in range(4))} + 31) >> 6))) AS BIGINT) AS sparse FROM sparse0 GROUP BY plane),
c0 AS (SELECT plane, a, b, plane % 5 * 4 AS top, plane % 4 * 4 AS lft, (plane % 17 - 8) >> 1 AS sy, (plane % 23 - 11) >> 1 AS sx, unnest(range(16)) AS q FROM two),
c1 AS (SELECT *, top + q // 4 AS y, lft + q % 4 AS x FROM c0),
chroma AS (SELECT plane, CASE WHEN top + 4 <= 16 AND lft + 4 <= 16 AND top + sy >= 0 AND lft + sx >= 0 AND top + sy + 4 <= 16 AND lft + sx + 4 <= 16 THEN CAST(sum(abs({_at('a', 'y * 2', 'x * 2')} - {_at('b', '(y + sy) * 2', '(x + sx) * 2')}) + abs({_at('a', 'y * 2 + 1', 'x * 2 + 1')} - {_at('b', '(y + sy) * 2 + 1', '(x + sx) * 2 + 1')})) * 4 AS BIGINT) ELSE 1000 END AS chroma FROM c1 GROUP BY plane, top, lft, sy, sx)
SELECT plane, probes, sparse, chroma FROM probe JOIN sparse USING (plane) JOIN chroma USING (plane)""")
def motion_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to measure a plane against the one before: probes, a sparse sum at a displacement, chroma blocks."""

    def kernel(plane, x, before):
        dx, dy = plane % 23 - 11, plane % 17 - 8
        even, odd = (lambda a: a[:, ::2, ::2]), (lambda a: a[:, 1::2, 1::2])
        chroma = P.chroma_difference([even(x), odd(x)], [even(before), odd(before)], plane % 5 * 4, plane % 4 * 4, dx, dy)
        return [pa.array(P.probe_difference(x, before, 8)), pa.array(P.sparse_difference(x, before, dx, dy)), pa.array(chroma)]

    return _with(_pairs(spark, sf_dir), "probes long, sparse long, chroma long", kernel)


_REACH = 3
_SEARCH = f"""offs AS (SELECT k, k // 7 - {_REACH} AS dy, k % 7 - {_REACH} AS dx FROM (SELECT unnest(range(49)) AS k))"""


def _cost_sql(name: str, ref: str) -> str:
    return f"""{name}_cost AS (SELECT plane, p // 256 * 4 + p % 32 // 8 AS block, k, dx, dy, sum(abs(a[p + 1] - {_at(ref, f'{_Y} + dy', f'{_X} + dx')})) AS cost FROM samples, offs GROUP BY ALL),
{name} AS (SELECT plane, block, dx, dy, CAST(cost AS BIGINT) AS cost FROM {name}_cost QUALIFY row_number() OVER (PARTITION BY plane, block ORDER BY cost, k) = 1)"""


_FLAT = "flat AS (SELECT plane, p // 256 * 4 + p % 32 // 8 AS block, max({a}[p + 1]) - min({a}[p + 1]) AS contrast FROM samples GROUP BY ALL)"


@query(f"""WITH {_PL}, samples AS (SELECT plane, a, b, p FROM px2), {_SEARCH}, {_cost_sql('best', 'b')}, {_FLAT.format(a='a')}
SELECT plane, CAST(block AS INT) AS position, CASE WHEN cost > greatest(1024, contrast * 2) THEN 0 ELSE dx * 4 END AS dx, CASE WHEN cost > greatest(1024, contrast * 2) THEN 0 ELSE dy * 4 END AS dy, cost FROM best JOIN flat USING (plane, block)""")
def motion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(_, x, before):
        return list(map(P.lists, P.motion_field(x, before, 8, _REACH, weight=2)))

    return _samples(_with(_pairs(spark, sf_dir), "dx array<long>, dy array<long>, cost array<long>", kernel), "dx", "dy", "cost")


@query(f"""WITH {_PL}, samples AS (SELECT n.plane, n.a, n.b, f.a AS f, n.p FROM px2 n JOIN arr f ON f.plane = n.plane // {STREAM} * {STREAM}), {_SEARCH}, {_cost_sql('fore', 'b')}, {_cost_sql('back', 'f')}, {_FLAT.format(a='a')}, {_FLAT.format(a='f').replace('flat AS', 'flat2 AS')},
j AS (SELECT o.plane, o.block, o.dx AS px, o.dy AS py, o.cost AS error, n.dx AS nx, n.dy AS ny, n.cost AS other, (c.contrast - d.contrast) * (c.contrast - d.contrast) // 4 AS odd, o.plane % {STREAM} AS pos FROM fore o JOIN back n USING (plane, block) JOIN flat c USING (plane, block) JOIN flat2 d USING (plane, block)),
w AS (SELECT *, other + (abs(nx) + abs(ny)) * 8 + 32 + CASE WHEN other < 384 THEN 0 ELSE least(1024, pos * 16) END AS base FROM j),
d AS (SELECT *, least(1536, 512 + pos * 16) <= error AND base < error AND (base + odd < error OR (base + odd = error AND nx * nx + ny * ny < px * px + py * py)) AS backward FROM w)
SELECT plane, CAST(block AS INT) AS position, CASE WHEN backward THEN nx ELSE px END AS dx, CASE WHEN backward THEN ny ELSE py END AS dy, backward, error AS cost FROM d""")
def two_way_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = P.with_before(_planes(spark, sf_dir), STREAM)
    firsts = planes.where(F.col("plane") % STREAM == 0).select(F.expr(f"plane div {STREAM}").alias("g"), F.col("coef").alias("first"))
    both = planes.where("before is not null").withColumn("g", F.expr(f"plane div {STREAM}")).join(firsts, "g")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        now, before, first = (P.array(batch.column(c), SIDE, SIDE) for c in ("coef", "before", "first"))
        plane = batch.column("plane").to_numpy()
        dx, dy, backward, error = P.two_way_field(now, before, first, plane % STREAM, 8, _REACH)
        return [batch.column("plane"), P.lists(dx), P.lists(dy), P.lists(backward, pa.bool_()), P.lists(error)]

    found = P.mapped(both.select("plane", "coef", "before", "first"), "plane long, dx array<long>, dy array<long>, backward array<boolean>, cost array<long>", kernel)
    return _samples(found, "dx", "dy", "backward", "cost")


@query()
def searched_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search starts from what was found before it, so this is a fold over blocks and planes; tests hold it against whole windows."""
    found = P.searched_fields(_planes(spark, sf_dir), SIDE, 8, 8, STREAM)
    each = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(F.get("vectors", k * 3).alias("dy"), F.get("vectors", k * 3 + 1).alias("dx"), F.get("vectors", k * 3 + 2).alias("cost")))
    return found.select("plane", F.posexplode(each).alias("position", "v")).select("plane", "position", "v.dy", "v.dx", "v.cost")


# Seams

_SHIFT, _FLATNESS = 11, 22
_EDGE = "({at} % 8 = {k} AND {at} {side})"


def _seam_sql(name: str, source: str, at: str, line: str, before: str) -> str:
    """One pass of smooth_seams() along ``at``."""
    w = f"WINDOW w AS (PARTITION BY plane, {line} ORDER BY {at})"
    soft = lambda a2, a1, b0, b1: f"abs({b0} - {a1}) < lim AND abs({a2} - {a1}) * 2 < lim AND abs({b1} - {b0}) * 2 < lim"
    move = lambda p, q: f"greatest(-most, least(most, ({q} - {p} + 1) >> 1))"
    return f"""{name}_n AS (SELECT *, lag(v, 2) OVER w AS a2, lag(v) OVER w AS a1, lead(v) OVER w AS b1, lead(v, 2) OVER w AS b2 FROM {source} {w}),
{name}_l AS (SELECT *, {before} AS wide FROM {name}_n),
{name}_m AS (SELECT *, CASE WHEN wide THEN 16 ELSE 11 END AS most, CASE WHEN wide THEN 44 ELSE 22 END AS lim FROM {name}_l),
{name} AS (SELECT plane, y, x, CASE WHEN {at} % 8 = 0 AND {at} > 0 AND {soft('a2', 'a1', 'v', 'b1')} THEN v - {move('a1', 'v')} WHEN {at} % 8 = 7 AND {at} < 31 AND {soft('a1', 'v', 'b1', 'b2')} THEN v + {move('v', 'b1')} ELSE v END AS v FROM {name}_m)"""


def _intra_sql(at: str, other: str, upright: bool) -> str:
    """Whether one of the blocks beside a sample's seam is intra: block k of plane p where (5 p + k) % 7 = 0."""
    near = f"CASE WHEN {at} % 8 < 4 THEN {at} // 8 ELSE {at} // 8 + 1 END"
    block = (lambda k: f"({other} // 8 * 4 + {k})") if upright else (lambda k: f"(({k}) * 4 + {other} // 8)")
    flag = lambda k: f"(5 * plane + {block(k)}) % 7 = 0"
    return f"({flag(f'(({near}) - 1)')} OR {flag(f'({near})')})"


@query(f"""WITH {_PL}, small AS (SELECT plane, y, x, v // 8 AS v FROM pl), {_seam_sql('up', 'small', 'x', 'y', _intra_sql('x', 'y', True))}, {_seam_sql('level', 'up', 'y', 'x', _intra_sql('y', 'x', False))}
SELECT plane, CAST(y * 32 + x AS INT) AS position, v FROM level""")
def smoothed_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 16: shift 11 and limit 22, beside intra blocks 16 and 44."""

    def kernel(plane, x, _):
        intra = (5 * plane[:, None] + np.arange(16)) % 7 == 0
        small = np.sign(x) * (np.abs(x) // 8)
        return [P.lists(P.smooth_seams(small, intra, 8, (_SHIFT, _FLATNESS), (16, 44)))]

    return _samples(_with(_planes(spark, sf_dir), "v array<long>", kernel), "v")


def _blend_sql(name: str, source: str, at: str, inside: str, seam: str) -> str:
    """One seam of the intra block ``k``; ``seam`` is its place along ``at``, and ``inside`` its lines."""
    w = f"(PARTITION BY plane, {'y' if at == 'x' else 'x'} ORDER BY {at})"
    parts = " ".join(f"WHEN {at} = {seam} + {j} THEN (v * {4 + j} + {near} * {4 - j}) >> 3" for j, near in ((0, f"lag(v, 1) OVER {w}"), (1, f"lag(v, 2) OVER {w}"), (2, f"lag(v, 3) OVER {w}"), (3, f"lag(v, 4) OVER {w}")))
    parts += " " + " ".join(f"WHEN {at} = {seam} - {j + 1} THEN (v * {4 + j} + lead(v, {j + 1}) OVER {w} * {4 - j}) >> 3" for j in range(4))
    return f"{name} AS (SELECT plane, k, y, x, CASE WHEN NOT ({inside}) OR {seam} <= 0 OR {seam} >= 32 THEN v {parts} ELSE v END AS v FROM {source})"


@query(f"""WITH {_PL}, s0 AS (SELECT plane, plane % 16 AS k, y, x, v FROM pl),
{_blend_sql('s1', 's0', 'x', 'y // 8 = k // 4', '(k % 4 * 8)')}, {_blend_sql('s2', 's1', 'x', 'y // 8 = k // 4', '(k % 4 * 8 + 8)')},
{_blend_sql('s3', 's2', 'y', 'x // 8 = k % 4', '(k // 4 * 8)')}, {_blend_sql('s4', 's3', 'y', 'x // 8 = k % 4', '(k // 4 * 8 + 8)')}
SELECT plane, CAST(y * 32 + x AS INT) AS position, v FROM s4""")
def blended_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intra block a plane."""

    def kernel(plane, x, _):
        return [P.lists(P.blend_seams(x, np.arange(16) == plane[:, None] % 16, 8))]

    return _samples(_with(_planes(spark, sf_dir), "v array<long>", kernel), "v")


# Estimates

_RICE = "(s // CAST(2 ** greatest(0, k - 1) AS BIGINT)) + 16 * (1 + k)"


@query(f"""WITH {COEF}, q AS (SELECT frame, y, x, {{band}} AS band, CASE {{band}} WHEN 'LL' THEN {quant_sql('v', LOW, 32768)} WHEN 'HH' THEN {quant_sql('v', HIGH, 8192)} ELSE {quant_sql('v', MIDDLE, 16384)} END AS v FROM coef),
ll AS (SELECT * FROM q WHERE band = 'LL'),
d AS (SELECT a.frame, a.band, a.v - CASE WHEN a.y = 0 AND a.x = 0 THEN 0 WHEN a.y = 0 THEN l.v WHEN a.x = 0 THEN u.v WHEN c.v >= greatest(l.v, u.v) THEN least(l.v, u.v) WHEN c.v <= least(l.v, u.v) THEN greatest(l.v, u.v) ELSE l.v + u.v - c.v END AS v
 FROM ll a LEFT JOIN ll l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN ll u ON u.frame = a.frame AND u.y = a.y - 1 AND u.x = a.x LEFT JOIN ll c ON c.frame = a.frame AND c.y = a.y - 1 AND c.x = a.x - 1),
e AS (SELECT frame, band, v FROM d UNION ALL SELECT frame, band, v FROM q WHERE band <> 'LL'),
t AS (SELECT frame, band, CAST(sum(abs(v)) AS BIGINT) AS s FROM e GROUP BY ALL), m AS (SELECT *, CASE WHEN s // 16 < 1 THEN 0 ELSE length(bin(s // 16)) - 1 END AS k FROM t),
z AS (SELECT frame, max(abs(v)) = 0 AS zero FROM q GROUP BY frame)
SELECT frame, CAST(CASE WHEN any_value(zero) THEN 1 ELSE 1 + sum({_RICE}) END AS BIGINT) AS bits FROM m JOIN z USING (frame) GROUP BY frame""".replace("{band}", "CASE WHEN y >= 4 AND x >= 4 THEN 'HH' WHEN y >= 4 THEN 'LH' WHEN x >= 4 THEN 'HL' ELSE 'LL' END"))
def block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column("frame"), pa.array(P.block_bits(P.array(batch.column("coef"), 8, 8), (LOW, MIDDLE, HIGH)))]

    return P.mapped(tables.blocks(spark, sf_dir), "frame long, bits long", kernel)


# Fidelity of several planes

_YUV = f"{PX}, bytes AS (SELECT frame // 3 AS frame, frame % 3 AS plane, y, x, greatest(0, least(255, 128 + v // 4)) AS a, greatest(0, least(255, 128 + (v + 6) // 16 * 4)) AS b FROM px)"


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, plane, a, b): three vectors are a frame's planes; the second array lacks every seventh frame."""
    byte = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + 128))
    rows = tables.blocks(spark, sf_dir).select(F.expr("frame div 3").alias("frame"), (F.col("frame") % 3).cast("int").alias("plane"), "coef")
    now = rows.select("frame", "plane", F.transform("coef", lambda v: byte(S.div(v, 4))).alias("a"))
    other = rows.where("frame % 7 <> 6").select("frame", "plane", F.transform("coef", lambda v: byte(S.div(v + 6, 16) * 4)).alias("b"))
    return now.join(other, ["frame", "plane"])


@query(f"""WITH {_YUV}, m AS (SELECT frame, plane, sum((a - b) * (a - b)) AS e, count(*) AS n, avg(a::DOUBLE) AS ma, avg(b::DOUBLE) AS mb, avg((a * a)::DOUBLE) AS qa, avg((b * b)::DOUBLE) AS qb, avg((a * b)::DOUBLE) AS qab FROM bytes WHERE frame % 7 <> 6 GROUP BY ALL),
f AS (SELECT frame, plane, CASE WHEN e = 0 THEN 100.0::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / (e::DOUBLE / n)) END AS psnr, (2 * ma * mb + 6.5025::DOUBLE) * (2 * (qab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((qa - ma * ma) + (qb - mb * mb) + 58.5225::DOUBLE)) AS ssim FROM m)
SELECT frame, round(sum(CASE plane WHEN 0 THEN 4 ELSE 1 END * psnr) / 6, 5) AS psnr, round(sum(CASE plane WHEN 0 THEN 4 ELSE 1 END * ssim) / 6, 5) AS ssim FROM f GROUP BY frame HAVING count(*) = 3""")
def combined_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR and SSIM of frames that both sides have, luma four times, each chroma plane once."""
    return fidelity.combined(_triples(spark, sf_dir)).select("frame", F.round("psnr", 5).alias("psnr"), F.round("ssim", 5).alias("ssim"))


@query(f"""WITH {PX}, byte AS (SELECT frame, y * 8 + x AS p, greatest(0, least(255, 128 + v // 4)) AS o, greatest(0, least(255, 128 + (v + 6) // 256 * 64)) AS d FROM px),
j AS (SELECT n.frame, abs(n.d - n.o) AS e, abs(n.d - b.o) AS before, abs(n.d - f.o) AS first FROM byte n JOIN byte b ON b.frame = n.frame - 1 AND b.p = n.p AND b.frame // {GROUP} = n.frame // {GROUP} JOIN byte f ON f.frame = n.frame // {GROUP} * {GROUP} AND f.p = n.p)
SELECT frame, count(*) FILTER (WHERE e > 10) AS wrong, count(*) FILTER (WHERE e > 10 AND first < e) AS first_ghosts, count(*) FILTER (WHERE e > 10 AND before < e AND NOT first < e) AS trailing_ghosts,
 round(CASE WHEN count(*) FILTER (WHERE e > 10) = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (WHERE e > 10 AND (first < e OR before < e)) * 100.0::DOUBLE / count(*) FILTER (WHERE e > 10) END, 6) AS score FROM j GROUP BY frame""")
def ghost_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + 128))
    rows = tables.blocks(spark, sf_dir).select("frame", F.expr(f"frame div {GROUP}").alias("gop"), F.transform("coef", lambda v: byte(S.div(v, 4))).alias("a"), F.transform("coef", lambda v: byte(S.div(v + 6, 256) * 64)).alias("b"))
    return fidelity.ghosts(rows, "gop")


@query(f"""WITH {PX}, byte AS (SELECT frame // 2 AS frame, frame % 2 AS plane, y, x, greatest(0, least(255, 128 + v // 4)) AS v FROM px),
n AS (SELECT *, lag(v) OVER (PARTITION BY frame, plane, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY frame, plane, y ORDER BY x) AS r, lag(v) OVER (PARTITION BY frame, plane, x ORDER BY y) AS u, lead(v) OVER (PARTITION BY frame, plane, x ORDER BY y) AS d FROM byte),
s AS (SELECT frame, plane, avg(v::DOUBLE) AS mean, count(*) FILTER (WHERE v >= 250 OR v <= 5) AS clipped, count(*) AS n, avg(abs(v - 128)::DOUBLE) AS energy, avg(abs(4 * v - l - r - u - d)::DOUBLE) FILTER (WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) AS rough FROM n GROUP BY ALL),
f AS (SELECT a.frame, a.mean AS mean_u, b.mean AS mean_v, (a.clipped + b.clipped) * 100.0::DOUBLE / (a.n + b.n) AS saturated, a.energy + b.energy AS energy, (a.rough + b.rough) / 2 AS rough FROM s a JOIN s b ON b.frame = a.frame AND a.plane = 0 AND b.plane = 1)
SELECT CAST(frame % {GROUP} AS INT) AS position, count(*) AS frames, round(avg(mean_u), 9) AS mean_u, round(avg(mean_v), 9) AS mean_v, round(avg(saturated), 9) AS saturated, round(avg(energy), 9) AS energy, round(avg(rough), 9) AS rough FROM f GROUP BY frame % {GROUP}""")
def chroma_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour statistics by a frame's place in its group."""
    byte = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + 128))
    rows = tables.blocks(spark, sf_dir).select(F.expr("frame div 2").alias("frame"), (F.col("frame") % 2).cast("int").alias("plane"), F.transform("coef", lambda v: byte(S.div(v, 4))).alias("a"))
    return fidelity.drift(fidelity.colour_statistics(rows), GROUP, "mean_u", "mean_v", "saturated", "energy", "rough")
