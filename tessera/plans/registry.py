"""Every query over the driver's tables, with its SQL twin where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import blocks as B
from tessera.operators import coding, fidelity, models, ordered, search
from tessera.plans import planes, streams
from tessera.plans.catalogue import BAND, COEF, HIGH, INTERVAL, LIMIT, LOW, MIDDLE, ORACLE_SQL, PX, QUANT, QUERIES, SCENE, SERIES, lift_sql, quant_sql, query
from tessera.sources import container, tables
from tessera.sources.shared import shared_folder
from tessera.streaming import sessions

def _coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.transform_blocks(tables.blocks(spark, sf_dir))


def _quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quantise_blocks(_coefs(spark, sf_dir), LOW, MIDDLE, HIGH)


# Blocks


@query(f"WITH {COEF} SELECT frame, y, x, v FROM coef")
def block_transform8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(_coefs(spark, sf_dir))


@query(f"WITH {PX} SELECT frame, y, x, v FROM px")
def block_roundtrip8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(B.untransform_blocks(_coefs(spark, sf_dir)))


@query(f"WITH {QUANT} SELECT frame, y, x, v FROM quant")
def block_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(_quantised(spark, sf_dir))


@query(f"WITH {QUANT} SELECT frame, y, x, CASE {BAND} WHEN 'LL' THEN v * {LOW} ELSE (CASE WHEN v % 2 = 0 THEN v // 2 ELSE -((v + 1) // 2) END) * (CASE {BAND} WHEN 'HH' THEN {HIGH} ELSE {MIDDLE} END) END AS v FROM quant")
def block_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(B.dequantise_blocks(_quantised(spark, sf_dir), LOW, MIDDLE, HIGH))


@query(f"""WITH {COEF},
q AS (SELECT frame, y, x, CASE {BAND} WHEN 'LL' THEN {quant_sql('v', 64, 32768)} ELSE {quant_sql('v', 64, 0)} END AS v, {BAND} AS band FROM coef),
quads AS (SELECT frame, ((y % 4) // 2) * 2 + (x % 4) // 2 AS k, max(abs(v)) AS m FROM q WHERE band <> 'LL' GROUP BY ALL),
flags AS (SELECT frame, max(CASE WHEN band <> 'LL' THEN abs(v) END) <= 1 AND max(CASE WHEN band = 'LL' THEN abs(v) END) = 0 AS is_zero FROM q GROUP BY frame)
SELECT f.frame, f.is_zero, bool_or(k.m = 0) AS is_split, CAST((SELECT CASE WHEN f.is_zero THEN 0 ELSE sum(abs(v)) END FROM q WHERE q.frame = f.frame) AS BIGINT) AS left_over
FROM flags f JOIN quads k USING (frame) GROUP BY f.frame, f.is_zero""")
def zero_block_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = _coefs(spark, sf_dir).withColumn("coef", F.transform("coef", lambda v, p: F.when(B.band(p) == "LL", S.quantise(v, 64)).otherwise(S.quantise(v, 64, 0))))
    return B.zero_blocks(coarse, 1).select("frame", "is_zero", "is_split", F.aggregate("coef", F.lit(0).cast("long"), lambda s, v: s + F.abs(v)).alias("left_over"))


@query(f"WITH {COEF}, e AS (SELECT frame, {BAND} AS band, sum(abs(v)) AS e FROM coef GROUP BY ALL) SELECT frame, CAST(sum(e) FILTER (WHERE band = 'HL') AS BIGINT) AS hl, CAST(sum(e) FILTER (WHERE band = 'LH') AS BIGINT) AS lh, CAST(sum(e) FILTER (WHERE band = 'HH') AS BIGINT) AS hh, CAST(sum(e) FILTER (WHERE band <> 'LL') AS BIGINT) AS energy FROM e GROUP BY frame")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.band_energy(_coefs(spark, sf_dir))


_AQ_SAD = "CASE WHEN d.sad IS NULL THEN -1 ELSE d.sad // 64 END"


@query(f"""WITH {COEF}, two AS (SELECT a.frame, a.v, b.v AS w FROM px a JOIN px b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x), d AS (SELECT frame, CAST(sum(abs(v - w)) AS BIGINT) AS sad FROM two GROUP BY frame),
q AS (SELECT frame, CASE WHEN frame % 11 = 10 THEN -1 ELSE sum(abs(v)) END AS e FROM coef WHERE {BAND} <> 'LL' GROUP BY frame),
r AS (SELECT q.frame, CAST(e * 10 // (SELECT greatest(1, CAST(sum(e) AS BIGINT) // count(*)) FROM q WHERE e <> -1) AS BIGINT) AS r, q.frame % 8 AS c, (q.frame // 8) % 6 AS w, {_AQ_SAD} AS sad FROM q LEFT JOIN d ON d.frame = q.frame WHERE e <> -1),
p AS (SELECT frame, r + CASE WHEN (abs(c - 4) + abs(w - 3)) * 10 // 7 >= 7 THEN 2 WHEN (abs(c - 4) + abs(w - 3)) * 10 // 7 <= 4 THEN -3 ELSE 0 END + CASE WHEN sad = -1 THEN 0 WHEN sad < 128 THEN 2 WHEN sad > 256 THEN CASE WHEN r <= 10 THEN -3 ELSE 2 END ELSE 0 END AS t FROM r)
SELECT frame, CASE WHEN t <= 6 THEN 0 WHEN t <= 8 THEN 1 WHEN t <= 12 THEN 2 WHEN t <= 15 THEN 3 ELSE 4 END AS level FROM p""")
def aq_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh block is marked as not measured; blocks without a frame before have no motion."""
    energy = B.band_energy(_coefs(spark, sf_dir)).select("frame", F.when(F.col("frame") % 11 == 10, -1).otherwise(F.col("energy")).alias("energy"))
    mean = energy.agg(B.mean_energy(F.col("energy")).alias("mean"))
    moved = search.frame_differences(tables.blocks(spark, sf_dir)).select("frame", S.div(F.col("sad"), 64).alias("sad"))
    known = energy.where("energy <> -1").join(moved, "frame", "left").join(F.broadcast(mean))  # one row
    return known.select("frame", S.aq_level(F.col("energy"), F.col("mean"), F.coalesce("sad", F.lit(-1)), F.col("frame") % 8, F.expr("(frame div 8) % 6"), 8, 6).alias("level"))


@query("WITH b AS (SELECT b.base, l.layer, c.chroma FROM (SELECT DISTINCT p_size * 7 AS base FROM part) b, (SELECT unnest([0, 1, 2]) AS layer) l, (SELECT unnest([false, true]) AS chroma) c), m AS (SELECT *, CASE layer WHEN 2 THEN base ELSE base // 2 END AS mid, CASE layer WHEN 2 THEN base * 5 // 4 WHEN 1 THEN base ELSE base * 3 // 4 END AS hi, CASE layer WHEN 2 THEN base WHEN 1 THEN base // 6 ELSE base // 8 END AS lo FROM b) SELECT base, layer, chroma, CAST(CASE WHEN chroma THEN least(16, greatest(1, base // 8)) ELSE least(16, greatest(1, lo)) END AS BIGINT) AS low, CAST(least(CASE WHEN chroma THEN 24 ELSE 48 END, greatest(1, mid)) AS BIGINT) AS middle, CAST(least(CASE WHEN chroma THEN 48 ELSE 64 END, greatest(1, hi)) AS BIGINT) AS high, CASE WHEN chroma THEN [-8000, -16000, -32000][layer + 1] ELSE [16384, 8192, 0][layer + 1] END AS middle_zone, CASE WHEN chroma THEN [-16000, -32000, -64000][layer + 1] ELSE [8192, 0, -8000][layer + 1] END AS high_zone FROM m")
def step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = tables.table(spark, sf_dir, "part").select((F.col("p_size") * 7).alias("base")).distinct()
    every = bases.withColumn("layer", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("chroma", F.explode(F.array(F.lit(False), F.lit(True))))
    return B.step_table(every)


@query(f"WITH {PX} SELECT frame, CAST(y // 2 * 4 + x // 2 AS INT) AS position, v - 128 AS v FROM px WHERE y % 2 = 0 AND x % 2 = 0")
def plane_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = tables.blocks(spark, sf_dir).select("frame", F.posexplode(B.decimate(F.col("coef"))).alias("position", "v"))
    return small.select("frame", "position", F.col("v").cast("long").alias("v"))


_DIFF = f"{PX}, two AS (SELECT a.frame, a.y, a.x, a.v, b.v AS w FROM px a JOIN px b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x), s AS (SELECT frame, CAST(sum(abs(v - w)) AS BIGINT) // 8 AS sad FROM two GROUP BY frame), o AS (SELECT frame, CAST(sum(c) AS BIGINT) // 64 AS occlusion FROM (SELECT frame, x, abs(sum(v) - sum(w)) AS c FROM two GROUP BY frame, x) GROUP BY frame)"


@query(f"WITH {_DIFF}, w AS (SELECT s.frame, s.sad, o.occlusion, frame % 8 * 2048 // 7 - 1024 AS cx, frame // 8 % 6 * 2048 // 5 - 1024 AS cy FROM s JOIN o USING (frame)), k AS (SELECT *, 1024 + least(1024, CAST(floor(sqrt(cx * cx + cy * cy)) AS BIGINT) * 1024 // 1448) * 512 // 1024 AS weight FROM w) SELECT frame, CAST(CASE WHEN sad >= 1500 OR occlusion >= 2 THEN greatest(1, weight * 8 // 1024 // 2) ELSE weight * 8 // 1024 END AS BIGINT) AS \"limit\", sad < weight * 150 // 1024 AS skipped FROM k")
def skip_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.frame_differences(tables.blocks(spark, sf_dir)).select("frame", S.div(F.col("sad"), 8).alias("sad"), "occlusion", (F.col("frame") % 8).alias("col"), F.expr("frame div 8 % 6").alias("row"))
    return B.skip_limits(rows, 48, 8, 6, 8).select("frame", "limit", "skipped")


@query(f"WITH {_DIFF}, b AS (SELECT s.frame, s.sad, o.occlusion, s.frame % 16 AS col, s.frame // 16 AS r FROM s JOIN o USING (frame)), c AS (SELECT r // 2 AS cr, col // 2 AS cc, CAST(sum(sad) AS BIGINT) AS sad, max(occlusion) AS occlusion FROM b GROUP BY ALL) SELECT b.frame, c.sad AS cell_sad, c.sad >= 1500 OR c.occlusion >= 2 AS busy FROM b JOIN c ON c.cr = b.r // 2 AND c.cc = b.col // 2")
def cell_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with what its cell of two by two blocks moves."""
    rows = search.frame_differences(tables.blocks(spark, sf_dir)).select("frame", S.div(F.col("sad"), 8).alias("sad"), "occlusion", (F.col("frame") % 16).alias("col"), F.expr("frame div 16").alias("row"))
    return search.with_cells(rows).select("frame", "cell_sad", ((F.col("cell_sad") >= 1500) | (F.col("cell_occlusion") >= 2)).alias("busy"))


@query(f"WITH {PX}, keep AS (SELECT vec_id AS frame FROM embeddings WHERE label = (SELECT min(label) FROM embeddings)) SELECT frame, CAST(sum(v) AS BIGINT) AS total FROM px WHERE frame IN (SELECT frame FROM keep) GROUP BY frame")
def frame_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings")
    least = rows.agg(F.min("label").alias("least"))
    keep = rows.join(F.broadcast(least), F.col("label") == F.col("least"), "left_semi").select(F.col("vec_id").alias("frame"))
    return tables.blocks(spark, sf_dir).join(keep, "frame", "left_semi").select("frame", F.aggregate("coef", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


# Prediction, runs and tokens

_MED = f"""{PX},
n AS (SELECT a.frame, a.y, a.x, a.v, l.v AS l, u.v AS u, c.v AS c FROM px a LEFT JOIN px l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN px u ON u.frame = a.frame AND u.y = a.y - 1 AND u.x = a.x LEFT JOIN px c ON c.frame = a.frame AND c.y = a.y - 1 AND c.x = a.x - 1)"""


@query(f"WITH {_MED} SELECT frame, y, x, v - CASE WHEN y = 0 AND x = 0 THEN 0 WHEN y = 0 THEN l WHEN x = 0 THEN u WHEN c >= greatest(l, u) THEN least(l, u) WHEN c <= least(l, u) THEN greatest(l, u) ELSE l + u - c END AS v FROM n")
def dpcm_med(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(ordered.residuals(tables.blocks(spark, sf_dir)))


@query(f"WITH {PX} SELECT frame, y, x, v FROM px")
def dpcm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(ordered.from_residuals(ordered.residuals(tables.blocks(spark, sf_dir))))


_SPARSE = f"{QUANT}, sparse AS (SELECT frame, y * 8 + x AS p, CASE WHEN abs(v) < 20 THEN 0 ELSE v END AS v FROM quant)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(_quantised(spark, sf_dir)).select("frame", (F.col("y") * 8 + F.col("x")).alias("p"), F.when(F.abs("v") < 20, 0).otherwise(F.col("v")).alias("v"))


@query(f"WITH {_SPARSE}, k AS (SELECT frame, p, v, lag(p) OVER (PARTITION BY frame ORDER BY p) AS q FROM sparse WHERE v <> 0) SELECT frame, p, CAST(p - coalesce(q, -1) - 1 AS INT) AS run, v AS value, CASE WHEN q IS NULL THEN 0 ELSE 1 END AS context FROM k")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.zero_runs(_sparse(spark, sf_dir), "frame", "p", "v")


@query(f"WITH {_SPARSE} SELECT frame, p AS position, v AS value FROM sparse")
def run_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = _sparse(spark, sf_dir)
    return ordered.expand_runs(ordered.zero_runs(sparse, "frame", "p", "v"), tables.blocks(spark, sf_dir).select("frame"), "frame", "p", 64)


_BITS = "(CASE WHEN {v} = 0 THEN 0 ELSE length(bin({v})) END)"


@query(f"""WITH {SERIES}, s AS (SELECT event_id, v - 15000 AS v, abs(v - 15000) AS m, CASE WHEN v < 15000 THEN 1 ELSE 0 END AS g FROM series), b AS (SELECT *, greatest(m - 16, 0) AS r, {_BITS.format(v='greatest(m - 16, 0)')} AS bits FROM s)
SELECT event_id, v, CAST(CASE WHEN v = 0 THEN 0 WHEN m <= 15 THEN 2 * m - 1 + g ELSE 32 + bits END AS INT) AS token, CAST(CASE WHEN m <= 15 THEN 0 ELSE (CASE WHEN r = 0 THEN 0 ELSE r - (1 << (bits - 1)) END) * 2 + g END AS BIGINT) AS bypass, CAST(CASE WHEN m <= 15 THEN 0 ELSE greatest(bits, 1) END AS INT) AS width, v AS back FROM b""")
def signed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.series(spark, sf_dir).select("event_id", (F.col("v") - 15000).cast("long").alias("v"))
    token, bypass, width = S.signed_token(F.col("v"))
    return rows.select("event_id", "v", token.alias("token"), bypass.alias("bypass"), width.alias("width")).withColumn("back", S.signed_value(F.col("token"), F.col("bypass")))


@query(f"""WITH {SERIES}, b AS (SELECT event_id, v, greatest(v - 32, 0) AS r, {_BITS.format(v='greatest(v - 32, 0)')} AS bits FROM series)
SELECT event_id, v, CAST(CASE WHEN v < 32 THEN v ELSE 32 + bits END AS INT) AS token, CAST(CASE WHEN r = 0 THEN 0 ELSE r - (1 << (bits - 1)) END AS BIGINT) AS bypass, CAST(greatest(bits - 1, 0) AS INT) AS width, v AS back FROM b""")
def unsigned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.series(spark, sf_dir).select("event_id", F.col("v").cast("long").alias("v"))
    token, bypass, width = S.unsigned_token(F.col("v"))
    return rows.select("event_id", "v", token.alias("token"), bypass.alias("bypass"), width.alias("width")).withColumn("back", S.unsigned_value(F.col("token"), F.col("bypass")))


@query(f"WITH {SERIES} SELECT user_id, event_id, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS lane FROM series")
def lane_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.lanes(tables.series(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", F.col("lane").cast("int").alias("lane"))


# Models

_TOKENS = f"{_SPARSE}, t0 AS (SELECT y AS ctx, abs(v) AS v FROM quant), t AS (SELECT ctx, CAST(CASE WHEN v < 32 THEN v ELSE 32 + {_BITS.format(v='(v - 32)')} END AS INT) AS token FROM t0)"
_HIST = f"{_TOKENS}, hist AS (SELECT ctx, token, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL)"
_MODEL = f"""{_HIST},
grid AS (SELECT c.ctx, g.token, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT ctx FROM hist) c CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS token) g LEFT JOIN hist h ON h.ctx = c.ctx AND h.token = g.token),
share AS (SELECT ctx, token, n, CASE WHEN n = 0 THEN 1 ELSE greatest(1, ((16384 - count(*) FILTER (WHERE n = 0) OVER w) * n) // CAST(sum(n) OVER w AS BIGINT)) END AS f FROM grid WINDOW w AS (PARTITION BY ctx)),
model AS (SELECT ctx, token, n, CAST(f + CASE WHEN row_number() OVER (PARTITION BY ctx ORDER BY f DESC, token) = 1 THEN 16384 - sum(f) OVER (PARTITION BY ctx) ELSE 0 END AS BIGINT) AS freq FROM share)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token, _, _ = S.unsigned_token(F.abs("v"))
    return tables.pixels(_quantised(spark, sf_dir)).select(F.col("y").alias("ctx"), token.alias("token"))


@query(f"WITH {_HIST} SELECT ctx, token, n FROM hist")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.histogram(_tokens(spark, sf_dir), "ctx")


@query(f"WITH {_MODEL} SELECT ctx, token, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY ctx ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM model")
def prefix_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rows_of(models.models(models.histogram(_tokens(spark, sf_dir), "ctx"), "ctx"), "ctx")


_LOG = "((length(bin({f})) - 1) * 256 + (({f} - (1 << (length(bin({f})) - 1))) * 256) // (1 << (length(bin({f})) - 1)))"


@query(f"""WITH {_MODEL},
m0 AS (SELECT token, sum(n) AS n FROM grid GROUP BY token),
m1 AS (SELECT token, n, CASE WHEN n = 0 THEN 1 ELSE greatest(1, CAST((16384 - (SELECT count(*) FROM m0 WHERE n = 0)) * n AS BIGINT) // (SELECT CAST(sum(n) AS BIGINT) FROM m0)) END AS f FROM m0),
m2 AS (SELECT token, CAST(f + CASE WHEN row_number() OVER (ORDER BY f DESC, token) = 1 THEN 16384 - sum(f) OVER () ELSE 0 END AS BIGINT) AS freq FROM m1),
hm AS (SELECT 64 + sum(CASE WHEN freq <= 1 THEN 0 WHEN freq < 128 THEN 8 ELSE 16 END) AS bits FROM m2),
c AS (SELECT a.ctx, CAST(sum(a.n * (3584 - 2048)) AS BIGINT) AS static_cost, CAST(sum(a.n * (3584 - {_LOG.format(f='b.freq')})) + max(hm.bits) * 256 AS BIGINT) AS merged_cost,
 CAST(sum(a.n * (3584 - {_LOG.format(f='a.freq')})) + (64 + sum(CASE WHEN a.freq <= 1 THEN 0 WHEN a.freq < 128 THEN 8 ELSE 16 END)) * 256 AS BIGINT) AS own_cost FROM model a JOIN m2 b USING (token) CROSS JOIN hm GROUP BY a.ctx)
SELECT ctx, static_cost, merged_cost, own_cost, CASE WHEN static_cost <= least(merged_cost, own_cost) THEN 'static' WHEN merged_cost <= own_cost THEN 'merged' ELSE 'own' END AS model FROM c""")
def model_cost_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.choose(models.models(models.histogram(_tokens(spark, sf_dir), "ctx"), "ctx"), "ctx")


@query(f"WITH {_MODEL}, cums AS (SELECT ctx, token, freq, coalesce(sum(freq) OVER (PARTITION BY ctx ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM model), {SERIES} SELECT s.event_id, s.event_id % 8 AS ctx, CAST(s.v % 16384 AS BIGINT) AS slot, c.token FROM series s JOIN cums c ON c.ctx = s.event_id % 8 AND s.v % 16384 >= c.cum AND s.v % 16384 < c.cum + c.freq")
def slot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot in the model of its context; there are eight."""
    found = models.rows_of(models.models(models.histogram(_tokens(spark, sf_dir), "ctx"), "ctx"), "ctx").withColumn("ctx", F.col("ctx").cast("long"))
    slots = tables.series(spark, sf_dir).select("event_id", (F.col("event_id") % 8).alias("ctx"), (F.col("v") % 16384).cast("long").alias("slot"))
    return models.lookup(slots, found, "ctx").select("event_id", "ctx", "slot", "token")


# Sequences

_GOP = f"""{SERIES},
d AS (SELECT *, coalesce(lag(v) OVER w = v, false) AS is_copy, CASE WHEN coalesce(abs(v - lag(v) OVER w) > {SCENE}, false) THEN 1 ELSE 0 END AS cut FROM series WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene FROM d),
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id, scene ORDER BY event_id) - 1) % {INTERVAL} AS INT) AS position FROM s),
g AS (SELECT *, CAST(sum(CASE WHEN position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop FROM p)
SELECT user_id, event_id, is_copy, position = 0 AS is_key, scene, gop, position, CAST(position % 2 AS INT) AS parity, CAST(first_value(v) OVER (PARTITION BY user_id, gop ORDER BY event_id) AS INT) AS reference FROM g"""


@query(f"WITH {_GOP}")
def gop_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.segments(tables.series(spark, sf_dir), "user_id", "event_id", "v", SCENE, INTERVAL)


@query(f"""WITH RECURSIVE {SERIES}, n AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM series),
f AS (SELECT user_id, k, m, v AS fast, v AS slow FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.k, n.m, ((CASE WHEN f.fast = 0 THEN n.v ELSE f.fast END) * 4 + n.v) // 5, ((CASE WHEN f.slow = 0 THEN n.v ELSE f.slow END) * 7 + n.v) // 8 FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
SELECT user_id, CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow FROM f WHERE k = m""")
def ema_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.folded(tables.series(spark, sf_dir), "user_id", "event_id", ["v"], sessions.smoothed_step, "fast long, slow long", last_only=True)


@query(f"WITH {SERIES}, l AS (SELECT user_id, event_id, CAST(least(v // 5000, 4) AS INT) AS level FROM series), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, level ORDER BY event_id) AS island FROM l) SELECT user_id, CAST(min(k) AS INT) AS start, level, count(*) AS length FROM n GROUP BY user_id, level, island")
def aq_level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = tables.series(spark, sf_dir).withColumn("level", F.least(F.expr("v div 5000"), F.lit(4)).cast("int"))
    return ordered.level_runs(levels, "user_id", "event_id", "level")


_STEP = 16


@query(f"""WITH {PX}, b AS (SELECT frame * 64 + y * 8 + x AS p, v // 8 AS v FROM px), e AS (SELECT p, v, lag(v, 2) OVER w AS a2, lag(v) OVER w AS a1, lead(v) OVER w AS b1, lead(v, 2) OVER w AS b2, p % 64 AS i FROM b WINDOW w AS (PARTITION BY p // 64 ORDER BY p)),
r AS (SELECT *, i % 8 = 0 AND i > 0 AND abs(v - a1) < 22 AND abs(a2 - a1) * 2 < 22 AND abs(b1 - v) * 2 < 22 AS right_side, i % 8 = 7 AND i < 63 AND abs(b1 - v) < 22 AND abs(a1 - v) * 2 < 22 AND abs(b2 - b1) * 2 < 22 AS left_side FROM e)
SELECT p // 64 AS frame, i AS position, CAST(CASE WHEN right_side THEN v - greatest(-11, least(11, (v - a1 + 1) >> 1)) WHEN left_side THEN v + greatest(-11, least(11, (b1 - v + 1) >> 1)) ELSE v END AS BIGINT) AS v FROM r""")
def deblock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.blocks(spark, sf_dir).withColumn("coef", F.transform("coef", lambda v: S.div(v, 8)))
    shift, limit = S.edge_strength(F.lit(_STEP))
    return rows.select("frame", F.posexplode(ordered.deblock_row(F.col("coef"), 8, shift, limit)).alias("position", "v"))


# Frames beside frames

_PAIR = f"{PX}, two AS (SELECT a.frame, a.y, a.x, a.v, b.v AS w FROM px a JOIN px b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x)"


@query(f"""WITH {_PAIR}, cols AS (SELECT frame, x, abs(sum(v) - sum(w)) AS c FROM two GROUP BY frame, x), o AS (SELECT frame, CAST(sum(c) AS BIGINT) // 64 AS occlusion FROM cols GROUP BY frame)
SELECT frame, CAST(sum(abs(v - w)) AS BIGINT) AS sad, CAST(sum(abs(v - w)) FILTER (WHERE (y * 8 + x) % 4 = 0) * 4 AS BIGINT) // 64 AS fast, max(v) - min(v) AS contrast, any_value(occlusion) AS occlusion FROM two JOIN o USING (frame) GROUP BY frame""")
def frame_sad_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.frame_differences(tables.blocks(spark, sf_dir))


_BEST = f"""{PX}, offs AS (SELECT k, k // 5 - 2 AS dy, k % 5 - 2 AS dx FROM (SELECT unnest(range(25)) AS k)),
cost AS (SELECT a.frame, o.k, o.dx, o.dy, sum(abs(a.v - b.v)) AS cost FROM px a CROSS JOIN offs o JOIN px b ON b.frame = a.frame - 1 AND b.y = greatest(0, least(7, a.y + o.dy)) AND b.x = greatest(0, least(7, a.x + o.dx)) GROUP BY ALL),
best AS (SELECT frame, dx, dy, CAST(cost AS BIGINT) AS cost FROM cost QUALIFY row_number() OVER (PARTITION BY frame ORDER BY cost, k) = 1)"""


@query(f"WITH {_BEST} SELECT frame, dx, dy, cost FROM best")
def motion_best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_offset(tables.blocks(spark, sf_dir))


@query(f"WITH {_BEST}, d AS (SELECT frame, dx - coalesce(lag(dx) OVER w, 0) AS mx, dy - coalesce(lag(dy) OVER w, 0) AS my FROM best WINDOW w AS (PARTITION BY frame // 50 ORDER BY frame)) SELECT frame, mx, my, abs(mx) + abs(my) AS penalty FROM d")
def motion_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.predicted_vectors(search.best_offset(tables.blocks(spark, sf_dir)))


# Fidelity: each frame against its coarse reconstruction, as bytes

_BYTES = f"{QUANT.replace('quant AS', 'q0 AS')}, pairs AS (SELECT p.frame, p.y, p.x, greatest(0, least(255, 128 + p.v // 4)) AS a, greatest(0, least(255, 128 + (p.v + 6) // 16 * 4)) AS b FROM px p)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + 128))
    return tables.blocks(spark, sf_dir).select("frame", F.transform("coef", lambda v: byte(S.div(v, 4))).alias("a"), F.transform("coef", lambda v: byte(S.div(v + 6, 16) * 4)).alias("b"))


_PSNR = f"{_BYTES}, psnr AS (SELECT frame, CASE WHEN sum((a - b) * (a - b)) = 0 THEN 100.0 ELSE 10 * log10(65025.0::DOUBLE / (sum((a - b) * (a - b))::DOUBLE / count(*))) END AS psnr FROM pairs GROUP BY frame)"


@query(f"WITH {_PSNR} SELECT frame, round(psnr::DOUBLE, 6) AS psnr FROM psnr")
def psnr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.psnr(_pairs(spark, sf_dir)).select("frame", F.round("psnr", 6).alias("psnr"))


@query(f"""WITH {_BYTES}, m AS (SELECT frame, avg(a::DOUBLE) AS ma, avg(b::DOUBLE) AS mb, avg((a * a)::DOUBLE) AS qa, avg((b * b)::DOUBLE) AS qb, avg((a * b)::DOUBLE) AS qab FROM pairs GROUP BY frame)
SELECT frame, round((2 * ma * mb + 6.5025::DOUBLE) * (2 * (qab - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((qa - ma * ma) + (qb - mb * mb) + 58.5225::DOUBLE)), 6) AS ssim FROM m""")
def ssim_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.ssim(_pairs(spark, sf_dir)).select("frame", F.round("ssim", 6).alias("ssim"))


@query(f"WITH {_BYTES} SELECT frame, CAST(sum(abs(a - b)) AS BIGINT) AS absolute, max(abs(a - b)) AS largest, " + ", ".join(f"count(*) FILTER (WHERE abs(a - b) > {k}) * 1000 // count(*) AS above_{k}" for k in (10, 20, 30)) + " FROM pairs GROUP BY frame")
def error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.errors(_pairs(spark, sf_dir))


@query(f"WITH {_PSNR}, r AS (SELECT psnr::DOUBLE AS v, row_number() OVER (ORDER BY psnr) - 1 AS r, count(*) OVER () AS n FROM psnr) SELECT count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, round(stddev_pop(v), 6) AS deviation, round(max(v) FILTER (WHERE r = least(n - 1, floor(n * 0.5))), 6) AS p50, round(max(v) FILTER (WHERE r = least(n - 1, floor(n * 0.9))), 6) AS p90 FROM r")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.summary(fidelity.psnr(_pairs(spark, sf_dir)), "psnr")


@query(f"WITH {_PSNR} SELECT frame FROM psnr ORDER BY psnr, frame LIMIT 1")
def worst_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fidelity.worst(fidelity.psnr(_pairs(spark, sf_dir)), "psnr")


# Scalar functions over bulk numbers


@query(f"""WITH v AS (SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS p FROM lineitem),
g AS (SELECT k, n, q, p, q % 10 * 2048 // 9 - 1024 AS cx, p % 7 * 2048 // 6 - 1024 AS cy FROM v)
SELECT k, n, CAST({_LOG.format(f='p')} AS BIGINT) AS log2, CAST(floor(sqrt(p)) AS BIGINT) AS root, CAST(1024 + least(1024, CAST(floor(sqrt(cx * cx + cy * cy)) AS BIGINT) * 1024 // 1448) * 512 // 1024 AS BIGINT) AS weight, CAST((q - 25 + 1) >> 1 AS BIGINT) AS half FROM g""")
def integer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"), F.round("l_extendedprice").cast("long").alias("p"))
    return rows.select("k", "n", S.log2_q8(F.col("p")).alias("log2"), S.isqrt(F.col("p")).alias("root"), S.spatial_weight(F.col("q") % 10, F.col("p") % 7, 10, 7).alias("weight"), S.scale_vector(F.col("q") - 25, 1).alias("half"))


_B = "greatest(0, least(255, {}))"
_RGB = "c AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) * 5 % 256 AS r, CAST(round(l_extendedprice) AS BIGINT) % 256 AS g, CAST(round(l_extendedprice / 256) AS BIGINT) % 256 AS b FROM lineitem)"
_YCC = f"{_RGB}, y AS (SELECT k, n, {_B.format('(19595 * r + 38470 * g + 7471 * b + 32768) >> 16')} AS y, {_B.format('((-11059 * r - 21709 * g + 32768 * b + 32768) >> 16) + 128')} AS cb, {_B.format('((32768 * r - 27439 * g - 5329 * b + 32768) >> 16) + 128')} AS cr FROM c)"


@query(f"WITH {_YCC} SELECT k, n, y, cb, cr, {_B.format('(y * 1024 + 1436 * (cr - 128) + 512) >> 10')} AS r, {_B.format('(y * 1024 - 352 * (cb - 128) - 731 * (cr - 128) + 512) >> 10')} AS g, {_B.format('(y * 1024 + 1815 * (cb - 128) + 512) >> 10')} AS b FROM y")
def colour_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("l_extendedprice").cast("long")
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("long") * 5 % 256).alias("r"), (price % 256).alias("g"), (F.round(F.col("l_extendedprice") / 256).cast("long") % 256).alias("b"))
    y, cb, cr = S.luma_chroma(F.col("r"), F.col("g"), F.col("b"))
    planes = rows.select("k", "n", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    r, g, b = S.red_green_blue(F.col("y"), F.col("cb"), F.col("cr"))
    return planes.select("k", "n", "y", "cb", "cr", r.alias("r"), g.alias("g"), b.alias("b"))


# Streams of packets, coded blocks, live frames


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients from coarse to fine as three layers of big-endian 16-bit numbers; every tenth frame is a key frame."""
    code = lambda *bands: F.unhex(F.concat_ws("", F.transform(F.filter("coef", lambda v, p: B.band(p).isin(*bands)), lambda v: F.lpad(F.hex(v + 32768), 4, "0"))))
    frame = F.col("frame")
    return _coefs(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.expr("frame div 50")).cast("string")).alias("stream_id"), (frame % 50).cast("long").alias("frame_no"), F.when(frame % 10 == 0, "I").otherwise("P").alias("kind"),
        F.when(frame % 10 != 0, F.lit(b"\x01\x02")).alias("mvs"), F.when(frame % 10 > 4, F.lit(b"\x7f")).alias("ref_dir"), code("LL").alias("layer0"), code("HL", "LH").alias("layer1"), code("HH").alias("layer2"),
    )


_NUMBERS = f"WITH {COEF}, c AS (SELECT frame, {BAND} AS band, y * 8 + x AS p, lpad(hex(v + 32768), 4, '0') AS h FROM coef)"


@query(f"{_NUMBERS} SELECT 's' || (frame // 50) AS stream_id, CAST(frame % 50 AS BIGINT) AS frame_no, CASE WHEN frame % 10 = 0 THEN 'I' ELSE 'P' END AS kind, CASE WHEN frame % 10 <> 0 THEN '0102' END AS mvs, CASE WHEN frame % 10 > 4 THEN '7F' END AS ref_dir, string_agg(h, '' ORDER BY p) FILTER (WHERE band = 'LL') AS layer0, string_agg(h, '' ORDER BY p) FILTER (WHERE band IN ('HL', 'LH')) AS layer1, string_agg(h, '' ORDER BY p) FILTER (WHERE band = 'HH') AS layer2 FROM c GROUP BY frame")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = container.read_files(container.write_files(_packets(spark, sf_dir), shared_folder(spark, "streams"), 8, 8, 30))
    return back.select("stream_id", "frame_no", "kind", *(F.hex(p).alias(p) for p in container.PAYLOADS))


_SIZES = "s AS (SELECT vec_id // 50 AS s, vec_id % 50 AS n, 21 + 128 + CASE WHEN vec_id % 10 <> 0 THEN 2 ELSE 0 END + CASE WHEN vec_id % 10 > 4 THEN 1 ELSE 0 END AS size FROM embeddings), e AS (SELECT s, n, 16 + sum(size) OVER (PARTITION BY s ORDER BY n) AS stop, 16 + sum(size) OVER (PARTITION BY s) AS whole FROM s), c AS (SELECT *, CASE s % 3 WHEN 0 THEN whole WHEN 1 THEN whole - 200 ELSE 9 END AS left_over FROM e)"


@query(f"WITH {_SIZES} SELECT 's' || s AS stream_id, count(*) FILTER (WHERE s % 3 <> 2 AND stop <= left_over) AS frames, CASE s % 3 WHEN 1 THEN 'a packet is cut off' WHEN 2 THEN 'the header is too short' END AS problem FROM c GROUP BY s")
def checked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third stream lacks its last 200 bytes, every third all but nine."""
    streams = container.write_streams(_packets(spark, sf_dir), 8, 8, 30).withColumn("k", F.substring("stream_id", F.lit(2), F.lit(20)).cast("long") % 3)
    cut = F.when(F.col("k") == 0, F.col("data")).when(F.col("k") == 1, F.substring("data", F.lit(1), F.octet_length("data") - 200)).otherwise(F.substring("data", F.lit(1), F.lit(9)))
    return container.checked_streams(streams.select("stream_id", cut.alias("data")))


@query("SELECT count(*) AS frames, CAST(sum(32 + CASE WHEN vec_id % 10 <> 0 THEN 2 ELSE 0 END + CASE WHEN vec_id % 10 > 4 THEN 1 ELSE 0 END) AS BIGINT) AS kept_bytes, count(*) * 96 AS dropped_bytes FROM embeddings")
def layer_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.dropped_bytes(_packets(spark, sf_dir), 0)


@query(f"WITH {QUANT} SELECT frame, y * 8 + x AS position, CAST(CASE WHEN abs(v) < 32 THEN abs(v) ELSE 32 + {_BITS.format(v='(abs(v) - 32)')} END AS INT) AS token FROM quant")
def entropy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda v: S.unsigned_token(F.abs(v))[0]
    rows = _quantised(spark, sf_dir).select("frame", F.transform("coef", token).alias("tokens"))
    counts = models.histogram(rows.select(F.explode("tokens").alias("token")))
    freqs = models.models(counts.withColumn("one", F.lit(1)), "one").first()["freqs"]  # one row of 64
    return coding.uncode_blocks(coding.code_blocks(rows, freqs), freqs).select("frame", F.posexplode("tokens").alias("position", "token"))


@query(f"WITH g AS ({'WITH ' + _GOP}) SELECT user_id, event_id, is_copy, is_key, scene, gop - 0 AS gop, position FROM g")
def gop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's groups by state that goes from batch to batch, run to the end of what is there."""
    events = tables.table(spark, sf_dir, "events")
    live = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    frames = live.select("user_id", "event_id", F.round(F.col("value") * 100).cast("int").alias("v"))
    folder = shared_folder(spark, "gop-stream")
    run = sessions.stream_sessions(frames, SCENE, INTERVAL).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.schema(sessions.SESSIONS).parquet(f"{folder}/out")


#: Transform, quantise and measure: the flagship is the energy of every band of every block.
FLAGSHIP = band_energy
