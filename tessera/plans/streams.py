"""Queries over coded planes, files, packets and live frames, and their SQL twins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import coding, models, ordered
from tessera.operators import planes as P
from tessera.plans.catalogue import COEF, HIGH, INTERVAL, LOW, MIDDLE, PX, SCENE, SERIES, lift_sql, quant_sql, query
from tessera.sources import container, png, tables, y4m
from tessera.sources.shared import shared_folder
from tessera.streaming import sessions

STEPS = (LOW, MIDDLE, HIGH)


def _signed_sql(name: str, source: str, half: int = 4) -> str:
    """Quantised levels with their signs."""
    return f"{name} AS (SELECT frame, y, x, CASE WHEN y >= {half} AND x >= {half} THEN {quant_sql('v', HIGH, 8192)} WHEN y >= {half} OR x >= {half} THEN {quant_sql('v', MIDDLE, 16384)} ELSE {quant_sql('v', LOW, 32768)} END AS v FROM {source})"


_SIGNED = f"{COEF}, {_signed_sql('q', 'coef')}"


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, coef, parent): quantised squares, and those of the transformed low band; every fifth has lost its parent."""

    def fine(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column("frame"), P.lists(P.quantised(P.forward(P.array(b.column("coef"), 8, 8)), STEPS))]

    def coarse(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column("frame"), P.lists(P.quantised(P.forward(P.forward(P.array(b.column("coef"), 8, 8))[:, :4, :4]), STEPS))]

    blocks = tables.blocks(spark, sf_dir)
    parents = P.mapped(blocks.where("frame % 5 <> 0"), "frame long, parent array<long>", coarse)
    return P.mapped(blocks, "frame long, coef array<long>", fine).join(parents, "frame", "left")


# Runs and models

_RUNS = f"""{_SIGNED}, ll AS (SELECT frame, y, x, v FROM coef WHERE y < 4 AND x < 4), {lift_sql('pr', 'll', 'y', 'x', 2)}, {lift_sql('pc', 'pr', 'x', 'y', 2)}, {_signed_sql('parent', 'pc', 2)},
b AS (SELECT frame, CASE WHEN y < 4 THEN 'HL' WHEN x < 4 THEN 'LH' ELSE 'HH' END AS band, y % 4 AS y, x % 4 AS x, v, y // 4 AS gy, x // 4 AS gx FROM q WHERE y >= 4 OR x >= 4),
s AS (SELECT frame, band, CASE WHEN band = 'HL' THEN x * 4 + y ELSE y * 4 + x END AS p, v, gy, gx FROM b),
k AS (SELECT frame, band, p, v, gy, gx, lag(p) OVER (PARTITION BY frame, band ORDER BY p) AS before FROM s WHERE v <> 0),
g AS (SELECT *, coalesce(before, -1) + 1 AS start FROM k),
c AS (SELECT g.frame, g.band, g.p, g.v, g.start, g.before, CASE WHEN g.band = 'HL' THEN start % 4 ELSE start // 4 END AS sy, CASE WHEN g.band = 'HL' THEN start // 4 ELSE start % 4 END AS sx, gy, gx FROM g),
runs AS (SELECT c.frame, c.band, CAST(c.p AS INT) AS position, CAST(c.p - c.start AS INT) AS run, c.v AS value, CAST(CASE WHEN c.frame % 5 <> 0 AND p.v = 0 THEN 2 ELSE 0 END + CASE WHEN c.before IS NULL THEN 0 ELSE 1 END AS INT) AS context
 FROM c JOIN parent p ON p.frame = c.frame AND p.y = c.gy * 2 + c.sy // 2 AND p.x = c.gx * 2 + c.sx // 2)"""


@query(f"WITH {_RUNS} SELECT frame, band, position, run, value, context FROM runs")
def scanned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.square_runs(_squares(spark, sf_dir))


_SIGN_TOKEN = "CAST(CASE WHEN value = 0 THEN 0 WHEN abs(value) <= 15 THEN 2 * abs(value) - 1 + CASE WHEN value < 0 THEN 1 ELSE 0 END WHEN abs(value) = 16 THEN 32 ELSE 32 + length(bin(abs(value) - 16)) END AS INT)"
_TOTALS = f"""{_RUNS}, t AS (SELECT context * 2 AS model, least(run, 63) AS token FROM runs UNION ALL SELECT context * 2 + 1, {_SIGN_TOKEN} FROM runs),
hist AS (SELECT model, token, count(*) AS n FROM t GROUP BY ALL),
grid AS (SELECT c.model, g.token, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT model FROM hist) c CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS token) g LEFT JOIN hist h ON h.model = c.model AND h.token = g.token),
share AS (SELECT model, token, n, CASE WHEN n = 0 THEN 1 ELSE greatest(1, ((16384 - count(*) FILTER (WHERE n = 0) OVER w) * n) // CAST(sum(n) OVER w AS BIGINT)) END AS f FROM grid WINDOW w AS (PARTITION BY model)),
trained AS (SELECT CAST(model AS INT) AS model, token, n, CAST(f + CASE WHEN row_number() OVER (PARTITION BY model ORDER BY f DESC, token) = 1 THEN 16384 - sum(f) OVER (PARTITION BY model) ELSE 0 END AS BIGINT) AS freq FROM share)"""


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the runs and one of the values for each context, from all rows of the table."""
    runs = coding.square_runs(_squares(spark, sf_dir))
    value, _, _ = S.signed_token(F.col("value"))
    both = F.array(F.struct((F.col("context") * 2).alias("model"), F.least("run", F.lit(63)).alias("token")), F.struct((F.col("context") * 2 + 1).alias("model"), value.alias("token")))
    tokens = runs.select(F.explode(both).alias("t")).select("t.model", "t.token")
    return models.models(models.histogram(tokens, "model"), "model")


@query(f"WITH {_TOTALS} SELECT model, token, n, freq FROM trained")
def training_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).select("model", F.posexplode(F.arrays_zip("counts", "freqs")).alias("token", "z")).select("model", "token", F.col("z.counts").alias("n"), F.col("z.freqs").alias("freq"))


@query(f"""WITH {_TOTALS}, bytes AS (SELECT model, token // 8 AS b, lpad(hex(CAST(sum(CASE WHEN freq > 1 THEN 1 << (token % 8) ELSE 0 END) AS BIGINT)), 2, '0') AS h FROM trained GROUP BY model, token // 8),
map AS (SELECT model, string_agg(h, '' ORDER BY b DESC) AS h FROM bytes GROUP BY model),
rest AS (SELECT model, string_agg(CASE WHEN freq < 128 THEN lpad(hex(freq), 2, '0') ELSE lpad(hex(freq | 32768), 4, '0') END, '' ORDER BY token) FILTER (WHERE freq > 1) AS h, sum(token * freq) AS total FROM trained GROUP BY model)
SELECT model, map.h || coalesce(rest.h, '') AS data, CAST(total AS BIGINT) AS back FROM map JOIN rest USING (model)""")
def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coding.code_tables(_trained(spark, sf_dir), "model")
    return coded.select("model", F.hex("data").alias("data"), F.aggregate(F.transform("freqs", lambda f, k: f * k), F.lit(0).cast("long"), lambda s, v: s + v).alias("back"))


@query(f"""WITH {_SIGNED}, z AS (SELECT frame, max(abs(v)) FILTER (WHERE y >= 4 OR x >= 4) <= 3 AND max(abs(v)) FILTER (WHERE y < 4 AND x < 4) = 0 AS zero FROM q GROUP BY frame)
SELECT q.frame // 16 AS plane, CAST(row_number() OVER (PARTITION BY q.frame // 16 ORDER BY q.frame, y, x) - 1 AS INT) AS position, CASE WHEN zero THEN 0 ELSE v END AS v FROM q JOIN z USING (frame)""")
def plane_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen squares a plane, as bytes and back: flags, residuals of the low bands, runs, models, lanes. Squares with next to nothing are cleared before."""

    def kernel(b: pa.RecordBatch) -> list[pa.Array]:
        return [b.column("frame"), P.lists(coding.cleared(P.quantised(P.forward(P.array(b.column("coef"), 8, 8)), STEPS), 8, "luma2"))]

    squares = P.mapped(tables.blocks(spark, sf_dir), "frame long, coef array<long>", kernel)
    planes = squares.groupBy(F.expr("frame div 16").alias("plane")).agg(F.array_sort(F.collect_list(F.struct("frame", "coef"))).alias("all")).select("plane", F.flatten(F.transform("all", lambda s: s["coef"])).alias("squares"))
    return coding.uncode_planes(coding.code_planes(planes, 8), 8).select("plane", F.posexplode("squares").alias("position", "v"))


@query(f"""WITH {SERIES}, w AS (SELECT user_id, event_id, 1 + event_id % 12 AS width, v % (1 << (1 + event_id % 12)) AS v FROM series),
s AS (SELECT user_id, CAST(sum(width) AS BIGINT) AS n_bits, string_agg(lpad(bin(v), CAST(width AS INT), '0'), '' ORDER BY event_id) AS bits, CAST(sum(v) AS BIGINT) AS back FROM w GROUP BY user_id),
p AS (SELECT user_id, n_bits, back, rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INT), '0') AS bits FROM s),
b AS (SELECT user_id, n_bits, back, k, substr(bits, CAST(k * 4 + 1 AS INT), 4) AS nibble FROM (SELECT *, unnest(range(length(bits) // 4)) AS k FROM p))
SELECT user_id, n_bits, back, string_agg(substr('0123456789ABCDEF', CAST(CAST(substr(nibble, 1, 1) AS INT) * 8 + CAST(substr(nibble, 2, 1) AS INT) * 4 + CAST(substr(nibble, 3, 1) AS INT) * 2 + CAST(substr(nibble, 4, 1) AS INT) + 1 AS INT), 1), '' ORDER BY k) AS data FROM b GROUP BY user_id, n_bits, back""")
def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one to twelve bits, packed by user."""
    width = (F.col("event_id") % 12 + 1).cast("int")
    rows = tables.series(spark, sf_dir).select("user_id", "event_id", F.expr("v % shiftleft(1, cast(event_id % 12 + 1 AS int))").alias("v"), width.alias("width"))
    return coding.pack_bits(rows, "user_id", "event_id", "v", "width").select("user_id", "n_bits", F.hex("data").alias("data"), "back")


# Files

_BYTE = "greatest(0, least(255, 128 + v // 4))"


def _hex_bytes(values: Column) -> Column:
    return F.unhex(F.concat_ws("", F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0"))))


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda v: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + 128))
    return tables.blocks(spark, sf_dir).select("frame", F.transform("coef", lambda v: byte(S.div(v, 4))).alias("a"))


@query(f"""WITH {PX}, h AS (SELECT frame, y, x, lpad(hex({_BYTE}), 2, '0') AS h FROM px)
SELECT frame AS frame_no, 8 AS width, 8 AS height, 25 AS fps, string_agg(h, '' ORDER BY y, x) AS y, string_agg(h, '' ORDER BY y, x) FILTER (WHERE y % 2 = 0 AND x % 2 = 0) AS cb, string_agg(h, '' ORDER BY y, x) FILTER (WHERE y % 2 = 1 AND x % 2 = 1) AS cr FROM h GROUP BY frame""")
def y4m_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as Y4M files, a range of frames a file, and read again in slices."""
    spark.dataSource.register(y4m.Y4M)
    part = lambda k: F.filter("a", lambda v, p: (p % 2 == k) & (S.div(p, 8) % 2 == k))
    frames = _bytes(spark, sf_dir).select(F.col("frame").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(25).alias("fps"), _hex_bytes(F.col("a")).alias("y"), _hex_bytes(part(0)).alias("cb"), _hex_bytes(part(1)).alias("cr"))
    path = shared_folder(spark, "y4m")
    frames.repartitionByRange("frame_no").sortWithinPartitions("frame_no").write.format("y4m").mode("append").save(path)
    back = spark.read.format("y4m").option("framesPerTask", 256).load(path)
    return back.select("frame_no", "width", "height", "fps", *(F.hex(c).alias(c) for c in ("y", "cb", "cr")))


@query(f"""WITH {PX}, h AS (SELECT frame, y, x, lpad(hex({_BYTE}), 2, '0') || lpad(hex(255 - {_BYTE}), 2, '0') || lpad(hex(y * 32 + x * 4), 2, '0') || 'FF' AS h FROM px)
SELECT frame AS frame_no, 8 AS width, 8 AS height, string_agg(h, '' ORDER BY y, x) AS rgba FROM h GROUP BY frame""")
def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as PNG files and read again."""
    rgba = F.flatten(F.transform("a", lambda v, p: F.array(v, 255 - v, (p * 4).cast("long"), F.lit(255).cast("long"))))
    pictures = _bytes(spark, sf_dir).select(F.col("frame").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), _hex_bytes(rgba).alias("rgba"))
    folder = shared_folder(spark, "png")
    png.write_pictures(pictures, folder).agg(F.sum("bytes")).collect()  # writes
    return png.read_pictures(spark.read.format("binaryFile").load(f"{folder}/*.png")).withColumn("rgba", F.hex("rgba"))


_VLQ = "CASE WHEN {n} < 128 THEN lpad(hex({n}), 2, '0') ELSE lpad(hex(({n} >> 7) | 128), 2, '0') || lpad(hex({n} & 127), 2, '0') END"


def _part_sql(h: str) -> str:
    return f"({_VLQ.format(n=f'(length({h}) // 2)')} || {h})"


@query(f"""WITH {PX}, h AS (SELECT frame, string_agg(lpad(hex({_BYTE}), 2, '0'), '' ORDER BY y, x) AS h FROM px GROUP BY frame),
p AS (SELECT frame, repeat('02', CAST(frame % 4 AS INT)) AS levels, repeat(h, CAST(frame % 5 AS INT)) AS y, h AS cb, substr(h, 1, CAST(frame % 60 AS INT) * 2) AS cr FROM h)
SELECT frame AS key, lpad(hex(frame % 300), 4, '0') || lpad(hex(frame % 70), 4, '0') || {_part_sql('levels')} || {_part_sql('y')} || {_part_sql('cb')} || {_part_sql('cr')} AS record, y, cr, levels FROM p""")
def layer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as bytes, with lengths of one and two bytes, and read again."""
    frame, h = F.col("frame"), F.concat_ws("", F.transform("a", lambda v: F.lpad(F.hex(v), 2, "0")))
    rows = _bytes(spark, sf_dir).select(frame, h.alias("h")).select(frame.alias("key"), (frame % 300).cast("int").alias("step_y"), (frame % 70).cast("int").alias("step_c"), F.unhex(F.expr("repeat('02', cast(frame % 4 AS int))")).alias("levels"), F.unhex(F.expr("repeat(h, cast(frame % 5 AS int))")).alias("y"), F.unhex("h").alias("cb"), F.unhex(F.expr("substr(h, 1, cast(frame % 60 AS int) * 2)")).alias("cr"))
    records = container.write_layers(rows)
    back = container.read_layers(records, True).select(F.col("key").alias("k"), F.hex("y").alias("y"), F.hex("cr").alias("cr"), F.hex("levels").alias("levels"))
    return records.select("key", F.hex("record").alias("record")).join(back, F.col("key") == F.col("k")).drop("k")


def _count_sql(v: str) -> str:
    for n in (2, 2, 8):
        v = f"(({v} + {n - 1}) // {n})"
    return v


@query(f"SELECT p_partkey AS key, CAST({_count_sql('p_size * 37')} * {_count_sql('(p_partkey % 2000 + 1)')} AS BIGINT) AS vectors FROM part")
def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), container.vector_count(F.col("p_size") * 37, F.col("p_partkey") % 2000 + 1).alias("vectors"))


# Packets and live frames


@query(f"""WITH {PX}, r AS (SELECT 's' || (frame // 35) AS stream_id, CAST(frame % 35 AS BIGINT) AS frame_no, y * 8 + x AS p, CASE frame % 10 WHEN 0 THEN 'I' WHEN 7 THEN 'COPY' ELSE 'P' END AS kind, v FROM px),
g AS (SELECT *, sum(CASE WHEN kind = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, p ORDER BY frame_no) AS gop FROM r),
d AS (SELECT stream_id, frame_no, p, gop, sum(CASE WHEN kind = 'COPY' THEN 0 ELSE v END) OVER (PARTITION BY stream_id, gop, p ORDER BY frame_no) AS v FROM g)
SELECT stream_id, frame_no, CASE WHEN any_value(gop) = 0 THEN 'no reference' END AS problem, CASE WHEN any_value(gop) > 0 THEN CAST(sum(v * (p + 1)) AS BIGINT) END AS picture FROM d GROUP BY stream_id, frame_no""")
def decoded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of 35 packets, some of which begin inside a group; each picture as a sum weighted by place."""
    frame = F.col("frame")
    kind = F.when(frame % 10 == 0, "I").when(frame % 10 == 7, "COPY").otherwise("P")
    packets = tables.blocks(spark, sf_dir).select(F.concat(F.lit("s"), F.expr("frame div 35").cast("string")).alias("stream_id"), (frame % 35).cast("long").alias("frame_no"), kind.alias("kind"), F.when(kind != "COPY", F.col("coef")).alias("samples"))
    total = F.aggregate(F.transform("picture", lambda v, p: v * (p + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return sessions.decode_groups(packets).select("stream_id", "frame_no", "problem", total.alias("picture"))


_ORDERED = f"{SERIES}, n AS (SELECT s.user_id, s.event_id, s.v, CASE WHEN e.event_type = (SELECT min(event_type) FROM events) AND s.event_id % 5 = 0 THEN 1 ELSE 0 END AS forced, row_number() OVER (PARTITION BY s.user_id ORDER BY s.event_id) AS k FROM series s JOIN events e USING (event_id))"


def _key_sql(last: str, since: str, mean: str, distortion: str, join: str) -> str:
    change = f"CASE WHEN {since} = 0 THEN 0 ELSE abs(n.v - {last}) END"
    drifts = f"(0 < {mean} * 2 AND {mean} * 2 < {distortion} AND {distortion} > 32)"
    reason = f"CASE WHEN {since} = 0 THEN 'first' WHEN {change} > {SCENE} THEN 'cut' WHEN n.forced = 1 THEN 'forced' WHEN {since} >= {INTERVAL} THEN 'due' WHEN {drifts} THEN 'drift' END"
    return f"""SELECT n.user_id, n.event_id, n.k, {reason} AS reason, {drifts} AS drifts, n.v AS last, CASE WHEN ({reason}) IS NOT NULL THEN 1 ELSE {since} + 1 END AS since,
 CASE WHEN {mean} = 0 THEN ({change}) // 100 ELSE ({mean} * 7 + ({change}) // 100) // 8 END AS mean, ({change}) // 100 AS distortion FROM {join}"""


@query(f"""WITH RECURSIVE {_ORDERED}, f AS ({_key_sql('0', '0', '0', '0', 'n WHERE n.k = 1')} UNION ALL {_key_sql('f.last', 'f.since', 'f.mean', 'f.distortion', 'f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1')})
SELECT user_id, event_id, reason IS NOT NULL AS is_key, reason, drifts FROM f""")
def key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type").alias("least"))
    forced = ((F.col("event_type") == F.col("least")) & (F.col("event_id") % 5 == 0)).cast("int")
    rows = events.join(F.broadcast(least)).select("user_id", "event_id", F.round(F.col("value") * 100).cast("int").alias("v"), forced.alias("forced"))  # one row
    return sessions.key_frames(rows, SCENE, INTERVAL)


RATE = sessions.RateConfig(1_000_000, 30, INTERVAL, 16)
_LOW, _HIGH = max(1, RATE.base), max(RATE.base * 2, min(512, RATE.base * 4))


def _between(v: str) -> str:
    return f"greatest({_LOW}, least({_HIGH}, {v}))"


def _ratio_sql(a: str, b: str) -> str:
    return f"greatest({sessions.RATIO_LIMITS[0]}, least({sessions.RATIO_LIMITS[1]}, (({a}) << 16) // greatest(1, {b})))"


_FIELDS = ("lft", "target", "frames", "mean_sad", "bits", "step", "sad", "mean_distortion", "distortion")


def _rate_sql(state: dict[str, str], source: str) -> str:
    """One frame of rate_step() from the state's expressions."""
    s, usual = state, RATE.bitrate * RATE.interval // RATE.rate
    head = ", ".join(f"{s[f]} AS s_{f}" for f in _FIELDS)
    return f"""SELECT user_id, event_id, k, CASE WHEN is_key THEN new_target - new_share ELSE s_lft - n_bits END AS lft, CASE WHEN is_key THEN new_target ELSE s_target END AS target, CASE WHEN is_key THEN {RATE.interval - 1} ELSE s_frames - 1 END AS frames,
 CASE WHEN is_key THEN s_mean_sad ELSE mean END AS mean_sad, CASE WHEN is_key THEN s_bits ELSE n_bits END AS bits, CASE WHEN is_key THEN s_step ELSE n_step END AS step, CASE WHEN is_key THEN s_sad ELSE n_sad END AS sad,
 CASE WHEN is_key THEN s_mean_distortion WHEN s_mean_distortion = 0 THEN n_sad // 64 ELSE (s_mean_distortion * 7 + n_sad // 64) // 8 END AS mean_distortion, CASE WHEN is_key THEN s_distortion ELSE n_sad // 64 END AS distortion,
 CASE WHEN is_key THEN new_share ELSE share END AS out_share, CASE WHEN is_key THEN {RATE.base} ELSE n_step END AS out_step
 FROM (SELECT *, n_sad * 8 // n_step AS n_bits FROM (SELECT *, {_between('step3')} AS n_step FROM (SELECT *, CASE WHEN s_step > 0 AND mean > 0 THEN {_between('(step2 * weight + s_step * (65536 - weight)) >> 16')} ELSE step2 END AS step3
 FROM (SELECT *, greatest(CASE WHEN change < 32768 THEN {sessions.FALLING} ELSE {sessions.STEADY} END, least(65536, change)) AS weight FROM (SELECT *, CASE WHEN mean > 0 THEN (n_sad << 16) // mean ELSE 0 END AS change,
 CASE WHEN s_distortion > 0 AND s_mean_distortion > 0 THEN {_between('(step1 + step1 * s_mean_distortion // s_distortion) // 2')} ELSE step1 END AS step2
 FROM (SELECT *, CASE WHEN s_bits > 0 AND s_step > 0 AND s_sad > 0 THEN {_between(f"s_step * ((s_bits * {_ratio_sql('n_sad', 's_sad')}) >> 16) // greatest(1, share)")} ELSE {RATE.base * 3 // 2} END AS step1
 FROM (SELECT *, (greatest(s_target // 50, s_lft // greatest(1, s_frames)) * {_ratio_sql('n_sad', 'mean')}) >> 16 AS share, greatest(1000, {RATE.bitrate * 6 // RATE.rate}, new_target * 5 // {RATE.interval + 4}) AS new_share
 FROM (SELECT *, (CASE WHEN s_mean_sad = 0 THEN n_sad ELSE s_mean_sad END * 4 + n_sad) // 5 AS mean, {usual} + least({usual}, greatest(0, s_lft)) AS new_target
 FROM (SELECT n.user_id, n.event_id, n.k, n.is_key, n.sad AS n_sad, {head} FROM {source})))))))))"""


_GOPS = f"""{SERIES},
d AS (SELECT *, CASE WHEN coalesce(abs(v - lag(v) OVER w) > {SCENE}, false) THEN 1 ELSE 0 END AS cut FROM series WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS scene FROM d),
p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, scene ORDER BY event_id) - 1) % {INTERVAL} = 0 AS is_key FROM c),
n AS (SELECT user_id, event_id, is_key, CAST(abs(v - coalesce(lag(v) OVER w, v)) AS BIGINT) AS sad, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""WITH RECURSIVE {_GOPS}, f AS ({_rate_sql(dict.fromkeys(_FIELDS, 'CAST(0 AS BIGINT)'), 'n WHERE n.k = 1')} UNION ALL {_rate_sql({x: f'f.{x}' for x in _FIELDS}, 'f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1')})
SELECT user_id, event_id, CAST(out_share AS BIGINT) AS share, CAST(out_step AS BIGINT) AS step FROM f""")
def rate_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as frames; a frame's change is its difference to the one before."""
    w = W.partitionBy("user_id").orderBy("event_id")
    series = tables.series(spark, sf_dir)
    changes = series.select("user_id", "event_id", F.abs(F.col("v") - F.coalesce(F.lag("v").over(w), F.col("v"))).cast("long").alias("sad"))
    groups = ordered.segments(series, "user_id", "event_id", "v", SCENE, INTERVAL).select("user_id", "event_id", "is_key")
    return sessions.rate_steps(groups.join(changes, ["user_id", "event_id"]), RATE)
