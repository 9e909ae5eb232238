import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import blocks as B
from tessera.operators import coding, fidelity, models, ordered, planes, search
from tessera.sources import container as C
from tessera.sources import png, y4m
from tessera.streaming import sessions


@pytest.mark.parametrize("side", [8, 16])
def test_transform_is_lossless(spark, side):
    rng = random.Random(side)
    rows = [(k, [rng.randint(-1000, 1000) for _ in range(side * side)]) for k in range(5)]
    df = spark.createDataFrame(rows, "frame long, coef array<int>")
    back = df.select("frame", B.inverse(B.forward(F.col("coef"), side), side).alias("coef"))
    assert {r.frame: r.coef for r in back.collect()} == dict(rows)


@pytest.mark.parametrize("step", [1, 4, 13, 128])
def test_quantisation_error_is_bounded(spark, step):
    rng = random.Random(step)
    values = [(rng.randint(-32767, 32767),) for _ in range(300)] + [(0,), (32767,), (-32767,)]
    df = spark.createDataFrame(values, "v int")
    q = S.quantise(F.col("v"), step)
    rows = df.select("v", S.dequantise(q, step).alias("back"), S.unzigzag(S.zigzag(q)).alias("again"), q.alias("q")).collect()
    # the reciprocal has 16 bits, so large values lose up to their share of its rounding
    assert all(abs(r.v - r.back) <= step + 1 + abs(r.v) * step // 65536 and r.again == r.q for r in rows)


def test_tokens_come_back(spark):
    values = [(v,) for v in [*range(-40, 41), 255, -256, 32767, -32767]]
    df = spark.createDataFrame(values, "v long")
    token, bypass, _ = S.signed_token(F.col("v"))
    assert all(r.v == r.back and 0 <= r.t < 64 for r in df.select("v", token.alias("t"), S.signed_value(token, bypass).alias("back")).collect())
    token, bypass, _ = S.unsigned_token(F.abs("v"))
    assert all(abs(r.v) == r.back for r in df.select("v", S.unsigned_value(token, bypass).alias("back")).collect())


def test_models_add_up(spark):
    rng = random.Random(2)
    rows = [(g, t, 1 if g == 0 else rng.choice([1, 5, 60000])) for g in range(4) for t in range(0, 64, 1 + g)]
    found = models.models(spark.createDataFrame(rows, "g int, token int, n long"), "g").collect()
    assert all(sum(r.freqs) == models.SCALE and min(r.freqs) >= 1 for r in found)
    assert models.rows_of(models.models(spark.createDataFrame(rows, "g int, token int, n long"), "g"), "g").where("token = 0 and cum <> 0").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=300), st.lists(st.integers(1, 60), min_size=64, max_size=64))
def test_coding_is_reversible(symbols, weights):
    freqs = [1 + w * (models.SCALE - 64) // sum(weights) for w in weights]
    freqs[0] += models.SCALE - sum(freqs)
    cums = [sum(freqs[:k]) for k in range(64)]
    table = [s for s, f in enumerate(freqs) for _ in range(f)]
    assert coding.decode(coding.encode(symbols, freqs, cums), len(symbols), freqs, cums, table) == symbols


@given(st.lists(st.integers(0, 4), max_size=400))
def test_level_runs_are_reversible(levels):
    assert coding.unpack_levels(coding.pack_levels(levels), len(levels)) == levels


@given(st.integers(0, 2**35 - 1))
def test_variable_lengths(value):
    data = C.variable_length(value)
    assert C.read_variable_length(b"x" + data, 1) == (value, 1 + len(data))


def test_layer_records():
    record = C.layer_record(7, 300, b"ab", (b"y" * 200, b"", b"cr"))
    assert C.read_layer_record(record, True) == (7, 300, b"ab", (b"y" * 200, b"", b"cr"))
    for k in range(len(record)):
        with pytest.raises(C.BadStream):
            C.read_layer_record(record[:k], True)


def test_truncated_streams(spark):
    packets = spark.createDataFrame([("a", 0, "I", None, None, b"1", b"22", b"333"), ("a", 1, "COPY", None, None, None, None, None), ("a", 2, "P", b"m", b"d", b"4", None, b"5")], C.PACKETS)
    (row,) = C.write_streams(packets, 64, 48, 30).collect()
    data = bytes(row.data)
    whole = list(C.cut_stream(data))
    assert [k for _, k, _ in whole] == ["I", "COPY", "P"] and whole[2][2] == (b"m", b"d", b"4", None, b"5")
    assert C.read_header(data)[:3] == (64, 48, 30)
    ends = {16, 16 + 21 + 6, 16 + 21 + 6 + 1, len(data)}
    for k in range(len(data)):
        if k in ends:
            assert len(list(C.cut_stream(data[:k]))) == sorted(ends).index(k)
        else:
            with pytest.raises(C.BadStream):
                list(C.cut_stream(data[:k]))
            if k > 16:
                assert len(list(C.cut_stream(data[:k], strict=False))) < 4
    assert C.keep_layers(packets, 0).where("layer1 is not null or layer2 is not null").count() == 0
    assert tuple(C.dropped_bytes(packets, 1).first()) == (3, 6, 4)
    with pytest.raises(ValueError):
        C.keep_layers(packets, 3)


def test_projection_is_column_pruning(spark, tmp_path):
    packets = spark.createDataFrame([("a", 0, "I", None, None, b"1", b"22", b"333")], C.PACKETS)
    packets.write.parquet(str(tmp_path / "p"))
    plan = C.keep_layers(spark.read.parquet(str(tmp_path / "p")), 0)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "layer0" in schema and "layer2" not in schema


def test_y4m_files(spark, tmp_path):
    spark.dataSource.register(y4m.Y4M)
    rng = random.Random(1)
    frames = [(k, 3, 3, 25, rng.randbytes(9), rng.randbytes(4), rng.randbytes(4)) for k in range(7)]
    path = str(tmp_path / "clip.y4m")
    df = spark.createDataFrame(frames, y4m.SCHEMA)
    df.coalesce(1).sortWithinPartitions("frame_no").write.format("y4m").mode("append").save(path)
    back = spark.read.format("y4m").option("framesPerTask", 2).load(path)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r[:4]) + tuple(map(bytes, r[4:])) for r in back.collect()) == frames
    with open(path, "rb+") as f:
        f.truncate(60)
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("y4m").load(path).collect()
    for head in (b"YUV4MPEG W1 H1\n", b"YUV4MPEG2 W0 H1\n", b"YUV4MPEG2 W1 H1"):
        with pytest.raises(ValueError):
            y4m.parse_header(head)
    assert y4m.parse_header(b"YUV4MPEG2 W5 H3\n")[:4] == (5, 3, 30, 1)


RATE = sessions.RateConfig(1_000_000, 30, 15, 16)


def test_rate_steps_by_hand():
    state, found = sessions.rate_step(None, (True, 0, 100_000, None), RATE)
    # 15 of 30 frames a second have 500,000 bits; the key frame's share is above six frames' 200,000
    assert found == (200_000, 16) and state.target == 500_000 and (state.left, state.frames) == (400_000, 14)
    state, found = sessions.rate_step(state, (False, 1000, 20_000, 10), RATE)
    assert found == (28_571, 24) and state == (380_000, 500_000, 13, 1000, 20_000, 24, 1000, 10, 10)
    # the change doubled, to 1.666 of its mean: a share of 380,000 // 13 = 29,230 becomes 48,716; 24 * 40,000 // 48,716 = 19; content that changes takes the new step whole
    state, found = sessions.rate_step(state, (False, 2000, 50_000, 100), RATE)
    assert found == (48_716, 19)
    assert (state.left, state.frames, state.mean_sad) == (330_000, 12, 1200)
    assert sessions.drifting(10, 100) and not sessions.drifting(50, 100) and not sessions.drifting(0, 100) and not sessions.drifting(10, 32)
    state, _ = sessions.rate_step(state, (True, 0, None, None), RATE)
    assert state.target == 830_000 and state.left == 830_000 - max(200_000, 830_000 * 5 // 19)


def test_rates_of_a_table_and_of_a_stream_agree(spark, tmp_path):
    import uuid

    rng = random.Random(6)
    rows = [(u, k, k % 9 == 0, rng.choice([0, 50, 900, 4000])) for k in range(60) for u in (1, 2, None)]
    schema = "user_id long, event_id long, is_key boolean, sad long"
    want, state = {}, {}
    for u, k, is_key, sad in rows:
        state[u], found = sessions.rate_step(state.get(u), (is_key, sad, None, None), RATE)
        want[u, k] = found
    table = sessions.rate_steps(spark.createDataFrame(rows, schema).repartition(3), RATE)
    assert {(r.user_id, r.event_id): (r.share, r.step) for r in table.collect()} == want
    source = str(tmp_path / "in")
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).where("user_id is not null")
    name = f"r{uuid.uuid4().hex}"
    q = sessions.stream_rate_steps(live, RATE).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.event_id): (r.share, r.step) for r in spark.table(name).collect()} == {k: v for k, v in want.items() if k[0] is not None}
    assert len(q.recentProgress) >= 2


def test_key_frames_have_their_reasons():
    state, reasons = None, []
    for frame in [(100, 0), (100, 0), (9000, 0), (9000, 1), *[(9000, 0)] * 3, (9100, 0), (12000, 0), (12100, 0)]:
        state, (_, reason, _) = sessions.key_step(state, frame, 5000, 4)
        reasons.append(reason)
    assert reasons[:4] == ["first", None, "cut", "forced"] and "due" in reasons
    drifted = sessions.Keys(0, 1, 10, 90)
    assert sessions.key_step(drifted, (0, 0), 5000, 4)[1] == (True, "drift", True)


def test_groups_are_decoded_from_their_key_frames(spark):
    rows = [("a", 0, "P", [1, 1]), ("a", 1, "COPY", None), ("a", 2, "I", [5, 6]), ("a", 3, "P", [1, -1]), ("a", 4, "COPY", None), ("a", 5, "I", [0, 0]), ("b", 0, "COPY", None)]
    got = {(r.stream_id, r.frame_no): (r.picture, r.problem) for r in sessions.decode_groups(spark.createDataFrame(rows, "stream_id string, frame_no long, kind string, samples array<int>")).collect()}
    lost = (None, "no reference")
    assert got == {("a", 0): lost, ("a", 1): lost, ("a", 2): ([5, 6], None), ("a", 3): ([6, 5], None), ("a", 4): ([6, 5], None), ("a", 5): ([0, 0], None), ("b", 0): lost}


def test_stream_keeps_state_between_batches(spark, tmp_path):
    import uuid

    rng = random.Random(4)
    rows = [(k % 3, k, rng.choice([100, 100, 9000])) for k in range(120)]
    want, state = {}, {}
    for user, event, v in rows:
        state[user], want[event] = sessions.step(state.get(user), v, 5000, 7)
    source = str(tmp_path / "in")
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], "user_id long, event_id long, v int").coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema("user_id long, event_id long, v int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    name = f"s{uuid.uuid4().hex}"
    q = sessions.stream_sessions(live, 5000, 7).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: tuple(r[2:]) for r in spark.table(name).collect()}
    assert got == want and len(q.recentProgress) >= 3


def test_small_groups(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 5)], "u long, t long, v int")
    assert ordered.zero_runs(df, "u", "t", "v").collect()[0]["run"] == 0
    assert {(r.u, r.lane) for r in ordered.lanes(df, "u", "t").collect()} == {(1, 0), (1, 1), (2, 0)}
    values = spark.createDataFrame([(float(v), v) for v in range(11)], "v double, frame long")
    row = fidelity.summary(values, "v").first()
    assert (row.n, row.p50, row.p90) == (11, 5.0, 9.0)
    assert sorted((r.v, r.first, r["last"]) for r in fidelity.ranked(values.union(values.where("v < 3")), "v").collect()) == [(0, 0, 1), (1, 2, 3), (2, 4, 5), *((v, v + 3, v + 3) for v in range(3, 11))]
    equal = spark.range(500).selectExpr("100.0D as v", "id as frame")
    row = fidelity.summary(equal, "v").first()
    assert (row.n, row.p50, row.p90, row.least) == (500, 100.0, 100.0, 100.0)


def test_counts_over_the_table_have_no_cap(spark):
    tokens = spark.range(150_000).select((F.col("id") % 2).alias("ctx"), F.when(F.col("id") < 140_000, 0).otherwise(1).alias("token"))
    assert {tuple(r) for r in models.histogram(tokens, "ctx").collect()} == {(c, t, n) for c in (0, 1) for t, n in ((0, 70_000), (1, 5_000))}
    assert {tuple(r) for r in models.plane_histogram(tokens, "ctx").collect()} == {(c, t, n) for c in (0, 1) for t, n in ((0, 65_535), (1, 5_000))}
    assert {r.counts[0] for r in models.models(models.histogram(tokens, "ctx"), "ctx").collect()} == {70_000}


def test_runs_of_groups_without_values_come_back(spark):
    rows = spark.createDataFrame([(g, p, v) for g, line in enumerate(([0, 0, 0, 0], [0, 5, 0, 0], [1, 0, 0, 2])) for p, v in enumerate(line)], "g long, p int, v long")
    back = ordered.expand_runs(ordered.zero_runs(rows, "g", "p", "v"), rows.select("g").distinct(), "g", "p", 4)
    assert sorted(tuple(r) for r in back.collect()) == sorted((r.g, r.p, r.v) for r in rows.collect())


@pytest.mark.parametrize("n", [0, 1, 32, 33, 700])
@pytest.mark.parametrize("trailing", [0, 9])
def test_pair_streams(n, trailing):
    rng = random.Random(n)
    pairs = [(rng.choice([0, 0, 1, 31, 32, 33, 400]), rng.choice([-1, 1, 15, 16, -16, 17, 64, -32767]), rng.randrange(coding.CONTEXTS)) for _ in range(n)]
    for select in (coding.cheapest, lambda runs, values: ("own", [coding.Model.of(c) for c in runs], [coding.Model.of(c) for c in values])):
        data = coding.encode_pairs(pairs, b"flags", 3, trailing, select)
        reader = coding.PairReader(data)
        assert (reader.flags, reader.count) == (b"flags", 3)
        assert [(*reader.pair(c), c) for _, _, c in pairs] == pairs
        if n > coding.FEW:
            assert reader.rest() == trailing
            with pytest.raises(ValueError):
                reader.pair(0)
    for k in range(len(data) - 1) if n == 33 else ():
        try:
            cut = coding.PairReader(data[:k])
            for _, _, c in pairs:
                cut.pair(c)
        except ValueError:
            pass


@pytest.mark.parametrize("side", [8, 16, 32])
def test_squares_come_back(side):
    rng = np.random.default_rng(side)
    squares = rng.integers(-300, 300, (12, side, side)) * (rng.random((12, side, side)) < 0.15)
    squares[[2, 3]] = 0
    squares[5, : side // 2, : side // 2] = 0
    parents = rng.integers(-2, 3, (12, side // 2, side // 2))
    assert (coding.decode_squares(coding.encode_squares(squares), side) == squares).all()
    assert (coding.decode_squares(coding.encode_squares(squares, parents), side, parents) == squares).all()
    small = np.where(np.abs(squares) > 3, 0, squares)
    gone = coding.cleared(small, 8, "luma2")
    assert all((g == 0).all() or s[: side // 2, : side // 2].any() for g, s in zip(gone, small, strict=True))


def test_models_in_python_are_those_in_columns(spark):
    rng = random.Random(3)
    counts = [[rng.choice([0, 0, 1, 7, 900, 60_000]) for _ in range(64)] for _ in range(20)] + [[0] * 64, [1] * 64]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(counts)], "k int, counts array<long>")
    rows = df.withColumn("freqs", models.normalise(F.col("counts"))).withColumn("cost", models.bit_cost(F.col("counts"), F.col("freqs"))).withColumn("head", models.header_bits(F.col("freqs"))).collect()
    for r in rows:
        model = coding.Model.of(r.counts)
        assert model.freqs == r.freqs and model.bits(r.counts) == r.cost and len(model.table()) * 8 == r.head
        assert coding.Model.read_table(b"x" + model.table(), 1)[0].freqs == model.freqs


def test_pictures():
    rng = np.random.default_rng(7)
    lines = rng.integers(0, 256, (5, 4 * 6), dtype=np.uint8)
    assert png.decode(png.encode(6, 5, lines.tobytes())) == (6, 5, lines.tobytes())
    # every filter, by its definition
    above, body = np.zeros(24, int), b""
    for kind, line in enumerate(lines.astype(int)):
        left, corner = np.concatenate([[0] * 4, line[:-4]]), np.concatenate([[0] * 4, above[:-4]])
        near = [min((a, b, c), key=lambda n: abs(a + b - c - n)) for a, b, c in zip(left.tolist(), above.tolist(), corner.tolist(), strict=True)]
        guess = [0, left, above, (left + above) // 2, np.array(near)][kind]
        body += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    head = struct.pack(">IIBBBBB", 6, 5, 8, 6, 0, 0, 0)
    data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(body)[:20]) + png._chunk(b"IDAT", zlib.compress(body)[20:]) + png._chunk(b"IEND", b"")
    assert png.decode(data) == (6, 5, lines.tobytes())
    for damaged in (data[:20], b"x" + data, data[:40] + b"\0\0" + data[42:]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            png.decode(damaged)


def test_mirrored_and_replicated_places():
    at = np.array([-3, -1, 0, 4, 5, 6, 9, 12])
    assert planes.replicated(at, 5).tolist() == [0, 0, 0, 4, 4, 4, 4, 4]
    assert planes.mirrored(at, 5).tolist() == [3, 1, 0, 4, 4, 3, 0, 0]


def test_plan_has_each_block_once(spark):
    from tessera.plans import registry

    plan = registry.QUERIES["dpcm_med"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") <= 1


def test_initial_steps():
    assert planes.initial_step(1, 100, 100, 10**9) == 1 and planes.initial_step(10**6, 1, 10**6, 1) == 256
    assert planes.initial_step(5_000, 64, 64, 50_000) == 64 * 5_000 * 78 // 5_000_000


def test_streams_as_files(spark, tmp_path):
    rows = [(s, n, "COPY", None, None, None, None, None) if n % 4 == 3 else (s, n, "I" if n == 0 else "P", None if n == 0 else b"mv", b"d" if n == 2 else None, bytes([n]) * 50, None, b"x" * n or None) for s in ("a", "b") for n in range(9)]
    files = C.write_files(spark.createDataFrame(rows, C.PACKETS).repartition(3), f"file://{tmp_path}/out", 16, 8, 30)
    sizes = {r.stream_id: r.bytes for r in files.collect()}
    assert all((tmp_path / "out" / f"{s}.stream").stat().st_size == n for s, n in sizes.items())
    plain = lambda df: sorted((r[0], r[1], r[2], *(None if p is None else bytes(p) for p in r[3:])) for r in df.collect())
    assert plain(C.read_files(files, batch_bytes=200)) == plain(spark.createDataFrame(rows, C.PACKETS))
    data = (tmp_path / "out" / "a.stream").read_bytes()
    whole = list(C.cut_stream(data))
    for k in range(17, len(data), 7):
        got = list(C.cut_file(pa.BufferReader(data[:k]), strict=False))
        assert got == whole[: len(got)] == list(C.cut_stream(data[:k], strict=False))
    checked = C.checked_streams(spark.createDataFrame([("a", data), ("b", data[:-1]), ("c", b"no")], "stream_id string, data binary"))
    assert sorted(tuple(r) for r in checked.collect()) == [("a", 9, None), ("b", 8, "a packet is cut off"), ("c", 0, "no magic")]


def test_y4m_stream_takes_few_frames_a_batch(spark, tmp_path):
    spark.dataSource.register(y4m.Y4M)
    frames = [(k, 2, 2, 25, bytes([k] * 4), b"u", b"v") for k in range(7)]
    path = str(tmp_path / "clip.y4m")
    spark.createDataFrame(frames, y4m.SCHEMA).coalesce(1).sortWithinPartitions("frame_no").write.format("y4m").mode("append").save(path)
    with open(path, "rb+") as f:
        f.seek(0, 2)
        f.truncate(f.tell() - 3)  # the last frame is still being written
    q = spark.readStream.format("y4m").option("framesPerBatch", 2).load(path).writeStream.format("memory").queryName("y4m_live").start()
    try:
        q.processAllAvailable()
        got = sorted((r.frame_no, bytes(r.y)) for r in spark.table("y4m_live").collect())
        assert got == [(k, bytes([k] * 4)) for k in range(6)]
        assert max(p["numInputRows"] for p in q.recentProgress) <= 2
    finally:
        q.stop()


def test_previous_frames_over_the_edges_of_runs(spark):
    blocks = spark.createDataFrame([(k, [k, k]) for k in range(25) if k != 13], "frame long, coef array<int>")
    got = {r.frame: r.before for r in search.with_previous(blocks, 4).collect()}
    assert got == {k: None if k in (0, 14) else [k - 1] * 2 for k in range(25) if k != 13}


@pytest.mark.parametrize("median", [False, True])
def test_searched_motion(median):
    y, x = np.indices((48, 48))
    scene = (60 * np.sin(x / 7) + 50 * np.cos(y / 9) + 30 * np.sin((x + y) / 11)).round().astype(np.int64) * 8
    before, now = scene[4:36, 4:36], scene[6:38, 3:35]  # the picture goes two rows up and one column to the right
    field = planes.searched_field(now, before, 8, 6, median=median)
    # the median of a first row, whose upper neighbours count as standing still, is a poor guess
    inner = field.reshape(4, 4, 3)[int(median) : -1, 1:]
    assert (inner[..., 0] == 8).all() and (inner[..., 1] == -4).all() and (inner[..., 2] == 0).all()
    # never worse than standing still, never better than the whole window of whole samples where nothing is refined
    rng = np.random.default_rng(1)
    noise, other = rng.integers(-200, 200, (2, 32, 32))
    field = planes.searched_field(noise, other, 8, 3, median=median)
    dx, dy, least = planes.best_vectors(noise[None], other[None], 8, 3)
    still = np.abs(noise - other).reshape(4, 8, 4, 8).sum((1, 3)).reshape(-1)
    assert (field[:, 2] <= still + 8).all()
    whole = (field[:, :2] % 4 == 0).all(1)
    assert (field[whole, 2] >= least[0][whole]).all()
    # nearly equal planes stand still; a large error asks the field before
    assert (planes.searched_field(noise, noise, 8, 3) == 0).all()
    last = np.zeros((16, 3), np.int64)
    last[:, 0], last[:, 1] = dy[0] * 4, dx[0] * 4
    assert planes.searched_field(noise, other, 8, 3, last, median)[:, 2].sum() <= field[:, 2].sum()
