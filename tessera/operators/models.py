"""Token statistics: histograms, normalised models, prefix sums, bit costs and the choice of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S

TOKENS, SCALE, CAP = 64, 16384, 65535


def histogram(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n), partial sums first; all tokens of the table count."""
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def plane_histogram(tokens: DataFrame, *plane: str) -> DataFrame:
    """The histogram of each coded plane, counts capped as in a stream's header."""
    return histogram(tokens, *plane).withColumn("n", F.least("n", F.lit(CAP).cast("long")))


def _packed(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, counts): 64 counts as an array; a group has 64 rows at most."""
    found = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("token").cast("int"), F.col("n").cast("long")))).alias("m"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("counts"))


def normalise(counts: Column) -> Column:
    """64 frequencies that add up to 16384: unused tokens have 1, used ones their share, 1 at least; the largest takes what is missing, and what is too much comes off the largest, one at a time."""

    def shares(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
        room = SCALE - F.size(F.filter(c, lambda x: x == 0))
        return F.when(total == 0, F.transform(c, lambda x: F.lit(SCALE // TOKENS).cast("long"))).otherwise(F.transform(c, lambda x: F.when(x == 0, 1).otherwise(F.greatest(F.lit(1).cast("long"), S.div(room * x, F.greatest(total, F.lit(1)))))))

    def settle(f: Column) -> Column:
        total = F.aggregate(f, F.lit(0).cast("long"), lambda s, x: s + x)
        add = lambda a, d: S.let(F.array_position(a, F.array_max(a)), lambda at: F.transform(a, lambda x, i: F.when(i + 1 == at, x + d).otherwise(x)))
        more = F.when(total < SCALE, add(f, SCALE - total)).otherwise(f)
        return F.aggregate(F.sequence(F.lit(0), F.greatest(total - SCALE, F.lit(0).cast("long"))), more, lambda a, k: F.when(k == 0, a).otherwise(add(a, F.lit(-1).cast("long"))))

    return S.let(counts, lambda c: S.let(shares(c), settle))


def models(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, counts, freqs) of each histogram."""
    return _packed(counts, *keys).withColumn("freqs", normalise(F.col("counts")))


def rows_of(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, freq, cum): a model as rows with exclusive prefix sums."""
    flat = found.select(*keys, F.posexplode("freqs").alias("token", "freq"))
    return flat.withColumn("cum", F.coalesce(F.sum("freq").over(W.partitionBy(*keys).orderBy("token").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def bit_cost(counts: Column, freqs: Column) -> Column:
    """Bits times 256 of coding the counted tokens with a model."""
    return F.aggregate(F.zip_with(counts, freqs, lambda c, f: c * (14 * 256 - S.log2_q8(f))), F.lit(0).cast("long"), lambda s, x: s + x)


def header_bits(freqs: Column) -> Column:
    """Bits of a model's table: a bitmap, and one or two bytes for each frequency above 1."""
    return F.aggregate(freqs, F.lit(64).cast("long"), lambda s, f: s + F.when(f <= 1, 0).when(f < 128, 8).otherwise(16))


def choose(found: DataFrame, key: str) -> DataFrame:
    """Cost of each group with the uniform, the merged and its own model, and the cheapest; ties go in that order. Own and merged models pay for their tables."""
    merged = found.select(F.posexplode("counts").alias("token", "n")).groupBy("token").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    shared = models(merged, "one").select(F.col("freqs").alias("merged"))
    both = found.join(F.broadcast(shared))  # one row
    uniform = F.transform("counts", lambda c: F.lit(SCALE // TOKENS).cast("long"))
    cost = both.select(key, bit_cost(F.col("counts"), uniform).alias("static_cost"), (bit_cost(F.col("counts"), F.col("merged")) + header_bits(F.col("merged")) * 256).alias("merged_cost"), (bit_cost(F.col("counts"), F.col("freqs")) + header_bits(F.col("freqs")) * 256).alias("own_cost"))
    best = F.least("static_cost", "merged_cost", "own_cost")
    return cost.withColumn("model", F.when(F.col("static_cost") == best, "static").when(F.col("merged_cost") == best, "merged").otherwise("own"))


def lookup(slots: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The token of each slot in its model: the interval [cum, cum + freq) that holds it, by expanding each model's 16384 slots into an equi-join."""
    table = rows.select(*keys, "token", F.explode(F.sequence("cum", F.col("cum") + F.col("freq") - 1)).alias("slot"))
    return slots.join(F.broadcast(table), [*keys, "slot"])  # 16384 rows a model
