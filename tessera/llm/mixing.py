"""Mixing sources to target weights by Poisson replication.

A source of size s, of the S in all, with target weight w is repeated w * S / s times on average. Each
document's count is drawn from a Poisson distribution with that mean by inversion of a uniform number that
is hashed from the seed and the document; nothing depends on partitions, retries or order. The copies go
out in the order of another hash, dealt by range, which is a global shuffle of the corpus.

A mean above ``PART`` is split into equal parts, each inverted with a number of its own, since exp(-mean)
would vanish; the sum of the parts has the same distribution.

Defined results: a null source is a source of its own, named by null; null texts count no characters; a source
without characters, or with target weight 0, is not in the mixture; repeated rows draw the same
count each, and equal places in the order are taken by doc_id; a row without doc_id is told from others by its text and source; a text of any length is
one row; an empty table gives an empty table; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, tasks, unused

#: Largest mean that is inverted in one piece, and how many counts its table has: beyond them lies less than 2^-53.
PART, TABLE = 16.0, 80
#: A table of rates with as many sources at most is broadcast; a larger one is joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 16


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 32 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, size, rate): the mean repetitions of each source. Without ``weights`` a source's target is in proportion to its size to ``power``."""
    size = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")).where("size > 0")
    size = cut(size)
    if weights is None:
        wanted = size.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double").where("weight > 0")
        wanted = size.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # as many rows as the caller's dictionary
    all_weight, all_size = wanted.agg(F.sum("weight"), F.sum("size")).first()
    return wanted.select("source", "size", (F.col("weight") / F.lit(all_weight) * F.lit(all_size) / F.col("size")).alias("rate"))


def _tables(found: DataFrame) -> DataFrame:
    """Adds the number of equal parts of each rate, and one part's cumulative probabilities."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = F.col("rate") / F.col("parts")
    steps = F.expr(f"aggregate(sequence(1, {TABLE}), named_struct('p', first, 'c', array(first)), (s, k) -> named_struct('p', s.p * mean / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * mean / k)))).c")
    return found.withColumn("parts", parts).withColumn("mean", mean).withColumn("first", F.exp(-F.col("mean"))).withColumn("cdf", steps).select("source", "rate", "parts", "cdf")


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, seed: int = 7, report: bool = False) -> DataFrame:
    """The mixture, in shuffled order: all columns of ``docs``, or with ``report`` (doc_id, copy, source, rate, shuffle_key)."""
    named, at, rate, parts, cdf, salt, own, count, copy, key = unused(docs, "name", "of_source", "rate", "parts", "cdf", "salt", "own_salt", "count", "copy", "key")
    table = _tables(rates(docs, weights, power)).withColumnsRenamed({"source": at, "rate": rate, "parts": parts, "cdf": cdf})
    source = F.col("source").cast("string")
    # rows without doc_id must not all draw one number
    other = F.concat(F.lit("-"), F.md5(F.concat_ws("|", F.col("text").cast("string"), source)))
    slim = docs.withColumn(named, F.coalesce(F.col("doc_id").cast("string"), other))
    if report:
        slim = slim.select("doc_id", "source", named)
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = slim.join(F.broadcast(table), source.eqNullSafe(F.col(at)))
    else:
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = slim.withColumn(own, F.pmod(F.xxhash64(named), F.lit(SALTS)).cast("int")).join(spread, source.eqNullSafe(F.col(at)) & (F.col(own) == F.col(salt)))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda part: _uniform(F.lit(f"{seed}"), F.col(named), part.cast("string")))
    drawn = joined.withColumn(count, F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(cdf, lambda c: c <= u))))
    copies = drawn.where(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    copies = copies.withColumn(key, F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col(named), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("long"))
    n = tasks(docs)
    # the key is uniform, so equal ranges of it are equal partitions, and no sampling pass is needed
    mixed = copies.repartitionById(n, F.floor(F.col(key) / F.lit(float(1 << 60)) * n).cast("int")).sortWithinPartitions(key, "doc_id")
    if report:
        return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(copy).alias("copy"), source.alias("source"), F.round(rate, 6).alias("rate"), F.col(key).alias("shuffle_key"))
    return mixed.select(*docs.columns)


#: DuckDB SQL for the report of replicate() with its defaults.
ORACLE_SQL = f"""
WITH RECURSIVE
sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source HAVING sum(coalesce(length(text), 0)) > 0),
weighed AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM sizes),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed) / size AS rate FROM weighed),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / {PART})) AS INT) AS parts FROM rates),
steps AS (
  SELECT source, rate, parts, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
  UNION ALL
  SELECT source, rate, parts, k + 1, p * (rate / parts) / (k + 1), c + p * (rate / parts) / (k + 1) FROM steps WHERE k < {TABLE}
),
named AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '-' || md5(concat_ws('|', text, source))) AS name FROM documents),
draws AS (
  SELECT d.doc_id, d.source, d.name, s.rate, s.parts, unnest(range(1, s.parts + 1)) AS part FROM named d JOIN parts s ON d.source IS NOT DISTINCT FROM s.source
),
uniform AS (
  SELECT doc_id, source, name, rate, part, CAST(CAST('0x' || substr(md5(concat_ws('|', '7', name, CAST(part AS VARCHAR))), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u FROM draws
),
counts AS (
  SELECT u.doc_id, u.source, u.name, u.rate, CAST(count(*) AS INT) AS n FROM uniform u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source AND s.c <= u.u GROUP BY u.doc_id, u.source, u.name, u.rate
),
copies AS (SELECT doc_id, source, name, rate, unnest(range(1, n + 1)) AS copy FROM counts)
SELECT doc_id, CAST(copy AS INT) AS copy, source, round(rate, 6) AS rate,
       CAST(CAST('0x' || substr(md5(concat_ws('|', '7 order', name, CAST(copy AS VARCHAR))), 1, 15) AS UBIGINT) AS BIGINT) AS shuffle_key
FROM copies
"""
