"""Where queries and their SQL twins are registered, and SQL pieces that several twins share, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Steps of the low, middle and high bands, the zero limit, the scene threshold and the longest group.
LOW, MIDDLE, HIGH, LIMIT, SCENE, INTERVAL = 4, 8, 12, 100, 5000, 15


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PX = "px AS (SELECT frame, p // 8 AS y, p % 8 AS x, v FROM (SELECT vec_id AS frame, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v, unnest(range(64)) AS p FROM embeddings))"
SERIES = "series AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def lift_sql(name: str, source: str, line: str, along: str, half: int = 4, key: str = "frame") -> str:
    """CTEs that lift every line of ``source`` (key, y, x, v); the result is ``name``."""
    a = lambda i: f"a[{i + 1}]"
    h = ", ".join(f"{a(2 * i + 1)} - (({a(2 * i)} + {a(2 * min(i + 1, half - 1))} + {i % 2}) >> 1) AS h{i}" for i in range(half))
    low = ", ".join(f"{a(2 * i)} + ((h{max(i - 1, 0)} + h{i} + 1 + {i % 2}) >> 2)" for i in range(half))
    return f"""{name}_a AS (SELECT {key}, {line}, list(v ORDER BY {along}) AS a FROM {source} GROUP BY {key}, {line}),
{name}_h AS (SELECT {key}, {line}, a, {h} FROM {name}_a),
{name} AS (SELECT {key}, {line}, unnest(range({2 * half})) AS {along}, unnest([{low}, {", ".join(f"h{i}" for i in range(half))}]) AS v FROM {name}_h)"""


COEF = f"{PX},\n{lift_sql('lr', 'px', 'y', 'x')},\n{lift_sql('coef', 'lr', 'x', 'y')}"
BAND = "CASE WHEN y >= 4 AND x >= 4 THEN 'HH' WHEN y >= 4 THEN 'LH' WHEN x >= 4 THEN 'HL' ELSE 'LL' END"


def quant_sql(v: str, step: int, bias: int) -> str:
    return f"(CASE WHEN {v} < 0 THEN -1 ELSE 1 END * greatest(0, (abs({v}) * {65536 // step} + {bias}) >> 16))"


ZIG = "(CASE WHEN {q} >= 0 THEN 2 * {q} ELSE -2 * {q} - 1 END)"
QUANT = f"""{COEF},
quant AS (SELECT frame, y, x, CASE {BAND} WHEN 'LL' THEN {quant_sql('v', LOW, 32768)} WHEN 'HH' THEN {ZIG.format(q=quant_sql('v', HIGH, 8192))} ELSE {ZIG.format(q=quant_sql('v', MIDDLE, 16384))} END AS v FROM coef)"""
