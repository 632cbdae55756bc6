"""Registry of queries, and the SQL that reads the tables the way the adapters do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SAMPLES = "s AS (SELECT user_id AS session, event_id AS seq, epoch_us(ts)::BIGINT AS t_us, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, event_type AS marker, value AS v FROM events)"
VECTORS = "e AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(16)) + " FROM embeddings)"
FRAMES = "f AS (SELECT l_orderkey AS frame, l_linenumber AS marker, l_extendedprice / 10000e0 AS x, l_quantity / 10e0 AS y, l_discount * 10e0 AS z, l_linenumber * 0.1e0 AS s FROM lineitem)"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
