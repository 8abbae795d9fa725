"""Register of the queries: name -> Spark query over the driver tables, name -> the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parlance.functions.shipping import ship
from parlance.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` follows ``WITH`` and the view definitions where ``views`` is set."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = (f"WITH RECURSIVE {V.CTE}" if views else "") + sql
        return f

    return add


def told_apart(words: str, key: str, skip: int, more: int) -> str:
    """CTEs ``rare`` and ``good``: rows of ``words(key, w)`` whose equal words are found again. The diff leaves words out that make up over 1 % of 200 or more."""
    n = f"len(w) + {more}"
    return f"""u AS (SELECT {key}, unnest(w[{skip + 1}:]) AS x FROM {words}), rare AS (SELECT {key}, min(c) AS least FROM (SELECT {key}, x, count(*) AS c FROM u GROUP BY ALL) GROUP BY {key}),
good AS (SELECT * FROM {words} JOIN rare USING ({key}) WHERE {n} < 200 OR least <= ({n}) // 100 + 1)"""
