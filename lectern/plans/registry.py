"""Queries by key: a function of the corpus, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.oracle import with_views
from lectern.sources.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None, *views: str):
    """Registers a function (corpus) -> DataFrame. sql: its oracle over the derived tables in `views`."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql, *views)
        return f

    return register
