"""Register of queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swapledger.plans.views import with_views
from swapledger.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(inventory_id: str, name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``<inventory id>_<name>``."""
    key = f"{inventory_id.lower().replace('-', '_')}_{name}"

    def register(fn: Callable[[Tables], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if oracle is not None:
            # DuckDB rounds small negatives to -0.0, Spark to 0.0: adding 0.0 settles it.
            _ORACLES[key] = re.sub(r", ([2-9])\) as (\w+)", r", \1) + 0.0 as \2", with_views(oracle))
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
