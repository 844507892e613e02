"""Registry of named queries: SURVEY ids -> ``fn(spark, sf_dir) -> DataFrame``.

Star-schema queries are written against :class:`Tables`; here they are bound to
the test-data adapter, which derives the tables from the driver's parquet
files, so every registered query reads the whole input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statlake.session import ensure_defaults
from statlake.sources.stored import stored
from statlake.sources.tables import Tables
from statlake.sources.testviews import derive

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def star(name: str, staged: bool = False):
    """Register ``fn(Tables) -> DataFrame`` under ``name``; ``staged`` for those that read most tables: each is made once and stored."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            ensure_defaults(spark)
            return _fn(derive(spark, sf_dir, stored) if staged else derive(spark, sf_dir))

        _REGISTRY[name] = run
        return fn

    return deco


def raw(name: str):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Query):
        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            ensure_defaults(spark)
            return _fn(spark, sf_dir)

        _REGISTRY[name] = run
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    from statlake.plans import registered  # noqa: F401  (fills the registry)

    return dict(_REGISTRY)
