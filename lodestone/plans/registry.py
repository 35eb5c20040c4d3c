"""All queries of the library by name, with the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("sources", "columns", "joins", "retrieval", "beams", "training", "metrics")


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Registers a function of :class:`Views` under ``name``."""

    def add(build: Callable[[Views], DataFrame]):
        assert name not in _FOUND, name
        _FOUND[name] = (lambda spark, sf_dir: build(Views(spark, sf_dir)), sql and with_views(sql, views))
        return build

    return add


def _all() -> dict[str, tuple[Query, str | None]]:
    for m in _MODULES:
        import_module(f"{__package__}.{m}_queries")
    return _FOUND


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided beam search, from vectors to ranked documents."""
    return queries()["beam_lex_guided"](spark, sf_dir)
