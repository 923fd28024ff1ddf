"""Registered queries: each reads the given tables, applies operators and names its SQL oracle."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``, with DuckDB SQL for the same rows if there is any."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def registry() -> dict:
    return _QUERIES


def oracles() -> dict[str, str]:
    return _ORACLES


from lumenreel.plans import search  # noqa: E402,F401
from lumenreel.plans import texts  # noqa: E402,F401
from lumenreel.plans import series, stores, tabular  # noqa: E402,F401
