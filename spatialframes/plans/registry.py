"""Named queries over the driver tables, each next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    """A derived table in SQL; it may use views declared before it."""
    VIEWS[name] = text


def with_views(names: tuple[str, ...], body: str) -> str:
    if not names and not body.strip().startswith(","):
        return body
    wanted = set(names)
    # a view may use earlier views, so close over the names its text mentions
    for name in reversed(list(VIEWS)):
        if name in wanted:
            wanted |= {other for other in VIEWS if other != name and f"v_{other}" in VIEWS[name]}
    parts = [f"v_{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted]
    body = body.strip()
    if body.startswith(","):
        return "WITH " + ", ".join(parts) + body if parts else "WITH " + body[1:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, sql: str | None = None, views: tuple[str, ...] | None = None):
    """Register a query; the SQL names derived tables as ``v_<view>``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            used = views if views is not None else tuple(v for v in VIEWS if f"v_{v}" in sql)
            ORACLES[name] = with_views(used, sql)
        return fn

    return register
