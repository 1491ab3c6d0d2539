"""Registry of runnable queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.bindings import DRIVER_TABLES, TABLES, Catalog, catalog, duckdb_sql

#: The fixed "now" and "today" of time-dependent queries, so that runs repeat.
NOW = "1999-06-15T12:00:00+00:00"
TODAY = "1999-06-15"
THIS_YEAR = 1999

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(catalog) -> DataFrame`` and the SQL it must agree with."""
    def register(fn: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(catalog(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if check is not None:
            CHECKS[name] = with_tables(check)
        return fn
    return register


def with_tables(body: str) -> str:
    """Prefix a statement with the catalog projections it mentions.

    ``@name`` in the body marks a catalog table; driver tables are plain names.
    """
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in re.findall(r"\{(\w+)\}", TABLES[name]):
            if other in TABLES:
                visit(other)
        needed.append(name)

    def mention(match: re.Match) -> str:
        name = match.group(1)
        if name in TABLES:
            visit(name)
        elif name not in DRIVER_TABLES:
            raise KeyError(name)
        return name

    body = re.sub(r"(?<=[\s(,])@([a-z_]+)\b", mention, body.strip())
    if not needed:
        return body
    ctes = [f"{n} as materialized ({duckdb_sql(n).strip()})" for n in needed]
    recursive = "recursive " if re.match(r"with\s+recursive\b", body, re.I) else ""
    if re.match(r"with\b", body, re.I):
        rest = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I)
        return f"with {recursive}" + ",\n".join(ctes) + ",\n" + rest
    return "with " + ",\n".join(ctes) + "\n" + body
