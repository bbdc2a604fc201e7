"""Queries by name, each with the SQL that must give the same rows. Modules of this package register theirs on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import VIEWS, Tables, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables as the query `name`; sql may use the base tables and any view of VIEWS."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return add


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions in front."""
    names = needed(sql)
    if not names:
        return sql
    plain = lambda text: text.replace("{", "").replace("}", "")
    views = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in names)
    body = sql.strip()
    head = "with recursive " if body.lower().startswith("with recursive") else "with "
    if body.lower().startswith("with recursive "):
        return f"{head}{views},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"{head}{views},\n{body[len('with '):]}"
    return f"{head}{views}\n{body}"
