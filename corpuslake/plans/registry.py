"""Catalogue of queries with the SQL they are checked against."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.plans.inputs import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named SQL inputs; a query pulls in those it mentions, in dependency order.
VIEWS: dict[str, str] = {}


def _needed(sql: str, done: list[str]) -> list[str]:
    for name, body in VIEWS.items():
        if name not in done and re.search(rf"\b{name}\b", sql):
            _needed(body, done)
            if name not in done:
                done.append(name)
    return done


def with_views(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    heads = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def plain_types(df: DataFrame) -> DataFrame:
    """Widen small numbers, so that both engines report the same types."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[
        F.col(f"`{name}`").cast(wide[kind]).alias(name) if kind in wide else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows."""
    def register(fn: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(Corpus(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register
