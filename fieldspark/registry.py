"""Registered queries: a name, a Spark callable over a folder of tables, and an equivalent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldspark import fixtures
from fieldspark.session import use_utc


class Inputs:
    """The projections of one folder of tables, read lazily by name: `x.obs`, `x.site`, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._held:
            self._held[name] = fixtures.load(self.spark, self.folder, name)
        return self._held[name]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None
    operators: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Inputs(use_utc(spark), folder))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_inputs(self.sql)


QUERIES: dict[str, Query] = {}


def query(*operators: str, sql: str | None = None, name: str | None = None):
    """Register the decorated function as the query of the listed operator ids."""

    def add(run: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = Query(key, run, sql, operators)
        return run

    return add


def with_inputs(sql: str) -> str:
    """Put the projections that `sql` names in front of it as common table expressions."""
    ordered: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_]+", text):
            if word in fixtures.PROJECTIONS and word not in seen:
                seen.add(word)
                need(fixtures.PROJECTIONS[word].duck)
                ordered.append(word)

    need(sql)
    head = [f"{name} AS ({fixtures.PROJECTIONS[name].duck})" for name in ordered]
    body = sql.strip()
    if not head:
        return body
    if re.match(r"(?i)with\b", body):
        return "WITH " + ",\n".join(head) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(head) + "\n" + body


def load_all() -> dict[str, Query]:
    from fieldspark.queries import aggregates, expressions, joins, scans, sets, streams, surface, windows  # noqa: F401

    return QUERIES
