"""Registered queries and their SQL twins: one for each operator, over projections of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import load, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def projected(self, name: str) -> DataFrame:
        """A table that isn't written for the session, for a query that reads a part of it once."""
        return load(self.spark, self.sf_dir, name, stored=False)


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name, with the SQL (over the same projections) that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql)
        return f

    return register


from . import accounting, activity, ingest, outcomes, usage  # noqa: E402,F401
