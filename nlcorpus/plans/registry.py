"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nlcorpus.plans.views import with_views
from nlcorpus.session import dealt, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale directory, read in place (see :func:`nlcorpus.session.dealt`)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return dealt(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``function(tables) -> DataFrame``; ``views`` names the SQL views the oracle needs."""
    def add(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return function

    return add
