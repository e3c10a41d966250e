"""Registry of queries over the star schema and the text tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read when asked for; those of long texts are dealt to all cores if they are small."""

    LONG_TEXTS = ("documents", "pages")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in self.LONG_TEXTS else df


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    from siltstone.plans import answering, evidence, files, graph, judge, metrics, reports, retrieval, search, sequences  # noqa: F401
