"""Registry of queries and their SQL twins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reliq.session import spread


#: Rows of a table that arrives in few files which one task works on, about.
TASK_ROWS = 250_000


@dataclass
class Tables:
    """The given parquet tables of one scale factor."""

    spark: SparkSession
    path: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores even when it is one small file; for regex- or Python-heavy queries."""
        table = self(name)
        return spread(table, math.ceil(table.count() / TASK_ROWS))  # counted in the files' footers


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every stored time is naive UTC; offsets in parsed text resolve against this.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return QUERIES[name](Tables(spark, sf_dir))
