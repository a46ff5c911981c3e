"""Registered queries: one Spark function and, where it exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Schemas already looked up, by path: it takes a job to read them from a footer.
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The Parquet tables of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register the decorated ``f(tables) -> DataFrame``, under its own name by default."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        label = name or function.__name__
        QUERIES[label] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[label] = sql
        return function

    return register
