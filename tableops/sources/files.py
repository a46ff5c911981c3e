"""Small helpers around file reads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableops.columns import col, require
from tableops.sources.csv import read_csv
from tableops.sources.exports import SOURCE
from tableops.sources.ingest import promote_numeric
from tableops.sources.workbooks import ROW as SHEET_ROW, read_workbooks

FILE, ROW = "_file", "_row"


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A .csv or .xlsx file as a typed table; anything else is refused."""
    if not path:
        raise ValueError("no path given")
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, **options)
    if path.lower().endswith(".xlsx"):
        return promote_numeric(read_workbooks(spark, path, **options).drop(SOURCE, SHEET_ROW))
    raise ValueError(f"neither a .csv nor an .xlsx file: {path!r}")


def read_parquet_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table plus ``_file`` and ``_row``: file order as real columns.

    Use both as ``order_by`` where "first" should mean first in the file.
    """
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def preview_files(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of a Parquet table in the order of its files, without ``_file`` and ``_row``.

    Files are opened in order, one, two, four and so on, until ``n`` rows are there; the rest is only listed.
    """
    whole = spark.read.parquet(path)
    files, many = sorted(whole.inputFiles()), 1
    while True:
        some = spark.read.schema(whole.schema).option("basePath", path).parquet(*files[:many]) if files else whole
        if many >= len(files) or len(some.select(F.lit(1)).take(n)) == n:
            break
        many *= 2
    ordered = some.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    return preview(ordered, [FILE, ROW], n).drop(FILE, ROW)


def preview(df: DataFrame, order_by: str | Iterable[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-n, not a full sort)."""
    order = require(df, order_by, "order column")
    if not order:
        raise ValueError("give the columns that define the order")
    return df.orderBy(*[col(c) for c in order]).limit(n)
