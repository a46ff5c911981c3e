"""Split a table into one output per value of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableops.columns import col, dtype, missing_to_null, require
from tableops.functions import as_text, slug
from tableops.sources.csv import READ_OPTIONS, WRITE_OPTIONS, printable

PART = "part_key"
# Stands in for the empty string, which a directory name cannot tell from NULL.
# A value of that very spelling shares the folder; the split column is kept in
# the rows and tells them apart.
EMPTY_LABEL = "__EMPTY__"


def _part_key(value: Column, data_type: T.DataType) -> Column:
    text = as_text(value, data_type)
    return F.when(text == "", F.lit(EMPTY_LABEL)).otherwise(text)


def manifest(df: DataFrame, column: str) -> DataFrame:
    """One row per part: key, file-name label, rows, and whether it is written.

    ``collides`` marks labels shared by several parts; since parts are laid out
    by key, not by label, none overwrites another. The row with a NULL key
    counts the rows that have no value and go to no part.
    """
    (column,) = require(df, column)
    data_type = dtype(df, column)
    counted = df.groupBy(missing_to_null(df, column).alias("_value")).agg(F.count("*").alias("n_rows"))
    listed = counted.select(
        _part_key(F.col("_value"), data_type).alias(PART), slug(as_text(F.col("_value"), data_type)).alias("slug"), "n_rows"
    )
    # A label with more rows than one of its parts has another part as well.
    # Summed and joined, not windowed: any number of parts may share a label.
    # Both branches need the same counts, so the table is scanned once.
    labels = listed.groupBy(F.col("slug").alias("_slug")).agg(F.sum("n_rows").alias("_label_rows"))
    joined = listed.join(labels, F.col("slug").eqNullSafe(F.col("_slug")))
    return joined.select(
        PART,
        "slug",
        "n_rows",
        F.col(PART).isNotNull().alias("written"),
        (F.col("_label_rows") > F.col("n_rows")).alias("collides"),
    )


def parts(df: DataFrame, column: str) -> DataFrame:
    """Rows that belong to some part, with their ``part_key``, laid out by part.

    The rebalance hint brings the rows of a value together, so a usual part is
    one file, and lets adaptive execution cut a part that is far bigger than
    the rest over several tasks and files.
    """
    (column,) = require(df, column)
    if PART in df.columns:
        raise ValueError(f"the table already has a column {PART!r}")
    keyed = df.filter(missing_to_null(df, column).isNotNull()).withColumn(
        PART, _part_key(missing_to_null(df, column), dtype(df, column))
    )
    return keyed.hint("rebalance", PART)


def split_write(
    df: DataFrame, column: str, path: str, format: str = "parquet", max_records_per_file: int | None = None, **options
) -> None:
    """Write one directory ``part_key=<value>`` per value, in one pass."""
    laid_out = parts(df, column)
    if format == "csv":
        # Header, byte order mark and cell rules as in every CSV of this package.
        laid_out = printable(laid_out, bom=True)
        options = {**WRITE_OPTIONS, "header": True, **options}
    writer = laid_out.write.partitionBy(PART).format(format)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.options(**options).save(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", **options) -> DataFrame:
    """Read a split table back; ``schema`` is that of the table that was split.

    The key is declared as text: inference would read a key ``01`` as 1.
    """
    with_key = T.StructType([*schema.fields, T.StructField(PART, T.StringType())])
    reader = spark.read.schema(with_key).format(format)
    if format == "csv":
        # Cells may hold line breaks; a part is several files where it is big.
        options = {**READ_OPTIONS, "header": True, "multiLine": True, **options}
    return reader.options(**options).load(path)
