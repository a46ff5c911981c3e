"""Every registered query against its SQL twin."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from catalog import QUERIES, loading

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    from tools.check import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    from tools.check import differences

    assert name in oracle_sql(), "a query needs its SQL twin"
    assert differences(queries()[name](spark, FOLDER), connection, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 9
    assert set(oracle_sql()) <= set(queries())


def test_queries_without_the_optional_package(monkeypatch):
    import importlib.util

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert set(queries()) == set(QUERIES) and set(oracle_sql()) <= set(QUERIES)


def test_long_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """No task writes more than about ``LONG_FILE`` bytes of text, and all rows come back."""
    text = F.concat(F.repeat(F.concat(F.lit('a "b", c\n'), F.col("id")), 40), F.lit("\nend"))
    docs = spark.range(2000).select("id", F.when(F.col("id") % 9 != 4, text).alias("text"))
    docs = docs.select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("int").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(loading, "LONG_FILE", 200_000, raising=False)
    kept, write = [], loading.write_csv
    monkeypatch.setattr(loading, "write_csv", lambda df, path, **options: kept.append(path) or write(df, path, **options))
    found = QUERIES["csv_one_long_file_in_splits"](spark, str(tmp_path))
    expected = docs.select("doc_id", F.md5("text"), "lang", "source", "n_chars")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    sizes = [x.stat().st_size for x in Path(kept[0]).glob("*.csv")]
    assert len(sizes) >= 4 and max(sizes) < 400_000
