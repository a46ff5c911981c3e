from pyspark.sql import functions as F

from tableops import manifest, parts, read_parts, split_write
from tests.conftest import rows

VALUES = ["a/b", "ab", None, "São Paulo", "!!!", "A  B", "", "01"]


def awkward(spark):
    return spark.createDataFrame([(k, i) for i, k in enumerate(VALUES)] + [("ab", 99)], "k string, v int")


def test_manifest(spark):
    out = {r.part_key: (r.slug, r.n_rows, r.written, r.collides) for r in manifest(awkward(spark), "k").collect()}
    assert out == {
        "a/b": ("ab", 1, True, True),
        "ab": ("ab", 2, True, True),
        None: (None, 1, False, False),
        "São Paulo": ("São_Paulo", 1, True, False),
        "!!!": ("", 1, True, True),
        "__EMPTY__": ("", 1, True, True),
        "A  B": ("A__B", 1, True, False),
        "01": ("01", 1, True, False),
    }
    numbers = spark.createDataFrame([(1.0,), (10.0,), (float("nan"),)], "d double")
    assert {(r.part_key, r.slug, r.written) for r in manifest(numbers, "d").collect()} == {
        ("1.0", "10", True), ("10.0", "100", True), (None, None, False),
    }


def test_write_and_read_back(spark, tmp_path):
    df = awkward(spark)
    path = str(tmp_path / "parts")
    split_write(df, "k", path)
    back = read_parts(spark, path, df.schema)
    expected = df.filter("k is not null").withColumn("part_key", F.when(F.col("k") == "", "__EMPTY__").otherwise(F.col("k")))
    assert rows(back) == rows(expected)
    folders = [p for p in (tmp_path / "parts").iterdir() if p.is_dir()]
    assert len(folders) == 7
    # One file per value, rows of one value being together.
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert sum(r.n_rows for r in manifest(df, "k").collect()) == df.count()


def test_csv_parts(spark, tmp_path):
    df = spark.createDataFrame([("x", 'q"1', 1), ("y", " b ", 2)], "k string, t string, n int")
    path = str(tmp_path / "csv")
    split_write(df, "k", path, format="csv")
    assert rows(read_parts(spark, path, df.schema, format="csv").drop("part_key")) == rows(df)
    (part,) = (tmp_path / "csv" / "part_key=y").glob("*.csv")
    assert part.read_bytes() == b"\xef\xbb\xbfk,t,n\ny, b ,2\n"


def test_hot_part_is_cut(spark, tmp_path):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(30_000).repartition(16).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("t"),
        )
        path = str(tmp_path / "hot")
        split_write(df, "k", path)
        assert len(list((tmp_path / "hot" / "part_key=hot").glob("*.parquet"))) > 3
        assert read_parts(spark, path, df.schema).filter("part_key = 'hot'").count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parts_scan_once(spark):
    text = parts(awkward(spark), "k")._jdf.queryExecution().toString()
    assert text[text.index("== Physical Plan ==") :].count("Exchange") == 1


def test_manifest_reads_the_table_once(spark):
    out = manifest(awkward(spark), "k")
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
