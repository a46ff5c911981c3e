import math

import pytest
from pyspark.sql import functions as F

from tableops import compare
from tableops.operators import comparison
from tests.conftest import rows

SCHEMA = "id bigint, amt double, txt string"


def two_tables(spark):
    inf, nan = math.inf, math.nan
    a = [
        (1, 1.0001, "x"), (2, 1.00011, "x"), (3, None, "x"), (4, None, "x"), (5, nan, "x"), (6, inf, "x"),
        (7, 1.0, "x"), (7, 2.0, "x"), (None, 1.0, "x"), (8, 1.0, "y"),
    ]
    b = [
        (1, 1.0, "x"), (2, 1.0, "x"), (3, None, "x"), (4, 5.0, "x"), (5, nan, "x"), (6, inf, "x"),
        (7, 1.0, "x"), (None, 1.0, "x"), (9, 1.0, "z"),
    ]
    return spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def test_outputs(spark):
    a, b = two_tables(spark)
    result = compare(a, b, "id")
    both = result.both
    assert both.columns == ["id", "amt_a", "amt_b", "amt_match", "txt_a", "txt_b", "txt_match", "all_match"]
    assert {(r["id"], r.amt_match, r.all_match) for r in both.collect()} == {
        (1, True, True), (2, False, False), (3, True, True), (4, False, False), (5, True, True),
        (6, True, True), (7, True, True), (None, True, True),
    }
    assert rows(result.only_a) == [(7, 2.0, "x"), (8, 1.0, "y")]
    assert rows(result.only_b) == [(9, 1.0, "z")]
    summary = result.summary().first().asDict()
    assert summary["rows_a"] == 10 == summary["only_a"] + summary["both"]
    assert summary["rows_b"] == 9 == summary["only_b"] + summary["both"]
    assert (summary["both_equal"], summary["both_different"], summary["matches"]) == (6, 2, False)
    assert compare(a, a, "id").matches() is True
    stats = {r["column"]: r for r in result.column_stats().collect()}
    assert (stats["amt"].n_equal, stats["amt"].n_different, stats["amt"].n_one_missing) == (6, 2, 1)
    assert stats["amt"].max_difference == pytest.approx(0.00011)
    assert stats["txt"].max_difference is None
    assert [r["id"] for r in result.samples(1).collect()] == [2]
    report = result.report()
    assert "n_different=2" in report and "First 10 rows only in A" in report and "id=9" in report


def test_keys_of_another_name_and_extra_columns(spark):
    a, b = two_tables(spark)
    b = b.withColumnsRenamed({"id": "cod"}).withColumn("extra", F.lit(1))
    result = compare(a.withColumn("mine", F.lit(2)), b, ["id"], ["cod"])
    assert result.both.columns[-3:] == ["mine", "extra", "all_match"]
    assert result.only_b.columns == ["id", "amt", "txt", "extra"]
    assert result.summary().first().both == 8
    with pytest.raises(ValueError):
        compare(a, b.withColumn("id", F.lit(1)), ["id"], ["cod"])


def test_validation(spark):
    a, b = two_tables(spark)
    for keys_a, keys_b in [([], []), (["id"], []), (["id"], ["id", "amt"]), (["zz"], ["id"]), (["id"], ["txt"])]:
        with pytest.raises(ValueError):
            compare(a, b, keys_a, keys_b)
    with pytest.raises(ValueError):
        compare(a, b, "id", ignore="id")


def test_text_is_tidied_after_matching(spark):
    a = spark.createDataFrame([("k1", " v "), (" k2", "w")], "k string, v string")
    b = spark.createDataFrame([("k1", "v"), ("k2", "w")], "k string, v string")
    result = compare(a, b, "k")
    assert rows(result.both) == [("k1", "v", "v", False, False)]
    assert rows(result.only_a) == [("k2", "w")]
    assert rows(compare(a, b, "k", tidy_text=False).only_a) == [(" k2", "w")]


def test_order_by_and_ignore(spark):
    a = spark.createDataFrame([(1, "p", 2), (1, "q", 1)], "k int, v string, pos int")
    b = spark.createDataFrame([(1, "q", 1), (1, "p", 9)], "k int, v string, pos int")
    ordered = compare(a, b, "k", order_by="pos", ignore="pos")
    assert ordered.both.columns == ["k", "v_a", "v_b", "v_match", "all_match"]
    assert ordered.matches()
    assert not compare(a, b, "k", order_by="pos").matches()
    reverse = b.withColumn("pos", -F.col("pos"))
    assert not compare(a, reverse, "k", order_by="pos", ignore="pos").matches()


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_copies_pair_by_what_the_tables_share(spark, hot_rows):
    """Columns that only one table has must not decide which rows pair up."""
    a = spark.createDataFrame([(1, i, f"t{i}", f"own{-i}") for i in range(40)], "k int, n int, t string, mine string")
    b = spark.createDataFrame([(1, f"x{i * 7 % 40}", f"t{i}", i) for i in range(40)], "k int, more string, T string, N int")
    assert compare(a, b, "k", hot_rows=hot_rows, hot_sample=1.0).matches()
    assert compare(a.drop("n"), b.drop("N"), "k", hot_rows=hot_rows, hot_sample=1.0).matches()


def test_keys_only_and_dotted_names(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "`k.1` int")
    b = spark.createDataFrame([(2,), (3,)], "`k.1` int")
    result = compare(a, b, "k.1")
    assert (rows(result.only_a), rows(result.only_b), rows(result.both)) == ([(1,), (2,)], [(3,)], [(2, True)])


def test_one_shuffle(spark):
    a, b = two_tables(spark)
    text = compare(a, b, "id", order_by="amt").both._jdf.queryExecution().toString()
    assert text[text.index("== Physical Plan ==") :].count("Exchange hashpartitioning") == 1


def skewed(spark):
    """Key 0 holds a third of the rows, partly as copies of one row; key NULL is large too."""
    base = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 900).alias("k"),
        F.when(F.col("id") % 6 == 0, F.lit("copy" * 40)).otherwise(F.concat(F.lit("copy" * 40), F.col("id") % 1500)).alias("t"),
        F.when(F.col("id") % 6 == 0, 1.5).otherwise((F.col("id") % 400).cast("double")).alias("x"),
    )
    other = base.filter(F.xxhash64("t", "x") % 7 != 0).unionByName(base.filter(F.col("x") < 20))
    return base, other.withColumn("x", F.col("x") + F.when(F.col("x") % 11 == 0, 1.0).otherwise(0.00001))


@pytest.mark.parametrize("order_by", [[], ["x"], ["t"]])
def test_hot_keys_give_the_same_pairs(spark, monkeypatch, order_by):
    monkeypatch.setattr(comparison, "BLOCK", 64)
    a, b = skewed(spark)
    plain = compare(a, b, "k", order_by=order_by, hot_rows=None)
    spread = compare(a, b, "k", order_by=order_by, hot_rows=300, hot_sample=1.0)
    names = ["k", "t_a", "t_b", "x_a", "x_b", "all_match"]
    assert rows(spread.both.select(names)) == rows(plain.both.select(names))
    assert rows(spread.only_a) == rows(plain.only_a)
    assert rows(spread.only_b) == rows(plain.only_b)
    text = spread.both._jdf.queryExecution().toString()
    assert "tableops/compare-" in text


def test_hot_key_is_cut_into_many_tasks(spark):
    a, b = skewed(spark)
    only = a.filter("k = 0")
    spread = compare(only, only, "k", hot_rows=300, hot_sample=1.0)
    path = next(w for w in spread.matched.inputFiles() if "/compare-" in w).rsplit("/", 1)[0]
    sizes = spark.read.parquet(path).groupBy("_side", "_chunk").agg(F.count("*").alias("n"))
    assert sizes.count() >= 8
    assert sizes.agg(F.max("n")).first()[0] < only.distinct().count() / 2
    assert spread.matches()


@pytest.mark.parametrize("fan", [32, 3])
def test_chunks_do_not_follow_a_low_threshold(spark, monkeypatch, fan):
    """A key far above ``hot_rows`` has chunks by its own rows, looked up in groups of any depth."""
    monkeypatch.setattr(comparison, "FAN", fan)
    a = spark.range(9000).select(F.when(F.col("id") < 8000, 1).alias("k"), (F.xxhash64("id") % 5000).alias("n"), F.col("id").alias("v"))
    b = a.filter("v % 50 != 7").withColumn("v", F.col("v") + F.when(F.col("v") % 40 == 3, 1).otherwise(0))
    spread = compare(a, b, "k", order_by="n", hot_rows=100, hot_sample=1.0)
    path = next(w for w in spread.matched.inputFiles() if "/compare-" in w).rsplit("/", 1)[0]
    of_key = [r.n for r in spark.read.parquet(path).filter("_k0 = 1").groupBy("_side", "_chunk").agg(F.count("*").alias("n")).collect()]
    assert 20 < len(of_key) <= 128 and max(of_key) < 2000
    plain = compare(a, b, "k", order_by="n", hot_rows=None)
    assert rows(spread.both) == rows(plain.both)
    assert spread.summary().first() == plain.summary().first()


def test_long_common_starts_are_spread(spark):
    """Rows whose order column differs only behind its 90th character, and copies, fall into chunks of like size."""
    url = F.concat(F.lit("https://www.example.org/" + "section/" * 9), F.format_string("%05d", F.col("id")))
    a = spark.range(20_000).select(F.lit(1).alias("k"), url.alias("url"), (F.col("id") % 7).alias("n"))
    b = a.union(a.filter("n = 3"))
    spread = compare(a, b, "k", order_by="url", hot_rows=16_000, hot_sample=1.0)
    path = next(w for w in spread.matched.inputFiles() if "/compare-" in w).rsplit("/", 1)[0]
    sizes = spark.read.parquet(path).groupBy("_side", "_chunk").agg(F.count("*").alias("n")).collect()
    for side in "ab":
        of_side = [r.n for r in sizes if r["_side"] == side]
        assert sum(of_side) == 20_000 and len(of_side) >= 4 and max(of_side) < 5_000
    plain = compare(a, b, "k", order_by="url", hot_rows=None)
    assert spread.summary().first() == plain.summary().first()


def test_few_long_rows_are_spread(spark):
    """A key with few rows for its number but many bytes is cut into chunks and blocks by bytes."""
    key = F.when(F.col("id") < 300, 1).otherwise(F.col("id"))
    a = spark.range(900).select(key.alias("k"), F.concat(F.repeat(F.lit("long "), 2_000), F.col("id")).alias("t"), F.col("id").alias("n"))
    b = a.filter("n % 50 != 7").withColumn("t", F.when(F.col("n") % 40 == 3, "short").otherwise(F.col("t")))
    plain = compare(a, b, "k", order_by="n", hot_rows=None)
    by_rows = compare(a, b, "k", order_by="n", hot_rows=2_000, hot_sample=1.0)
    assert not any("/compare-" in w for w in by_rows.matched.inputFiles())
    spread = compare(a, b, "k", order_by="n", hot_rows=2_000, hot_sample=1.0, hot_bytes=1 << 20)
    path = next(w for w in spread.matched.inputFiles() if "/compare-" in w).rsplit("/", 1)[0]
    sizes = spark.read.parquet(path).groupBy("_side", "_chunk").agg(F.count("*").alias("n")).collect()
    for side, n in (("a", 300), ("b", 294)):
        of_side = [r.n for r in sizes if r["_side"] == side]
        assert sum(of_side) == n and len(of_side) >= 8 and max(of_side) < 60
    assert rows(spread.both) == rows(plain.both)
    assert rows(spread.only_a) == rows(plain.only_a)
    assert spread.summary().first() == plain.summary().first()


def test_spreadsheet_names_on_the_spread_road(spark):
    names = "`cod. (id)` bigint, `valor (R$), total;` double, `obs\n=` string"
    a = spark.createDataFrame([(1, float(i), f"t{i % 3}") for i in range(50)], names)
    b = a.withColumn("valor (R$), total;", F.col("`valor (R$), total;`") + 0.00001)
    result = compare(a, b, "cod. (id)", hot_rows=5, hot_sample=1.0)
    assert "tableops/compare-" in result.both._jdf.queryExecution().toString()
    assert result.matches() and result.summary().first().both == 50
