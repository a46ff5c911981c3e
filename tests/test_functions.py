import math

from pyspark.sql import functions as F, types as T

from tableops.functions import approx_equal, clean_text, exact_sum, slug, strip_ws, to_number


def apply(spark, values, function):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_numbers_with_decimal_comma(spark):
    cases = {
        "1,5": 1.5, "2.5": 2.5, " 7 ": 7.0, "1e3": 1000.0, "1.234,56": None, "1,234,567": None,
        "Silva, J": None, "1d": None, "1f": None, "inf": math.inf, "0x10": None, "1_000": None,
        "True": None, "1,234": 1.234, "1e400": None, "-Infinity": -math.inf, "nan": None, "": None, None: None,
    }
    assert apply(spark, list(cases), lambda c: to_number(c, True)) == list(cases.values())


def test_numbers_without_comma(spark):
    assert apply(spark, ["1,5", ".5", "5.", "+3", "--3", "1e"], to_number) == [None, 0.5, 5.0, 3.0, None, None]


def test_clean_text(spark):
    cases = {
        " São\tPaulo\n": "SãoPaulo",
        "nº 1ª €5 ×÷ “q”": "n 1 5 ×÷ q",
        "\U0001f600 a ": "a",
        " a b ": "a b",
        "á āó": "a ó",
        None: None,
    }
    assert apply(spark, list(cases), clean_text) == list(cases.values())


def test_strip_all_white_space(spark):
    values = ["  x　", "\t b\n", "\x1cc\x1f", "​d", " a b ", "", None]
    assert apply(spark, values, strip_ws) == ["x", "b", "c", "​d", "a b", "", None]


def test_slug(spark):
    cases = {
        "a/b": "ab", "ab": "ab", "São Paulo": "São_Paulo", "!!!": "", "A  B": "A__B", "1.0": "10",
        " x-y_z ": "x-y_z", "m²": "m²", "é": "e", "日本": "日本",
    }
    assert apply(spark, list(cases), slug) == list(cases.values())


def equal(spark, pairs, data_type, **tolerance):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("a", data_type), T.StructField("b", data_type)])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], schema)
    flag = approx_equal(F.col("a"), F.col("b"), data_type, data_type, **tolerance)
    return [r[0] for r in df.orderBy("i").select(flag).collect()]


def test_tolerant_equality(spark):
    inf, nan = math.inf, math.nan
    pairs = [
        (1.0, 1.00005), (1.0, 1.001), (None, None), (None, 1.0), (nan, nan), (nan, 1.0),
        (inf, inf), (inf, -inf), (5.0, inf), (inf, 5.0), (1.0, nan),
    ]
    expected = [True, False, True, False, True, False, True, False, False, False, False]
    assert equal(spark, pairs, T.DoubleType()) == expected
    relative = equal(spark, [*pairs, (100.0, 101.0), (100.0, 103.0)], T.DoubleType(), rel_tol=0.02)
    assert relative == [True, True, *expected[2:], True, False]


def test_whole_numbers_compare_exactly(spark):
    big = 2**62
    assert equal(spark, [(big, big + 1), (big, -big), (3, 3)], T.LongType()) == [False, False, True]


def test_exact_sum(spark):
    cents = [1, -1, 99, -12345, 10**15 + 7, -(10**15), 5, 0, -(2**20), 2**20 + 1]
    df = spark.createDataFrame([(c / 100,) for c in cents] + [(None,)], "v double")
    out = df.repartition(4).agg(exact_sum(F.col("v"), T.DoubleType(), 2).alias("s")).first().s
    assert int(out * 100) == sum(cents)
    assert df.filter("v is null").agg(exact_sum(F.col("v"), T.DoubleType(), 2)).first()[0] is None
    many = spark.range(300_000).select(F.lit(9e12).alias("v")).agg(exact_sum(F.col("v"), T.DoubleType(), 2).alias("s"))
    assert many.first().s == 9 * 10**12 * 300_000


def test_exact_sum_of_many_rows(spark):
    """Sums of parts must not overflow where many values are close to the largest that is counted in units."""
    value = F.lit(8e10) + (F.col("id") % 4) * 0.25
    df = spark.range(3_000_000).select(value.alias("v"))
    total = 3_000_000 * 8e10 + 750_000 * 1.5
    assert df.agg(exact_sum(F.col("v"), T.DoubleType(), 2)).first()[0] == total
    assert df.agg(exact_sum(-F.col("v"), T.DoubleType(), 2)).first()[0] == -total
    wide = spark.range(200_000).select(F.lit(1e30).alias("v")).agg(exact_sum(F.col("v"), T.DoubleType(), 6)).first()[0]
    assert abs(wide / 2e35 - 1) < 1e-9
