"""Hand-made inputs with their results written out."""

import pytest
from pyspark.sql import functions as F

from tableops import CleanSpec, clean, summarize, unify
from tableops.functions import clean_text, slug, strip_ws, to_number
from tests.conftest import rows


def test_summarize_text_metric(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "2"), (None, "3"), ("a", "x"), ("c", "y"), ("b", " 4.5 "), ("b", None)], "g string, m string")
    found = summarize(df, "g", "m", ["sum", "mean", "count", "max", "min"])
    assert found.columns == ["g", "m_sum", "m_mean", "m_count", "m_max", "m_min"]
    assert rows(found) == [("a", 2.0, 2.0, 1, 2.0, 2.0), ("b", 5.5, 2.75, 2, 4.5, 1.0), ("c", 0.0, None, 0, None, None)]


def test_summarize_several_keys(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 30), (1, "b", 5), (2, None, 7), (None, "a", 1)], "k int, t string, v long")
    assert rows(summarize(df, ["k", "t"], "v", ["sum", "count"])) == [(1, "a", 40, 2), (1, "b", 5, 1)]
    assert rows(summarize(df, "k", "v", ["max", "min", "mean"])) == [(1, 30, 5, 15.0), (2, 7, 7, 7.0)]


LEFT = [(1.0, 1, 1), (None, 2, 1), (2.0, 3, 1), (2.0, 4, 1)]
RIGHT = [(None, 9), (2.0, 8), (2.0, 7)]


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ("left", [(1.0, 1, 1, None), (2.0, 3, 1, 7), (2.0, 3, 1, 8), (2.0, 4, 1, 7), (2.0, 4, 1, 8), (None, 2, 1, 9)]),
        ("inner", [(2.0, 3, 1, 7), (2.0, 3, 1, 8), (2.0, 4, 1, 7), (2.0, 4, 1, 8), (None, 2, 1, 9)]),
    ],
)
def test_unify_repeated_and_missing_keys(spark, how, expected):
    a, b = spark.createDataFrame(LEFT, "k double, v int, w int"), spark.createDataFrame(RIGHT, "k double, v int")
    found = unify(a, b, "k", "k", how=how)
    assert found.columns == ["k", "v_A", "w", "v_B"]
    assert rows(found) == expected


def test_unify_keys_of_other_names(spark):
    a, b = spark.createDataFrame(LEFT, "k double, v int, w int"), spark.createDataFrame([(2.0, "x")], "kk double, k string")
    found = unify(a, b, "k", "kk", how="inner")
    assert found.columns == ["k_A", "v", "w", "kk", "k_B"]
    assert rows(found) == [(2.0, 3, 1, 2.0, "x"), (2.0, 4, 1, 2.0, "x")]


def test_clean_in_its_order(spark):
    df = spark.createDataFrame(
        [(0, "a", 0.5, " x "), (1, "a", 0.5, "Y"), (2, "a", None, "Y"), (3, None, 0.5, "q"), (4, "b", 1.0, "\u00a0ß\t"), (5, "b", 1.0, "z"), (6, "c", 2.0, None)],
        "pos int, k string, x double, s string",
    )
    spec = CleanSpec(duplicates=("k", "x"), order_by=("pos",), missing="drop", text_columns=("s",), text_actions=("lower", "upper", "strip"))
    assert rows(clean(df, spec)) == [(0, "a", 0.5, "x"), (4, "b", 1.0, "ss")]


@pytest.mark.parametrize(
    ("text", "stripped", "tidy", "label", "number"),
    [
        ("\u00a0São\tPaulo\n", "São\tPaulo", "SãoPaulo", "São\tPaulo", None),
        ("nº 1ª €5 ×÷ “q”", "nº 1ª €5 ×÷ “q”", "n 1 5 ×÷ q", "nº_1ª_5__q", None),
        ("\U0001f600 a ", "\U0001f600 a", "a", "a", None),
        ("\u00a0a\u00a0b\u00a0", "a\u00a0b", "a b", "a\u00a0b", None),
        ("\x1cc\x1f", "c", "c", "c", None),
        ("\u200bd", "\u200bd", "d", "d", None),
        ("a/b", "a/b", "a/b", "ab", None),
        ("A  B", "A  B", "A  B", "A__B", None),
        ("!!!", "!!!", "!!!", "", None),
        ("1,5", "1,5", "1,5", "15", 1.5),
        (" 7 ", "7", "7", "7", 7.0),
        ("1e3", "1e3", "1e3", "1e3", 1000.0),
        ("-.5", "-.5", "-.5", "-5", -0.5),
        ("1.234,56", "1.234,56", "1.234,56", "123456", None),
        ("1d", "1d", "1d", "1d", None),
        ("inf", "inf", "inf", "inf", float("inf")),
        ("0x10", "0x10", "0x10", "0x10", None),
        ("", "", "", "", None),
        (None, None, None, None, None),
    ],
)
def test_cells(spark, text, stripped, tidy, label, number):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(strip_ws(F.col("t")), clean_text(F.col("t")), slug(F.col("t")), to_number(F.col("t"), True)).first()
    assert tuple(found) == (stripped, tidy, label, number)
