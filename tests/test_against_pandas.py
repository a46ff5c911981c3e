"""Random small tables: keeping first rows, distinct values and pairing, against pandas."""

from random import Random

import numpy as np
import pandas as pd
import pytest

from tableops import compare, dedupe, distinct_values

SCHEMA = "pos int, k string, g bigint, x double, s string"


def table(seed, n):
    r = Random(seed)
    return pd.DataFrame(
        [
            (
                i,
                r.choice(["a", "b", "c", "d", None]),
                r.choice([1, 2, 3]),
                r.choice([0.5, 1.25, -3.0, 100.0, None]),
                r.choice([" x ", "Y", "y", "ß\t", None, "1,5", "12"]),
            )
            for i in range(n)
        ],
        columns=["pos", "k", "g", "x", "s"],
    )


def to_spark(spark, pdf, schema=SCHEMA):
    clean_rows = [tuple(None if v is None or v != v else v for v in row) for row in pdf.itertuples(index=False)]
    return spark.createDataFrame(clean_rows, schema)


def cells(rows):
    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "missing"
        return float(v) if isinstance(v, (int, float, np.number)) else v

    return sorted([tuple(plain(v) for v in row) for row in rows], key=repr)


def same(df, pdf):
    assert list(df.columns) == list(pdf.columns)
    assert cells(df.collect()) == cells(pdf.itertuples(index=False))


@pytest.mark.parametrize("subset", [["k"], ["k", "x"], ["s", "g"]])
def test_dedupe(spark, subset):
    a = table(4, 60)
    same(dedupe(to_spark(spark, a), subset, "pos"), a.drop_duplicates(subset=subset))


def test_distinct_values(spark):
    a = table(6, 40)
    for column in ("k", "x", "g", "s"):
        expected = sorted(a[column].dropna().astype(str).unique())
        assert [r.value for r in distinct_values(to_spark(spark, a), column).collect()] == expected


@pytest.mark.parametrize("seed", [8, 9])
@pytest.mark.parametrize("hot_rows", [None, 3])
def test_compare(spark, seed, hot_rows):
    a, b = table(seed, 60), table(seed + 50, 50)

    def numbered(pdf):
        order = pdf.sort_values(["pos"]).copy()
        order["k"] = order["k"].fillna("<none>")
        order["occ"] = order.groupby(["k", "g"]).cumcount()
        return order

    pairs = pd.merge(numbered(a), numbered(b), on=["k", "g", "occ"], how="outer", suffixes=("_a", "_b"), indicator=True)
    result = compare(
        to_spark(spark, a), to_spark(spark, b), ["k", "g"], order_by="pos", tidy_text=False, hot_rows=hot_rows, hot_sample=1.0
    )
    for side, frame, name in (("left_only", result.only_a, "pos_a"), ("right_only", result.only_b, "pos_b")):
        assert sorted(r.pos for r in frame.collect()) == sorted(pairs.loc[pairs["_merge"] == side, name])
    both = pairs[pairs["_merge"] == "both"]
    found = {(r.pos_a, r.pos_b): (r.x_match, r.s_match, r.all_match) for r in result.both.collect()}
    equal_x = (abs(both.x_a - both.x_b) <= 1e-4) | (both.x_a.isna() & both.x_b.isna())
    equal_s = (both.s_a == both.s_b) | (both.s_a.isna() & both.s_b.isna())
    everything = equal_x & equal_s & (both.pos_a == both.pos_b)
    assert found == {
        (p, q): flags for p, q, *flags in zip(both.pos_a, both.pos_b, equal_x, equal_s, everything) for flags in [tuple(flags)]
    }
