"""Truth tables for the number cleaners (derived by reading the reference; see SURVEY §8.1)."""

import math

import pytest
from pyspark.sql import functions as F

from cuadre.functions import numbers as N

NAN = object()
# input, N01 clean_amount, N02 trial balance, N03 manual
TABLE = [
    (None, 0.0, None, 0.0),
    ("", 0.0, None, 0.0),
    ("   ", 0.0, None, 0.0),
    ("1.234,56", 1234.56, 1234.56, 1234.56),
    ("1,234.56", 1234.56, 1234.56, 1234.56),
    ("1,5", 1.5, 1.5, 1.5),
    ("1,234", 1234.0, 1.234, 1234.0),
    ("1.234", 1234.0, 1.234, 1234.0),
    ("12.34", 12.34, 12.34, 12.34),
    ("1,234,56", 1234.56, None, 123456.0),
    ("25.000.00", 25000.0, None, 25000.0),
    ("1.234.567", 1.234, None, 1234567.0),
    ("(100)", -100.0, -100.0, 100.0),
    ("(1.234,56)", -1234.56, -1234.56, 1234.56),
    ("(-5)", 5.0, 5.0, 5.0),
    ("-22.128.00", -22128.0, None, -22128.0),
    ("68,28-", 6828.0, None, 68.28),
    ("1.110,67-", 1110.67, None, 1110.67),
    ("EUR", None, None, 0.0),
    ("abc", None, None, 0.0),
    ("-", 0.0, None, 0.0),
    ("12 €", 12.0, None, 12.0),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TABLE)], "i int, v string")
    rows = df.select("i", N.clean_amount("v").alias("n01"), N.clean_trial_balance_number("v").alias("n02"),
                     N.parse_amount_manual("v").alias("n03")).orderBy("i").collect()
    return rows


@pytest.mark.parametrize("idx", range(len(TABLE)))
def test_truth_table(cleaned, idx):
    _, n01, n02, n03 = TABLE[idx]
    r = cleaned[idx]
    assert r.n01 == n01, (TABLE[idx][0], "N01", r.n01)
    assert r.n02 == n02, (TABLE[idx][0], "N02", r.n02)
    assert r.n03 == n03, (TABLE[idx][0], "N03", r.n03)


def test_first_number_and_is_numeric(spark):
    df = spark.createDataFrame([("€ 1.234,56",), ("$1,234.56",), ("12,5",), ("x",), (None,), ("1,234",)], "v string")
    out = [r[0] for r in df.select(N.first_number("v")).collect()]
    assert out == [1234.56, 1234.56, 12.5, 0.0, 0.0, 1234.0]
    df2 = spark.createDataFrame([("1,5",), ("-3",), ("--3",), ("1.234,5",), ("5d",), ("abc",), (" 7 ",)], "v string")
    assert [r[0] for r in df2.select(N.is_numeric("v")).collect()] == [True, True, True, False, False, False, True]


def test_indicators(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 5.0), (0.0, 0.0), (3.0, 4.0)], "d double, c double")
    r = df.select(N.debit_credit_to_amount("d", "c").alias("a"), N.indicator_from_debit_credit("d", "c").alias("i"),
                  N.indicator_from_amount(F.col("d") - F.col("c")).alias("j")).collect()
    assert [(x.a, x.i, x.j) for x in r] == [(10.0, "D", "D"), (-5.0, "H", "H"), (0.0, "D", ""), (-1.0, "", "H")]


def test_clip_and_ratio(spark):
    r = spark.range(1).select(N.clip01(F.lit(1.7)).alias("a"), N.clip01(F.lit(-2.0)).alias("b"),
                              N.safe_ratio(F.lit(3), F.lit(0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (1.0, 0.0, 3.0)
    assert not math.isnan(r.c)
