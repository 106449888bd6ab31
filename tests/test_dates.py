import pytest
from pyspark.sql import functions as F

from cuadre.functions import dates as D

CASES = [  # text, day-first ISO result, month-first ISO result
    ("2024-01-05", "2024-01-05", "2024-01-05"),
    ("2024/1/5", "2024-01-05", "2024-01-05"),
    ("2024.01.05", "2024-01-05", "2024-01-05"),
    ("20240105", "2024-01-05", "2024-01-05"),
    ("05/01/2024", "2024-01-05", "2024-05-01"),
    ("5.1.2024", "2024-01-05", "2024-05-01"),
    ("01/15/2024", "2024-01-15", "2024-01-15"),      # day-first impossible -> month-first fallback
    ("05-01-24", "2024-01-05", "2024-05-01"),        # 2-digit year -> 20yy
    ("2024-02-30", "2024-02-30", "2024-02-30"),      # invalid date stays as text
    ("05-Jan-2024", "2024-01-05", "2024-01-05"),
    ("2024-01-05 07:05:09", "2024-01-05", "2024-01-05"),
    ("05/01/2024 7:05", "2024-01-05", "2024-05-01"),
    ("2024-01-05T07:05:09.123", "2024-01-05", "2024-01-05"),
    ("13:05", "13:05", "13:05"),                     # bare time unchanged
    ("12345", "12345", "12345"),                     # bare digits unchanged
    ("abc", "abc", "abc"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, v string")
    return {r.i: r for r in df.select("i", D.to_iso_date("v", True).alias("d"),
                                      D.to_iso_date("v", False).alias("m")).collect()}


@pytest.mark.parametrize("idx", range(len(CASES)))
def test_to_iso_date(parsed, idx):
    r = parsed[idx]
    assert (r.d, r.m) == CASES[idx][1:], CASES[idx]


def test_split_and_staged_match_inline(spark):
    df = spark.createDataFrame([("05.01.2024 07:05:09", 1), ("06.01.2024 08:00:00", 2), (None, 3)],
                               "entry_date string, row_id int")
    out = {r.row_id: (r.entry_date, r.entry_time)
           for r in D.split_datetime(df, fields=("entry_date",), order_col="row_id").collect()}
    assert out == {1: ("2024-01-05", "07:05:09"), 2: ("2024-01-06", "08:00:00"), 3: ("", "")}
    kept = {r.row_id: r.entry_date for r in D.split_datetime(df, fields=("entry_date",), order_col="row_id",
                                                            keep_format=True).collect()}
    assert kept[1] == "05.01.2024"
    staged = D.with_parsed(df, {"ts": "entry_date"}).select("row_id", "ts")
    inline = df.select("row_id", D.parse_date_text(F.col("entry_date"), True, True).alias("ts"))
    assert sorted(staged.collect()) == sorted(inline.collect())


def test_day_first_decision(spark):
    df = spark.createDataFrame([("01/15/2024", 1), ("02/03/2024", 2)], "posting_date string, row_id int")
    dec = D.date_decisions(df, ["posting_date"], "row_id").first()
    assert dec["__d_posting_date"] is False          # a second component > 12, none first -> month-first
    out = {r.row_id: r.posting_date for r in D.split_datetime(df, fields=("posting_date",)).collect()}
    assert out == {1: "2024-01-15", 2: "2024-02-03"}


def test_empty_time_column_receives_the_times(spark):
    schema = "file_id string, row_id int, entry_date string, entry_time string"
    rows = [("empty", 1, "05.01.2024 07:05:09", None), ("empty", 2, "06.01.2024 08:00:00", None),
            ("filled", 1, "05.01.2024 07:05:09", "x"), ("filled", 2, "06.01.2024 08:00:00", None)]
    out = D.split_datetime(spark.createDataFrame(rows, schema), fields=("entry_date",), group_cols=["file_id"])
    got = {(r.file_id, r.row_id): (r.entry_date, r.entry_time, r.entry_time_1) for r in out.collect()}
    assert got == {("empty", 1): ("2024-01-05", "07:05:09", None), ("empty", 2): ("2024-01-06", "08:00:00", None),
                   ("filled", 1): ("2024-01-05", "x", "07:05:09"), ("filled", 2): ("2024-01-06", None, "08:00:00")}
