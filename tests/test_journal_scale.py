"""Headers and date decisions: the same rows as on the whole canonical journal, without ordering the ledger."""

from pyspark.sql import functions as F

from cuadre.functions import dates as D
from cuadre.operators import journal as J

MAPPING = {"a": "journal_entry_id", "f": "posting_date", "h": "entry_date", "i": "amount", "d": "description"}
ROWS = [("1", "13/02/2024", "2024-02-01 10:00:00", "1,5", "x", 5), ("1", "01/02/2024", "2024-02-02 11:30:00", "2", None, 2), ("2", None, "", "x", "y", 1),
        (None, "02/03/2024", "2024-03-01 00:00:00", "3", "z", 4), (None, "bad", None, None, "w", 3), ("2", "03/04/24", "31-04-2024 08:00", "4", "v", 9)]


def ledger(spark, rows=ROWS):
    return spark.createDataFrame(rows, "a string, f string, h string, i string, d string, row_id int")


def test_first_rows_before_parsing(spark):
    df = ledger(spark)
    want = J.journal_header(J.canonical_journal(df, MAPPING)).collect()
    got = J.journal_header(J.canonical_journal(df, MAPPING, first_of="journal_entry_id")).collect()
    key = lambda r: str(r.journal_entry_id)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 3
    assert {r.journal_entry_id: (r.posting_date, r.entry_date, r.entry_time) for r in got}["1"] == ("2024-02-01", "2024-02-02", "11:30:00")


def test_decisions_sort_no_rows(spark):
    """Before, all values of the date fields were sorted for the first ten."""
    df = ledger(spark).withColumnsRenamed(MAPPING)
    dec = D.date_decisions(df, ["posting_date", "entry_date"], "row_id")
    plan = dec._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit [__field" not in plan.split("TakeOrderedAndProject")[-1]
    r = dec.first()
    assert (r.__getitem__("__a_posting_date"), r.__getitem__("__a_entry_date"), r.__getitem__("__d_posting_date")) == ("convert", "split", True)
    (m,) = D.date_decisions(ledger(spark, [("1", "02/13/2024", None, None, None, 1), ("1", "9.09.2024x", "1-2-99", None, None, 2)]).withColumnsRenamed(MAPPING), ["posting_date", "entry_date"], "row_id").collect()
    assert (m.__getitem__("__d_posting_date"), m.__getitem__("__d_entry_date")) == (False, True)


def test_other_reading_where_the_first_is_no_date(spark):
    df = spark.createDataFrame([("13/02/2024",), ("02/13/2024",), ("31.12.99 7:05",), ("30/30/2024",), ("2024-02-30",), ("5-Mar-21",), ("20240131",), (None,)], "v string")
    got = [[str(x) if x else None for x in r] for r in D.with_parsed(D.with_parsed(df, {"x": "v"}, True), {"y": "v"}, False).select("x", "y").collect()]
    one = lambda s: [s, s]
    assert got == [one("2024-02-13 00:00:00"), one("2024-02-13 00:00:00"), one("2099-12-31 07:05:00"), one(None), one(None), one("2021-03-05 00:00:00"), one("2024-01-31 00:00:00"), one(None)]
