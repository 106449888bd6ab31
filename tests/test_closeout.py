"""Mended number mode, field checks, raw files to journals and the decision report."""

import os

from pyspark.sql import functions as F

from cuadre.functions import numbers as N
from cuadre.operators import closeout as X
from cuadre.sources import catalog as C
from cuadre.sources import io

#: text -> value of the mended mode; where it differs from the compatible mode, that mode's value follows
FIXED = [(None, 0.0), ("", 0.0), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,5", 1.5), ("1,234", 1234.0), ("1.234", 1234.0), ("12.34", 12.34),
         ("1,234,56", 1234.56), ("25.000.00", 25000.0), ("1.234.567", 1234567.0), ("(100)", -100.0), ("(1.234,56)", -1234.56), ("-22.128.00", -22128.0),
         ("68,28-", -68.28), ("1.110,67-", -1110.67), ("EUR", 0.0), ("abc", 0.0), ("-", 0.0), ("12 €", 12.0), ("-1.234.567", -1234567.0), ("12.345.678 EUR-", -12345678.0)]


def test_fixed_number_mode(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(FIXED)], "i int, v string")
    got = {r.i: r.x for r in N.with_cleaned(df, {"x": "v"}, "clean_amount_fixed").collect()}
    assert [(v, got[i]) for i, (v, _) in enumerate(FIXED)] == FIXED


def test_field_checks(spark):
    rows = [("amount", "Importe", "numeric", 0, True), ("Amount 2", "x", "numeric", 1, True), ("empty", " ", "text", 2, True),
            ("odd", "x", "colour", 3, True), ("amount", "Importe", "numeric", 4, True)]
    good, bad = C.valid_fields(spark.createDataFrame(rows, C.FIELD_SCHEMA))
    assert [r.field_order for r in good.collect()] == [0]
    assert {r.field_order: r.reason for r in bad.collect()} == {1: "invalid field code", 2: "empty name", 3: "unknown type", 4: "code used twice"}


def test_marker_character_does_not_disturb_counts(spark):
    from cuadre.functions import line_features as L
    df = spark.createDataFrame([("a\u0000b 12 34",), ("no digits",), ("1\u000022",)], "t string")
    assert [r[0] for r in df.select(L.count_re(F.col("t"), r"\d+")).collect()] == [2, 0, 2]


def test_raw_files_to_journal_and_close_out(spark, tmp_path):
    with open(os.path.join(tmp_path, "a.csv"), "w", encoding="utf-8") as f:
        f.write("Asiento,Fecha,Importe,Vacio\n" + "".join(f"{i // 2},2024-01-{i % 28 + 1:02d},\"{(1 if i % 2 else -1) * (i // 2 + 1) * 10},50\",\n" for i in range(40)))
    with open(os.path.join(tmp_path, "b.csv"), "w", encoding="utf-8") as f:
        f.write("NumAsiento,Debe,Haber\n" + "".join(f"{i},\"{i + 1}.000,25\",0\n{i},0,\"{i + (1 if i else 2)}.000,25\"\n" for i in range(20)))
    raw = io.read_ledger_lake(spark, [os.path.join(tmp_path, n) for n in ("a.csv", "b.csv")])
    mappings, journal = X.raw_lake_to_journal(raw, C.synonyms(spark), C.field_definitions(spark))
    got = {(r.file_id, r.field_type): r.column for r in mappings.collect()}
    assert got["a.csv", "journal_entry_id"] == "Asiento" and got["a.csv", "amount"] == "Importe"
    assert got["b.csv", "journal_entry_id"] == "NumAsiento" and got["b.csv", "debit_amount"] == "Debe" and got["b.csv", "credit_amount"] == "Haber"
    assert dict(journal.dtypes)["amount"] == "decimal(18,2)" and journal.count() == 80
    cells = raw.withColumn("row_key", F.to_json(F.struct("row_order")))
    rep = {r.file_id: r for r in X.close_out(cells, mappings).collect()}
    assert (rep["a.csv"].entries_count, rep["a.csv"].balanced_entries_count, rep["a.csv"].is_balanced) == (20, 20, True)
    assert (rep["b.csv"].entries_count, rep["b.csv"].balanced_entries_count, rep["b.csv"].rows) == (20, 19, 40)
    kinds = {(r.section, r["item"]) for r in X.decision_report(mappings).collect() if r.file_id == "b.csv"}
    assert {("numeric", "debit_amount"), ("numeric", "credit_amount"), ("resolution", "no_conflict")} <= kinds
