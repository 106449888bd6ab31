"""Scans, sinks and the streaming balance on small files written to a fresh scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from cuadre.operators import catalog_ops as CO
from cuadre.operators import journal as J
from cuadre.sources import catalog as C
from cuadre.sources import io
from cuadre.streaming import journal_stream as S


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


def test_ledger_scan_and_canonical_journal(spark):
    d = tempfile.mkdtemp(prefix="cuadre-io-")
    _write(os.path.join(d, "a.csv"), "NumAsiento,FechaAsiento,Debe,Haber\n1,05/01/2024,\"1.234,56\",\n"
                                     "1,05/01/2024,,\"1.234,56\"\n2,06/01/2024,10,\n")
    _write(os.path.join(d, "b.csv"), "Asiento,Fecha,Importe\nX1,2024-02-01,-5\nX1,2024-02-01,5\n")
    a = io.read_ledger_csv(spark, os.path.join(d, "a.csv"))
    assert a.columns[:2] == ["file_id", "row_id"] and a.count() == 3
    canon = J.canonical_journal(a, {"NumAsiento": "journal_entry_id", "FechaAsiento": "posting_date",
                                    "Debe": "debit_amount", "Haber": "credit_amount"})
    rows = {(r.journal_entry_id, r.amount, r.debit_credit_indicator, r.posting_date)
            for r in canon.select("journal_entry_id", "amount", "debit_credit_indicator", "posting_date").collect()}
    assert rows == {("1", 1234.56, "D", "2024-01-05"), ("1", -1234.56, "H", "2024-01-05"),
                    ("2", 10.0, "D", "2024-01-06")}
    lake = io.read_ledger_lake(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")])
    assert lake.select("file_id").distinct().count() == 2
    assert lake.where(F.col("column") == "Importe").count() == 2


def test_text_lines_large_mode_matches_small(spark):
    d = tempfile.mkdtemp(prefix="cuadre-io-")
    p = os.path.join(d, "r.txt")
    _write(p, "HEADER|A\r\n-----------\nline one\n\nlast\n")
    small = io.read_text_lines(spark, p).orderBy("line_no").collect()
    large = io.read_text_lines(spark, p, large=True).orderBy("line_no").collect()
    assert [r.text for r in small] == ["HEADER|A", "-----------", "line one", "", "last"]
    assert [(r.line_no, r.text, r.prev_text, r.next_text) for r in small] == \
           [(r.line_no, r.text, r.prev_text, r.next_text) for r in large]


def test_sniff_delimiter_listing(spark):
    d = tempfile.mkdtemp(prefix="cuadre-io-")
    _write(os.path.join(d, "s.csv"), "a;b;c\n1;2;3\n", encoding="utf-8-sig")
    enc = io.sniff_encoding(spark, os.path.join(d, "s.csv")).first().encoding
    assert enc == "utf-8-sig"
    assert io.choose_delimiter(spark, os.path.join(d, "s.csv")).first().sep == ";"
    lst = io.input_listing(spark, os.path.join(d, "s.csv")).first()
    assert lst.extension == "csv" and lst.accepted and not lst.size_warning


def test_sink_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="cuadre-io-")
    df = spark.createDataFrame([("1", " a "), ("2", "")], "journal_entry_id string, text string")
    out = os.path.join(d, "out")
    io.write_table(df, out, fmt="csv", quote_all=True, sort_within=["journal_entry_id"])
    back = io.read_predictions(spark, out)
    assert sorted((r.journal_entry_id, r.text) for r in back.collect()) == [("1", " a "), ("2", "")]


def test_catalogue_upsert_and_learning(spark):
    syn = C.synonyms(spark)
    maps = spark.createDataFrame([("f", "Importe", "amount"), ("f", "ImporteEUR", "amount")],
                                 "file_id string, column string, field_type string")
    new = CO.learned_synonyms(maps, syn)
    assert [r.name for r in new.collect()] == ["ImporteEUR"]
    v2 = CO.upsert_synonyms(syn, new)
    assert v2.count() == syn.count() + 1
    stats = {(r.field_type, r.erp): r.synonyms for r in CO.catalogue_stats(v2).collect()}
    assert stats[("amount", "Generic_ES")] == 4
    valid, rejected = C.valid_synonyms(spark.createDataFrame(
        [("amount", "X", "", 0.5, 0, None, False), ("amount", "X", "ok", 1.5, 1, None, False)], C.SYNONYM_SCHEMA))
    assert valid.count() == 0 and rejected.count() == 2


def test_streaming_entry_balance(spark):
    d = tempfile.mkdtemp(prefix="cuadre-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    _write(os.path.join(src, "1.csv"), "Asiento,Importe\nA,\"1.000,00\"\nA,\"-1.000,00\"\nB,5\n")
    lines = S.ledger_stream(spark, src, ["Asiento", "Importe"])
    q = S.start_balance_query(S.streaming_entry_balance(lines, {"Asiento": "journal_entry_id",
                                                                "Importe": "amount"}),
                              os.path.join(d, "ckpt"), name="bal_test")
    q.processAllAvailable()
    _write(os.path.join(src, "2.csv"), "Asiento,Importe\nB,-5\n")
    q.processAllAvailable()
    q.stop()
    latest = spark.sql("SELECT journal_entry_id, max_by(is_balanced, lines) AS ok FROM bal_test "
                       "GROUP BY journal_entry_id").collect()
    assert {r.journal_entry_id: r.ok for r in latest} == {"A": True, "B": True}


def test_learned_patterns_and_mapping_table(spark):
    from cuadre.operators import mapping as M
    from cuadre.operators import patterns as PT
    from cuadre.operators import profile as P
    sample = spark.createDataFrame([("f", "c1", 1, "AB12", i) for i in range(1, 5)] +
                                   [("f", "c2", 2, "hello", i) for i in range(1, 5)],
                                   "file_id string, column string, ordinal int, value string, rn int")
    pats = spark.createDataFrame([("vendor_id", "^[A-Z]{2}\\d{2}$"), ("vendor_id", "^X")], "field_type string, regex string")
    got = {(r.column, r.field_type): r.score for r in P.learned_pattern_scores(sample, pats).collect()}
    assert got == {("c1", "vendor_id"): 1.0}
    cp = PT.char_class_pattern(sample).withColumn("rx", PT.pattern_to_regex("char_pattern"))
    assert {r.column: r.rx for r in cp.collect()} == {"c1": "^[A-Z]{2}\\d{2}$", "c2": "^[a-z]{5}$"}
    maps = spark.createDataFrame([("f", "c1", "vendor_id", 0.9)], "file_id string, column string, field_type string, "
                                                                  "confidence double")
    files = sample.select("file_id").distinct()
    table = M.mapping_table(maps, files)
    assert table.count() == len(M.STANDARD_FIELDS)
    assert table.where("column = 'No mapeado'").count() == len(M.STANDARD_FIELDS) - 1
    assert M.unmapped_fields(maps, files).count() == len(M.STANDARD_FIELDS) - 1
