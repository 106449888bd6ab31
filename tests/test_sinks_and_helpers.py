"""Written tables read back, a model saved and loaded, and the small library functions without a query."""

import os

import pytest
from pyspark.sql import functions as F

from cuadre.functions import numbers as N
from cuadre.operators import catalog_ops as CO
from cuadre.operators import journal as J
from cuadre.operators import lines as L
from cuadre.operators import mapping as M
from cuadre.operators import ml
from cuadre.operators import patterns as PT
from cuadre.sources import catalog as C
from cuadre.sources import io


def journal(spark):
    rows = [("b", "1", 10.5, "2024-01-02", " two ", 2), ("a", "1", -10.5, "2024-01-01", 'say "x", y', 1), (None, "1", 3.0, None, "", 3)]
    return spark.createDataFrame(rows, "journal_entry_id string, line_number string, amount double, posting_date string, description string, row_id int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_header_and_detail_round_trip(spark, tmp_path, fmt):
    for name, df in (("header", J.journal_header(journal(spark))), ("detail", J.journal_detail(journal(spark)))):
        path = os.path.join(tmp_path, name)
        io.write_table(df, path, fmt=fmt, quote_all=True, sort_within=["journal_entry_id"] if "journal_entry_id" in df.columns else None)
        if fmt == "csv":
            back = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", "\\").csv(path)
            text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
            assert rows(back.fillna("").select(*df.columns)) == rows(text)
        else:
            back = spark.read.schema(df.schema).format(fmt).load(path)
            assert rows(back.select(*df.columns)) == rows(df)


def test_predictions_pair_and_labelled_lines(spark, tmp_path):
    pred = spark.createDataFrame([(" a,b ", "CHILD", 0.9), ("", "DATA", 0.4)], "text string, predicted_label string, confidence double")
    for name, df in (("simple", pred.select("text", "predicted_label")), ("detailed", pred)):
        io.write_table(df, os.path.join(tmp_path, name), fmt="csv", quote_all=True)
        back = io.read_predictions(spark, os.path.join(tmp_path, name))
        assert rows(back) == rows(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))
    assert L.label_column(pred) == "predicted_label"
    assert [r.text for r in L.low_confidence(pred).collect()] == [""]
    stats = L.confidence_stats(pred).first()
    assert (stats.min_confidence, stats.max_confidence) == (0.4, 0.9)
    io.write_table(spark.createDataFrame([("x", " child "), ("y", "data")], "text string, label string"), os.path.join(tmp_path, "labels"), fmt="csv")
    got = io.read_labelled_lines(spark, os.path.join(tmp_path, "labels"))
    assert rows(got) == [("x", "CHILD"), ("y", "DATA")] and L.label_column(got) == "label"
    with pytest.raises(ValueError):
        io.read_labelled_lines(spark, os.path.join(tmp_path, "simple"))
    with pytest.raises(ValueError):
        L.label_column(spark.createDataFrame([(1,)], "x int"))


def test_split_sets_are_written_apart(spark, tmp_path):
    df = ml.stratified_split(spark.range(300).withColumn("label", F.lit("a")), "id")
    io.write_table(df, os.path.join(tmp_path, "sets"), partition_by=["split"])
    back = spark.read.parquet(os.path.join(tmp_path, "sets"))
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sorted(d for d in os.listdir(os.path.join(tmp_path, "sets")) if "=" in d) == ["split=test", "split=train", "split=validation"]


def test_model_round_trip(spark, tmp_path):
    data = spark.createDataFrame([(i, float(i % 7), float(i % 3), "CHILD" if i % 7 > 3 else "DATA") for i in range(120)], "id int, x double, y double, label string")
    model = ml.build_pipeline(["x", "y"], num_trees=5, max_depth=4).fit(ml.with_weights(data))
    io.save_model(model, os.path.join(tmp_path, "model"))
    again = io.load_model(os.path.join(tmp_path, "model"))
    a, b = (rows(ml.predict(m, data, ["id"]).select("id", "predicted_label", "confidence")) for m in (model, again))
    assert a == b and sum(p == "CHILD" for _, p, _ in a) == sum(i % 7 > 3 for i in range(120))


def test_catalogue_export_and_lists(spark, tmp_path):
    defs, syn = C.field_definitions(spark), C.synonyms(spark)
    io.export_catalogue(defs, syn, ["amount"], os.path.join(tmp_path, "catalogue"))
    out = spark.read.json(os.path.join(tmp_path, "catalogue"))
    assert out.count() == defs.count() - 1 and out.where("field_type = 'amount'").isEmpty()
    assert CO.distinct_synonyms(syn, "SAP").count() == len({(f, n) for f, e, n, _ in C.SYNONYMS if e == "SAP"})
    assert [r.erp for r in CO.distinct_values(syn, "erp").collect()] == sorted({e for _, e, _, _ in C.SYNONYMS})
    std = spark.createDataFrame([("b",), ("a",)], "field_type string")
    assert [r.field_type for r in CO.standard_and_mapped(std, spark.createDataFrame([("c",), ("a",)], "field_type string")).collect()] == ["a", "b", "c"]


def test_order_sign_and_boost(spark):
    assert [r.journal_entry_id for r in J.sort_by_journal_id(journal(spark)).collect()] == ["a", "b", None]
    maps = spark.createDataFrame([("f", " Importe ", "amount", 0.9), ("f", "x", "amount", 0.95), ("f", "y", "vendor_id", 0.3)],
                                 "file_id string, column string, field_type string, confidence double")
    assert [r.column for r in M.by_priority(maps).collect()] == ["x", " Importe ", "y"]
    names = spark.createDataFrame([("importe", "amount"), ("y", "amount")], "name string, field_type string")
    assert {r.column: r.confidence for r in PT.learned_name_boost(maps, names).collect()} == {" Importe ": 1.0, "x": 0.95, "y": 0.3}
    signed = J.signed_amount(spark.createDataFrame([("f", 5.0, "H"), ("f", 7.0, "D"), ("g", -1.0, "H")], "file_id string, amount double, debit_credit_indicator string"), ["file_id"])
    assert rows(signed.select("amount")) == [(-1.0,), (-5.0,), (7.0,)]
    sides = spark.createDataFrame([(5.0,), (-3.0,)], "a double").select(N.amount_to_debit("a"), N.amount_to_credit("a"))
    assert rows(sides) == [(0.0, 3.0), (5.0, 0.0)]
    assert spark.createDataFrame([("a", None, 1)], "x string, y string, z int").select(L.row_text(spark.createDataFrame([("a", None, 1)], "x string, y string, z int"))).first()[0] == "a  1"
