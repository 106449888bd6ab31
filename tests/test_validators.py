"""Validator scores on the reference's inline validator table, with expectations derived from the scoring code."""

import pytest
from pyspark.sql import functions as F

from cuadre.functions import validators as V

CASES = [
    ("journal_entry_id", "JE123456789", 1.0), ("journal_entry_id", "20240001234", 1.0),
    ("journal_entry_id", "AST12345678", 1.0), ("journal_entry_id", "01/01/2024", 0.0),
    ("line_number", "1", 1.0), ("line_number", "3", 1.0), ("line_number", "18-dic-23", 0.0),
    ("posting_date", "01/01/2024", 1.0), ("posting_date", "2024-01-01", 1.0), ("posting_date", "01-JAN-24", 1.0),
    ("posting_date", "123456789", -0.3),
    ("amount", "1.234,56", 1.0), ("amount", "EUR", 0.0), ("amount", "-22.128.00", 0.0),
    ("debit_credit_indicator", "D", 1.0), ("debit_credit_indicator", "H", 1.0),
    ("debit_credit_indicator", "-22.128.00", 0.0), ("debit_credit_indicator", "0", 1.0),
    ("gl_account_number", "430.0001", 1.0), ("gl_account_number", "43-0001X", 0.6), ("gl_account_number", "5", 0.0), ("gl_account_number", "4300", 1.0),
    ("fiscal_year", "2024", 1.0), ("fiscal_year", "FY24", 0.9), ("fiscal_year", "24", 0.8),
    ("period_number", "3", 1.0), ("period_number", "30", 0.6), ("period_number", "MARZO", 0.9),
    ("period_number", "Q2", 0.9),
    ("description", "Pago a proveedor", 1.0), ("description", "123", 0.0), ("description", "abc", 0.7),
]


@pytest.mark.parametrize("field,value,expected", CASES)
def test_single_value_scores(spark, field, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.agg(V.column_score(field, F.col("v")).alias("s")).first().s
    assert got == pytest.approx(expected), (field, value, got)


def test_registry(spark):
    V.register_validator("cost_center", V.score_cost_center)
    assert "cost_center" in V.list_validators()
    df = spark.createDataFrame([("CC01",), ("x",)], "v string")
    assert df.agg(V.column_score("cost_center", F.col("v"))).first()[0] == pytest.approx(0.5)
    del V.VALIDATORS["cost_center"]
