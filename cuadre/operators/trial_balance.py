"""Trial-balance normalisation (X08: P14-P17, T02, T07, N02, P03, S20) over a raw-cells table
(file_id, row_no, cells array<string>) - the layout of a spreadsheet export, one row per sheet row.

Per file the header row and the column roles are decided on a one-row-per-file metadata table (header cells); the
data rows are then projected by position. Everything is grouped per file; no file is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.functions.numbers import with_cleaned
from cuadre.functions.text import clean_account_number, normalize_text

TRIAL_BALANCE_FIELDS = [  # fixed value: output schema
    "gl_account_number", "reporting_account", "fiscal_year", "period_number", "period_ending_balance",
    "period_activity_debit", "period_activity_credit", "period_beginning_balance", "period_ending_date",
    "business_unit", "cost_center", "department", "user_defined_01", "user_defined_02", "user_defined_03",
]


def header_rows(cells: DataFrame) -> DataFrame:
    """Per file, the first row with one cell containing CUENTA and one containing SALDO (normalised)."""
    norm = F.transform("cells", lambda c: normalize_text(c))
    hit = F.exists(norm, lambda c: c.contains("CUENTA")) & F.exists(norm, lambda c: c.contains("SALDO"))
    return (cells.where(hit).groupBy("file_id")
                 .agg(F.min_by(F.struct("row_no", "cells"), F.col("row_no")).alias("h"))
                 .select("file_id", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("header")))


def column_roles(headers: DataFrame) -> DataFrame:
    """P14/P15/P17 per file: positions (0-based) of the account, local account, ending and beginning balance.

    Account columns: CUENTA or CTA and no '#'; fewer than 3 -> the file is rejected (``error``); exactly 3 -> the
    third; more -> the second-to-last is the account, the last the local account. Ending balance: first column with
    SALDO and FINAL. Beginning: the 'SALDO 31/12/20YY' column with the smallest year, else SALDO + INICIAL."""
    h = headers.select("file_id", F.posexplode("header").alias("pos", "name"))
    h = h.withColumn("norm", normalize_text(F.col("name")))
    acc = (F.col("norm").contains("CUENTA") | F.col("norm").contains("CTA")) & ~F.col("norm").contains("#")
    year = F.regexp_extract(F.col("name"), r"(20\d{2})", 1).try_cast("int")
    hist = F.col("norm").rlike(r"^SALDO 31/12/20\d{2,4}") & year.isNotNull()
    roles = h.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(acc, F.col("pos")))).alias("acc"),
        F.min(F.when(F.col("norm").contains("SALDO") & F.col("norm").contains("FINAL"), F.col("pos")))
         .alias("ending_pos"),
        F.min_by(F.when(hist, F.col("pos")), F.when(hist, F.struct(year, F.col("pos")))).alias("oldest_pos"),
        F.min(F.when(F.col("norm").contains("SALDO") & F.col("norm").contains("INICIAL"), F.col("pos")))
         .alias("initial_pos"))
    n = F.size("acc")
    return roles.select(
        "file_id",
        F.when(n == 3, F.element_at("acc", 3)).when(n > 3, F.element_at("acc", -2)).alias("account_pos"),
        F.when(n > 3, F.element_at("acc", -1)).alias("local_account_pos"),
        "ending_pos", F.coalesce("oldest_pos", "initial_pos").alias("beginning_pos"),
        F.when(n < 3, F.lit("not enough account columns"))
         .when(F.col("ending_pos").isNull(), F.lit("no ending balance column")).alias("error"))


def trial_balance(cells: DataFrame) -> DataFrame:
    """Per valid file, data rows after the header -> the 15 trial-balance columns (money as decimal(18,2),
    absent fields ''), plus file_id and row_no. Rejected files are reported by ``column_roles``."""
    hdr = header_rows(cells)
    roles = column_roles(hdr).where(F.col("error").isNull())
    meta = hdr.select("file_id", "header_row").join(roles, "file_id")
    rows = cells.join(meta, "file_id").where(F.col("row_no") > F.col("header_row"))

    def cell(pos):
        return F.get(F.col("cells"), pos)

    raw = rows.select("file_id", "row_no", cell(F.col("account_pos")).alias("__acc"),
                      cell(F.col("ending_pos")).alias("__end"),
                      F.when(F.col("beginning_pos").isNotNull(), cell(F.col("beginning_pos"))).alias("__beg"))
    # staged N02 (each intermediate computed once; keeps the projection inside codegen limits)
    raw = with_cleaned(raw, {"__end_n": "__end", "__beg_n": "__beg"}, "clean_trial_balance_number")
    present = {
        "gl_account_number": clean_account_number(F.col("__acc")),
        "period_ending_balance": F.col("__end_n").cast("decimal(18,2)"),
        "period_beginning_balance": F.col("__beg_n").cast("decimal(18,2)"),
    }
    return raw.select("file_id", "row_no", *[present[f].alias(f) if f in present else F.lit("").alias(f)
                                             for f in TRIAL_BALANCE_FIELDS])
