"""Views that present the driver tables in the reference's data model.

The reference works on general-ledger exports; the driver provides order/lineitem tables, documents and chats. These
views derive ledger-shaped data from them with Spark expressions only, so every query's work grows with the tables.

* ``lineitem_journal``: one journal entry per order (``journal_entry_id = l_orderkey``). Every lineitem posts a debit
  line of its extended price; a fulfilled line (``l_linestatus = 'F'``) also posts the matching credit line. Entries
  whose lines are all fulfilled therefore balance, the others do not. One scan + a Generate, no shuffle.
* ``raw_ledger``: lineitem rendered as a raw text export, the shape the cleaning operators expect: every column a
  string, amounts as European / US / plain / parenthesised number text chosen by ``l_linenumber``, dates as
  ``dd/MM/yyyy`` and ISO timestamps, a D/H indicator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadre.sources.tables import table

MONEY = "decimal(18,2)"


def lineitem_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate")
    price = F.col("l_extendedprice").cast(MONEY)
    sides = F.when(F.col("l_linestatus") == "F", F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    return (li.select("*", F.explode(sides).alias("side"))
              .select(F.col("l_orderkey").alias("journal_entry_id"),
                      F.col("l_linenumber").alias("line_number"),
                      F.when(F.col("side") > 0, price).otherwise(-price).alias("amount"),
                      F.when(F.col("side") > 0, F.lit("D")).otherwise(F.lit("H")).alias("debit_credit_indicator"),
                      F.col("l_returnflag"), F.col("l_shipdate")))


def grouped_digits_sql(d: str, sep: str) -> str:
    """SQL text: integer digit string ``d`` with a thousands separator, up to 12 digits (substring arithmetic only,
    valid in Spark SQL and DuckDB alike)."""
    g1 = f"right({d}, 3)"
    g2 = f"substring({d}, length({d}) - 5, 3)"
    g3 = f"substring({d}, length({d}) - 8, 3)"
    return (f"CASE WHEN length({d}) <= 3 THEN {d} "
            f"WHEN length({d}) <= 6 THEN concat(left({d}, length({d}) - 3), '{sep}', {g1}) "
            f"WHEN length({d}) <= 9 THEN concat(left({d}, length({d}) - 6), '{sep}', {g2}, '{sep}', {g1}) "
            f"ELSE concat(left({d}, length({d}) - 9), '{sep}', {g3}, '{sep}', {g2}, '{sep}', {g1}) END")


def money_text_sql(x: str, style: str) -> str:
    """SQL text rendering a non-negative decimal(18,2) expression ``x``: eu '1.234,56', us '1,234.56', plain
    '1234.56'."""
    s = f"CAST({x} AS STRING)" if style != "duck" else f"CAST({x} AS VARCHAR)"
    int_part = f"split_part({s}, '.', 1)"
    frac = f"split_part({s}, '.', 2)"
    if style == "eu":
        return f"concat({grouped_digits_sql(int_part, '.')}, ',', {frac})"
    if style == "us":
        return f"concat({grouped_digits_sql(int_part, ',')}, '.', {frac})"
    return s


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a raw string ledger (one row per lineitem; ``row_id`` is an orderable struct standing for file
    order, used for 'first row' semantics).

    Columns: row_id, asiento, linea, fecha (dd/MM/yyyy), fecha_hora (yyyy-MM-dd HH:mm:ss), importe (mixed text
    styles by line number; returns 'R' are negative), debe, haber (European text, '' on the other side), signo (D/H).
    """
    li = table(spark, sf_dir, "lineitem")
    # staged rendering: the decimal text and its integer / fraction parts are computed once per row, then the
    # European and US forms once each, and every output column reuses them
    li = li.withColumn("__ps", F.col("l_extendedprice").cast(MONEY).cast("string"))
    li = li.withColumns({"__ip": F.split_part("__ps", F.lit("."), F.lit(1)),
                         "__fr": F.split_part("__ps", F.lit("."), F.lit(2))})
    li = li.withColumns({"__eu": F.concat(F.expr(grouped_digits_sql("__ip", ".")), F.lit(","), F.col("__fr")),
                         "__us": F.concat(F.expr(grouped_digits_sql("__ip", ",")), F.lit("."), F.col("__fr"))})
    eu, us, plain = F.col("__eu"), F.col("__us"), F.col("__ps")
    neg = F.col("l_returnflag") == "R"
    style = F.col("l_linenumber") % 4
    importe = (F.when(style == 0, F.when(neg, F.concat(F.lit("-"), eu)).otherwise(eu))
                .when(style == 1, F.when(neg, F.concat(F.lit("-"), us)).otherwise(us))
                .when(style == 2, F.when(neg, F.concat(F.lit("-"), plain)).otherwise(plain))
                .otherwise(F.when(neg, F.concat(F.lit("("), eu, F.lit(")"))).otherwise(F.concat(eu, F.lit(" €")))))
    return li.select(
        F.col("l_orderkey").cast("string").alias("asiento"),
        F.col("l_linenumber").cast("string").alias("linea"),
        F.col("l_partkey").cast("string").alias("cuenta"),
        F.col("l_suppkey").cast("string").alias("tercero"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("fecha"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("fecha_hora"),
        importe.alias("importe"),
        F.when(~neg, eu).otherwise(F.lit("")).alias("debe"),
        F.when(neg, eu).otherwise(F.lit("")).alias("haber"),
        F.when(neg, F.lit("H")).otherwise(F.lit("D")).alias("signo"),
        row_order().alias("row_id"),
    )


def row_order():
    """Deterministic file order of lineitem rows: every column, key first ((l_orderkey, l_linenumber) repeats)."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
                    "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linestatus")
