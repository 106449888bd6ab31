"""Balance family over the lineitem journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.operators import balance as B
from cuadre.plans.registry import query
from cuadre.plans.views import MONEY, lineitem_journal
from cuadre.sources.tables import table

# DuckDB form of ``lineitem_journal``
JOURNAL_SQL = f"""
  SELECT l_orderkey AS journal_entry_id, l_linenumber AS line_number,
         CAST(l_extendedprice AS {MONEY}) AS amount, 'D' AS debit_credit_indicator
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, -CAST(l_extendedprice AS {MONEY}), 'H'
  FROM lineitem WHERE l_linestatus = 'F'
"""

ENTRY_SQL = f"""
  SELECT journal_entry_id, COALESCE(SUM(amount), 0) AS s
  FROM ({JOURNAL_SQL}) j WHERE journal_entry_id IS NOT NULL GROUP BY journal_entry_id
"""


def _money_out(df, *cols):
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("entry_balance", ("A02", "A04"), oracle=f"""
  SELECT journal_entry_id, CAST(s AS DOUBLE) AS amount_sum, CAST(s AS DOUBLE) AS balance_difference,
         abs(s) < 0.01 AS is_balanced
  FROM ({ENTRY_SQL}) e""")
def q_entry_balance(spark, sf):
    return _money_out(B.entry_balance(lineitem_journal(spark, sf)), "amount_sum", "balance_difference")


@query("unbalanced_entries", ("A03",), oracle=f"""
  SELECT journal_entry_id, CAST(s AS DOUBLE) AS amount_sum, CAST(s AS DOUBLE) AS balance_difference,
         false AS is_balanced
  FROM ({ENTRY_SQL}) e WHERE NOT (abs(s) < 0.01)""")
def q_unbalanced_entries(spark, sf):
    return _money_out(B.unbalanced_entries(lineitem_journal(spark, sf)), "amount_sum", "balance_difference")


@query("total_balance", ("A01",), oracle=f"""
  SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount_sum,
         CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_balance_difference,
         abs(COALESCE(SUM(amount), 0)) < 0.01 AS is_balanced
  FROM ({JOURNAL_SQL}) j""")
def q_total_balance(spark, sf):
    return _money_out(B.total_balance(lineitem_journal(spark, sf)), "total_amount_sum", "total_balance_difference")


@query("balance_report", ("A06", "A07", "A08"), oracle=f"""
  WITH t AS (SELECT COALESCE(SUM(amount), 0) AS tot FROM ({JOURNAL_SQL}) j),
       e AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE abs(s) < 0.01) AS b FROM ({ENTRY_SQL}) x)
  SELECT CAST(tot AS DOUBLE) AS total_amount_sum, abs(tot) < 0.01 AS is_balanced,
         n AS entries_count, b AS balanced_entries_count, n - b AS unbalanced_entries_count,
         CASE WHEN n > 0 THEN CAST(b AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 END AS balance_rate_pct,
         CASE WHEN n > 0 THEN CAST(abs(tot) < 0.01 AS DOUBLE) * 0.5 + CAST(b AS DOUBLE) / CAST(n AS DOUBLE) * 0.5
              ELSE CAST(abs(tot) < 0.01 AS DOUBLE) END AS quality_score
  FROM t, e""")
def q_balance_report(spark, sf):
    return _money_out(B.balance_report(lineitem_journal(spark, sf)), "total_amount_sum")


@query("unbalanced_top10", ("K07",), oracle=f"""
  WITH u AS (SELECT journal_entry_id, s FROM ({ENTRY_SQL}) e WHERE NOT (abs(s) < 0.01))
  SELECT journal_entry_id, CAST(s AS DOUBLE) AS amount_sum, CAST(s AS DOUBLE) AS balance_difference,
         (SELECT COUNT(*) FROM u) - least((SELECT COUNT(*) FROM u), 10) AS remaining_unbalanced
  FROM u ORDER BY journal_entry_id LIMIT 10""")
def q_unbalanced_top10(spark, sf):
    return _money_out(B.unbalanced_sample(lineitem_journal(spark, sf), 10), "amount_sum", "balance_difference")


_CANDIDATE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS candidate, CAST({c} AS VARCHAR) AS key_value, amount FROM jr"
    for c in ("l_orderkey", "l_partkey", "l_suppkey"))


@query("key_candidate_quality", ("J08", "A05", "W10"), oracle=f"""
  WITH jr AS (
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_extendedprice AS {MONEY}) AS amount FROM lineitem
    UNION ALL
    SELECT l_orderkey, l_partkey, l_suppkey, -CAST(l_extendedprice AS {MONEY}) FROM lineitem
    WHERE l_linestatus = 'F'),
  k AS (SELECT candidate, key_value, COALESCE(SUM(amount), 0) AS s FROM ({_CANDIDATE_SQL}) u
        WHERE key_value IS NOT NULL GROUP BY candidate, key_value)
  SELECT candidate, COUNT(*) AS entries_count, COUNT(*) FILTER (WHERE abs(s) < 0.01) AS balanced_entries,
         COUNT(*) - COUNT(*) FILTER (WHERE abs(s) < 0.01) AS unbalanced_entries,
         CAST(COUNT(*) FILTER (WHERE abs(s) < 0.01) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS quality_score,
         CAST(CASE candidate WHEN 'l_orderkey' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence,
         CAST(0.7 AS DOUBLE) * (CAST(COUNT(*) FILTER (WHERE abs(s) < 0.01) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE))
           + CAST(0.3 AS DOUBLE) * CAST(CASE candidate WHEN 'l_orderkey' THEN 0.7 ELSE 0.6 END AS DOUBLE)
           AS combined_score
  FROM k GROUP BY candidate""")
def q_key_candidate_quality(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
                                             "l_linestatus")
    price = F.col("l_extendedprice").cast(MONEY)
    sides = F.when(F.col("l_linestatus") == "F", F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    jr = (li.select("*", F.explode(sides).alias("side"))
            .select("l_orderkey", "l_partkey", "l_suppkey",
                    F.when(F.col("side") > 0, price).otherwise(-price).alias("amount")))
    # candidate confidences as the mapper's content profile would give them (id-like columns, repeats present)
    conf = spark.createDataFrame([("l_orderkey", 0.7), ("l_partkey", 0.6), ("l_suppkey", 0.6)],
                                 "candidate string, confidence double")
    return B.key_candidate_quality(jr, ["l_orderkey", "l_partkey", "l_suppkey"], confidence=conf)


# two ledgers with the same journal ids: the second holds the first's entries of fulfilled lines only, all negative,
# so an id that is open in one ledger may balance or not in the other, and never both together
TWO_LEDGERS_SQL = f"""
  SELECT 'f1' AS file_id, journal_entry_id, amount FROM ({JOURNAL_SQL}) j
  UNION ALL
  SELECT 'f2', l_orderkey, -CAST(l_extendedprice AS {MONEY}) FROM lineitem WHERE l_linestatus <> 'F'
"""


def two_ledgers(spark, sf):
    j = lineitem_journal(spark, sf).select(F.lit("f1").alias("file_id"), "journal_entry_id", "amount")
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus") != "F")
    return j.unionByName(li.select(F.lit("f2").alias("file_id"), F.col("l_orderkey").alias("journal_entry_id"),
                                   (-F.col("l_extendedprice").cast(MONEY)).alias("amount")))


@query("lake_entry_balance", ("A02", "A03", "A04"), oracle=f"""
  WITH e AS (SELECT file_id, journal_entry_id, sum(amount) AS s FROM ({TWO_LEDGERS_SQL}) t GROUP BY ALL)
  SELECT file_id, journal_entry_id, CAST(s AS DOUBLE) AS amount_sum, CAST(s AS DOUBLE) AS balance_difference,
         abs(s) < 0.01 AS is_balanced FROM e""")
def q_lake_entry_balance(spark, sf):
    return _money_out(B.entry_balance(two_ledgers(spark, sf), group_cols=["file_id"]), "amount_sum", "balance_difference")


@query("lake_balance_report", ("A01", "A05", "A06", "A07", "A08"), oracle=f"""
  WITH e AS (SELECT file_id, journal_entry_id, sum(amount) AS s FROM ({TWO_LEDGERS_SQL}) t GROUP BY ALL),
  r AS (SELECT file_id, sum(s) AS tot, count(*) AS n, count(*) FILTER (WHERE abs(s) < 0.01) AS b FROM e GROUP BY file_id)
  SELECT file_id, CAST(tot AS DOUBLE) AS total_amount_sum, abs(tot) < 0.01 AS is_balanced, n AS entries_count,
         b AS balanced_entries_count, n - b AS unbalanced_entries_count, CAST(b AS DOUBLE) / n * 100.0 AS balance_rate_pct,
         CAST(abs(tot) < 0.01 AS DOUBLE) * 0.5 + CAST(b AS DOUBLE) / n * 0.5 AS quality_score FROM r""")
def q_lake_balance_report(spark, sf):
    return _money_out(B.balance_report(two_ledgers(spark, sf), group_cols=["file_id"]), "total_amount_sum")
