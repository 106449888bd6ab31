"""Trial balance (X08) over spreadsheet-like cell rows derived from customer x nation, and learned character
patterns (T10, T11) of the ledger lake's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.operators import patterns as PT
from cuadre.operators import trial_balance as TB
from cuadre.plans import duck
from cuadre.plans.q_mapping import _sample_sql, lake_sample
from cuadre.plans.registry import query
from cuadre.plans.views import MONEY, money_text_sql
from cuadre.sources.tables import table

TB_HEADER = ["Cta. Grupo", "Cta. Subgrupo", "Cuenta", "Cuenta Local", "Nombre", "Saldo Inicial",
             "SALDO 31/12/2023", "SALDO 31/12/2022", "Saldo Final"]


def tb_cells(spark, sf):
    """One 'sheet' per nation: a title row, a header row, then one row per customer with the balance rendered in
    several text styles (European, US, parenthesised negatives, padded) and the account as '123.0'."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    c = c.withColumn("__abs", F.abs(F.col("c_acctbal")).cast(MONEY))
    eu = F.expr(money_text_sql("__abs", "eu"))
    us = F.expr(money_text_sql("__abs", "us"))
    neg = F.col("c_acctbal") < 0
    data = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("file_id"), (F.col("c_custkey") + 2).alias("row_no"),
        F.array(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"),
                F.concat(F.col("c_custkey").cast("string"), F.lit(".0")),
                F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.col("c_name"),
                F.when(neg, F.concat(F.lit("-"), eu)).otherwise(eu),
                F.when(neg, F.concat(F.lit("-"), us)).otherwise(us),
                F.concat(F.lit(" "), F.when(neg, F.concat(F.lit("("), eu, F.lit(")"))).otherwise(eu), F.lit(" ")),
                F.when(neg, F.concat(F.lit("("), eu, F.lit(")"))).otherwise(eu)).alias("cells"))
    title = n.select(F.col("n_name").alias("file_id"), F.lit(0).cast("long").alias("row_no"),
                     F.array(F.lit("BALANCE DE SUMAS Y SALDOS"), F.col("n_name")).alias("cells"))
    header = n.select(F.col("n_name").alias("file_id"), F.lit(1).cast("long").alias("row_no"),
                      F.array(*[F.lit(h) for h in TB_HEADER]).alias("cells"))
    return title.unionByName(header).unionByName(data)


def _tb_oracle():
    cols = {"gl_account_number": "CAST(c_custkey AS VARCHAR)",
            "period_ending_balance": f"CAST(c_acctbal AS {duck.MONEY})",
            "period_beginning_balance": f"CAST(c_acctbal AS {duck.MONEY})"}
    sel = ", ".join(f"{cols[f]} AS {f}" if f in cols else f"'' AS {f}" for f in TB.TRIAL_BALANCE_FIELDS)
    return f"""
  SELECT n_name AS file_id, c_custkey + 2 AS row_no, {sel}
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query("trial_balance", ("X08", "P14", "P15", "P16", "P17", "T02", "T07", "N02", "S20"), oracle=_tb_oracle())
def q_trial_balance(spark, sf):
    return TB.trial_balance(tb_cells(spark, sf))


_LETTER = """CASE WHEN bool_and(regexp_matches(c, '^\\p{Nd}$')) THEN 'D'
                  WHEN bool_and(regexp_matches(c, '^\\p{Lu}$')) THEN 'U'
                  WHEN bool_and(regexp_matches(c, '^\\p{Ll}$')) THEN 'L'
                  WHEN bool_and(regexp_matches(c, '^\\p{L}$')) THEN 'A'
                  WHEN bool_and(strpos('.,;:-_/', c) > 0) THEN 'P'
                  WHEN bool_and(regexp_matches(c, '^\\s$')) THEN 'W' ELSE 'X' END"""
_RX = "CASE letter " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PT.CLASS_REGEX.items()) + " END"


@query("char_pattern", ("T10", "T11"), oracle=f"""
  WITH {_sample_sql(10)},
  lens AS (SELECT file_id, "column", count(DISTINCT length(value)) AS nl, max(length(value)) AS ml
           FROM sample GROUP BY ALL),
  ch AS (SELECT file_id, "column", unnest(string_split(value, '')) AS c,
                generate_subscripts(string_split(value, ''), 1) AS pos FROM sample),
  per AS (SELECT file_id, "column", pos, {_LETTER} AS letter FROM ch WHERE c <> '' GROUP BY ALL),
  runs AS (SELECT *, sum(CASE WHEN letter = prev THEN 0 ELSE 1 END)
                       OVER (PARTITION BY file_id, "column" ORDER BY pos) AS run
           FROM (SELECT *, lag(letter) OVER (PARTITION BY file_id, "column" ORDER BY pos) AS prev FROM per) q),
  r2 AS (SELECT file_id, "column", run, any_value(letter) AS letter, count(*) AS len FROM runs GROUP BY ALL),
  pat AS (SELECT file_id, "column", string_agg(letter, '' ORDER BY pos) AS p FROM per GROUP BY ALL),
  rx AS (SELECT file_id, "column", '^' || string_agg({_RX} || '{{' || len || '}}', '' ORDER BY run) || '$' AS r
         FROM r2 GROUP BY ALL)
  SELECT l.file_id, l."column", CASE WHEN nl = 1 AND ml > 0 THEN p END AS char_pattern,
         CASE WHEN nl = 1 AND ml > 0 THEN r END AS regex
  FROM lens l LEFT JOIN pat USING (file_id, "column") LEFT JOIN rx USING (file_id, "column")""")
def q_char_pattern(spark, sf):
    # the first 10 values of the shared 100-value sample are exactly the first 10 values (same row order)
    p = PT.char_class_pattern(lake_sample(spark, sf), first_n=10)
    return p.withColumn("regex", PT.pattern_to_regex("char_pattern"))
