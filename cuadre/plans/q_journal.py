"""Journal family over the raw lineitem ledger: cleaning (N01-N05, A26), scenarios (P18, N06-N08), canonical
journal header / detail (X04: P01, P03-P06, J06, A27, D06) and date handling (D01-D12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.functions import dates as D
from cuadre.functions import numbers as N
from cuadre.operators import journal as J
from cuadre.plans import duck
from cuadre.plans.registry import query
from cuadre.plans.views import raw_ledger
from cuadre.sources.tables import table

RAW = duck.raw_ledger_cte()
ROW_ORDER = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, "
             "l_quantity, l_discount, l_tax, l_linestatus")

# raw column -> canonical field (what the mapper decides for this export, see map_columns)
LEDGER_MAPPING = {"asiento": "journal_entry_id", "linea": "line_number", "cuenta": "gl_account_number",
                  "tercero": "vendor_id", "fecha": "posting_date", "fecha_hora": "entry_date", "importe": "amount",
                  "signo": "debit_credit_indicator"}


@query("clean_amounts", ("N01", "N02", "N03", "N04", "N05", "S08"), oracle=f"""
  WITH {RAW}
  SELECT importe, {duck.clean_amount('importe')} AS amount_clean, {duck.tb_number('importe')} AS tb_number,
         {duck.manual_amount('importe')} AS manual_amount, {duck.first_number('importe')} AS first_number,
         {duck.is_numeric('importe')} AS is_numeric,
         {duck.clean_amount('debe')} AS debe_clean, {duck.clean_amount('haber')} AS haber_clean
  FROM raw""")
def q_clean_amounts(spark, sf):
    r = raw_ledger(spark, sf).select("importe", "debe", "haber")
    r = N.with_cleaned(r, {"amount_clean": "importe", "debe_clean": "debe", "haber_clean": "haber"})
    r = N.with_cleaned(r, {"tb_number": "importe"}, "clean_trial_balance_number")
    r = N.with_cleaned(r, {"manual_amount": "importe"}, "parse_amount_manual")
    r = N.with_cleaned(r, {"first_number": "importe"}, "first_number")
    return r.select("importe", "amount_clean", "tb_number", "manual_amount", "first_number",
                    N.is_numeric("importe").alias("is_numeric"), "debe_clean", "haber_clean")


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, COUNT(*) FILTER (WHERE {duck.clean_amount(f)} = 0.0) AS zero_values, "
    f"COUNT(*) FILTER (WHERE strpos({f}, '(') > 0) AS parentheses_negatives FROM raw"
    for f in ("debe", "haber", "importe"))


@query("cleaning_stats", ("A26", "N09"), oracle=f"WITH {RAW} {_STATS_SQL}")
def q_cleaning_stats(spark, sf):
    r = raw_ledger(spark, sf).select("importe", "debe", "haber")
    return J.cleaning_stats(r, r)


def _scenarios(spark, sf):
    r = raw_ledger(spark, sf)
    base = r.select(F.col("asiento").alias("journal_entry_id"), F.col("linea").alias("line_number"),
                    "importe", "debe", "haber", "signo")
    s1 = J.apply_amount_scenarios(base.select("journal_entry_id", "line_number", F.col("debe").alias("debit_amount"),
                                              F.col("haber").alias("credit_amount")))
    s2 = J.apply_amount_scenarios(J.clean_numeric_columns(
        base.select("journal_entry_id", "line_number", F.col("importe").alias("amount"))))
    s3 = J.apply_amount_scenarios(J.clean_numeric_columns(
        base.select("journal_entry_id", "line_number", F.col("importe").alias("amount"),
                    F.col("signo").alias("debit_credit_indicator"))))
    s4 = J.apply_amount_scenarios(J.clean_numeric_columns(
        base.select("journal_entry_id", "line_number", F.col("importe").alias("amount"),
                    F.col("debe").alias("debit_amount"), F.col("haber").alias("credit_amount"))))
    cols = ["journal_entry_id", "line_number", "amount", "debit_credit_indicator", "amount_scenario"]
    return s1.select(*cols).unionByName(s2.select(*cols)).unionByName(s3.select(*cols)).unionByName(s4.select(*cols))


def _ind_dc(d, c):
    return f"(CASE WHEN {c} = 0 THEN 'D' WHEN {d} = 0 AND {c} <> 0 THEN 'H' ELSE '' END)"


def _ind_amt(a):
    return f"(CASE WHEN {a} > 0 THEN 'D' WHEN {a} < 0 THEN 'H' ELSE '' END)"


_D, _C, _A = duck.clean_amount("debe"), duck.clean_amount("haber"), duck.clean_amount("importe")


@query("amount_scenarios", ("P18", "N06", "N07", "N08", "N09"), oracle=f"""
  WITH {RAW}
  SELECT asiento AS journal_entry_id, linea AS line_number, {_D} - {_C} AS amount, {_ind_dc(_D, _C)}
         AS debit_credit_indicator, 1 AS amount_scenario FROM raw
  UNION ALL
  SELECT asiento, linea, {_A}, {_ind_amt(_A)}, 2 FROM raw
  UNION ALL
  SELECT asiento, linea, {_A}, signo, 3 FROM raw
  UNION ALL
  SELECT asiento, linea, {_A}, {_ind_dc(_D, _C)}, 4 FROM raw""")
def q_amount_scenarios(spark, sf):
    return _scenarios(spark, sf)


def canonical_lineitem(spark, sf, first_of=None):
    raw = raw_ledger(spark, sf).select(*LEDGER_MAPPING, "row_id")
    return J.canonical_journal(raw, LEDGER_MAPPING, first_of=first_of)


_DETAIL_SQL_COLS = {
    "journal_entry_id": "asiento", "line_number": "linea", "gl_account_number": "cuenta",
    "amount": duck.clean_amount("importe"), "debit_credit_indicator": "signo", "vendor_id": "tercero"}


def _conform_sql(fields, present):
    return ", ".join(f"{present[f]} AS {f}" if f in present else f"'' AS {f}" for f in fields)


@query("canonical_journal_detail", ("X04", "P01", "P03", "P06", "P19", "N09", "S14"), oracle=f"""
  WITH {RAW}
  SELECT {_conform_sql(J.DETAIL_FIELDS, _DETAIL_SQL_COLS)} FROM raw""")
def q_canonical_detail(spark, sf):
    return J.journal_detail(canonical_lineitem(spark, sf))


_HEADER_SQL_COLS = {"journal_entry_id": "asiento", "entry_date": "strftime(l_shipdate, '%Y-%m-%d')",
                    "entry_time": "strftime(l_shipdate, '%H:%M:%S')",
                    "posting_date": "strftime(l_shipdate, '%Y-%m-%d')"}


@query("journal_header", ("J06", "P05", "P03", "D06", "D04", "S13"), oracle=f"""
  WITH {RAW}
  SELECT {_conform_sql(J.HEADER_FIELDS, _HEADER_SQL_COLS)} FROM raw
  QUALIFY row_number() OVER (PARTITION BY asiento ORDER BY {ROW_ORDER}) = 1""")
def q_journal_header(spark, sf):
    return J.journal_header(canonical_lineitem(spark, sf, first_of="journal_entry_id"))


@query("journal_header_first_nonnull", ("A27",), oracle=f"""
  WITH {RAW}, x AS (
    SELECT asiento, CASE WHEN l_returnflag = 'R' THEN tercero END AS vendor_id,
           CASE WHEN l_returnflag = 'A' THEN fecha END AS posting_date, importe,
           row_number() OVER (ORDER BY {ROW_ORDER}) AS rn FROM raw)
  SELECT asiento AS journal_entry_id, arg_min(vendor_id, CASE WHEN vendor_id IS NOT NULL THEN rn END) AS vendor_id,
         arg_min(posting_date, CASE WHEN posting_date IS NOT NULL THEN rn END) AS posting_date,
         arg_min(importe, CASE WHEN importe IS NOT NULL THEN rn END) AS importe
  FROM x GROUP BY asiento""")
def q_header_first_nonnull(spark, sf):
    r = raw_ledger(spark, sf)
    li = r.select(F.col("asiento").alias("journal_entry_id"),
                  F.when(F.col("signo") == "H", F.col("tercero")).alias("vendor_id"),
                  F.when(F.col("row_id.l_returnflag") == "A", F.col("fecha")).alias("posting_date"),
                  "importe", "row_id")
    return J.header_first_nonnull(li)


# ---------------------------------------------------------------------------------------------------------------
# dates

_ORDER_FORMATS = {0: ("dd.MM.yyyy", "%d.%m.%Y"), 1: ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
                  2: ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"), 3: ("yyyyMMdd", "%Y%m%d"),
                  4: ("MM/dd/yyyy", "%m/%d/%Y")}


def _order_date_text():
    k = F.col("o_orderkey") % 5
    e = None
    for i, (fmt, _) in _ORDER_FORMATS.items():
        e = (F.when(k == i, F.date_format("o_orderdate", fmt)) if e is None
             else e.when(k == i, F.date_format("o_orderdate", fmt)))
    return e


_DUCK_TEXT = "CASE o_orderkey % 5 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (_, f) in _ORDER_FORMATS.items()) + " END"


def _duck_iso(t):
    # explicit formats in the same precedence as parse_date_text with day-first
    fmts = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y%m%d",
            "%d.%m.%Y", "%d/%m/%Y", "%d/%m/%Y %H:%M", "%m/%d/%Y"]
    tries = ", ".join(f"try_strptime({t}, '{f}')" for f in fmts)
    return f"COALESCE(strftime(COALESCE({tries}), '%Y-%m-%d'), {t})"


_DATE_LIKE3 = " OR ".join(f"regexp_matches(t, '{p}')" for p in D.DATE_LIKE_3)
_PURE_D = " OR ".join(f"regexp_matches(t, '{p}')" for p in D.PURE_DATE_PATTERNS)
_PURE_T = " OR ".join(f"regexp_matches(t, '{p}')" for p in D.PURE_TIME_PATTERNS)
_COMB = " OR ".join(f"regexp_matches(t, '{p}')" for p in D.COMBINED_PATTERNS)


@query("iso_dates", ("D01", "D02", "D03", "D05", "D09", "D11", "D12"), oracle=f"""
  WITH x AS (SELECT o_orderkey, {_DUCK_TEXT} AS t, o_orderdate FROM orders)
  SELECT o_orderkey, t AS date_text, {_duck_iso('t')} AS iso_date, ({_PURE_D}) AS is_pure_date,
         ({_PURE_T}) AS is_pure_time, ({_COMB}) AS has_date_and_time, ({_DATE_LIKE3}) AS is_date_like,
         true AS parses_as_date, CAST(year(o_orderdate) AS INTEGER) AS year_of
  FROM x""")
def q_iso_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _order_date_text().alias("date_text"))
    t = F.col("date_text")
    # parse once (staged), derive the ISO text, the parse flag and the year from the same timestamp
    o = D.with_parsed(o, {"__ts": "date_text"}, True, with_time=True)
    ts = F.col("__ts")
    return o.select("o_orderkey", "date_text", D.to_iso_date(t, True, ts=ts).alias("iso_date"),
                    D.is_pure_date(t).alias("is_pure_date"), D.is_pure_time(t).alias("is_pure_time"),
                    D.has_date_and_time(t).alias("has_date_and_time"), D.is_date_like(t).alias("is_date_like"),
                    ts.isNotNull().alias("parses_as_date"), F.year(ts).alias("year_of"))


@query("split_datetime", ("D06", "D07", "D04"), oracle="""
  SELECT event_id, strftime(ts, '%Y-%m-%d') AS entry_date, strftime(ts, '%H:%M:%S') AS entry_time,
         strftime(ts, '%d.%m.%Y') AS entry_date_kept, strftime(ts, '%Y-%m-%d') AS posting_date
  FROM events""")
def q_split_datetime(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("entry_date"),
        F.date_format("ts", "yyyy/MM/dd").alias("posting_date"), F.col("event_id").alias("row_id"))
    split = D.split_datetime(e, order_col="row_id")
    kept = D.split_datetime(e.select("event_id", "entry_date", "row_id"), fields=("entry_date",),
                            order_col="row_id", keep_format=True)
    return (split.select("event_id", "entry_date", "entry_time", "posting_date")
                 .join(kept.select("event_id", F.col("entry_date").alias("entry_date_kept")), "event_id"))
