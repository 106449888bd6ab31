"""Profile and mapping family over a lake of five ledgers derived from the driver tables: the raw lineitem export
(Spanish headers), orders, customer, supplier and part, every value as text (S02, W08, W09, A10-A13, A19, A21-A24,
J01, J04, J05, X01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cuadre.operators import closeout as X
from cuadre.operators import mapping as M
from cuadre.operators import profile as P
from cuadre.plans import duck
from cuadre.plans.q_lake import new_folder
from cuadre.plans.registry import query
from cuadre.plans.views import raw_ledger
from cuadre.session import cut_lineage
from cuadre.sources import catalog as C
from cuadre.sources.lake import Lake, read_lake
from cuadre.sources.tables import table

LEDGER_COLS = ["asiento", "linea", "cuenta", "tercero", "fecha", "fecha_hora", "importe", "debe", "haber", "signo"]
LAKE = {  # file_id -> (table, columns, row order)
    "ledger": ("lineitem", LEDGER_COLS, None),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                          "o_orderpriority"], "o_orderkey"),
    "customer": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_custkey"),
    "supplier": ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "s_vacio"], "s_suppkey"),
    "part": ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "p_partkey"),
}
NULL_COLUMNS = {"s_vacio"}  # a header without any value below it


def lake_columns(spark):
    """(file_id, column, ordinal) from the files' headers."""
    rows = [(fid, c, i) for fid, (_, cols, _) in LAKE.items() for i, c in enumerate(cols, 1)]
    return spark.createDataFrame(rows, "file_id string, column string, ordinal int")


def scanned_columns(spark, sf):
    """(file_id, column, ordinal) as the lake scan finds them in the headers of the lake's ledgers, written as files."""
    folder = new_folder(spark, "lake")
    for f in lake_files(spark, sf):
        f[1].select(*[F.col(c).cast("string") for c in f[3]]).write.option("header", True).csv(f"{folder}/{f[0]}")
    return read_lake(spark, folder, by="folder").columns()


def lake_cells(spark, sf):
    """Every cell of the lake: (file_id, column, ordinal, row_key, value)."""
    parts = [P.cells(f[1], f[0], f[2], f[3]).withColumn("row_key", F.to_json(F.struct("row_order"))) for f in lake_files(spark, sf)]
    parts = [p.select("file_id", "column", "ordinal", "row_key", "value") for p in parts]
    return reduce(lambda a, b: a.unionByName(b), parts)


def lake_files(spark, sf):
    files = []
    for fid, (tname, cols, order) in LAKE.items():
        if fid == "ledger":
            df = raw_ledger(spark, sf)
            files.append((fid, df.select(*cols, "row_id"), F.col("row_id"), cols, F.col("row_id.l_orderkey")))
        else:
            df = table(spark, sf, tname)
            conv = [F.lit(None).cast("string").alias(c) if c in NULL_COLUMNS
                    else F.date_format(c, "yyyy-MM-dd").alias(c) if c.endswith("date") else F.col(c) for c in cols]
            files.append((fid, df.select(*conv, F.col(order).alias("__order")), F.col("__order"), cols))
    return files


_SAMPLES: dict[tuple, object] = {}


def lake_sample(spark, sf, n=P.SAMPLE_N):
    """The lake's first-N sample, checkpointed into the shared checkpoint folder once per (application, data
    folder, N): every profile, validator, mapping and review query of the session reads this small materialised
    table instead of re-running scan + unpivot + window."""
    import os

    if n < P.SAMPLE_N:
        return lake_sample(spark, sf).where(F.col("rn") <= n)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf), n)
    if key not in _SAMPLES:
        _SAMPLES[key] = cut_lineage(P.lake_sample(lake_files(spark, sf), n))
    return _SAMPLES[key]


def wide_lake(spark, files):
    """The same files as a lake of wide rows (the cells of a row in one array), for the steps that read whole ledgers."""
    headers = spark.createDataFrame([(f[0], f[0], "table", f[3]) for f in files], "file string, file_id string, kind string, names array<string>")
    rows = [f[1].select(F.lit(f[0]).alias("file"), F.lit(f[0]).alias("file_id"), F.to_json(F.struct(f[2].alias("row_order"))).alias("row_order"),
                        F.array(*[F.col(c).cast("string") for c in f[3]]).alias("cells")) for f in files]
    return Lake(headers, reduce(lambda a, b: a.unionByName(b), rows))


def trial_of(spark, files):
    """J08 on the wide rows of ``files``, as ``map_columns`` takes it."""
    return lambda best, amounts: X.trial_on_rows(wide_lake(spark, files), best, amounts, kind="clean_amount")


# ---------------------------------------------------------------------------------------------------------------
# DuckDB: the same lake sample

def _sample_sql(n=P.SAMPLE_N):
    parts = []
    raw_order = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, "
                 "l_quantity, l_discount, l_tax, l_linestatus")
    for fid, (tname, cols, order) in LAKE.items():
        for i, c in enumerate(cols, 1):
            if fid == "ledger":
                src, ordby, expr = "raw", raw_order, c
            else:
                src, ordby = tname, order
                expr = (f"strftime({c}, '%Y-%m-%d')" if c.endswith("date")
                        else f"CAST({'NULL' if c in NULL_COLUMNS else c} AS VARCHAR)")
            parts.append(f"SELECT '{fid}' AS file_id, '{c}' AS \"column\", {i} AS ordinal, {expr} AS value, "
                         f"row_number() OVER (ORDER BY {ordby}) AS ro FROM {src}")
    union = "\n    UNION ALL ".join(parts)
    headers = ", ".join(f"('{fid}', '{c}', {i})" for fid, (_, cols, _) in LAKE.items() for i, c in enumerate(cols, 1))
    return f"""{duck.raw_ledger_cte()},
  headers(file_id, "column", ordinal) AS (VALUES {headers}),
  allcells AS ({union}),
  cells AS (SELECT * FROM allcells WHERE value IS NOT NULL),
  sample AS (SELECT file_id, "column", ordinal, value,
                    row_number() OVER (PARTITION BY file_id, "column" ORDER BY ro) AS rn FROM cells
             QUALIFY rn <= {n})"""


def _pyfloat(v):
    return duck.py_float(v)


@query("column_profile", ("A10", "A19", "A33", "W08", "S02"), oracle=f"""
  WITH {_sample_sql()},
  w AS (SELECT file_id, "column", ordinal, count(*) AS "rows", count(value) AS nonnull, count(DISTINCT value) AS distinct_values,
               round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM allcells GROUP BY ALL),
  t AS (SELECT file_id, "column",
         CASE WHEN count(*) FILTER (WHERE rn <= 10) = 0 THEN 'unknown'
              WHEN CAST(count(*) FILTER (WHERE rn <= 10 AND ({' OR '.join(f"regexp_matches(trim(value), '{p}')" for p in
              __import__('cuadre.functions.dates', fromlist=['x']).DATE_LIKE_3)})) AS DOUBLE)
                   / count(*) FILTER (WHERE rn <= 10) > 0.6 THEN 'date'
              WHEN CAST(count(*) FILTER (WHERE rn <= 10 AND {duck.is_numeric('value')}) AS DOUBLE)
                   / count(*) FILTER (WHERE rn <= 10) > 0.6 THEN 'numeric'
              ELSE 'text' END AS inferred_type,
         string_agg(CASE WHEN rn <= 5 THEN value END, '|' ORDER BY rn) AS samples_text
  FROM sample GROUP BY file_id, "column")
  SELECT w.*, coalesce(inferred_type, 'unknown') AS inferred_type, samples_text FROM w LEFT JOIN t USING (file_id, "column")""")
def q_column_profile(spark, sf):
    prof = P.column_profile(lake_sample(spark, sf), lake_files(spark, sf))
    return prof.select("file_id", "column", "ordinal", "rows", "nonnull", "distinct_values", "null_pct", "inferred_type",
                       F.array_join("samples", "|").alias("samples_text"))


@query("numeric_profile", ("A11", "W09"), oracle=f"""
  WITH {_sample_sql()},
  x AS (SELECT *, {_pyfloat('value')} AS x FROM sample),
  st AS (SELECT file_id, "column", ordinal, count(*) FILTER (WHERE prev IS NOT NULL AND x = prev + 1) AS consecutive
         FROM (SELECT *, lag(x) OVER (PARTITION BY file_id, "column" ORDER BY x) AS prev,
                      row_number() OVER (PARTITION BY file_id, "column" ORDER BY x) AS r
               FROM x WHERE x IS NOT NULL) q WHERE r <= 20 GROUP BY ALL),
  s AS (SELECT file_id, "column", ordinal, count(*) AS n, count(x) AS n_numeric,
               count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x > 0) AS positives,
               count(*) FILTER (WHERE x < 0) AS negatives, min(x) AS min_value, max(x) AS max_value,
               avg(x) AS mean_value, stddev_samp(x) AS std_value, count(DISTINCT x) AS n_unique,
               COALESCE(bool_and(x BETWEEN 1900 AND 2100), false) AS all_years
        FROM x GROUP BY ALL),
  j AS (SELECT s.*, COALESCE(st.consecutive, 0) AS consecutive FROM s LEFT JOIN st USING (file_id, "column", ordinal)),
  h AS (SELECT *, CASE
          WHEN n_numeric = 0 OR CAST(n_numeric AS DOUBLE) / n < 0.7 THEN NULL
          WHEN abs(mean_value) > 1 AND std_value > 1 THEN
               CASE WHEN CAST(zeros AS DOUBLE) / n_numeric > 0.3 THEN
                    CASE WHEN positives > negatives THEN 'debit_amount' ELSE 'credit_amount' END ELSE 'amount' END
          WHEN max_value <= 1000 AND std_value < 10 THEN
               CASE WHEN CAST(n_unique AS DOUBLE) / n_numeric < 0.2 THEN 'document_number' END
          WHEN all_years THEN CASE WHEN n_unique <= 5 THEN 'fiscal_year' END
          WHEN max_value <= 100 AND min_value >= 1 THEN
               CASE WHEN consecutive > n_numeric * 0.3 THEN 'line_number' END
          WHEN n_unique < n_numeric * 0.7 THEN 'journal_entry_id'
          WHEN max_value <= 999999 AND min_value >= 1 THEN
               CASE WHEN CAST(n_unique AS DOUBLE) / n_numeric > 0.8 THEN 'vendor_id' END
          END AS hint_field FROM j)
  SELECT file_id, "column", ordinal, n, n_numeric, zeros, positives, negatives, min_value, max_value, n_unique,
         consecutive, hint_field,
         CAST(CASE hint_field WHEN 'debit_amount' THEN 0.8 WHEN 'credit_amount' THEN 0.7 WHEN 'amount' THEN 0.9
              WHEN 'document_number' THEN 0.7 WHEN 'fiscal_year' THEN 0.9 WHEN 'line_number' THEN 0.8
              WHEN 'journal_entry_id' THEN 0.7 WHEN 'vendor_id' THEN 0.6 END AS DOUBLE) AS hint_confidence
  FROM h""")
def q_numeric_profile(spark, sf):
    return P.numeric_profile(lake_sample(spark, sf)).select(
        "file_id", "column", "ordinal", "n", "n_numeric", "zeros", "positives", "negatives", "min_value",
        "max_value", "n_unique", "consecutive", "hint_field", "hint_confidence")


@query("text_profile", ("A12",), oracle=f"""
  WITH {_sample_sql()},
  s AS (SELECT file_id, "column", ordinal, count(*) FILTER (WHERE rn <= 10) AS n10,
               count(*) FILTER (WHERE rn <= 10 AND {_pyfloat('value')} IS NOT NULL) AS num10,
               count(*) AS n, count(DISTINCT value) AS n_unique FROM sample GROUP BY ALL),
  t AS (SELECT *, CAST(n_unique AS DOUBLE) / n AS u, lower("column") AS low,
               (SELECT avg(length(value)) FROM sample q WHERE q.file_id = s.file_id AND q."column" = s."column")
               AS avg_length FROM s)
  SELECT file_id, "column", ordinal, n10, num10, n, n_unique,
         CASE WHEN num10 > n10 * 0.8 THEN NULL
              WHEN strpos(low, 'descripcion') > 0 OR strpos(low, 'description') > 0 THEN
                   CASE WHEN u > 0.7 THEN 'line_description' ELSE 'description' END
              WHEN strpos(low, 'concepto') > 0 OR strpos(low, 'concept') > 0 THEN 'description'
              WHEN avg_length > 10 AND u > 0.5 THEN 'line_description'
              WHEN avg_length > 5 AND u < 0.3 THEN 'description' END AS hint_field
  FROM t""")
def q_text_profile(spark, sf):
    return P.text_profile(lake_sample(spark, sf)).select("file_id", "column", "ordinal", "n10", "num10", "n",
                                                         "n_unique", "hint_field")


@query("date_share", ("A13", "D10", "D11"))
def q_date_share(spark, sf):
    return P.date_share(lake_sample(spark, sf, 20)).select("file_id", "column", "checked", "date_like",
                                                           "posting_date_conf", "entry_date_conf")


def _catalogue_sql():
    syn = ", ".join(f"('{f}', '{e}', '{n}', {b})" for f, e, n, b in C.SYNONYMS)
    fields = ", ".join(f"('{c}', {i})" for i, (c, _, _) in enumerate(C.FIELD_DEFINITIONS))
    return (f"syn(field_type, erp, name, boost) AS (VALUES {syn}),\n"
            f"  fld(field_type, field_order) AS (VALUES {fields})")


def _norm(x):
    return f"regexp_replace(lower({x}), '[^a-zA-Z0-9]', '', 'g')"


_PROBLEM = " OR ".join(f"(starts_with(lower(c.\"column\"), '{p}') AND strpos('{p}', lower(s.name)) = 0)"
                       for p in M.PROBLEMATIC_PREFIXES)


@query("name_matches", ("J01", "T01", "T04"), oracle=f"""
  WITH {_sample_sql()}, {_catalogue_sql()},
  cols AS (SELECT file_id, "column" FROM headers),
  hits AS (
    SELECT c.file_id, c."column", s.field_type,
           least(CAST(0.85 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(s.boost AS DOUBLE), CAST(1.0 AS DOUBLE)) AS conf
    FROM cols c JOIN syn s ON {_norm('c."column"')} = {_norm('s.name')}
    WHERE NOT (lower(c."column") <> lower(s.name) AND strpos(lower(c."column"), lower(s.name)) > 0 AND ({_PROBLEM}))
    UNION ALL
    SELECT c.file_id, c."column", f.field_type, CAST(0.9 AS DOUBLE) FROM cols c JOIN fld f ON {_norm('c."column"')} = {_norm('f.field_type')})
  SELECT h.file_id, h."column", h.field_type, max(conf) AS exact_conf, any_value(f.field_order) AS field_order
  FROM hits h LEFT JOIN fld f USING (field_type) GROUP BY h.file_id, h."column", h.field_type""")
def q_name_matches(spark, sf):
    return M.exact_matches(scanned_columns(spark, sf), C.synonyms(spark), C.field_definitions(spark)).select(
        "file_id", "column", "field_type", "exact_conf", "field_order")


def _mappings(spark, sf):
    return M.map_columns(lake_sample(spark, sf), C.synonyms(spark), C.field_definitions(spark),
                         columns=lake_columns(spark), trial=trial_of(spark, lake_files(spark, sf)))


@query("map_columns", ("X01", "J02", "N13", "W05", "W06", "W07", "K04", "P08", "A14", "A15", "A18", "T05", "T06"))
def q_map_columns(spark, sf):
    return _mappings(spark, sf)


@query("mapping_table", ("J04", "J05"))
def q_mapping_table(spark, sf):
    m = _mappings(spark, sf)
    return M.mapping_table(m, lake_columns(spark))


@query("mapping_summary", ("A21", "A23"))
def q_mapping_summary(spark, sf):
    m = _mappings(spark, sf)
    return M.mapping_summary(m, lake_columns(spark)).join(
        M.decision_stats(m), "file_id", "left")


# a ledger whose columns compete: two journal ids (the name match prefers the wrong one, only the order key balances),
# a total and a local amount, a forced header, a more specific date name
CONFLICT_COLS = ["NumAsiento", "Asiento", "Header description", "Fecha", "Fecha date", "Importe", "Importe Local"]
CONFLICT_SYNONYMS = C.SYNONYMS + [("amount", "Generic_ES", "Importe Local", 0.9), ("posting_date", "Generic_ES", "Fecha date", 0.9)]


def conflict_ledger(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_linestatus")
    side = F.explode(F.when(F.col("l_linestatus") == "F", F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))))
    price = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("side")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return li.withColumn("side", side).select(
        F.col("l_suppkey").alias("NumAsiento"), F.col("l_orderkey").alias("Asiento"), F.lit("cierre").alias("Header description"),
        day.alias("Fecha"), day.alias("Fecha date"), price.cast("decimal(18,2)").alias("Importe"), price.cast("decimal(18,2)").alias("Importe Local"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "side").alias("__order"))


def conflict_inputs(spark, sf):
    """Sample, columns and the file itself (as in ``lake_files``) of the conflict ledger."""
    file = ("cierre", conflict_ledger(spark, sf), F.col("__order"), CONFLICT_COLS, F.col("__order.l_orderkey"))
    columns = spark.createDataFrame([("cierre", c, i) for i, c in enumerate(CONFLICT_COLS, 1)], "file_id string, column string, ordinal int")
    return cut_lineage(P.lake_sample([file])), columns, file


@query("map_columns_conflicts", ("X01", "W06", "W07", "W10", "J08", "P21", "T05", "T06", "A18"))
def q_map_columns_conflicts(spark, sf):
    sample, columns, file = conflict_inputs(spark, sf)
    return M.map_columns(sample, C.synonyms(spark, CONFLICT_SYNONYMS), C.field_definitions(spark), columns=columns, trial=trial_of(spark, [file]))


@query("map_columns_priority", ("X02", "K03", "T05", "W06"))
def q_map_columns_priority(spark, sf):
    """The lake and the conflict ledger in the priority order."""
    s1, c1, file = conflict_inputs(spark, sf)
    sample, columns = s1.unionByName(lake_sample(spark, sf)), c1.unionByName(lake_columns(spark))
    best = cut_lineage(M.best_matches(sample, columns, C.synonyms(spark, CONFLICT_SYNONYMS), C.field_definitions(spark)))
    flags = cut_lineage(M.better_amount_flags(sample))
    amounts = M.trusted_amounts(M.resolve_conflicts(best, flags))
    trial = cut_lineage(trial_of(spark, [file])(best.where("file_id = 'cierre'"), amounts))
    return M.harmonise_by_priority(best, columns, flags, trial)


@query("balance_trial", ("J08", "W10", "P21", "A05"), oracle="""
  WITH j AS (SELECT l_orderkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem
             UNION ALL SELECT l_orderkey, l_suppkey, -CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem WHERE l_linestatus = 'F'),
  e AS (SELECT 'Asiento' AS "column", l_orderkey AS k, sum(amount) AS s FROM j GROUP BY l_orderkey
        UNION ALL SELECT 'NumAsiento', l_suppkey, sum(amount) FROM j GROUP BY l_suppkey)
  SELECT 'cierre' AS file_id, "column", CAST(count(*) FILTER (WHERE abs(s) < 0.01) AS DOUBLE) / count(*) AS quality
  FROM e GROUP BY "column" """)
def q_balance_trial(spark, sf):
    sample, columns, file = conflict_inputs(spark, sf)
    best = cut_lineage(M.best_matches(sample, columns, C.synonyms(spark, CONFLICT_SYNONYMS), C.field_definitions(spark)))
    amounts = cut_lineage(M.trusted_amounts(M.resolve_conflicts(best, M.better_amount_flags(sample))))
    return trial_of(spark, [file])(best, amounts)


def close_out_inputs(spark, sf):
    """The raw ledger export and the conflict ledger as wide rows, and their mappings, each mapped from its own cells."""
    s1, c1, file = conflict_inputs(spark, sf)
    files = [file, lake_files(spark, sf)[0]]
    s2 = lake_sample(spark, sf).where("file_id = 'ledger'")
    c2 = lake_columns(spark).where("file_id = 'ledger'")
    m = M.map_columns(s1.unionByName(s2), C.synonyms(spark, CONFLICT_SYNONYMS), C.field_definitions(spark), columns=c1.unionByName(c2), trial=trial_of(spark, files))
    return wide_lake(spark, files), cut_lineage(m)


@query("close_out", ("X05", "X01", "X12", "J08", "A06", "A07", "A08"), oracle="""
  WITH j AS (SELECT 'cierre' AS file_id, l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem
             UNION ALL SELECT 'cierre', l_orderkey, -CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem WHERE l_linestatus = 'F'
             UNION ALL SELECT 'ledger', l_orderkey, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem),
  e AS (SELECT file_id, k, sum(amount) AS s, count(*) AS n FROM j GROUP BY ALL),
  r AS (SELECT file_id, sum(s) AS tot, count(*) AS n, count(*) FILTER (WHERE abs(s) < 0.01) AS b, CAST(sum(n) AS BIGINT) AS rws FROM e GROUP BY file_id)
  SELECT file_id, CAST(tot AS DOUBLE) AS total_amount_sum, abs(tot) < 0.01 AS is_balanced, n AS entries_count, b AS balanced_entries_count,
         n - b AS unbalanced_entries_count, CAST(b AS DOUBLE) / n * 100.0 AS balance_rate_pct,
         CAST(abs(tot) < 0.01 AS DOUBLE) * 0.5 + CAST(b AS DOUBLE) / n * 0.5 AS quality_score, rws AS "rows", rws AS rows_with_amount FROM r""")
def q_close_out(spark, sf):
    out = X.close_out_rows(*close_out_inputs(spark, sf))
    return out.withColumn("total_amount_sum", F.col("total_amount_sum").cast("double"))


@query("decision_report", ("X13", "A23"))
def q_decision_report(spark, sf):
    return X.decision_report(close_out_inputs(spark, sf)[1])


@query("validator_scores", ("V01", "V02", "V03", "V04", "V05", "V06", "V07", "V08", "V09", "V10", "V11", "V12",
                            "V13", "V14", "F01"))
def q_validator_scores(spark, sf):
    return P.validator_scores(lake_sample(spark, sf))


# DuckDB form of the validator sweep (per-value scores, averaged per column, clamped where the reference clamps)
def _v_sql():
    from cuadre.functions import dates as D
    from cuadre.functions import validators as V
    s = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
    up = f"upper({s})"
    n = f"length({s})"

    def anyp(x, pats):
        return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in pats) + ")"

    def isdigit(x):
        return f"regexp_matches({x}, '^\\p{{Nd}}+$')"

    date_like = anyp(s, D.DATE_LIKE_5)
    pf = duck.py_float
    # explicit-shape date parse: y-m-d (same separator), compact, d/m/y (day first, month-first fallback), time tail
    tt = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?$"
    ymd = r"^(\d{4})([./-])(\d{1,2})[./-](\d{1,2})" + tt
    cmp_ = r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?$"
    dmy = r"^(\d{1,2})([./-])(\d{1,2})[./-](\d{4}|\d{2})" + tt

    def g(rx, i):
        return f"TRY_CAST(NULLIF(regexp_extract({s}, '{rx}', {i}), '') AS INTEGER)"

    def ts(y, m, d, hh, mi, ss):
        return (f"try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', {y}, {m}, {d}, COALESCE({hh}, 0), "
                f"COALESCE({mi}, 0), COALESCE({ss}, 0)), '%Y-%m-%d %H:%M:%S')")

    yy = f"(CASE WHEN {g(dmy, 4)} < 100 THEN {g(dmy, 4)} + 2000 ELSE {g(dmy, 4)} END)"
    same_sep_ymd = f"(regexp_matches({s}, '{ymd}') AND regexp_extract({s}, '^\\d{{4}}([./-])', 1) = " \
                   f"regexp_extract({s}, '^\\d{{4}}[./-]\\d{{1,2}}([./-])', 1))"
    same_sep_dmy = f"(regexp_matches({s}, '{dmy}') AND regexp_extract({s}, '^\\d{{1,2}}([./-])', 1) = " \
                   f"regexp_extract({s}, '^\\d{{1,2}}[./-]\\d{{1,2}}([./-])', 1))"
    parsed = (f"(CASE WHEN {same_sep_ymd} THEN {ts(g(ymd, 1), g(ymd, 3), g(ymd, 4), g(ymd, 5), g(ymd, 6), g(ymd, 7))}"
              f" WHEN regexp_matches({s}, '{cmp_}') THEN {ts(g(cmp_, 1), g(cmp_, 2), g(cmp_, 3), g(cmp_, 4), g(cmp_, 5), g(cmp_, 6))}"
              f" WHEN {same_sep_dmy} THEN COALESCE({ts(yy, g(dmy, 3), g(dmy, 1), g(dmy, 5), g(dmy, 6), g(dmy, 7))}, "
              f"{ts(yy, g(dmy, 1), g(dmy, 3), g(dmy, 5), g(dmy, 6), g(dmy, 7))}) END)")
    sc = {}
    sc["journal_entry_id"] = (f"CASE WHEN {anyp(up, V.JE_PATTERNS)} THEN 1.0 ELSE "
                              f"(CASE WHEN {n} >= 6 AND {isdigit(s)} THEN 0.8 WHEN {n} >= 4 AND "
                              f"regexp_matches({up}, '^[A-Z0-9]+$') THEN 0.6 ELSE 0.0 END)"
                              f" - (CASE WHEN {date_like} THEN 0.5 ELSE 0.0 END) - (CASE WHEN {n} < 3 THEN 0.3 ELSE 0.0 END) END")
    num = pf("replace(value, ',', '.')")
    sc["line_number"] = (f"CASE WHEN {num} IS NOT NULL THEN (CASE WHEN {num} >= 1 AND {num} <= 9999 AND {num} = floor({num}) THEN 1.0"
                         f" WHEN {isdigit(s)} AND TRY_CAST({s} AS BIGINT) BETWEEN 1 AND 99999 THEN 0.8"
                         f" WHEN {num} >= 0 AND {num} < 1 THEN 0.3 ELSE 0.0 END)"
                         f" ELSE (CASE WHEN {date_like} THEN -0.5 ELSE 0.0 END) + (CASE WHEN {n} <= 5 AND "
                         f"regexp_matches({up}, '^[A-Z0-9]+$') THEN 0.4 ELSE 0.0 END) END")
    sc["posting_date"] = (f"CASE WHEN {anyp(s, V.DATE_PATTERNS)} THEN 1.0 WHEN {parsed} IS NOT NULL THEN 0.8 "
                          f"WHEN {n} > 8 AND {isdigit(s)} THEN -0.3 ELSE 0.0 END")
    sc["entry_date"] = sc["posting_date"]
    letters = f"(length({s}) - length(regexp_replace({s}, '\\p{{L}}', '', 'g')))"
    sc["amount"] = (f"CASE WHEN {anyp(s, V.AMOUNT_PATTERNS)} THEN 1.0 ELSE (CASE WHEN {duck.is_numeric(s)} THEN 0.7 ELSE 0.0 END)"
                    f" - (CASE WHEN {n} > 2 AND {letters} > {n} * 0.5 THEN 0.5 ELSE 0.0 END)"
                    f" - (CASE WHEN {date_like} THEN 0.4 ELSE 0.0 END) END")
    sc["debit_amount"] = sc["amount"]
    sc["credit_amount"] = sc["amount"]
    inds = ", ".join(f"'{i}'" for i in V.INDICATORS)
    yn = ", ".join(f"'{i}'" for i in V.YES_NO)
    inum = f"abs({pf(f'replace({up}, {chr(39)},{chr(39)}, {chr(39)}.{chr(39)})')})"
    sc["debit_credit_indicator"] = (
        f"(CASE WHEN {up} IN ({inds}) THEN 1.0 WHEN length({up}) = 1 AND strpos('{V.INDICATOR_CHARS}', {up}) > 0 THEN 0.8"
        f" WHEN {up} IN ({yn}) THEN 0.6 ELSE 0.0 END)"
        f" + (CASE WHEN {duck.is_numeric(up)} AND {inum} IS NOT NULL THEN (CASE WHEN {inum} > 10 THEN -0.8"
        f" WHEN {inum} <= 1 THEN 0.3 ELSE 0.0 END) ELSE 0.0 END) - (CASE WHEN length({up}) > 10 THEN 0.5 ELSE 0.0 END)")
    bare = f"regexp_replace({s}, '[.\\-]', '', 'g')"
    as_int = f"(CASE WHEN regexp_matches({bare}, '^[+-]?[0-9]+$') THEN TRY_CAST({bare} AS BIGINT) END)"
    sc["gl_account_number"] = (
        f"CASE WHEN {anyp(s, V.ACCOUNT_PATTERNS)} THEN 1.0 ELSE (CASE WHEN {n} >= 3 AND {isdigit(bare)} THEN 0.8"
        f" WHEN {n} >= 3 AND regexp_matches({up}, '^[A-Z0-9.\\-]+$') THEN 0.6 ELSE 0.0 END)"
        f" - (CASE WHEN {as_int} BETWEEN 1 AND 12 THEN 0.4 ELSE 0.0 END) - (CASE WHEN {n} < 3 THEN 0.3 ELSE 0.0 END) END")
    x = pf("value")
    trunc = f"(CASE WHEN {x} >= 0 THEN floor({x}) ELSE ceil({x}) END)"
    sc["fiscal_year"] = (f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN (CASE WHEN {trunc} BETWEEN 1950 AND 2100 THEN 1.0"
                         f" WHEN {trunc} BETWEEN 50 AND 99 THEN 0.8 WHEN {trunc} BETWEEN 0 AND 49 THEN 0.8 ELSE 0.0 END)"
                         f" WHEN {x} IS NOT NULL THEN 0.0"
                         f" WHEN regexp_matches({up}, '^FY\\d{{2,4}}$') THEN 0.9 WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{4}}$') THEN 0.9"
                         f" ELSE 0.0 END")
    months = " OR ".join(f"strpos({up}, '{m}') > 0" for m in V.MONTH_NAMES)
    sc["period_number"] = (f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN (CASE WHEN {trunc} BETWEEN 1 AND 12 THEN 1.0"
                           f" WHEN {trunc} BETWEEN 1 AND 53 THEN 0.6 ELSE 0.0 END) WHEN {x} IS NOT NULL THEN 0.0"
                           f" WHEN {months} THEN 0.9 WHEN regexp_matches({up}, '^Q[1-4]$') THEN 0.9"
                           f" WHEN regexp_matches({up}, '^T[1-4]$') THEN 0.9 WHEN regexp_matches({up}, '^\\d{{4}}-\\d{{2}}$') THEN 0.8"
                           f" ELSE 0.0 END")
    has_l = f"regexp_matches({s}, '\\p{{L}}')"
    dg = isdigit(f"regexp_replace({s}, '[.,\\- ]', '', 'g')")
    sc["description"] = (f"(CASE WHEN {n} >= 3 THEN (CASE WHEN {has_l} AND (strpos({s}, ' ') > 0 OR {n} > 10) THEN 1.0"
                         f" WHEN {has_l} THEN 0.7 WHEN {n} > 5 THEN 0.4 ELSE 0.0 END) ELSE 0.0 END)"
                         f" - (CASE WHEN {dg} THEN (CASE WHEN {n} < 8 THEN 0.6 ELSE 0.2 END) ELSE 0.0 END)"
                         f" - (CASE WHEN {date_like} THEN 0.4 ELSE 0.0 END) - (CASE WHEN {n} < 2 THEN 0.5 ELSE 0.0 END)")
    sc["line_description"] = sc["description"]
    parts = []
    for f, (_, clamp) in V.VALIDATORS.items():
        if f == "amount_credit":
            continue
        avg = f"COALESCE(avg(CAST({sc[f]} AS DOUBLE)), 0.0)"
        expr = f"greatest(0.0, least({avg}, 1.0))" if clamp else avg
        parts.append(f"SELECT file_id, \"column\", '{f}' AS field_type, {expr} AS score FROM sample GROUP BY ALL")
    return "\n  UNION ALL ".join(parts)


ORACLES_V = f"""
  WITH {_sample_sql()},
  v AS ({_v_sql()})
  SELECT file_id, "column", field_type, score FROM v WHERE score > 0.35"""

from cuadre.plans.registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["validator_scores"] = ORACLES_V
