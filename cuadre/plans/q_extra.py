"""Remaining composite checks: ERP detection (J03), weighted balance score (A09), manual-session journal (X07:
P02, P07, N03, D07, A27), examples per label (K09, T13), field detection (X03: K05, N14, J10, A20, V14), mapping
checks (A22, A24, A25) and catalogue learning (U02-U05, A32, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.functions import dates as D
from cuadre.functions import numbers as N
from cuadre.operators import balance as B
from cuadre.operators import catalog_ops as CO
from cuadre.operators import journal as J
from cuadre.operators import lines as L
from cuadre.operators import mapping as M
from cuadre.operators import profile as P
from cuadre.operators import review as RV
from cuadre.plans import duck
from cuadre.plans.q_balance import ENTRY_SQL, JOURNAL_SQL
from cuadre.plans.q_journal import RAW, ROW_ORDER
from cuadre.plans.q_lines import _CONV_SQL, conv_lines
from cuadre.plans.q_lake import new_folder
from cuadre.plans.q_mapping import _mappings, _sample_sql, conflict_inputs, lake_cells, lake_columns, lake_files, lake_sample, scanned_columns
from cuadre.plans.registry import query
from cuadre.plans.views import lineitem_journal, raw_ledger
from cuadre.session import cut_lineage
from cuadre.sources import catalog as C
from cuadre.sources import versions as V


def _erp_sql():
    parts = []
    for i, (erp, pats) in enumerate(M.ERP_SIGNATURES.items()):
        hits = " + ".join(f"CAST(strpos(header, '{p}') > 0 AS INTEGER)" for p in pats)
        parts.append(f"SELECT file_id, '{erp}' AS erp, {i} AS o, CAST({hits} AS DOUBLE) / {len(pats)} AS score FROM h")
    return " UNION ALL ".join(parts)


@query("erp_detect", ("J03",), oracle=f"""
  WITH {_sample_sql(1)},
  h AS (SELECT file_id, string_agg(lower("column"), ' ' ORDER BY ordinal) AS header
        FROM headers GROUP BY file_id),
  s AS ({_erp_sql()}),
  b AS (SELECT file_id, arg_max(erp, (score, -o)) AS erp, max(score) AS erp_score FROM s GROUP BY file_id)
  SELECT file_id, erp_score, CASE WHEN erp_score > 0.3 THEN erp ELSE 'Generic_ES' END AS erp FROM b""")
def q_erp_detect(spark, sf):
    return M.detect_erp(scanned_columns(spark, sf))


@query("weighted_balance_score", ("A09",), oracle=f"""
  WITH e AS ({ENTRY_SQL}),
  r AS (SELECT (SELECT COALESCE(SUM(amount), 0) FROM ({JOURNAL_SQL}) j) AS tot, count(*) AS n,
               count(*) FILTER (WHERE abs(s) < 0.01) AS b, sum(abs(s)) AS abs_sum FROM e)
  SELECT CAST(tot AS DOUBLE) AS total_amount_sum, CAST(abs_sum AS DOUBLE) AS abs_amount_sum,
         CAST(b AS DOUBLE) / n * 100.0 AS balance_rate_pct,
         (CASE WHEN abs(tot) < 0.01 THEN 0.4 ELSE 0.4 * greatest(0.0, 1.0 - 5.0 * abs(CAST(tot AS DOUBLE))
               / greatest(CAST(abs_sum AS DOUBLE), 1e-9)) END) + 0.6 * (CAST(b AS DOUBLE) / n * 100.0 / 100.0)
           AS weighted_score
  FROM r""")
def q_weighted_balance_score(spark, sf):
    j = lineitem_journal(spark, sf)
    rep = B.balance_report(j)
    abs_sum = B.entry_balance(j).agg(F.sum(F.abs("amount_sum")).alias("abs_amount_sum"))
    out = B.weighted_balance_score(rep.crossJoin(abs_sum))
    return out.select(F.col("total_amount_sum").cast("double").alias("total_amount_sum"),
                      F.col("abs_amount_sum").cast("double").alias("abs_amount_sum"), "balance_rate_pct",
                      "weighted_score")


# manual-session journal: two columns map to amount (P02 suffixes the second), N03 amounts, D07 keeps date format
MANUAL_MAPPING = {"asiento": "journal_entry_id", "linea": "line_number", "cuenta": "gl_account_number",
                  "importe": "amount", "debe": "amount", "signo": "debit_credit_indicator", "tercero": "vendor_id",
                  "fecha_hora": "entry_date", "fecha": "posting_date"}


def manual_canonical(spark, sf):
    raw = raw_ledger(spark, sf).select("asiento", "linea", "cuenta", "importe", "debe", "signo", "tercero",
                                       "fecha_hora", "fecha", "row_id")
    df = J.rename_unique(raw, MANUAL_MAPPING)
    df = N.with_cleaned(df.withColumnRenamed("amount", "__amount_raw"), {"amount": "__amount_raw"},
                        "parse_amount_manual").drop("__amount_raw")
    return D.split_datetime(df, fields=("entry_date",), order_col="row_id", keep_format=True)


@query("manual_journal_detail", ("X07", "P02", "P07", "N03"), oracle=f"""
  WITH {RAW}
  SELECT asiento AS journal_entry_id, linea AS line_number, cuenta AS gl_account_number,
         {duck.manual_amount('importe')} AS amount, signo AS debit_credit_indicator, tercero AS vendor_id
  FROM raw""")
def q_manual_journal_detail(spark, sf):
    return J.available_projection(manual_canonical(spark, sf), J.MANUAL_DETAIL_FIELDS)


@query("manual_journal_header", ("X07", "D07", "A27", "P07"), oracle=f"""
  WITH {RAW}
  SELECT asiento AS journal_entry_id, arg_min(strftime(l_shipdate, '%Y-%m-%d'), ({ROW_ORDER})) AS entry_date,
         arg_min(strftime(l_shipdate, '%H:%M:%S'), ({ROW_ORDER})) AS entry_time,
         arg_min(fecha, ({ROW_ORDER})) AS posting_date
  FROM raw GROUP BY asiento""")
def q_manual_journal_header(spark, sf):
    df = manual_canonical(spark, sf)
    hdr = J.available_projection(df, J.MANUAL_HEADER_FIELDS + ["row_id"])
    return J.header_first_nonnull(hdr)


@query("examples_per_label", ("K09", "T13"), oracle=f"""
  WITH {_CONV_SQL}
  SELECT label, conv_id, turn,
         CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
  FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY conv_id, turn) <= 3""")
def q_examples_per_label(spark, sf):
    ex = L.examples_per_label(conv_lines(spark, sf), "label", ["file", "line_no"], 3)
    return ex.select("label", F.col("file").alias("conv_id"), F.col("line_no").alias("turn"),
                     L.preview(F.col("text"), 100).alias("preview"))


@query("detect_fields", ("X03", "K05", "N14", "J10", "A20", "V14", "A34"))
def q_detect_fields(spark, sf):
    s, cols = lake_sample(spark, sf, 20), lake_columns(spark)
    best = M.best_matches(s, cols, C.synonyms(spark), C.field_definitions(spark))
    vals = P.validator_scores(s)
    top = M.top_candidates(M.merge_candidate_sources(best, vals), 3)
    fixed = M.smart_corrections(top, vals)
    quality = M.detection_quality(fixed, cols, P.whole_column_counts(lake_files(spark, sf)))
    return fixed.join(quality, "file_id", "left")


@query("learned_detection", ("X03", "X06", "V15", "N14", "U05", "U06", "S12", "T10", "T11"))
def q_learned_detection(spark, sf):
    """Decisions on the conflict ledger, merged as feedback, and what the learned patterns do to the other ledgers' fields:
    every candidate with its confidence before and after."""
    s1, c1, _ = conflict_inputs(spark, sf)
    sample, cols = s1.unionByName(lake_sample(spark, sf)), c1.unionByName(lake_columns(spark))
    seed = C.synonyms(spark)
    best = cut_lineage(M.best_matches(sample, cols, seed, C.field_definitions(spark)))
    vals = cut_lineage(P.validator_scores(sample))
    queue = RV.review_queue(c1, best.where("file_id = 'cierre'").drop("ordinal"), RV.alternatives(vals, best, sample))
    decisions = spark.createDataFrame([("cierre", "Fecha", "manual", "posting_date"), ("cierre", "Fecha date", "manual", "entry_date"), ("cierre", "Importe", "reject", None)],
                                      "file_id string, column string, choice string, chosen_field string")
    catalogue, patterns = new_folder(spark, "catalogue"), new_folder(spark, "patterns")
    for _ in range(2):  # the second run finds its decisions merged
        RV.merge_feedback(queue, decisions, sample, seed, catalogue, patterns)
    learned = P.learned_pattern_scores(sample, spark.read.parquet(f"{patterns}/versions/1"))
    before = M.merge_candidate_sources(best, vals).select("file_id", "column", "field_type", F.col("confidence").alias("before"))
    after = M.merge_candidate_sources(best, vals, learned)
    return after.join(before, ["file_id", "column", "field_type"], "left").select(
        "file_id", "column", "field_type", "before", "confidence", "source", F.lit(V.current_version(spark, catalogue)).alias("catalogue_version"))


@query("column_coverage", ("A20", "A33"), oracle=f"""
  WITH {_sample_sql(1)}
  SELECT file_id, "column", ordinal, count(*) AS "rows", count(value) AS nonnull, count(DISTINCT value) AS distinct_values,
         round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM allcells GROUP BY ALL""")
def q_column_coverage(spark, sf):
    return P.whole_column_counts(lake_files(spark, sf))


@query("mapping_checks", ("A21", "A22", "A24", "A25", "D12"))
def q_mapping_checks(spark, sf):
    s, cols = lake_sample(spark, sf), lake_columns(spark)
    best = M.best_matches(s, cols, C.synonyms(spark), C.field_definitions(spark))
    final = cut_lineage(_mappings(spark, sf))  # the mappings that X01 returns
    # years of the whole column, but only of the columns that could be re-tagged
    dates = final.where(F.col("field_type") == "entry_date").select("file_id", "column")
    whole = lake_cells(spark, sf).join(dates, ["file_id", "column"], "left_semi")
    years = whole.groupBy("file_id", "column").agg(F.count_distinct(D.year_of(F.col("value"))).alias("distinct_years"))
    summary = M.mapping_summary(M.single_year_date_fix(final, years), cols)
    coherence = M.mapping_coherence(best).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("critical_conflicts"))
    erp = M.detect_erp(cols).select("file_id", "erp")
    same = M.erp_distribution(cols).withColumnRenamed("files", "erp_files")
    cross = M.cross_file_summary(summary)
    out = summary.join(coherence, "file_id", "left").fillna({"critical_conflicts": 0}).join(erp, "file_id").join(same, "erp")
    return out.crossJoin(F.broadcast(cross))  # 1-row global summary


@query("catalog_learn", ("U02", "U03", "U04", "U05", "A32", "J11", "X06"))
def q_catalog_learn(spark, sf):
    syn = C.synonyms(spark)
    mappings = _mappings(spark, sf)
    v2 = CO.upsert_synonyms(syn, CO.learned_synonyms(mappings, syn))
    stats = CO.catalogue_stats(v2)
    return CO.display_names(stats, C.field_definitions(spark))


@query("review_queue", ("X06", "A16", "A17", "K06"))
def q_review_queue(spark, sf):
    from cuadre.operators import review as R
    s = lake_sample(spark, sf, 20)
    mappings = _mappings(spark, sf)
    scores = R.content_scores(R.manual_type_profile(s))
    return R.review_queue(lake_columns(spark), mappings, R.alternatives(scores, mappings, s))
