"""Review queue (X06, re-aimed manual session): per column a suggestion with its confidence band and up to three
content-based alternatives (A16, A17, K06); a decisions table comes back and drives learning (U05, U06, T10/T11).
No prompts: both sides are tables, so a whole lake is reviewed in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.operators.profile import py_float

# fixed values: date prefixes of the manual-session type check (tested at the start of the value)
MANUAL_DATE_PREFIXES = [
    r"^\d{4}-\d{2}-\d{2}", r"^\d{4}-\d{1,2}-\d{1,2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{1,2}/\d{1,2}/\d{4}",
    r"^\d{4}/\d{2}/\d{2}", r"^\d{4}/\d{1,2}/\d{1,2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{1,2}/\d{1,2}/\d{4}",
    r"^\d{2}\.\d{2}\.\d{4}", r"^\d{1,2}\.\d{1,2}\.\d{4}", r"^\d{4}\.\d{2}\.\d{2}", r"^\d{4}\.\d{1,2}\.\d{1,2}",
    r"^\d{2}-\d{2}-\d{4}", r"^\d{1,2}-\d{1,2}-\d{4}", r"^\d{2} \d{2} \d{4}", r"^\d{1,2} \d{1,2} \d{4}",
    r"^\d{2}/\d{2}/\d{2}", r"^\d{1,2}/\d{1,2}/\d{2}", r"^\d{2}-\d{2}-\d{2}", r"^\d{1,2}-\d{1,2}-\d{2}",
    r"^\d{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}",
    r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, \d{4}",
    r"^\d{1,2}-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4}",
    r"^\d{1,2} de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre) de \d{4}",
    r"^\d{1,2} (ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic) \d{4}",
    r"^\d{4}-\d{2}-\d{2}T", r"^\d{4}-\d{2}-\d{2} ", r"^\d{8}", r"^\d{6}",
]
# fixed values: date shapes that need no further check, and the fields that are offered for review
STRICT_DATE_PREFIXES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{4}/\d{2}/\d{2}"]
REVIEW_FIELDS = ["amount", "debit_amount", "credit_amount", "posting_date", "entry_date", "description",
                 "line_description", "gl_account_name", "journal_entry_id", "line_number", "fiscal_year",
                 "gl_account_number", "vendor_id"]
HIGH_BAND = 0.8


def _any(v, pats):
    return reduce(lambda a, b: a | b, [v.rlike(p) for p in pats])


def manual_type_profile(sample: DataFrame) -> DataFrame:
    """Per column: unique ratio, is_numeric (> 80 % numeric), is_monetary, is_sequential (first 10 numbers),
    is_repetitive (< 70 % unique), is_date (> 70 % of the first 10 start like a date), is_text, numeric stats."""
    g = ["file_id", "column"]
    x = sample.withColumn("x", py_float(F.col("value")))
    first10 = F.col("rn") <= 10
    seq_w = Window.partitionBy(*g).orderBy("x")
    seq = (x.where(first10 & F.col("x").isNotNull()).withColumn("__prev", F.lag("x").over(seq_w))
            .groupBy(*g).agg(F.count_if(F.col("x") == F.col("__prev") + 1).alias("consecutive"),
                             F.count(F.lit(1)).alias("n10_num")))
    s = x.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_unique"), F.count("x").alias("n_num"),
        F.stddev_samp("x").alias("std"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") > 0).alias("pos"),
        F.count_if(F.col("x") < 0).alias("neg"),
        F.count_if(first10).alias("n10"),
        F.count_if(first10 & _any(F.col("value"), MANUAL_DATE_PREFIXES)).alias("date10"),
        F.count_if(first10 & _any(F.col("value"), STRICT_DATE_PREFIXES)).alias("strict10"),
        F.count_if(first10 & F.col("value").rlike(r"^\d{4}$") & F.col("value").try_cast("int").between(2000, 2030))
         .alias("year10"),
        F.avg(F.length("value")).alias("avg_length"))
    s = s.join(seq, g, "left").fillna({"consecutive": 0, "n10_num": 0})
    uniq = F.col("n_unique") / F.col("n")
    numeric = F.col("n_num") / F.col("n") > 0.8
    monetary = numeric & (F.col("std") > 1) & (F.abs("mean") > 1) & ((F.col("max") > 100) | (F.col("min") < -10))
    sequential = numeric & (F.col("max") <= 100) & (F.col("min") >= 1) & (F.col("consecutive") > F.col("n10_num") * 0.3)
    date = (~numeric | ~monetary) & (F.col("date10") > F.col("n10") * 0.7)
    return s.select(*g, uniq.alias("unique_ratio"), numeric.alias("is_numeric"),
                    F.coalesce(monetary, F.lit(False)).alias("is_monetary"),
                    F.coalesce(sequential, F.lit(False)).alias("is_sequential"),
                    (numeric & (uniq < 0.7)).alias("is_repetitive"), date.alias("is_date"),
                    (~numeric & ~date & (F.col("avg_length") > 3)).alias("is_text"),
                    "n_num", "zeros", "pos", "neg", "std", "mean", "n10", "strict10", "year10", "avg_length")


def content_scores(profile: DataFrame) -> DataFrame:
    """Per (column, field type) content score from the A16 flags (long form)."""
    zr = F.col("zeros") / F.col("n_num")
    money_ok = F.col("is_monetary") & (F.col("std") >= 1) & (F.abs("mean") >= 1)
    strict = F.col("strict10") / F.col("n10")
    years = F.col("year10") / F.col("n10")
    u, al = F.col("unique_ratio"), F.col("avg_length")
    text_ok = F.col("is_text") & (al >= 5)
    sc = {
        "amount": F.when(money_ok, F.when((zr < 0.4) & (F.col("pos") > 0), 0.9).otherwise(0.4)),
        "debit_amount": F.when(money_ok, F.when((zr > 0.4) & (F.col("pos") > F.col("neg")), 0.9).otherwise(0.3)),
        "credit_amount": F.when(money_ok, F.when(zr > 0.4, 0.8).otherwise(0.3)),
        "posting_date": F.when(F.col("is_date"), F.when(strict > 0.8, 0.9).when(strict > 0.6, 0.7)),
        "entry_date": F.when(F.col("is_date"), F.when(strict > 0.8, 0.9).when(strict > 0.6, 0.7)),
        "line_description": F.when(text_ok, F.when((u > 0.7) & (al > 8), 0.9).when(u > 0.5, 0.6).otherwise(0.2)),
        "description": F.when(text_ok, F.when((u < 0.3) & (al > 5), 0.9).when(u < 0.5, 0.6).otherwise(0.2)),
        "gl_account_name": F.when(text_ok, F.when((u > 0.5) & (al > 5), 0.8).otherwise(0.3)),
        "journal_entry_id": F.when(F.col("is_numeric") & F.col("is_repetitive"), F.when(u < 0.7, 0.8).otherwise(0.3)),
        "line_number": F.when(F.col("is_numeric") & F.col("is_sequential"), F.lit(0.9)),
        "fiscal_year": F.when(years > 0.8, 0.9).when(years > 0.6, 0.6),
        "gl_account_number": F.when(~F.col("is_monetary"), F.when(F.col("is_numeric"), 0.6).otherwise(0.3)),
        "vendor_id": F.when(~F.col("is_monetary"), F.when(F.col("is_numeric"), 0.6).otherwise(0.3)),
    }
    stack = ", ".join(f"'{f}', CAST(`__{f}` AS DOUBLE)" for f in REVIEW_FIELDS)
    wide = profile.select("file_id", "column", *[F.coalesce(sc[f], F.lit(0.0)).alias(f"__{f}") for f in REVIEW_FIELDS])
    return wide.selectExpr("file_id", "`column`", f"stack({len(REVIEW_FIELDS)}, {stack}) AS (field_type, score)")


def alternatives(scores: DataFrame, suggestions: DataFrame, sample: DataFrame, k: int = 3) -> DataFrame:
    """Fields with content score > 0.4 other than the suggestion, scored x 0.85, best ``k`` per column, with a
    reason text holding the first three sample values."""
    samples = sample.where(F.col("rn") <= 3).groupBy("file_id", "column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]), ", ")
        .alias("__s3"))
    sug = suggestions.select("file_id", "column", F.col("field_type").alias("__sug"))
    c = (scores.where(F.col("score") > 0.4).join(sug, ["file_id", "column"], "left")
               .where(F.col("__sug").isNull() | (F.col("field_type") != F.col("__sug")))
               .withColumn("confidence", F.col("score") * 0.85))
    w = Window.partitionBy("file_id", "column").orderBy(F.desc("confidence"), "field_type")
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(samples, ["file_id", "column"], "left").select(
        "file_id", "column", "rank", "field_type", "confidence",
        F.concat(F.col("field_type"), F.lit(" pattern: "), F.coalesce("__s3", F.lit(""))).alias("reason"))


def review_queue(columns: DataFrame, mappings: DataFrame, alts: DataFrame) -> DataFrame:
    """X06 suggestions: every column of every file with its suggestion, if there is one, its band (high > 0.8, low,
    none) and its alternatives as an array. ``columns`` is (file_id, column, ordinal) from the headers."""
    a = alts.groupBy("file_id", "column").agg(F.array_sort(F.collect_list(
        F.struct("rank", "field_type", "confidence", "reason"))).alias("alternatives"))
    q = columns.select("file_id", "column", "ordinal").join(mappings, ["file_id", "column"], "left").join(a, ["file_id", "column"], "left")
    return q.withColumn("band", F.when(F.col("confidence") > HIGH_BAND, F.lit("high"))
                        .when(F.col("confidence").isNotNull(), F.lit("low")).otherwise(F.lit("none")))


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """X06 outcome: decisions (file_id, column, choice, chosen_field) with choice accept | alternative | manual |
    reject. accept -> the suggestion (``automatic``); alternative -> ``user_correction`` with the alternative's
    confidence; manual -> ``manual_selection`` at 0.8; reject -> dropped."""
    j = queue.join(decisions, ["file_id", "column"], "left")
    alt_conf = F.filter("alternatives", lambda x: x["field_type"] == F.col("chosen_field"))
    field = (F.when(F.col("choice").isin("alternative", "manual"), F.col("chosen_field"))
              .otherwise(F.col("field_type")))
    conf = (F.when(F.col("choice") == "alternative", F.element_at(alt_conf, 1)["confidence"])
             .when(F.col("choice") == "manual", F.lit(0.8)).otherwise(F.col("confidence")))
    kind = (F.when(F.col("choice") == "alternative", F.lit("user_correction"))
             .when(F.col("choice") == "manual", F.lit("manual_selection")).otherwise(F.lit("automatic")))
    kept = (F.coalesce(F.col("choice"), F.lit("accept")) != "reject") & field.isNotNull()
    return j.where(kept).select(
        "file_id", "column", field.alias("field_type"), conf.alias("confidence"), kind.alias("decision_type"),
        (F.coalesce(F.col("choice"), F.lit("accept")).isin("alternative", "manual") & ~F.col("chosen_field").eqNullSafe(F.col("field_type")))
        .alias("learn"))


# ---------------------------------------------------------------------------------------------------------------
# feedback (X06 -> U05, U06)

SYNONYM_KEY = ["field_type", "erp", "name"]


def catalogue_changes(queue: DataFrame, decisions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """U05 as data: what the decisions change in the catalogue, in its columns. A column whose field was chosen by hand
    becomes a synonym of that field; a rejected suggestion deactivates the synonym that the column's name is."""
    from cuadre.operators import catalog_ops as CO
    add = CO.learned_synonyms(apply_decisions(queue, decisions).where("learn"), synonyms)
    gone = queue.join(decisions.where("choice = 'reject'").select("file_id", "column"), ["file_id", "column"], "left_semi")
    gone = gone.select("field_type", F.lower(F.trim("column")).alias("__k")).distinct()
    off = synonyms.withColumn("__k", F.lower(F.trim("name"))).join(gone, ["field_type", "__k"], "left_semi").withColumn("deprecated", F.lit(True))
    return add.select(*synonyms.columns).unionByName(off.select(*synonyms.columns))


def merge_feedback(queue: DataFrame, decisions: DataFrame, sample: DataFrame, seed: DataFrame, catalogue_path: str, patterns_path: str) -> tuple[int, int]:
    """X06's learning job: decisions in, the next version of the synonym catalogue and of the learned-pattern table out;
    (catalogue version, pattern version). The same decisions again change nothing."""
    from cuadre.operators import catalog_ops as CO
    from cuadre.operators import patterns as PT
    from cuadre.sources import versions as V
    spark = decisions.sparkSession
    run = V.run_id(decisions)
    known = V.read_current(spark, catalogue_path, seed)
    catalogue = V.commit(CO.upsert_synonyms(known, catalogue_changes(queue, decisions, known)), catalogue_path, run)
    new = PT.learn_patterns(apply_decisions(queue, decisions).where("decision_type <> 'automatic'"), sample)
    old = V.read_current(spark, patterns_path, new.limit(0))  # no row: the shape only
    return catalogue, V.commit(PT.upsert_learned_patterns(old, new), patterns_path, run)
