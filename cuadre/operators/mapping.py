"""Schema harmonisation: map every column of every ledger in a lake to a canonical field (J01, J02, J04, J05, T01,
T04-T06, N13, W05-W07, K04, P08, A18, A20-A24, X01).

Inputs are small per-column tables (one row per (file, column), computed from bounded samples), so after the sample
step everything here is metadata-sized; the catalogue is broadcast (its size is the catalogue's, not the data's).
The reference's order-dependent greedy conflict pass (W06) becomes an ``aggregate`` fold over the sorted candidate
array of each (file, field) - at most the number of columns of one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuadre.operators import profile as P
from cuadre.operators.journal import STANDARD_FIELDS

# fixed values: rule lists
AMOUNT_PRIORITY_WORDS = ["amount", "importe", "saldo", "debe", "haber", "debit", "credit"]
AMOUNT_INDICATORS = ["saldo", "balance", "importe", "amount", "total"]
LOCAL_AMOUNT_MARKERS = ["local", "loc.", "ml", "lm"]
PROBLEMATIC_PREFIXES = ["fecha", "numero", "codigo", "tipo", "descripcion"]
SPECIFICITY_KEYWORDS = {
    "amount": ["saldo", "balance", "importe", "amount"], "debit_amount": ["debe", "debit"],
    "credit_amount": ["haber", "credit"], "journal_entry_id": ["asiento", "journal"],
    "posting_date": ["fecha", "date"], "gl_account_number": ["cuenta", "account"],
    "gl_account_name": ["nombre", "name"], "vendor_id": ["proveedor", "vendor", "supplier"],
}
# fixed values: keyword groups of the priority order (K03), the first group that a name contains counts
PRIORITY_GROUPS = [
    (["saldo", "balance"], 1), (["debe", "debit"], 1), (["haber", "credit"], 1),
    (["fecha", "date"], 2), (["asiento", "journal"], 2), (["cuenta", "account"], 2),
    (["cabecera", "header"], 3), (["concepto", "concept"], 3),
    (["descripcion", "description"], 4),
    (["doc", "documento", "numero"], 5), (["proveedor", "vendor", "supplier"], 5), (["nombre", "name"], 5),
]
LAST_PRIORITY = 6
CONFIDENCE_THRESHOLD = 0.75
MIN_CONFIDENCE = 0.3
LEARNED_RAISES = 0.7


def normalize_field_name(name: Column) -> Column:
    """Lower-case, drop everything outside [a-z0-9] (accented letters are dropped too)."""
    return F.regexp_replace(F.lower(name), "[^a-zA-Z0-9]", "")


def is_problematic_partial(name: Column, synonym: Column) -> Column:
    """A synonym inside a longer name starting with fecha/numero/codigo/tipo/descripcion is rejected."""
    fl, sl = F.lower(name), F.lower(synonym)
    bad = reduce(lambda a, b: a | b, [fl.startswith(p) & ~F.lit(p).contains(sl) for p in PROBLEMATIC_PREFIXES])
    return (fl != sl) & (F.instr(fl, sl) > 0) & bad


def name_specificity(name: Column, field: Column) -> Column:
    """Number of the field's specificity keywords contained in the name (0 for other fields)."""
    low = F.lower(name)
    out = F.lit(0)
    for fld, kws in SPECIFICITY_KEYWORDS.items():
        score = reduce(lambda a, b: a + b, [low.contains(k).cast("int") for k in kws])
        out = F.when(field == fld, score).otherwise(out)
    return out


def exact_matches(columns: DataFrame, synonyms: DataFrame, fields: DataFrame, erp: Column | str | None = None) -> DataFrame:
    """(file_id, column, field_type, exact_conf, field_order). ``columns`` has (file_id, column); ``erp`` an
    optional per-row ERP hint column name present on ``columns``.

    own-ERP hit: min(0.95 + 0.05 * boost, 1); any-ERP hit: min(0.85 + 0.1 * boost, 1); field-code hit: 0.90; best
    per field. The catalogue may grow by learning, so the join side is left to Spark's own size check."""
    cols = columns.withColumn("__norm", normalize_field_name(F.col("column")))
    syn = synonyms.select("field_type", F.col("erp").alias("syn_erp"), F.col("name").alias("syn_name"), "boost",
                          normalize_field_name(F.col("name")).alias("__norm"))
    hits = cols.join(syn, "__norm").where(~is_problematic_partial(F.col("column"), F.col("syn_name")))
    any_erp = F.least(F.lit(0.85) + F.lit(0.1) * F.col("boost"), F.lit(1.0))
    conf = any_erp
    if erp is not None:
        erp = F.col(erp) if isinstance(erp, str) else erp
        conf = F.greatest(any_erp, F.when(F.col("syn_erp") == erp,
                                          F.least(F.lit(0.95) + F.lit(0.05) * F.col("boost"), F.lit(1.0))))
    syn_hits = hits.select("file_id", "column", "field_type", conf.alias("c"))
    code = fields.select("field_type", normalize_field_name(F.col("field_type")).alias("__norm"))
    code_hits = cols.join(code, "__norm").select("file_id", "column", "field_type", F.lit(0.9).alias("c"))
    allh = syn_hits.unionByName(code_hits)
    best = allh.groupBy("file_id", "column", "field_type").agg(F.max("c").alias("exact_conf"))
    return best.join(fields.select("field_type", "field_order"), "field_type", "left")


def content_candidates(sample: DataFrame) -> DataFrame:
    """A11-A15 + J02 merged like the reference's dict updates (numeric, text, date, name pattern, vendor, account
    name; a later analysis overwrites an earlier score for the same field): (file_id, column, field_type,
    content_conf, content_rank) where ``content_rank`` is the position the field first appeared at."""
    g = ["file_id", "column", "ordinal"]
    num = P.numeric_profile(sample).select(*g, F.col("hint_field").alias("field_type"),
                                           F.col("hint_confidence").alias("c"), F.lit(1).alias("src"),
                                           F.lit(0).alias("k"))
    txt = P.text_profile(sample)
    text = txt.select(*g, F.col("hint_field").alias("field_type"), F.col("hint_confidence").alias("c"),
                      F.lit(2).alias("src"), F.lit(0).alias("k"))
    ds = P.date_share(sample)
    d1 = ds.select(*g, F.lit("posting_date").alias("field_type"), F.col("posting_date_conf").alias("c"),
                   F.lit(3).alias("src"), F.lit(0).alias("k"))
    d2 = ds.select(*g, F.lit("entry_date").alias("field_type"), F.col("entry_date_conf").alias("c"),
                   F.lit(3).alias("src"), F.lit(1).alias("k"))
    pf, pc = P.name_pattern_hint(F.col("column"))
    cols = sample.select(*g).distinct()
    pat = cols.select(*g, pf.alias("field_type"), pc.alias("c"), F.lit(4).alias("src"), F.lit(0).alias("k"))
    ven = txt.select(*g, F.lit("vendor_id").alias("field_type"),
                     P.vendor_hint(F.col("column"), F.col("avg_length"), F.col("unique_ratio")).alias("c"),
                     F.lit(5).alias("src"), F.lit(0).alias("k"))
    acc = txt.select(*g, F.lit("gl_account_name").alias("field_type"),
                     P.account_name_hint(F.col("column"), F.col("avg_length")).alias("c"),
                     F.lit(6).alias("src"), F.lit(0).alias("k"))
    allc = reduce(lambda a, b: a.unionByName(b), [num, text, d1, d2, pat, ven, acc])
    allc = allc.where(F.col("field_type").isNotNull() & F.col("c").isNotNull())
    return allc.groupBy(*g, "field_type").agg(
        F.max_by("c", F.col("src") * 10 + F.col("k")).alias("content_conf"),
        F.min(F.col("src") * 10 + F.col("k")).alias("content_rank"))


def best_match(exact: DataFrame, content: DataFrame, ordinals: DataFrame) -> DataFrame:
    """N13 + W05: combine exact and content scores per field and keep the best field per column.

    both: min(0.7 * exact + 0.3 * content, 1); exact only: exact; content only (standard fields only):
    0.8 * content. Ties go to exact matches in catalogue order, then content fields in first-seen order; a best
    score below 0.3 maps nothing. Returns (file_id, column, ordinal, field_type, confidence)."""
    k = ["file_id", "column", "field_type"]
    c = content.where(F.col("field_type").isin(STANDARD_FIELDS)).select(*k, "content_conf", "content_rank")
    e = exact.select(*k, "exact_conf", "field_order")
    j = e.join(c, k, "full")
    conf = (F.when(F.col("exact_conf").isNotNull() & F.col("content_conf").isNotNull(),
                   F.least(F.col("exact_conf") * 0.7 + F.col("content_conf") * 0.3, F.lit(1.0)))
             .when(F.col("exact_conf").isNotNull(), F.col("exact_conf"))
             .otherwise(F.col("content_conf") * 0.8))
    rank = F.when(F.col("exact_conf").isNotNull(), F.col("field_order")).otherwise(100 + F.col("content_rank"))
    scored = j.withColumn("confidence", conf).withColumn("__rank", rank)
    w = Window.partitionBy("file_id", "column").orderBy(F.desc("confidence"), "__rank")
    best = scored.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") == 1)
                                                                    & (F.col("confidence") >= MIN_CONFIDENCE))
    return best.join(ordinals, ["file_id", "column"]).select("file_id", "column", "ordinal", "field_type",
                                                             "confidence")


def better_amount_flags(sample: DataFrame) -> DataFrame:
    """The name holds an amount word and the numeric sample has std > 1 and |mean| > 1."""
    low = F.lower(F.col("column"))
    named = reduce(lambda a, b: a | b, [low.contains(w) for w in AMOUNT_INDICATORS])
    x = P.py_float(F.col("value"))
    s = sample.groupBy("file_id", "column").agg(F.stddev_samp(x).alias("sd"), F.avg(x).alias("mu"))
    return s.select("file_id", "column",
                    F.coalesce(named & (F.col("sd") > 1) & (F.abs(F.col("mu")) > 1), F.lit(False))
                    .alias("better_amount"))


def forced_headers(best: DataFrame) -> DataFrame:
    """The first column (by ordinal) of a file whose name holds cabecera or header and description is forced to
    ``description`` at 0.95 and processed before all others; later ones keep their normal match."""
    low = F.lower(F.col("column"))
    named = (low.contains("cabecera") | low.contains("header")) & low.contains("description")
    first = Window.partitionBy("file_id").orderBy(F.when(named, F.col("ordinal")).asc_nulls_last(), "column")
    force = named & (F.row_number().over(first) == 1)
    return (best.withColumn("__force", force)
                .withColumn("field_type", F.when(F.col("__force"), F.lit("description")).otherwise(F.col("field_type")))
                .withColumn("confidence", F.when(F.col("__force"), F.lit(0.95)).otherwise(F.col("confidence"))))


def column_priority(name: Column) -> Column:
    """1 for the most specific names to 6 for all others."""
    low = F.lower(name)
    out = None
    for words, priority in PRIORITY_GROUPS:
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(hit, priority) if out is None else out.when(hit, priority)
    return out.otherwise(LAST_PRIORITY)


def forced_by_priority(best: DataFrame, columns: DataFrame) -> DataFrame:
    """T05 in the priority order: the first column, by (K03, ordinal), that claims ``description`` decides. If it is named
    as a header (whether or not anything else matches it), it is forced to ``description`` at 0.95; if a column took the
    field before, nothing is forced."""
    low = F.lower(F.col("column"))
    named = (low.contains("cabecera") | low.contains("header")) & low.contains("description")
    all_ = columns.select("file_id", "column", "ordinal").join(best.drop("ordinal"), ["file_id", "column"], "left")
    claims = named | (F.col("field_type") == "description")
    place = F.struct(column_priority(F.col("column")), "ordinal", "column")
    first = all_.where(claims).groupBy("file_id").agg(F.min_by(F.when(named, F.col("column")), place).alias("__first"))
    j = all_.join(first, "file_id", "left").withColumn("__force", F.coalesce(F.col("column") == F.col("__first"), F.lit(False)))
    return (j.withColumn("field_type", F.when(F.col("__force"), F.lit("description")).otherwise(F.col("field_type")))
             .withColumn("confidence", F.when(F.col("__force"), F.lit(0.95)).otherwise(F.col("confidence")))
             .where(F.col("field_type").isNotNull()).drop("__first"))


def harmonise_by_priority(best: DataFrame, columns: DataFrame, better_amount: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """One pass over each file's columns in the priority order (K03), without a global resolution afterwards.

    A column asks for its best field; it gets it if the field is free or if it beats the holder by the rules of W06 (for
    journal ids W10). Every column that got its field in its turn stays in the result, also where a later one took the
    field over (``taken_over``); a column that lost, or has no match, has no row with a field. One row per column:
    (file_id, column, ordinal, priority, field_type, confidence, taken_over)."""
    order = column_priority(F.col("column"))
    kept = fold_claims(best, better_amount, balance, forced=forced_by_priority(best, columns), first=order)
    last = Window.partitionBy("file_id", "field_type").orderBy(F.desc("pos"))
    kept = kept.withColumn("taken_over", F.row_number().over(last) > 1)
    return columns.select("file_id", "column", "ordinal", order.alias("priority")).join(
        kept.select("file_id", "column", "field_type", "confidence", "taken_over"), ["file_id", "column"], "left")


def fold_claims(best: DataFrame, better_amount: DataFrame, balance: DataFrame | None = None,
                forced: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """K04 + W06: the columns each field keeps, (file_id, field_type, pos, column, confidence, quality).

    Processing order: the forced header (T05), then columns whose names hold an amount word (by ordinal), then the
    rest. The first claimant of a field is kept; a later one is kept (and becomes current) if its confidence beats
    the current by more than 0.2, or, for ``amount``, if it is a better amount candidate (A18), or, for other fields,
    if its name is more specific (T06). For ``journal_entry_id`` the combined score 0.7 * balance + 0.3 * confidence
    must be strictly greater (W10); ``balance`` holds the trial's (file_id, column, quality), and without a trial the
    balance part falls back to the confidence. Losers are dropped. ``forced`` (best matches with ``__force``) and
    ``first`` (the leading order) replace the processing order and T05's rule (X02).
    """
    low = F.lower(F.col("column"))
    amount_first = reduce(lambda a, b: a | b, [low.contains(w) for w in AMOUNT_PRIORITY_WORDS])
    b = (forced_headers(best) if forced is None else forced).join(better_amount, ["file_id", "column"], "left")
    b = (b.join(balance.select("file_id", "column", "quality"), ["file_id", "column"], "left") if balance is not None
         else b.withColumn("quality", F.lit(None).cast("double")))
    b = (b.withColumn("proc_order", F.when(F.col("__force"), F.lit(0)).when(amount_first, F.lit(1)).otherwise(F.lit(2)) if first is None else first)
          .withColumn("spec", name_specificity(F.col("column"), F.col("field_type"))))
    cand = F.struct(F.col("proc_order"), F.col("ordinal"), F.col("column"), F.col("confidence"),
                    F.coalesce(F.col("better_amount"), F.lit(False)).alias("better_amount"), F.col("spec"), F.col("quality"))
    grouped = b.groupBy("file_id", "field_type").agg(F.array_sort(F.collect_list(cand)).alias("cands"))
    init = F.struct(F.lit(None).cast("double").alias("cur_conf"), F.lit(None).cast("int").alias("cur_spec"),
                    F.lit(None).cast("double").alias("cur_trial"),
                    F.array().cast(grouped.schema["cands"].dataType).alias("kept"))
    field = F.col("field_type")

    def step(acc, x):
        trial = F.coalesce(x["quality"], x["confidence"]) * 0.7 + x["confidence"] * 0.3
        wins = F.when(field == "journal_entry_id", trial > acc["cur_trial"]).otherwise(
            (x["confidence"] > acc["cur_conf"] + 0.2)
            | F.when(field == "amount", x["better_amount"]).otherwise(x["spec"] > acc["cur_spec"]))
        return F.when(acc["cur_conf"].isNull() | wins, F.struct(
            x["confidence"].alias("cur_conf"), x["spec"].alias("cur_spec"), trial.alias("cur_trial"),
            F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    kept = grouped.select("file_id", "field_type", F.posexplode(F.aggregate("cands", init, step)["kept"]).alias("pos", "k"))
    return kept.select("file_id", "field_type", "pos", F.col("k.column").alias("column"),
                       F.col("k.confidence").alias("confidence"), F.col("k.quality").alias("quality"))


def final_winners(kept: DataFrame) -> DataFrame:
    """The column of each field. One kept column -> no_conflict; ``amount`` -> the first whose name holds
    local/loc./ml/lm; ``journal_entry_id`` with a balance trial -> the best balance score, ties to the higher
    confidence, then the first; otherwise the highest confidence, first on ties."""
    low = F.lower(F.col("column"))
    is_local = (F.col("field_type") == "amount") & reduce(lambda a, b: a | b, [low.contains(m) for m in LOCAL_AMOUNT_MARKERS])
    per = Window.partitionBy("file_id", "field_type")
    tried = (F.col("field_type") == "journal_entry_id") & (F.count("quality").over(per) > 0)
    k = (kept.withColumn("__n", F.count(F.lit(1)).over(per)).withColumn("__local", is_local)
             .withColumn("__any_local", F.max(is_local).over(per)).withColumn("__tried", tried))
    order = per.orderBy(F.desc("__local"), F.when(F.col("__local"), F.col("pos")),
                        F.when(F.col("__tried"), F.coalesce("quality", F.lit(0.0))).desc_nulls_last(), F.desc("confidence"), "pos")
    res = (F.when(F.col("__n") == 1, F.lit("no_conflict")).when(F.col("__any_local"), F.lit("amount_local_priority"))
            .when(F.col("__tried"), F.lit("balance_validation_winner")).otherwise(F.lit("highest_confidence")))
    return (k.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") == 1)
             .select("file_id", "column", "field_type", "confidence", res.alias("resolution_type")))


def resolve_conflicts(best: DataFrame, better_amount: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    """K04 + W06 + W07 (+ W10 with ``balance``)."""
    return final_winners(fold_claims(best, better_amount, balance))


def trusted_amounts(mappings: DataFrame) -> DataFrame:
    """Amount, debit and credit mappings with confidence >= 0.75."""
    return mappings.where(F.col("field_type").isin("amount", "debit_amount", "credit_amount")
                          & (F.col("confidence") >= CONFIDENCE_THRESHOLD))


def id_conflicts(best: DataFrame) -> DataFrame:
    """Files in which more than one column claims ``journal_entry_id``."""
    return (best.where(F.col("field_type") == "journal_entry_id").groupBy("file_id")
                .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_id"))


def balance_trial(cells: DataFrame, best: DataFrame, amounts: DataFrame, tol: float = 0.01) -> DataFrame:
    """J08 over a lake: (file_id, column, quality) for the journal-id candidates of every file that has more than
    one and a trusted amount.

    ``cells`` is (file_id, column, row_key, value); ``row_key`` names a row within its file. A row's amount is its
    cleaned ``amount`` (N01), else debit - credit. Candidate cells meet the amount of their row on (file_id, row_key),
    then one aggregation per (file, candidate, id) gives the entry sums: all candidates of all files in one pass, and
    a hot id is summed before it is shuffled.
    """
    from cuadre.functions import numbers as N
    cands = best.where(F.col("field_type") == "journal_entry_id").select("file_id", "column")
    several = id_conflicts(best)
    cands = cands.join(several, "file_id", "left_semi").join(amounts.select("file_id"), "file_id", "left_semi")
    roles = cands.withColumn("role", F.lit("id")).unionByName(
        amounts.join(several, "file_id", "left_semi").select("file_id", "column", F.col("field_type").alias("role")))
    used = cells.join(roles, ["file_id", "column"])
    money = N.with_cleaned(used.where("role <> 'id'"), {"__x": "value"})
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("__x").cast("decimal(18,2)")))
    money = money.groupBy("file_id", "row_key").agg(pick("amount").alias("a"), pick("debit_amount").alias("d"), pick("credit_amount").alias("c"))
    zero = F.lit(0).cast("decimal(18,2)")
    money = money.select("file_id", "row_key", F.coalesce("a", F.when(F.col("d").isNotNull() | F.col("c").isNotNull(),
                                                                     F.coalesce("d", zero) - F.coalesce("c", zero))).alias("amount"))
    ids = used.where((F.col("role") == "id") & F.col("value").isNotNull()).select("file_id", "column", "row_key", "value")
    sums = (ids.join(money, ["file_id", "row_key"], "left").groupBy("file_id", "column", "value")
               .agg(F.coalesce(F.sum("amount"), zero).alias("s")))
    share = F.count_if(F.abs("s") < tol).cast("double") / F.count(F.lit(1)).cast("double")
    return sums.groupBy("file_id", "column").agg(share.alias("quality"))


def best_matches(sample: DataFrame, columns: DataFrame, synonyms: DataFrame, fields: DataFrame) -> DataFrame:
    """J03 -> J01 -> J02 -> W05: the best field of every column. ``columns`` is (file_id, column, ordinal) from the
    headers, so a column without any value still has its name match."""
    hinted = columns.join(detect_erp(columns).select("file_id", "erp"), "file_id", "left")
    return best_match(exact_matches(hinted, synonyms, fields, "erp"), content_candidates(sample), columns)


def map_columns(sample: DataFrame, synonyms: DataFrame, fields: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                columns: DataFrame | None = None, cells: DataFrame | None = None, trial=None) -> DataFrame:
    """The lake's sample -> final mappings (file_id, column, field_type, confidence, resolution_type), P08
    applied (confidence >= threshold). With ``cells``, or with ``trial``, a function of (best matches, trusted amounts),
    journal-id conflicts are decided by balance (J08, W10)."""
    columns = sample.select("file_id", "column", "ordinal").distinct() if columns is None else columns
    from cuadre.session import cut_lineage
    best = best_matches(sample, columns, synonyms, fields)
    flags = better_amount_flags(sample)
    if trial is None and cells is not None:
        trial = lambda best, amounts: balance_trial(cells, best, amounts)
    if trial is not None:  # one row per column: computed once, read by every step below
        best, flags = cut_lineage(best), cut_lineage(flags)
    final = resolve_conflicts(best, flags)
    if trial is not None and not id_conflicts(best).isEmpty():  # the whole ledger is read only where ids compete
        final = resolve_conflicts(best, flags, cut_lineage(trial(best, trusted_amounts(final))))
    return final.where(F.col("confidence") >= threshold)


def by_priority(mappings: DataFrame) -> DataFrame:
    """Mappings with the most certain first (for written output only: a global sort)."""
    return mappings.orderBy(F.desc("confidence"), "file_id", "column")


# ---------------------------------------------------------------------------------------------------------------
# reports over mappings

def mapping_table(mappings: DataFrame, files: DataFrame, standard: list[str] | None = None) -> DataFrame:
    """Every standard field of every file with its mapped column or 'No mapeado' and 0.0."""
    fields = standard or STANDARD_FIELDS
    pairs = F.array(*[F.struct(F.lit(f).alias("field_type"), F.lit(i).alias("field_order"))
                      for i, f in enumerate(fields)])
    std = files.select("file_id").distinct().select("file_id", F.inline(pairs))  # 17 rows per file, no join
    j = std.join(mappings, ["file_id", "field_type"], "left")
    return j.select("file_id", "field_type", "field_order", F.coalesce("column", F.lit("No mapeado")).alias("column"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def unmapped_fields(mappings: DataFrame, files: DataFrame, standard: list[str] | None = None) -> DataFrame:
    """Standard fields without a mapping, per file."""
    fields = F.array(*[F.lit(f) for f in (standard or STANDARD_FIELDS)])
    std = files.select("file_id").distinct().select("file_id", F.explode(fields).alias("field_type"))
    return std.join(mappings.select("file_id", "field_type"), ["file_id", "field_type"], "left_anti")


def mapping_summary(mappings: DataFrame, columns: DataFrame) -> DataFrame:
    """Per file: columns, mapped, rate %, mean confidence, distinct field types."""
    c = columns.groupBy("file_id").agg(F.count_distinct("column").alias("columns"))
    m = mappings.groupBy("file_id").agg(F.count(F.lit(1)).alias("mapped"),
                                        F.avg("confidence").alias("mean_confidence"),
                                        F.count_distinct("field_type").alias("field_types"))
    j = c.join(m, "file_id", "left").fillna({"mapped": 0, "field_types": 0})
    return j.withColumn("mapping_rate_pct", F.col("mapped") * 100.0 / F.col("columns"))


def cross_file_summary(summary: DataFrame) -> DataFrame:
    """Mean rate and confidence over files, best and worst file (lake-level columns)."""
    return summary.agg(F.avg("mapping_rate_pct").alias("lake_mean_rate_pct"),
                       F.avg("mean_confidence").alias("lake_mean_confidence"),
                       F.max_by("file_id", F.struct("mapping_rate_pct", F.col("file_id"))).alias("best_file"),
                       F.min_by("file_id", F.struct("mapping_rate_pct", F.col("file_id"))).alias("worst_file"))


def erp_distribution(columns: DataFrame) -> DataFrame:
    """Files per detected ERP."""
    return detect_erp(columns).groupBy("erp").agg(F.count(F.lit(1)).alias("files"))


def mapping_coherence(best: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Critical fields claimed by more than one column of a file (before conflict resolution)."""
    crit = critical or ["journal_entry_id", "amount", "posting_date", "gl_account_number"]
    return (best.where(F.col("field_type").isin(crit)).groupBy("file_id", "field_type")
                .agg(F.count(F.lit(1)).alias("columns")).where(F.col("columns") > 1))


def decision_stats(mappings: DataFrame) -> DataFrame:
    """Per file, mappings by confidence band (> 0.8 high) and conflicts resolved (each mapping counted once)."""
    return mappings.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("automatic"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
        F.count_if(F.col("confidence") <= 0.8).alias("low_confidence"),
        F.count_if(F.col("resolution_type") != "no_conflict").alias("conflicts_resolved"))


# fixed values: ERP column-name signatures
ERP_SIGNATURES = {
    "SAP": ["belnr", "bukrs", "hkont", "shkzg", "dmbtr", "waers", "bldat", "budat", "xblnr", "bschl", "kostl"],
    "Oracle": ["je_header_id", "je_line_num", "code_combination_id", "entered_dr", "entered_cr", "accounted_dr",
               "accounted_cr"],
    "Navision": ["document_no", "posting_date", "g_l_account_no", "amount_lcy", "debit_amount", "credit_amount"],
    "SAGE": ["reference", "account_code", "nominal_code", "transaction_type", "net_amount", "tax_amount"],
    "PeopleSoft": ["business_unit", "journal_id", "journal_line", "account", "monetary_amount",
                   "statistics_amount"],
}


def detect_erp(columns: DataFrame) -> DataFrame:
    """Per file, the lower-cased header names joined by spaces; score per ERP = signature patterns contained
    / patterns; the best ERP (first on ties) if its score > 0.3, else Generic_ES. ``columns``: (file_id, column,
    ordinal)."""
    hdr = columns.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("ordinal", F.lower("column").alias("c")))), lambda x: x["c"]), " ").alias("header"))
    scores = []
    for i, (erp, pats) in enumerate(ERP_SIGNATURES.items()):
        hits = reduce(lambda a, b: a + b, [F.col("header").contains(p).cast("int") for p in pats])
        scores.append(F.struct((hits / F.lit(len(pats))).alias("score"), F.lit(-i).alias("neg_order"),
                               F.lit(erp).alias("erp")))
    best = F.array_max(F.array(*scores))
    return hdr.select("file_id", best["score"].alias("erp_score"),
                      F.when(best["score"] > 0.3, best["erp"]).otherwise(F.lit("Generic_ES")).alias("erp"))


def merge_candidate_sources(mapper: DataFrame, validators: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Per (file, column, field): mapper and validator both -> average; one source -> its score. ``learned`` (V15
    scores) comes last: above 0.7 it raises a candidate that is there to its own score, and a field that no other source
    names becomes a candidate."""
    m = mapper.select("file_id", "column", "field_type", F.col("confidence").alias("m"))
    v = validators.select("file_id", "column", "field_type", F.col("score").alias("v"))
    j = m.join(v, ["file_id", "column", "field_type"], "full")
    conf = F.when(F.col("m").isNotNull() & F.col("v").isNotNull(), (F.col("m") + F.col("v")) / 2) \
        .otherwise(F.coalesce("m", "v"))
    src = F.when(F.col("m").isNotNull() & F.col("v").isNotNull(), F.lit("mapper+validator")) \
        .when(F.col("m").isNotNull(), F.lit("mapper")).otherwise(F.lit("content_validator"))
    out = j.select("file_id", "column", "field_type", conf.alias("confidence"), src.alias("source"),
                   F.col("v").alias("validator_score"))
    if learned is None:
        return out
    p = learned.select("file_id", "column", "field_type", F.col("score").alias("p"))
    j = out.join(p, ["file_id", "column", "field_type"], "full")
    raised = F.col("confidence").isNotNull() & (F.col("p") > LEARNED_RAISES)
    return j.select("file_id", "column", "field_type",
                    F.when(raised, F.greatest("confidence", "p")).otherwise(F.coalesce("confidence", "p")).alias("confidence"),
                    F.when(F.col("source").isNull(), F.lit("learned_pattern")).when(raised, F.concat("source", F.lit("+learned_pattern")))
                    .otherwise(F.col("source")).alias("source"), "validator_score")


def top_candidates(cands: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best candidates per column (row_number <= k: partial WindowGroupLimit). Ties go to the mapper's
    own candidate, then to the validators' order."""
    from cuadre.functions.validators import VALIDATORS
    place = F.array_position(F.array(*[F.lit(v) for v in VALIDATORS]), F.col("field_type"))
    w = Window.partitionBy("file_id", "column").orderBy(F.desc("confidence"), F.col("source") == "content_validator",
                                                        place, "field_type")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def smart_corrections(top: DataFrame, validator_scores: DataFrame) -> DataFrame:
    """When the best candidate's own validator score is below 0.3, the best other field whose validator scores
    above 0.5 replaces it (``corrected_from`` keeps the original)."""
    best = top.where(F.col("rank") == 1)
    alt = validator_scores.where(F.col("score") > 0.5).select(
        "file_id", "column", F.col("field_type").alias("alt_field"), F.col("score").alias("alt_score"))
    j = best.join(alt, ["file_id", "column"], "left").where(
        F.col("alt_field").isNull() | (F.col("alt_field") != F.col("field_type")))
    w = Window.partitionBy("file_id", "column").orderBy(F.desc_nulls_last("alt_score"), "alt_field")
    j = j.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    weak = F.coalesce(F.col("validator_score"), F.lit(0.0)) < 0.3
    fix = weak & F.col("alt_field").isNotNull()
    return j.select("file_id", "column", F.when(fix, F.col("alt_field")).otherwise(F.col("field_type"))
                    .alias("field_type"),
                    F.when(fix, F.col("alt_score")).otherwise(F.col("confidence")).alias("confidence"),
                    F.when(fix, F.col("field_type")).alias("corrected_from"))


def detection_quality(detected: DataFrame, columns: DataFrame, cells_nonnull: DataFrame) -> DataFrame:
    """Per file: detected columns, detection rate, mean confidence and the share of non-null cells in the
    detected columns. ``cells_nonnull``: (file_id, column, nonnull, rows)."""
    c = columns.groupBy("file_id").agg(F.count_distinct("column").alias("columns"))
    d = detected.groupBy("file_id").agg(F.count_distinct("column").alias("detected"),
                                        F.avg("confidence").alias("mean_confidence"))
    cov = cells_nonnull.join(detected.select("file_id", "column").distinct(), ["file_id", "column"]) \
                       .groupBy("file_id").agg((F.sum("nonnull") / F.sum("rows")).alias("coverage"))
    return c.join(d, "file_id", "left").join(cov, "file_id", "left").withColumn(
        "detection_rate", F.coalesce(F.col("detected"), F.lit(0)) / F.col("columns"))


def single_year_date_fix(mappings: DataFrame, date_years: DataFrame) -> DataFrame:
    """A file whose only date mapping is entry_date (confidence >= 0.8) and whose parsed years are all equal
    gets it re-tagged as posting_date with confidence + 0.1 (capped at 1). ``date_years``: (file_id, column,
    distinct_years)."""
    dates = mappings.where(F.col("field_type").isin("entry_date", "posting_date"))
    per_file = dates.groupBy("file_id").agg(F.count(F.lit(1)).alias("__n"))
    j = mappings.join(per_file, "file_id", "left").join(date_years, ["file_id", "column"], "left")
    hit = ((F.col("__n") == 1) & (F.col("field_type") == "entry_date") & (F.col("confidence") >= 0.8)
           & (F.col("distinct_years") == 1))
    return j.select(*[c for c in mappings.columns if c not in ("field_type", "confidence")],
                    F.when(hit, F.lit("posting_date")).otherwise(F.col("field_type")).alias("field_type"),
                    F.when(hit, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence"))
                    .alias("confidence"))
