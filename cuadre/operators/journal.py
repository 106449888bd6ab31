"""Canonical journal: rename, clean, derive amounts, split header / detail (P01-P07, P18, P19, N09, J06, A26-A28,
K01, X04).

Data-dependent decisions of the reference (does the indicator column hold data? is a column already numeric?) are
computed as tiny per-group flag tables (one row per ledger file) and joined back, so the whole chain stays one lazy
plan. "First row" semantics use an explicit ``row_id`` and aggregate with ``min_by`` (partial aggregation, so a hot
journal id does not land whole in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadre.functions import numbers as N

# fixed values: canonical schemas and field lists
STANDARD_FIELDS = [
    "journal_entry_id", "line_number", "description", "line_description", "posting_date", "fiscal_year",
    "period_number", "gl_account_number", "amount", "debit_amount", "credit_amount", "debit_credit_indicator",
    "prepared_by", "entry_date", "entry_time", "gl_account_name", "vendor_id",
]
HEADER_FIELDS = [
    "journal_entry_id", "journal_id", "entry_date", "entry_time", "posting_date", "reversal_date", "effective_date",
    "description", "reference_number", "source", "entry_type", "recurring_entry", "manual_entry", "adjustment_entry",
    "prepared_by", "approved_by", "approval_date", "entry_status", "total_debit_amount", "total_credit_amount",
    "line_count", "fiscal_year", "period_number", "user_defined_01", "user_defined_02", "user_defined_03",
]
DETAIL_FIELDS = [
    "journal_entry_id", "line_number", "gl_account_number", "amount", "debit_credit_indicator", "business_unit",
    "cost_center", "department", "project_code", "location", "line_description", "reference_number", "customer_id",
    "vendor_id", "product_id", "user_defined_01", "user_defined_02", "user_defined_03",
]
MANUAL_HEADER_FIELDS = ["journal_entry_id", "entry_date", "entry_time", "posting_date", "description",
                        "prepared_by", "fiscal_year", "period_number"]
MANUAL_DETAIL_FIELDS = ["journal_entry_id", "line_number", "gl_account_number", "gl_account_name", "amount",
                        "debit_credit_indicator", "line_description", "vendor_id"]
NUMERIC_TRIGGER_FIELDS = ["amount", "line_number", "debit_amount", "credit_amount", "fiscal_year", "period_number",
                          "gl_account_number"]
CLEANED_NUMERIC_FIELDS = ["amount", "debit_amount", "credit_amount", "debit", "credit", "debe", "haber", "importe",
                          "valor"]
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def rename_by_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P01."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_unique(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The second column mapped to the same field becomes ``field_1``, the third ``field_2`` (source order)."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        if c in mapping:
            f = mapping[c]
            k = seen.get(f, 0)
            seen[f] = k + 1
            out.append(F.col(f"`{c}`").alias(f if k == 0 else f"{f}_{k}"))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def _group_flags(df: DataFrame, group_cols: list[str], **flags: Column) -> DataFrame:
    aggs = [v.alias(k) for k, v in flags.items()]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def _attach(df: DataFrame, flags: DataFrame, group_cols: list[str]) -> DataFrame:
    """Attach a per-ledger decision table. Without group columns it is one row (a global aggregate): broadcast is
    safe. Per file it has one row per file, a count that is not bounded in advance, so it is a plain equi-join that
    AQE turns into a broadcast at run time when small, and splits (skew join) when one file is huge."""
    return df.join(flags, group_cols, "left") if group_cols else df.crossJoin(F.broadcast(flags))


def conform_columns(df: DataFrame, fields: list[str]) -> list[Column]:
    """The fields in their fixed order, missing ones as ''."""
    return [F.col(f) if f in df.columns else F.lit("").alias(f) for f in fields]


def conform(df: DataFrame, fields: list[str]) -> DataFrame:
    """Add missing columns as '' and project in the fixed order."""
    return df.select(*conform_columns(df, fields))


def regenerate_indicator(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """If ``debit_credit_indicator`` is entirely null (per ledger) and ``amount`` exists, rebuild it from the
    sign of the amount."""
    g = group_cols or []
    if "debit_credit_indicator" not in df.columns or "amount" not in df.columns:
        return df
    flags = _group_flags(df, g, __ind_all_null=F.count("debit_credit_indicator") == 0)
    out = _attach(df, flags, g)
    return out.withColumn("debit_credit_indicator",
                          F.when(F.col("__ind_all_null"), N.indicator_from_amount("amount"))
                           .otherwise(F.col("debit_credit_indicator"))).drop("__ind_all_null")


def available_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only the listed fields that exist."""
    return df.select(*[f for f in fields if f in df.columns])


def numeric_processing_applies(df: DataFrame) -> bool:
    """Cleaning runs only when one of the seven numeric field names is present (schema check)."""
    return any(f in df.columns for f in NUMERIC_TRIGGER_FIELDS)


def clean_numeric_columns(df: DataFrame, group_cols: list[str] | None = None,
                          passthrough_plain: bool = True, flags_attached: bool = False) -> DataFrame:
    """Clean every known numeric column with N01.

    With ``passthrough_plain`` a column whose non-blank values are all plain numbers ('1234.5', '-3') in a ledger is
    cast directly, as a typed source column would be read, instead of running the separator ladder.
    """
    g = group_cols or []
    fields = [f for f in CLEANED_NUMERIC_FIELDS if f in df.columns]
    if not fields:
        return df
    if passthrough_plain:
        if not flags_attached:
            flags = {}
            for f in fields:
                t = F.trim(F.col(f).cast("string"))
                nonblank = F.col(f).isNotNull() & (t != "")
                flags[f"__plain_{f}"] = ((F.count_if(nonblank) > 0)
                                         & (F.count_if(nonblank & ~t.rlike(PLAIN_NUMBER)) == 0))
            df = _attach(df, _group_flags(df, g, **flags), g)
        df = N.with_cleaned(df, {f"__cl_{f}": F.col(f) for f in fields})
        cols = {f: F.when(F.col(f"__plain_{f}"),
                          F.coalesce(F.trim(F.col(f).cast("string")).try_cast("double"), F.lit(0.0)))
                    .otherwise(F.col(f"__cl_{f}")) for f in fields}
        return df.withColumns(cols).drop(*[f"__plain_{f}" for f in fields], *[f"__cl_{f}" for f in fields])
    df = N.with_cleaned(df, {f"__cl_{f}": F.col(f) for f in fields})
    return df.withColumns({f: F.col(f"__cl_{f}") for f in fields}).drop(*[f"__cl_{f}" for f in fields])


def cleaning_stats(raw: DataFrame, cleaned: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per cleaned field, zero values after cleaning and parenthesis values before it. ``raw`` and ``cleaned``
    must be row-aligned projections of the same input (both carry the same columns)."""
    g = group_cols or []
    fields = [f for f in CLEANED_NUMERIC_FIELDS if f in raw.columns]
    both = N.with_cleaned(raw.select(*g, *[F.col(f).cast("string").alias(f"__raw_{f}") for f in fields]),
                          {f"__cl_{f}": f"__raw_{f}" for f in fields})
    aggs = []
    for f in fields:
        aggs += [F.count_if(F.col(f"__cl_{f}") == 0.0).alias(f"{f}__zero_values"),
                 F.count_if(F.col(f"__raw_{f}").contains("(")).alias(f"{f}__parentheses")]
    wide = both.groupBy(*g).agg(*aggs) if g else both.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}__zero_values`, `{f}__parentheses`" for f in fields)
    return wide.selectExpr(*g, f"stack({len(fields)}, {stack}) AS (field, zero_values, parentheses_negatives)")


def apply_amount_scenarios(df: DataFrame, group_cols: list[str] | None = None,
                           flags_attached: bool = False) -> DataFrame:
    """Choose the amount / indicator derivation per ledger.

    | amount | debit & credit | indicator has data | action |
    | no     | both           | any                | amount = debit - credit, indicator from debit/credit |
    | yes    | neither        | no                 | indicator from the amount sign |
    | yes    | any            | yes                | nothing (cleaning only) |
    | yes    | both           | no                 | indicator from debit/credit |
    "Has data": not all null, and some value differs from '' (a null counts as different).
    Adds ``amount_scenario`` (1, 2, 3, 4 or 0 = incomplete).
    """
    g = group_cols or []
    has_amount = "amount" in df.columns
    has_debit = "debit_amount" in df.columns
    has_credit = "credit_amount" in df.columns
    if "debit_credit_indicator" in df.columns:
        ind = F.col("debit_credit_indicator")
        if not flags_attached:
            flags = _group_flags(df, g, __has_ind=(F.count(ind) > 0) & F.max(ind.isNull() | (ind != "")))
            df = _attach(df, flags, g)
        has_ind = F.coalesce(F.col("__has_ind"), F.lit(False))
    else:
        has_ind = F.lit(False)
        df = df.withColumn("debit_credit_indicator", F.lit(None).cast("string"))
    existing = F.col("debit_credit_indicator")
    if not has_amount and has_debit and has_credit:
        to_clean = {c: c for c in ("debit_amount", "credit_amount") if dict(df.dtypes)[c] == "string"}
        if to_clean:
            df = N.with_cleaned(df.withColumnsRenamed({c: f"__raw_{c}" for c in to_clean}),
                                {c: f"__raw_{c}" for c in to_clean}).drop(*[f"__raw_{c}" for c in to_clean])
        df = df.withColumns({"amount": N.debit_credit_to_amount("debit_amount", "credit_amount"),
                             "debit_credit_indicator": N.indicator_from_debit_credit("debit_amount", "credit_amount"),
                             "amount_scenario": F.lit(1)})
    elif has_amount and not has_debit and not has_credit:
        df = df.withColumns({"debit_credit_indicator": F.when(has_ind, existing)
                             .otherwise(N.indicator_from_amount("amount")),
                             "amount_scenario": F.when(has_ind, F.lit(3)).otherwise(F.lit(2))})
    elif has_amount and has_debit and has_credit:
        df = df.withColumns({"debit_credit_indicator": F.when(has_ind, existing)
                             .otherwise(N.indicator_from_debit_credit("debit_amount", "credit_amount")),
                             "amount_scenario": F.when(has_ind, F.lit(3)).otherwise(F.lit(4))})
    elif has_amount:
        df = df.withColumn("amount_scenario", F.when(has_ind, F.lit(3)).otherwise(F.lit(0)))
    else:
        df = df.withColumn("amount_scenario", F.lit(0))
    return df if flags_attached else df.drop("__has_ind")


def signed_amount(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Opt-in extension of P18: sign an unsigned amount by its indicator (D, S, DR, +, 1 -> debit; H, C, CR, -, 0 ->
    credit), only for ledgers whose amount column has no negative values."""
    g = group_cols or []
    flags = _group_flags(df, g, __no_neg=F.count_if(F.col("amount") < 0) == 0)
    out = _attach(df, flags, g)
    ind = F.upper(F.trim(F.col("debit_credit_indicator")))
    credit = ind.isin("H", "C", "CR", "-", "0")
    return out.withColumn("amount", F.when(F.col("__no_neg") & credit, -F.abs(F.col("amount")))
                          .otherwise(F.col("amount"))).drop("__no_neg")


# ---------------------------------------------------------------------------------------------------------------
# header / detail

def header_dedup(df: DataFrame, key: str = "journal_entry_id", order_col: str = "row_id",
                 group_cols: list[str] | None = None) -> DataFrame:
    """One row per key (and ledger, ``group_cols``), the first in ``order_col`` order; a null key is kept once.

    ``min_by(struct, row_id)`` is a partial aggregate: each partition pre-reduces its rows per key before the shuffle.
    """
    g = [*(group_cols or []), key]
    others = [c for c in df.columns if c not in (*g, order_col)]
    if not others:
        return df.select(*g).distinct()
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("__first")
    return df.groupBy(*g).agg(first).select(*g, *[F.col(f"__first.{c}").alias(c) for c in others])


def header_first_nonnull(df: DataFrame, key: str = "journal_entry_id", order_col: str = "row_id",
                         group_cols: list[str] | None = None) -> DataFrame:
    """Per key (and ledger), the first non-null value of every other column; null keys dropped."""
    g = [*(group_cols or []), key]
    others = [c for c in df.columns if c not in (*g, order_col)]
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in others]
    return df.where(F.col(key).isNotNull()).groupBy(*g).agg(*aggs)


def keyless_header(df: DataFrame, order_col: str = "row_id", group_cols: list[str] | None = None) -> DataFrame:
    """A ledger without journal id yields one sample header row (its first)."""
    g = group_cols or []
    others = [c for c in df.columns if c not in (*g, order_col)]
    first = df.groupBy(*g).agg(F.min_by(F.struct(*map(F.col, others)), F.col(order_col)).alias("__first"))
    return first.where(F.col("__first").isNotNull()).select(*g, *[F.col(f"__first.{c}").alias(c) for c in others])


def sort_by_journal_id(df: DataFrame, key: str = "journal_entry_id", order_col: str | None = "row_id") -> DataFrame:
    """Ascending, nulls last; ties keep input order. A global sort (range-partitioned shuffle); use only for
    the written output, never inside a pipeline."""
    cols = [F.col(key).asc_nulls_last()] + ([F.col(order_col)] if order_col and order_col in df.columns else [])
    return df.orderBy(*cols)


DATE_FIELDS = ["entry_date", "entry_time", "posting_date"]


def ledger_decisions(df: DataFrame, group_cols: list[str] | None = None, order_col: str = "row_id",
                     split_dates: bool = True) -> DataFrame | None:
    """Every data-dependent decision of X04 from the renamed input, one row per ledger (group):
    ``__plain_<f>`` (N09 pass-through), ``__has_ind`` (P18), ``__ind_all_null`` (P04), ``__a_<date>`` /
    ``__d_<date>`` (D04). One aggregation plus one sampled window pass, whatever the number of fields."""
    from cuadre.functions.dates import date_decisions
    g = group_cols or []
    flags: dict[str, Column] = {}
    for f in [f for f in CLEANED_NUMERIC_FIELDS if f in df.columns]:
        t = F.trim(F.col(f).cast("string"))
        nonblank = F.col(f).isNotNull() & (t != "")
        flags[f"__plain_{f}"] = (F.count_if(nonblank) > 0) & (F.count_if(nonblank & ~t.rlike(PLAIN_NUMBER)) == 0)
    if "debit_credit_indicator" in df.columns:
        ind = F.col("debit_credit_indicator")
        flags["__has_ind"] = (F.count(ind) > 0) & F.coalesce(F.max(ind.isNull() | (ind != "")), F.lit(False))
        flags["__ind_all_null"] = F.count(ind) == 0
    out = _group_flags(df, g, **flags) if flags else None
    if split_dates:
        dec = date_decisions(df, DATE_FIELDS, order_col, g)
        if dec is not None:
            out = dec if out is None else (out.join(dec, g, "full") if g else out.crossJoin(dec))
    return out


def canonical_journal(raw: DataFrame, mapping: dict[str, str], group_cols: list[str] | None = None,
                      split_dates: bool = True, order_col: str = "row_id", first_of: str | None = None) -> DataFrame:
    """X04 core: P01 rename -> N09 clean -> P18 scenario -> D06 date split. Returns the full canonical frame
    (header and detail are projections of it).

    Plan shape: the decisions of all steps are computed once from the renamed input (a small per-ledger table,
    broadcast), then a single chain of projections rewrites the rows. No step aggregates over the output of another
    step, so the input is scanned a fixed number of times (rows, flags, date sample) regardless of the field count.

    With ``first_of`` (a key) only the header fields of each key's first row are wanted: the decisions still come from all
    rows, but the first rows are found (J06) before their dates are parsed, not after.
    """
    from cuadre.functions.dates import split_datetime
    g = group_cols or []
    df = rename_by_mapping(raw, mapping)
    dec = ledger_decisions(df, g, order_col, split_dates)
    if first_of and first_of in df.columns:
        head = [c for c in df.columns if c in HEADER_FIELDS or c in DATE_FIELDS]
        df = header_dedup(df.select(*g, *head, order_col), first_of, order_col, g).withColumn(order_col, F.lit(0))
    if dec is not None:
        df = _attach(df, dec, g)
    if numeric_processing_applies(df):
        df = clean_numeric_columns(df, g, flags_attached=True)
        df = apply_amount_scenarios(df, g, flags_attached=True)
    if split_dates:
        df = split_datetime(df, DATE_FIELDS, order_col=order_col, group_cols=g, decisions_attached=True)
    if "__ind_all_null" in df.columns and "amount" in df.columns:
        df = df.withColumn("debit_credit_indicator",
                           F.when(F.coalesce(F.col("__ind_all_null"), F.lit(False)),
                                  N.indicator_from_amount("amount")).otherwise(F.col("debit_credit_indicator")))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def journal_header(canonical: DataFrame, key: str = "journal_entry_id", order_col: str = "row_id",
                   group_cols: list[str] | None = None) -> DataFrame:
    """S13 shape: header columns, deduplicated by journal id (first row wins). Only the columns that are there go
    through the aggregation; the absent ones are added after it."""
    g = group_cols or []
    present = [c for c in HEADER_FIELDS if c in canonical.columns]
    if key in canonical.columns:
        first = header_dedup(canonical.select(*g, *present, order_col), key, order_col, g)
    else:
        first = canonical.select(*g, *present)
    return first.select(*g, *conform_columns(first, HEADER_FIELDS))


def journal_detail(canonical: DataFrame) -> DataFrame:
    """S14 shape: all rows, detail columns (P04 already applied by ``canonical_journal``)."""
    return conform(canonical, DETAIL_FIELDS)
