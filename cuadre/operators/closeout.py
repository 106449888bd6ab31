"""Close-out of a lake of ledgers (X05) and raw files to journals (X12), as one DataFrame chain for any number of ledgers.

Two forms. On wide rows (``close_lake``): a record keeps its cells in one array, the mapping is a small table of
field -> place per file, and every canonical field is read from the array in place. Nothing is unpivoted, shuffled by row
or pivoted; the ledgers' decisions (N09, P18, P04, D04) are one aggregation, attached once. On cells
(``journal_from_cells``): cells + mapping table -> pivot, for sources that come as cells.

The mapping is data (X01's output), not a literal: cells meet their field on (file_id, column) and are pivoted to one
row per (file_id, row_key) over the fixed list of canonical fields, so the plan does not grow with the number of
files or of different headers. Money is decimal(18,2) from here on, so sums do not depend on the order of shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataclasses import dataclass
from functools import reduce

from cuadre.functions import dates as D
from cuadre.functions import numbers as N
from cuadre.operators import balance as B
from cuadre.operators import journal as J
from cuadre.operators import mapping as M
from cuadre.operators import profile as P
from cuadre.session import cut_lineage, stage
from cuadre.sources.lake import Lake, first_cells

MONEY = "decimal(18,2)"
AMOUNTS = ["amount", "debit_amount", "credit_amount"]
#: Rows of a block, counted as one when a ledger's first values are looked for.
BLOCK_ROWS = 4096


def journal_from_cells(cells: DataFrame, mappings: DataFrame, kind: str = "clean_amount_fixed") -> DataFrame:
    """(file_id, row_key, one text column per canonical field, amounts as decimals) of every mapped ledger.

    ``amount`` is the mapped amount, else debit - credit where a row has one of them; the indicator, where it is not
    mapped, follows the amount's sign."""
    used = cells.join(mappings.select("file_id", "column", "field_type"), ["file_id", "column"])
    return with_money(used.groupBy("file_id", "row_key").pivot("field_type", M.STANDARD_FIELDS).agg(F.first("value")), kind)


def journal_from_rows(lake: Lake, mappings: DataFrame, kind: str = "clean_amount_fixed") -> DataFrame:
    """``journal_from_cells`` on wide rows: every field is read from the row's array in place, no row is shuffled."""
    rows = lake.rows.join(F.broadcast(places(lake.headers, mappings)), "file")
    return with_money(rows.select("file_id", F.col("row_order").alias("row_key"), *[F.get("cells", F.col("at")[f]).alias(f) for f in M.STANDARD_FIELDS]), kind)


def with_money(wide: DataFrame, kind: str) -> DataFrame:
    """Rows of canonical fields as text, with their amounts as decimals and an indicator."""
    clean = N.with_cleaned(wide, {f"__{f}": f for f in AMOUNTS}, kind)
    wide = clean.withColumns({f: F.when(F.col(f).isNotNull(), F.col(f"__{f}").cast(MONEY)) for f in AMOUNTS}).drop(*[f"__{f}" for f in AMOUNTS])
    zero = F.lit(0).cast(MONEY)
    pair = F.when(F.col("debit_amount").isNotNull() | F.col("credit_amount").isNotNull(),
                  (F.coalesce("debit_amount", zero) - F.coalesce("credit_amount", zero)).cast(MONEY))
    return wide.withColumn("amount", F.coalesce("amount", pair)).withColumn(
        "debit_credit_indicator", F.coalesce("debit_credit_indicator", N.indicator_from_amount("amount")))


def close_out(cells: DataFrame, mappings: DataFrame, tol: float = B.DEFAULT_TOLERANCE) -> DataFrame:
    """Per ledger with a mapped amount: rows, balance report (A06-A08) and the share of rows with an amount."""
    return _reported(journal_from_cells(cells, mappings), mappings, tol)


def close_out_rows(lake: Lake, mappings: DataFrame, tol: float = B.DEFAULT_TOLERANCE) -> DataFrame:
    """``close_out`` on wide rows: the entries' sums are the only shuffle."""
    return _reported(journal_from_rows(lake, mappings), mappings, tol)


def _reported(journal: DataFrame, mappings: DataFrame, tol: float) -> DataFrame:
    able = M.trusted_amounts(mappings).select("file_id").distinct()
    journal = journal.join(F.broadcast(able), "file_id", "left_semi")  # one row per ledger
    per = journal.groupBy("file_id", "journal_entry_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count(F.lit(1)).alias("rows"), F.count("amount").alias("with_amount"))
    per = stage(per, "entries")  # read twice, the rows once
    stats = per.groupBy("file_id").agg(F.sum("rows").alias("rows"), F.sum("with_amount").alias("rows_with_amount"))
    return B.balance_report(per, tol=tol, group_cols=["file_id"]).join(stats, "file_id")


def harmonise(cells: DataFrame, columns: DataFrame, sample: DataFrame, synonyms: DataFrame, fields: DataFrame) -> DataFrame:
    """X01 on a lake of cells with the balance trial."""
    return M.map_columns(sample, synonyms, fields, columns=columns, cells=cells)


def raw_lake_to_journal(raw: DataFrame, synonyms: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells as ``read_ledger_lake`` gives them -> (mappings, journal). Header, sample, mapping and journal are
    all taken from the one cells table."""
    cells = raw.withColumn("row_key", F.to_json(F.struct("row_order")))
    columns = raw.select("file_id", "column", "ordinal").distinct()
    sample = P.first_values(raw)
    mappings = harmonise(cells.select("file_id", "column", "ordinal", "row_key", "value"), columns, sample, synonyms, fields)
    return mappings, journal_from_cells(cells, mappings)


def decision_report(mappings: DataFrame) -> DataFrame:
    """Decisions per ledger and kind: (file_id, section, item, columns, mean_confidence)."""
    dates, amounts = F.col("field_type").isin("posting_date", "entry_date", "entry_time"), F.col("field_type").isin(*AMOUNTS)
    section = F.when(amounts, F.lit("numeric")).when(dates, F.lit("date")).otherwise(F.lit("other"))
    rows = mappings.select("file_id", "confidence", F.explode(F.array(
        F.struct(section.alias("section"), F.col("field_type").alias("item")),
        F.struct(F.lit("resolution").alias("section"), F.col("resolution_type").alias("item")))).alias("s"))
    return rows.groupBy("file_id", "s.section", "s.item").agg(F.count(F.lit(1)).alias("columns"), F.avg("confidence").alias("mean_confidence"))


# ---------------------------------------------------------------------------------------------------------------
# wide rows

@dataclass
class CloseOut:
    """What X05 leaves: ``mappings`` (file_id, column, field_type, confidence, resolution_type), ``journal`` (every
    record in canonical fields), ``header`` (S13, one row per ledger and journal id), ``detail`` (S14) and ``balance``
    (one row per ledger)."""

    mappings: DataFrame
    journal: DataFrame
    header: DataFrame
    detail: DataFrame
    balance: DataFrame


def places(headers: DataFrame, mappings: DataFrame) -> DataFrame:
    """(file, at): the place of every mapped field in the records of each file, a map of at most the number of fields."""
    named = headers.where("kind = 'table'").select("file", "file_id", F.posexplode("names").alias("i", "column"))
    met = named.join(mappings.select("file_id", "column", "field_type"), ["file_id", "column"])
    return met.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field_type", "i"))).alias("at"))


def trial_on_rows(lake: Lake, best: DataFrame, amounts: DataFrame, tol: float = 0.01, kind: str = "clean_amount_fixed") -> DataFrame:
    """J08 on wide rows: (file_id, column, quality) of the journal-id candidates of every ledger that has more than one
    and a trusted amount. A record's amount and its candidate ids are read from the one array, so the candidates' sums
    are the only shuffle; a hot id is summed before it."""
    several = M.id_conflicts(best).join(amounts.select("file_id").distinct(), "file_id", "left_semi")
    named = lake.headers.where("kind = 'table'").join(several, "file_id", "left_semi").select("file", "file_id", F.posexplode("names").alias("i", "column"))
    ids = named.join(best.where("field_type = 'journal_entry_id'").select("file_id", "column"), ["file_id", "column"])
    ids = ids.groupBy("file").agg(F.collect_list(F.struct("column", "i")).alias("ids"))  # columns of one file
    found = cut_lineage(places(lake.headers, amounts).join(ids, "file"))  # one row per file
    rows = lake.rows_of(found.select("file")).join(F.broadcast(found), "file")
    money = {f: F.get("cells", F.col("at")[f]) for f in AMOUNTS}
    rows = rows.select("file_id", "cells", "ids", *[v.alias(f) for f, v in money.items()])
    rows = N.with_cleaned(rows, {f"__{f}": f for f in AMOUNTS}, kind)
    a, d, c = (F.when(F.col(f).isNotNull(), F.col(f"__{f}").cast(MONEY)) for f in AMOUNTS)
    zero = F.lit(0).cast(MONEY)
    amount = F.coalesce(a, F.when(d.isNotNull() | c.isNotNull(), F.coalesce(d, zero) - F.coalesce(c, zero)))
    tried = rows.select("file_id", amount.alias("amount"), F.explode(F.transform("ids", lambda x: F.struct(x["column"].alias("column"), F.get("cells", x["i"]).alias("value")))).alias("x"))
    sums = tried.where("x.value is not null").groupBy("file_id", F.col("x.column").alias("column"), "x.value").agg(F.coalesce(F.sum("amount"), zero).alias("s"))
    share = F.count_if(F.abs("s") < tol).cast("double") / F.count(F.lit(1)).cast("double")
    return sums.groupBy("file_id", "column").agg(share.alias("quality"))


def map_lake(lake: Lake, synonyms: DataFrame, fields: DataFrame, threshold: float = M.CONFIDENCE_THRESHOLD) -> DataFrame:
    """X01 on a lake of wide rows, journal-id conflicts decided by balance."""
    return M.map_columns(first_cells(lake), synonyms, fields, threshold, columns=lake.columns(),
                         trial=lambda best, amounts: trial_on_rows(lake, best, amounts))


def canonical_rows(lake: Lake, mappings: DataFrame) -> DataFrame:
    """(file_id, row_id, the standard fields as text, ``has_<amount field>``) of every record of the mapped ledgers."""
    found = cut_lineage(places(lake.headers, mappings))  # one row per file
    rows = lake.rows_of(found.select("file")).join(F.broadcast(found), "file")
    fields = [F.get("cells", F.col("at")[f]).alias(f) for f in M.STANDARD_FIELDS]
    has = [F.map_contains_key("at", F.lit(f)).alias(f"has_{f}") for f in AMOUNTS]
    return rows.select("file_id", F.col("row_order").alias("row_id"), *fields, *has)


def first_dated(rows: DataFrame, n: int = 10) -> DataFrame:
    """The rows of the blocks that hold the first ``n`` values of every date field of a ledger, so that only they are ordered.
    A block's rows follow each other in their file; the table of blocks is ``BLOCK_ROWS`` times smaller than the rows."""
    of = {"__file": F.col("row_id.file"), "__split": F.col("row_id.block"), "__block": F.floor(F.col("row_id.pos") / BLOCK_ROWS)}
    rows = rows.withColumns(of)
    sizes = rows.groupBy("file_id", *of).agg(*[F.count(f).alias(f) for f in J.DATE_FIELDS])
    before = Window.partitionBy("file_id").orderBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    seen = sizes.withColumns({f"__n_{f}": F.coalesce(F.sum(f).over(before), F.lit(0)) for f in J.DATE_FIELDS})
    near = seen.where(reduce(lambda a, b: a | b, [(F.col(f) > 0) & (F.col(f"__n_{f}") < n) for f in J.DATE_FIELDS]))
    return rows.join(F.broadcast(near.select("file_id", *of)), ["file_id", *of], "left_semi").drop(*of)


def ledger_choices(rows: DataFrame) -> DataFrame:
    """One row per ledger: which money columns are plain numbers (N09), whether the indicator holds data (P18, P04), and
    the date columns' formats (D04)."""
    plain = {}
    for f in AMOUNTS:
        t = F.trim(F.col(f))
        filled = F.col(f).isNotNull() & (t != "")
        plain[f] = ((F.count_if(filled) > 0) & (F.count_if(filled & ~t.rlike(J.PLAIN_NUMBER)) == 0)).alias(f"__plain_{f}")
    ind = F.col("debit_credit_indicator")
    flags = [((F.count(ind) > 0) & F.coalesce(F.max(ind.isNull() | (ind != "")), F.lit(False))).alias("__has_ind"), (F.count(ind) == 0).alias("__no_ind")]
    found = rows.groupBy("file_id").agg(*plain.values(), *flags)
    return found.join(D.date_decisions(rows, J.DATE_FIELDS, "row_id", ["file_id"], first=first_dated(rows)), "file_id", "left")


def lake_journal(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """X04 for many ledgers at once: money cleaned (N09) as decimals, the ledger's amount scenario (P18), an indicator
    for ledgers without one (P04), dates and times apart (D06)."""
    df = rows.join(F.broadcast(choices), "file_id")  # one row per ledger
    df = N.with_cleaned(df, {f"__{f}": f for f in AMOUNTS}, "clean_amount_fixed")
    money = {f: F.when(F.col(f"has_{f}"), F.when(F.col(f"__plain_{f}"), F.coalesce(F.trim(f).try_cast(MONEY), F.lit(0).cast(MONEY)))
                       .otherwise(F.coalesce(F.col(f"__{f}"), F.lit(0.0)).cast(MONEY))) for f in AMOUNTS}
    df = df.withColumns(money)
    has, debit, credit = (F.col(f"has_{f}") for f in AMOUNTS)
    ind = F.coalesce("__has_ind", F.lit(False))
    df = df.withColumn("amount_scenario", F.when(~has & debit & credit, 1).when(has & ~ind & ~debit & ~credit, 2).when(has & ind, 3)
                       .when(has & debit & credit & ~ind, 4).otherwise(0))
    kind = F.col("amount_scenario")
    df = df.withColumn("amount", F.when(kind == 1, N.debit_credit_to_amount("debit_amount", "credit_amount").cast(MONEY)).otherwise(F.col("amount")))
    df = df.withColumn("debit_credit_indicator", F.when(kind.isin(1, 4), N.indicator_from_debit_credit("debit_amount", "credit_amount"))
                       .when((kind == 2) | (F.col("__no_ind") & F.col("amount").isNotNull()), N.indicator_from_amount("amount"))
                       .otherwise(F.col("debit_credit_indicator")))
    df = D.split_datetime(df, J.DATE_FIELDS, order_col="row_id", group_cols=["file_id"], decisions_attached=True)
    return df.drop(*[c for c in df.columns if c.startswith(("__", "has_"))])


def close_lake(lake: Lake, mappings: DataFrame, tol: float = B.DEFAULT_TOLERANCE) -> CloseOut:
    """Mapped lake -> journal, header, detail and balance per ledger. The ledgers' lines are read, decoded and cut once,
    the amounts and dates cleaned once: the canonical rows, and the journal made of them, are staged tables."""
    rows = stage(canonical_rows(lake, mappings), "canonical")
    journal = stage(lake_journal(rows, cut_lineage(ledger_choices(rows))), "journal")
    header = J.journal_header(journal, group_cols=["file_id"])
    detail = journal.select("file_id", "row_id", *J.conform_columns(journal, J.DETAIL_FIELDS))
    # no filter on a cleaned column: it would be pushed through the cleaning's steps, each written out in the next
    per = journal.groupBy("file_id", "journal_entry_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count("amount").alias("rows"),
                                                             F.max("amount_scenario").alias("scenario")).where("rows > 0")
    per = stage(per, "entries")  # read twice, the journal once
    stats = per.groupBy("file_id").agg(F.sum("rows").alias("rows"), F.max("scenario").alias("amount_scenario"))
    balance = B.balance_report(per, tol=tol, group_cols=["file_id"]).join(stats, "file_id")
    return CloseOut(mappings, journal, header, detail, balance)


def raw_files_to_close_out(spark, paths, synonyms: DataFrame, fields: DataFrame, label_lines, by: str = "file", tol: float = B.DEFAULT_TOLERANCE) -> CloseOut:
    """Raw files -> S06 dispatch by format -> (reports: X09 -> X10 -> cells) -> X01 -> X05, in one plan for all of them.

    ``label_lines`` is X09: a function of the report lines (file_id, file, line_no, text, prev_text, next_text, n_lines)
    that returns (file_id, file, line_no, text, predicted_label). Tables and reports meet as one lake of records, so the
    mapping and the close-out don't know where a ledger came from."""
    from cuadre.operators import reports as R
    from cuadre.sources.lake import read_lake
    lake = read_lake(spark, paths, by)
    if not lake.headers.where("kind = 'text'").isEmpty():
        lake = lake.union(R.report_lake(stage(label_lines(R.report_lines(lake)), "labelled"), "predicted_label"))
    mappings = cut_lineage(map_lake(lake, synonyms, fields))
    return close_lake(lake, mappings, tol)
