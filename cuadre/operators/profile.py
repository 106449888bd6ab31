"""Column profiles over a lake of ledgers.

A ledger lake is a set of files with different headers. ``cells`` unpivots each file to
(file_id, column, ordinal, row_order, value); ``first_values`` keeps the first N non-null values per column (the
reference profiles ``dropna().head(N)``). It orders all cells it is given, so ``lake_sample`` gives it only a file's first
rows, which every task finds in a heap of that many rows, and looks up the columns that have fewer values there one by
one. All profiles are then grouped aggregations per (file, column), whose inputs are bounded by N.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuadre.functions.numbers import FLOAT_LITERAL, SPECIAL_FLOAT
from cuadre.operators.distinct import column_counts
from cuadre.session import cut_lineage

SAMPLE_N = 100
#: Rows of a file that are looked at for samples before the whole file is.
FIRST_ROWS = 1000

# fixed values: date-shape regexes of the content analysis, in the reference's order (duplicates included);
# each is tested anchored at the start, as Python's re.match does
DATE_SHARE_PATTERNS = [
    r'^\d{4}-\d{2}-\d{2}$', r'^\d{4}-\d{1,2}-\d{1,2}$', r'^\d{2}/\d{2}/\d{4}$', r'^\d{1,2}/\d{1,2}/\d{4}$',
    r'^\d{4}/\d{2}/\d{2}$', r'^\d{4}/\d{1,2}/\d{1,2}$', r'^\d{2}-\d{2}-\d{4}$', r'^\d{1,2}-\d{1,2}-\d{4}$',
    r'^\d{2}\.\d{2}\.\d{4}$', r'^\d{1,2}\.\d{1,2}\.\d{4}$', r'^\d{4}\.\d{2}\.\d{2}$', r'^\d{4}\.\d{1,2}\.\d{1,2}$',
    r'^\d{8}$', r'^\d{2}/\d{2}/\d{2}$', r'^\d{1,2}/\d{1,2}/\d{2}$', r'^\d{2}-\d{2}-\d{2}$', r'^\d{1,2}-\d{1,2}-\d{2}$',
    r'^\d{2}\.\d{2}\.\d{2}$', r'^\d{1,2}\.\d{1,2}\.\d{2}$', r'^\d{6}$', r'^\d{1,2}/\d{1,2}/\d{4}$',
    r'^\d{2}/\d{2}/\d{4}$', r'^\d{1,2}-\d{1,2}-\d{4}$', r'^\d{2}-\d{2}-\d{4}$',
    r'^\d{1,2}[-\s]?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[-\s]?\d{2,4}$',
    r'^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-\s]?\d{1,2}[-\s]?\d{2,4}$',
    r'^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[-\s]?\d{1,2}[-\s]?\d{2,4}$',
    r'^(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[-\s]?\d{1,2}[-\s]?\d{2,4}$',
    r'^\d{2,4}[-\s]?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-\s]?\d{1,2}$',
    r'^\d{1,2}[-\s]?(January|February|March|April|May|June|July|August|September|October|November|December)'
    r'[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(january|february|march|april|may|june|july|august|september|october|november|december)'
    r'[-\s]?\d{2,4}$',
    r'^(January|February|March|April|May|June|July|August|September|October|November|December)[-\s]?\d{1,2}'
    r'[-\s]?\d{2,4}$',
    r'^(january|february|march|april|may|june|july|august|september|october|november|december)[-\s]?\d{1,2}'
    r'[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(Ene|Feb|Mar|Abr|May|Jun|Jul|Ago|Sep|Oct|Nov|Dic)[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(Enero|Febrero|Marzo|Abril|Mayo|Junio|Julio|Agosto|Septiembre|Octubre|Noviembre|Diciembre)'
    r'[-\s]?\d{2,4}$',
    r'^\d{1,2}[-\s]?(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)'
    r'[-\s]?\d{2,4}$',
    r'^\d{4}-\d{2}-\d{2}\s\d{1,2}:\d{2}$', r'^\d{4}-\d{2}-\d{2}\s\d{1,2}:\d{2}:\d{2}$',
    r'^\d{2}/\d{2}/\d{4}\s\d{1,2}:\d{2}$', r'^\d{2}/\d{2}/\d{4}\s\d{1,2}:\d{2}:\d{2}$',
    r'^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}(:\d{2})?$', r'^\d{2}\.\d{2}\.\d{4}\s\d{1,2}:\d{2}(:\d{2})?$',
    r'^\d{4}/\d{2}/\d{2}\s\d{1,2}:\d{2}(:\d{2})?$', r'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$',
    r'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$', r'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z?$',
    r'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$', r'^\d{1,2}\s\d{1,2}\s\d{2,4}$',
    r'^\d{2,4}\s\d{1,2}\s\d{1,2}$', r'^\d{1,2}_\d{1,2}_\d{2,4}$', r'^\d{2,4}_\d{1,2}_\d{1,2}$',
    r'^\d{1,2}\|\d{1,2}\|\d{2,4}$', r'^\d{2,4}\|\d{1,2}\|\d{1,2}$', r'^\d{4}\d{2}\d{2}$', r'^\d{2}\d{2}\d{4}$',
    r'^\d{2}\d{2}\d{2}$', r'^\d{6}$', r'^\d{4}-\d{3}$', r'^\d{2}/\d{4}$', r'^\d{1,2}/\d{4}$', r'^\d{4}/\d{2}$',
    r'^\d{4}/\d{1,2}$', r'^\d{4}-\d{2}$', r'^\d{4}-\d{1,2}$', r'^\d{10}$', r'^\d{13}$',
    r'^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+$', r'^\d{1,2}\.\d{1,2}\.\d{4}$', r'^\d{2}\.\d{2}\.\d{2}$',
    r'^\d{1,2}/\d{1,2}/\d{4}$', r'^\d{1,2}-\d{1,2}-\d{4}$', r'^\d{1,2}/\d{1,2}/\d{4}$', r'^\d{1,2}-\d{1,2}-\d{4}$',
    r'^\d{1,2}st|nd|rd|th\s\w+\s\d{4}$', r'^\w+\s\d{1,2}st|nd|rd|th,?\s\d{4}$', r'^\w{3}\s\d{1,2},?\s\d{4}$',
    r'^\d{1,2}\s\w{3}\s\d{4}$', r'^\d{4}年\d{1,2}月\d{1,2}日$', r'^\d{4}.\d{1,2}.\d{1,2}$',
]
# one alternation; each branch anchored at the start like re.match (the unanchored alternatives stay anchored)
DATE_SHARE_REGEX = "(?U)^(?:" + "|".join(f"(?:{p})" for p in DATE_SHARE_PATTERNS) + ")"

# fixed values: ordered name patterns of the content analysis (first contained pattern wins)
FIELD_NAME_PATTERNS = [
    ("saldo", "amount", 0.95), ("balance", "amount", 0.95), ("importe", "amount", 0.9), ("total", "amount", 0.85),
    ("debe", "debit_amount", 0.95), ("haber", "credit_amount", 0.95), ("debit", "debit_amount", 0.95),
    ("credit", "credit_amount", 0.95), ("fecha", "posting_date", 0.9), ("date", "posting_date", 0.9),
    ("asiento", "journal_entry_id", 0.9), ("journal", "journal_entry_id", 0.9),
    ("cuenta", "gl_account_number", 0.9), ("account", "gl_account_number", 0.9), ("año", "fiscal_year", 0.9),
    ("year", "fiscal_year", 0.9), ("doc", "document_number", 0.8), ("documento", "document_number", 0.8),
    ("numero", "document_number", 0.7), ("num", "document_number", 0.7), ("periodo", "period_number", 0.9),
    ("period", "period_number", 0.9), ("preparado", "prepared_by", 0.8), ("prepared", "prepared_by", 0.8),
    ("entrada", "entry_date", 0.8), ("entry", "entry_date", 0.8), ("proveedor", "vendor_id", 0.7),
    ("vendor", "vendor_id", 0.7), ("supplier", "vendor_id", 0.7),
]
# fixed values: words of vendor and account names
VENDOR_NAME_WORDS = ["proveedor", "vendor", "supplier", "fornecedor", "fournisseur", "fornitore", "lieferant"]
VENDOR_ID_WORDS = ["id", "codigo", "code", "num"]
ACCOUNT_NAME_WORDS = ["nombre", "name", "denominacion", "description", "desc", "titel", "titre", "titolo"]
ACCOUNT_WORDS = ["cuenta", "account", "conto", "compte", "konto"]
ACCOUNT_NUMBER_WORDS = ["num", "number", "codigo", "code"]


def cells(df: DataFrame, file_id: str, order: Column, columns: list[str] | None = None,
          major: Column | None = None) -> DataFrame:
    """One file -> (file_id, column, ordinal, row_major, row_order, value) with every value as text.

    ``major`` is the leading primitive component of the row order (e.g. the first field of a struct key); sorting
    on (row_major, row_order) gives the same order, but lets Spark's sorter compare 8-byte prefixes and fall back to
    the full key only on ties."""
    cols = columns or [c for c in df.columns]
    return unpivoted(text_rows(df, order, cols, major), file_id, cols, cols)


def text_rows(df: DataFrame, order: Column, columns: list[str], major: Column | None = None) -> DataFrame:
    """(row_major, row_order, every column as text) of one file."""
    major = order if major is None else major
    return df.select(major.alias("row_major"), order.alias("row_order"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def unpivoted(wide: DataFrame, file_id: str, columns: list[str], header: list[str]) -> DataFrame:
    """Cells of some columns of ``text_rows``; ``header`` gives their ordinals."""
    long = wide.unpivot(ids=["row_major", "row_order"], values=[F.col(f"`{c}`") for c in columns], variableColumnName="column",
                        valueColumnName="value")
    ordinal = F.array_position(F.array(*[F.lit(c) for c in header]), F.col("column")).cast("int")
    return long.select(F.lit(file_id).alias("file_id"), "column", ordinal.alias("ordinal"), "row_major",
                       "row_order", "value")


def first_values(cell_df: DataFrame, n: int = SAMPLE_N) -> DataFrame:
    """First ``n`` non-null values per (file_id, column) in row order, numbered ``rn`` from 1."""
    order = ["row_major", "row_order"] if "row_major" in cell_df.columns else ["row_order"]
    w = Window.partitionBy("file_id", "column").orderBy(*order)
    return (cell_df.where(F.col("value").isNotNull())
                   .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
                   .drop("row_order", "row_major"))


def first_of_file(df: DataFrame, file_id: str, order: Column, columns: list[str] | None = None, major: Column | None = None,
                  n: int = SAMPLE_N, first_rows: int = FIRST_ROWS) -> DataFrame:
    """``first_values`` of one file without ordering it: every task keeps its ``first_rows`` first rows (a limit on a sort),
    only those of all tasks are unpivoted. A column with fewer than ``n`` values there is looked up in the whole file, again by a
    limit on a sort, over the rows that have a value."""
    cols = columns or [c for c in df.columns]
    take = max(n, first_rows)
    wide = text_rows(df, order, cols, major)
    first = lambda rows, k: rows.orderBy("row_major", "row_order").limit(k)
    early = cut_lineage(first(wide, take))
    seen, *had = early.agg(F.count(F.lit(1)).alias("seen"), *[F.count(F.col(f"`{c}`")).alias(f"had_{i}") for i, c in enumerate(cols)]).first()
    short = [c for c, k in zip(cols, had) if seen >= take and k < n]  # a shorter file was seen whole
    parts = [unpivoted(early, file_id, [c for c in cols if c not in short], cols)] if len(short) < len(cols) else []
    parts += [unpivoted(first(wide.select("row_major", "row_order", f"`{c}`").where(F.col(f"`{c}`").isNotNull()), n), file_id, [c], cols) for c in short]
    return first_values(reduce(lambda a, b: a.unionByName(b), parts), n)


def lake_sample(files: list[tuple], n: int = SAMPLE_N) -> DataFrame:
    """Samples of several files (each with its own row order), unioned: (file_id, column, ordinal, value, rn).
    ``files`` holds (file_id, df, order column[, data columns[, leading order component]])."""
    parts = [first_of_file(f[1], f[0], f[2], f[3] if len(f) > 3 else None, f[4] if len(f) > 4 else None, n) for f in files]
    return reduce(lambda a, b: a.unionByName(b), parts)


def py_float(v: Column) -> Column:
    from cuadre.functions.text import py_strip
    t = py_strip(v)
    return F.when(t.rlike(FLOAT_LITERAL) | t.rlike(SPECIAL_FLOAT), t.try_cast("double"))


def column_profile(sample: DataFrame, files: list[tuple] | None = None) -> DataFrame:
    """Per column: inferred type (A19) and 5 sample values, and with ``files`` (as in ``lake_sample``) rows,
    null % and distinct values of the whole column."""
    g = ["file_id", "column", "ordinal"]
    prof = sample.groupBy(*g).agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_distinct("value").alias("distinct_in_sample"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "value")))).alias("__s5"),
        infer_type_agg().alias("inferred_type"))
    prof = prof.withColumn("samples", F.transform("__s5", lambda s: s["value"])).drop("__s5")
    if files is None:
        return prof
    return whole_column_counts(files).join(prof, g, "left").fillna({"inferred_type": "unknown", "sampled": 0, "distinct_in_sample": 0})


def whole_column_counts(files: list[tuple]) -> DataFrame:
    """Rows, non-null values, exact distinct values and null % of every column of the lake's ``files``
    (as in ``lake_sample``), columns without a value included."""
    out = column_counts([(f[0], f[1], f[3] if len(f) > 3 else f[1].columns) for f in files])
    return out.withColumn("null_pct", F.round((F.col("rows") - F.col("nonnull")) * 100.0 / F.greatest(F.col("rows"), F.lit(1)), 2))


def infer_type_agg() -> Column:
    """A19 over the first 10 sampled values: > 60 % date-like -> date, > 60 % numeric -> numeric, else text."""
    from cuadre.functions.dates import is_date_like
    from cuadre.functions.numbers import is_numeric
    first10 = F.col("rn") <= 10
    n = F.count_if(first10)
    d = F.count_if(first10 & is_date_like(F.col("value")))
    num = F.count_if(first10 & is_numeric(F.col("value")))
    return (F.when(n == 0, F.lit("unknown")).when(d / n > 0.6, F.lit("date")).when(num / n > 0.6, F.lit("numeric"))
             .otherwise(F.lit("text")))


def numeric_profile(sample: DataFrame) -> DataFrame:
    """A11 + W09: numeric statistics of each sampled column and the field hint of the decision chain.

    ratio < 0.7 -> none; |mean| > 1 and std > 1 -> zeros > 30 % ? (pos > neg ? debit_amount 0.8 : credit_amount 0.7)
    : amount 0.9; max <= 1000 and std < 10 -> unique < 20 % ? document_number 0.7; all in 1900..2100 -> <= 5
    distinct ? fiscal_year 0.9; 1 <= min and max <= 100 -> consecutive steps among the 20 smallest > 30 % of n ?
    line_number 0.8; distinct < 70 % -> journal_entry_id 0.7; 1 <= min and max <= 999999 -> unique > 80 % ?
    vendor_id 0.6. ``std`` is the sample standard deviation (null for one value, so its tests are false)."""
    g = ["file_id", "column", "ordinal"]
    x = sample.withColumn("x", py_float(F.col("value")))
    nums = x.where(F.col("x").isNotNull())
    w = Window.partitionBy(*g).orderBy("x")
    steps = (nums.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 20)
                 .withColumn("__prev", F.lag("x").over(w))
                 .groupBy(*g).agg(F.count_if(F.col("x") == F.col("__prev") + 1).alias("consecutive")))
    stats = x.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_numeric"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") > 0).alias("positives"),
        F.count_if(F.col("x") < 0).alias("negatives"), F.min("x").alias("min_value"), F.max("x").alias("max_value"),
        F.avg("x").alias("mean_value"), F.stddev_samp("x").alias("std_value"),
        F.count_distinct("x").alias("n_unique"),
        F.coalesce(F.bool_and(F.col("x").between(1900, 2100)), F.lit(False)).alias("all_years"))
    s = stats.join(steps, g, "left").fillna({"consecutive": 0})
    nn = F.col("n_numeric")
    ratio = nn / F.col("n")
    uniq = F.col("n_unique") / nn
    money = (F.abs(F.col("mean_value")) > 1) & (F.col("std_value") > 1)
    small = (F.col("max_value") <= 1000) & (F.col("std_value") < 10)
    years = F.col("all_years")
    lines = (F.col("max_value") <= 100) & (F.col("min_value") >= 1)
    repeats = F.col("n_unique") < nn * 0.7
    ids = (F.col("max_value") <= 999999) & (F.col("min_value") >= 1)
    field = (F.when((nn == 0) | (ratio < 0.7), F.lit(None))
              .when(money, F.when(F.col("zeros") / nn > 0.3,
                                  F.when(F.col("positives") > F.col("negatives"), F.lit("debit_amount"))
                                   .otherwise(F.lit("credit_amount"))).otherwise(F.lit("amount")))
              .when(small, F.when(uniq < 0.2, F.lit("document_number")))
              .when(years, F.when(F.col("n_unique") <= 5, F.lit("fiscal_year")))
              .when(lines, F.when(F.col("consecutive") > nn * 0.3, F.lit("line_number")))
              .when(repeats, F.lit("journal_entry_id"))
              .when(ids, F.when(uniq > 0.8, F.lit("vendor_id"))))
    conf = (F.when(field == "debit_amount", 0.8).when(field == "credit_amount", 0.7).when(field == "amount", 0.9)
             .when(field == "document_number", 0.7).when(field == "fiscal_year", 0.9)
             .when(field == "line_number", 0.8).when(field == "journal_entry_id", 0.7)
             .when(field == "vendor_id", 0.6))
    return s.withColumn("hint_field", field).withColumn("hint_confidence", conf)


def text_profile(sample: DataFrame) -> DataFrame:
    """Numeric-like share of the first 10, unique ratio, mean length and the description hints."""
    g = ["file_id", "column", "ordinal"]
    first10 = F.col("rn") <= 10
    s = sample.groupBy(*g).agg(
        F.count_if(first10).alias("n10"), F.count_if(first10 & py_float(F.col("value")).isNotNull()).alias("num10"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_unique"),
        F.avg(F.length("value")).alias("avg_length"))
    low = F.lower(F.col("column"))
    uniq = F.col("n_unique") / F.col("n")
    numeric_like = F.col("num10") > F.col("n10") * 0.8
    field = (F.when(numeric_like, F.lit(None))
              .when(low.contains("descripcion") | low.contains("description"),
                    F.when(uniq > 0.7, F.lit("line_description")).otherwise(F.lit("description")))
              .when(low.contains("concepto") | low.contains("concept"), F.lit("description"))
              .when((F.col("avg_length") > 10) & (uniq > 0.5), F.lit("line_description"))
              .when((F.col("avg_length") > 5) & (uniq < 0.3), F.lit("description")))
    conf = (F.when(low.contains("descripcion") | low.contains("description"),
                   F.when(uniq > 0.7, F.lit(0.8)).otherwise(F.lit(0.7)))
             .when(low.contains("concepto") | low.contains("concept"), F.lit(0.8))
             .when(field == "line_description", F.lit(0.6)).when(field == "description", F.lit(0.5)))
    return s.withColumn("unique_ratio", uniq).withColumn("hint_field", field) \
            .withColumn("hint_confidence", F.when(field.isNotNull(), conf))


def date_share(sample: DataFrame) -> DataFrame:
    """Share of the first 20 sampled values matching a date shape (or parsing as a date with a 1900-2100 year
    and not being a short bare number); >= 0.8 / 0.6 / 0.4 give posting_date 0.9 / 0.7 / 0.5 and entry_date
    0.85 / 0.65 / 0.45."""
    from cuadre.functions.dates import parse_date_text
    g = ["file_id", "column", "ordinal"]
    first20 = F.col("rn") <= 20
    v = F.regexp_replace(F.col("value"), r"(?U)^\s+|\s+$", "")
    parsed = parse_date_text(v, True, with_time=True)
    bare = F.regexp_replace(v, r"[./-]", "").rlike(r"^[0-9]+$") & (F.length(v) <= 6)
    hit = v.rlike(DATE_SHARE_REGEX) | (parsed.isNotNull() & F.year(parsed).between(1900, 2100) & ~bare)
    s = sample.groupBy(*g).agg(F.count_if(first20).alias("checked"), F.count_if(first20 & hit).alias("date_like"))
    r = F.col("date_like") / F.col("checked")
    return s.select(*g, "checked", "date_like", r.alias("date_ratio"),
                    F.when(r >= 0.8, 0.9).when(r >= 0.6, 0.7).when(r >= 0.4, 0.5).alias("posting_date_conf"),
                    F.when(r >= 0.8, 0.85).when(r >= 0.6, 0.65).when(r >= 0.4, 0.45).alias("entry_date_conf"))


def _any_in(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def name_pattern_hint(name: Column) -> tuple[Column, Column]:
    """The first of the ordered name patterns contained in lower(name) gives (field, confidence)."""
    low = F.lower(name)
    field, conf = None, None
    for pat, fld, c in FIELD_NAME_PATTERNS:
        field = F.when(low.contains(pat), F.lit(fld)) if field is None else field.when(low.contains(pat), F.lit(fld))
        conf = F.when(low.contains(pat), F.lit(c)) if conf is None else conf.when(low.contains(pat), F.lit(c))
    return field, conf


def vendor_hint(name: Column, avg_length: Column, unique_ratio: Column) -> Column:
    """Confidence for vendor_id (null when none)."""
    low = F.lower(name)
    return F.when(_any_in(low, VENDOR_NAME_WORDS),
                  F.when(_any_in(low, VENDOR_ID_WORDS), F.lit(0.9))
                   .when((avg_length <= 15) & (unique_ratio > 0.8), F.lit(0.7)))


def account_name_hint(name: Column, avg_length: Column) -> Column:
    """Confidence for gl_account_name (null when none)."""
    low = F.lower(name)
    has_name, has_acc = _any_in(low, ACCOUNT_NAME_WORDS), _any_in(low, ACCOUNT_WORDS)
    return (F.when(has_name & has_acc, F.lit(0.9))
             .when(has_name & (low.contains("gl") | low.contains("mayor")), F.lit(0.8))
             .when(has_acc & ~_any_in(low, ACCOUNT_NUMBER_WORDS), F.when(avg_length > 10, F.lit(0.7))))


def validator_scores(sample: DataFrame, threshold: float = 0.35, field_types: list[str] | None = None) -> DataFrame:
    """Score every registered validator on every sampled column in one grouped pass; keep scores above
    ``threshold``. Returns (file_id, column, field_type, score)."""
    from cuadre.functions import validators as V
    fts = field_types or [f for f in V.VALIDATORS if f != "amount_credit"]
    aggs = [V.column_score(f, F.col("value")).alias(f) for f in fts]
    wide = sample.groupBy("file_id", "column").agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}`" for f in fts)
    long = wide.selectExpr("file_id", "`column`", f"stack({len(fts)}, {stack}) AS (field_type, score)")
    return long.where(F.col("score") > threshold)


def learned_pattern_scores(sample: DataFrame, patterns: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Share of a column's sampled values matching any learned regex of a field; keep > ``threshold``.

    ``patterns`` (field_type, regex) is the learned-pattern table. Its regexes become one alternation per field by
    aggregation, and the fields' alternations one row, which every sampled value meets: the pattern is data, a column
    of the join, and nothing is read by the driver. The row has one entry for each field of the catalogue."""
    per = patterns.where("regex is not null").groupBy("field_type").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("(?:"), "regex", F.lit(")")))), "|").alias("regex"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("field_type", "regex"))).alias("learned"))
    met = sample.select("file_id", "column", "value").crossJoin(F.broadcast(one))  # a one-row aggregate
    met = met.select("file_id", "column", "value", F.explode("learned").alias("l"))
    hit = F.regexp_like(F.col("value"), F.col("l.regex")).cast("double")
    return met.groupBy("file_id", "column", F.col("l.field_type").alias("field_type")).agg(F.avg(hit).alias("score")).where(F.col("score") > threshold)
