"""Date and time text handling (D01-D12) as native Column expressions.

Parsing uses explicit formats with ``try_to_timestamp`` (never a lenient guesser), and the day-first / month-first
reading is decided once per column (see ``date_decisions``), so one column never mixes both readings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadre.functions import staging as S

# fixed values: pattern lists that must equal the reference's
PURE_DATE_PATTERNS = [  # D01
    r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{4}\.\d{2}\.\d{2}$",
    r"^\d{8}$",
]
PURE_TIME_PATTERNS = [  # D02
    r"^\d{1,2}:\d{2}:\d{2}$",
    r"^\d{1,2}:\d{2}$",
    r"^\d{1,2}:\d{2}:\d{2}\.\d+$",
]
COMBINED_PATTERNS = [  # D03 (searched anywhere in the value)
    r"\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}",
    r"\d{1,2}-\d{1,2}-\d{4}\s+\d{1,2}:\d{2}",
    r"\d{1,2}\.\d{1,2}\.\d{4}\s+\d{1,2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
]
DATE_LIKE_3 = [  # D09, detector variant
    r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}$",
    r"^\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}$",
    r"^\d{1,2}-[a-zA-Z]{3}-\d{2,4}$",
]
DATE_LIKE_5 = DATE_LIKE_3 + [  # D09, validator variant
    r"^\d{2,4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}$",
    r"^\d{8}$",
]


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _any(v: Column, patterns: list[str]) -> Column:
    return v.rlike("|".join(f"(?:{p})" for p in patterns))


def _strip(v: Column) -> Column:
    from cuadre.functions.text import py_strip
    return py_strip(v)


def is_pure_date(v) -> Column:
    """D01."""
    return _any(_strip(_c(v)), PURE_DATE_PATTERNS)


def is_pure_time(v) -> Column:
    """D02."""
    return _any(_strip(_c(v)), PURE_TIME_PATTERNS)


def has_date_and_time(v) -> Column:
    """D03."""
    return _any(_strip(_c(v)), COMBINED_PATTERNS)


def is_date_like(v, variant: int = 3) -> Column:
    """3-pattern (detector) or 5-pattern (validator) variant."""
    return _any(_strip(_c(v)), DATE_LIKE_3 if variant == 3 else DATE_LIKE_5)


# ---------------------------------------------------------------------------------------------------------------
# parsing with explicit formats

_TIME_TAIL = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?$"
_YMD_RE = r"^(\d{4})([./-])(\d{1,2})\2(\d{1,2})" + _TIME_TAIL
_COMPACT_RE = r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?$"
_DMY_RE = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})" + _TIME_TAIL
_MON_RE = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})$"
# fixed values: English month abbreviations in calendar order
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _norm_ts(y: Column, m: Column, d: Column, hh: Column, mi: Column, ss: Column) -> Column:
    txt = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", y, m, d, F.coalesce(hh, F.lit(0)),
                          F.coalesce(mi, F.lit(0)), F.coalesce(ss, F.lit(0)))
    return F.try_to_timestamp(txt, F.lit("yyyy-MM-dd HH:mm:ss"))


def _grp(s: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).try_cast("int")


_PARSE_FMT = "y-M-d[ H:m[:s]]"


def _parse_formula(with_time: bool) -> S.Formula:
    """Stages of ``parse_date_text``: strip; classify the shape; rewrite the text with one back-reference
    replacement to 'y-M-d H:m:s' (day-first and month-first readings for d/M/y shapes, 2-digit years -> 20yy);
    parse once with optional time sections; the other reading is only made where the first is no date. A handful of regex passes per value instead of one extraction per
    component."""
    def fix(x):
        return F.regexp_replace(F.regexp_replace(x, r"[ :]+$", ""), r"^(\d{2})-", "20$1-")

    def primary(g):
        s = g("s")
        d_m = F.regexp_replace(s, _DMY_RE, "$4-$3-$1 $5:$6:$7")
        m_d = F.regexp_replace(s, _DMY_RE, "$4-$1-$3 $5:$6:$7")
        return fix(F.when(g("shape") == 1, F.regexp_replace(s, _YMD_RE, "$1-$3-$4 $5:$6:$7"))
                    .when(g("shape") == 2, F.regexp_replace(s, _COMPACT_RE, "$1-$2-$3 $4:$5:$6"))
                    .when(g("shape") == 3, F.when(g("dayfirst"), d_m).otherwise(m_d)))

    def secondary(g):
        s = g("s")
        return fix(F.when((g("shape") == 3) & g("ta").isNull(), F.when(g("dayfirst"), F.regexp_replace(s, _DMY_RE, "$4-$1-$3 $5:$6:$7"))
                          .otherwise(F.regexp_replace(s, _DMY_RE, "$4-$3-$1 $5:$6:$7"))))

    def month_name(g):
        s = g("s")
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(s, _MON_RE, 2)))
        my = _grp(s, _MON_RE, 3)
        return _norm_ts(F.when(my < 100, my + 2000).otherwise(my),
                        F.when(month > 0, month).cast("int"), _grp(s, _MON_RE, 1),
                        F.lit(None), F.lit(None), F.lit(None))

    def out(g):
        fmt = F.lit(_PARSE_FMT)
        ts = (F.when(g("shape").isin(1, 2, 3), F.coalesce(g("ta"), F.try_to_timestamp(g("b"), fmt)))
               .when(g("shape") == 4, month_name(g)))
        return ts if with_time else F.when(~g("s").rlike(r"\d:\d"), ts)

    shape = {"shape": lambda g: (F.when(g("s").rlike(_YMD_RE), F.lit(1)).when(g("s").rlike(_COMPACT_RE), F.lit(2))
                                  .when(g("s").rlike(_DMY_RE), F.lit(3)).when(g("s").rlike(_MON_RE), F.lit(4)))}
    return [{"s": lambda g: _strip(g("v"))}, shape, {"a": primary}, {"ta": lambda g: F.try_to_timestamp(g("a"), F.lit(_PARSE_FMT))}, {"b": secondary}, {"out": out}]


def parse_date_text(v, dayfirst: Column | bool = True, with_time: bool = False) -> Column:
    """Parse date (and optionally date-time) text; null when no supported shape fits or the date is invalid.

    Shapes: yyyy-MM-dd / yyyy/MM/dd / yyyy.MM.dd, yyyyMMdd[HHmmss], d.M.y / d/M/y / d-M-y (or month-first), 2- or
    4-digit years (2-digit -> 20yy), d-Mon-y; each optionally followed by ' H:mm[:ss[.f]]' or 'T...'. The text is
    rewritten to 'yyyy-MM-dd HH:mm:ss' and parsed once. ``dayfirst`` (constant or per-row Column, i.e. a per-column
    decision joined back) picks the reading of ambiguous d/M shapes; the other reading is the fallback when the
    first is not a valid date. Use ``with_parsed`` on DataFrames (staged).
    """
    dfirst = F.lit(dayfirst) if isinstance(dayfirst, bool) else dayfirst
    return S.inline(_parse_formula(with_time), _c(v), dayfirst=dfirst)


def with_parsed(df: DataFrame, outputs: dict[str, Column | str], dayfirst: Column | bool = True,
                with_time: bool = True) -> DataFrame:
    """Staged ``parse_date_text`` for DataFrames: ``{output column: source}``."""
    dfirst = F.lit(dayfirst) if isinstance(dayfirst, bool) else dayfirst
    return S.apply(df, _parse_formula(with_time), outputs, dayfirst=dfirst)


def to_iso_date(v, dayfirst: Column | bool = True, ts: Column | None = None) -> Column:
    """Any recognised date (or date-time) text -> 'yyyy-MM-dd'; unparsed text is returned unchanged;
    null and '' stay as they are. Bare times and plain digit strings (other than yyyyMMdd) stay unchanged.
    ``ts`` may pass an already parsed timestamp of the same value."""
    x = _c(v).cast("string")
    s = _strip(x)
    ts = F.when(~_any(s, PURE_TIME_PATTERNS), parse_date_text(s, dayfirst, with_time=True) if ts is None else ts)
    return F.when(x.isNull() | (x == ""), x).otherwise(F.coalesce(F.date_format(ts, "yyyy-MM-dd"), s))


def parses_as_date(v) -> Column:
    """The value parses with one of the explicit date / date-time formats."""
    return parse_date_text(v, True, with_time=True).isNotNull()


def year_of(v) -> Column:
    """Year of the parsed date, null when it does not parse."""
    return F.year(parse_date_text(v, True, with_time=True))


# ---------------------------------------------------------------------------------------------------------------
# per-column decision (D04) and split

def date_decisions(df: DataFrame, fields: list[str], order_col: str, group_cols: list[str] | None = None,
                   sample: int = 10, first: DataFrame | None = None) -> DataFrame:
    """D04 for several date fields in one pass: one row per group with ``__a_<field>`` (action) and ``__d_<field>``
    (day-first). The fields are unpivoted once, sampled with ``row_number() <= sample`` per (group, field) (planned
    with a partial WindowGroupLimit before the shuffle; for one ledger a limit on a sort) and classified; day-first statistics are a plain aggregate.
    ``first``: rows of ``df`` that hold the first values of every field, where the caller knows fewer than all."""
    from pyspark.sql import Window as W
    g = group_cols or []
    fields = [f for f in fields if f in df.columns]
    if not fields:
        return None
    times = time_columns(df, fields)
    base = df.select(*g, F.col(order_col).alias("__o"), *[F.col(t).alias(f"__t_{t}") for t in times],
                     *[_strip(F.col(f)).alias(f) for f in fields])
    if g:
        some = base if first is None else first.select(*g, F.col(order_col).alias("__o"), *[_strip(F.col(f)).alias(f) for f in fields])
        long = some.select(*g, "__o", *fields).unpivot(ids=g + ["__o"], values=fields, variableColumnName="__field", valueColumnName="__v")
        long = long.where(F.col("__v").isNotNull())
    else:  # one ledger: every task keeps its first values of a field, and none is sorted
        heads = [base.select("__o", F.lit(f).alias("__field"), F.col(f).alias("__v")).where(F.col("__v").isNotNull()).orderBy("__o").limit(sample) for f in fields]
        long = reduce(DataFrame.unionByName, heads)
    w = W.partitionBy(*g, "__field").orderBy("__o")
    smp = (long.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= sample)
               .select(*g, "__field", "__rn", _any(F.col("__v"), PURE_DATE_PATTERNS).alias("pd"),
                       _any(F.col("__v"), PURE_TIME_PATTERNS).alias("pt"),
                       _any(F.col("__v"), COMBINED_PATTERNS).alias("cb")))
    first_cb = F.min(F.when(~F.col("pd") & ~F.col("pt") & F.col("cb"), F.col("__rn"))).over(
        W.partitionBy(*g, "__field"))
    smp = smp.withColumn("first_cb", first_cb)
    before = F.col("first_cb").isNull() | (F.col("__rn") < F.col("first_cb"))
    prof = smp.groupBy(*g, "__field").agg(
        F.count_if(F.col("pd") & before).alias("pure_dates"), F.count_if(F.col("pt") & before).alias("pure_times"),
        F.count(F.lit(1)).alias("samples"), F.max(F.col("first_cb").isNotNull()).alias("dt"))
    pd_r, pt_r = F.col("pure_dates") / F.col("samples"), F.col("pure_times") / F.col("samples")
    action = (F.when(pd_r >= 0.7, F.lit("convert")).when(pt_r >= 0.7, F.lit("leave"))
               .when(~F.col("dt"), F.lit("convert")).otherwise(F.lit("split")))
    wide = prof.groupBy(*g).agg(*[F.max(F.when(F.col("__field") == f, action)).alias(f"__a_{f}") for f in fields]) \
        if g else prof.agg(*[F.max(F.when(F.col("__field") == f, action)).alias(f"__a_{f}") for f in fields])
    over_12 = r"(?:1[3-9]|[2-9]\d)"
    day = []
    for f in fields:
        first = F.col(f).rlike(rf"^{over_12}[./-]\d{{1,2}}[./-]\d{{2,4}}")
        second = F.col(f).rlike(rf"^\d{{1,2}}[./-]{over_12}[./-]\d{{2,4}}")
        day.append((~(F.max(F.coalesce(second, F.lit(False))) & ~F.max(F.coalesce(first, F.lit(False)))))
                   .alias(f"__d_{f}"))
    day += [(F.count(f"__t_{t}") == 0).alias(f"__e_{t}") for t in times]
    days = base.groupBy(*g).agg(*day) if g else base.agg(*day)
    return wide.join(days, g, "full") if g else wide.crossJoin(days)


def split_value(v, dayfirst: Column | bool = True, keep_format: bool = False,
                ts: Column | None = None, s: Column | None = None, pure_d: Column | None = None,
                pure_t: Column | None = None) -> tuple[Column, Column]:
    """Row part of D06/D07: (date text, time text) for one value under the 'split' action.

    null/'' -> ('',''); pure date -> (ISO date, ''), or untouched with ``keep_format``; pure time -> ('', value);
    combined -> (ISO date, 'HH:mm:ss'); with ``keep_format`` the date keeps its own separator order
    ('dd.MM.yyyy HH:mm' -> 'dd.MM.yyyy'); anything else -> (ISO date or the text, '').
    The optional arguments pass pre-computed (staged) pieces of the same value.
    """
    x = _c(v).cast("string")
    s = _strip(x) if s is None else s
    pure_d = _any(s, PURE_DATE_PATTERNS) if pure_d is None else pure_d
    pure_t = _any(s, PURE_TIME_PATTERNS) if pure_t is None else pure_t
    combined = ((F.instr(s, " ") > 0) | (F.instr(s, "T") > 0)) & (F.instr(s, ":") > 0)
    if ts is None:
        ts = parse_date_text(s, dayfirst, with_time=True)
    iso = F.date_format(ts, "yyyy-MM-dd")
    date_kept = F.regexp_extract(s, r"^(\S+?)(?:[ T]\d{1,2}:.*)?$", 1)
    date_combined = date_kept if keep_format else iso
    empty = x.isNull() | (x == "")
    date_out = (F.when(empty, F.lit(""))
                 .when(pure_d, s if keep_format else F.coalesce(iso, s))
                 .when(pure_t, F.lit(""))
                 .when(combined & ts.isNotNull(), date_combined)
                 .otherwise(F.coalesce(iso, s)))
    time_out = (F.when(empty, F.lit(""))
                 .when(pure_d, F.lit(""))
                 .when(pure_t, s)
                 .when(combined & ts.isNotNull(), F.date_format(ts, "HH:mm:ss"))
                 .otherwise(F.lit("")))
    return date_out, time_out


def time_field_name(field: str) -> tuple[str, str]:
    """Output (date field, time field) names for a split column."""
    if field in ("entry_date", "entry_time"):
        return "entry_date", "entry_time"
    t = field.replace("_date", "_time").replace("date", "time")
    return field, (f"{field}_time" if t == field else t)


def time_columns(df: DataFrame, fields) -> list[str]:
    """Columns of ``df`` that would receive the times of the date fields."""
    names = [time_field_name(f)[1] for f in fields if f in df.columns]
    return [t for t in dict.fromkeys(names) if t in df.columns]


def split_datetime(df: DataFrame, fields=("entry_date", "entry_time", "posting_date"), order_col: str = "row_id",
                   group_cols: list[str] | None = None, keep_format: bool = False,
                   decisions_attached: bool = False) -> DataFrame:
    """D06 (D07 with ``keep_format``): per date field present, decide the action per column (and group), then
    convert to ISO, leave, or split into a date and a time column. A time column that is there and holds nothing in
    the group receives the times; where it holds values they go to a twin (``_1``). Decisions are a tiny per-group table
    joined back (a 1-row broadcast for a single ledger), the rows are rewritten with native expressions."""
    g = group_cols or []
    present = [f for f in fields if f in df.columns]
    if not present:
        return df
    if not decisions_attached:
        # all decisions from the input in one pass; one row per group, attached once
        dec = date_decisions(df, present, order_col, g)
        df = df.join(dec, g, "left") if g else df.crossJoin(F.broadcast(dec))  # 1-row broadcast only
    decided = [c for c in df.columns if c.startswith("__e_")]
    for field in present:
        a, d = F.col(f"__a_{field}"), F.coalesce(F.col(f"__d_{field}"), F.lit(True))
        date_field, time_field = time_field_name(field)
        fill = None
        if time_field in df.columns and time_field != field:
            if f"__e_{time_field}" in decided:
                fill = (time_field, F.coalesce(F.col(f"__e_{time_field}"), F.lit(True)))
            n = 1
            while f"{time_field}_{n}" in df.columns:
                n += 1
            time_field = f"{time_field}_{n}"
        # staged: strip and classify once, parse once, then derive every output from those columns
        df = df.withColumn("__s", _strip(F.col(field)))
        df = df.withColumns({"__pd": _any(F.col("__s"), PURE_DATE_PATTERNS),
                             "__pt": _any(F.col("__s"), PURE_TIME_PATTERNS)})
        df = with_parsed(df, {"__ts": F.col("__s")}, d, with_time=True)
        ts, sc = F.col("__ts"), F.col("__s")
        date_out, time_out = split_value(F.col(field), d, keep_format, ts=ts, s=sc, pure_d=F.col("__pd"),
                                         pure_t=F.col("__pt"))
        x = F.col(field).cast("string")
        converted = F.col(field) if keep_format else F.when(x.isNull() | (x == ""), x).otherwise(
            F.coalesce(F.date_format(F.when(~F.col("__pt"), ts), "yyyy-MM-dd"), sc))
        new_date = (F.when(a == "split", date_out).when(a == "convert", converted).otherwise(F.col(field)))
        cols = {date_field: new_date}
        if field in ("entry_date", "entry_time") or time_field not in df.columns:
            base_time = F.col(time_field) if time_field in df.columns else F.lit(None).cast("string")
            cols[time_field] = F.when(a == "split", time_out).otherwise(base_time)
        if fill:
            whole, empty = fill
            cols[time_field] = F.when((a == "split") & ~empty, time_out)
            cols[whole] = F.when((a == "split") & empty, time_out).otherwise(F.col(whole))
        if field == "entry_time":
            cols = {"entry_date": F.when(a == "split", date_out).otherwise(
                        F.col("entry_date") if "entry_date" in df.columns else F.lit(None).cast("string")),
                    "entry_time": F.when(a == "split", time_out).otherwise(F.col("entry_time"))}
        df = df.withColumns(cols).drop(f"__a_{field}", f"__d_{field}", "__ts", "__s", "__pd", "__pt")
    return df.drop(*decided)
