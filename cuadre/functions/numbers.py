"""Number-text cleaning and amount derivation as native Column expressions.

Everything is built from ``regexp_replace`` / ``locate`` / ``substring`` / ``when`` and a guarded ``try_cast``, so the
expressions stay inside whole-stage codegen (no Python UDF). Spark's string->double cast accepts forms Python's
``float`` rejects ('5d', '1f') and vice versa, so every cast is guarded by an explicit literal grammar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuadre.functions import staging as S

# Python ``float()`` literal grammar (ASCII subset) used to guard casts
FLOAT_LITERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_FLOAT = r"(?i)^[+-]?(inf|infinity|nan)$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _last_pos(s: Column, ch: str) -> Column:
    """1-based position of the last ``ch`` in ``s``; 0 when absent."""
    return F.length(s) - F.length(F.substring_index(s, ch, -1))


def _without(s: Column, *chars: str) -> Column:
    """``s`` without the given characters."""
    for ch in chars:
        s = F.replace(s, F.lit(ch), F.lit(""))
    return s


def _count(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(_without(s, ch))


def _bare(s: Column) -> Column:
    """``_strip`` of a staged column: text that begins and ends with printable ASCII has nothing to strip."""
    plain = F.substring(s, 1, 1).between("!", "~") & F.substring(s, -1, 1).between("!", "~")
    return F.when(plain, s).otherwise(_strip(s))


def _strip(s: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    from cuadre.functions.text import py_strip
    return py_strip(s)


def _py_float(s: Column) -> Column:
    """float(s) as Python would parse it; null where Python raises."""
    t = _strip(s)
    return F.when(t.rlike(FLOAT_LITERAL) | t.rlike(SPECIAL_FLOAT), t.try_cast("double"))


def _n01() -> S.Formula:
    return [
        {"s": lambda g: _bare(g("v").cast("string"))},
        {"c": lambda g: F.regexp_replace(g("s"), r"[^0-9.,\-]", ""),
         "paren": lambda g: g("s").contains("(") & g("s").rlike(r"\([^)]*[0-9]+[^)]*\)")},
        {"lc": lambda g: _last_pos(g("c"), ","), "ld": lambda g: _last_pos(g("c"), "."),
         "n_dots": lambda g: _count(g("c"), "."),
         "last_c": lambda g: F.substring_index(g("c"), ",", -1),
         "last_d": lambda g: F.substring_index(g("c"), ".", -1)},
        {"norm": lambda g: (
            F.when((g("lc") > 0) & (g("ld") > 0),
                   F.when(g("lc") < g("ld"), _without(g("c"), ",")).otherwise(
                       F.concat(_without(F.substring(g("c"), 1, g("lc") - 1), ".", ","),
                                F.lit("."), F.substring(g("c"), g("lc") + 1, 1 << 30))))
             .when(g("lc") > 0,
                   F.when(F.length(g("last_c")) <= 2,
                          F.concat(_without(F.substring(g("c"), 1, g("lc") - 1), ","), F.lit("."),
                                   g("last_c")))
                    .otherwise(_without(g("c"), ",")))
             .when(g("ld") > 0,
                   F.when((g("n_dots") >= 2) & (F.length(g("last_d")) <= 2) & g("last_d").rlike(r"^[0-9]+$"),
                          F.concat(_without(F.substring(g("c"), 1, g("ld") - 1), "."), F.lit("."),
                                   g("last_d")))
                    .when((g("n_dots") == 1) & (F.length(g("last_d")) > 2), _without(g("c"), "."))
                    .otherwise(g("c")))
             .otherwise(g("c")))},
        {"first": lambda g: F.regexp_extract(g("norm"), r"-?[0-9]+\.?[0-9]*", 0)},
        {"out": lambda g: (
            F.when(g("v").isNull() | (g("s") == ""), F.lit(0.0))
             .when(g("c") == "", F.lit(None).cast("double"))
             .when(g("first") == "", F.lit(0.0))
             .when(g("paren"), -g("first").try_cast("double"))
             .otherwise(g("first").try_cast("double")))},
    ]


def _n02() -> S.Formula:
    return [
        {"s": lambda g: _strip(g("v").cast("string"))},
        {"paren": lambda g: g("s").startswith("(") & g("s").endswith(")") & (F.length(g("s")) >= 2)},
        {"t": lambda g: F.regexp_replace(
            F.when(g("paren"), F.regexp_replace(F.substring(g("s"), 2, 1 << 30), r"\)$", "")).otherwise(g("s")),
            "[ \u200b]", "")},
        {"lc": lambda g: _last_pos(g("t"), ","), "ld": lambda g: _last_pos(g("t"), ".")},
        {"fixed": lambda g: (F.when(g("lc") > g("ld"), F.regexp_replace(F.regexp_replace(g("t"), r"\.", ""), ",", "."))
                              .when(g("ld") > g("lc"), F.regexp_replace(g("t"), ",", ""))
                              .otherwise(g("t")))},
        {"num": lambda g: _py_float(g("fixed"))},
        {"out": lambda g: F.when(g("v").isNull(), F.lit(None).cast("double"))
                           .when(g("paren"), -g("num")).otherwise(g("num"))},
    ]


def _n03() -> S.Formula:
    return [
        {"s0": lambda g: _bare(g("v").cast("string"))},
        {"neg": lambda g: g("s0").startswith("-")},
        {"c": lambda g: F.regexp_replace(F.when(g("neg"), F.substring(g("s0"), 2, 1 << 30)).otherwise(g("s0")),
                                         r"[^0-9.,]", "")},
        {"lc": lambda g: _last_pos(g("c"), ","), "ld": lambda g: _last_pos(g("c"), "."),
         "n_d": lambda g: _count(g("c"), "."),
         "n_c": lambda g: _count(g("c"), ","),
         "no_sep": lambda g: _without(g("c"), ".", ","),
         "td": lambda g: F.substring_index(g("c"), ".", -1),
         "tc": lambda g: F.substring_index(g("c"), ",", -1)},
        {"norm": lambda g: (
            F.when((g("n_d") == 0) & (g("n_c") == 0), g("c"))
             .when(g("n_c") == 0,
                   F.when(g("n_d") == 1, F.when(F.length(g("td")) <= 2, g("c")).otherwise(g("no_sep")))
                    .when((F.length(g("td")) <= 2) & (F.length(g("td")) > 0),
                          F.concat(_without(F.substring(g("c"), 1, g("ld") - 1), "."), F.lit("."),
                                   g("td")))
                    .otherwise(g("no_sep")))
             .when(g("n_d") == 0,
                   F.when((g("n_c") == 1) & (F.length(g("tc")) <= 2), F.replace(g("c"), F.lit(","), F.lit(".")))
                    .otherwise(g("no_sep")))
             .otherwise(
                 F.when(g("ld") > g("lc"),
                        F.when(F.length(g("td")) <= 2, _without(g("c"), ",")).otherwise(g("no_sep")))
                  .otherwise(F.when(F.length(g("tc")) <= 2,
                                    F.replace(_without(g("c"), "."), F.lit(","), F.lit(".")))
                             .otherwise(g("no_sep")))))},
        {"num": lambda g: _py_float(g("norm"))},
        {"out": lambda g: F.when(g("v").isNull() | (g("v") == "") | ~g("s0").rlike("[0-9]") | (g("c") == ""),
                                 F.lit(0.0))
                           .otherwise(F.coalesce(F.when(g("neg"), -g("num")).otherwise(g("num")), F.lit(0.0)))},
    ]


def _n04() -> S.Formula:
    return [
        {"s": lambda g: F.regexp_replace(_strip(g("v").cast("string")), r"[€$£¥₹\s]", "")},
        {"tok": lambda g: F.regexp_extract(g("s"), r"-?[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]+)?", 0)},
        {"lc": lambda g: _last_pos(g("tok"), ","), "ld": lambda g: _last_pos(g("tok"), "."),
         "n_c": lambda g: F.length(g("tok")) - F.length(F.regexp_replace(g("tok"), ",", ""))},
        {"norm": lambda g: (
            F.when((g("lc") > 0) & (g("ld") > 0),
                   F.when(g("ld") > g("lc"), F.regexp_replace(g("tok"), ",", ""))
                    .otherwise(F.regexp_replace(F.regexp_replace(g("tok"), r"\.", ""), ",", ".")))
             .when((g("n_c") == 1) & (F.length(F.substring_index(g("tok"), ",", -1)) <= 2),
                   F.regexp_replace(g("tok"), ",", "."))
             .otherwise(F.regexp_replace(g("tok"), ",", "")))},
        {"out": lambda g: F.when(g("v").isNull() | (g("v") == ""), F.lit(0.0))
                           .when(g("tok") == "", F.lit(0.0))
                           .otherwise(F.coalesce(_py_float(g("norm")), F.lit(0.0)))},
    ]


def _n01_fixed() -> S.Formula:
    """N01 with its quirks mended: a trailing minus counts, '1.234.567' is an integer, text without digits is 0."""
    steps = _n01()
    steps[0] = {"s0": lambda g: _bare(g("v").cast("string"))}
    late = r"^[^-]*[0-9][^0-9-]*-$"  # a minus only after the last digit
    groups = r"^[^0-9.,]*[0-9]{1,3}(\.[0-9]{3}){2,}[^0-9.,]*$"
    steps.insert(1, {"s1": lambda g: F.when(g("s0").endswith("-") & g("s0").rlike(late), F.concat(F.lit("-"), F.regexp_replace(g("s0"), "-$", ""))).otherwise(g("s0"))})
    steps.insert(2, {"s": lambda g: F.when((_count(g("s1"), ".") >= 2) & g("s1").rlike(groups), _without(g("s1"), ".")).otherwise(g("s1"))})
    quirk = steps[-1]["out"]
    steps[-1] = {"out": lambda g: F.coalesce(quirk(g), F.lit(0.0))}
    return steps


FORMULAS = {"clean_amount": _n01, "clean_amount_fixed": _n01_fixed, "clean_trial_balance_number": _n02, "parse_amount_manual": _n03,
            "first_number": _n04}


def clean_amount(value: Column | str) -> Column:
    """European/US number text -> double, parentheses make it negative.

    null / blank -> 0.0. Keep only digits, '.', ',' and '-'. Both separators: the later one is the decimal point.
    Commas only: a last group of <= 2 characters is decimal, otherwise commas are thousands. Dots only: several dots
    with a last group of 1-2 digits is European ('25.000.00'); one dot followed by 3+ characters is a thousands
    separator. Then the first '-?digits[.digits]' is taken. Nothing left after the character filter -> null
    ('EUR'); characters left but no digits -> 0.0 ('-'). Quirks kept: '1.234.567' -> 1.234, '68,28-' -> 6828.0.
    Single-expression form; use ``with_cleaned`` on DataFrames (staged, codegen-friendly).
    """
    return S.inline(_n01(), _c(value))


def clean_trial_balance_number(value: Column | str) -> Column:
    """Trial-balance number text -> double or null. Trim; '(x)' is negative; spaces and zero-width spaces
    removed; the later of ',' and '.' is the decimal separator (the other is dropped); the rest must parse as a
    float, otherwise null."""
    return S.inline(_n02(), _c(value))


def parse_amount_manual(value: Column | str) -> Column:
    """Manual-session amount parser. Leading '-' kept, parentheses ignored, invalid -> 0.0.

    After dropping everything but digits, '.' and ',': no separator -> integer; dots only -> one dot with <= 2
    decimals is decimal, 3+ is thousands, several dots with a 1-2 digit tail keep the last as decimal; commas only ->
    one comma with <= 2 decimals is decimal, otherwise thousands; both -> the later one is decimal when followed by
    <= 2 digits, else every separator is dropped.
    """
    return S.inline(_n03(), _c(value))


def first_number(value: Column | str) -> Column:
    """Strip currency symbols and whitespace, take the first number-like token, normalise its separators."""
    return S.inline(_n04(), _c(value))


def with_cleaned(df: DataFrame, outputs: dict[str, Column | str], kind: str = "clean_amount") -> DataFrame:
    """Staged DataFrame form of N01-N04: ``{output column: source}``; every intermediate computed once per row."""
    return S.apply(df, FORMULAS[kind](), outputs)


def is_numeric(value: Column | str) -> Column:
    """N05: ',' -> '.', spaces removed, one leading '-' dropped, then it must parse as a float."""
    v = _c(value).cast("string")
    t = F.regexp_replace(F.regexp_replace(v, ",", "."), " ", "")
    t = F.when(t.startswith("-"), F.substring(t, 2, 1 << 30)).otherwise(t)
    t = _strip(t)
    return F.coalesce(t.rlike(FLOAT_LITERAL) | t.rlike(SPECIAL_FLOAT), F.lit(False))


# ---------------------------------------------------------------------------------------------------------------
# amount derivation

def debit_credit_to_amount(debit: Column | str, credit: Column | str) -> Column:
    """amount = debit - credit (both already cleaned)."""
    return _c(debit) - _c(credit)


def indicator_from_debit_credit(debit: Column | str, credit: Column | str) -> Column:
    """N06/N07: 'D' when credit == 0; else 'H' when debit == 0 and credit != 0; else ''."""
    d, c = _c(debit), _c(credit)
    return F.when(c == 0, F.lit("D")).when((d == 0) & (c != 0), F.lit("H")).otherwise(F.lit(""))


def indicator_from_amount(amount: Column | str) -> Column:
    """> 0 'D', < 0 'H', else ''."""
    a = _c(amount)
    return F.when(a > 0, F.lit("D")).when(a < 0, F.lit("H")).otherwise(F.lit(""))


def amount_to_debit(amount: Column | str) -> Column:
    """Debit side of a signed amount."""
    return F.greatest(_c(amount), F.lit(0.0))


def amount_to_credit(amount: Column | str) -> Column:
    """Credit side of a signed amount."""
    return F.greatest(-_c(amount), F.lit(0.0))


def clip01(x: Column | str) -> Column:
    """N11."""
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def safe_ratio(n: Column | str, d: Column | str) -> Column:
    """N / max(d, 1)."""
    return _c(n).cast("double") / F.greatest(_c(d), F.lit(1)).cast("double")
