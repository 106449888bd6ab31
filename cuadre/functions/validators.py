"""Content validators (V01-V16) and the validator registry.

Each validator is a per-value score Column; a column's score is the mean over its non-null sampled values, clamped
to [0, 1] for the validators that clamp (dates, fiscal year and period are not clamped, as in the reference). The
registry maps a field type to a score builder; a user may register a native Column builder, or a pandas
Series->float UDF for the aggregate (``register_validator``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuadre.functions.dates import DATE_LIKE_5, parse_date_text
from cuadre.functions.numbers import FLOAT_LITERAL, SPECIAL_FLOAT, is_numeric

# fixed values: patterns and vocabularies of the validators
JE_PATTERNS = [r"^\d{6,15}$", r"^JE\d{6,12}$", r"^AST\d{4,10}$", r"^[A-Z]{2,4}\d{6,12}$", r"^\d{4}[A-Z]{2,4}\d{4,8}$",
               r"^[A-Z0-9]{8,20}$"]
DATE_PATTERNS = [r"^\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}$", r"^\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}$",
                 r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}\.\d{2}\.\d{4}$",
                 r"^\d{1,2}\.\d{1,2}\.\d{4}$", r"^\d{4}\.\d{2}\.\d{2}$", r"^\d{8}$"]
AMOUNT_PATTERNS = [r"^-?\d{1,3}(\.\d{3})*,\d{2}$", r"^-?\d{1,3}(,\d{3})*\.\d{2}$", r"^-?\d+[,\.]\d{1,4}$", r"^-?\d+$",
                   r"^-?\d+\.\d+$", r"^-?\d+,\d+$", r"^-?\d{1,3}( \d{3})*[,\.]\d{2}$"]
INDICATORS = ["D", "C", "H", "DEBE", "HABER", "DEBIT", "CREDIT", "DR", "CR", "1", "0", "-1", "S", "N", "DB", "CD",
              "DEB", "CRE"]
INDICATOR_CHARS = "DCHXSNYN+-"
YES_NO = ["YES", "NO", "SI", "TRUE", "FALSE"]
ACCOUNT_PATTERNS = [r"^\d{3,10}$", r"^\d{3,6}\.\d{2,4}$", r"^\d{3,6}-\d{2,4}$", r"^[A-Z]\d{3,9}$",
                    r"^\d{1,2}\.\d{2,3}\.\d{2,3}$"]
MONTH_NAMES = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC", "JAN", "APR",
               "AUG", "DEC", "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE",
               "OCTUBRE", "NOVIEMBRE", "DICIEMBRE"]


def _any(v: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [v.rlike(p) for p in patterns])


def _strip(v: Column) -> Column:
    from cuadre.functions.text import py_strip
    return py_strip(v)


def _isdigit(v: Column) -> Column:
    return v.rlike(r"^\p{Nd}+$")


def _float(v: Column) -> Column:
    t = _strip(v)
    return F.when(t.rlike(FLOAT_LITERAL) | t.rlike(SPECIAL_FLOAT), t.try_cast("double"))


def _date_like(v: Column) -> Column:
    return _any(_strip(v), DATE_LIKE_5)


def score_journal_entry_id(v: Column) -> Column:
    """V01."""
    s = _strip(v)
    up = F.upper(s)
    n = F.length(s)
    fallback = (F.when((n >= 6) & _isdigit(s), 0.8).when((n >= 4) & up.rlike(r"^[A-Z0-9]+$"), 0.6).otherwise(0.0)
                - F.when(_date_like(s), 0.5).otherwise(0.0) - F.when(n < 3, 0.3).otherwise(0.0))
    return F.when(_any(up, JE_PATTERNS), F.lit(1.0)).otherwise(fallback)


def score_line_number(v: Column) -> Column:
    """V02."""
    raw = v.cast("string")
    num = _float(F.replace(raw, F.lit(","), F.lit(".")))
    as_int = _strip(raw)
    parsed = (F.when((num >= 1) & (num <= 9999) & (num == F.floor(num)), 1.0)
               .when(_isdigit(as_int) & (as_int.try_cast("long") >= 1) & (as_int.try_cast("long") <= 99999), 0.8)
               .when((num >= 0) & (num < 1), 0.3).otherwise(0.0))
    s = _strip(raw)
    unparsed = (F.when(_date_like(s), -0.5).otherwise(0.0)
                + F.when((F.length(s) <= 5) & F.upper(s).rlike(r"^[A-Z0-9]+$"), 0.4).otherwise(0.0))
    return F.when(num.isNotNull(), parsed).otherwise(unparsed)


def score_date(v: Column) -> Column:
    """1 for a date pattern, 0.8 when it parses (explicit formats), -0.3 for digit runs longer than 8."""
    s = _strip(v)
    return (F.when(_any(s, DATE_PATTERNS), 1.0)
             .when(parse_date_text(s, True, with_time=True).isNotNull(), 0.8)
             .when((F.length(s) > 8) & _isdigit(s), -0.3).otherwise(0.0))


def score_amount(v: Column) -> Column:
    """V05-V07."""
    s = _strip(v)
    n = F.length(s)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    fallback = (F.when(is_numeric(s), 0.7).otherwise(0.0)
                - F.when((n > 2) & (letters > n * 0.5), 0.5).otherwise(0.0)
                - F.when(_date_like(s), 0.4).otherwise(0.0))
    return F.when(_any(s, AMOUNT_PATTERNS), F.lit(1.0)).otherwise(fallback)


def score_indicator(v: Column) -> Column:
    """V08."""
    s = F.upper(_strip(v))
    base = (F.when(s.isin(*INDICATORS), 1.0)
             .when((F.length(s) == 1) & (F.instr(F.lit(INDICATOR_CHARS), s) > 0), 0.8)
             .when(s.isin(*YES_NO), 0.6).otherwise(0.0))
    num = F.abs(_float(F.replace(s, F.lit(","), F.lit("."))))
    numeric_adj = F.when(is_numeric(s) & num.isNotNull(),
                         F.when(num > 10, -0.8).when(num <= 1, 0.3).otherwise(0.0)).otherwise(0.0)
    return base + numeric_adj - F.when(F.length(s) > 10, 0.5).otherwise(0.0)


def score_gl_account(v: Column) -> Column:
    """V09."""
    s = _strip(v)
    n = F.length(s)
    bare = F.regexp_replace(s, r"[.\-]", "")
    as_int = F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("long"))
    fallback = (F.when((n >= 3) & _isdigit(bare), 0.8).when((n >= 3) & F.upper(s).rlike(r"^[A-Z0-9.\-]+$"), 0.6)
                 .otherwise(0.0)
                - F.when((as_int >= 1) & (as_int <= 12), 0.4).otherwise(0.0)
                - F.when(n < 3, 0.3).otherwise(0.0))
    return F.when(_any(s, ACCOUNT_PATTERNS), F.lit(1.0)).otherwise(fallback)


def score_fiscal_year(v: Column) -> Column:
    """V10 (not clamped)."""
    x = _float(v.cast("string"))
    y = F.when(x.isNotNull() & ~F.isnan(x), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))
    s = F.upper(_strip(v))
    parsed = F.when((y >= 1950) & (y <= 2100), 1.0).when((y >= 50) & (y <= 99), 0.8) \
        .when((y >= 0) & (y <= 49), 0.8).otherwise(0.0)
    unparsed = F.when(s.rlike(r"^FY\d{2,4}$"), 0.9).when(_strip(v).rlike(r"^\d{4}-\d{4}$"), 0.9).otherwise(0.0)
    return F.when(x.isNotNull(), parsed).otherwise(unparsed)


def score_period(v: Column) -> Column:
    """V11 (not clamped; the quarter branch is unreachable behind the week branch, as in the reference)."""
    x = _float(v.cast("string"))
    p = F.when(x.isNotNull() & ~F.isnan(x), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))
    s = F.upper(_strip(v))
    month = reduce(lambda a, b: a | b, [F.instr(s, m) > 0 for m in MONTH_NAMES])
    parsed = F.when((p >= 1) & (p <= 12), 1.0).when((p >= 1) & (p <= 53), 0.6).otherwise(0.0)
    unparsed = (F.when(month, 0.9).when(s.rlike(r"^Q[1-4]$"), 0.9).when(s.rlike(r"^T[1-4]$"), 0.9)
                 .when(s.rlike(r"^\d{4}-\d{2}$"), 0.8).otherwise(0.0))
    return F.when(x.isNotNull(), parsed).otherwise(unparsed)


def score_description(v: Column) -> Column:
    """V12/V13."""
    s = _strip(v)
    n = F.length(s)
    letters = s.rlike(r"\p{L}")
    base = F.when(n >= 3, F.when(letters & ((F.instr(s, " ") > 0) | (n > 10)), 1.0).when(letters, 0.7)
                  .when(n > 5, 0.4).otherwise(0.0)).otherwise(0.0)
    digits = _isdigit(F.regexp_replace(s, r"[.,\- ]", ""))
    return (base - F.when(digits, F.when(n < 8, 0.6).otherwise(0.2)).otherwise(0.0)
            - F.when(_date_like(s), 0.4).otherwise(0.0) - F.when(n < 2, 0.5).otherwise(0.0))


def score_cost_center(v: Column) -> Column:
    """V16 (template validator): 1 if it starts with 2-10 upper letters/digits, else 0.5 for length >= 2."""
    s = _strip(v)
    return F.when(s.rlike(r"^[A-Z0-9]{2,10}"), 1.0).when(F.length(s) >= 2, 0.5).otherwise(0.0)


# field type -> (row score builder, clamp)
VALIDATORS: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "journal_entry_id": (score_journal_entry_id, True),
    "line_number": (score_line_number, True),
    "posting_date": (score_date, False),
    "entry_date": (score_date, False),
    "amount": (score_amount, True),
    "debit_amount": (score_amount, True),
    "credit_amount": (score_amount, True),   # registered under 'amount_credit' in the reference; both names work
    "amount_credit": (score_amount, True),
    "debit_credit_indicator": (score_indicator, True),
    "gl_account_number": (score_gl_account, True),
    "fiscal_year": (score_fiscal_year, False),
    "period_number": (score_period, False),
    "description": (score_description, True),
    "line_description": (score_description, True),
}
OPTIONAL_VALIDATORS = {"cost_center": (score_cost_center, True)}


def register_validator(field_type: str, builder: Callable[[Column], Column], clamp: bool = True) -> None:
    """add or replace a validator (a Column -> per-value score builder)."""
    VALIDATORS[field_type] = (builder, clamp)


def list_validators() -> list[str]:
    return sorted(VALIDATORS)


def column_score(field_type: str, value: Column) -> Column:
    """Aggregate expression: the validator's column score over ``value`` (nulls dropped; empty -> 0)."""
    builder, clamp = {**VALIDATORS, **OPTIONAL_VALIDATORS}[field_type]
    avg = F.coalesce(F.avg(F.when(value.isNotNull(), builder(value))), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(avg, F.lit(1.0))) if clamp else avg
