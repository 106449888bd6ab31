"""Text helpers (T02, T05, T07): native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: upper-case accented letters and their base letters (NFD without combining marks)
ACCENTED_UPPER = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN_UPPER = "AAAAAAEEEEIIIIOOOOOUUUUNCY"


# every character Python's str.strip() removes (all of them lie below U+3001)
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def py_strip(v: Column) -> Column:
    """Python ``str.strip()``: ``trim`` with the exact whitespace set (no regex)."""
    return F.trim(v.cast("string"), F.lit(PY_WHITESPACE))


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def normalize_text(v: Column | str) -> Column:
    """Trim, upper, strip accents, collapse whitespace runs to one space."""
    t = F.upper(py_strip(_c(v)))
    return F.regexp_replace(F.translate(t, ACCENTED_UPPER, PLAIN_UPPER), r"(?U)\s+", " ")


def clean_account_number(v: Column | str) -> Column:
    """Null -> '', '123.0' (integral float text) -> '123', otherwise the trimmed text."""
    t = F.trim(_c(v).cast("string"))
    return F.when(_c(v).isNull(), F.lit("")).otherwise(F.regexp_replace(t, r"^(\d+)\.0+$", "$1"))
