"""DuckDB SQL text for the oracle side of the correctness gate.

These are independent re-statements of the Column builders in DuckDB's dialect (RE2 regexes, ``regexp_replace`` with
the 'g' flag, ``strpos``), used only inside ``oracle_sql()`` strings."""

from __future__ import annotations

from cuadre.plans.views import grouped_digits_sql

MONEY = "DECIMAL(18,2)"
FLOAT_LITERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL_FLOAT = r"^[+-]?(inf|infinity|nan)$"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def last_pos(s: str, ch: str) -> str:
    return f"(CASE WHEN strpos({s}, '{ch}') > 0 THEN length({s}) - strpos(reverse({s}), '{ch}') + 1 ELSE 0 END)"


def tail(s: str, ch: str) -> str:
    esc = "\\." if ch == "." else ch
    return f"regexp_extract({s}, '[^{esc}]*$', 0)"


def rm(s: str, ch: str) -> str:
    return f"replace({s}, '{ch}', '')"


def py_float(s: str) -> str:
    t = strip(s)
    return (f"(CASE WHEN regexp_matches({t}, '{FLOAT_LITERAL}') OR regexp_matches(lower({t}), '{SPECIAL_FLOAT}') "
            f"THEN TRY_CAST({t} AS DOUBLE) END)")


def clean_amount(x: str) -> str:
    """N01 in DuckDB SQL (nested CTE-free form: repeated sub-expressions)."""
    s = strip(f"CAST({x} AS VARCHAR)")
    c = f"regexp_replace({s}, '[^0-9.,\\-]', '', 'g')"
    lc, ld = last_pos(c, ","), last_pos(c, ".")
    both = (f"(CASE WHEN {lc} < {ld} THEN {rm(c, ',')} ELSE concat({rm(rm(f'substring({c}, 1, {lc} - 1)', ','), '.')},"
            f" '.', substring({c}, {lc} + 1)) END)")
    last_c = tail(c, ",")
    commas = (f"(CASE WHEN length({last_c}) <= 2 THEN concat({rm(f'substring({c}, 1, {lc} - 1)', ',')}, '.', {last_c})"
              f" ELSE {rm(c, ',')} END)")
    n_dots = f"(length({c}) - length({rm(c, '.')}))"
    last_d = tail(c, ".")
    dots = (f"(CASE WHEN {n_dots} >= 2 AND length({last_d}) <= 2 AND regexp_matches({last_d}, '^[0-9]+$') "
            f"THEN concat({rm(f'substring({c}, 1, {ld} - 1)', '.')}, '.', {last_d}) "
            f"WHEN {n_dots} = 1 AND length({last_d}) > 2 THEN {rm(c, '.')} ELSE {c} END)")
    norm = (f"(CASE WHEN {lc} > 0 AND {ld} > 0 THEN {both} WHEN {lc} > 0 THEN {commas} "
            f"WHEN {ld} > 0 THEN {dots} ELSE {c} END)")
    first = f"regexp_extract({norm}, '-?[0-9]+\\.?[0-9]*', 0)"
    paren = f"regexp_matches({s}, '\\([^)]*[0-9]+[^)]*\\)')"
    return (f"(CASE WHEN {x} IS NULL OR {s} = '' THEN 0.0 WHEN {c} = '' THEN NULL WHEN {first} = '' THEN 0.0 "
            f"WHEN {paren} THEN -CAST({first} AS DOUBLE) ELSE CAST({first} AS DOUBLE) END)")


def tb_number(x: str) -> str:
    """N02."""
    s = strip(f"CAST({x} AS VARCHAR)")
    paren = f"(starts_with({s}, '(') AND ends_with({s}, ')') AND length({s}) >= 2)"
    inner = f"(CASE WHEN {paren} THEN substring({s}, 2, length({s}) - 2) ELSE {s} END)"
    t = f"replace(replace({inner}, ' ', ''), chr(8203), '')"
    lc, ld = last_pos(t, ","), last_pos(t, ".")
    fixed = (f"(CASE WHEN {lc} > {ld} THEN replace({rm(t, '.')}, ',', '.') WHEN {ld} > {lc} THEN {rm(t, ',')} "
             f"ELSE {t} END)")
    num = py_float(fixed)
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {paren} THEN -{num} ELSE {num} END)"


def manual_amount(x: str) -> str:
    """N03."""
    s0 = strip(f"CAST({x} AS VARCHAR)")
    neg = f"starts_with({s0}, '-')"
    s = f"(CASE WHEN {neg} THEN substring({s0}, 2) ELSE {s0} END)"
    c = f"regexp_replace({s}, '[^0-9.,]', '', 'g')"
    lc, ld = last_pos(c, ","), last_pos(c, ".")
    n_d = f"(length({c}) - length({rm(c, '.')}))"
    n_c = f"(length({c}) - length({rm(c, ',')}))"
    no_sep = f"regexp_replace({c}, '[.,]', '', 'g')"
    td, tc = tail(c, "."), tail(c, ",")
    dots = (f"(CASE WHEN {n_d} = 1 THEN (CASE WHEN length({td}) <= 2 THEN {c} ELSE {no_sep} END) "
            f"WHEN length({td}) <= 2 AND length({td}) > 0 THEN concat({rm(f'substring({c}, 1, {ld} - 1)', '.')}, '.', {td})"
            f" ELSE {no_sep} END)")
    commas = f"(CASE WHEN {n_c} = 1 AND length({tc}) <= 2 THEN replace({c}, ',', '.') ELSE {no_sep} END)"
    both = (f"(CASE WHEN {ld} > {lc} THEN (CASE WHEN length({td}) <= 2 THEN {rm(c, ',')} ELSE {no_sep} END) "
            f"ELSE (CASE WHEN length({tc}) <= 2 THEN replace({rm(c, '.')}, ',', '.') ELSE {no_sep} END) END)")
    norm = (f"(CASE WHEN {n_d} = 0 AND {n_c} = 0 THEN {c} WHEN {n_c} = 0 THEN {dots} WHEN {n_d} = 0 THEN {commas} "
            f"ELSE {both} END)")
    num = py_float(norm)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' OR NOT regexp_matches({s0}, '[0-9]') OR {c} = '' THEN 0.0 "
            f"ELSE COALESCE(CASE WHEN {neg} THEN -{num} ELSE {num} END, 0.0) END)")


def first_number(x: str) -> str:
    """N04."""
    s = f"regexp_replace({strip(f'CAST({x} AS VARCHAR)')}, '[€$£¥₹\\s]', '', 'g')"
    tok = f"regexp_extract({s}, '-?[0-9]{{1,3}}(?:[.,][0-9]{{3}})*(?:[.,][0-9]+)?', 0)"
    lc, ld = last_pos(tok, ","), last_pos(tok, ".")
    n_c = f"(length({tok}) - length({rm(tok, ',')}))"
    norm = (f"(CASE WHEN {lc} > 0 AND {ld} > 0 THEN (CASE WHEN {ld} > {lc} THEN {rm(tok, ',')} "
            f"ELSE replace({rm(tok, '.')}, ',', '.') END) "
            f"WHEN {n_c} = 1 AND length({tail(tok, ',')}) <= 2 THEN replace({tok}, ',', '.') ELSE {rm(tok, ',')} END)")
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 0.0 WHEN {tok} = '' THEN 0.0 "
            f"ELSE COALESCE({py_float(norm)}, 0.0) END)")


def is_numeric(x: str) -> str:
    """N05."""
    t = f"replace(replace(CAST({x} AS VARCHAR), ',', '.'), ' ', '')"
    t = f"(CASE WHEN starts_with({t}, '-') THEN substring({t}, 2) ELSE {t} END)"
    t = strip(t)
    return (f"COALESCE(regexp_matches({t}, '{FLOAT_LITERAL}') OR regexp_matches(lower({t}), '{SPECIAL_FLOAT}'), "
            f"false)")


def money_text(x: str, style: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    ip, fr = f"split_part({s}, '.', 1)", f"split_part({s}, '.', 2)"
    if style == "eu":
        return f"concat({grouped_digits_sql(ip, '.')}, ',', {fr})"
    if style == "us":
        return f"concat({grouped_digits_sql(ip, ',')}, '.', {fr})"
    return s


def raw_ledger_cte() -> str:
    """DuckDB form of ``views.raw_ledger`` (plus the ordering columns used for 'first row' semantics)."""
    eu, us, plain = money_text("p", "eu"), money_text("p", "us"), money_text("p", "plain")
    importe = (f"CASE l_linenumber % 4 "
               f"WHEN 0 THEN (CASE WHEN l_returnflag = 'R' THEN concat('-', {eu}) ELSE {eu} END) "
               f"WHEN 1 THEN (CASE WHEN l_returnflag = 'R' THEN concat('-', {us}) ELSE {us} END) "
               f"WHEN 2 THEN (CASE WHEN l_returnflag = 'R' THEN concat('-', {plain}) ELSE {plain} END) "
               f"ELSE (CASE WHEN l_returnflag = 'R' THEN concat('(', {eu}, ')') ELSE concat({eu}, ' €') END) END")
    return f"""raw AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS asiento, CAST(l_linenumber AS VARCHAR) AS linea,
             CAST(l_partkey AS VARCHAR) AS cuenta, CAST(l_suppkey AS VARCHAR) AS tercero,
             strftime(l_shipdate, '%d/%m/%Y') AS fecha, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS fecha_hora,
             {importe} AS importe,
             CASE WHEN l_returnflag <> 'R' THEN {eu} ELSE '' END AS debe,
             CASE WHEN l_returnflag = 'R' THEN {eu} ELSE '' END AS haber,
             CASE WHEN l_returnflag = 'R' THEN 'H' ELSE 'D' END AS signo,
             l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag,
             l_quantity, l_discount, l_tax, l_linestatus
      FROM (SELECT *, CAST(l_extendedprice AS {MONEY}) AS p FROM lineitem) li)"""
