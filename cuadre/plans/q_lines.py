"""Line family: documents as report text files (S03, L01-L26, W01, W02, W11) and conversations as labelled line
files (W03, W04, A29, X10: user -> PARENT, assistant -> CHILD, system -> HEADER, ordered by turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuadre.functions import line_features as LF
from cuadre.operators import lines as L
from cuadre.plans.registry import query
from cuadre.sources.tables import table

STRUCTURAL = [
    "line_length", "line_length_no_ws", "starts_with_space_or_tab", "leading_spaces", "leading_tabs",
    "total_indentation", "pipe_count", "tab_count", "comma_count", "semicolon_count", "colon_count", "dot_count",
    "dash_count", "total_delimiters", "has_dashes", "has_equals", "has_dots", "is_separator_line", "upper_ratio",
    "non_alnum_ratio", "digits_ratio", "space_ratio", "number_count", "has_numbers", "number_density",
    "has_month_name", "has_amounts", "amount_count", "meta_keywords", "header_keywords", "total_keywords",
    "num_words", "avg_word_length", "max_word_length", "starts_with_number", "starts_with_zeros", "is_empty",
    "is_mostly_spaces", "is_table_like", "is_header_candidate", "has_dotted_fillers", "meta_strong_keywords",
    "is_meta_strong"]
CONTEXT = ["relative_position", "is_first_lines", "is_last_lines", "prev_line_length", "prev_is_separator",
           "prev_is_table_like", "length_diff_prev", "surrounded_by_separators", "next_line_length",
           "next_is_separator", "next_is_table_like", "length_diff_next", "next_pipe_count", "header_context_hint",
           "meta_context_hint"]
LEXICAL = ["has_date", "has_two_dates", "has_year", "has_currency", "has_doc_type", "has_account_number",
           "has_all_caps_word", "is_meta_candidate", "short_tokens_ratio"]


def doc_lines(spark, sf):
    return L.text_lines(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


def _features(spark, sf, names):
    lines = doc_lines(spark, sf)
    feats = L.line_features(lines, keep=["file", "line_no"])
    return feats.select(F.col("file").alias("doc_id"), "line_no", *names)


# ---------------------------------------------------------------------------------------------------------------
# DuckDB side

LINES_SQL = """
  lines AS (
    SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line_no, len(ls) AS n_lines, ls
    FROM (SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN []::VARCHAR[]
                 ELSE string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13),
                      chr(10)), chr(10) || '$', ''), chr(10)) END AS ls
          FROM documents) d),
  lx AS (SELECT doc_id, line_no, n_lines, t, COALESCE(ls[line_no - 1], '') AS prv,
                CASE WHEN line_no < n_lines THEN ls[line_no + 1] ELSE '' END AS nxt FROM lines)"""


def _cnt_char(t, ch):
    return f"(length({t}) - length(replace({t}, {ch}, '')))"


def _cnt_re(t, p):
    return f"(length(regexp_replace({t}, '{p}', 'X', 'g')) - length(regexp_replace({t}, '{p}', '', 'g')))"


def _ratio(n, d):
    return f"(CAST({n} AS DOUBLE) / CAST(greatest({d}, 1) AS DOUBLE))"


def _sep(t):
    return rf"CAST(regexp_matches({t}, '^\s*[-=\.]{{8,}}\s*$') AS INTEGER)"


def _table(t):
    conds = " OR ".join(f"{_cnt_char(t, c)} >= 3" for c in ("'|'", "'│'", "';'", "','", "chr(9)"))
    return f"CAST(({conds} OR {_cnt_re(t, ' {2,}')} >= 3) AS INTEGER)"


def _kw(low, words):
    return "(" + " + ".join(f"CAST(strpos({low}, '{w}') > 0 AS INTEGER)" for w in words) + ")"


def _strip(t):
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _structural_sql():
    t, low, st = "t", "lower(t)", _strip("t")
    c = {}
    c["line_length"] = "length(t)"
    c["line_length_no_ws"] = "length(replace(replace(t, ' ', ''), chr(9), ''))"
    c["starts_with_space_or_tab"] = "CAST(starts_with(t, ' ') OR starts_with(t, chr(9)) AS INTEGER)"
    c["leading_spaces"] = "length(regexp_extract(t, '^ *', 0))"
    c["leading_tabs"] = "length(regexp_extract(t, '^\t*', 0))"
    c["total_indentation"] = f"({c['leading_spaces']} + {c['leading_tabs']})"
    for name, ch in (("pipe_count", "'|'"), ("tab_count", "chr(9)"), ("comma_count", "','"),
                     ("semicolon_count", "';'"), ("colon_count", "':'"), ("dot_count", "'.'"), ("dash_count", "'-'")):
        c[name] = _cnt_char(t, ch)
    c["total_delimiters"] = "(" + " + ".join(c[k] for k in ("pipe_count", "tab_count", "comma_count",
                                                             "semicolon_count", "colon_count")) + ")"
    c["has_dashes"] = "CAST(regexp_matches(t, '-{8,}') AS INTEGER)"
    c["has_equals"] = "CAST(regexp_matches(t, '={8,}') AS INTEGER)"
    c["has_dots"] = r"CAST(regexp_matches(t, '\.{8,}') AS INTEGER)"
    c["is_separator_line"] = _sep(t)
    c["upper_ratio"] = _ratio(_cnt_re(t, r"\p{Lu}"), _cnt_re(t, r"\p{L}"))
    c["non_alnum_ratio"] = _ratio(_cnt_re(t, r"[^\p{L}\p{N}\s]"), "length(t)")
    c["digits_ratio"] = _ratio(_cnt_re(t, r"\p{Nd}"), "length(t)")
    c["space_ratio"] = _ratio(_cnt_char(t, "' '"), "length(t)")
    nums = _cnt_re(t, r"\d+[.,]\d+|\d+")
    c["number_count"] = nums
    c["has_numbers"] = f"CAST({nums} > 0 AS INTEGER)"
    c["number_density"] = f"(CAST({nums} AS DOUBLE) / CAST(greatest(length(t), 1) AS DOUBLE))"
    c["has_month_name"] = (f"CAST(regexp_matches({low}, '{LF.MONTHS_ES}') OR regexp_matches({low}, '{LF.MONTHS_EN}')"
                           f" AS INTEGER)")
    amt = _cnt_re(t, LF.AMOUNT_PATTERN)
    c["has_amounts"] = f"CAST({amt} > 0 AS INTEGER)"
    c["amount_count"] = amt
    c["meta_keywords"] = _kw(low, LF.META_KEYWORDS)
    c["header_keywords"] = _kw(low, LF.HEADER_KEYWORDS)
    c["total_keywords"] = _kw(low, LF.TOTAL_KEYWORDS)
    words = rf"regexp_extract_all({st}, '\S+')"
    c["num_words"] = f"len({words})"
    c["avg_word_length"] = (rf"(CASE WHEN len({words}) > 0 THEN CAST(length(regexp_replace({st}, '\s+', '', 'g')) "
                            f"AS DOUBLE) / CAST(len({words}) AS DOUBLE) ELSE 0.0 END)")
    c["max_word_length"] = f"COALESCE(list_max(list_transform({words}, lambda x: length(x))), 0)"
    c["starts_with_number"] = rf"CAST(regexp_matches({st}, '^\d') AS INTEGER)"
    c["starts_with_zeros"] = f"CAST(starts_with({st}, '0') AS INTEGER)"
    c["is_empty"] = f"CAST({st} = '' AS INTEGER)"
    c["is_mostly_spaces"] = f"CAST(length({st}) < length(t) * 0.1 AS INTEGER)"
    c["is_table_like"] = _table(t)
    c["is_header_candidate"] = (f"CAST(({_table(t)} = 1) OR {c['header_keywords']} > 0 OR {c['pipe_count']} >= 3 "
                                f"AS INTEGER)")
    c["has_dotted_fillers"] = r"CAST(regexp_matches(t, '\.{3,}') AS INTEGER)"
    c["meta_strong_keywords"] = _kw(low, LF.META_STRONG_KEYWORDS)
    c["is_meta_strong"] = f"CAST({c['meta_strong_keywords']} >= 2 AS INTEGER)"
    return ",\n         ".join(f"{c[n]} AS {n}" for n in STRUCTURAL)


def _context_sql():
    c = {}
    i0 = "(line_no - 1)"
    c["relative_position"] = (f"(CASE WHEN n_lines > 1 THEN CAST({i0} AS DOUBLE) / CAST(n_lines - 1 AS DOUBLE) "
                              f"ELSE 0.0 END)")
    c["is_first_lines"] = f"CAST({i0} < 10 AS INTEGER)"
    c["is_last_lines"] = f"CAST({i0} >= n_lines - 8 AS INTEGER)"
    c["prev_line_length"] = "length(prv)"
    c["prev_is_separator"] = _sep("prv")
    c["prev_is_table_like"] = _table("prv")
    c["length_diff_prev"] = "(length(t) - length(prv))"
    c["surrounded_by_separators"] = f"CAST({_sep('prv')} = 1 AND {_sep('nxt')} = 1 AS INTEGER)"
    c["next_line_length"] = "length(nxt)"
    c["next_is_separator"] = _sep("nxt")
    c["next_is_table_like"] = _table("nxt")
    c["length_diff_next"] = "(length(nxt) - length(t))"
    c["next_pipe_count"] = _cnt_char("nxt", "'|'")
    c["header_context_hint"] = f"CAST({_sep('prv')} = 1 OR {_sep('nxt')} = 1 AS INTEGER)"
    c["meta_context_hint"] = f"CAST({i0} < 10 AND {_table('prv')} = 0 AS INTEGER)"
    return ",\n         ".join(f"{c[n]} AS {n}" for n in CONTEXT)


_W = r"[\p{L}\p{N}_]"      # Unicode word character, as Python's re and Java's (?U) see it
_NW = r"[^\p{L}\p{N}_]"


def _bounded(p):
    """Unicode \\b...\\b around ``p`` for RE2 (whose \\b is ASCII-only): a non-word character or the line edge."""
    return f"(^|{_NW}){p}({_NW}|$)"


def _two(p):
    """Two non-overlapping bounded occurrences (fixed-length patterns, so leftmost scanning finds them)."""
    return f"(^|{_NW}){p}{_NW}(.*{_NW})?{p}({_NW}|$)"


def _lexical_sql():
    c = {}
    c["has_date"] = "CAST(" + " OR ".join(f"regexp_matches(t, '{_bounded(p[2:-2])}')" for p in LF.DATE_PATTERNS) \
        + " AS INTEGER)"
    c["has_two_dates"] = "CAST(" + " OR ".join(f"regexp_matches(t, '{_two(p[2:-2])}')" for p in LF.DATE_PATTERNS) \
        + " AS INTEGER)"
    c["has_year"] = f"CAST(regexp_matches(t, '{_bounded(r'20\d{2}')}') AS INTEGER)"
    c["has_currency"] = f"CAST(regexp_matches(t, '(?i)({_bounded('(EUR|USD)')}|€|\\$)') AS INTEGER)"
    c["has_doc_type"] = f"CAST(regexp_matches(t, '{_bounded('[A-Z][A-Z0-9]')}') AS INTEGER)"
    c["has_account_number"] = f"CAST(regexp_matches(t, '{_bounded(r'\d{6,12}')}') AS INTEGER)"
    c["has_all_caps_word"] = f"CAST(regexp_matches(t, '{_bounded(r'\p{Lu}{4,}')}') AS INTEGER)"
    c["is_meta_candidate"] = f"CAST({_kw('lower(t)', LF.META_KEYWORDS)} > 0 OR {c['has_all_caps_word']} = 1 AS INTEGER)"
    short = f"len(list_filter(regexp_extract_all(t, '{_W}+'), lambda x: length(x) <= 3))"
    c["short_tokens_ratio"] = _ratio(short, _cnt_re("t", r"\S+"))
    return ",\n         ".join(f"{c[n]} AS {n}" for n in LEXICAL)


@query("line_features_structural", ("S03", "W11", "L01", "L02", "L03", "L04", "L05", "L06", "L07", "L08", "L09",
                                    "L11", "L15", "L16", "L17", "L18", "L20", "L21", "L22", "L23"),
       oracle=f"WITH {LINES_SQL}\n  SELECT doc_id, line_no, {_structural_sql()} FROM lx")
def q_line_features_structural(spark, sf):
    return _features(spark, sf, STRUCTURAL)


@query("line_features_context", ("W01", "W02", "L24", "L25", "L26"),
       oracle=f"WITH {LINES_SQL}\n  SELECT doc_id, line_no, {_context_sql()} FROM lx")
def q_line_features_context(spark, sf):
    return _features(spark, sf, CONTEXT)


@query("line_features_lexical", ("L10", "L11", "L12", "L13", "L14", "L19", "L21", "L22"),
       oracle=f"WITH {LINES_SQL}\n  SELECT doc_id, line_no, {_lexical_sql()} FROM lx")
def q_line_features_lexical(spark, sf):
    return _features(spark, sf, LEXICAL)


@query("line_features", ("L01-L26",))
def q_line_features(spark, sf):
    """All 67 features (bench headline; the three queries above check them against the oracle)."""
    return _features(spark, sf, LF.FEATURE_NAMES)


# ---------------------------------------------------------------------------------------------------------------
# conversations as labelled line files

ROLE_LABEL = {"user": "PARENT", "assistant": "CHILD", "system": "HEADER"}  # mapping of roles onto line labels


def conv_lines(spark, sf):
    c = table(spark, sf, "conversations")
    lab = F.when(F.col("role") == "user", F.lit("PARENT")).when(F.col("role") == "assistant", F.lit("CHILD")) \
        .when(F.col("role") == "system", F.lit("HEADER")).otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), "text", lab.alias("label"))


_CONV_SQL = """c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'PARENT' WHEN 'assistant' THEN 'CHILD'
                  WHEN 'system' THEN 'HEADER' ELSE role END AS label FROM conversations)"""


@query("carry_parent", ("W03", "T08"), oracle=f"""
  WITH {_CONV_SQL}
  SELECT conv_id, turn, label, COALESCE(last_value(CASE WHEN label = 'PARENT' THEN text END IGNORE NULLS)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS parent
  FROM c""")
def q_carry_parent(spark, sf):
    out = L.carry_parent(conv_lines(spark, sf), block=L.CARRY_BLOCK)
    return out.select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "label", "parent")


@query("carry_parent_small_blocks", ("W03",), oracle=f"""
  WITH {_CONV_SQL}
  SELECT conv_id, turn, COALESCE(last_value(CASE WHEN label = 'PARENT' THEN text END IGNORE NULLS)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS parent
  FROM c""")
def q_carry_parent_small_blocks(spark, sf):
    """The segmented scan with 2-turn blocks, so parents cross many block boundaries."""
    out = L.carry_parent(conv_lines(spark, sf), block=2)
    return out.select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "parent")


@query("distinct_headers", ("W04", "T09"), oracle=r"""
  SELECT conv_id, min(turn) AS first_line, arg_min(text, turn) AS header_text
  FROM conversations WHERE role = 'system' AND text <> ''
  GROUP BY conv_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')""")
def q_distinct_headers(spark, sf):
    out = L.distinct_headers(conv_lines(spark, sf))
    return out.select(F.col("file").alias("conv_id"), "first_line", "header_text")


@query("structure_mode", ("A29",), oracle="""
  SELECT conv_id, CASE WHEN bool_or(role IN ('user', 'assistant')) THEN 'HPC' ELSE 'NONE' END AS mode
  FROM conversations GROUP BY conv_id""")
def q_structure_mode(spark, sf):
    return L.structure_mode(conv_lines(spark, sf)).select(F.col("file").alias("conv_id"), "mode")


@query("structure_rows", ("X10", "P10", "S17"), oracle=f"""
  WITH {_CONV_SQL}, p AS (
    SELECT conv_id, turn, label, text, COALESCE(last_value(CASE WHEN label = 'PARENT' THEN text END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS parent,
           bool_or(label IN ('PARENT', 'CHILD')) OVER (PARTITION BY conv_id) AS hpc FROM c)
  SELECT conv_id, turn, parent, text FROM p WHERE hpc AND label = 'CHILD'""")
def q_structure_rows(spark, sf):
    out = L.structure_rows(conv_lines(spark, sf))
    return out.select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "parent", "text")
