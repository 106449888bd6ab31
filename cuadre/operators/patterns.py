"""Learned value patterns (T10, T11, U06): the common character-class pattern of a column's first values and its
anchored regex, computed as a grouped aggregation per (file, column, position); and the learned-pattern upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PUNCT = ".,;:-_/"  # fixed value: punctuation class P
CLASS_REGEX = {"D": r"\d", "U": "[A-Z]", "L": "[a-z]", "A": "[A-Za-z]", "P": r"[.,:;\-_/]", "W": r"\s",
               "X": "."}  # class X uses '.' (a class that rejects letters and digits would not match its sample)


def char_class_pattern(sample: DataFrame, first_n: int = 10) -> DataFrame:
    """Per (file_id, column): if the first ``first_n`` sampled values all have the same length, one class
    letter per position - D digits, U upper, L lower, A letters, P punctuation '.,;:-_/', W spaces, X mixed;
    otherwise null. ``sample`` is ``profile.first_values`` output."""
    s = sample.where(F.col("rn") <= first_n)
    lens = s.groupBy("file_id", "column").agg(F.count_distinct(F.length("value")).alias("__nl"),
                                              F.max(F.length("value")).alias("__len"))
    chars = s.select("file_id", "column", F.posexplode(F.split("value", "")).alias("pos", "ch")) \
             .where(F.col("ch") != "")
    ch = F.col("ch")
    cls = chars.groupBy("file_id", "column", "pos").agg(
        F.bool_and(ch.rlike(r"^\p{Nd}$")).alias("d"), F.bool_and(ch.rlike(r"^\p{Lu}$")).alias("u"),
        F.bool_and(ch.rlike(r"^\p{Ll}$")).alias("l"), F.bool_and(ch.rlike(r"^\p{L}$")).alias("a"),
        F.bool_and(F.instr(F.lit(PUNCT), ch) > 0).alias("p"), F.bool_and(ch.rlike(r"(?U)^\s$")).alias("w"))
    letter = (F.when(F.col("d"), "D").when(F.col("u"), "U").when(F.col("l"), "L").when(F.col("a"), "A")
               .when(F.col("p"), "P").when(F.col("w"), "W").otherwise("X"))
    per = cls.select("file_id", "column", "pos", letter.alias("c"))
    pat = per.groupBy("file_id", "column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "")
        .alias("__p"))
    out = lens.join(pat, ["file_id", "column"], "left")
    return out.select("file_id", "column",
                      F.when((F.col("__nl") == 1) & (F.col("__len") > 0), F.col("__p")).alias("char_pattern"))


def pattern_to_regex(pattern_col: str = "char_pattern") -> F.Column:
    """Run-length encode the class letters into an anchored regex, e.g. 'UUDD' -> '^[A-Z]{2}\\d{2}$'."""
    runs = F.regexp_extract_all(F.col(pattern_col), F.lit(r"((.)\2*)"), F.lit(1))
    mapping = F.create_map(*[x for k, v in CLASS_REGEX.items() for x in (F.lit(k), F.lit(v))])
    parts = F.transform(runs, lambda r: F.concat(F.element_at(mapping, F.substring(r, 1, 1)), F.lit("{"),
                                                 F.length(r).cast("string"), F.lit("}")))
    return F.when(F.col(pattern_col).isNotNull(), F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$")))


def learn_patterns(decided: DataFrame, sample: DataFrame, confidence: float = 0.8) -> DataFrame:
    """T10 + T11 on the columns of ``decided`` (file_id, column, field_type): (field_type, regex, boost, confidence,
    sample_values), one row for each field and regex; columns whose values have no common pattern teach nothing."""
    mine = sample.join(decided.select("file_id", "column", "field_type"), ["file_id", "column"])
    regex = char_class_pattern(mine).select("file_id", "column", pattern_to_regex().alias("regex")).where("regex is not null")
    values = mine.where("rn <= 5").groupBy("file_id", "column", "field_type").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("v"))
    rows = values.join(regex, ["file_id", "column"]).groupBy("field_type", "regex").agg(
        F.min_by(F.col("v.value"), F.struct("file_id", "column")).alias("sample_values"))
    return rows.select("field_type", "regex", F.lit(0.25).alias("boost"), F.lit(confidence).alias("confidence"), "sample_values")


def upsert_learned_patterns(existing: DataFrame, new: DataFrame, keep_examples: int = 20) -> DataFrame:
    """Append unseen (field_type, regex) with boost 0.25; for seen ones merge sample values (last
    ``keep_examples`` distinct) and raise confidence by 0.05 up to 0.95. Both inputs:
    (field_type, regex, boost, confidence, sample_values array<string>)."""
    e = existing.alias("e")
    n = new.alias("n")
    j = e.join(n, ["field_type", "regex"], "full")
    merged = F.array_distinct(F.concat(F.coalesce(F.col("e.sample_values"), F.array().cast("array<string>")),
                                       F.coalesce(F.col("n.sample_values"), F.array().cast("array<string>"))))
    tail = F.slice(merged, F.greatest(F.size(merged) - keep_examples + 1, F.lit(1)), keep_examples)
    return j.select(
        "field_type", "regex",
        F.coalesce(F.col("e.boost"), F.lit(0.25)).alias("boost"),
        F.when(F.col("e.regex").isNotNull() & F.col("n.regex").isNotNull(),
               F.least(F.col("e.confidence") + 0.05, F.lit(0.95)))
         .otherwise(F.coalesce(F.col("e.confidence"), F.col("n.confidence"))).alias("confidence"),
        tail.alias("sample_values"))


def learned_name_boost(mappings: DataFrame, learned_names: DataFrame) -> DataFrame:
    """+0.2 (capped at 1) when lower(trim(column)) is a learned name of the same field."""
    ln = learned_names.select(F.lower(F.trim("name")).alias("__k"), F.col("field_type").alias("__f")).distinct()
    m = mappings.withColumn("__k", F.lower(F.trim("column")))
    j = m.join(ln, (m["__k"] == ln["__k"]) & (m["field_type"] == ln["__f"]), "left")
    return j.select(*[m[c] for c in mappings.columns if c != "confidence"],
                    F.when(ln["__f"].isNotNull(), F.least(m["confidence"] + 0.2, F.lit(1.0)))
                     .otherwise(m["confidence"]).alias("confidence"))
