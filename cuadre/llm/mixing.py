"""Mixing sources to target weights by systematic sampling.

Sizes are word counts. Sources get targets by weight: ``share`` times the total size, a target never above ``most``
times its source's size, the excess reshared by weight until none is above. Each document of a source expects the
same number of copies, target / source size. Documents of a source are laid out by (size, keyed hash); the running
sum of expected copies, shifted by one offset per source, crosses an integer for every copy that is emitted. Taking
them in the order of their size spreads the picks over all sizes, so the words taken come near the target.

The running sum needs each row's rank in its source: rows are range-partitioned and staged, the partitions' row
counts summed up into offsets, and ranks counted inside a partition (``common.ranked``). A source with a third of all
rows is thus spread over a third of the partitions. Only the table of sources, one row each, is sorted in one task.

Null text or text without words has size 0 and is emitted like any other document, with 0 words. Null is a source of
its own, the last. A source without words has target 0 and none of its documents is taken. Repeated rows are taken
one by one. The hash is of id and seed, so a rerun takes the same documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.llm.common import WORD, free_names, ranked, stage, text_or_empty

#: Fixed values of the mix: weights of the sources in their order, repeating; share of all sizes; most of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(col: str):
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets per source, from (source, source_size). Sources whose cap / weight is small reach their cap first; the
    first number of capped sources for which no other is above its cap is the answer."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    t = t.withColumn("level", F.col("cap") / F.col("weight"))
    by = Window.orderBy("level", F.col("source").isNull(), "source")
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("flat", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("flat") <= F.col("level"), F.struct("level", F.col("source").isNull(), "source", "flat"))).over(everything)
    # below the first source that stays under its cap, all are capped
    t = t.withColumn("first", first)
    return t.select("source", "source_size", F.when(F.col("first").isNull() | (F.col("level") < F.col("first.level")), F.col("cap"))
                    .otherwise(F.least(F.col("weight") * F.col("first.flat"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Per row: ``row`` number, doc_id, size, source_size, target, ``copies`` and ``taken`` = copies x size."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                      word_count(text_col).alias("size"), F.monotonically_increasing_id().alias("row"))
    src = src.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")))
    place = ranked(src, ["size", "key", "doc_id", "row"], "source", name="mix")
    sources = stage(targets(place.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    s = sources.select(F.col("source").alias("of_source"), "source_size", "target",
                       F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
                       offset.alias("shift"))
    t = place.join(s, F.col("source").eqNullSafe(F.col("of_source")))
    t = t.withColumn("copies", (F.floor(F.col("rank") * F.col("rate") + F.col("shift")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("shift"))).cast("long"))
    return t.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, all columns as they were.

    Rows find their copies by id and the hash of their text; rows that repeat an id and text share the sum of their
    copies out among themselves.
    """
    key, n, no, m_id, m_key, m_source, every, same = free_names(
        docs, "text_key", "copies", "copy_no", "m_id", "m_key", "m_source", "all_copies", "same")
    cols = docs.columns
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    ident, src = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    plan = mix(keyed.select(F.struct(ident.alias("id"), F.col(key).alias("key")).alias("doc_id"), src.alias("source"), F.col(f"`{text_col}`").alias("text")),
               "doc_id", "text", "source", **how)
    plan = plan.groupBy("doc_id", "source").agg(F.sum("copies").alias(every), F.count(F.lit(1)).alias(same)).where(F.col(every) > 0)
    plan = stage(plan.select(F.col("doc_id.id").alias(m_id), F.col("doc_id.key").alias(m_key),
                             F.col("source").alias(m_source), every, same), "copies")
    match = (F.col(key) == F.col(m_key)) & ident.eqNullSafe(F.col(m_id)) & src.eqNullSafe(F.col(m_source))
    out = keyed.join(plan.where(F.col(same) == 1), match).withColumn(n, F.col(every))
    repeated = plan.where(F.col(same) > 1)
    if not repeated.isEmpty():
        # the same row several times: which of the equal rows carries the extra copy makes no difference
        w = Window.partitionBy(m_key, m_id, m_source).orderBy(F.lit(1))
        share = lambda k: F.floor(k * F.col(every) / F.col(same))
        many = keyed.join(repeated, match).withColumn(no, F.row_number().over(w))
        many = many.withColumn(n, share(F.col(no)) - share(F.col(no) - 1)).drop(no)
        out = out.unionByName(many)
    out = out.where(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[f"`{c}`" for c in cols])
