"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every row becomes a digest entry (short digest, SHA-256 of the normalised text, length, id). Entries are dealt into
``runs`` runs by a hash of the row number. Each run is sorted by digest and reduced to its best entry per text; then
the runs merge in binomial rounds: in round r, ``fan_in`` runs that differ only in their r-th digit meet, sorted by
digest, and one entry per text is retained. Entries merge only if the SHA-256 and length verify the short digest, so a
collision of the short digest can't join two texts. The aggregate is over a struct, for which Spark plans sort
aggregation: each round is a merge of sorted runs with partial merging before the exchange.

A group of copies of any size gives at most ``runs`` entries after the first step, so no later task sees the group.
The way back uses the same runs: the root entry goes to the (at most ``runs``) leaf entries of its text, and rows meet
the leaf entry of their own run, which holds about 1/runs of a group. Nothing is collected or broadcast.

Null text counts as empty. Of equal texts the longest original stays, then the smallest id (a null id comes last), then
the first row; a row that is repeated with the same id is one more copy, so exactly one row of a group is ``kept``.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm.common import SPACES, free_names, stage, text_or_empty

RUNS = 64
FAN_IN = 8


def normalised(text_col: str):
    return F.translate(text_or_empty(text_col), SPACES, "")


def digest_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """A row for each document: row number, id, SHA-256, short digest, run and the order in which copies are preferred."""
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(text_col).cast("binary"), 256).alias("sha"),
                      F.length(text_or_empty(text_col)).cast("long").alias("size"),
                      F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("digest", F.xxhash64("sha")).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int"))


def merge_runs(entries: DataFrame) -> DataFrame:
    """One entry per run and text: the preferred copy and the number of copies."""
    return entries.groupBy("digest", "sha", "run").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS,
          fan_in: int = FAN_IN) -> DataFrame:
    """Per row: ``row`` number, id, SHA-256, the id that stays, the group's size and whether this row stays."""
    rows = stage(digest_entries(docs, id_col, text_col, runs), "digests")
    best = F.struct((-F.col("size")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    leaves = stage(merge_runs(rows.select("digest", "sha", "run", best.alias("best"), F.lit(1).cast("long").alias("copies"))),
                   "leaves")
    level, left = leaves, runs
    while left > 1:
        level = merge_runs(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
        left = -(-left // fan_in)
    root = level.select("digest", "sha", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"),
                        F.col("copies").alias("group_size"))
    down = leaves.select("digest", "sha", "run").join(root, ["digest", "sha"])
    return rows.join(down, ["digest", "sha", "run"]).select(
        "row", F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were.

    Rows find their verdict by SHA-256 and id. Where the id that stays is on several rows of its group (the same row
    again, or a shorter copy under the same id), the longest of them is taken.
    """
    sha, size, key, k_sha, k_id = free_names(docs, "text_sha", "text_size", "kept_id", "k_sha", "k_id")
    groups = dedup(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = stage(groups.groupBy(F.col("text_sha256").alias(k_sha), F.col("keep_id").alias(k_id))
                 .agg(F.count(F.lit(1)).alias("same")), "keep")
    cols = [f"`{c}`" for c in docs.columns]
    mine = docs.withColumn(sha, F.sha2(normalised(text_col).cast("binary"), 256))
    match = (F.col(sha) == F.col(k_sha)) & F.col(f"`{id_col}`").eqNullSafe(F.col(k_id))
    single, repeated = keep.where("same = 1").drop("same"), keep.where("same > 1").drop("same")
    one = mine.join(single, match, "left_semi").select(*cols)
    if repeated.isEmpty():
        return one
    many = mine.join(repeated, match, "left_semi").withColumn(size, F.length(text_or_empty(text_col)))
    many = many.groupBy(sha).agg(F.max_by(F.struct(*map(F.col, cols)), F.col(size)).alias(key)).select(f"{key}.*")
    return one.unionByName(many)
