"""Merkle dataset manifest: a hash tree over a table, with a proof for every row, from lag and lead windows.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value. The leaves
of a group (a source) ascend by id; of every ``FAN_OUT`` consecutive nodes of a level the hash is a node of the next
level, until one is left, the group's subroot. The subroots, ordered by group (null first, then by bytes), are the
leaves of a tree of their own, whose last node is the root.

A level is one window pass. Nodes carry their place and the number of nodes of their level, so slot and length of
their run are known without looking: fixed-offset ``lag`` and ``lead`` columns, masked by them, are the siblings, and the
row in slot 0, which sees its whole run, hashes the parent. Windows span ``SPAN`` nodes (whole runs), never a group,
so one source may hold any share of the rows. Places come from ``ranked``: range partitions and their counts. Levels
shrink by ``FAN_OUT``; on the way back each node's path (its siblings, then its parent's path) is joined to it by group and
place, at most ``FAN_OUT`` rows to a key. Nothing is collected but the size of the longest level.

All leaves are hashed and all rows folded: ``folded_root`` starts from the tampered leaf where the row is tampered
with, else from its own, and takes the siblings as they were.

Null fields are ``-``; the empty string is ``0:``. Null ids come first in their group and are never tampered with. Rows
with the same id are ordered by their leaf; rows that repeat are leaves of their own. A run of one node is hashed too. A
single row of a single source is leaf, subroot and root, its proof the hash of nothing. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuadre.llm.common import ranked, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 16
#: Nodes of a window, and rows of a range partition.
SPAN = 16 * FAN_OUT
PART_ROWS = 1_000_000
#: Rows with crc32(id) divisible by this are tampered with.
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sized(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_rows(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields=FIELDS) -> DataFrame:
    """doc_id, grp (the group as a string that sorts null first), leaf, and ``changed``: the leaf of a tampered row."""
    col = {c: F.col(f"`{c}`") for c in {*fields, id_col, group_col, text_col}}
    told = {c: sized(col[c]) for c in fields}
    lowered = told | {text_col: sized(F.translate(col[text_col].cast("string"), UPPER, LOWER))}
    tampered = F.crc32(col[id_col].cast("string").cast("binary")) % TAMPER == 0
    return docs.select(
        col[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("="), col[group_col].cast("string")), F.lit("-")).alias("grp"),
        sha(*told.values()).alias("leaf"), F.when(tampered, sha(*lowered.values())).alias("changed"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, n, digest, ...) with ``left`` and ``right``: the digests of the run's others, end to end."""
    span = Window.partitionBy("grp", F.expr(f"idx div {SPAN}")).orderBy("idx")
    slot = F.col("idx") % FAN_OUT
    run = F.least(F.lit(FAN_OUT), F.col("n") - F.col("idx") + slot)
    lags = [F.when(slot >= k, F.lag("digest", k).over(span)) for k in range(FAN_OUT - 1, 0, -1)]
    leads = [F.when(slot + k < run, F.lead("digest", k).over(span)) for k in range(1, FAN_OUT)]
    return nodes.select("*", F.concat_ws("", *lags).alias("left"), F.concat_ws("", *leads).alias("right"))


def climb(nodes: DataFrame, name: str) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Per level, the nodes with siblings and the groups that end there; and (grp, digest) of the last nodes."""
    levels, ended, now = [], [], nodes
    while True:
        ended.append(now.where("n = 1"))
        if (now.agg(F.max("n").alias("n")).first()["n"] or 0) <= 1:
            break
        rows = stage(with_siblings(now.where("n > 1")), name)
        levels.append((rows, ended[-1]))
        now = stage(rows.where(F.col("idx") % FAN_OUT == 0).select(
            "grp", F.expr(f"idx div {FAN_OUT}").alias("idx"), F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"),
            sha(F.col("digest"), F.col("right")).alias("digest")), name)
    tops = ended[0].select("grp", "digest")
    for e in ended[1:]:
        tops = tops.unionByName(e.select("grp", "digest"))
    levels.append((None, ended[-1]))
    return levels, tops


def descend(levels: list[tuple[DataFrame, DataFrame]], base: DataFrame, name: str) -> DataFrame:
    """The nodes of the lowest level with ``path``: (left, right) of every level up to the last, then the path that
    ``base`` (grp, path, ...) has for the group."""
    path, known = None, base.drop("grp").columns
    for depth, (rows, ended) in reversed(list(enumerate(levels))):
        here = ended.join(base, "grp")
        if rows is not None:
            above = path.select("grp", F.col("idx").alias("up"), *[F.col(c).alias(f"up_{c}") for c in known])
            joined = rows.withColumn("up", F.expr(f"idx div {FAN_OUT}")).join(above, ["grp", "up"])
            step = F.array(F.struct("left", "right"))
            joined = joined.select(*[c for c in rows.columns if c not in ("left", "right")],
                                   *[(F.concat(step, "up_path") if c == "path" else F.col(f"up_{c}")).alias(c) for c in known])
            here = joined.unionByName(here)
        path = stage(here, name) if depth else here
    return path


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields=FIELDS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = stage(leaf_rows(docs, id_col, group_col, text_col, fields), "leaves")
    sizes = stage(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    placed = ranked(leaves, ["doc_id", "leaf"], group="grp", partitions=parts, name="leaves").join(sizes, "grp")
    levels, subroots = climb(placed.select("grp", (F.col("rank") - 1).alias("idx"), "n", F.col("leaf").alias("digest"), "doc_id", "changed"), "level")

    groups = sizes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    nodes = ranked(stage(subroots.withColumnRenamed("grp", "of"), "subroots"), ["of"], name="subroots")
    top, roots = climb(nodes.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("idx"), F.lit(groups).cast("long").alias("n"), "digest", "of"), "top")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = descend(top, roots.select("grp", nothing.alias("path"), F.col("digest").alias("root")), "paths")
    base = stage(tops.select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "paths")

    rows = descend(levels, base, "paths")
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda acc, x: sha(x["left"], acc, x["right"]))
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda x: F.concat(x["left"], x["right"]))), 256)
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")
                       ).withColumn("verified", F.col("folded_root") == F.col("root"))
