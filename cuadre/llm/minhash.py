"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one). Two documents link when
100 x intersection >= ``PERCENT`` x union. Links are confirmed on the full sets, so no wrong link is made.

1. Signatures. A shingle's 64-bit hash is its place under one random permutation. The range of hashes is cut into
   ``BANDS * ROWS`` bins; a bin's value is the least hash in it. An empty bin takes the value of the first full one among
   bins drawn by a hash of (bin, attempt), the same draws for every document: each empty bin chooses independently, so a
   bin agrees with the chance of the similarity also where a set has fewer shingles than there are bins.
2. Buckets. ``ROWS`` values of a band are one bucket key; documents with the same set are one class and enter once. Of
   two classes with similarity s, a band agrees with chance s^ROWS: at s = 0.85 all 32 bands of 6 miss with a chance
   of 3e-7, at 0.9 with 1e-10.
3. Stars. In a bucket, one class is the centre and the others are paired with it alone: k - 1 candidates for k classes.
   Confirmed pairs tie components together; a bucket with one component left is done.
4. The rest. A star may miss a link between two members that are not like its centre. Buckets that still hold several
   components tie these to neighbourhoods (k - 1 edges between k components), and the classes of a neighbourhood are compared in
   tasks, by counting shared shingles for ``MOST`` classes at a time; a larger neighbourhood is cut into blocks, and each
   task gets two of them. So every two classes of a bucket are tied, or were compared: no link between members of a
   bucket is lost. Pairs that no star confirmed are never rows.
5. Confirming. A centre's members are dealt into slices of ``SLICE`` and slices into tasks by bytes of text; a task makes
   the sets from the texts. So a centre with any number of members is spread out. Only the texts of classes that share a
   bucket are moved.

Buckets are rows and are only counted, reduced by partial aggregates and joined, never gathered. Null or empty text, or text
without words, has no shingles and links with nothing. Repeated rows are rows of their own with the same set. The
component's id is the smallest in it; a null id counts only where there is no other. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm import blocks
from cuadre.llm.common import stage, text_or_empty
from cuadre.llm.ngram_join import components, shared_counts, shingle_sets

PERCENT = 85
BANDS, ROWS = 32, 6
#: Documents whose signatures are made at once, members of a centre in a slice, and bytes of text in a task.
BATCH, SLICE, TASK_BYTES = 512, 256, 16_000_000
#: Classes that one task compares after the stars.
MOST = 2048


def draws(bins: int, attempt: int) -> np.ndarray:
    """The bin that every empty bin looks at in an attempt."""
    return (blocks.mix64(np.arange(bins, dtype=np.uint64) + np.uint64((attempt + 1) << 20)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures of sets of sorted hashes, none empty."""
    edges = np.array([(k << 64) // bins for k in range(1, bins)], np.uint64)
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        first = np.concatenate([[0], np.searchsorted(s, edges)])
        full[i] = np.diff(np.append(first, len(s))) > 0
        out[i, full[i]] = s[first[full[i]]]
    one = full.sum(axis=1) == 1  # whatever is drawn
    out[one] = out[one].max(axis=1, keepdims=True)
    row, empty = np.nonzero(~full & ~one[:, None])
    attempt = 0
    while len(row):
        look = draws(bins, attempt)[empty]
        hit = full[row, look]
        out[row[hit], empty[hit]] = out[row[hit], look[hit]]
        row, empty = row[~hit], empty[~hit]
        attempt += 1
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band."""
    n, bins = signature.shape
    parts = signature.reshape(n, bands, bins // bands)
    key = np.broadcast_to(blocks.mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1)), (n, bands))
    for k in range(parts.shape[2]):
        key = blocks.mix64(key ^ parts[:, :, k]) + np.uint64(k + 1)
    return key.view(np.int64) if key.flags.c_contiguous else np.ascontiguousarray(key).view(np.int64)


def signed(batches):
    """(row, doc_id, text) with n, digest of the set and its band keys (none for an empty set)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            rows = batch.slice(at, BATCH)
            sets = shingle_sets(rows.column("text").to_pylist())
            has = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[i] for i in has], BANDS * ROWS), BANDS) if has else []
            bands, digest = [None] * len(sets), [None] * len(sets)
            for i, k in zip(has, keys):
                bands[i], digest[i] = k, hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*rows.schema.names, "n", "digest", "bands"])


def confirm(table: pa.Table) -> pa.Table:
    """Which pairs (centre a, member b) of a task link; a row without b has a centre's text."""
    a, b = table["a"].to_pylist(), table["b"].to_pylist()
    sets = shingle_sets(table["text"].to_pylist())
    centre = {x: s for x, y, s in zip(a, b, sets) if y is None}
    pairs = [(x, y, s) for x, y, s in zip(a, b, sets) if y is not None]
    linked = []
    for x, _, s in pairs:
        c = centre[x]
        same = int((c[np.minimum(np.searchsorted(c, s), len(c) - 1)] == s).sum())
        linked.append(100 * same >= PERCENT * (len(c) + len(s) - same))
    return pa.table({"a": pa.array([x for x, _, _ in pairs], pa.int64()), "b": pa.array([y for _, y, _ in pairs], pa.int64()), "linked": pa.array(linked, pa.bool_())})


def dealt(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (rep, ...) with the class's text; by a merge join at every size, as neither side is known to be small."""
    return rows.join(texts.hint("merge"), "rep")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of the pairs (a, b); ``texts`` has (rep, text)."""
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).withColumn("slices", F.ceil(F.col("k") / SLICE).cast("int"))
    members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), "b", F.col("b").alias("rep"))
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("b"), F.col("a").alias("rep"))
    rows = stage(dealt(members.unionByName(centres), texts), "members")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("a", "slice"), F.lit(tasks)).cast("int"))
    return rows.groupBy("task").applyInArrow(confirm, "a bigint, b bigint, linked boolean")


def compare(table: pa.Table) -> pa.Table:
    """A spanning forest of the links of every neighbourhood (or two blocks of one) in a task."""
    table = table.sort_by([("home", "ascending"), ("rep", "ascending")])
    home, rep, label = (table[c].to_numpy() for c in ("home", "rep", "label"))
    sets = shingle_sets(table["text"].to_pylist())
    cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
    out = []
    for x, y in zip(cut[:-1], cut[1:]):
        size = np.fromiter(map(len, sets[x:y]), np.int64, y - x)
        same = shared_counts(sets[x:y])
        i, j = np.nonzero((100 + PERCENT) * same >= PERCENT * np.add.outer(size, size))
        up = {}

        def top(v):
            while up.get(v, v) != v:
                v = up[v]
            return v

        for a, b in zip(i.tolist(), j.tolist()):
            if a < b and label[x + a] != label[x + b]:
                p, q = top(label[x + a]), top(label[x + b])
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((rep[x + a], rep[x + b]))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def neighbourhood_links(live: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links that tie the components of the open buckets ``live`` (bucket, rep, label), found by comparing all
    classes of a neighbourhood."""
    held = live.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    lead = held.groupBy("bucket").agg(F.min_by("label", F.xxhash64("label")).alias("a"))
    near = held.join(lead, "bucket").where("label <> a").select("a", F.col("label").alias("b")).distinct()
    homes = components(near).select(F.col("rep").alias("label"), F.col("label").alias("home"))
    classes = stage(live.select("rep", "label").distinct().join(homes, "label"), "homes")
    sizes = classes.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    rows = stage(dealt(classes.join(sizes, "home"), texts), "homes")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    small = rows.where(F.col("members") <= MOST).withColumn("task", F.concat(F.lit("t"), F.pmod(F.xxhash64("home"), F.lit(tasks)).cast("string")))
    parts = F.ceil(F.col("members") / (MOST // 2)).cast("int")
    large = rows.where(F.col("members") > MOST).withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    large = large.withColumn("task", F.concat_ws("/", "home", F.least("part", "other"), F.greatest("part", "other"))).drop("part", "other")
    return small.unionByName(large).select("task", "home", "rep", "label", "text").groupBy("task").applyInArrow(compare, "a bigint, b bigint")


def star_labels(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, label) of the classes tied to others, from ``posts`` (bucket, rep, n) of buckets with several classes."""
    turn = F.xxhash64("rep")
    centres = posts.groupBy("bucket").agg(F.min(F.struct(turn.alias("turn"), "rep", "n")).alias("c"))
    near = posts.join(centres, "bucket").where(F.col("rep") != F.col("c.rep")).where(100 * F.least("n", "c.n") >= PERCENT * F.greatest("n", "c.n"))
    pairs = stage(near.select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    labels = components(confirmed(pairs, texts).where("linked").select("a", "b"))

    live = posts.join(labels, "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    several = live.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    live = stage(live.join(several, "bucket"), "live")
    return labels if live.isEmpty() else joined(labels, neighbourhood_links(live, texts))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links (a, b); a component so far is a star around its label."""
    return components(links.unionByName(labels.where("rep <> label").select(F.col("label").alias("a"), F.col("rep").alias("b"))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and whether the row's id is that of its component."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kinds = f"row bigint, doc_id {src.schema['doc_id'].dataType.simpleString()}, text string, n bigint, digest binary, bands array<bigint>"
    sets = stage(src.mapInArrow(signed, kinds), "signed")
    able = sets.where("digest is not null")
    classes = stage(able.groupBy("digest").agg(F.min("row").alias("rep")), "classes")
    reps = able.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    posts = stage(reps.select(F.explode("bands").alias("bucket"), F.col("row").alias("rep"), "n"), "posts")
    met = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    met = stage(posts.join(met, "bucket"), "met")
    texts = stage(dealt(met.select("rep").distinct(), able.select(F.col("row").alias("rep"), "text")), "texts")
    labels = star_labels(met, texts)

    groups = classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rows = sets.select("row", "doc_id", "n", "digest").join(groups.select("digest", "label"), "digest", "left").withColumn("label", F.coalesce("label", "row"))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
