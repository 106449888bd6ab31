"""N-gram Jaccard join with adaptive multi-match prefixes: components of documents that share enough word shingles.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one). Two documents link when
100 x intersection >= 80 x union. The answer is exact, up to the 64-bit hashes that stand for shingles.

1. Document frequencies. Blocks of documents ask the shards of the shingle space for the frequency of each shingle
   (``blocks``). Frequencies are counted over the upper ``DF_BITS`` of the hash; a collision there only changes the
   order below, not the result.
2. Prefixes. Shingles are ordered by (frequency, hash). A document of n shingles can only link with one that shares
   need = ceil(0.8 n) of them, so one with fewer shingles of frequency 2 or more is out. For any l, two linked
   documents share at least l of their first n - need + l shingles. Each document picks the l up to ``MOST_MATCHES``
   that makes the estimated cost least: frequencies in its prefix, for looking up, plus ``VERIFY`` times those over l
   for verifying. A pair must share min(l, l') in both prefixes of that length before it is verified.
3. Classes. Documents with the same set are one class; only its representative goes on.
4. Neighbourhoods. Two linked classes share one of their shortest prefixes' shingles (l = 1), so each such shingle's
   list ties its members to one of them: k - 1 edges for k members, not k^2. Connected neighbourhoods of these edges
   hold every link. A neighbourhood of up to ``MOST`` classes is one task's (many small ones share a task); a larger
   one is cut into blocks, and each task gets two of them.
5. Links. A task counts shared prefix shingles of all its pairs (sparse lists for rare shingles, a matrix product for
   frequent ones), keeps pairs with min(l, l') or more, verifies those exactly and returns a spanning forest of the
   links. Pairs are never rows, and no link between different texts is lost. The components of the forests' edges are
   the result.

Null or empty text, or text without words, has no shingles and links with nothing. Repeated rows are rows of their own
with the same set. The component's id is the smallest id in it; a null id counts only where there is no other. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm import blocks
from cuadre.llm.common import free_names, stage, text_or_empty

WORDS = 5
PERCENT = 80
DF_BITS = 40
MOST_MATCHES = 16
VERIFY = 8.0
#: Classes that one task compares, shingles per task of small neighbourhoods, and how the counting is split.
MOST = 2048
TASK_SHINGLES = 4_000_000
RARE, COLUMNS = 8, 2048

_STEP = np.array([blocks.mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(WORDS)], np.uint64)


def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, part in blocks.text_chunks(texts):
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        h, starts, _ = blocks.word_hashes(raw)
        ends = np.cumsum([len(b) + 1 for b in part])
        cut = np.searchsorted(starts, ends)
        first = np.concatenate([[0], cut[:-1]])
        sh = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            sh += h[k:len(h) - words + 1 + k] * _STEP[k]
        sh = blocks.mix64(sh)
        for a, b in zip(first.tolist(), cut.tolist()):
            if b - a >= words:
                s = np.sort(sh[a:b - words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                with np.errstate(over="ignore"):
                    short = (h[a:b] * _STEP[:b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)
                out.append(blocks.mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def df_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) >> np.uint64(64 - DF_BITS) if sets else np.zeros(0, np.uint64)


def text_key(text_col: str):
    return F.xxhash64(text_or_empty(text_col))


def prefix_choice(n: int, unique: int, df: np.ndarray, most: int = MOST_MATCHES) -> tuple[int, int]:
    """Matches asked for and prefix length in shared shingles; ``df`` of the shared ones in order, after the unique."""
    need = -(-PERCENT * n // 100)
    cost = np.concatenate([[0.0], np.cumsum(df - 1.0)])
    l = np.arange(1, min(most, need) + 1)
    length = np.clip(n - need + l - unique, 0, len(df))
    total = cost[length] * (1 + VERIFY / l)
    best = int(total.argmin())
    return int(l[best]), int(length[best])


def prepared_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, n, digest of the set and, for rows that can link at all, shared shingles in
    prefix order."""
    src, n_blocks = blocks.deal(docs, id_col, text_col, columns=[text_key(text_col).alias("key")])
    src = src.select("block", "doc_id", "key", "text")
    id_type = src.schema["doc_id"].dataType.simpleString()
    shards = n_blocks
    width = (1 << DF_BITS) // shards + 1

    def ask(table: pa.Table) -> pa.Table:
        keys = np.sort(df_keys(shingle_sets(table["text"].to_pylist())))
        cut = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
        some = np.flatnonzero(np.diff(cut))
        block = table["block"][0].as_py()
        return pa.table({"shard": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), block, np.int32)),
                         "keys": pa.array([blocks.pack(keys[cut[s]:cut[s + 1]]) for s in some], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        asked = [blocks.unpack(b) for b in table["keys"].to_pylist()]
        keys = np.concatenate(asked)
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(new, len(keys)))
        shared = keys[new][times > 1]
        times = times[times > 1].astype("<u4")
        masks, found = [], []
        for a in asked:
            at = np.minimum(np.searchsorted(shared, a), max(0, len(shared) - 1))
            hit = shared[at] == a if len(shared) else np.zeros(len(a), bool)
            masks.append(np.packbits(hit).tobytes())
            found.append(blocks.planes(times[at[hit]]))
        return pa.table({"block": table["block"], "shard": table["shard"], "n": pa.array([len(a) for a in asked], pa.int32()),
                         "mask": pa.array(masks, pa.binary()), "df": pa.array(found, pa.binary())})

    def answer(table: pa.Table, counts: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"].to_pylist())
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = df_keys(sets)
        df = np.ones(len(keys), np.int64)
        rows = sorted(zip(counts["shard"].to_pylist(), counts["n"].to_pylist(), counts["mask"].to_pylist(), counts["df"].to_pylist()))
        if rows:
            in_order = np.ones(len(keys), np.int64)
            hit = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for _, n, m, _ in rows]).astype(bool)
            in_order[hit] = np.concatenate([blocks.from_planes(d, "<u4") for *_, d in rows])
            df[np.argsort(keys)] = in_order
        ends = np.cumsum(size)
        out = {k: [] for k in ("digest", "unique", "matches", "prefix", "shingles")}
        for s, a, b in zip(sets, (ends - size).tolist(), ends.tolist()):
            d = df[a:b]
            shared = d > 1
            k = int(shared.sum())
            if b > a and 100 * k >= PERCENT * (b - a):
                s_df, s_id = d[shared], s[shared]
                order = np.lexsort((s_id, s_df))
                l, length = prefix_choice(b - a, b - a - k, s_df[order])
                row = (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), b - a - k, l, length, s_id[order].view(np.int64))
            else:
                row = (None, None, None, None, None)
            for name, v in zip(out, row):
                out[name].append(v)
        return pa.table({"doc_id": table["doc_id"], "key": table["key"], "n": pa.array(size), "digest": pa.array(out["digest"], pa.binary()),
                         "unique": pa.array(out["unique"], pa.int64()), "matches": pa.array(out["matches"], pa.int32()),
                         "prefix": pa.array(out["prefix"], pa.int32()), "shingles": pa.array(out["shingles"], pa.list_(pa.int64()))})

    asked = src.groupBy("block").applyInArrow(ask, "shard int, block int, keys binary")
    counts = asked.groupBy("shard").applyInArrow(count, "block int, shard int, n int, mask binary, df binary")
    return src.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        answer, f"doc_id {id_type}, key bigint, n bigint, digest binary, unique bigint, matches int, prefix int, shingles array<bigint>")


def shared_counts(members: list[np.ndarray]) -> np.ndarray:
    """How many values each two arrays of distinct values share."""
    m = len(members)
    out = np.zeros((m, m), np.float32)
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(m), np.fromiter(map(len, members), np.int64, m))
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(flat)))
    for t in range(2, RARE + 1):
        cols = first[times == t]
        if len(cols):
            who = owner[cols[:, None] + np.arange(t)]
            i, j = np.triu_indices(t, 1)
            out += np.bincount((who[:, i] * m + who[:, j]).ravel(), minlength=m * m).reshape(m, m)
    often = np.flatnonzero(times > RARE)
    for at in range(0, len(often), COLUMNS):
        part = often[at:at + COLUMNS]
        x = np.zeros((m, len(part)), np.float32)
        rows = np.repeat(first[part], times[part]) + np.arange(times[part].sum()) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
        x[owner[rows], np.repeat(np.arange(len(part)), times[part])] = 1
        out += np.triu(x @ x.T, 1)
    return out


def forest(size: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], shingles: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what the links of these sets connect."""
    i, j = np.nonzero(shared_counts(prefixes) >= np.maximum(1, np.minimum.outer(matches, matches)))
    keep = (i < j) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    same = shared_counts([shingles[u] for u in used])[back[:len(i)], back[len(i):]]
    link = (100 + PERCENT) * same >= PERCENT * (size[i] + size[j])
    up = np.arange(len(size))
    edges = []
    for a, b in zip(i[link].tolist(), j[link].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            edges.append((a, b))
    return edges


def task_links(table: pa.Table) -> pa.Table:
    """Spanning links of every neighbourhood (or two blocks of one) in a task."""
    table = table.sort_by([("home", "ascending"), ("rep", "ascending")])
    home, rep, n = (table[c].to_numpy() for c in ("home", "rep", "n"))
    matches, prefix = table["matches"].to_numpy(), table["prefix"].to_numpy()
    column = table["shingles"].combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
    a_out, b_out = [], []
    for x, y in zip(cut[:-1], cut[1:]):
        for a, b in forest(n[x:y], matches[x:y], [s[:k] for s, k in zip(sets[x:y], prefix[x:y])], sets[x:y]):
            a_out.append(rep[x + a])
            b_out.append(rep[x + b])
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(rep, label): the smallest vertex reachable from each vertex of ``edges`` (a, b)."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = stage(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(near, F.col("rep") == F.col("a")).select("rep", "label", F.least("label", "l").alias("low"))
        jump = low.select(F.col("rep").alias("low"), F.col("low").alias("lower"))
        after = stage(low.join(jump, "low", "left").select("rep", F.col("label").alias("old"), F.coalesce("lower", "low").alias("label")), "labels")
        if after.where("label < old").isEmpty():
            return labels
        labels = after.select("rep", "label")


def link_labels(reps: DataFrame) -> DataFrame:
    """(rep, label) of the classes that are linked with another."""
    spark = reps.sparkSession
    shortest = F.greatest(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("unique"), F.lit(0)).cast("int")
    posts = reps.select("rep", F.explode(F.slice("shingles", F.lit(1), shortest)).alias("s"))
    leads = posts.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min_by("rep", F.xxhash64("rep")).alias("lead")).where("k > 1")
    near = posts.join(leads, "s").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    homes = components(near).withColumnRenamed("label", "home")
    sizes = stage(homes.groupBy("home").agg(F.count(F.lit(1)).alias("members")), "homes")
    members = reps.join(homes.join(sizes, "home"), "rep").select("home", "members", "rep", "n", "matches", "prefix", "shingles")
    total = members.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SHINGLES))
    small = members.where(F.col("members") <= MOST).withColumn(
        "task", F.concat(F.lit("t"), F.pmod(F.xxhash64("home"), F.lit(tasks)).cast("string")))
    parts = F.ceil(F.col("members") / (MOST // 2)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), parts).cast("int")
    large = members.where(F.col("members") > MOST).withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    large = large.withColumn("task", F.concat_ws("/", "home", F.least("part", "other"), F.greatest("part", "other"))).drop("part", "other")
    found = small.unionByName(large).drop("members").groupBy("task").applyInArrow(task_links, "a bigint, b bigint")
    return components(found)


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``row`` number, doc_id, ``key`` (hash of the text), n_shingles, component_id and whether the row stays
    (the first row of the smallest id of its component)."""
    sets = stage(prepared_sets(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    able = sets.where("digest is not null")
    classes = stage(able.groupBy("digest").agg(F.min("row").alias("rep")), "classes")
    reps = stage(able.join(classes.select("rep"), F.col("row") == F.col("rep"), "left_semi")
                 .select(F.col("row").alias("rep"), "n", "unique", "matches", "prefix", "shingles"), "reps")
    labels = link_labels(reps)
    groups = classes.join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    rows = sets.select("row", "doc_id", "key", "n", "digest").join(groups, "digest", "left").withColumn("label", F.coalesce("label", "row"))
    first = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"),
                                      F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    return rows.join(first, "label").select("row", "doc_id", "key", F.col("n").alias("n_shingles"), "component_id",
                                            (F.col("first.row") == F.col("row")).alias("stays"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, all columns as they were: the smallest id, of equal ids one row.

    Rows find their verdict by id and a 64-bit hash of their text.
    """
    key, verdict, k_id, k_key = free_names(docs, "text_key", "verdict", "k_id", "k_key")
    keyed = docs.withColumn(key, text_key(text_col))
    ident = F.col(f"`{id_col}`")
    found = components_of(docs, id_col, text_col).groupBy(F.col("doc_id").alias(k_id), F.col("key").alias(k_key))
    keep = stage(found.agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("same")).where("stays").drop("stays"), "keep")
    cols = [f"`{c}`" for c in docs.columns]
    match = (F.col(key) == F.col(k_key)) & ident.eqNullSafe(F.col(k_id))
    single, repeated = keep.where("same = 1").drop("same"), keep.where("same > 1").drop("same")
    one = keyed.join(single, match, "left_semi").select(*cols)
    if repeated.isEmpty():
        return one
    many = keyed.join(repeated, match, "left_semi").withColumn(verdict, F.struct(ident, F.col(key)))
    many = many.groupBy(verdict).agg(F.first(F.struct(*map(F.col, cols))).alias(key)).select(f"{key}.*")
    return one.unionByName(many)
