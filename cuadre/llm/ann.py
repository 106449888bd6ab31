"""Approximate nearest neighbours by inner product on shifted space-filling curves.

Every distinct vector gets ``CURVES`` keys. For each curve the vectors are projected onto ``DIMS`` orthonormal random
directions, scaled to a unit cube by mean and deviation, shifted by a random offset and placed on a Hilbert curve.
Keys have ``BITS`` bits a direction, so near but not equal vectors keep their order on the curve at their own scale; equal
keys are ordered by a projection of each curve's own. Spark range-partitions the (curve, key) pairs, so each vector has a rank on each curve; ranks are cut into cells of
``CELL`` rows. A query visits, on every curve, the cells within ``WINDOW`` of the rows around its own rank (at least
``LEAST`` rows on either side); each cell scores its visitors exactly, in double precision, and returns their best;
the windows' answers are merged and reranked.

Vectors without structure need windows in proportion to the table to keep the recall: the defaults find over 0.95 of
the true neighbours of random unit vectors in 64 dimensions, and ``CURVES`` windows together score more rows than the
table has (README).

Scaling is fitted on at most ``FIT_ROWS`` vectors, those of the smallest hash; all vectors are indexed. Null or zero
vectors, vectors with a null or non-finite component, rows with a null id and vectors that don't have the most common
dimension (of equally common ones the larger) take no part. Equal vectors are indexed once and answer with their
smallest ids, so a group of copies of any size is one point of the curve. A row that is repeated counts once; an id on
several vectors is several candidates and queries. Ties go to the smaller id. A query never returns its own id. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.llm.common import broadcast_by_value, ranked, received, stage

CURVES = 16
DIMS = 4
BITS = 30
WINDOW = 0.1
LEAST = 256
CELL = 4096
FIT_ROWS = 4096
SEED = 20
SLACK = 1e-9


def hilbert_words(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Place on the Hilbert curve of each row of integer coordinates below 2^bits, in words of at most 63 bits."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrorings of each level
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= turn
    words, per = [], 63 // dims
    for top in range(bits, 0, -per):
        key = np.zeros(x.shape[1], np.int64)
        for level in range(top - 1, max(0, top - per) - 1, -1):
            for d in range(dims):
                key = key << 1 | (x[d] >> level) & 1
        words.append(key)
    return words


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place as one number, for curves of at most 63 bits."""
    (key,) = hilbert_words(cells, bits)
    return key


class Curves:
    """Directions, scale and shifts of the curves for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.bits, self.dims = bits, min(dims, size)
        bases = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-curves * self.dims // (size // self.dims * self.dims)))]
        per = size // self.dims
        self.direction = [bases[c // per][:, c % per * self.dims:(c % per + 1) * self.dims] for c in range(curves)]
        self.mean = [sample.dot(d).mean(axis=0) for d in self.direction]
        self.scale = [np.maximum(sample.dot(d).std(axis=0), 1e-12) for d in self.direction]
        self.shift = [rng.random(self.dims) for _ in range(curves)]
        self.across = [rng.normal(size=size) for _ in range(curves)]

    def keys(self, x: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place on the curve in two words, and a projection that orders equal places."""
        z = (x.dot(self.direction[curve]) - self.mean[curve]) / self.scale[curve]
        unit = 0.5 * (1 + np.tanh(0.8 * z))  # close to the normal distribution function
        cube = (unit * 0.8 + self.shift[curve] * 0.2) * (1 << self.bits)
        words = hilbert_words(np.clip(cube.astype(np.int64), 0, (1 << self.bits) - 1), self.bits)
        return words[0], words[1] if len(words) > 1 else np.zeros_like(words[0]), x.dot(self.across[curve])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part, each once."""
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(good, F.lit(False)))
    common = v.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return v.where(F.size("vec") == (common["size"] if common else 0)).dropDuplicates(["id", "vec"])


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES,
           dims: int = DIMS, bits: int = BITS, window: float = WINDOW, least: int = LEAST, cell: int = CELL, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` largest inner products found for the rows where ``is_query(id)``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    same = Window.partitionBy("vec").orderBy("id")
    # the k + 1 smallest ids of each distinct vector; ``point`` is the smallest
    members = stage(rows.withColumn("nth", F.row_number().over(same)).withColumn("point", F.first("id").over(same)).where(F.col("nth") <= k + 1), "members")
    points = members.where("nth = 1").select("point", "vec", F.xxhash64("vec").alias("point_key"))
    n = points.count()
    sample = [r["vec"] for r in points.orderBy(F.xxhash64("point_key"), "point").limit(FIT_ROWS).select("vec").collect()]
    if not sample:
        return members.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    shared = broadcast_by_value(spark, Curves(np.array(sample), curves, dims, bits, seed))
    asked = stage(rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "vec"), "asked")
    asked = stage(asked.join(points.select("vec", "point"), "vec").select("query_id", "point"), "queries")
    ask_points = asked.select("point").distinct().withColumn("asks", F.lit(True))

    def place(batches):
        model = received(shared)
        for batch in batches:
            x = matrix(batch.column("vec"))
            for c in range(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), *map(pa.array, model.keys(x, c)), batch.column("point"), batch.column("vec"), batch.column("asks")],
                    names=["curve", "key", "fine", "tie", "point", "vec", "asks"])

    laid = points.select("point", "vec").join(ask_points, "point", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    laid = laid.mapInArrow(place, f"curve int, key bigint, fine bigint, tie double, point {id_type}, vec array<double>, asks boolean")
    laid = stage(ranked(laid, ["key", "fine", "tie", "point"], "curve", name="curve"), "ranks")
    half = max(least, int(np.ceil(n * window / 2)))
    here = F.floor((F.col("rank") - 1) / cell).cast("int")
    cells = laid.select("curve", here.alias("cell"), "point", "vec")
    low = F.floor((F.greatest(F.col("rank") - half, F.lit(1)) - 1) / cell).cast("int")
    high = F.floor((F.least(F.col("rank") + half, F.lit(n)) - 1) / cell).cast("int")
    visits = laid.where("asks").select("curve", F.explode(F.sequence(low, high)).alias("cell"), "point", "vec")

    def best(queries: pa.Table, found: pa.Table) -> pa.Table:
        q, x = matrix(queries["vec"]), matrix(found["vec"])
        ids = found["point"].combine_chunks()
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        x = x[order]
        out = []
        for a in range(0, len(q), 256):
            block = q[a:a + 256]
            near = block @ x.T
            if len(x) > k + 1:
                margin = SLACK * np.linalg.norm(block, axis=1) * np.linalg.norm(x, axis=1).max()
                edge = np.partition(near, len(x) - k - 1, axis=1)[:, len(x) - k - 1] - margin
                i, j = np.nonzero(near >= edge[:, None])
            else:
                i, j = np.divmod(np.arange(near.size), max(1, len(x)))
            s = (block[i] * x[j]).sum(axis=1)  # the same sum for the same pair in every cell
            by = np.lexsort((j, -s, i))
            i, j, s = i[by], j[by], s[by]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            top = nth <= k
            out.append((i[top] + a, j[top], s[top]))
        i, j, s = (np.concatenate([o[p] for o in out] + [np.zeros(0, t)]) for p, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query": queries["point"].combine_chunks().take(pa.array(i)), "point": ids.take(pa.array(order[j])), "score": pa.array(s)})

    found = visits.groupBy("curve", "cell").cogroup(cells.groupBy("curve", "cell")).applyInArrow(
        best, f"query {id_type}, point {id_type}, score double")
    first = lambda by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    merged = found.groupBy("query", "point").agg(F.max("score").alias("score")).withColumn("id", F.col("point"))
    merged = stage(merged.withColumn("nth", F.row_number().over(first(["query"]))).where(F.col("nth") <= k + 1).select("query", "point", "score"), "found")
    each = merged.join(members.select("point", "id"), "point")
    each = each.withColumn("nth", F.row_number().over(first(["query"]))).where(F.col("nth") <= k + 1)
    own = asked.join(each.select(F.col("query").alias("point"), "id", "score"), "point").where("id <> query_id")
    last = own.withColumn("rank", F.row_number().over(first(["query_id", "point"]))).where(F.col("rank") <= k)
    return last.select("query_id", "rank", "id", "score")
