"""Exact counts of every column of a lake in one pass: rows, values, distinct values.

Each task takes the distinct values of one block of rows after the other, per column, and sends them on by hash: a message
is all values of a block that one shard of a column gets, packed in one cell. Low-cardinality columns shrink to a few
values a block, a hot value is one entry a block, and no task holds more than a block, so nothing spills before the
shuffle. A shard counts the distinct values of its messages; shards share no value, so the counts add up exactly.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Rows and bytes of a block.
BLOCK_ROWS = 1 << 18
BLOCK_BYTES = 24 << 20
#: Shards of a column (a power of two); only those that get a value exist.
SHARD_BITS = 9
MESSAGE = "c int, shard int, rows long, nonnull long, n long, packed binary"
COUNTS = "c int, rows long, nonnull long, distinct_values long"
_WEIGHTS = np.random.default_rng(20250909).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def _parts(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array without nulls."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], every[at[0]:at[-1]]


def _shards(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Shard of every value: a weighted sum of its bytes modulo 2^64, mixed."""
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at[:-1], np.diff(at))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 1023], dtype=np.uint64)])
    h = total[at[1:]] - total[at[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - SHARD_BITS)).astype(np.int16)  # sorted by radix


def _messages(first: int, block: pa.Table):
    """Messages of one block of rows; the columns are numbered from ``first``."""
    out = {f: [] for f in ("c", "shard", "rows", "nonnull", "n", "packed")}
    for i, col in enumerate(block.columns):
        nonnull = len(col) - col.null_count
        values = pc.drop_null(col.unique()).cast(pa.large_binary())
        bounds = [(0, 0, 0)]  # a column without values still has rows
        if len(values):
            at, data = _parts(values)
            shards = _shards(at, data)
            order = np.argsort(shards, kind="stable")
            at, data = _parts(values.take(pa.array(order)))
            found, starts = np.unique(shards[order], return_index=True)
            bounds = list(zip(found.tolist(), starts.tolist(), starts.tolist()[1:] + [len(values)]))
            sizes = np.diff(at).astype(np.uint32)
        for k, (shard, a, b) in enumerate(bounds):
            out["c"].append(first + i)
            out["shard"].append(shard)
            out["rows"].append(0 if k else len(col))
            out["nonnull"].append(0 if k else nonnull)
            out["n"].append(b - a)
            out["packed"].append(sizes[a:b].tobytes() + data[at[a]:at[b]].tobytes() if b > a else b"")
    types = {"c": pa.int32(), "shard": pa.int32(), "rows": pa.int64(), "nonnull": pa.int64(), "n": pa.int64(), "packed": pa.binary()}
    return pa.RecordBatch.from_pydict(out, schema=pa.schema(list(types.items())))


def _sender(first: int):
    def send(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield _messages(first, pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if rows:
            yield _messages(first, pa.Table.from_batches(held))
    return send


def _counted(messages: pa.Table) -> pa.Table:
    """One shard of a column: its distinct values."""
    sizes, data = [], []
    for n, packed in zip(messages["n"].to_pylist(), messages["packed"].to_pylist()):
        sizes.append(np.frombuffer(packed, np.uint32, n))
        data.append(memoryview(packed)[4 * n:])
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(b"".join(data))])
    return pa.table({"c": messages["c"][:1], "rows": [pc.sum(messages["rows"]).as_py()], "nonnull": [pc.sum(messages["nonnull"]).as_py()],
                     "distinct_values": pa.array([len(values.unique())], pa.int64())})


def column_counts(files: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(file_id, column, ordinal, rows, nonnull, distinct_values) of every column of (file_id, rows, columns), as text; a
    file without rows has none."""
    spark = files[0][1].sparkSession
    names, parts = [], []
    for file_id, df, cols in files:
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
        parts.append(text.mapInArrow(_sender(len(names)), MESSAGE))
        names += [(len(names) + i, file_id, c, i + 1) for i, c in enumerate(cols)]
    sent = reduce(DataFrame.unionByName, parts)
    per_shard = sent.groupBy("c", "shard").applyInArrow(_counted, COUNTS)
    counts = per_shard.groupBy("c").agg(*[F.sum(n).alias(n) for n in ("rows", "nonnull", "distinct_values")])
    return spark.createDataFrame(names, "c int, file_id string, column string, ordinal int").join(counts, "c").drop("c")
