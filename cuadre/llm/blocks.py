"""Blocks: bounded groups of whole documents that ask a corpus-wide table for what they need.

Corpus statistics (document frequencies, counts) are too large to broadcast and too many to join row by row. So
documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash; a block's task sends its distinct keys, as
one packed array per shard of the key space; each shard's task merges what all blocks sent and answers every block in
the order of its request; the block's answers then meet its documents again (cogroup on the block, which reuses the
exchange that dealt the documents out). Work per task is bounded by the block and shard sizes: both numbers follow the
size of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm.common import text_or_empty

BLOCK_BYTES = 12_000_000
#: Documents are handled in chunks of about this many bytes inside a block; a longer one is a chunk of its own.
CHUNK_BYTES = 2_000_000
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def deal(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, columns=()) -> tuple[DataFrame, int]:
    """(block, doc_id, text, ``columns``) with null text as empty, and the number of blocks."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), *columns)
    total = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(8, -(-int(total) // block_bytes))
    return src.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(n)).cast("int")), n


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes of small numbers are nearly all zeros."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, as gaps."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, "<u8"), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)


def lower_bytes(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8").lower()


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word in ``raw`` (bytes, words apart by ASCII white space)."""
    space = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lens = ends - starts
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lens) - lens, lens)
    power = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64), dtype=np.uint64)
    h = np.add.reduceat(_LETTER[raw[inside]] * power[place], np.cumsum(lens) - lens, dtype=np.uint64)
    return mix64(h + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts, ends


def text_chunks(texts, most: int = CHUNK_BYTES):
    """(first row, [lower-case bytes]) for runs of rows of about ``most`` bytes."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = lower_bytes(t)
        if part and size + len(b) > most:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield first, part
