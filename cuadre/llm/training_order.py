"""Training order: every fixed-length sequence of token ids gets a global slot, and slots are written as shards.

The documents' ids, each closed by an end id, are one stream in the order of the staged rows; it is cut into sequences of
``length`` ids that run across documents, so only the last is filled up with the pad id. A keyed Feistel permutation of
the sequences' numbers below the next power of four, walked in cycles until it falls below their count, gives each a
slot: a bijection that needs no table and no sort of the data by random keys. A shard holds ``shard_size`` slots of the
same stride, so slot s is at byte (s mod shard_size) x stride of shard s div shard_size and a reader resumes anywhere.

Ids are written once (staged, with each row's place in its partition) and moved once. The partitions' sums, one row per
task, make places global. The task that reads a piece of the stream cuts it and sends every shard its pieces, packed; the
task that receives a range of shards puts each together, writes its file and returns only its index. A document of any
length is cut where it lies, a sequence whose ids two tasks hold arrives in two pieces, and a shard with a missing
piece is an error.

Without ``tokens_col`` ids are UTF-8 bytes (0-255), end 256, pad 257, as unsigned 16-bit; ``tokens_col`` takes ids of
``id_bytes`` each from a binary column instead (as ``bpe.encode_documents`` makes them), ``encode`` makes such ids
of the texts in the task that reads them. They need an end and a pad id
that no token has: ``marks`` gives those of a vocabulary. An end id that is a special token may be in a text that spells
that token out, as for the tokenizer; a pad id in a text, or the byte ids' end in one, is an error. Null text counts as
empty: the end id alone. Rows that repeat, and ties and nulls of the id, are in the stream as often as they come. The same
files read in the same splits give the same slots; other splits another order. Other columns are ignored. An empty table
gives an empty result and no shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.llm.bpe import Vocabulary, spans
from cuadre.llm.common import stage, text_or_empty

LENGTH = 1024
SHARD_SIZE = 8192
KEY = "order-1"
ROUNDS = 4
#: Sequences that a task cuts at a time (a longer document is cut at once).
BATCH = 4096
#: Shards that a task is to receive, at most (if there are more, there are more tasks).
TASK_SHARDS = 16
END_ID, PAD_ID = 256, 257
END_TOKEN = "<|endoftext|>"
#: Columns of a piece: its slot and place in it, its ids, the place of the first in its document, its documents.
NUMBERS = ("slot", "at", "size", "token", "n_docs")


def round_keys(key: str, rounds: int = ROUNDS) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") | 1) for r in range(rounds)]


def slots(numbers: np.ndarray, count: int, key: str = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``count``."""
    half = np.uint64(max(1, -(-max(1, count - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = round_keys(key, rounds)

    def once(x):
        a, b = x >> half, x & low
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * (k | np.uint64(1))
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & low)
        return a << half | b

    out = once(numbers.astype(np.uint64))
    while (far := out >= count).any():  # walk the cycle back below the count
        out[far] = once(out[far])
    return out.astype(np.int64)


def marks(vocab: Vocabulary, end_id: int | None = None, pad_id: int | None = None) -> tuple[int, int]:
    """End and pad id for a vocabulary, checked against it: a special token or an id past it, and another id past it."""
    past = len(vocab.token_bytes)
    end = vocab.special.get(END_TOKEN, past) if end_id is None else end_id
    pad = max(past, end + 1) if pad_id is None else pad_id
    if end < past and end not in vocab.special.values():
        raise ValueError(f"end id {end} is an ordinary token")
    if pad < past or pad == end:
        raise ValueError(f"pad id {pad} is a token")
    return end, pad


def binaries(raw: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Binary values of ``lens`` bytes each, one after the other in ``raw``."""
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def lists(values: pa.Array, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), values)


class Cut:
    """How the stream is cut into sequences and put together as shards; holds plain values only, as tasks receive it."""

    def __init__(self, length: int, shard_size: int, key: str, pad: int, dtype: str, n_ids: int):
        self.length, self.shard_size, self.key, self.pad, self.dtype, self.n_ids = length, shard_size, key, pad, np.dtype(dtype), n_ids
        self.count = -(-n_ids // length)
        self.shards = -(-self.count // shard_size)
        self.stride = length * self.dtype.itemsize

    def pieces(self, batches):
        """Rows of the stream to pieces of sequences: a row for each shard that some rows have ids for."""
        length, codec = self.length, pa.Codec("zstd", compression_level=3)
        for batch in batches:
            begin, n = batch.column("begin").to_numpy(), batch.column("n").to_numpy()
            if not len(n):
                continue
            step = np.cumsum(n) // (BATCH * length)
            new = (begin[1:] != begin[:-1] + n[:-1]) | (step[1:] != step[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(n)]
            for a, b in zip(edges, edges[1:]):  # rows that follow each other in the stream
                raw = np.frombuffer(b"".join(batch.column("ids").slice(a, b - a).to_pylist()), self.dtype)
                start, stop = begin[a], begin[b - 1] + n[b - 1]
                first = np.concatenate([[start], np.arange((start // length + 1) * length, stop, length)])
                last = np.append(first[1:], stop)
                slot = slots(first // length, self.count, self.key)
                own = np.searchsorted(begin[a:b], first, "right") - 1
                n_docs = np.searchsorted(begin[a:b], last, "left") - own
                order = np.argsort(slot, kind="stable")
                slot, at, size, token, own, n_docs, first = (
                    x[order] for x in (slot, first % length, last - first, first - begin[a:b][own], own, n_docs, first))
                docs = batch.column("doc_id").take(pa.array(a + spans(np.arange(b - a), own, n_docs)))
                shard = slot // self.shard_size
                cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1])
                each = np.diff(np.append(cuts, len(slot)))
                ends = np.cumsum(np.add.reduceat(size, cuts))
                packed = [codec.compress(x.tobytes(), asbytes=True) for x in np.split(spans(raw, first - start, size), ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts]), *(lists(pa.array(x), each) for x in (slot, at, size, token, n_docs)),
                     lists(docs, np.add.reduceat(n_docs, cuts)), pa.array(packed, pa.binary())],
                    names=["shard", *NUMBERS, "docs", "packed"])

    def joined(self, batches):
        """(shard, index, ids) of every whole shard, from pieces in the order of shards."""
        shard, held = None, []
        for batch in batches:
            for i, s in enumerate(batch.column("shard").to_pylist()):
                if s != shard and held:
                    yield self.whole(shard, held)
                    held = []
                shard = s
                held.append({c: batch.column(c)[i].values.to_numpy() for c in NUMBERS}
                            | {"docs": batch.column("docs")[i].values, "packed": batch.column("packed")[i].as_py()})
        if held:
            yield self.whole(shard, held)

    def whole(self, shard: int, held: list[dict]):
        begin, length = shard * self.shard_size, self.length
        many = min(self.shard_size, self.count - begin)
        ids = np.full(many * length, self.pad, self.dtype)
        for p in held:
            flat = np.frombuffer(pa.decompress(p["packed"], int(p["size"].sum()) * self.dtype.itemsize, codec="zstd", asbytes=True), self.dtype)
            to = (p["slot"] - begin) * length + p["at"] - (np.cumsum(p["size"]) - p["size"])
            ids[np.repeat(to, p["size"]) + np.arange(len(flat))] = flat
        slot, at, size, token, n_docs = (np.concatenate([p[c] for p in held]) for c in NUMBERS)
        docs = pa.concat_arrays([p["docs"] for p in held])
        order = np.lexsort((at, slot))
        slot, at, size, token, from_doc, n_docs = (x[order] for x in (slot, at, size, token, np.cumsum(n_docs) - n_docs, n_docs))
        head = np.append(True, slot[1:] != slot[:-1])
        heads = np.flatnonzero(head)
        n_ids = np.add.reduceat(size, heads)
        want = np.full(many, length)
        final = int(slots(np.array([self.count - 1]), self.count, self.key)[0]) - begin
        if 0 <= final < many:
            want[final] = self.n_ids - (self.count - 1) * length
        if len(heads) != many or at[head].any() or (at[1:] != at[:-1] + size[:-1])[~head[1:]].any() or (n_ids != want).any():
            raise ValueError(f"shard {shard} has not got all its pieces")
        again = (~head & (token > 0)).astype(np.int64)  # begins in the document that the piece before ended in
        docs = docs.take(pa.array(spans(np.arange(len(docs)), from_doc + again, n_docs - again)))
        docs = lists(docs, np.add.reduceat(n_docs - again, heads))
        index = [pa.array(slot[heads]), pa.array(np.full(many, shard)), pa.array(np.arange(many) * self.stride),
                 docs.flatten().take(docs.offsets[:-1]), pa.array(token[heads]), pa.array(n_ids), docs]
        return shard, pa.RecordBatch.from_arrays(index, names=["slot", "shard", "shard_offset", "doc_id", "first_token", "n_tokens", "doc_ids"]), ids


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", tokens_col: str | None = None,
             length: int = LENGTH, shard_size: int = SHARD_SIZE, key: str = KEY,
             id_bytes: int = 4, end_id: int = END_ID, pad_id: int = PAD_ID, encode=None) -> tuple[DataFrame, Cut, str]:
    """Pieces of sequences, whole shards in every partition, in order; how to join them; the columns of their index.
    ``encode``, a function from batches of (doc_id, text) to batches that have (doc_id, ids), makes the ids in the same task."""
    of_bytes = tokens_col is None and encode is None
    width = 2 if of_bytes else id_bytes
    if max(end_id, pad_id) >> 8 * width or end_id == pad_id:
        raise ValueError(f"end id {end_id} and pad id {pad_id} must differ and fit {width} bytes")
    # no text may hold the pad id, nor the end id of bytes, which is no special token of any vocabulary
    barred = [] if of_bytes else [pad_id, *([end_id] if end_id == END_ID else [])]
    body = F.coalesce(F.col(f"`{tokens_col}`"), F.lit(b"")) if tokens_col else text_or_empty(text_col).cast("binary")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text") if encode else body.alias("ids"))
    id_type, dtype = src.schema["doc_id"].dataType.simpleString(), f"<u{width}"
    end = np.array([end_id], dtype).tobytes()

    def placed(batches):
        """Each row's place in its task's part of the stream, and its ids with their end."""
        from pyspark import TaskContext

        part, begin = TaskContext.get().partitionId(), 0
        for batch in encode(batches) if encode else batches:
            if not batch.num_rows:
                continue
            bodies = batch.column("ids").to_pylist()
            if of_bytes:
                bodies = [np.frombuffer(b, np.uint8).astype(dtype).tobytes() for b in bodies]
            n = np.fromiter(map(len, bodies), np.int64, len(bodies)) // width + 1
            flat = np.frombuffer(end.join(bodies) + end, dtype)
            for i in barred:  # the ends that were added are there by right
                if np.count_nonzero(flat == i) > (len(bodies) if i == end_id else 0):
                    raise ValueError(f"a text holds one of the ids {barred}, which are to mark end and padding")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()),
                                              pa.array(begin + np.cumsum(n) - n), pa.array(n), binaries(flat, n * width)],
                                             names=["doc_id", "part_no", "begin", "n", "ids"])
            begin += int(n.sum())

    rows = stage(src.mapInArrow(placed, f"doc_id {id_type}, part_no int, begin bigint, n bigint, ids binary"), "stream")
    sums = stage(rows.groupBy("part_no").agg(F.sum("n").alias("s")), "parts")
    how = Cut(length, shard_size, key, pad_id, dtype, int(sums.agg(F.sum("s").alias("s")).first()["s"] or 0))
    # one row for each task of the scan: the only table that is broadcast
    offsets = F.broadcast(sums.select("part_no", (F.sum("s").over(Window.orderBy("part_no")) - F.col("s")).alias("offset")))
    rows = rows.join(offsets, "part_no").select("doc_id", (F.col("begin") + F.col("offset")).alias("begin"), "n", "ids")
    made = rows.mapInArrow(how.pieces, "shard bigint, " + ", ".join(f"{c} array<bigint>" for c in NUMBERS) + f", docs array<{id_type}>, packed binary")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-how.shards // TASK_SHARDS))
    # slots fill 0 .. count - 1 evenly, so the ranges need no sample
    made = made.repartitionById(n, F.floor(F.col("shard") * n / max(1, how.shards)).cast("int")).sortWithinPartitions("shard")
    return made, how, ("slot bigint, shard bigint, shard_offset bigint, "
                       f"doc_id {id_type}, first_token bigint, n_tokens bigint, doc_ids array<{id_type}>")


def sequences(docs: DataFrame, **how) -> DataFrame:
    """Per sequence: slot, shard, shard_offset (bytes), the document and the place in it of its first id, n_tokens (without
    padding), ``doc_ids`` (the documents it holds ids of, in order) and ``ids`` (binary of the fixed stride). ``how``: the
    parameters of ``laid_out``."""
    made, cut, index = laid_out(docs, **how)

    def run(batches):
        for _, rows, ids in cut.joined(batches):
            for a in range(0, rows.num_rows, BATCH):
                some = rows.slice(a, BATCH)
                part = binaries(ids[a * cut.length:(a + some.num_rows) * cut.length], np.full(some.num_rows, cut.stride))
                yield pa.RecordBatch.from_arrays([*some.columns, part], names=[*some.schema.names, "ids"])

    return made.mapInArrow(run, index + ", ids binary")


def write_shards(docs: DataFrame, uri: str, rows: bool = False, **how) -> DataFrame:
    """Write the sequences as files ``shard-<number>.bin`` under ``uri`` (a folder that all executors can write to);
    returns the manifest (shard, first_slot, n_sequences, n_bytes, sha256) or, with ``rows``, the columns of ``sequences``
    with ``ids_sha256`` in place of ids. Each file is written under a name of its task and then moved, so a task that is
    repeated leaves the same file."""
    made, cut, index = laid_out(docs, **how)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        mine = TaskContext.get().taskAttemptId()
        for shard, table, ids in cut.joined(batches):
            raw = ids.tobytes()
            with store.open_output_stream(f"{root}/.tmp-{mine}-{shard}") as out:
                out.write(raw)
            store.move(f"{root}/.tmp-{mine}-{shard}", f"{root}/shard-{shard:08d}.bin")
            if rows:
                sums = [hashlib.sha256(raw[a:a + cut.stride]).hexdigest() for a in range(0, len(raw), cut.stride)]
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(sums)], names=[*table.schema.names, "ids_sha256"])
            else:
                yield pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": shard * cut.shard_size, "n_sequences": table.num_rows,
                                                   "n_bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}])

    return made.mapInArrow(run, index + ", ids_sha256 string" if rows else "shard bigint, first_slot bigint, n_sequences bigint, n_bytes bigint, sha256 string")
