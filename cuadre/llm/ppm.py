"""LM scoring by prediction by partial matching (PPM) over bytes, with a word unigram base beside it.

The model is a trie of byte contexts up to ``ORDER`` with the counts of the bytes that follow in training texts
(A-Z in lower case; a start mark fills the first contexts, an end mark closes each text). A byte's probability starts
at the longest context of the trie. A context gives each byte it has seen count / (total + distinct) and the rest, its
escape, goes to the context one byte shorter, where the bytes already seen are excluded from counts and totals; below
order 0 the bytes never seen share alike. So the 256 symbols of a context always add up to 1. The score is the sum of
log10 probabilities, the end mark's among them: an accumulated code length per document.

The trie is never in one place. Blocks of documents send their distinct (context, byte) pairs with training counts to
the shard of the context's last two bytes (``blocks``). All contexts that extend those two bytes meet there, so the
shard has the counts of every order from 2 on, with all escapes, and answers each block with the log-probability of
its pairs. Orders 1 and 0 are at most 65,536 counts: they are summed in Spark and sent to every shard. What is gathered
grows with the corpus; what is broadcast does not.

Words are treated likewise for the base: sum over words and one end of log10((c + 0.5) / (N + 0.5 (V + 1))). They are
known by a 64-bit hash.

Training texts are those whose crc32(id) mod 5 is not 1. Null text counts as empty and scores its end mark; a null id
counts as the empty string in the hash. Rows that repeat are learned and scored each; other columns are ignored.
Without training rows every symbol has 1/256. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm import blocks
from cuadre.llm.common import stage

ORDER = 5
BLOCK_BYTES = 24_000_000
FOLDS, HELD_OUT = 5, 1
MARK = 0xFF  # no byte of UTF-8; before a text it is the start, after it the end
END = np.uint64(0x5851F42D4C957F2D)  # key of the end token among word hashes


def planes(counts: np.ndarray) -> bytes:
    return blocks.planes(counts.astype("<i8"))


def from_planes(blob: bytes) -> np.ndarray:
    return blocks.from_planes(blob, "<i8")


def grams(part: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every byte and end mark of the texts, packed, and symbols per text."""
    pad = bytes([MARK]) * order
    raw = np.frombuffer(b"".join(x for b in part for x in (pad, b, pad[:0] + bytes([MARK]))), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, part), np.int64, len(part)) + 1
    g = np.zeros(len(raw) - order, np.uint64)
    for k in range(order + 1):
        g = (g << np.uint64(8)) | raw[k:len(raw) - order + k]
    if len(part) > 1:  # symbols of the start marks are not scored
        full = np.ones(len(g), bool)
        gap = (np.cumsum(lens + order) - order)[:-1]
        full[(gap[:, None] + np.arange(order)).ravel()] = False
        g = g[full]
    return g, lens


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts[order], new)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def symbol_logs(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 P(symbol | context) of each (context, symbol) in ``keys``; ``counts`` are of training texts.

    ``keys`` holds every pair seen in training whose context ends with the same two bytes as one of its own;
    ``low[c, s]`` counts symbol s after byte c in all training texts.
    """
    sym = (keys & np.uint64(0xFF)).astype(np.int64)
    last = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
    zero = low.sum(axis=0)

    def at(k):
        """Count of the pair, and total and distinct symbols of the context, for order k; pairs of each key."""
        if k == 1:
            return low[last, sym], low.sum(axis=1)[last], (low > 0).sum(axis=1)[last]
        if k == 0:
            return zero[sym], np.full(len(sym), zero.sum()), np.full(len(sym), (zero > 0).sum())
        pairs, back = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(back, weights=counts, minlength=len(pairs)).astype(np.int64)
        _, node = np.unique(pairs >> np.uint64(8), return_inverse=True)
        t = np.bincount(node, weights=c).astype(np.int64)
        q = np.bincount(node, weights=c > 0).astype(np.int64)
        levels[k] = pairs, c, node, back
        return c[back], t[node][back], q[node][back]

    levels: dict[int, tuple] = {}
    out = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    above_q = np.zeros(len(keys), np.int64)  # of the next longer context: distinct symbols, and their counts here
    above_x = np.zeros(len(keys), np.int64)
    for k in range(order, -1, -1):
        c, t, q = at(k)
        total, distinct = t - above_x, q - above_q
        whole = total + distinct
        hit = ~done & (c > 0)
        out[hit] += np.log10(c[hit] / whole[hit])
        done |= hit
        miss = ~done & (distinct > 0)
        out[miss] += np.log10(distinct[miss] / whole[miss])
        above_q = q
        if k == 0:
            break
        # counts, one order below, of the symbols that this context has seen
        if k >= 2:
            pairs, pc, node, back = levels[k]
            s, b = (pairs & np.uint64(0xFF)).astype(np.int64), ((pairs >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
            if k == 2:
                below = low[b, s]
            else:
                p2, inv = np.unique(pairs & np.uint64((1 << 8 * k) - 1), return_inverse=True)
                below = np.bincount(inv, weights=pc, minlength=len(p2))[inv]
            above_x = np.bincount(node, weights=np.where(pc > 0, below, 0)).astype(np.int64)[node][back]
        else:
            above_x = np.where(low > 0, zero, 0).sum(axis=1)[last]
    never = 256 - int((zero > 0).sum())
    out[~done] -= np.log10(max(1, never))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 2 <= order <= 7:
        raise ValueError("a context and its symbol must fit 8 bytes, and shards need two bytes of context")
    out_of = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    src, n_blocks = blocks.deal(docs, id_col, text_col, BLOCK_BYTES, [out_of.alias("held_out")])
    src = src.select("block", "doc_id", "text", "held_out")
    id_type = src.schema["doc_id"].dataType.simpleString()
    shards = n_blocks
    width = (1 << 64) // shards + 1

    def hashes(part):
        """Word hashes of a chunk, each text's end among them, and each token's text."""
        h, starts, _ = blocks.word_hashes(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        doc = np.searchsorted(np.cumsum([len(b) + 1 for b in part]), starts, side="right")
        return np.concatenate([h, np.full(len(part), END, np.uint64)]), np.concatenate([doc, np.arange(len(part))])

    def ask(table: pa.Table) -> pa.Table:
        held = table["held_out"].to_numpy()
        words, pairs = [], []
        for first, part in blocks.text_chunks(table["text"].to_pylist()):
            train = ~held[first:first + len(part)]
            h, doc = hashes(part)
            words += [tally(h[train[doc]]), (h[~train[doc]], np.zeros((~train[doc]).sum(), np.int64))]
            g, lens = grams(part, order)
            learn = np.repeat(train, lens)
            unseen, _ = tally(g[~learn])
            pairs += [tally(g[learn]), (unseen, np.zeros(len(unseen), np.int64))]
        out = {k: [] for k in ("shard", "kind", "keys", "counts")}

        def send(kind, shard, keys, counts):
            for name, v in zip(out, (shard, kind, blocks.pack(keys), planes(counts))):
                out[name].append(v)

        keys, counts = merged(words)
        cut = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) * np.uint64(width))
        for s, (k, c) in enumerate(zip(np.split(keys, cut), np.split(counts, cut))):
            if len(k):
                send("word", s, k, c)
        keys, counts = merged(pairs)
        send("low", -1, *tally(keys & np.uint64(0xFFFF), counts))
        shard = (blocks.mix64((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange(1, shards))
        for s, at in enumerate(np.split(by, cut)):
            if len(at):
                send("gram", s, keys[at], counts[at])
        n = len(out["shard"])
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "block": pa.array([table["block"][0].as_py()] * n, pa.int32()),
                         "kind": pa.array(out["kind"], pa.string()), "keys": pa.array(out["keys"], pa.binary()),
                         "counts": pa.array(out["counts"], pa.binary())})

    def low_counts(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(blocks.unpack(k).astype(np.int32)), pa.array(from_planes(c))], names=["pair", "n"])

    asked = stage(src.groupBy("block").applyInArrow(ask, "shard int, block int, kind string, keys binary, counts binary"), "asked")
    low = np.zeros((256, 256), np.int64)
    for r in asked.where("kind = 'low'").select("keys", "counts").mapInArrow(low_counts, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        low[r["pair"] >> 8, r["pair"] & 255] = r["n"]  # 65,536 rows at most

    def count(table: pa.Table) -> pa.Table:
        out = {k: [] for k in ("block", "kind", "shard", "keys", "values")}
        rows = list(zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist()))
        shard = table["shard"][0].as_py()

        def send(*row):
            for name, v in zip(out, row):
                out[name].append(v)

        for kind in ("word", "gram"):
            mine = [(b, blocks.unpack(k), from_planes(c), k) for b, t, k, c in rows if t == kind]
            keys, counts = merged([(k, c) for _, k, c, _ in mine])
            if kind == "word":
                send(-1, "total", shard, None, planes(np.array([counts.sum(), (counts > 0).sum()])))
            else:
                logs = symbol_logs(keys, counts, low, order) if len(keys) else np.zeros(0)
            for b, k, _, raw in mine:
                at = np.searchsorted(keys, k)
                send(b, kind, shard, None if kind == "word" else raw, planes(counts[at]) if kind == "word" else blocks.planes(logs[at].astype("<f4")))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "kind": pa.array(out["kind"], pa.string()), "shard": pa.array(out["shard"], pa.int32()),
                         "keys": pa.array(out["keys"], pa.binary()), "values": pa.array(out["values"], pa.binary())})

    told = stage(asked.where("kind <> 'low'").groupBy("shard").applyInArrow(count, "block int, kind string, shard int, keys binary, values binary"), "told")
    totals = told.where("kind = 'total'").select("values").mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays([pa.array([int(from_planes(v)[i]) for v in b.column("values").to_pylist()], pa.int64()) for i in (0, 1)], names=["n", "v"]) for b in it),
        "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_vocab = int(totals["n"] or 0), int(totals["v"] or 0)

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(zip(told["shard"].to_pylist(), told["kind"].to_pylist(), told["keys"].to_pylist(), told["values"].to_pylist()), key=lambda r: r[:2])
        counts = np.concatenate([np.zeros(0, np.int64)] + [from_planes(v) for _, kind, _, v in rows if kind == "word"])
        keys = np.concatenate([np.zeros(0, np.uint64)] + [blocks.unpack(k) for _, kind, k, _ in rows if kind == "gram"])
        logs = np.concatenate([np.zeros(0, "<f4")] + [blocks.from_planes(v, "<f4") for _, kind, _, v in rows if kind == "gram"])
        by = np.argsort(keys)
        keys, logs = keys[by], logs[by].astype(np.float64)
        size = table.num_rows
        scores = np.zeros(size)
        token, doc = [], []
        for first, part in blocks.text_chunks(table["text"].to_pylist()):
            h, d = hashes(part)
            token.append(h)
            doc.append(d + first)
            g, lens = grams(part, order)
            scores[first:first + len(part)] = np.add.reduceat(logs[np.searchsorted(keys, g)], np.cumsum(lens) - lens)
        _, word = np.unique(np.concatenate(token), return_inverse=True)
        c, doc = counts[word], np.concatenate(doc)
        base = np.log10((c + 0.5) / (n_train + 0.5 * (n_vocab + 1)))
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"],
                         "n_tokens": pa.array(np.bincount(doc, minlength=size)),
                         "n_known": pa.array(np.bincount(doc, weights=c > 0, minlength=size).astype(np.int64)),
                         "train_tokens": pa.array(np.full(size, n_train)),
                         "base_score": pa.array(np.bincount(doc, weights=base, minlength=size)), "score": pa.array(scores)})

    return src.groupBy("block").cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(
        answer, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
