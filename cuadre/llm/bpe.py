"""BPE encoding and decoding with a pair occurrence index.

The texts of a batch are cut into pre-tokens; each distinct pre-token is laid out once in one long token array. An
index maps every rank to the positions where its pair occurs. Active ranks are taken in ascending order: all positions
of the pair are merged at once, and the pairs that a merge creates on its left and right are added to the lists of
their own ranks. A merge can only create pairs of higher rank than its own (checked when the vocabulary is read), so
this gives what merging word by word gives.

Texts need no shuffle: each Arrow batch of a partition is encoded where it was read. Only the vocabulary, a file of a
fixed size, is broadcast.

Null text counts as empty: no ids, empty decoded text. Ties between positions of one pair go to the left. Rows that
repeat are encoded each; columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm.blocks import _BASE, mix64

#: The pre-token pattern of the byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK_CHARS = 6_000_000
#: Characters whose pre-tokens are found at once.
BLOCK_CHARS = 1_000_000
DECODE_TOKENS = 1_000_000
MAX_WORDS = 400_000
#: Kinds of characters, as the pattern tells them apart; ``ODD`` ones are left to the library.
LETTER, NUMBER, SPACE, OTHER, ODD, UNKNOWN = range(6)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.raw = raw
        as_byte = byte_symbols()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_count = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.byte_first = np.cumsum(self.byte_count) - self.byte_count
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in as_byte.items():
            self.of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.new = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left << 32 | self.right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.rank_type = np.uint16 if len(merges) <= 1 << 16 else np.int64  # short numbers sort faster
        two = np.arange(1 << 16)
        self.byte_pairs = self.ranks(self.of_byte[two >> 8], self.of_byte[two & 255])
        made = np.full(size, -1, np.int64)
        made[self.new] = np.arange(len(merges))
        ranks = np.arange(len(merges))
        if len(merges) and ((made[self.left] >= ranks).any() or (made[self.right] >= ranks).any()):
            raise ValueError("a merge uses a token that a later merge makes: ranks can't be applied in ascending order")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where no merge has it."""
        if not len(self.pair_keys):
            return np.full(len(a), -1, np.int64)
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


class PairIndex:
    """Positions of each rank's pair in one token array; positions of a word are chained by ``nxt`` and ``prv``."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        self.vocab = vocab
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.n = n = len(raw)
        self.tok = np.append(vocab.of_byte[raw], -1)  # one place past the end stands for "none"
        ends = np.cumsum(lens)
        self.nxt = np.arange(1, n + 2)
        self.prv = np.arange(-1, n)
        full = lens > 0
        self.nxt[ends[full] - 1] = n
        self.prv[(ends - lens)[full]] = n
        self.nxt[n] = self.prv[n] = n
        self.starts, self.ends = ends - lens, ends
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        pos = np.flatnonzero(self.nxt[:n] < n)
        self.add(pos, vocab.byte_pairs[raw[pos].astype(np.int64) << 8 | raw[self.nxt[pos]]])

    def add(self, pos: np.ndarray, r: np.ndarray | None = None) -> None:
        """Enter the pairs that begin at ``pos``."""
        if r is None:
            r = self.vocab.ranks(self.tok[pos], self.tok[self.nxt[pos]])
        pos, r = pos[r >= 0], r[r >= 0]
        if not len(pos):
            return
        order = np.argsort(r.astype(self.vocab.rank_type), kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.r_[0, cuts]].tolist(), np.split(pos, cuts)):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(part)

    def merge_all(self) -> None:
        v, tok, nxt, prv, n = self.vocab, self.tok, self.nxt, self.prv, self.n
        while self.active:
            rank = heapq.heappop(self.active)
            found = self.lists.pop(rank)
            pos = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
            a, b = v.left[rank], v.right[rank]
            pos = pos[(tok[pos] == a) & (tok[nxt[pos]] == b)]  # others went into an earlier merge
            if len(pos) > 1:
                pos = pos[np.r_[True, pos[1:] != pos[:-1]]]
                if a == b:  # in a run of the same token every second pair is used up by the one before
                    at = np.arange(len(pos))
                    first = np.r_[True, nxt[pos[:-1]] != pos[1:]]
                    pos = pos[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            tok[pos] = v.new[rank]
            tok[gone] = -1
            nxt[pos] = after
            prv[after] = pos
            before = prv[pos]
            prv[n] = n
            fresh = np.concatenate([pos[after < n], before[before < n]])
            if len(fresh):
                self.add(fresh)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in order, and how many each word has."""
        alive = self.tok[: self.n] >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return self.tok[: self.n][alive], count[self.ends] - count[self.starts]


def spans(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[f:f + c]`` of each pair (f, c), joined."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = i = len(self)
        return i


def token_starts(kind: np.ndarray, chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a pre-token, for texts that lie one after the other and begin at ``begins``."""
    n = len(chars)
    text = np.zeros(n + 1, bool)
    text[begins] = text[n] = True
    edge = text[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge)
    end = np.append(run[1:], n)
    goes_on = ~text[end]
    spaces = (kind[run] == SPACE) & goes_on
    out = edge
    out[end[spaces] - 1] = True  # the last white space before something else stands apart
    out[end[spaces & (chars[end - 1] == 0x20)]] = False  # and a space begins what follows
    quote = run[(end - run == 1) & (chars[run] == ord("'")) & goes_on]
    quote = quote[out[quote]]
    c, d = chars[quote + 1], np.append(chars, [0])[quote + 2]
    two = (np.isin(c, [ord("r"), ord("v")]) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))) & ~text[quote + 2]
    taken = np.where(np.isin(c, [ord(x) for x in "stmd"]), 1, 2 * two)
    quote, taken = quote[taken > 0], taken[taken > 0]
    out[quote + 1] = False
    after = quote + 1 + taken
    out[after[after < n]] = True
    return out


class Collision(Exception):
    """Two different pre-tokens have one hash."""


class Encoder:
    """Encodes batches of texts; pre-tokens already met in the partition keep their tokens.

    Texts are cut and their pre-tokens numbered by array operations: a 64-bit hash finds a pre-token's number, and its
    characters are then compared with those kept for the number; should they ever differ, the texts are encoded again
    with other hashes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.library = None
        self.seed = 0
        self.reset()

    def reset(self) -> None:
        """Forget all words; the first numbers are the special tokens'."""
        special = list(self.vocab.special.values())
        self.letter = mix64((np.arange(0x110000, dtype=np.uint64) + np.uint64(self.seed << 32 | 1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = np.zeros(len(special), np.int64)
        self.begin = np.zeros(len(special), np.int64)
        self.chars = np.zeros(0, np.uint32)
        self.fresh: list[bytes] = []
        self.flat = np.array(special, np.int32)
        self.count = np.ones(len(special), np.int64)
        self.first = np.arange(len(special))

    def kinds(self, chars: np.ndarray) -> np.ndarray:
        kind = self.kind[chars]
        for c in np.unique(chars[kind == UNKNOWN]).tolist():
            x = chr(c)
            # a character newer than this Python's tables may be a letter to one library and none to the other
            self.kind[c] = (ODD if unicodedata.category(x) == "Cn" else LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x)
                            else SPACE if regex.match(r"\s", x) else OTHER)
        return self.kind[chars]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special token."""
        if (self.kinds(np.frombuffer(text.encode("utf-32-le"), np.uint32)) == ODD).any():
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_str(self.vocab.raw.decode()).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return PATTERN.findall(text)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' pre-tokens, one after the other, and how many each text has."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n, lens = len(chars), np.fromiter(map(len, texts), np.int64, len(texts))
        if not n:
            return np.zeros(0, np.int64), lens
        ends = np.cumsum(lens)
        kind = self.kinds(chars)
        begins = token_starts(kind, chars, (ends - lens)[lens > 0])
        slow = set(np.searchsorted(ends, np.flatnonzero(kind == ODD), "right").tolist())
        special = {t: i for i, t in enumerate(self.vocab.special)}
        if any(t in joined for t in special):
            slow |= {i for i, text in enumerate(texts) if any(t in text for t in special)}
        marked = {}
        for i in slow:  # texts with special tokens or odd characters are cut one by one
            at = int(ends[i] - lens[i])
            begins[at:ends[i]] = False
            for part in self.vocab.split.split(texts[i]) if self.vocab.split else [texts[i]]:
                if part in special:
                    marked[at] = special[part]
                for piece in [part] if part in special else self.pieces(part):
                    begins[at] = True
                    at += len(piece)
        starts = np.flatnonzero(begins)
        numbers = self.numbered(joined, chars, starts)
        if marked:
            numbers[np.searchsorted(starts, list(marked))] = list(marked.values())
        before = np.append(0, np.cumsum(begins))
        return numbers, before[ends] - before[ends - lens]

    def numbered(self, joined: str, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each pre-token; new ones are entered as known, and as ``fresh`` for ``learn``."""
        n = len(chars)
        size = np.diff(np.append(starts, n))
        power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64), dtype=np.uint64)
        hashed = np.add.reduceat(self.letter[chars] * power[np.arange(n) - np.repeat(starts, size)], starts, dtype=np.uint64)
        hashed += size.astype(np.uint64)
        order = np.argsort(hashed)
        keys = hashed[order]
        head = np.append(True, keys[1:] != keys[:-1])
        keys, sample = keys[head], order[head]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        begin, many = starts[sample], size[sample]
        if (many[which] != size).any() or (chars[np.repeat(begin[which] - starts, size) + np.arange(n)] != chars).any():
            raise Collision
        at = np.searchsorted(self.hashes, keys)
        met = np.zeros(len(keys), bool)
        if len(self.hashes):
            met = self.hashes[np.minimum(at, len(self.hashes) - 1)] == keys
        number = np.empty(len(keys), np.int64)
        number[met] = old = self.numbers[at[met]]
        if (self.size[old] != many[met]).any() or (spans(self.chars, self.begin[old], many[met]) != spans(chars, begin[met], many[met])).any():
            raise Collision
        new = ~met
        number[new] = len(self.size) + np.arange(np.count_nonzero(new))
        self.hashes, self.numbers = np.insert(self.hashes, at[new], keys[new]), np.insert(self.numbers, at[new], number[new])
        self.begin = np.append(self.begin, len(self.chars) + np.cumsum(many[new]) - many[new])
        self.size = np.append(self.size, many[new])
        self.chars = np.append(self.chars, spans(chars, begin[new], many[new]))
        self.fresh += [joined[a:b].encode() for a, b in zip(begin[new].tolist(), (begin + many)[new].tolist())]
        return number[which]

    def learn(self) -> None:
        """Tokens of the words that are new since the last call."""
        if not self.fresh:
            return
        pairs = PairIndex(self.vocab, self.fresh)
        pairs.merge_all()
        flat, count = pairs.tokens()
        self.flat = np.concatenate([self.flat, flat])
        self.count = np.concatenate([self.count, count])
        self.first = np.cumsum(self.count) - self.count
        self.fresh = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.size) > MAX_WORDS:  # the next batch meets its words anew; bounds memory only
            self.reset()
        while True:
            try:
                found = [self.words(texts[a:b]) for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK_CHARS)]
                break
            except Collision:
                self.seed += 1
                self.reset()
        self.learn()
        out = []
        for w, n_words in found:
            count = self.count[w]
            before = np.append(0, np.cumsum(count))
            to = before[np.cumsum(n_words)]
            out += np.split(spans(self.flat, self.first[w], count), to[:-1])
        return out

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocab
        parts = [spans(v.all_bytes, v.byte_first[x], v.byte_count[x]).tobytes()
                 for x in (ids[i:i + DECODE_TOKENS] for i in range(0, len(ids), DECODE_TOKENS))]
        return b"".join(parts).decode("utf-8", "replace")


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    """The parsed vocabulary, kept for the life of a Python worker."""
    key = hash(raw)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(raw)
    return _VOCABULARIES[key]


def chunks(lens: np.ndarray, most: int = CHUNK_CHARS):
    """Ranges of rows of about ``most`` characters; a longer text ends its range."""
    step = np.cumsum(lens) // most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(lens)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def encoding(spark, vocab_path: str, id_bytes: int = 4, decode: bool = False):
    """A function for tasks: Arrow batches of (doc_id, text) to batches of what ``encode_documents`` returns."""
    with open(vocab_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        enc = Encoder(vocabulary(shared.value))
        for batch in batches:
            table = batch.column("text")
            lens = pc.utf8_length(table).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(lens):
                ids = enc.encode([t or "" for t in table.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype(f"<u{id_bytes}").tobytes() for x in ids], pa.binary()),
                    *([pa.array([enc.decode(x) for x in ids], pa.string())] if decode else []),
                ], names=["doc_id", "n_tokens", "ids", *(["decoded"] if decode else [])])

    return run


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                     id_bytes: int = 4, decode: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids`` (binary, little-endian unsigned of ``id_bytes``) and, if asked
    for, the ``decoded`` text."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    run = encoding(docs.sparkSession, vocab_path, id_bytes, decode)
    return src.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids binary" + ", decoded string" * decode)


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 of ids and decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
