"""Phrase collocation mining by direct-address tiling.

Texts, with A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces, and those at spaces and tabs into
words. Per language, the frequent phrases of 2 to ``LONGEST`` words are counted level by level:

1. Blocks. Each task turns its texts into blocks of about ``BLOCK_BYTES`` of one language: a stream of word numbers of
   the block's own, with a break after each piece, and the block's word list with counts.
2. Ranks. A block sends its words with their counts to shards of the words by hash; a shard adds them up. Words that
   occur ``MIN_COUNT`` times are numbered by falling frequency (number 0 is the most frequent), and the shards answer each
   block with the numbers of its own words. Other words break a phrase: every part of a phrase occurs at least as often
   as the phrase.
3. Tiles. A block's pairs of numbers fall into tiles of ``TILE`` x ``TILE`` cells. As the numbers are ranks, the leading
   tiles are dense: a tile with a pair for every ``SPARSE`` cells is counted by ``bincount`` over its cells, addressed
   directly. The pairs of all other tiles are sorted as coordinates and counted by runs. Both give the sorted distinct
   pairs of the block with their counts, which travel as gaps to shards of the pairs by hash and are added up there.
4. Recursion. Frequent pairs are numbered by falling frequency in turn, and the shards answer each block with the numbers
   of its own pairs. The block replaces its stream by the numbers of the pairs that start at each place; a pair of
   (number of the frequent phrase of k words, word that follows) is a phrase of k + 1 words, and its tiles are dense at the
   front again.

Every part of a candidate is itself frequent, so scores need only the tables of frequent phrases: l and r are joins on
them. Scores are integer divisions in decimal(38, 0). No corpus table is collected or broadcast; a block is bounded by its
bytes. Shards are by hash of the single word or pair and their number follows the number of words, so a shard holds about
``SHARD_WORDS`` entries; the most frequent pair of all is one entry for each block. A message from a block to a shard
holds one entry at least, so there are never more messages than distinct pairs of blocks.

Null text counts as empty, null lang as ``und``. Rows that repeat count each time. Words are byte strings, so any text
is whole; a piece never spans two texts. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuadre.llm import blocks
from cuadre.llm.common import ranked, stage, text_or_empty

LONGEST = 4
MIN_COUNT = 30
SCALE = 2_000_000
COVERED = 80
TOP = 2000
UNKNOWN = "und"

#: Text of a block, text that is split into words at once, and documents that are.
BLOCK_BYTES, CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 1_000_000, 256
#: Words of the corpus for each shard, and rows of a range partition where phrases are numbered.
SHARD_WORDS, PART_ROWS = 2_000_000, 1_000_000
#: Side of a tile, side of the square of tiles that may be dense, and cells for each pair from which a tile is sparse.
TILE, DENSE, SPARSE = 1024, 4096, 64
#: A pair is one 64-bit number: this many bits for the word, the others for the phrase before it.
WORD_BITS = 28

# fixed by the definition: A-Z in lower case, tab as space, and 0xFF, which is no byte of UTF-8, for the ends of a piece
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
_TABLE[0x09] = 0x20
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF
_TABLE = bytes(_TABLE)
_BREAK = b"\xff"


class Block:
    """Texts of one language as a stream of the block's own word numbers; 0 is a break."""

    def __init__(self):
        self.number = defaultdict(count(1).__next__)
        self.number[_BREAK] = 0
        self.streams, self.waiting, self.bytes, self.size = [], [], 0, 0

    def add(self, raw: bytes):
        self.waiting.append(raw)
        self.bytes += len(raw)
        self.size += len(raw)
        if self.bytes >= CHUNK_BYTES:
            self.split()

    def split(self):
        # bytes.split takes the white space of ASCII, of which the table left only the space
        tokens = _BREAK.join([*self.waiting, b""]).replace(_BREAK, b" \xff ").split()
        self.streams.append(np.fromiter(map(self.number.__getitem__, tokens), np.uint32, len(tokens)))
        self.waiting, self.bytes = [], 0

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        self.split()
        stream = np.concatenate(self.streams)
        words = [w.decode() for w in self.number if w != _BREAK]
        counts = np.bincount(stream, minlength=len(words) + 1)[1:].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([blocks.planes(stream)], pa.binary()),
             pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
            names=["block", "lang", "stream", "words", "counts"])


def stretches(text: str):
    """The text's bytes, mapped by the table; a long text in stretches that end with a piece."""
    raw, start = text.encode().translate(_TABLE), 0
    while len(raw) - start > CHUNK_BYTES:
        end = raw.find(_BREAK, start + CHUNK_BYTES)
        if end < 0:
            break
        yield raw[start:end]
        start = end + 1
    yield raw[start:]


def blocks_of(batches):
    """(block, lang, stream, words, counts) of (lang, text) batches: texts gather per language up to ``BLOCK_BYTES``."""
    part = TaskContext.get().partitionId()
    made, open_ = count(), defaultdict(Block)

    def close(lang):
        return open_.pop(lang).row((part << 32) | next(made), lang)

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            rows = batch.slice(at, CHUNK_ROWS)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                for raw in stretches(text):
                    open_[lang].add(raw)
                    if open_[lang].size >= BLOCK_BYTES:
                        yield close(lang)
            while sum(b.size for b in open_.values()) > 2 * BLOCK_BYTES:  # many languages at once
                yield close(max(open_, key=lambda x: open_[x].size))
    for lang in list(open_):
        yield close(lang)


def ask_words(shards: int):
    """A block's words for each shard, with their numbers in the block."""
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                counts = batch.column("counts")[i].values
                shard = np.fromiter((zlib.crc32(w.encode()) % shards for w in words.to_pylist()), np.int64, len(words))
                by = np.argsort(shard, kind="stable")
                for mine in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
                    if len(mine):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard[mine[0]]], pa.int32()), batch.column("block").slice(i, 1), batch.column("lang").slice(i, 1),
                             pa.array([blocks.planes((mine + 1).astype("<u4"))], pa.binary()),
                             pa.array([words.take(mine)], pa.list_(pa.string())), pa.array([counts.take(mine)], pa.list_(pa.int64()))],
                            names=["shard", "block", "lang", "at", "words", "counts"])
    return rows


ASKED_WORDS = "shard int, block bigint, lang string, at binary, words array<string>, counts array<bigint>"


def count_words(least: int):
    def counted(table: pa.Table) -> pa.Table:
        """The frequent words of a shard."""
        words, counts = table["words"].combine_chunks(), table["counts"].combine_chunks()
        lang = table["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))))
        found = pa.table({"lang": lang, "phrase": words.flatten(), "n": counts.flatten()}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        found = found.filter(pa.array(found["n_sum"].to_numpy() >= least))
        shard = pa.array(np.full(found.num_rows, table["shard"][0].as_py(), np.int32))
        return pa.table({"shard": shard, "lang": found["lang"], "phrase": found["phrase"], "f": found["n_sum"]})
    return counted


def answer_words(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each block, its numbers ``at`` and the global numbers of its frequent words."""
    number = dict(zip(zip(known["lang"].to_pylist(), known["phrase"].to_pylist()), known["number"].to_pylist()))
    ats, numbers = [], []
    for i, (lang, at) in enumerate(zip(asked["lang"].to_pylist(), asked["at"].to_pylist())):
        got = np.array([number.get((lang, w), -1) for w in asked["words"][i].as_py()], np.int64)
        ats.append(blocks.planes(blocks.from_planes(at, "<u4")[got >= 0]))
        numbers.append(blocks.planes(got[got >= 0]))
    return answers(asked, ats, numbers)


ANSWERS = "of bigint, keys binary, numbers binary"


def answers(asked: pa.Table, keys: list[bytes], numbers: list[bytes]) -> pa.Table:
    return pa.table({"of": asked["block"], "keys": pa.array(keys, pa.binary()), "numbers": pa.array(numbers, pa.binary())})


def pair_keys(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    if len(word) and (int(word.max()) >> WORD_BITS or int(phrase.max()) >> (63 - WORD_BITS)):
        raise ValueError("more frequent words or phrases than a pair's 63 bits can number")
    return (phrase << WORD_BITS) | word


def tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the distinct pairs and their counts, by tiles."""
    keys, counts = [], []
    front = (a < DENSE) & (b < DENSE)
    tile = np.where(front, a // TILE * (DENSE // TILE) + b // TILE, -1)
    filled = np.bincount(tile[front], minlength=(DENSE // TILE) ** 2)
    for t in np.flatnonzero(filled * SPARSE >= TILE * TILE):
        row, col = divmod(int(t), DENSE // TILE)
        mine = tile == t
        cells = np.bincount((a[mine] - row * TILE) * TILE + b[mine] - col * TILE, minlength=TILE * TILE)
        hit = np.flatnonzero(cells)
        keys.append(pair_keys(row * TILE + hit // TILE, col * TILE + hit % TILE))
        counts.append(cells[hit])
        a, b, tile = a[~mine], b[~mine], tile[~mine]
    rest = np.sort(pair_keys(a, b))
    new = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.zeros(0, np.int64)
    keys, counts = np.concatenate([*keys, rest[new]]), np.concatenate([*counts, np.diff(np.append(new, len(rest)))])
    order = np.argsort(keys, kind="stable")
    return keys[order].astype(np.int64), counts[order].astype(np.int64)


def places(phrase: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Where a phrase of k + 1 words can start: frequent phrases of k words at the place and at the next one."""
    if len(word) <= k:
        return np.zeros(0, np.int64)
    return np.flatnonzero((phrase[:len(word) - k] >= 0) & (phrase[1:len(word) - k + 1] >= 0))


def packed(x: np.ndarray) -> bytes:
    """Numbers from -1 on."""
    return blocks.planes((x + 1).astype("<u8"))


def unpacked(blob: bytes) -> np.ndarray:
    return blocks.from_planes(blob, "<u8").astype(np.int64) - 1


def ask_pairs(k: int, shards: int):
    """Counts of (phrase of k words, next word) in each block, for each shard."""
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                phrase, word = (unpacked(batch.column(c)[i].as_py()) for c in ("phrase", "word"))
                at = places(phrase, word, k)
                keys, counts = tally(phrase[at], word[at + k])
                shard = (blocks.mix64(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                parts = [p for p in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard[p[0]] for p in parts], pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()),
                     pa.array([batch.column("lang")[i].as_py()] * len(parts), pa.string()),
                     pa.array([blocks.pack(keys[p].astype(np.uint64)) for p in parts], pa.binary()), pa.array([blocks.planes(counts[p]) for p in parts], pa.binary())],
                    names=["shard", "block", "lang", "keys", "counts"])
    return rows


ASKED_PAIRS = "shard int, block bigint, lang string, keys binary, counts binary"


def count_pairs(least: int):
    def counted(table: pa.Table) -> pa.Table:
        """The frequent pairs of a shard."""
        out = {k: [] for k in ("lang", "keys", "f")}
        lang = np.array(table["lang"].to_pylist(), object)
        for one in sorted(set(lang)):
            mine = np.flatnonzero(lang == one)
            keys = np.concatenate([blocks.unpack(table["keys"][int(i)].as_py()) for i in mine])
            counts = np.concatenate([blocks.from_planes(table["counts"][int(i)].as_py(), "<i8") for i in mine])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            f = np.add.reduceat(counts[order], new) if len(new) else new
            out["keys"].append(keys[new][f >= least].astype(np.int64))
            out["f"].append(f[f >= least])
            out["lang"] += [one] * len(out["f"][-1])
        keys, f = np.concatenate(out["keys"]), np.concatenate(out["f"])
        return pa.table({"shard": pa.array(np.full(len(f), table["shard"][0].as_py(), np.int32)), "lang": pa.array(out["lang"], pa.string()),
                         "a": pa.array(keys >> WORD_BITS), "b": pa.array(keys & ((1 << WORD_BITS) - 1)), "f": pa.array(f.astype(np.int64))})
    return counted


def answer_pairs(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each block, the frequent ones among its pairs and their numbers."""
    lang = np.array(known["lang"].to_pylist(), object)
    keys, number = pair_keys(known["a"].to_numpy(), known["b"].to_numpy()), known["number"].to_numpy()
    tables = {}
    for one in set(lang):
        mine = np.flatnonzero(lang == one)
        mine = mine[np.argsort(keys[mine])]
        tables[one] = keys[mine], number[mine]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, numbers = [], []
    for one, wanted in zip(asked["lang"].to_pylist(), asked["keys"].to_pylist()):
        want = blocks.unpack(wanted).astype(np.int64)
        mine, known_as = tables.get(one, none)
        at = np.searchsorted(mine, want)
        at[at == len(mine)] = 0
        hit = mine[at] == want if len(mine) else np.zeros(len(want), bool)
        out.append(blocks.pack(want[hit].astype(np.uint64)))
        numbers.append(blocks.planes(known_as[at[hit]] if len(mine) else known_as))
    return answers(asked, out, numbers)


STREAMS = "block bigint, lang string, phrase binary, word binary"


def streams(block: pa.Table, phrase: bytes, word: bytes) -> pa.Table:
    return pa.table({"block": block["block"], "lang": block["lang"], "phrase": pa.array([phrase], pa.binary()), "word": pa.array([word], pa.binary())})


def number_words(block: pa.Table, known: pa.Table) -> pa.Table:
    """A block's stream in global word numbers; -1 for breaks and words that are not frequent."""
    local = blocks.from_planes(block["stream"][0].as_py(), "<u4")
    table = np.full(int(local.max(initial=0)) + 1, -1, np.int64)
    for at, numbers in zip(known["keys"].to_pylist(), known["numbers"].to_pylist()):
        table[blocks.from_planes(at, "<u4")] = blocks.from_planes(numbers, "<i8")
    word = packed(table[local])
    return streams(block, word, word)


def number_phrases(k: int):
    def renumber(block: pa.Table, known: pa.Table) -> pa.Table:
        """A block's stream with the numbers of the frequent phrases of k + 1 words in place of those of k words."""
        keys = np.concatenate([np.zeros(0, np.int64), *(blocks.unpack(x).astype(np.int64) for x in known["keys"].to_pylist())])
        number = np.concatenate([np.zeros(0, np.int64), *(blocks.from_planes(x, "<i8") for x in known["numbers"].to_pylist())])
        order = np.argsort(keys)
        keys, number = keys[order], number[order]
        same = block["word"][0].as_py()
        phrase, word = unpacked(block["phrase"][0].as_py()), unpacked(same)
        at = places(phrase, word, k)
        longer = np.full(len(word), -1, np.int64)
        if len(keys):
            want = pair_keys(phrase[at], word[at + k])
            spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            met = keys[spot] == want
            longer[at[met]] = number[spot[met]]
        return streams(block, packed(longer), same)
    return renumber


def numbered(frequent: DataFrame, ties: list[str], name: str) -> DataFrame:
    """``number`` from 0, per language by falling frequency ``f``."""
    rows = stage(frequent, name)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    order = rows.withColumn("less", -F.col("f"))
    return stage(ranked(order, ["less", *ties], group="lang", partitions=parts, name=name).withColumn("number", F.col("rank") - 1).drop("rank", "less"), name)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                     longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences; and (lang, phrase, size, f) of every phrase that occurs ``min_count`` times."""
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text_col).alias("text"))
    made = stage(src.mapInArrow(blocks_of, "block bigint, lang string, stream binary, words array<string>, counts array<bigint>"), "blocks")
    totals = stage(made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")), "totals")
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))

    asked = stage(made.select("block", "lang", "words", "counts").mapInArrow(ask_words(shards), ASKED_WORDS), "asked")
    level = numbered(asked.groupBy("shard").applyInArrow(count_words(min_count), "shard int, lang string, phrase string, f bigint"), ["phrase"], "words")
    words = level.select("lang", F.col("number").alias("b"), F.col("phrase").alias("last"))
    known = level.select(F.col("shard").alias("in_shard"), "lang", "phrase", "number")
    told = asked.groupBy("shard").cogroup(known.groupBy("in_shard")).applyInArrow(answer_words, ANSWERS)
    coded = stage(made.select("block", "lang", "stream").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(number_words, STREAMS), "coded")
    found = level.select("lang", "phrase", F.lit(1).alias("size"), "f")

    for k in range(1, longest):
        asked = stage(coded.mapInArrow(ask_pairs(k, shards), ASKED_PAIRS), "asked")
        often = asked.groupBy("shard").applyInArrow(count_pairs(min_count), "shard int, lang string, a bigint, b bigint, f bigint")
        counted = numbered(often, ["a", "b"], "phrases")
        shorter = level.select("lang", F.col("number").alias("a"), F.col("phrase").alias("start"))
        level = stage(counted.join(shorter, ["lang", "a"]).join(words, ["lang", "b"])
                      .select("shard", "lang", "a", "b", "number", "f", F.concat_ws(" ", "start", "last").alias("phrase")), "phrases")
        found = found.unionByName(level.select("lang", "phrase", F.lit(k + 1).alias("size"), "f"))
        if k + 1 < longest:
            known = level.select(F.col("shard").alias("in_shard"), "lang", "a", "b", "number")
            told = asked.groupBy("shard").cogroup(known.groupBy("in_shard")).applyInArrow(answer_pairs, ANSWERS)
            coded = stage(coded.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(number_phrases(k), STREAMS), "coded")
    return totals, found


#: Exact for counts up to 20 digits: products are decimals, and the quotient of integers is floored.
SCORE = f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)"


def part(words, first, size):
    return F.concat_ws(" ", F.slice(words, first, size))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, found = frequent_phrases(docs, text_col, lang_col, min_count, longest)
    found = stage(found, "found")
    whole = found.where("size > 1").withColumn("w", F.split("phrase", " ", -1))

    cut = whole.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part("w", F.lit(1), F.col("k")).alias("head"), part("w", F.col("k") + 1, F.size("w")).alias("tail"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")

    inner = whole.where("size > 2").select("lang", F.col("f").alias("longer"), "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    covers = inner.groupBy("lang", part("w", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    wide = "cast({} as decimal(20,0)) * {}"
    kept = best.join(covers, ["lang", "phrase"], "left").where(
        f"longer is null or {wide.format('longer', 100)} < {wide.format('a', COVERED)}")

    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    chosen = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return chosen.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
