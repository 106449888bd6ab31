"""Language ID of whole texts: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its script (by code-point ranges) narrows the candidate languages to those that training
rows wrote in that script; its score per candidate is the log-likelihood of its character bigrams and trigrams under
a naive Bayes model. Viterbi finds the best sequence of languages over the words of a text, each change of language
costing ``PENALTY``; runs of one language are the spans. The prediction is the language with most letters, the score
its share of all letters.

The model is fitted on about ``TRAIN_ROWS`` rows of each language (all, where there are fewer), chosen by a hash of
the id: a documented bound, as is ``MAX_LANGS``, beyond which training raises an error. Its size is languages x
``BUCKETS``, so it can be collected and broadcast. Prediction reads every text whole, where it was scanned: no
shuffle.

Null or empty text and text without letters is ``und`` with score 0 and no spans. Ties go to the language that comes
first by code point. A null id counts as the empty string in the hash. Rows that repeat are predicted each; other
columns are ignored. Without any training row every text is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadre.llm.bpe import _Numbered, chunks
from cuadre.llm.common import broadcast_by_value, received

TRAIN_ROWS = 2000
MAX_LANGS = 512
BUCKETS = 1 << 16
PENALTY = 12.0
ALPHA = 0.2
OUTSIDE = 30.0
CANDIDATE_SHARE = 0.005
CHUNK_CHARS = 4_000_000
MAX_WORDS = 200_000
UNKNOWN = "und"

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: First code point of each range and its script; a range ends where the next begins.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"),
    (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every bigram and trigram with its word's number, and each word's script."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lens)
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(codes))
    two = at + 1 < ends
    three = at + 2 < ends
    mult = np.uint64(0x9E3779B97F4A7C15)
    padded = np.append(codes, np.zeros(2, np.uint64))
    nxt, nxt2 = padded[1:-1], padded[2:]
    pair = codes * np.uint64(0x1000193) + nxt
    triple = (pair * np.uint64(0x1000193) + nxt2) ^ np.uint64(1 << 60)
    bucket = lambda h: ((h * mult) >> np.uint64(48)).astype(np.int64) % BUCKETS
    first = np.cumsum(lens) - lens + 1
    return (np.concatenate([bucket(pair[two]), bucket(triple[three])]), np.concatenate([word[two], word[three]]),
            _SCRIPT[np.searchsorted(_STARTS, codes[first].astype(np.int64), side="right") - 1])


class Model:
    """Log-probabilities per language and bucket, and which languages are written in which script."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + ALPHA) / (total + ALPHA * BUCKETS)).astype(np.float32)
        share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
        outside = (share < CANDIDATE_SHARE) & (letters.sum(axis=0, keepdims=True) > 0)
        self.outside = np.where(outside, -OUTSIDE, 0.0).astype(np.float32)  # language x script

    def score(self, words: list[str]) -> np.ndarray:
        bucket, word, script = features(words)
        out = np.empty((len(words), len(self.langs)), np.float32)
        for i, logp in enumerate(self.logp):
            out[:, i] = np.bincount(word, weights=logp[bucket], minlength=len(words))
        return out + self.outside[:, script].T


def viterbi(scores: np.ndarray, lens: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word; ``scores`` has the words of all texts one after another, ``lens`` words per text.

    All texts of the batch step together, longest first, so that those still running are always the first k.
    """
    n_langs = scores.shape[1]
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    first, size = starts[order], lens[order]
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    change = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    value = np.zeros((len(size), n_langs), np.float64)
    for t, k in enumerate(running):
        at = first[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(k), best] - penalty
            switch = v < top[:, None]
            change[at] = switch
            source[at] = best
            v = np.where(switch, top[:, None], v)
        value[:k] = v + scores[at]
    label = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = first[:k] + t
        s = state[:k]
        label[at] = s
        state[:k] = np.where(change[at, s], source[at], s)
    return label


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with a language whose crc32(id) mod 5 is not 0, about ``train_rows`` of each language."""
    src = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      F.col(f"`{lang_col}`").alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in src.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes, key=lambda x: x.encode())
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_rows / sizes[lang]))]), F.col("lang"))
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)), np.int64)
        for batch in batches:
            index = [_Numbered() for _ in langs]
            times = [[] for _ in langs]
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                i = number[lang]
                w = WORDS.findall((text or "").lower())
                times[i].append(np.fromiter(map(index[i].__getitem__, w), np.int64, len(w)))
            for i in range(len(langs)):
                if index[i]:
                    words = list(index[i])
                    n = np.bincount(np.concatenate(times[i]), minlength=len(words))
                    bucket, word, script = features(words)
                    counts[i, :BUCKETS] += np.bincount(bucket, weights=n[word], minlength=BUCKETS).astype(np.int64)
                    letters = n * np.fromiter(map(len, words), np.int64, len(words))
                    counts[i, BUCKETS:] += np.bincount(script, weights=letters, minlength=len(SCRIPTS)).astype(np.int64)
        lang, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)),
                                          pa.array(counts[lang, slot])], names=["l", "slot", "n"])

    rows = src.where(part < keep).select("text", "lang").mapInArrow(count, "l int, slot int, n bigint")
    table = rows.groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x slots rows
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counts[table["l"].to_numpy(), table["slot"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def label_texts(model: Model, texts: list[str | None], index: _Numbered, known: np.ndarray, penalty: float):
    """Predictions, scores and spans of a batch; ``known`` has the scores of the words in ``index`` so far."""
    words = [np.zeros(0, np.int64)] * len(texts)
    if model.langs:
        for i, text in enumerate(texts):
            if text:
                w = WORDS.findall(text.lower())
                words[i] = np.fromiter(map(index.__getitem__, w), np.int64, len(w))
    if len(index) > len(known):
        fresh = list(index)[len(known):]
        new = np.column_stack([model.score(fresh), np.fromiter(map(len, fresh), np.float32, len(fresh))])
        known = np.concatenate([known, new])
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = known[np.concatenate(words)] if len(words) else known[:0]
    label = viterbi(flat[:, :-1], lens, penalty) if len(flat) else np.zeros(0, np.int16)
    doc = np.repeat(np.arange(len(texts)), lens)
    n = max(1, len(model.langs))
    letters = np.bincount(doc * n + label, weights=flat[:, -1], minlength=len(texts) * n).reshape(len(texts), n)
    some = lens > 0
    best = letters.argmax(axis=1)
    pred = [model.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
    score = np.where(some, letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1), 0.0)
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]) if len(doc) else np.zeros(0, np.int64)
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc[cut], np.arange(len(texts) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([
            pa.array([model.langs[i] for i in label[cut]], pa.string()),
            pa.array((cut - (np.cumsum(lens) - lens)[doc[cut]]).astype(np.int32)),
            pa.array(np.diff(np.append(cut, len(doc))).astype(np.int32))], names=["lang", "first_word", "words"]))
    return pred, score, spans, known


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = (), penalty: float = PENALTY) -> DataFrame:
    """Per row: doc_id, the ``carry`` columns, lang_pred, score and ``spans`` (language, first word, words)."""
    names = [f"c{i}" for i in range(len(carry))]
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])
    shared = broadcast_by_value(docs.sparkSession, model)  # languages x buckets
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text")

    def run(batches):
        m = received(shared)
        index, known = _Numbered(), np.zeros((0, len(m.langs) + 1), np.float32)
        for batch in batches:
            table = batch.column("text")
            for a, b in chunks(pc.utf8_length(table).fill_null(0).to_numpy(zero_copy_only=False), CHUNK_CHARS):
                if len(index) > MAX_WORDS:  # later words are scored anew; bounds memory only
                    index, known = _Numbered(), known[:0]
                pred, score, spans, known = label_texts(m, table.slice(a, b - a).to_pylist(), index, known, penalty)
                keep = [batch.column(n).slice(a, b - a) for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(pred, pa.string()), pa.array(score), spans],
                                                 names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score", "spans"])

    out = src.mapInArrow(run, f"{kept}, lang_pred string, score double, spans array<struct<lang string, first_word int, words int>>")
    return out.select("doc_id", *[F.col(n).alias(c) for c, n in zip(carry, names)], "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0,
                    penalty: float = PENALTY) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``) or whose score is under ``min_score``."""
    shared = broadcast_by_value(docs.sparkSession, model)  # languages x buckets

    def run(batches):
        m = received(shared)
        index, known = _Numbered(), np.zeros((0, len(m.langs) + 1), np.float32)
        for batch in batches:
            table = batch.column(text_col)
            for a, b in chunks(pc.utf8_length(table).fill_null(0).to_numpy(zero_copy_only=False), CHUNK_CHARS):
                if len(index) > MAX_WORDS:
                    index, known = _Numbered(), known[:0]
                pred, score, _, known = label_texts(m, table.slice(a, b - a).to_pylist(), index, known, penalty)
                good = [p != UNKNOWN and s >= min_score for p, s in zip(pred, score)]
                yield batch.slice(a, b - a).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
