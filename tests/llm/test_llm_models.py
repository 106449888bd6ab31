"""PPM, BPE and language ID against plain Python, the tokenizers library and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuadre.llm import bpe, langid, ppm
from cuadre.llm.queries import VOCABULARY


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def brute_ppm(rows, order):
    low = [(t or "").encode().lower() for _, t, *_ in rows]
    words, trie = Counter(), defaultdict(Counter)
    for (i, *_), b in zip(rows, low):
        if crc(i) % 5 != 1:
            words.update([*b.split(), "end"])
            s = b"\xff" * order + b + b"\xff"
            for p in range(order, len(s)):
                for k in range(order + 1):
                    trie[s[p - k:p]][s[p]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for (i, *_), b in zip(rows, low):
        tokens = [*b.split(), "end"]
        s, total = b"\xff" * order + b + b"\xff", 0.0
        for p in range(order, len(s)):
            seen = set()
            for k in range(order, -1, -1):
                left = {c: x for c, x in trie.get(s[p - k:p], {}).items() if c not in seen}
                whole = sum(left.values()) + len(left)
                if s[p] in left:
                    total += math.log10(left[s[p]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                seen |= set(left)
            else:
                total -= math.log10(256 - len(seen))
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, crc(i) % 5 == 1, len(tokens), sum(words[w] > 0 for w in tokens), n, base, total))
    return out


def close(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), round(r[6], 2))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5)


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_odd_rows(make_docs, odd_rows, order):
    rows = [r for r in odd_rows if r[0] not in (13, 19)] + [(19, "x" * 3000)]
    close(ppm.score(make_docs(rows), order=order).collect(), brute_ppm(rows, order))


def test_ppm_sample(make_docs, sample_rows):
    rows = sample_rows[:60]
    close(ppm.score(make_docs(rows)).collect(), brute_ppm(rows, ppm.ORDER))


def test_ppm_many_blocks(make_docs, sample_rows, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 3000)
    rows = sample_rows[:40]
    close(ppm.score(make_docs(rows), order=3).collect(), brute_ppm(rows, 3))


def test_ppm_symbols_add_up():
    """The probabilities of all 256 symbols after a context are 1."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 101, 400).astype(np.uint8))
    g, _ = ppm.grams([text], 3)
    keys, counts = ppm.tally(g)
    low = np.zeros((256, 256), np.int64)
    np.add.at(low, (((g >> np.uint64(8)) & np.uint64(255)).astype(int), (g & np.uint64(255)).astype(int)), 1)
    for context in (b"abc", b"zab", b"zzz", b"\xff\xff\xff"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        k, c = ppm.merged([(keys, counts), (np.sort(asked), np.zeros(256, np.int64))])
        logs = ppm.symbol_logs(k, c, low, 3)
        assert math.isclose((10 ** logs[np.isin(k, asked)]).sum(), 1, rel_tol=1e-9)


def test_ppm_empty_and_untrained(make_docs):
    assert ppm.score(make_docs([])).count() == 0
    alone = next(i for i in range(100) if crc(i) % 5 == 1)
    (r,) = ppm.score(make_docs([(alone, "ab")])).collect()
    assert (r.n_known, r.train_tokens) == (0, 0) and math.isclose(r.score, -3 * math.log10(256), rel_tol=1e-6)


def random_texts():
    rng = random.Random(1)
    pool = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1FAFF)])) for _ in range(300)]
    pool += list("  \n\n\t aaabbb 123 the and 's'll ՘Ᲊ꟎")
    return ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(1500)]


def library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_random_texts():
    texts = random_texts()
    enc = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    ids, decoded = library(texts)
    for a in range(0, len(texts), 400):  # later batches meet known words
        got = enc.encode(texts[a:a + 400])
        assert [g.tolist() for g in got] == ids[a:a + 400]
        assert [enc.decode(g) for g in got] == decoded[a:a + 400]
    assert decoded == texts


def test_bpe_runs_of_one_token():
    enc = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    texts = ["a" * n for n in range(70)] + ["ab" * n + "a" for n in range(30)] + [" " * n for n in range(40)] + ["=" * 999]
    assert [g.tolist() for g in enc.encode(texts)] == library(texts)[0]


def test_bpe_documents(make_docs, odd_rows, sample_rows):
    rows = odd_rows + sample_rows
    got = bpe.digests(bpe.encode_documents(make_docs(rows), VOCABULARY)).collect()
    ids, decoded = library([r[1] or "" for r in rows])
    want = Counter((r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                   for r, i, d in zip(rows, ids, decoded))
    assert Counter(map(tuple, got)) == want
    assert bpe.encode_documents(make_docs([]), VOCABULARY).count() == 0


def test_bpe_forgets_words_safely(sample_rows, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    enc = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    texts = [r[1] or "" for r in sample_rows[:40]]
    assert [enc.encode([t])[0].tolist() for t in texts] == library(texts)[0]


def test_bpe_many_texts_at_once(monkeypatch):
    """Texts of odd beginnings and ends side by side, in one array and in small ones."""
    rng = random.Random(12)
    bits = ["'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'l", "'r", "l", "e", "s", " ", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u00a0", "\u3000", "\u200b", "\x1c", "\x00",
            "word", "Été", "日本", "١٢", "12", "½", "!", "?!", "…", "é", "e\u0301", "😀", "\ua7ce", "\U000323b0", "<|endoftext|>", "<|endof", "text|>", "ǅ", "ª", "Ⅷ", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 9))) for _ in range(30000)]
    want = library(texts)[0]
    enc = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert [x.tolist() for x in enc.encode(texts[:500])] == want[:500]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    assert [x.tolist() for x in bpe.Encoder(enc.vocab).encode(texts[:3000])] == want[:3000]
    assert enc.encode([]) == [] and [x.tolist() for x in enc.encode(["", ""])] == [[], []]


@pytest.mark.parametrize("known", [False, True])
def test_bpe_hashes_that_collide(known):
    texts = ["ab ba abc cab bca", " it's its 'tis", "aa bb"] * 3
    enc = bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, "rb").read()))
    enc.letter = np.ones_like(enc.letter)  # words of one length are alike
    if known:
        assert [x.tolist() for x in enc.encode(["zz"])] == library(["zz"])[0] and enc.seed == 0
    assert [x.tolist() for x in enc.encode(texts[2:3] if known else texts)] == library(texts[2:3] if known else texts)[0] and enc.seed == 1
    assert [x.tolist() for x in enc.encode(texts)] == library(texts)[0]


def test_bpe_refuses_unordered_ranks():
    raw = '{"added_tokens": [], "model": {"vocab": {%s, "ab": 256, "abc": 257}, "merges": [["ab", "c"], ["a", "b"]]}}'
    import json
    vocab = ", ".join(f"{json.dumps(c)}: {b}" for c, b in bpe.byte_symbols().items())
    with pytest.raises(ValueError):
        bpe.Vocabulary((raw % vocab).encode())
    assert public_tokenizers.path("byte_bpe_50k.json") == VOCABULARY


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    lens = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(size=(lens.sum(), 3)) * 2
    label = langid.viterbi(scores, lens, 1.5)
    at = 0
    for n in lens:
        s = scores[at:at + n]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert math.isclose(value(best), value(label[at:at + n]))
        at += n


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs), carry=("lang",)).select("doc_id", langid.held_out("doc_id").alias("h"), "lang", "lang_pred", "score").collect()
    assert {r.h == (crc(r.doc_id) % 5 == 0) for r in got} == {True}
    held = [r for r in got if r.h]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_spans_scripts_and_odd_rows(make_docs, odd_rows):
    en, fr = "the cat sat on the mat and then went to the house of the man ", "le chat est dans la maison avec les enfants et une grande table "
    ru = "кошка сидит на столе и смотрит в окно "
    train = [(i, (en, fr, ru)[i % 3] * 3, ("en", "fr", "ru")[i % 3], None) for i in range(60)]
    model = langid.fit(make_docs(train))
    assert model.langs == ["en", "fr", "ru"]
    rows = [(900, en * 2 + fr * 2 + ru, None, None), *odd_rows]
    got = [(r.doc_id, r.lang_pred, r.score, r.spans) for r in langid.identify(make_docs(rows), model).collect()]
    mixed = next(g for g in got if g[0] == 900)
    assert [s.lang for s in mixed[3]] == ["en", "fr", "ru"] and [s.first_word for s in mixed[3]] == [0, 2 * len(en.split()), 2 * len((en + fr).split())]
    assert len(got) == len(rows)
    for g, r in zip(sorted(got, key=lambda g: str(g[:2])), sorted(rows, key=lambda r: str(r[0]))):
        assert 0 <= g[2] <= 1
    by = {r[0]: r[1] for r in rows}
    for i, pred, score, spans in got:
        if i is not None and not any(c.isalpha() for c in by[i] or ""):
            assert (pred, score, spans) == ("und", 0.0, [])
        elif i in (4, 10):
            assert pred in model.langs
    assert next(g for g in got if g[0] == 10)[1] == "ru"
    kept = langid.keep_identified(make_docs(rows), model)
    assert kept.count() == sum(g[1] != "und" for g in got) and kept.dtypes == make_docs(rows).dtypes


def test_langid_untrained_and_empty(make_docs):
    docs = make_docs([(1, "some text", None, None), (2, None, None, None)])
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()] == [("und", 0.0)] * 2
    none = make_docs([])
    assert langid.identify(none, langid.fit(none)).count() == 0
