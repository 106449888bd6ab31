"""Phrase mining against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuadre.llm import phrases


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, least, longest=4, top=2000):
    f = {}
    for _, t, lang, *_ in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(t)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        cand = {p: x for p, x in c.items() if len(p) > 1 and x >= least}
        gone = {p[i:i + m] for p, x in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * x >= 80 * c[p[i:i + m]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), " ".join(p), c[p[:k]], c[p[k:]]))
        for r, (s, a, _, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, r, p, -a, left, right, n, -s))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("block", [phrases.BLOCK_BYTES, 300])
def test_odd_rows(make_docs, odd_rows, monkeypatch, block):
    """Blocks of the usual size, and so small that long texts are cut at the ends of pieces."""
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", min(block, 100))
    rows = odd_rows + [(30, "São Paulo, new york; NEW YORK!new\tyork\x0bnew  york", None, "a"), (31, "a b c d e. a b c d e: a b c d x", "zz", None)]
    want = brute(rows, 2)
    assert found(phrases.collocations(make_docs(rows), min_count=2)) == want and len({r[0] for r in want}) > 2


def test_sample(make_docs, sample_rows):
    want = brute(sample_rows, 5)
    assert found(phrases.collocations(make_docs(sample_rows), min_count=5)) == want and any(r[2].count(" ") == 3 for r in want)
    assert found(phrases.collocations(make_docs(sample_rows), min_count=5, top=7)) == brute(sample_rows, 5, top=7)


def test_one_pair_in_a_third_of_all_rows(make_docs):
    rows = [(i, "of the " * 40 if i % 3 == 0 else f"w{i % 9} w{i % 7} of the w{i % 5}", "en", "a") for i in range(900)]
    assert found(phrases.collocations(make_docs(rows))) == brute(rows, 30)


def test_no_rows_and_nothing_frequent(make_docs):
    assert phrases.collocations(make_docs([])).count() == 0
    assert phrases.collocations(make_docs([(1, "a b c", "en", "a"), (2, None, None, None)])).count() == 0


def test_tiles_count_what_a_counter_counts():
    rng = np.random.default_rng(5)
    for size, scale in ((0, 10), (50, 10), (60_000, 300), (60_000, 40_000)):
        a, b = (rng.exponential(scale, size).astype(np.int64) for _ in "ab")
        a[:size // 9] += 1 << 33
        keys, counts = phrases.tally(a, b)
        assert (np.diff(keys) > 0).all()
        assert dict(zip(zip((keys >> phrases.WORD_BITS).tolist(), (keys & ((1 << phrases.WORD_BITS) - 1)).tolist()), counts.tolist())) == Counter(zip(a.tolist(), b.tolist()))
    with pytest.raises(ValueError):
        phrases.tally(np.array([1]), np.array([1 << phrases.WORD_BITS]))


def test_scores_past_64_bits(spark):
    rows = [(7 * 10**15 + 3, 9 * 10**15 + 1, 8 * 10**15 + 5), (30, 31, 30), (10**18, 10**18, 10**18)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", F.expr(phrases.SCORE).alias("score")).collect()
    assert {tuple(x) for x in got} == {(a, x, r, 2_000_000 * a // (x + r)) for a, x, r in rows}
