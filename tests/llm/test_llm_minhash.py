"""MinHash near-dedup against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cuadre.llm import minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    met = {(i, j) for m in where.values() for i in m for j in m if i < j}
    for i, j in met:
        same = len(sets[i] & sets[j])
        if 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same):
            up[top(i)] = top(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    out = Counter()
    for i, (d, *_) in enumerate(rows):
        least = min((x for x in ids[top(i)] if x is not None), default=None)
        out[(d, len(sets[i]), least, d == least)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_sample(make_docs, sample_rows):
    want = brute(sample_rows)
    assert found(minhash.near_copies(make_docs(sample_rows))) == want and not all(r[3] for r in want)


def test_no_rows(make_docs):
    assert minhash.near_copies(make_docs([])).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_odd_rows_and_families_around_the_threshold(make_docs, odd_rows):
    """Odd rows, and families whose members share 75 to 100 % of their shingles with each other, chains among them, and
    short texts."""
    rng = random.Random(3)
    rows, i = [*odd_rows, (3, None), (None, " "), (3, "")], 1000
    for size in (6, 12, 40, 90, 200):
        for _ in range(12):
            base = words(rng, size)
            for _ in range(8):
                i += 1
                t = list(base)
                for _ in range(rng.randrange(0, max(2, size // 25))):
                    t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
                rows.append((i if i % 3 else None, " ".join(t[rng.randrange(3):len(t) - rng.randrange(3)])))
    want = brute(rows)
    assert found(minhash.near_copies(make_docs(rows))) == want
    assert 30 < len({r[2] for r in want}) < len(rows)


def test_one_template_holds_a_third(make_docs):
    """1,500 variants of a text: half link with the base, half only with a sibling or with none."""
    rng = random.Random(9)
    base = words(rng, 150)
    rows = []
    for i in range(1500):
        t = list(base)
        for p in rng.sample(range(150), 1 if i % 2 else 3 + i % 5):
            t[p] = f"v{i // 4}"
        rows.append((i, " ".join(t)))
    rows += [(5000 + i, " ".join(words(rng, 30))) for i in range(500)]
    want = brute(rows)
    assert found(minhash.near_copies(make_docs(rows))) == want


@pytest.mark.parametrize("n", [1, 2, 7, 100, 3000])
def test_signatures_agree_as_often_as_sets_are_similar(n):
    rng = np.random.default_rng(n)
    agree, similar = [], []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        more = rng.integers(0, 1 << 63, max(1, n // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        pair = [np.unique(both), np.unique(np.concatenate([both, more]))]
        a, b = minhash.signatures(pair, 192)
        agree.append((a == b).mean())
        similar.append(len(pair[0]) / len(pair[1]))
    assert abs(np.mean(agree) - np.mean(similar)) < 0.06


def test_densified_by_the_first_full_bin_drawn():
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 9, dtype=np.uint64) * np.uint64(2))
    bins = 32
    least = {}
    for x in s.tolist():
        least.setdefault(x * bins >> 64, x)
    want = []
    for k in range(bins):
        look, attempt = k, 0
        while look not in least:
            look, attempt = int(minhash.draws(bins, attempt)[k]), attempt + 1
        want.append(least[look])
    assert minhash.signatures([s], bins)[0].tolist() == want
