"""The n-gram join against all pairs in plain Python."""

import random
from collections import defaultdict

import numpy as np

from cuadre.llm import blocks, ngram_join


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[top(k)] = top(j)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[top(k)].append(r[0])
    low = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return sorted(((r[0], len(sets[k]), low[top(k)]) for k, r in enumerate(rows)), key=str), len(ids)


def same(docs, rows):
    got = ngram_join.components_of(docs).collect()
    want, groups = brute(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert sum(r.stays for r in got) == groups


def test_odd_rows(make_docs, odd_rows):
    same(make_docs(odd_rows), odd_rows)


def test_sample(make_docs, sample_rows):
    same(make_docs(sample_rows), sample_rows)


def near_copies():
    """A large group of near copies of which many pairs are below the threshold, chains, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60):
        rows.append((1000 + i, " ".join([word() for _ in range(rng.randrange(0, 40))] + passage)))
    chain = list(base[:60])
    for i in range(25):
        chain = chain[2:] + [word(), word()]
        rows.append((2000 + i, " ".join(chain)))
    return rows


def test_near_copies(make_docs):
    rows = near_copies()
    same(make_docs(rows), rows)


def test_neighbourhoods_in_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST", 20)
    rows = near_copies()
    same(make_docs(rows), rows)


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(6)
    for columns in (2048, 7):
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        sets = [rng.choice(120, rng.integers(0, 60), replace=False).astype(np.int64) for _ in range(40)]
        got = ngram_join.shared_counts(sets)
        assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(40) for j in range(i + 1, 40))


def test_keep_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = ngram_join.keep_rows(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == brute(odd_rows)[1]


def test_empty(make_docs):
    assert ngram_join.components_of(make_docs([])).count() == 0
    assert ngram_join.components_of(make_docs([(1, None), (2, "  ")])).count() == 2


def test_prefix_is_never_too_short():
    """Two sets that share `need` tokens share at least l of their prefixes for every l."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        df = np.sort(rng.integers(2, 50, n)).astype(float)
        l, length = ngram_join.prefix_choice(n, 0, df)
        assert 1 <= l <= ngram_join.MOST_MATCHES and length == min(n, n - -(-80 * n // 100) + l)


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        k = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (blocks.unpack(blocks.pack(k)) == k).all()
    texts = ["one two\nthree", "", "ONE two"]
    h = [blocks.word_hashes(np.frombuffer(blocks.lower_bytes(t), np.uint8))[0].tolist() for t in texts]
    assert h[0][:2] == h[2] and h[1] == [] and len(set(h[0])) == 3
