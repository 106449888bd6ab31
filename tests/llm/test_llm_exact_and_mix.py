"""Exact dedup and mixing against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

from cuadre.llm import exact_dedup, mixing
from cuadre.llm.common import ranked


def brute_dedup(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        t = t or ""
        norm = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((-len(t), i is None, i or 0, n))
    out = Counter()
    for sha, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        for j, m in enumerate(sorted(members)):
            out[(None if m[1] else m[2], None if best[1] else best[2], len(members), j == 0, sha)] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_dedup_odd_rows(make_docs, odd_rows):
    assert found(exact_dedup.dedup(make_docs(odd_rows))) == brute_dedup(odd_rows)


def test_dedup_sample_and_runs(make_docs, sample_rows):
    docs = make_docs(sample_rows)
    want = brute_dedup(sample_rows)
    assert found(exact_dedup.dedup(docs)) == want
    assert found(exact_dedup.dedup(docs, runs=5, fan_in=2)) == want


def test_dedup_large_group(make_docs):
    rows = [(i, "same text" + " " * (i % 3)) for i in range(600)] + [(1000 + i, f"own {i}") for i in range(50)]
    assert found(exact_dedup.dedup(make_docs(rows))) == brute_dedup(rows)


def test_keep_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = Counter((r[0], r[-1]) for r in brute_dedup(odd_rows).elements() if r[3])
    got = Counter((r.doc_id, hashlib.sha256("".join(c for c in (r.text or "") if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()) for r in kept.collect())
    assert got == want


def test_dedup_empty(make_docs):
    assert exact_dedup.dedup(make_docs([])).count() == 0 and exact_dedup.keep_rows(make_docs([])).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    cap = {s: Fraction(2 * sizes[s]) for s in order}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > cap[s]}
        if not over:
            target |= {s: weight[s] * left / total for s in open_}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return target


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len([w for w in (t or "").encode().split() if w])
    want = brute_targets(sizes)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, float(want[r.source]), rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s]


def test_mix_odd_rows(make_docs, odd_rows):
    rows = [(i, t, lang, s) for i, t, lang, s in odd_rows]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)


def test_mix_sample(make_docs, sample_rows):
    docs = make_docs(sample_rows)
    got = mixing.mix(docs).collect()
    check_mix(sample_rows, got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    # systematic: the copies of a source up to any place differ from the expected number by less than one
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        rate = rs[0].target / rs[0].source_size
        assert abs(sum(r.copies for r in rs) - rate * len(rs)) < 1


def test_mixed_documents(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = mixing.mixed_documents(docs)
    assert got.dtypes == docs.dtypes
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_mix_empty_and_wordless(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    got = mixing.mix(make_docs([(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]


def test_ranked(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i * 7919 % 1000) for i in range(500)], "g int, v int")
    got = defaultdict(list)
    for r in ranked(df, ["v"], "g", partitions=6).collect():
        got[r.g].append((r.rank, r.v))
    for g in got.values():
        g.sort()
        assert [k for k, _ in g] == list(range(1, len(g) + 1)) and [v for _, v in g] == sorted(v for _, v in g)
