"""Each stage of the pipeline against brute force on its own input, written and read again as in production."""

import hashlib
import os
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_exact_and_mix import brute_dedup, brute_targets
from test_llm_models import library
from test_llm_ngram_join import brute as brute_join

from cuadre.llm import langid

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple(r)


def norm(t):
    return hashlib.sha256("".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()


def run_stages(spark, docs, folder):
    """Input and output of every stage."""
    out = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = os.path.join(folder, str(k))
        step(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def check(spark, docs, folder):
    stages = run_stages(spark, docs, folder)
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    rows = [(before.collect(), after.collect()) for _, before, after in stages]

    # language ID: exactly the rows that the operator labels, and those well enough, stay
    before, after = rows[0]
    model = langid.fit(stages[0][1])
    found = langid.identify(stages[0][1], model).collect()
    good = Counter((r.doc_id, r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SHARE) for r in found)
    assert len(after) == sum(n for (_, ok), n in good.items() if ok)
    assert Counter(map(key, after)) <= Counter(map(key, before))
    if model.langs:
        assert all(any(c.isalpha() for c in r.text) for r in after)

    # exact dedup: one row of each group, the longest, then the smallest id
    before, after = rows[1]
    kept = Counter((g[0], g[4]) for g in brute_dedup([(r.doc_id, r.text) for r in before]).elements() if g[3])
    assert Counter((r.doc_id, norm(r.text)) for r in after) == kept
    assert Counter(map(key, after)) <= Counter(map(key, before))

    # n-gram join: one row of each component, the one that gives it its id
    before, after = rows[2]
    members, groups = brute_join([(r.doc_id, r.text) for r in before])
    assert len(after) == groups and {r.doc_id for r in after} == {c for _, _, c in members}
    assert Counter(map(key, after)) <= Counter(map(key, before))

    # mixing: nothing but whole copies of kept rows, as many of each source as its target asks for
    before, after = rows[3]
    times = Counter(map(key, after))
    assert set(times) <= set(map(key, before))
    size = lambda r: len((r.text or "").encode().split())
    sizes, most, count, taken = defaultdict(int), defaultdict(int), Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r)
        most[r.source] = max(most[r.source], size(r))
        count[r.source] += 1
    for r in after:
        taken[r.source] += size(r)
    copies = Counter(r.source for r in after)
    for s, want in brute_targets(sizes).items():
        rate = float(want) / sizes[s] if sizes[s] else 0
        assert abs(copies[s] - rate * count[s]) < 1 and abs(taken[s] - want) <= 2 * most[s]
    same = Counter(map(key, before))
    assert all(n <= 2 * same[k] for k, n in times.items())

    # BPE: what the library gives
    before, after = rows[4]
    ids, decoded = library([r.text or "" for r in before])
    want = Counter((r.doc_id, len(i), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                   for r, i, d in zip(before, ids, decoded))
    assert Counter(map(tuple, after)) == want
    return rows


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(spark, docs, str(tmp_path))
    assert len(rows[0][1]) == len(rows[0][0])  # every document of the sample is clean prose in one language
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, rows[4][1]))


def test_stages_on_odd_rows(spark, make_docs, odd_rows, tmp_path):
    rows = check(spark, make_docs(odd_rows + [(100 + i, f"some words of text number {i} in this small corpus", "en", "abc"[i % 3]) for i in range(12)]), str(tmp_path))
    assert len(rows[0][1]) < len(rows[0][0])


def test_stages_on_no_rows(spark, make_docs, tmp_path):
    assert all(a == [] for _, a in check(spark, make_docs([]), str(tmp_path)))


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "bpe"]
