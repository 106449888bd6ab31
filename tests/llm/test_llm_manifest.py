"""The Merkle manifest against plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from cuadre.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """Last node and, per leaf, the (left, right) siblings of every level."""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for k, a in enumerate(at):
            run = a // 16 * 16
            paths[k].append((now[run:a], now[a + 1:run + 16]))
            at[k] = a // 16
        now = [sha("".join(now[r:r + 16])) for r in range(0, len(now), 16)]
    return now[0], paths


def brute(rows):
    groups = {}
    for i, text, lang, source, *n in rows:
        n = n[0] if n else None
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        leaf, changed = (sha("".join(map(sized, (i, source, lang, n, t)))) for t in (text, low))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, changed if hit else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = [tree([m[2] for m in sorted(groups[s])]) for s in order]
    if not below:
        return Counter()
    root, above = tree([b[0] for b in below])
    out = Counter()
    for s, (subroot, paths), high in zip(order, below, above):
        for (has_id, i, leaf, start), path in zip(sorted(groups[s]), paths):
            folded = start
            for left, right in path + high:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in path + high))
            out[(i if has_id else None, leaf, subroot, root, proof, folded, folded == root)] += 1
    return out


def found(df):
    return Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def test_odd_rows(make_docs, odd_rows):
    want = brute(odd_rows)
    assert found(merkle.manifest(make_docs(odd_rows))) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 16, 17, 257, 4097])
def test_sizes_of_a_group(make_docs, n):
    """One source of n rows: a lone leaf, one whole run, a run of one, several levels and windows."""
    rows = [(i * 7, f"Text {i}", "en", "only") for i in range(n)]
    assert found(merkle.manifest(make_docs(rows))) == brute(rows)


def test_many_sources_and_a_large_one(make_docs):
    rows = [(i, f"T{i % 50}", None, "big" if i % 3 == 0 else f"s{i % 40}") for i in range(600)]
    rows += [(None, None, None, None), (None, "A", None, None), (None, "A", None, None), (5, "é" * 3000 + "Z", "fr", "é")]
    assert found(merkle.manifest(make_docs(rows))) == brute(rows)


def test_no_rows(make_docs):
    assert merkle.manifest(make_docs([])).count() == 0


def test_a_changed_byte_is_seen(make_docs):
    rows = [(i, "Some Text", "en", f"s{i % 3}") for i in range(100)]
    got = merkle.manifest(make_docs(rows)).collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0)
