import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tablewise.llm import simhash
from tablewise.llm.components import connected
from tests.llm.conftest import awkward_rows


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if words and not shingles:
        shingles = [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    """Root of each distinct fingerprint over links of at most two bits."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    return {p: find(p) for p in distinct}


def check(got, rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_roots(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    copies = Counter(prints)
    want = sorted(
        (repr(i), p, repr(least.get(roots[p])), copies[p],
         sum(0 < (p ^ q).bit_count() <= 2 for q in copies))
        for (i, _), p in zip(rows, prints)
    )
    assert sorted(
        (repr(r["id"]), r["print"] % 2**64, repr(r["component_id"]), r["copies"], r["links"])
        for r in got
    ) == want


def test_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    check(simhash.near_groups(documents).collect(), rows)


def test_awkward(clashing, no_docs):
    check(simhash.near_groups(clashing).collect(), [(r[0], r[1]) for r in awkward_rows()])
    assert simhash.near_groups(no_docs).collect() == []


def close_prints(seed, n):
    """Fingerprints in clusters, many of them a bit or two apart."""
    own = random.Random(seed)
    found = {0, 2**64 - 1, 1}
    while len(found) < n:
        p = own.getrandbits(64) if own.random() < 0.2 else own.choice(sorted(found)[:50])
        for _ in range(own.randrange(4)):
            p ^= 1 << own.randrange(64)
        found.add(p)
    return sorted(found)


@pytest.mark.parametrize("hot_node", [0, 3, 10**9])
def test_all_links(spark, hot_node):
    """Cutting crowded trie nodes changes the work, never the links."""
    prints = close_prints(5, 700)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    got = simhash.near_links(df.repartition(5), hot_node).collect()
    want = {
        (p, q) for i, p in enumerate(prints) for q in prints[:i] if (p ^ q).bit_count() <= 2
    }
    pairs = [tuple(sorted((r["u"] % 2**64, r["v"] % 2**64), reverse=True)) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_blocks_of_the_traversal(monkeypatch, block):
    monkeypatch.setattr(simhash, "_BLOCK", block)
    keys = np.array(close_prints(9, 300), np.uint64)
    zero = np.zeros(1, np.int64)
    frontier = (zero, zero, zero + len(keys), zero, zero + len(keys), zero)
    got = [p for a, b in simhash.join_tries(keys, frontier, 2) for p in zip(a, b)]
    want = {
        (i, j)
        for i in range(len(keys)) for j in range(i + 1, len(keys))
        if int(keys[i] ^ keys[j]).bit_count() <= 2
    }
    assert len(got) == len(want) and set(got) == want


def test_components(spark):
    own = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    links += [(own.randrange(300, 400), own.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = connected(spark.createDataFrame(links, "u long, v long")).collect()
    linked = {x for u, v in links if u != v for x in (u, v)}
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)


def test_dedup(clashing, no_docs):
    kept = simhash.near_dedup(clashing)
    assert kept.columns == clashing.columns
    rows = [(r[0], r[1]) for r in awkward_rows()]
    roots = brute_roots([brute_print(t) for _, t in rows])
    got = [roots[brute_print(r["text"])] for r in kept.collect()]
    assert len(got) == len(set(got)) == len(set(roots.values()))
    assert simhash.near_dedup(no_docs).collect() == []


def test_one_giant_component(spark):
    """A root that most links meet: a star, with a chain hanging on it, and small ones beside."""
    from tablewise.llm.components import connected

    star = [(i, 0) for i in range(1, 3000)]
    chain = [(2999 + i, 3000 + i) for i in range(40)]
    small = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(200)]
    links = spark.createDataFrame(star + chain + small, "u long, v long").repartition(7)
    got = dict(map(tuple, connected(links).collect()))
    assert got == {n: 0 for n in range(3040)} | {
        n: n - n % 2 for i in range(200) for n in (10_000 + 2 * i, 10_001 + 2 * i)
    }
