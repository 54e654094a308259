import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, edge_documents
from pyspark.sql import functions as F

from quire.llm import graph, partenum


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    post = defaultdict(list)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in post[x]:
                seen[j] += 1
            post[x].append(i)
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def check(docs):
    got = sorted(map(tuple, partenum.similar(docs).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    kept = partenum.one_of_each(docs)
    assert kept.columns == docs.columns
    expect = {c for d, n, c in want if n} - {None}
    have = [r.doc_id for r in kept.collect()]
    assert expect <= set(have)


def test_sample(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    check(edge_documents(spark))
    empty = edge_documents(spark).limit(0)
    assert partenum.similar(empty).collect() == [] and partenum.one_of_each(empty).collect() == []


def test_chains_and_copies(spark):
    r = random.Random(3)
    data, i = [], 0
    for size in [1, 4, 5, 8, 12, 20, 41, 90, 300]:
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        for _ in range(9):  # a chain of edits: ends may be unlike though all are connected
            data.append((i, " ".join(base)))
            i += 1
            base = list(base)
            for _ in range(r.choice([0, 1, 1, 2, size // 40])):
                base[r.randrange(len(base))] = f"w{r.randrange(5000)}"
            if r.random() < 0.3:
                base.insert(r.randrange(len(base)), "extra")
            if r.random() < 0.2 and len(base) > 1:
                base.pop(r.randrange(len(base)))
    data += [(i + k, data[20][1]) for k in range(50)]
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(6))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 9, 11, 14, 18, 23, 29, 37, 50, 64, 80, 120, 260, 500, 1500])
def test_every_partner_shares_a_signature(size):
    r = np.random.default_rng(size)
    for _ in range(60):
        a = r.integers(0, 2**63, size, dtype=np.uint64)
        gone = r.integers(0, size // 5 + 1)
        added = int(max(0, (size - gone) / 0.8 - size))
        added = r.integers(0, added + 1)
        b = np.concatenate((a[gone:], r.integers(0, 2**63, added, dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))


def test_components(spark):
    r = random.Random(5)
    for links in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(r.randrange(80), r.randrange(80)) for _ in range(70)], []):
        top = list(range(100))
        for u, v in links:
            a, b = top[u], top[v]
            top = [min(a, b) if x in (a, b) else x for x in top]
        got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
        assert got == {i: top[i] for u, v in links for i in (u, v) if u != v}
