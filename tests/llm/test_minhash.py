import random
import re

import numpy as np
import pytest
from helpers import SF, edge_documents, rows, same

from quire.llm import linking, minhash, sets

NAMES = ["doc_id", "n_shingles", "component_id", "kept"]


def brute(docs, size=minhash.SHINGLE, similar=minhash.SIMILAR):
    """Every pair that shares a shingle, by Python sets."""
    found = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    distinct = list(dict.fromkeys(s for s in found if s))
    top = {s: s for s in distinct}

    def root(s):
        while top[s] is not s:
            s = top[s]
        return s

    where = {}
    for i, s in enumerate(distinct):
        both = {}
        for x in s:
            for j in where.setdefault(x, []):
                both[j] = both.get(j, 0) + 1
            where[x].append(i)
        for j, n in both.items():
            if 100 * n >= similar * (len(s) + len(distinct[j]) - n):
                top[root(s)] = root(distinct[j])
    least = {}
    for (d, _), s in zip(docs, found):
        if s and d is not None:
            least[root(s)] = min(d, least.get(root(s), d))
    out = [(d, len(s), least.get(root(s)) if s else d) for (d, _), s in zip(docs, found)]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


def check(docs):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs)
    assert got.columns == NAMES
    assert rows(got, NAMES) == brute(own)


def test_against_sql(spark):
    same(minhash.op12(spark, SF), minhash.SQL)


def test_edges(spark):
    docs = edge_documents(spark)
    check(docs)
    same(minhash.near_duplicates(docs), minhash.SQL, documents=docs.select("doc_id", "text"))
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def varied(r, base, changes):
    base = list(base)
    for _ in range(changes):
        base[r.randrange(len(base))] = f"n{r.randrange(10**6)}"
    return base


def planted(seed):
    """Chains of edits, so that ends are linked through the middle alone, families, copies and texts near the threshold."""
    r, data = random.Random(seed), []
    for size in [1, 2, 3, 5, 9, 15, 22, 40, 90, 200, 700]:
        text = [f"w{r.randrange(3000)}" for _ in range(size)]
        for _ in range(10):
            data.append(" ".join(text))
            text = varied(r, text, r.choice([0, 1, 1, size // 50, size // 25]))
        family = [f"f{r.randrange(3000)}" for _ in range(size)]
        data += [" ".join(varied(r, family, max(1, size // 30))) for _ in range(12)]
    data += [data[30]] * 20 + [data[31].upper()] * 3
    r.shuffle(data)
    return [(i if i % 50 else None, t) for i, t in enumerate(data)]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4), (3, 16)])
def test_chains_families_and_copies(spark, monkeypatch, seed, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "TESTS", 5)
    check(spark.createDataFrame(planted(seed), "doc_id long, text string").repartition(6))


def test_one_large_family_and_strangers(spark, monkeypatch):
    """A group in which most sets are connected, and some share much of the text without a link: these alone meet the others."""
    monkeypatch.setattr(linking, "BLOCK", 32)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    data = [(i, " ".join(varied(r, base, r.choice([1, 2, 3])))) for i in range(300)] + [(1000 + i, " ".join(varied(r, base, r.randrange(8, 14)))) for i in range(40)]
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(5))


def test_signatures():
    r = np.random.default_rng(3)
    miss, agree = 0, []
    for _ in range(400):
        a = r.integers(0, 2**63, 340, dtype=np.uint64)
        b = np.unique(np.concatenate((a[30:], r.integers(0, 2**63, 25, dtype=np.uint64))))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        assert 0.84 < both / (len(a) + len(b) - both) < 0.86
        x, y = minhash.signature(a), minhash.signature(b)
        agree.append((x == y).mean())
        h = minhash.band_hashes(np.stack((x, y)))
        miss += not (h[0] == h[1]).any()
    assert miss == 0 and abs(np.mean(agree) - 0.85) < 0.01 and min(agree) * minhash.MINIMA >= minhash.fewest()
    assert 95 <= minhash.fewest() <= 115
    one = sets.shingles("a b c d", 3)
    assert len(one) == 2 and len(minhash.signature(one)) == minhash.MINIMA
