import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SF, edge_documents

from quire.llm import suffixes


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + 400]) for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[hash(d[i : i + 400])] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]))), key=repr)
    assert sorted(map(tuple, suffixes.digest(docs).collect()), key=repr) == want
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns
    assert cut.count() == sum(1 for w in want if w[1] == 0 or w[1] > w[2])


def test_sample(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    check(edge_documents(spark))
    assert suffixes.digest(edge_documents(spark).limit(0)).collect() == []
    assert suffixes.without_repeats(edge_documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 5)])
def test_planted(spark, monkeypatch, seed, batches):
    monkeypatch.setattr(suffixes, "BATCHES", batches)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 9)))
    long = [" ".join(word() for _ in range(400)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(80)))]
        for _ in range(r.randrange(3)):
            base = r.choice(long)
            a = r.randrange(1200)
            parts += [base[a : a + r.choice([380, 399, 400, 401, 402, 430, 600, 900])], word()]
        texts.append(r.choice(["", " "]).join(parts))
    texts += ["Der " * 300, "Der " * 99, "x" * 1000, "x" * 399, "ab" * 450 + "q" + "ab" * 450, texts[0], long[0] * 70]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5))


def test_levels_merge_geometrically(spark):
    family = suffixes.Family(spark, 4)
    docs = suffixes.named(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    ranks = []
    for k in range(6):
        family.add(docs.where(f"pmod(t, 6) = {k}"))
        ranks.append(sorted(family.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]


def test_query_merges_levels(spark, monkeypatch):
    ranks, add = [], suffixes.Family.add

    def watched(self, docs, store=True):
        out = add(self, docs, store)
        ranks.append(sorted(self.levels))
        return out

    monkeypatch.setattr(suffixes.Family, "add", watched)
    suffixes.op3(spark, SF)
    assert ranks == [[0], [1], [0, 1], [0, 1]]


def test_merged_arrays_are_in_order():
    r = np.random.default_rng(2)
    arrays = []
    for n in (0, 1, 50, 400):
        e = np.zeros(n, suffixes.ENTRY)
        e["h"], e["c"], e["doc"] = r.integers(0, 40, n), r.integers(0, 9, n), r.integers(0, 99, n)
        arrays.append(suffixes.ordered(e))
    got = suffixes.merged_arrays(arrays)
    keys = list(zip(got["h"].tolist(), got["c"].tolist()))
    assert keys == sorted(keys) and sorted(got.tolist()) == sorted(x for a in arrays for x in a.tolist())
