import math
from collections import Counter

from helpers import SF, edge_documents

from quire.llm import lm


def brute(docs, labels):
    best = {}
    for d, q in labels:
        best[d] = max(q, best.get(d, q))
    words = [(t or "").encode().split() for _, t in docs]
    counts = [[Counter(), Counter(), 0], [Counter(), Counter(), 0]]
    for (d, _), w in zip(docs, words):
        for c in [counts[1]] + ([counts[0]] if best.get(d) == 1 and d is not None else []):
            c[0].update(w)
            c[1].update(zip([None, *w], w))
            c[0][None] += bool(w)
            c[2] += len(w)
    v = len(set().union(*words))
    out = []
    for (d, _), w in zip(docs, words):
        loss = []
        for one, two, n in counts:
            total = 0.0
            for a, b in zip([None, *w], w):
                p = (one[b] + lm.ALPHA) / (n + lm.ALPHA * v)
                total -= math.log((two[a, b] + lm.BETA * p) / (one[a] + lm.BETA))
            loss.append(total / len(w) if w else None)
        out.append((d, len(w), *loss, loss[0] - loss[1] if w else None))
    return out


def check(docs, labels):
    got = sorted(map(tuple, lm.cross_entropy_difference(docs, labels).collect()), key=repr)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.doc_id, r.quality) for r in labels.collect()]), key=repr)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2] or 0, 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-8) for x, y in zip(a[2:], b[2:])), (a, b)


def test_sample(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5000)
    check(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), spark.read.parquet(f"{SF}/labels.parquet"))


def test_edges(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    check(edge_documents(spark), labels)
    check(edge_documents(spark), labels.limit(0))
    assert lm.cross_entropy_difference(edge_documents(spark).limit(0), labels).collect() == []


def test_scores_tell_target_from_rest(spark):
    good = [(i, " ".join(f"g{(i * j) % 50}" for j in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"b{(i * j) % 50}" for j in range(30))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(spark.createDataFrame(good + bad, "doc_id long, text string"), labels).collect()}
    held_out = sorted((got[i], i < 100) for i in [*range(30, 60), *range(130, 160)])
    assert all(g for _, g in held_out[:30]) and not any(g for _, g in held_out[30:])


def test_equal_rows_in_chunks_apart(spark):
    docs = spark.createDataFrame([(i, f"one two w{i % 3}") for i in range(4)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    check(docs.union(docs), labels)
    same = spark.createDataFrame(spark.sparkContext.parallelize([(None, "one two")] * 6 + [(1, "x")] * 3, 9), "doc_id long, text string")
    check(same, labels)


def test_any_partitions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "MET", 50)
    monkeypatch.setattr(lm, "CHUNK", 40)
    data = [(i % 7 if i % 5 else None, " ".join(f"w{i * j % 11}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    for n in (1, 4, 7):
        check(docs.repartition(n), labels)
