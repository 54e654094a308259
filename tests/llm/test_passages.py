"""Repeated passages of over 50 words beside repeated strings of 400 bytes."""

import random
import re
from collections import Counter

import pytest
from helpers import DOCS, edge_documents

import corpus_pipeline
from quire.llm import suffixes


def brute(texts, words=51, long=400):
    """What is left of each text, and whether anything was cut."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    runs = [[tuple(d[a:z] for a, z in w[i : i + words]) for i in range(len(w) - words + 1)] for d, w in zip(data, at)]
    told = Counter(r for x in runs for r in x)
    seen = Counter(d[i : i + long] for d in data for i in range(len(d) - long + 1))
    out = []
    for d, w, x in zip(data, at, runs):
        gone = bytearray(len(d))
        for i in range(len(d) - long + 1):
            if seen[d[i : i + long]] > 1:
                gone[i : i + long] = b"\x01" * long
        for i, r in enumerate(x):
            if told[r] > 1:
                stop = w[i + words][0] if i + words < len(w) else w[-1][1]
                gone[w[i][0] : stop] = b"\x01" * (stop - w[i][0])
        out.append((bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"), any(gone)))
    return out


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, left if cut else r.text) for r, (left, cut) in zip(rows, brute([r.text for r in rows])) if not cut or left.strip(suffixes.SPACES))
    got = corpus_pipeline.repeated_passages(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r[0], r[1]) for r in got.collect()) == want


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 4)])
def test_passages_between_50_words_and_400_bytes(spark, monkeypatch, seed, batches):
    monkeypatch.setattr(suffixes, "BATCHES", batches)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(2, 8)))
    space = lambda: r.choice([" ", " ", " ", "\n", " \t"])
    run = lambda n: "".join(word() + space() for _ in range(n))
    said = {n: " ".join(word() for _ in range(n)) for n in (50, 51, 52, 55, 60, 140)}
    texts = [run(r.randrange(3, 90)) + said[n] + space() + run(r.randrange(90)) for n in said for _ in range(3)]
    texts += [said[51], " " + said[51] + "\n", said[52].replace(" ", "\n\n"), run(70), said[140][300:], "x" * 900, "q" + "x" * 450, None, "", "a b c " * 40, said[60] + " " + said[60]]
    short = {n for n in (51, 52, 55) if len(said[n].encode()) < 400}
    assert short
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    check(spark, docs)
    left = [x.text or "" for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()]
    assert not any(said[n] in x for n in short for x in left)  # 400 bytes alone leave these
    assert sum(said[50] in x for x in left) == 3


def test_edges(spark):
    check(spark, edge_documents(spark))


def test_long_text_by_stretches(spark):
    r = random.Random(3)
    base = [str(r.randrange(10**6)) for _ in range(suffixes.STRETCH + 5000)]
    k = suffixes.STRETCH
    texts = [" ".join(base), "q " + " ".join(base[k - 20 : k + 31]) + " z " + " ".join(base[k + 4900 :]), " ".join(base[630:680]) + " e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in suffixes.without_repeats(docs, (suffixes.PASSAGES,)).collect()}
    assert got == {i: left for i, (left, _) in enumerate(brute(texts, long=10**9))}
    assert got[1] == "q z "
