"""op3's columns beyond its contract: passages of over 50 words that repeat, beside strings of 400 bytes."""

import hashlib
import random
import re
from collections import Counter

from helpers import DOCS, SF, edge_documents
from test_suffixes import brute as by_bytes

from quire.llm import suffixes


def covered(texts, words=51, long=400):
    """Per text: bytes and runs of passages that repeat, and the hash of what these and repeated strings of bytes leave."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    runs = [[tuple(d[a:z] for a, z in w[i : i + words]) for i in range(len(w) - words + 1)] for d, w in zip(data, at)]
    told = Counter(r for x in runs for r in x)
    seen = Counter(d[i : i + long] for d in data for i in range(len(d) - long + 1))
    out = []
    for d, w, x in zip(data, at, runs):
        gone = bytearray(len(d))
        for i, r in enumerate(x):
            if told[r] > 1:
                stop = w[i + words][0] if i + words < len(w) else w[-1][1]
                gone[w[i][0] : stop] = b"\x01" * (stop - w[i][0])
        said = sum(gone), len(re.findall(b"\x01+", gone))
        for i in range(len(d) - long + 1):
            if seen[d[i : i + long]] > 1:
                gone[i : i + long] = b"\x01" * long
        out.append((*said, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def check(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    want = Counter((r.doc_id, *a, *b) for r, a, b in zip(rows, by_bytes(texts), covered(texts)))
    got = suffixes.op3(spark, str(folder))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages", "left_sha256"]
    got = got.collect()
    assert Counter(map(tuple, got)) == want
    return {r.doc_id: r for r in got}


def test_planted_passages_are_caught_and_clean_documents_left_alone(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(2, 8)))
    run = lambda n: " ".join(word() for _ in range(n))
    said = {n: run(n) for n in (50, 51, 60, 140)}
    texts = [f"{run(r.randrange(3, 90))} a{n}{i} {said[n]}\nz{n}{i} {run(r.randrange(90))}" for n in said for i in range(3)]
    texts += [run(200) for _ in range(8)] + [f"{said[51]} z {said[60]} z {said[51]}", None, "", "x" * 900, "q" + "x" * 450, said[140][300:]]
    assert len(said[51].encode()) < 400
    got = check(spark, tmp_path, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS).repartition(5))
    assert all(got[i].n_passage_bytes == 0 for i in [0, 1, 2, *range(12, 20)])
    assert all(got[i].n_passages == 1 and got[i].n_removed == 0 for i in (3, 4, 5))  # 400 bytes alone leave these
    assert got[20].n_passages == 3


def test_edges(spark, tmp_path):
    check(spark, tmp_path, edge_documents(spark))


def test_sample(spark, tmp_path):
    check(spark, tmp_path, spark.read.parquet(f"{SF}/documents.parquet"))
