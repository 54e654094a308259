import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, edge_documents
from tokenizers import Tokenizer

from quire.llm import bpe, repair

LIB = Tokenizer.from_file(public_tokenizers.path(bpe.WORD_BPE))


@pytest.mark.parametrize("size", [0, 1, 2, 50, 3000])
def test_shard_round_trip_and_random_access(size):
    r = np.random.default_rng(size)
    sizes = r.integers(1, 6, 200)
    flat = r.integers(0, 40, int(sizes.sum())).astype(np.int32)
    docs = [r.integers(0, 200, r.integers(0, 60)) for _ in range(size)]
    lens = np.array([len(d) for d in docs], np.int64)
    s = repair.compress(flat, sizes, np.concatenate([np.zeros(0, np.int64), *docs]), lens, 49408)
    want = [np.append(repair.gathered(flat, sizes, d), repair.END) for d in docs]
    ids = repair.expand(s["sequence"], s["rules"], 49408)
    every = np.concatenate(want) if want else np.zeros(0)
    assert ids.tolist() == every.tolist()
    assert s["tokens"].tolist() == [len(w) for w in want]
    if size >= 50:
        assert len(s["rules"]) and len(s["sequence"]) < 0.9 * len(ids)
        for _ in range(50):
            a = int(r.integers(0, len(ids) - 1))
            n = int(r.integers(1, min(99, len(ids) - a) + 1))
            assert repair.stretch(s, a, n).tolist() == ids[a : a + n].tolist()
        at = np.cumsum(s["symbols"])
        assert repair.expand(s["sequence"][at[3] : at[4]], s["rules"], 49408).tolist() == want[4].tolist()


def check(docs):
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) as t").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.t))
    want, start = [], 0
    for r in rows:
        ids = LIB.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, repair.digest(repair.shards(docs)).collect()), key=lambda r: r[1]) == want


def test_sample(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD", 20_000)
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    odd = [(90, "a<|endoftext|>b <|startoftext|> c\x1cd\x85e\u2003f \u6f22\u5b57<|endoftext|>x <|x|>"), (91, "<|endoftext|>")]
    check(edge_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")))
    assert repair.digest(repair.shards(edge_documents(spark).limit(0))).collect() == []


def test_rounds_go_on_until_no_pair_is_frequent():
    r = np.random.default_rng(4)
    words = [r.integers(0, 30, n) for n in r.integers(1, 6, 40)]
    sizes = np.array([len(w) for w in words])
    every = r.integers(0, 40, 5000)
    lens = np.full(100, 50)
    out = repair.compress(np.concatenate(words).astype(np.int32), sizes, every, lens, 1000)
    assert len(out["rules"]) < repair.SYMBOLS - 1000
    ends = np.cumsum(out["symbols"])
    seq = out["sequence"].astype(np.int64)
    inside = np.ones(len(seq) - 1, bool)
    inside[ends[:-1] - 1] = False
    inside[ends - 2] = False  # the pair with the end id
    _, count = np.unique(seq[:-1][inside] << 16 | seq[1:][inside], return_counts=True)
    # Of a pair of equal symbols a run of three holds two, of which one can be taken.
    assert count.max() < 2 * repair.LEAST
