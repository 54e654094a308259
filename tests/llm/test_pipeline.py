from collections import Counter

from helpers import SF, edge_documents
from test_bpe import LIB
from test_partenum import brute as linked
from test_suffixes import brute as repeats

import corpus_pipeline
from quire.llm import mixing, quality


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    for s in steps[1:-1]:
        assert s.columns == docs.columns
    good = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == good
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({c for _, _, c in linked(rows)})
    rows = sorted((r.doc_id, r.text) for r in steps[2].collect())
    cut = {r.doc_id: r.text for r in steps[3].collect()}
    for (d, text), (size, gone, _, _) in zip(rows, repeats([t for _, t in rows])):
        assert (d in cut) == (gone < size or not size)
        assert gone or cut[d] == text
        assert d not in cut or abs(len(cut[d].encode()) - (size - gone)) <= 8
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mixture(steps[3]).collect()}
    copies = Counter(r.doc_id for r in steps[4].collect())
    assert all(copies[d] * n == t for d, (t, n) in taken.items())
    last = {r.doc_id: r.ids for r in steps[5].collect()}
    for r in steps[4].collect():
        assert last[r.doc_id] == LIB.encode(r.text, add_special_tokens=False).ids
    assert steps[5].count() == steps[4].count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids"]


def test_edges(spark):
    """Nulls, blank and long texts, ties, repeated rows, extra columns of clashing names, and no rows at all."""
    docs = edge_documents(spark)
    docs = docs.union(docs.selectExpr("doc_id + 100 as doc_id", "concat(text, ' more') as text", *docs.columns[2:])).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        none = stage(spark, docs.limit(0), SF)
        assert none.collect() == []
        if name == corpus_pipeline.STAGES[-1][0]:
            assert none.columns == ["doc_id", "ids"] and len(out) == docs.count()
        else:
            assert none.columns == docs.columns and len(out[0]) == len(docs.columns)
            assert {tuple(r)[0] for r in out} <= {r.doc_id for r in docs.collect()}
