from collections import Counter

from helpers import SF, edge_documents, same

from quire.llm import mixing


def test_against_sql(spark):
    same(mixing.op8(spark, SF), mixing.SQL)


def test_edges(spark):
    docs = edge_documents(spark)
    plain = docs.select("doc_id", "text", "lang", "source")
    same(mixing.mixture(docs), mixing.SQL, documents=plain)
    assert sorted(map(repr, mixing.mixture(docs).collect())) == sorted(map(repr, mixing.mixture(docs).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mixture(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_targets_and_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixture(docs).collect()
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    shared = sum(r.target * r["size"] / r.source_size for r in got if r.source_size)
    assert abs(shared - sum(r["size"] for r in got)) < 1
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in got if r["size"])


def test_hot_source_comes_near_its_target(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * id % 400 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 40) end as source")
    source = {r.doc_id: r.source for r in docs.collect()}
    by = {}
    for r in mixing.mixture(docs).collect():
        t = by.setdefault((source[r.doc_id], r.target), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
    assert all(abs(taken - target) <= 3 * most for (_, target), (taken, most) in by.items()), by
