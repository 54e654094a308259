"""Totals travel with what chunks ask and are answered: nothing is stored or collected between the exchanges."""

from pyspark.sql import DataFrame
from test_lm import check

from quire.llm import lm


def test_nothing_is_stored_or_collected_between(spark, monkeypatch):
    names, real = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: names.append(name) or real(df, name))
    docs = spark.createDataFrame([(i, f"one w{i % 5} two w{i % 3}") for i in range(40)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(DataFrame, "collect", None)
    out = lm.cross_entropy_difference(docs, labels)
    monkeypatch.undo()
    assert names == ["scores"]
    assert out.count() == 40


def test_chunks_that_ask_few_buckets(spark):
    """One word a chunk: most buckets are asked for nothing, and still tell their different words."""
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "a", "", None, "c c"])], "doc_id long, text string").repartition(6)
    check(docs, spark.createDataFrame([(0, 1), (5, 1)], "doc_id long, quality int"))
