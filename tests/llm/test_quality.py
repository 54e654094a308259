from helpers import SF, edge_documents, same

from quire.llm import quality


def test_against_sql(spark):
    same(quality.op9(spark, SF), quality.SQL)


def test_edges(spark):
    docs = edge_documents(spark)
    # DuckDB copies the list of words for each window, so the two long texts are compared by what they hold.
    short = docs.where("text is null or length(text) < 50000")
    same(quality.quality(short), quality.SQL, documents=short.select("doc_id", "text", "lang", "source"))
    long = quality.quality(docs).where("n_words > 50000").collect()
    assert [(r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in long] == [(60_000, 0, 0, 0, False)] * 2
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.quality(docs).where("kept").collect())
    assert quality.quality(docs.limit(0)).collect() == [] and quality.keep_good(docs.limit(0)).collect() == []


def test_outliers_go_and_clean_stay(spark):
    clean = [(i, " ".join(f"wo{(i * 7 + j * j) % 1009}rd" for j in range(60 + i % 50)), "en", "s", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(f"wo{(i * 7 + j * j) % 1009}rd$$$" for j in range(80)), "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(40))
