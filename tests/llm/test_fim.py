import hashlib
import re

import pytest
from helpers import DOCS, SF, edge_documents, rows, same
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import fim


def plain(text, h, pattern):
    """By a regular expression and slices of its matches."""
    units = re.findall(pattern, text, re.S)
    n = len(units)
    assert "".join(units) == text
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units,pattern", [
    (fim.LINES, r"[^\n]*\n|[^\n]+"), (fim.Units("\n", 1), r"."), (fim.Units("\n", 4), r"[^\n]{0,3}\n|[^\n]{1,4}"), (fim.Units("", 3), r".{1,3}"), (fim.Units(".!?\n"), r"[^.!?\n]*[.!?\n]|[^.!?\n]+"),
])
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n.<PSM>é😀\0", max_size=40), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_units_against_patterns(units, pattern, text, h):
    got = fim.arranged(text, h, units)
    assert got == plain(text, h, pattern)
    assert fim.restored(got[4], got[1]) == text


def test_rate_and_order():
    h = [5, 9, 60, 70]
    assert fim.arranged("a\nb\n", h, rate=60)[1] == "plain" and fim.arranged("a\nb\n", h, rate=61)[1] == "psm"
    assert fim.arranged("a\nb\n", h, suffix_first=71)[1] == "spm"
    with pytest.raises(ValueError):
        fim.Units("é")


def test_against_sql(spark):
    same(fim.op13(spark, SF), fim.SQL)
    forms = {r.form for r in fim.op13(spark, SF).collect()}
    assert {"psm", "spm"} <= forms


def test_edges(spark):
    docs = edge_documents(spark)
    more = [(i, t, None, None, 0) for i, t in enumerate(["\n", "\n\n\n", "no end", "ends\n", "a<P>b\nc", "<S>", "x<\nP>\n", "a\r\nb c\n", "<<<\n>>>\n" * 3, "<M", "é\n" * 70_000, "q" * 300_000], 50)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, DOCS)).selectExpr("*", "1 as n", "'x' as form", "'y' as output", "2 as prefix_chars")
    out = fim.digest(docs)
    assert len(out.columns) == 7 and out.count() == docs.count()
    same(out, fim.SQL, documents=docs.select("doc_id", "text"))
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for (d, t) in docs.select("doc_id", "text").distinct().collect() for r in [out.where(f"doc_id <=> {'null' if d is None else d}").first()])
    assert fim.digest(docs.limit(0)).collect() == []


def test_tables_round_trip(spark):
    docs = edge_documents(spark)
    back = fim.restore(fim.rearrange(docs, fim.Units(" ", 5)))
    assert rows(back, ["doc_id", "text"]) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
