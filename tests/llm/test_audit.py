import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, SF, edge_documents, oracle, rows, same
from pyspark.sql import functions as F

from quire.llm import audit

NAMES = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, least=audit.LEAST, top=audit.TOP):
    """Every term of every group, by dictionaries."""
    df, n, groups = Counter(), Counter(), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(w))
        n.update((lang, source, t) for t in w)
    kept = defaultdict(list)
    for (lang, t), x in df.items():
        if x >= least:
            kept[lang].append(t)
    total = Counter()
    for (lang, source, t), x in n.items():
        if df[lang, t] >= least:
            total[lang, source] += x
            total[lang, None] += x
    langs = Counter()
    for (lang, _, t), x in n.items():
        langs[lang, t] += x
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        v = len(kept[lang])
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 2) // (total[lang, s] + 2 * v) for t in kept[lang]} for x, s in groups if x == lang}
        q = {t: 1 + 10**9 * (langs[lang, t] + 2) // (total[lang, None] + 2 * v) for t in kept[lang]}
        own = p.pop(source)
        parts = {"pair": [(s, sum(f(own[t], p[s][t]) for t in kept[lang])) for s in p], "term": [(t, f(own[t], q[t])) for t in kept[lang] if n[lang, source, t] and own[t] > q[t]]}
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, *x, i) for i, x in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out, key=repr)


def check(docs, **options):
    own = [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]
    got = audit.divergence(docs, **options)
    assert got.columns == NAMES
    assert rows(got, NAMES) == brute(own, options.get("least", audit.LEAST), options.get("top", audit.TOP))


def test_against_sql(spark):
    same(audit.op11(spark, SF), audit.SQL)


def test_edges(spark):
    docs = edge_documents(spark)
    check(docs, least=2)
    same(audit.divergence(docs), audit.SQL, documents=docs.select("doc_id", "text", "lang", "source"))
    assert audit.divergence(docs.limit(0)).collect() == []
    alone = spark.createDataFrame([(1, "Ab ab\x00aB, é1é; ÀÉ", "en", None, 0), (2, "AB", None, "x", 0), (3, None, "de", "a", 0), (4, "1 2", "de", "b", 0)], DOCS)
    check(alone, least=1)
    check(alone)


@pytest.mark.parametrize("width,depth", [(64, 1), (64, 3), (1 << 16, 2)])
def test_a_full_sketch_changes_nothing(spark, monkeypatch, width, depth):
    monkeypatch.setattr(audit, "KNOWN", 40)
    monkeypatch.setattr(audit, "BYTES", 300)
    monkeypatch.setattr(audit, "PAIRS", 50)
    r = random.Random(width + depth)
    data = [(i, " ".join(f"{'ABCDEF'[int(r.random() ** 2 * 6)]}{'xyz'[i % 3]}{'a' * int(r.expovariate(0.2))}" for _ in range(r.randrange(30))), r.choice(["en", "de"]), f"s{r.randrange(5)}", 0) for i in range(200)]
    check(spark.createDataFrame(data, DOCS).repartition(5), width=width, depth=depth)


def test_sketch_never_underestimates_and_drops_rare_terms(spark):
    r = np.random.default_rng(1)
    hashes = np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = r.integers(1, 15, len(hashes))
    merged = audit.Sketch(10)
    for part in np.array_split(np.arange(len(hashes)), 7):
        merged.add(hashes[part], counts[part])
    assert (merged.estimate(hashes) >= np.minimum(counts, 10)).all()
    assert (merged.estimate(hashes)[counts < 10] == counts[counts < 10]).mean() > 0.99
    rare = spark.range(3000).selectExpr("id as doc_id", "concat('common w', translate(id, '0123456789', 'abcdefghij')) as text", "'en' as lang", "'a' as source")
    left = audit.counted(rare, 10).where("term is not null").collect()
    assert [(x.term, x.n, x.df) for x in left] == [("common", 3000, 3000)]


def test_hot_source(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('the of ', repeat(concat('t', translate(id % 60, '0123456789', 'abcdefghij'), ' '), 1 + id % 7)) as text", "'en' as lang", "case when id % 3 > 0 then 'hot' else concat('s', id % 12) end as source")
    check(docs.withColumn("n", F.lit(1)).withColumn("value", F.lit("x")))


def test_shares_beyond_64_bits(spark):
    n, total, v = 7 * 10**13, 9 * 10**14, 10**9
    got = spark.range(1).selectExpr(f"{audit.share(f'{n}L', f'{total}L', f'{v}L')} as p").first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_sql_equals_brute_force():
    got, names = oracle("with " + "x as (select 1) select lang, source, text from documents")
    want, _ = oracle(f"select {', '.join(NAMES)} from ({audit.SQL})")
    assert want == brute(got) and names == ["lang", "source", "text"]
