"""Sums, ranks and neighbours by range partition, joins with intervals, and keys by place, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import composed, order, patches, ranges


@pytest.fixture
def apart(spark):
    """Small range partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_ranks_and_neighbours_of_a_hot_key(spark, apart):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = {x.i: (x.before, x.place) for x in ranges.ranked(ranges.running(df, "k", [F.col("i")], "v"), "k", [F.col("i")]).collect()}
    beside = {x.i: (x.a, x.z) for x in ranges.beside(df, "k", [F.col("i")], "i", "a", "z").collect()}
    for key in ("hot", "b", None):
        own = sorted((i, v) for k, i, v in rows if k == key)
        for at, (i, _) in enumerate(own):
            assert got[i] == (sum(v for _, v in own[:at]), at)
            assert beside[i] == (own[at - 1][0] if at else None, own[at + 1][0] if at + 1 < len(own) else None)
    parts = ranges.placed(df, "k", [F.col("i")]).where("k = 'hot'").select("_part").distinct().count()
    assert parts > 1
    assert ranges.running(df.limit(0), "k", [F.col("i")], "v").collect() == [] and ranges.beside(df.limit(0), "k", [F.col("i")], "i", "a", "z").collect() == []


def test_points_within_spans(spark):
    r = random.Random(5)
    spans = [(r.choice("ab"), i, a := r.randrange(-50, 5000), a + r.randrange(-3, 2500)) for i in range(60)]
    points = [(r.choice("abc"), r.randrange(-60, 7600)) for _ in range(300)]
    s, p = spark.createDataFrame(spans, "k string, i int, lo long, hi long"), spark.createDataFrame(points, "k string, x long")
    for width in (1, 64, 10_000):
        got = sorted((x.k, x.x, x.i) for x in ranges.within(p, s, "k", "x", "lo", "hi", width).collect())
        assert got == sorted((k, x, i) for k, x in points for q, i, lo, hi in spans if q == k and lo <= x <= hi)
    assert ranges.within(p, s, "k", "x", "lo", "hi", how="left").where("i is null").count() == sum(not any(q == k and lo <= x <= hi for q, _, lo, hi in spans) for k, x in points)


def test_integers_by_expression(spark):
    at = [0, 1, 61, 62, 3905, 3906, 62**4, 10**12, -1, -62, -63, -3906, -3907, -(10**12), 5 * 10**15]
    rows = spark.createDataFrame([(x,) for x in at], "at long").select("at", order.integer_at(F.col("at")).alias("k")).withColumn("back", order.ordinal(F.concat("k", F.lit("V"))))
    assert all(x.k == order._integer(x["at"]) and x.back == x["at"] for x in rows.collect())


@pytest.mark.parametrize("a,b", [(None, None), ("a0", "a1"), ("a0V", "a3"), (None, "b05"), ("Zz8", None), (None, "a0V"), ("aV", "aW5")])
def test_each_key_from_its_place(a, b):
    for n in (1, 2, 3, 7, 100):
        assert [order.key_at(a, b, i, n) for i in range(n)] == order.keys_between(a, b, n)
    with pytest.raises(ValueError):
        order.key_at(a, b, 3, 3)


def test_rebalancing_one_large_parent(spark, apart):
    keys = ["a0"]
    for _ in range(400):
        keys.insert(1, order.key_between(keys[0], keys[1] if len(keys) > 1 else None))
    data = [("p", i, k) for i, k in enumerate(keys)] + [("q", 1000 + i, f"a{i}") for i in range(3)]
    df = spark.createDataFrame(data, "parent string, id int, sort_key string").repartition(5)
    got = {x.id: x.sort_key for x in order.rebalanced(df, "parent", [F.col("id")]).collect()}
    assert [got[i] for i in range(len(keys))] == order.keys_between(None, None, len(keys)) and [got[1000 + i] for i in range(3)] == ["a0", "a1", "a2"]
    new = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("new", 3, 1)], "parent string, id int, at int")
    assert {x.id: x.sort_key for x in order.appended(df, new, "parent", [F.col("at")]).collect()} == {1: "a3", 2: "a4", 3: "a0"}
    many = spark.range(200_000).selectExpr("'p' as parent", "id", "concat('a', lpad(id, 33, '0'), '1') as sort_key")
    out = order.rebalanced(many, "parent", []).where("id in (0, 61, 62, 199999)").collect()
    assert {x.id: x.sort_key for x in out} == {i: order._integer(i) for i in (0, 61, 62, 199_999)}


def body(spark, **given):
    values = {"kind": "MULTIPLE_CHOICE", "statement": "\n\n s1\ns2", "solution": "r1", "complement": "c1", "options": [("x", False), ("y", True)]} | given
    df = spark.createDataFrame([tuple(values.values())], "kind string, statement string, solution string, complement string, options array<struct<text string, correct boolean>>")
    df = composed.composed(composed.blocks(df))
    row = df.select("latex", *[composed.origin_of(F.col("spans"), F.lit(i)).alias(f"l{i}") for i in range(-2, 16)]).first()
    return row.latex, [tuple(row[f"l{i}"] or ()) for i in range(-2, 16)]


def test_lines_of_a_body(spark):
    latex, at = body(spark)
    assert latex.split("\n")[0] == "s1" and latex.endswith("\\textbf{Complemento.} c1") and "\\textbf{Gabarito:} b." in latex
    s, o, r, c = "statementLatex", "options", "solutionLatex", "complementLatex"
    # Two blank lines are cut from the head: line 1 is the third of the statement.
    assert at == [(), (s, 1), (s, 2), (s, 3), (s, 4), (o, 1), (o, 1), (o, 2), (o, 3), (r, 1), (r, 1), (r, 1), (r, 1), (r, 1), (c, 1), (c, 1), (c, 1), ()]
    latex, at = body(spark, kind="DISCURSIVE", statement=None, solution=" ", complement=None)
    assert latex == "" and at[4:] == [()] * 14
    assert "\\textbf{Gabarito:} a, b." in body(spark, kind="MULTIPLE_CORRECT", options=[("x", True), ("y", True)])[0]


PATCH = '{"schemaVersion":1,"summary":"s",%s}'
STATE = "statementLatex string, solutionLatex string, complementLatex string, nickname string, options array<struct<id string, text string, correct boolean>>, metadata map<string,string>, tags array<string>, json string, approved array<string>"


def state(spark, json, approved=None):
    row = ("st", "", None, "nick", [("o1", "one", True), ("o2", "  two\n x ", False), ("o3", "t" * 45, False)], {"board": "CESPE", "year": "2001"}, ["b", "a"], json, approved)
    return spark.createDataFrame([row], STATE)


@pytest.mark.parametrize("body,issues", [
    ('"tags":{"names":["a"]}', []), ('"fields":[{"field":"id","value":"x"}]', ["fields.0.field"]), ('"fields":[{"field":"nickname","value":null}]', ["fields.0.value"]), ('"fields":{}', ["fields"]),
    ('"tags":{"names":["a"],"more":1}', ["tags.more"]), ('"metadata":{"year":"2000"}', ["metadata.year"]), ('"metadata":{"year":2000.5,"difficulty":4,"legacyId":1}', ["metadata.difficulty", "metadata.legacyId", "metadata.year"]),
    ('"metadata":{"year":null,"board":null,"difficulty":7}', []), ('"metadata":{"videoUrl":"no url"}', ["metadata.videoUrl"]), ('"options":[{"optionId":"o1","isCorrect":"yes"}]', ["options.0.isCorrect"]), ('"options":[{"optionId":"o1"}]', ["an option unchanged"]),
    ('"options":[{"optionId":"a","isCorrect":true},{"optionId":"b","isCorrect":true}]', ["more than one right option"]), ('"reorder":{"optionIds":["a"]}', ["reorder.optionIds"]), ('"reorder":{"optionIds":["a","a"]}', ["the order repeats an option"]),
    ('"fields":[]', ["no change"]), ('"status":"READY","tags":{"names":[]}', ["status"]), ('"warnings":[1],"tags":{"names":[]}', ["warnings"]),
])
def test_strict_patches(spark, body, issues):
    got = patches.checked(state(spark, PATCH % body), "json").first()
    assert got.issues == issues and (got.patch is None) == bool(issues)


def test_patches_that_are_no_objects(spark):
    assert [patches.checked(state(spark, j), "json").first().issues for j in ("{", "[1]", None, "{}")] == [["$"], ["$"], ["$"], ["schemaVersion", "summary"]]


def test_changes_and_what_is_applied(spark):
    json = PATCH % ('"fields":[{"field":"nickname","value":" "},{"field":"statementLatex","value":"st"}],"options":[{"optionId":"o2","statementLatex":"2","isCorrect":true},{"optionId":"gone","isCorrect":false}],'
                    '"reorder":{"optionIds":["o3","o2","zz","o1"]},"metadata":{"board":null,"year":2001,"role":"r"},"tags":{"names":["a","b"]}')
    ids = ["field:nickname", "option:o2:text", "option:o2:correct", "reorder", "metadata:board", "metadata:role"]
    df = patches.with_changes(patches.checked(state(spark, json, ["option:o2:correct", "reorder", "metadata:board", "field:nickname", "tags"]), "json"))
    got = df.first().changes
    assert [c.id for c in got] == ids and [c.label for c in got[1:4]] == ["Alternativa b)", "Alternativa b) — gabarito", "Ordem das alternativas"]
    assert got[3].before == "one · two x · " + "t" * 40 + "…" and got[3].after == "t" * 40 + "… · two x · (alternativa removida) · one"
    after = patches.applied(df, "approved").first()
    assert after.nickname is None and [(o.id, o.text, o.correct) for o in after.options] == [("o3", "t" * 45, False), ("o2", "  two\n x ", True), ("o1", "one", True)]
    assert after.metadata == {"year": "2001"} and after.tags == ["b", "a"] and after.stale == ["tags"] and not after.refused
    assert after.summary == "Apelido, Alternativa b) — gabarito, Ordem das alternativas e mais 1"
    none = df.withColumn("approved", F.array(F.lit("tags")))
    kept = patches.applied(none, "approved").first()
    assert kept.refused and kept.nickname == "nick" and kept.summary == "nada" and kept.stale == ["tags"]
    with pytest.raises(Exception, match="Nenhuma mudança"):
        patches.applied(none, "approved", must=True).collect()
    assert '"nickname":"nick"' in df.select(patches.snapshot(df).alias("j")).first().j
