"""Operators over whole tables, on rows that a bound on ids or on their number would leave out."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import bank as bank_ops
from quire.operators import facets, joins, latex, portable, tree, variant
from quire.plans import registry


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    """Tables with large ids: (folder, orders by key, lines)."""
    d, r = tmp_path_factory.mktemp("bank"), random.Random(5)
    orders = {k: (k % 7 + 300, r.choice(["1-URGENT", "5-LOW"])) for k in range(9_001, 9_041)}
    lines = [(k, i, r.randrange(60), r.randrange(20), float(100 * k + i), r.choice("RA")) for k in orders for i in range(r.randrange(1, 5))]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save("nation", [(0, "N0"), (1, "N1")], "n_nationkey long, n_name string")
    save("customer", [(c, f"C{c}", c % 2) for c in range(300, 307)], "c_custkey long, c_name string, c_nationkey long")
    save("orders", [(k, *v) for k, v in orders.items()], "o_orderkey long, o_custkey long, o_orderpriority string")
    save("part", [(p, "ECONOMY", "Brand#1") for p in range(60)], "p_partkey long, p_type string, p_brand string")
    save("lineitem", [(*x, 1.0) for x in lines], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string, l_quantity double")
    return str(d), orders, lines


def run(spark, bank, name):
    return registry.queries()[name](spark, bank[0]).collect()


def test_no_bound_on_ids(spark, bank):
    _, orders, lines = bank
    got = {(x.l_orderkey, x.l_linenumber, x.now) for x in run(spark, bank, "exclusive_answer")}
    assert got == {(x[0], x[1], x[1] == 0) for x in lines if (x[1] == 0) != (x[5] == "R")} and got
    urgent = {k for k, v in orders.items() if "URGENT" in v[1]}
    got = {x.id: x.hit for x in run(spark, bank, "tree_filter_ancestors")}
    assert {k for k, hit in got.items() if hit} == {f"o{k}" for k in urgent}
    assert {k for k, hit in got.items() if not hit} == {f"c{orders[k][0]}" for k in urgent} | {f"n{orders[k][0] % 2}" for k in urgent}
    want = {k: "\n".join(["\\begin{enumerate}", *(f"\\item {x[2]}" for x in lines if x[0] == k), "\\end{enumerate}"]) for k in orders}
    assert {x.l_orderkey: x.latex for x in run(spark, bank, "exam_text")} == want
    assert {x.p_partkey for x in run(spark, bank, "add_item_reason") if x.reason == "already"} == {x[2] for x in lines}
    assert {x.o_orderkey for x in run(spark, bank, "provenance")} == set(orders)


def test_variants_of_all_customers(spark, bank):
    _, orders, lines = bank
    want = set()
    for c in range(300, 307):
        qs = [(str(k), [f"{k}.{x[1]}" for x in lines if x[0] == k]) for k in sorted(orders, key=str) if orders[k][0] == c]
        want |= {(c, i, q, ",".join(o)) for i, (q, o) in enumerate(variant.variant([(q, o, {o[-1]}) for q, o in qs], c, True))}
    assert {tuple(x) for x in run(spark, bank, "build_variants")} == want


def test_likes_among_all_earlier_rows(spark, tmp_path):
    long = "The same opening of forty letters and more, "
    docs = [(500, long + "one", "s"), (501, long + "two", "s"), (502, long + "one", "t"), (503, "É  long!" + long, "s"), (504, "e long " + long, "s"), (505, "e long " + long, "t"), (506, "", "s"), (507, "!", "s"), (508, None, "s"), (509, None, "s"), (510, long + "one", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.signal, x.found) for x in registry.queries()["earlier_like"](spark, str(tmp_path)).collect()}
    assert len(got) == 11 and {k: v for k, v in got.items() if v[0] != "none"} == {502: ("text", 500), 504: ("folded", 503), 505: ("text", 504), 510: ("text", 500)}
    turns = [(1, 0, "a", "The same text, one"), (1, 1, "a", "The same text, two"), (2, 0, "a", "The same text, one"), (2, 1, "b", "The same text, one")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(x.role, x.conv_id, x.turn, x.n) for x in registry.queries()["proposal_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {("a", 1, 0, 2), ("a", 1, 1, 1), ("b", 2, 1, 1)}


def test_three_signals_of_a_publication(spark):
    schema = "id long, external string, isbn string, title string, author string"
    known = spark.createDataFrame([(1, "e1", "0-306-40615-2", "A", "B"), (2, None, "0306406152", "Título", "José"), (3, "e3", " - ", "", None)], schema)
    new = spark.createDataFrame([(10, "e3", "0306406152", "A", "B"), (11, "e9", "0306 406152", "A", "B"), (12, None, None, "TITULO", "Jose"), (13, None, "-", "other", "x"), (14, None, None, "", None)], schema)
    got = {r.id: (r.found, r.signal, r.blocks) for r in joins.dup_signals(new, known).collect()}
    assert got == {10: (3, "external-id", True), 11: (1, "isbn", True), 12: (2, "title-and-author", False), 13: (None, None, None), 14: (3, "title-and-author", False)}


@pytest.mark.parametrize("most", [10**6, 0])
def test_items_in_texts(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST", most)  # by one automaton, and by the index
    texts = ["zz a b c d e foxtrot yy", "p q r", "xp q rx", "a  b", "Ünï", "", None, "one two three four five six seven eight"]
    items = ["a b c d e fox", "p q r", "q", "wo three four five six seve", "a b", " b c", "", None, "nï", "c d e ", "ight", "two three four"]
    t = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    i = spark.createDataFrame(list(enumerate(items)), "i long, x string")
    got = sorted(tuple(r) for r in joins.contained(t, "k", "t", i, "i", "x").collect())
    assert got == sorted((k, j) for k, a in enumerate(texts) for j, b in enumerate(items) if a is not None and b and b in a)


def test_cycles_and_depth(spark):
    rows = [("a", None), ("b", "a"), ("c", "gone"), ("y", "z"), ("x", "y"), ("z", "x"), ("t", "x"), ("d", "t"), ("s", "s"), ("q", "p"), ("p", "q")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)]
    df = spark.createDataFrame([(i, p, "k") for i, p in rows], "id string, parent_id string, sort_key string")
    got = {x.id: (x.root, x.depth, "/".join(":".join(p) for p in x.path)) for x in tree.forest(df, promote=True).collect()}
    assert len(got) == len(rows) and got["n149"][:2] == ("n0", 149) and got["n149"][2] == "/".join(f"k:n{i}" for i in range(150))
    assert {k: got[k] for k in "cxyzdsp"} == {"c": ("c", 0, "k:c"), "x": ("x", 0, "k:x"), "z": ("x", 1, "k:x/k:z"), "y": ("x", 2, "k:x/k:z/k:y"), "d": ("x", 2, "k:x/k:t/k:d"), "s": ("s", 0, "k:s"), "p": ("p", 0, "k:p")}
    assert got["q"] == ("p", 1, "k:p/k:q")
    assert {x.id: x.depth for x in tree.subtree(df, "x").collect()} == {"x": 0, "z": 1, "t": 1, "y": 2, "d": 2}
    assert tree.subtree(df, "n0").count() == 150 and [tuple(x) for x in tree.subtree(df, "c").collect()] == [("c", 0)] and tree.subtree(df, "gone").count() == 0
    hits = spark.createDataFrame([("d",), ("n149",), ("c",), ("none",)], "id string")
    want = {k: False for k in "txyz"} | {f"n{i}": False for i in range(149)} | {"d": True, "n149": True, "c": True}
    assert sorted((x.id, x.hit) for x in tree.with_ancestors(df, hits).collect()) == sorted(want.items())


def test_export_is_a_row_per_node(spark, bank):
    _, orders, _ = bank
    archive = portable.exported(spark, bank[0])
    assert archive.count() == 2 + 7 + len(orders) and archive.agg(F.max(F.length("data"))).first()[0] < 200
    assert {(x.id, x.parent_id) for x in portable.imported(archive).collect()} == {(f"o{k}", f"c{v[0]}") for k, v in orders.items()} | {(f"c{c}", f"n{c % 2}") for c in range(300, 307)}
    broken = archive.withColumn("data", F.when(F.col("data").contains('"C300"'), F.replace("data", F.lit("C300"), F.lit("C999"))).otherwise(F.col("data")))
    assert {x.id for x in portable.imported(archive).exceptAll(portable.imported(broken)).collect()} == {"c300"}
    assert {tuple(x) for x in portable.sections(archive).collect()} == {(0, 4, True), (1, 3, True)}
    assert {tuple(x) for x in portable.sections(broken).collect()} == {(0, 4, False), (1, 3, True)}
    matched = registry.queries()["group_scope_override"](spark, "/root/testdata/sf0.001")
    assert "Window" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_no_limit_of_rows(spark, tmp_path):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    items = [(k, k % 3, i) for k in range(700) for i in (1, 0)]
    save("orders", sorted({(k, c) for k, c, _ in items}), "o_orderkey long, o_custkey long")
    save("lineitem", [(k, i, 4, (k + i) % 9, 1.0) for k, _, i in items], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double")
    save("supplier", [(i, f"S{i}") for i in range(9)], "s_suppkey long, s_name string")
    save("customer", [(i, f"C{-i % 7}", "x") for i in range(1200)], "c_custkey long, c_name string, c_mktsegment string")
    save("part", [(i, f"p{i % 5}", i % 50) for i in range(300)], "p_partkey long, p_name string, p_size int")
    get = lambda name: [tuple(x) for x in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert get("ordered_items") == sorted((c, k, i, 4) for k, c, i in items)
    assert get("link_join_ordered") == [(4, next(f"S{(k + i) % 9}" for k, _, i in sorted(items)), 1400, ", ".join(f"S{(k + i) % 9}" for k, _, i in sorted(items)))]
    assert get("scan_project") == sorted([(i, f"C{-i % 7}", "x") for i in range(1200)], key=lambda x: (x[1], x[0]))
    assert get("composite_sort") == sorted([(i, f"{1000 - i % 50:05d}p{i % 5}") for i in range(300)], key=lambda x: (x[1], x[0]))


def test_pre_order_where_keys_begin_other_keys(spark):
    """a04 is what three insertions after a0 leave; it comes after a0 and all below it."""
    rows = [("r", None, "a0"), ("x", "r", "a0"), ("x2", "x", "a9"), ("y", "r", "a04"), ("y2", "y", "a0"), ("z", "r", "a1"), ("w", "r", "Zz"), ("t1", "z", "a0"), ("t2", "z", "a0")]
    df = spark.createDataFrame(rows, "id string, parent_id string, sort_key string").repartition(4)
    got = sorted((x.place, x.id) for x in tree.preorder(df).collect())
    assert got == list(enumerate(["r", "w", "x", "x2", "y", "y2", "z", "t1", "t2"]))
    plan = tree.copy_plan(df, "x", {"option": spark.createDataFrame([("x2", "o1", "b"), ("x", "o2", "c"), ("r", "o3", "a")], "parent string, id string, sort_key string")})
    assert sorted((r.kind, r.place, r.id, r.new_parent, r.status, r.render) for r in plan.collect()) == [("node", 0, "x", "r", "DRAFT", None), ("node", 1, "x2", "copy-x", "DRAFT", None), ("option", 0, "o2", "copy-x", None, None), ("option", 1, "o1", "copy-x2", None, None)]


def slugs_one_by_one(names, taken):
    claimed, used, out = set(taken) | set(names), set(taken), []
    for b in names:
        if b not in used:
            used.add(b)
            out.append(b)
            continue
        n = 2
        while f"{b}-{n}" in claimed or f"{b}-{n}" in used:
            n += 1
        used.add(f"{b}-{n}")
        out.append(f"{b}-{n}")
    return out


def test_slugs_never_clash(spark):
    t = lambda names, taken: [x.slug for x in latex.unique_slugs(spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(3), "k", "name", spark.createDataFrame([(x,) for x in taken], "slug string")).orderBy("k").collect()]
    assert t(["a", "a", "a 2"], []) == ["a", "a-3", "a-2"]
    assert t(["Á b", "a  b"], ["a-b", "a-b-2"]) == ["a-b-3", "a-b-4"]
    assert t(["x" * 59 + " y", "x" * 59 + "z"], []) == ["x" * 59, "x" * 59 + "z"]
    r = random.Random(2)
    names = [r.choice(["a", "a-2", "a-3", "a-3-2", "b", "a-7", "b-02", "b-1", "9-2", "9"]) for _ in range(120)]
    taken = ["a", "a-5", "b-4", "b-2", "zz"]
    got = t(names, taken)
    assert got == slugs_one_by_one(names, taken) and len(set(got) | set(taken)) == len(names) + len(taken)


def test_places_among_many_siblings(spark):
    r = random.Random(3)
    keys = [f"a{i:04d}" for i in r.sample(range(5000), 60)]
    rows = [(f"p{i}", None, k) for i, k in enumerate(keys[:3])] + [(f"c{i}", f"p{i % 2}", k) for i, k in enumerate(keys[3:])]
    data = {i: (p, k) for i, p, k in rows}
    moves = [(f"c{r.randrange(57)}", r.choice(["firstChild", "lastChild"]), f"p{r.randrange(3)}") for _ in range(40)] + [(f"c{r.randrange(57)}", r.choice(["before", "after"]), f"c{r.randrange(57)}") for _ in range(60)] + [("p0", "after", "p1"), ("c1", "before", "c1")]
    moves = sorted(set(moves))
    df = spark.createDataFrame(rows, "id string, parent_id string, sort_key string").repartition(4)
    got = {tuple(x)[:3]: tuple(x)[3:] for x in bank_ops.placed(df, spark.createDataFrame(moves, "move string, kind string, target string")).collect()}
    for move, kind, target in moves:
        child = kind in ("firstChild", "lastChild")
        parent = target if child else data[target][0]
        line = sorted(k for i, (p, k) in data.items() if p == parent and i != move)
        key = data[target][1]
        low = {"firstChild": None, "lastChild": line[-1] if line else None, "before": max((k for k in line if k < key), default=None), "after": max((k for k in line if k <= key), default=None)}[kind]
        high = {"firstChild": line[0] if line else None, "lastChild": None, "before": min((k for k in line if k >= key), default=None), "after": min((k for k in line if k > key), default=None)}[kind]
        assert got[move, kind, target] == (parent, low, high), (move, kind, target)


def test_a_page_beyond_the_end(spark):
    df = spark.range(7)
    page = lambda limit, offset: [tuple(x) for x in bank_ops.paged(df, [F.col("id")], limit, offset).select("id", "has_more", "total").collect()]
    assert page(3, 50) == [(None, False, 50)] and page(3, 3) == [(3, True, None), (4, True, None), (5, True, None)] and page(4, 3) == [(i, False, 7) for i in range(3, 7)]
    assert [tuple(x) for x in bank_ops.paged(df.limit(0), [F.col("id")], 3, 0).select("id", "has_more", "total").collect()] == [(None, False, 0)]


def test_portuguese_order_of_facets(spark):
    rows = [(1, ["Água", "zebra"]), (2, ["agua", "Zebra"]), (3, ["é", "e", "f", "E2"]), (4, ["Ébano"])]
    got = facets.tag_facets(spark.createDataFrame(rows, "k int, t array<string>"), "k", F.col("t")).collect()
    assert [(x.label, x.n) for x in got] == [("Água", 2), ("zebra", 2), ("e" if got[2].label == "e" else "é", 2 if got[2].n == 2 else 1)] + [(x.label, x.n) for x in got[3:]]
    assert [x.label for x in got if x.n == 1] == sorted([x.label for x in got if x.n == 1], key=lambda s: s.lower().replace("é", "e"))
