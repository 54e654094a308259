"""Golden values and properties of what SQL does not show."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import assets, diff, latex, order, plugins, preview, search, tree, variant
from quire.sources import blobs, changes
from quire.streaming import jobs


@pytest.mark.parametrize("a,b,want", [(None, None, "a0"), ("a0", "a1", "a0V"), (None, "a0", "Zz"), ("az", None, "b00"), ("a0", "a0V", "a0G"), ("a0V", "a1", "a0l"), ("Zz", None, "a0"), ("Yzz", None, "Z0")])
def test_key_between(a, b, want):
    assert order.key_between(a, b) == want


def test_many_keys_stay_ordered_and_valid():
    assert order.keys_between(None, None, 5) == ["a0", "a1", "a2", "a3", "a4"]
    assert order.keys_between("a0", "a1", 3) == ["a0G", "a0V", "a0l"]
    r, keys = random.Random(1), ["a0"]
    for _ in range(1500):
        i = r.randrange(len(keys) + 1)
        keys.insert(i, order.key_between(keys[i - 1] if i else None, keys[i] if i < len(keys) else None))
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and all(map(order.is_valid, keys))
    down = order.keys_between(None, "a0", 5000)
    assert down == sorted(down) and down[-1] == "Zz"
    with pytest.raises(ValueError):
        order.key_between("a1", "a0")
    assert not any(map(order.is_valid, ["", "a", "a00", "0", "a-", "A" + "0" * 26]))


def test_draws_and_shuffles():
    assert list(itertools.islice(variant.draws(1), 3)) == [2693262067, 11749833, 2265367787]
    assert list(itertools.islice(variant.draws(42), 3)) == [2581720956, 1925393290, 3661312704]
    opts = ["o0", "o1", "o2", "o3", "o4"]
    assert variant.shuffled(opts, variant.draws(1)) == ["o0", "o3", "o4", "o1", "o2"]
    assert variant.shuffled(opts, variant.draws(42)) == ["o3", "o4", "o0", "o2", "o1"]
    first = [0] * 5
    for seed in range(4000):
        first[int(variant.shuffled(opts, variant.draws(seed))[0][1])] += 1
    assert max(abs(n - 800) for n in first) < 96
    v = variant.variant([("q", opts, {"o0", "o3"}), ("r", ["x", "y"], set())], 7)
    assert variant.variant([("q", opts, set(), False), ("r", opts, set(), True)], 1) == [("q", opts), ("r", ["o0", "o3", "o4", "o1", "o2"])]
    assert [n for n, _ in v] == ["q", "r"] and dict(v)["q"][-2:] == ["o0", "o3"]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_text(spark):
    assert one(spark, text.tag_key(F.col("x")), x="  Função \u00a0 Quadrática ") == "funcao quadratica"
    assert one(spark, text.slug(F.col("x")), x="Álgebra & Cálculo II") == "algebra-calculo-ii"
    assert one(spark, text.tex_escape(F.col("x")), x="50% de R$ 3_a") == r"50\% de R\$ 3\_a"
    assert one(spark, text.brace_balance(F.col("x")), x=r"{a\{b}$x$") == 0 and one(spark, text.dollars(F.col("x")), x=r"{a\{b}$x$") == 2
    assert one(spark, text.fold(F.col("x")), x="ØŁßÀé") == "øłßae"
    assert [one(spark, text.isbn_valid(F.col("x")), x=x) for x in ("9780306406157", "0306406152", "0306406153")] == [True, True, False]
    labels = spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 52, 701)], "i int").select(text.option_label(F.col("i"))).collect()
    assert [r[0] for r in labels] == ["a", "z", "aa", "az", "ba", "zz"]
    ages = [one(spark, text.relative_age(F.to_timestamp("x"), F.to_timestamp(F.lit("2026-01-10 12:00:00"))), x=x) for x in ("2026-01-10 11:59:01", "2026-01-10 10:30:00", "2026-01-09 11:00:00", "2024-12-06 12:00:00")]
    assert ages == ["agora", "há 1 hora", "ontem", "há 1 ano"]
    assert [one(spark, variant.seed_of(F.col("x")), x=x) for x in ("A", "B", "")] == [3289118412, 3339451269, 2166136261]


def test_search_parameters():
    q = search.normalised({"text": " a " + "x" * 300, "years": ["1899", "1999", "?", 2000, 2000.5], "types": ["PROMO", "none"], "difficulties": ["3", 99], "tags": [" t ", "", 5], "boards": "no list", "limit": "999", "offset": "-1"})
    assert q == {"text": ("a " + "x" * 300)[:200], "tags": ["t"], "boards": [], "institutions": [], "years": [1999, 2000], "types": ["PROMO"], "difficulties": [3], "limit": 200, "offset": 0}
    assert search.active_filters(q) == 5 and not search.is_empty(q)
    assert search.normalised({})["limit"] == 50 and search.is_empty(search.normalised({"limit": "1.5", "text": "  "})) and search.normalised({"limit": "1.5"})["limit"] == 50


def test_forest_with_orphans_and_cycles(spark):
    df = spark.createDataFrame([("a", None, "1"), ("b", "a", "2"), ("c", "gone", "1"), ("x", "y", "1"), ("y", "x", "1"), ("z", "x", "1")], "id string, parent_id string, sort_key string")
    assert {r.id: (r.root, r.depth) for r in tree.forest(df).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("c", 0)}
    assert {r.id for r in tree.cycles(df).collect()} == {"x", "y", "z"} and [r.id for r in tree.orphans(df).collect()] == ["c"]


def test_log_and_preview(spark):
    log = "./main.tex:14: LaTeX Error: Bad.\n! Missing $ inserted.\n<x>\nl.12 \\foo\nLaTeX Warning: Long\n(pkg)   tail on input line 9.\n\nUnderfull \\hbox at line 3\nother.sty:2: oops"
    df = spark.createDataFrame([(1, log)], "k int, log string")
    got = [tuple(r) for r in latex.in_body(latex.diagnostics(df, "k", "log"), 10).orderBy("at").select("severity", "message", "line", "file").collect()]
    assert got == [("error", "Bad.", 4, "main.tex"), ("error", "Missing $ inserted.", 2, None), ("warning", "Long tail on input line 9.", None, None), ("info", "Underfull \\hbox at line 3", None, None), ("error", "oops", None, "other.sty")]
    source = spark.createDataFrame([(1, "a $x$ % gone\n\\textbf{b} \\\\ 5\\% $$y$$")], "k int, t string")
    kinds = [(r.kind, r.content) for r in latex.preview(source, "k", "t").orderBy("pos").collect()]
    assert kinds == [("text", "a "), ("math", "$x$"), ("text", " \n"), ("command", "b"), ("text", " "), ("break", "\\\\"), ("text", " 5"), ("escape", "\\%"), ("text", " "), ("display", "$$y$$")]


def test_changes(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, name string")
    new = spark.createDataFrame([(2, 9, "x"), (3, 1, "c"), (3, 1, "c")], "id int, v int, name string")
    assert sorted(map(tuple, changes.upserted(t, new, ["id"]).collect())) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    out, conflicts = changes.updated_if(t, spark.createDataFrame([(1, 1, "A"), (2, 7, "B")], "id int, v int, name string"), "id", "v")
    assert sorted(map(tuple, out.collect())) == [(1, 1, "A"), (2, 1, "b")] and [r.id for r in conflicts.collect()] == [2]
    assert changes.replaced_children(t, new.limit(1), ["id"]).count() == 2 and changes.without(t, new, ["id"]).count() == 1
    assert sorted(r.name for r in changes.connected(t, new, "name").collect()) == ["a", "b", "c", "x"]
    gone = changes.trashed(t.withColumn("deleted_at", F.lit(None).cast("string")), new, "id", F.lit("now"))
    assert {r.id: r.deleted_at for r in gone.collect()} == {1: None, 2: "now"}
    assert changes.replaced(t, new, "v").count() == 3


def test_archive_and_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, c in (("a.PNG", b"x"), ("b.png", b"x"), ("c", b"y")):
        (tmp_path / "in" / n).write_bytes(c)
    found = blobs.blobs(spark, str(tmp_path / "in"))
    assert found.count() == 3 and found.select("key").distinct().count() == 2
    data = spark.range(5).selectExpr("id", "concat('n', id) as name")
    assets = found.selectExpr("path as name", "sha256")
    blobs.write_archive(data, assets, str(tmp_path / "out"))
    good, problems = blobs.read_archive(spark, str(tmp_path / "out"), "id long, name string")
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, data.collect())) and problems.count() == 0
    spark.createDataFrame([("{}", "bad")], "json string, sha256 string").write.mode("append").parquet(str(tmp_path / "out/data"))
    spark.createDataFrame([("lost", "0")], "name string, sha256 string").write.mode("append").parquet(str(tmp_path / "out/manifest"))
    _, problems = blobs.read_archive(spark, str(tmp_path / "out"), "id long, name string")
    assert sorted(r.problem for r in problems.collect()) == ["checksum", "missing"]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events"))
    q = jobs.states_by_window(jobs.job_stream(spark, str(tmp_path / "events"))).writeStream.outputMode("append").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("jobs_out").agg(F.sum("n")).first()[0] > 0


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (3_000_000_000).to_bytes(4, "big")
    jpeg = b"\xff\xd8" + b"\xff\xe0\0\x04ab" + b"\xff\xc4\0\x03x" + b"\xff\xc2\0\x0b\x08" + (480).to_bytes(2, "big") + (320).to_bytes(2, "big") + b"\0" * 9
    data = [(png, "image/png"), (jpeg, "image/jpeg"), (jpeg, "image/png"), (png, "image/jpeg"), (png[:20], "image/png"), (jpeg[:12], "image/jpeg"), (None, "image/png"), (png, "image/gif"), (b"", "image/jpeg")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, m) for i, (b, m) in enumerate(data)], "i int, b binary, m string")
    got = {r.i: r.s and tuple(r.s) for r in df.select("i", assets.image_size(F.col("b"), F.col("m")).alias("s")).collect()}
    assert got == {0: (640, 3_000_000_000), 1: (320, 480)} | dict.fromkeys(range(2, 9))


def test_codes_and_schemas(spark):
    df = spark.createDataFrame([(-10,), (-7,), (2,), (None,)], "c int")
    assert [r[0] for r in df.select(assets.legacy_kind(F.col("c"), 3)).collect()] == ["CHAPTER", "SUBSECTION", "QUESTION", None]
    with pytest.raises(Exception, match="unknown code 3"):
        spark.createDataFrame([(3,)], "c int").select(assets.legacy_kind(F.col("c"), 3)).collect()
    assert assets.capabilities(["TagConhecimento"], None, ["LatexComplemento"]) == {"generation": "pre_migrations", "complement": True, "tags": True, "migrations": False}
    assert assets.capabilities([], ["1_ImagensCompleta"], ["Titulo"])["generation"] == "imagens_completa"
    assert assets.capabilities([], ["2_LatexComplemento"], [])["complement"] and assets.capabilities([], ["?"], [])["generation"] == "pre_migrations"


def test_text_of_urls_years_and_bytes(spark):
    urls = {"https://a.b/c": True, "HTTP://a.b": True, "javascript:alert(1)": False, "a.b": False, "http://": False, "": False}
    assert {u: one(spark, text.url_allowed(F.col("x")), x=u) for u in urls} == urls
    assert [one(spark, text.year_of(F.col("x")), x=x) for x in ("1999-01-01", "0101-01-01", "1450", "x")] == [1999, None, 1450, None]
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1024 * 1024, 5_500_000)], "n long").select(text.bytes_text(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["0 B", "1023 B", "1.0 kB", "1.5 kB", "1.0 MB", "5.2 MB"]
    assert one(spark, text.data_url(F.lit("image/png"), F.col("x").cast("binary")), x="abc") == "data:image/png;base64,YWJj"


def test_seeds_count_utf16_units_and_shuffles_take_draws(spark):
    def fnv(t):
        h = 0x811C9DC5
        raw = t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
        return h

    for t in ("A", "", "é漢", "a😀b"):
        assert one(spark, variant.seed_of(F.col("x")), x=t) == fnv(t)
    df = spark.createDataFrame([(["a", "b", "c", "d"], [0.0, 0.5, 0.9]), (["a"], []), ([], [])], "i array<string>, d array<double>")
    assert [r[0] for r in df.select(variant.display_shuffle(F.col("i"), F.col("d"))).collect()][1:] == [["a"], []]
    want = ["a", "b", "c", "d"]
    for i, u in zip((3, 2, 1), (0.0, 0.5, 0.9)):
        j = int(u * (i + 1))
        want[i], want[j] = want[j], want[i]
    assert df.select(variant.display_shuffle(F.col("i"), F.col("d"))).first()[0] == want


def test_more_changes(spark, tmp_path):
    t = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, deleted_at string")
    back = changes.restored(t, spark.createDataFrame([(1,), (9,)], "id int"), "id")
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, None), (3, "y")]
    assert changes.appended(str(tmp_path / "t"), t) == 3 and changes.appended(str(tmp_path / "t"), t.limit(1)) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    rows, parts = changes.nested(spark.createDataFrame([(1, [("a",), ("b",)]), (2, [])], "id int, options array<struct<text: string>>"), "id", "options")
    assert rows.columns == ["id"] and sorted(map(tuple, parts.collect())) == [(1, 0, "a"), (1, 1, "b")]
    files = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "content binary")
    store = str(tmp_path / "store")
    assert blobs.put(files, store).count() == 3 and blobs.put(files, store).count() == 3
    assert spark.read.parquet(store).count() == 2
    key = files.limit(1).select(F.sha2("content", 256).alias("sha256"))
    assert blobs.existing(spark, key.union(spark.createDataFrame([("no",)], "sha256 string")), store).where("exists").count() == 1
    blobs.deleted(spark, key, store, str(tmp_path / "rest"))
    assert spark.read.parquet(str(tmp_path / "rest")).count() == 1


def test_plugins_are_open_to_new_types(spark):
    q = spark.createDataFrame([(1, "MULTIPLE_CHOICE", "x", "r"), (2, "ESSAY", "", None), (3, "DISCURSIVE", "{", " "), (4, None, "x", "r"), (5, "DISCURSIVE", "odd $ here", None)], "id int, type string, text string, solution string")
    o = spark.createDataFrame([(1, "a", True), (1, "a ", False), (1, None, False), (2, "b", False)], "question int, text string, correct boolean")
    assert {r.id: r.status for r in plugins.statuses(q, o).collect()} == {1: "VALID", 2: "UNVALIDATED", 3: "INVALID", 4: "UNVALIDATED", 5: "INVALID"}
    assert sorted((r.code, r.severity) for r in plugins.issues(q, o).where("id = 5").collect()) == [("solution_empty", "warning"), ("unbalanced_math", "error")]
    assert [tuple(r) for r in plugins.issues(q, o).where("id = 1").collect()] == [(1, "duplicate_option", "warning", 1)]
    try:
        plugins.register("ESSAY", plugins.FEW)
        assert {r.id: r.status for r in plugins.statuses(q, o).collect()}[2] == "INVALID"
    finally:
        del plugins.REGISTRY["ESSAY"]


def test_preview_pieces():
    kinds = lambda t: [(d, k, c) for _, d, _, k, c in preview.pieces(t)]
    assert kinds(r"a {b \textbf{c}} d") == [(0, "text", "a "), (0, "group", ""), (1, "text", "b "), (1, "bold", "textbf"), (2, "text", "c"), (0, "text", " d")]
    assert kinds(r"$a\$b$ \(c\) $$d$$ \[e\]") == [(0, "math", r"a\$b"), (0, "text", " "), (0, "math", "c"), (0, "text", " "), (0, "display", "$$d$$"), (0, "text", " "), (0, "display", r"\[e\]")]
    assert kinds(r"\begin{align*}x\end{align*}") == [(0, "display", r"\begin{align*}x\end{align*}")]
    assert kinds("\\begin{itemize}\\item a\\begin{enumerate}\\item b\\end{enumerate}\\item c\\end{itemize}") == [(0, "list", "itemize"), (1, "item", ""), (2, "text", "a"), (2, "ordered", "enumerate"), (3, "item", ""), (4, "text", "b"), (1, "item", ""), (2, "text", "c")]
    assert kinds("a } b \\end{x} \\begin{y} } {c") == [(0, "text", "a } b \\end{x} "), (0, "box", "y"), (1, "text", " } "), (1, "group", ""), (2, "text", "c")]
    assert kinds("x % gone\ny\n\nz $ w\\_") == [(0, "text", "x \ny"), (0, "paragraph", ""), (0, "text", "z $ w_")]
    assert len(preview.pieces("{" * 5000 + "x")) == 5001 and preview.pieces("") == []
