"""The question bank as its users meet it: the full search, revisions and patches, places in a tree, exams, drafts and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import bytes_text, fold, isbn_valid, option_label, tag_key, url_allowed, year_of
from quire.operators.ranges import beside
from quire.operators.search import matches, normalised
from quire.sources.tables import nodes, table, written

NOTHING = "(vazio)"


def bank(s, d) -> DataFrame:
    """Parts as questions, each with the document of its number as its node: id, texts, metadata, tags, node_title, node_deleted.

    Parts without a document have no node, and toxic documents are deleted nodes.
    """
    gone = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("p_partkey"), F.lit(True).alias("gone")).distinct()
    node = table(s, d, "documents").select(F.col("doc_id").alias("p_partkey"), F.left("text", F.lit(40)).alias("node_title"), F.col("text").alias("statement"))
    df = table(s, d, "part").join(node, "p_partkey", "left").join(gone, "p_partkey", "left")
    return df.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("nickname"), "statement", F.col("p_brand").alias("board"), F.col("p_type").alias("type"), (F.col("p_size") + 1980).cast("int").alias("year"),
        (F.col("p_size") % 11).cast("int").alias("difficulty"), F.split("p_name", " ").alias("tags"), "node_title", F.coalesce("gone", F.lit(False)).alias("node_deleted"),
    )


def filtered(df: DataFrame, query: dict) -> DataFrame:
    """Questions of a live node that hold the text in one of three columns, every tag and one of each list of values."""
    df = df.where("node_title is not null and not node_deleted").where(matches(query["text"], F.col("nickname"), F.col("statement"), F.col("node_title")))
    for name, column in (("boards", "board"), ("types", "type"), ("years", "year"), ("difficulties", "difficulty"), ("institutions", "institution")):
        if query[name]:
            df = df.where(F.col(column).isin(query[name]))
    if query["tags"]:
        wanted = [tag_key(F.lit(t)) for t in query["tags"]]
        df = df.where(F.size(F.array_except(F.array(*wanted), F.transform("tags", tag_key))) == 0).where(~F.exists(F.array(*wanted), lambda k: k == ""))
    return df


def paged(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page with has_more, and total where no row follows it; one row more than the page is read, none is counted.

    A page without rows is one row of nulls, with has_more and total.
    """
    ahead = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = ahead.agg(F.count("*").alias("_n"))  # one row, of limit + 1 rows at most
    rows = ahead.orderBy(*order).limit(limit)
    return n.join(rows, F.lit(True), "left").withColumns({"has_more": F.col("_n") > limit, "total": F.when(F.col("_n") <= limit, F.col("_n") + offset)}).drop("_n")


def _search(raw: dict):
    def run(s, d):
        query = normalised(raw)
        return paged(filtered(bank(s, d), query), [F.asc("year"), F.asc("id")], query["limit"], query["offset"]).select("id", "nickname", "year", "has_more", "total")

    return run


def snapshot_changes(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Changes between snapshots of one entity: (entity, rank, id, before, after), ordered by rank and id.

    Both have entity, the fields, options array<struct<id, text, correct>>, metadata map and tags. Options are matched by id in a
    full outer join, metadata keys are united, tags are sets; an empty value reads ``(vazio)``.
    """
    shown = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", NOTHING).otherwise(c.cast("string"))
    a, b = before.select(*[F.col(c).alias(f"a_{c}") for c in before.columns]), after.select(*[F.col(c).alias(f"b_{c}") for c in after.columns])
    both = a.join(b, F.col("a_entity") == F.col("b_entity"))
    row = lambda rank, name, x, y: F.struct(F.lit(rank).alias("rank"), name.alias("id"), shown(x).alias("before"), shown(y).alias("after"))
    differ = lambda x, y: F.coalesce(x.cast("string"), F.lit("")) != F.coalesce(y.cast("string"), F.lit(""))
    of = [F.when(differ(F.col(f"a_{f}"), F.col(f"b_{f}")), row(0, F.lit(f"field:{f}"), F.col(f"a_{f}"), F.col(f"b_{f}"))) for f in fields]
    keys = F.array_union(F.map_keys("a_metadata"), F.map_keys("b_metadata"))
    meta = F.transform(keys, lambda k: F.when(differ(F.try_element_at("a_metadata", k), F.try_element_at("b_metadata", k)), row(2, F.concat(F.lit("metadata:"), k), F.try_element_at("a_metadata", k), F.try_element_at("b_metadata", k))))
    x, y = F.array_join(F.array_sort("a_tags"), ", "), F.array_join(F.array_sort("b_tags"), ", ")
    changes = F.concat(F.array(*of), meta, F.array(F.when(x != y, row(3, F.lit("tags"), x, y))))
    plain = both.select(F.col("a_entity").alias("entity"), F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("entity", "c.*")
    opts = lambda df, p: df.select("entity", F.explode("options").alias("o")).select("entity", F.col("o.id").alias("option"), F.col("o.text").alias(f"{p}t"), F.col("o.correct").alias(f"{p}c"), F.lit(True).alias(p))
    o = opts(before, "p").join(opts(after, "q"), ["entity", "option"], "full").join(both.select(F.col("a_entity").alias("entity")), "entity", "left_semi")
    told = F.array(
        F.when(F.col("p").isNull(), F.struct(F.lit("added").alias("k"), F.lit("(não existia)").alias("before"), shown(F.col("qt")).alias("after"))),
        F.when(F.col("q").isNull(), F.struct(F.lit("removed").alias("k"), shown(F.col("pt")).alias("before"), F.lit("(removida)").alias("after"))),
        F.when(F.expr("p and q and pt <> qt"), F.struct(F.lit("text").alias("k"), shown(F.col("pt")).alias("before"), shown(F.col("qt")).alias("after"))),
        F.when(F.expr("p and q and pc <> qc"), F.struct(F.lit("correct").alias("k"), F.expr("if(pc, 'correta', 'incorreta')").alias("before"), F.expr("if(qc, 'correta', 'incorreta')").alias("after"))),
    )
    o = o.select("entity", "option", F.explode(F.filter(told, lambda c: c.isNotNull())).alias("c")).select("entity", F.lit(1).alias("rank"), F.concat(F.lit("option:"), "option", F.lit(":"), "c.k").alias("id"), "c.before", "c.after")
    return plain.unionByName(o)


def _snapshots(s, d) -> DataFrame:
    """A snapshot per part: its lines as options, named by supplier, the richest line of each supplier; some metadata missing."""
    line = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_quantity", "l_returnflag")).alias("m"))
    opts = line.groupBy("l_partkey").agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.col("m.l_quantity").cast("int").cast("string").alias("text"), (F.col("m.l_returnflag") == "R").alias("correct"))).alias("options"))
    meta = F.map_filter(F.create_map(F.lit("board"), "p_brand", F.lit("year"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("source"), F.when(F.col("p_size") % 3 == 0, F.lit(""))), lambda k, v: v.isNotNull())
    df = table(s, d, "part").join(opts, F.col("p_partkey") == F.col("l_partkey"), "left")
    none = F.array().cast("array<struct<id string, text string, correct boolean>>")
    return df.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("nickname"), F.col("p_type").alias("statement"), F.coalesce("options", none).alias("options"), meta.alias("metadata"), F.split("p_name", " ").alias("tags"))


def _revisions(s, d):
    """Part 2k as the snapshot before and part 2k + 1 as the one after, of the entity k."""
    df = _snapshots(s, d)
    halve = lambda r: df.where(f"entity % 2 = {r}").withColumn("entity", F.expr("entity div 2"))
    return snapshot_changes(halve(0), halve(1), ("statement", "nickname"))


def patch_changes(state: DataFrame, patch: DataFrame) -> DataFrame:
    """What a patch really changes: (entity, id, before, after).

    state has entity and options array<struct<id, text, correct>> in order; patch has entity, entries array<struct<id, text,
    correct>> whose null text or correct say nothing, and reorder, an array of ids or null. Entries of unknown options and
    entries that change nothing are dropped; the same order is no change.
    """
    now = state.select("entity", F.posexplode("options").alias("pos", "o")).select("entity", "pos", F.col("o.id").alias("option"), F.col("o.text").alias("t"), F.col("o.correct").alias("c"))
    want = patch.select("entity", F.explode("entries").alias("e")).select("entity", F.col("e.id").alias("option"), F.col("e.text").alias("nt"), F.col("e.correct").alias("nc"))
    say = lambda c: F.when(c, "correta").otherwise("incorreta")
    told = F.array(
        F.when(F.col("nt") != F.col("t"), F.struct(F.lit("text").alias("k"), F.coalesce(F.nullif("t", F.lit("")), F.lit(NOTHING)).alias("before"), F.coalesce(F.nullif("nt", F.lit("")), F.lit(NOTHING)).alias("after"))),
        F.when(F.col("nc") != F.col("c"), F.struct(F.lit("correct").alias("k"), say(F.col("c")).alias("before"), say(F.col("nc")).alias("after"))),
    )
    label = F.concat(F.lit("Alternativa "), option_label(F.col("pos")), F.lit(")"))
    parts = now.join(want, ["entity", "option"]).select("entity", "option", label.alias("label"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x"))
    parts = parts.select("entity", F.concat(F.lit("option:"), "option", F.lit(":"), "x.k").alias("id"), "label", "x.before", "x.after")
    cut = lambda t: F.when(F.length(t) > 40, F.concat(F.left(t, F.lit(40)), F.lit("…"))).otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("(vazia)")))
    order = state.join(patch.where("reorder is not null").select("entity", "reorder"), "entity").where(F.transform("options", lambda o: o["id"]) != F.col("reorder"))
    text_of = F.map_from_entries(F.transform("options", lambda o: F.struct(o["id"], o["text"])))
    order = order.select("entity", F.lit("reorder").alias("id"), F.lit("Ordem das alternativas").alias("label"), F.array_join(F.transform("options", lambda o: cut(o["text"])), " · ").alias("before"), F.array_join(F.transform("reorder", lambda i: F.coalesce(cut(F.try_element_at(text_of, i)), F.lit("(alternativa removida)"))), " · ").alias("after"))
    return parts.unionByName(order)


def _options(s, d) -> DataFrame:
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)")).alias("id"), F.col("l_quantity").cast("int").cast("string").alias("text"), (F.col("l_returnflag") == "R").alias("correct"))
    return o.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "id", "text", "correct"))).alias("x")).select("entity", F.transform("x", lambda x: F.struct(x["id"], x["text"], x["correct"])).alias("options"))


def _patches(s, d):
    """A patch per order: every second option gets 7 as its text, every third becomes correct, one entry is of no option, and the order is reversed in every fourth."""
    state = _options(s, d)
    entries = F.transform("options", lambda o, i: F.struct(o["id"].alias("id"), F.when(i % 2 == 0, F.lit("7")).alias("text"), F.when(i % 3 == 0, F.lit(True)).alias("correct")))
    stray = F.array(F.struct(F.lit("none").alias("id"), F.lit("7").alias("text"), F.lit(True).alias("correct")))
    patch = state.select("entity", F.concat(entries, stray).alias("entries"), F.when(F.col("entity") % 4 == 0, F.reverse(F.transform("options", lambda o: o["id"]))).alias("reorder"))
    return patch_changes(state, patch)


def placed(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where nodes go: wanted (move, kind, target) with the new parent_id and the sort keys low and high on either side, null at an end.

    kind is firstChild or lastChild of the target, or before or after it. The node that moves doesn't count among its new siblings:
    where it is the neighbour, the one beyond is. Neighbours come from range partitions of (parent, key), and the ends of a parent are a
    minimum and a maximum, formed before the shuffle: a move meets its target, itself and one row of its parent, however many siblings there are.
    """
    me = F.struct("id", "sort_key")
    t = beside(tree.select("id", "parent_id", "sort_key").withColumn("_me", me), "parent_id", [F.col("sort_key"), F.col("id")], "_me", "_prev", "_next")
    t = written(t.drop("_me"), "siblings")
    df = wanted.join(t.select(F.col("id").alias("target"), F.col("parent_id").alias("up"), F.col("sort_key").alias("key"), F.col("_prev").alias("tp"), F.col("_next").alias("tn")), "target")
    df = df.join(t.select(F.col("id").alias("move"), F.col("_prev").alias("mp"), F.col("_next").alias("mn")), "move", "left")
    ends = t.groupBy(F.col("parent_id").alias("target")).agg(F.min(F.struct("sort_key", "id")).alias("first"), F.max(F.struct("sort_key", "id")).alias("last"))
    df = df.join(ends, "target", "left")
    beyond = lambda near, far: F.when(near["id"] == F.col("move"), far["sort_key"]).otherwise(near["sort_key"])
    of = lambda k: F.col("kind") == k
    own = F.col("target") == F.col("move")
    key = F.when(~own, F.col("key"))
    # Beside itself, both bounds are its own neighbours; else the target is one bound, and its neighbour the other.
    low = F.when(of("lastChild"), beyond(F.col("last"), F.col("mp"))).when(of("before") | (of("after") & own), beyond(F.col("tp"), F.col("mp"))).when(of("after"), key)
    high = F.when(of("firstChild"), beyond(F.col("first"), F.col("mn"))).when(of("after") | (of("before") & own), beyond(F.col("tn"), F.col("mn"))).when(of("before"), key)
    parent = F.when(F.col("kind").isin("firstChild", "lastChild"), F.col("target")).otherwise(F.col("up"))
    return df.select("move", "kind", "target", parent.alias("parent_id"), low.alias("low"), high.alias("high"))


def _placements(s, d):
    """Every third customer moves in turn to the ends of a nation, before and after another customer, and beside itself."""
    tree = nodes(s, d)
    c = tree.where("kind = 'SECTION'").select("id", F.expr("cast(substring(id, 2) as bigint)").alias("k")).where("k % 3 = 0")
    kind = F.element_at(F.array(*map(F.lit, ("firstChild", "lastChild", "before", "after", "after"))), (F.col("k") % 5 + 1).cast("int"))
    target = F.expr("case k % 5 when 0 then concat('n', k % 25) when 1 then concat('n', k % 25) when 4 then concat('c', k) else concat('c', k - 2) end")
    return placed(tree, c.select(F.col("id").alias("move"), kind.alias("kind"), target.alias("target")))


def answer_key(printed: DataFrame, correct: DataFrame) -> DataFrame:
    """Letter of each question's correct option as printed; printed (question, options array), correct (question, option).

    A question without a correct option has no row; one whose correct option isn't printed is told as missing.
    """
    at = F.array_position("options", F.col("option"))
    return printed.join(correct, "question").select("question", F.when(at > 0, option_label(at - 1)).alias("letter"), (at == 0).alias("missing"))


def _answer_key(s, d):
    """Orders printed with their options in reverse and without the last one in every fifth; the first correct line is the answer."""
    o = _options(s, d)
    ids = F.transform("options", lambda x: x["id"])
    printed = o.select(F.col("entity").alias("question"), F.when(F.col("entity") % 5 == 0, F.slice(F.reverse(ids), 2, 1000)).otherwise(F.reverse(ids)).alias("options"))
    right = o.select(F.col("entity").alias("question"), F.get(F.filter("options", lambda x: x["correct"]), 0)["id"].alias("option")).where("option is not null")
    return answer_key(printed, right)


def fingerprint(variants: DataFrame) -> DataFrame:
    """SHA-256 of each variant as canonical JSON; variants (label, seed, position, question, options array in printed order)."""
    labels = F.array_sort(F.transform("options", lambda o, i: F.concat(o, F.lit("="), option_label(i))))
    df = variants.select("label", "seed", F.struct("position", F.struct(F.col("question").alias("questionId"), F.col("options").alias("optionIds"), labels.alias("labels")).alias("q")).alias("x"))
    df = df.groupBy("label", "seed").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("questions"))
    return df.select("label", F.sha2(F.to_json(F.struct("label", "seed", "questions")), 256).alias("fingerprint"))


def _fingerprints(s, d):
    o = _options(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("entity"), "o_custkey"), "entity")
    return fingerprint(o.select(F.concat(F.lit("V"), F.col("o_custkey")).alias("label"), F.col("o_custkey").alias("seed"), F.col("entity").alias("position"), F.col("entity").cast("string").alias("question"), F.transform("options", lambda x: x["id"]).alias("options")))


def exam(questions: DataFrame, audience: str) -> DataFrame:
    """LaTeX of each exam for STUDENT, TEACHER or ANSWER_KEY; questions (exam, position, text, options array<struct<text, correct>>).

    Students see the options, teachers the correct one marked, and the key is the letters alone.
    """
    letters = F.array_join(F.filter(F.transform("options", lambda o, i: F.when(o["correct"], option_label(i))), lambda x: x.isNotNull()), ",")
    if audience == "ANSWER_KEY":
        body = F.concat(F.lit("\\item "), F.coalesce(F.nullif(letters, F.lit("")), F.lit("-")))
    else:
        mark = lambda o: F.when(o["correct"], F.lit(" \\correct")).otherwise("") if audience == "TEACHER" else F.lit("")
        lines = F.transform("options", lambda o, i: F.concat(F.lit("  "), option_label(i), F.lit(") "), o["text"], mark(o)))
        body = F.array_join(F.concat(F.array(F.concat(F.lit("\\item "), "text")), lines), "\n")
    df = questions.select("exam", F.struct("position", body.alias("body")).alias("x")).groupBy("exam").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return df.select("exam", F.lit(audience).alias("audience"), F.concat(F.lit("\\begin{enumerate}\n"), F.array_join(F.transform("x", lambda x: x["body"]), "\n"), F.lit("\n\\end{enumerate}")).alias("latex"))


def _exams(s, d):
    o = _options(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("entity"), "o_custkey", "o_orderpriority"), "entity")
    q = o.select(F.col("o_custkey").alias("exam"), F.col("entity").alias("position"), F.col("o_orderpriority").alias("text"), "options")
    every = exam(q, "STUDENT").union(exam(q, "TEACHER")).union(exam(q, "ANSWER_KEY"))
    return every.select("exam", "audience", F.md5("latex").alias("md5"))


def draft_problems(df: DataFrame) -> DataFrame:
    """Problems of publication drafts (id, title, isbn, year, authors as one text, url): a row each."""
    authors = F.filter(F.transform(F.split("authors", "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    checks = F.array(
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title"), F.when(F.length("title") > 200, "title_length"), F.when(~isbn_valid(F.col("isbn")) & (F.trim("isbn") != ""), "isbn"),
        F.when(year_of(F.col("year")).isNull() & (F.trim("year") != ""), "year"), F.when(F.size(authors) < 1, "authors"), F.when(~url_allowed(F.col("url")) & (F.trim("url") != ""), "url"),
    )
    return df.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def _drafts(s, d):
    """Pages as drafts: their urls with some protocols changed, numbers as ISBN and year, and paths as authors."""
    df = table(s, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 9 == 0, " ").otherwise(F.col("url")).alias("title"), F.lpad(F.col("page_id").cast("string"), 10, "0").alias("isbn"), F.concat((F.col("page_id") * 37 % 2100).cast("string"), F.lit("-01")).alias("year"), F.when(F.col("page_id") % 4 == 0, " ; ,").otherwise("Ann; Bob").alias("authors"), F.when(F.col("page_id") % 6 == 1, F.regexp_replace("url", "^[a-z]+:", "javascript:")).when(F.col("page_id") % 6 == 2, "no url").otherwise(F.col("url")).alias("url"))
    return draft_problems(df)


#: Kinds of files that may be uploaded, and the extensions of each.
MIMES = {"image/png": ("png",), "image/jpeg": ("jpg", "jpeg"), "application/pdf": ("pdf",), "text/html": ("html", "htm")}


def upload_verdict(mime: Column, extension: Column, size: Column, most: int) -> Column:
    """Whether an upload is taken: its mime type is known, its extension is one of that type, and its size is in bounds."""
    of = F.create_map(*[x for k, v in MIMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.try_element_at(of, F.lower(mime))
    return F.when(known.isNull(), "mime").when(~F.coalesce(F.array_contains(known, F.lower(extension)), F.lit(False)), "extension").when(size <= 0, "empty").when(size > most, "size").otherwise("ok")


def _uploads(s, d):
    mime = F.element_at(F.array(*map(F.lit, ("text/html", "IMAGE/PNG", "video/mp4", "text/html"))), (F.col("page_id") % 4 + 1).cast("int"))
    ext = F.when(F.col("page_id") % 3 == 0, "htm").when(F.col("page_id") % 3 == 1, "PNG").otherwise("html")
    size = F.octet_length("html")
    return table(s, d, "pages").select("page_id", upload_verdict(mime, ext, size, 4000).alias("verdict"), bytes_text(size).alias("size"))


def _two_filters(s, d):
    """The full tree filter: orders of a kind with all tags and a problem, their ancestors as the expanded list, and the number of hits."""
    from quire.operators.tree import with_ancestors

    tree = nodes(s, d)
    bad = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("c")).where("c <> 1").select(F.concat(F.lit("o"), "l_orderkey").alias("id"))
    hits = tree.where(F.col("kind") == "QUESTION").where(F.forall(F.array(F.lit("2"), F.lit("high")), lambda t: fold(F.col("title")).contains(t))).join(bad, "id", "left_semi")
    df = with_ancestors(tree, hits)
    n = df.agg(F.count_if("hit").alias("matches"))
    return df.join(n, F.lit(True)).select("id", "hit", (~F.col("hit")).alias("expanded"), "matches")


QUERIES = {
    "search_full": _search({"text": "  RE", "tags": ["Réd"], "years": [1985, "1990", 1991, 1995, 2000, 2005, 2010, 2015, 2020, 2025, "x"], "types": [], "limit": "5", "offset": 2}),
    "search_full_last": _search({"text": "ring", "boards": ["Brand#2", "Brand#3", " "], "difficulties": list(range(8)), "limit": 200}),
    "search_full_empty": _search({"text": "", "offset": 3, "limit": 0}),
    "search_full_beyond": _search({"text": "the", "offset": 90_000}),
    "search_full_text": _search({"text": "the ", "limit": 200}),
    "revision_changes": _revisions,
    "patch_changes": _patches,
    "placements": _placements,
    "answer_key": _answer_key,
    "variant_fingerprint": _fingerprints,
    "exam_audiences": _exams,
    "draft_problems": _drafts,
    "upload_verdict": _uploads,
    "tree_filter_full": _two_filters,
}

_BANK = """bank as (select p_partkey as id, p_name as nickname, d.text as statement, p_brand as board, p_type as type, cast(p_size + 1980 as int) as year, p_size % 11 as difficulty, string_split(p_name, ' ') as tags, left(d.text, 40) as node_title
  from part join documents d on d.doc_id = p_partkey where p_partkey not in (select doc_id from labels where toxic = 1 and doc_id is not null))"""
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(text: str) -> str:
    return "(" + " or ".join(f"contains({_ASCII.format(c)}, '{text}')" for c in ("nickname", "statement", "node_title")) + ")"


def _page_sql(where: str, limit: int, offset: int) -> str:
    return f"with {_BANK}, c as (select *, row_number() over (order by year, id) as n from bank where {where}), t as (select count(*) as n from c) select id, nickname, year, t.n > {limit + offset} as has_more, case when t.n <= {limit + offset} then greatest(t.n, {offset}) end as total from t left join c on c.n > {offset} and c.n <= {limit + offset}"


_LINES = "lines as (select l_orderkey as entity, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_extendedprice as decimal(20, 2)) as id, cast(cast(l_quantity as int) as varchar) as text, l_returnflag = 'R' as correct, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem)"
_LETTER = "chr(cast(97 + {} as int))"
_SNAPS = """line as (select l_partkey, l_suppkey, arg_max(cast(cast(l_quantity as int) as varchar), (l_quantity, l_returnflag)) as text, arg_max(l_returnflag, (l_quantity, l_returnflag)) = 'R' as correct from lineitem group by all),
  o as (select l_partkey // 2 as entity, l_partkey % 2 as side, l_suppkey as option, text, correct from line), pair as (select a.p_partkey // 2 as entity, a.p_type as sa, b.p_type as sb, a.p_name as an, b.p_name as bn, a.p_brand as ab, b.p_brand as bb, case when a.p_size % 2 = 0 then a.p_size::varchar end as ay, case when b.p_size % 2 = 0 then b.p_size::varchar end as byr,
  array_to_string(list_sort(string_split(a.p_name, ' ')), ', ') as ag, array_to_string(list_sort(string_split(b.p_name, ' ')), ', ') as bg from part a join part b on b.p_partkey = a.p_partkey + 1 where a.p_partkey % 2 = 0),
  m as (select entity, option, x.text as pt, x.correct as pc, x.entity is not null and x.text is not null as p, y.text as qt, y.correct as qc, y.text is not null as q from (select * from o where side = 0) x full join (select * from o where side = 1) y using (entity, option))"""
_V = "(vazio)"
ORACLE_SQL = {
    "search_full": _page_sql(f"{_has('re')} and list_contains(tags, 'red') and year in (1985, 1990, 1991, 1995, 2000, 2005, 2010, 2015, 2020, 2025)", 5, 2),
    "search_full_last": _page_sql(f"{_has('ring')} and board in ('Brand#2', 'Brand#3') and difficulty in (0, 1, 2, 3, 4, 5, 6, 7)", 200, 0),
    "search_full_empty": _page_sql("true", 1, 3),
    "search_full_beyond": _page_sql(_has("the"), 50, 90_000),
    "search_full_text": _page_sql(_has("the"), 200, 0),
    "revision_changes": f"with {_SNAPS} select entity, 0 as rank, 'field:statement' as id, sa as before, sb as after from pair where sa <> sb union all select entity, 0, 'field:nickname', an, bn from pair where an <> bn union all select entity, 2, 'metadata:board', ab, bb from pair where ab <> bb union all select entity, 2, 'metadata:year', coalesce(ay, '{_V}'), coalesce(byr, '{_V}') from pair where ay is distinct from byr union all select entity, 3, 'tags', ag, bg from pair where ag <> bg union all select entity, 1, 'option:' || option || ':added', '(não existia)', qt from m where not p and q and entity in (select entity from pair) union all select entity, 1, 'option:' || option || ':removed', pt, '(removida)' from m where p and not q and entity in (select entity from pair) union all select entity, 1, 'option:' || option || ':text', pt, qt from m where p and q and pt <> qt and entity in (select entity from pair) union all select entity, 1, 'option:' || option || ':correct', case when pc then 'correta' else 'incorreta' end, case when qc then 'correta' else 'incorreta' end from m where p and q and pc <> qc and entity in (select entity from pair)",
    "patch_changes": f"with {_LINES} select entity, 'option:' || id || ':text' as id, 'Alternativa ' || {_LETTER.format('pos')} || ')' as label, text as before, '7' as after from lines where pos % 2 = 0 and text <> '7' union all select entity, 'option:' || id || ':correct', 'Alternativa ' || {_LETTER.format('pos')} || ')', 'incorreta', 'correta' from lines where pos % 3 = 0 and not correct union all select entity, 'reorder', 'Ordem das alternativas', string_agg(text, ' · ' order by pos), string_agg(text, ' · ' order by pos desc) from lines where entity % 4 = 0 group by entity having count(*) > 1",
    "placements": "with c as (select c_custkey as k, 'n' || c_nationkey as up, lpad(cast(c_custkey as varchar), 9, '0') as sk from customer), w as (select k, case k % 5 when 0 then 'firstChild' when 1 then 'lastChild' when 2 then 'before' else 'after' end as kind, case when k % 5 < 2 then 'n' || (k % 25) when k % 5 = 4 then 'c' || k else 'c' || (k - 2) end as target, case when k % 5 < 2 then 'n' || (k % 25) else (select up from c t where t.k = case when w0.k % 5 = 4 then w0.k else w0.k - 2 end) end as parent_id, case when k % 5 = 4 then k else k - 2 end as a from c w0 where k % 3 = 0) select 'c' || k as move, kind, target, parent_id, case kind when 'lastChild' then (select max(sk) from c where up = parent_id and c.k <> w.k) when 'before' then (select max(sk) from c where up = parent_id and c.k <> w.k and c.k < w.a) when 'after' then (select max(sk) from c where up = parent_id and c.k <> w.k and c.k <= w.a) end as low, case kind when 'firstChild' then (select min(sk) from c where up = parent_id and c.k <> w.k) when 'before' then (select min(sk) from c where up = parent_id and c.k <> w.k and c.k >= w.a) when 'after' then (select min(sk) from c where up = parent_id and c.k <> w.k and c.k > w.a) end as high from w where parent_id is not null",
    "answer_key": f"with {_LINES}, n as (select entity, count(*) as n, min(pos) filter (correct) as p from lines group by entity), r as (select entity, case when entity % 5 = 0 then n - 2 - p else n - 1 - p end as i from n where p is not null) select entity as question, case when i >= 0 then {_LETTER.format('i')} end as letter, i < 0 as missing from r",
    "variant_fingerprint": f"""with {_LINES}, q as (select o_custkey, entity, '{{"questionId":"' || entity || '","optionIds":["' || string_agg(id, '","' order by pos) || '"],"labels":["' || string_agg(id || '=' || {_LETTER.format('pos')}, '","' order by id || '=' || {_LETTER.format('pos')}) || '"]}}' as j from lines join orders on o_orderkey = entity group by o_custkey, entity) select 'V' || o_custkey as label, sha256('{{"label":"V' || o_custkey || '","seed":' || o_custkey || ',"questions":[' || string_agg(j, ',' order by entity) || ']}}') as fingerprint from q group by o_custkey""",
    "exam_audiences": rf"""with {_LINES}, q as (select o_custkey as exam, entity, max(o_orderpriority) as t, string_agg('  ' || {_LETTER.format('pos')} || ') ' || text, chr(10) order by pos) as s, string_agg('  ' || {_LETTER.format('pos')} || ') ' || text || case when correct then ' \correct' else '' end, chr(10) order by pos) as c, coalesce(string_agg({_LETTER.format('pos')}, ',' order by pos) filter (correct), '-') as k from lines join orders on o_orderkey = entity group by o_custkey, entity),
  e as (select exam, 'STUDENT' as audience, string_agg('\item ' || t || chr(10) || s, chr(10) order by entity) as b from q group by exam union all select exam, 'TEACHER', string_agg('\item ' || t || chr(10) || c, chr(10) order by entity) from q group by exam union all select exam, 'ANSWER_KEY', string_agg('\item ' || k, chr(10) order by entity) from q group by exam)
  select exam, audience, md5('\begin{{enumerate}}' || chr(10) || b || chr(10) || '\end{{enumerate}}') as md5 from e""",
    "draft_problems": r"with p as (select page_id as id, url, lpad(cast(page_id as varchar), 10, '0') as isbn, page_id * 37 % 2100 || '-01' as y from pages), i as (select p.*, (select sum(cast(isbn[j] as int) * (11 - j)) from range(1, 11) r(j)) % 11 = 0 as fine from p) select id, 'title' as problem from i where id % 9 = 0 union all select id, 'title_length' from i where id % 9 <> 0 and length(url) > 200 union all select id, 'isbn' from i where not fine union all select id, 'year' from i where coalesce(try_cast(left(y, 4) as int), 0) < 1450 union all select id, 'authors' from i where id % 4 = 0 union all select id, 'url' from i where id % 6 in (1, 2) or not regexp_matches(url, '^(?i)https?://[^\s]+$')",
    "upload_verdict": "with p as (select page_id, strlen(html) as n, case page_id % 4 when 1 then 'png' when 2 then 'mp4' else 'html' end as mime, case page_id % 3 when 0 then 'htm' when 1 then 'png' else 'html' end as ext from pages) select page_id, case when mime = 'mp4' then 'mime' when mime = 'png' and ext <> 'png' or mime = 'html' and ext = 'png' then 'extension' when n <= 0 then 'empty' when n > 4000 then 'size' else 'ok' end as verdict, case when n < 1024 then n || ' B' when n < 1048576 then cast(floor(n / 1024.0 * 10 + 0.5) / 10 as decimal(20, 1)) || ' kB' else cast(floor(n / 1048576.0 * 10 + 0.5) / 10 as decimal(20, 1)) || ' MB' end as size from p",
    "tree_filter_full": "with h as (select o_orderkey, o_custkey from orders where contains(lower(o_orderpriority), '2') and contains(lower(o_orderpriority), 'high') and o_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') <> 1)), a as (select 'o' || o_orderkey as id, true as hit from h union all select distinct 'c' || o_custkey, false from h union all select distinct 'n' || c_nationkey, false from h join customer on c_custkey = o_custkey) select id, hit, not hit as expanded, (select count(*) from h) as matches from a",
}
