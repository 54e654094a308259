"""Joins, nesting and semi or anti joins along keys of the question bank."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.text import fold, option_label
from quire.sources.tables import QUESTIONS_SQL, nodes, options, questions, table


#: Characters by which a short item is looked up, and characters of all items up to which one automaton holds them.
GRAM, MOST = 4, 8_000_000


def unused(df: DataFrame, key: str, used: DataFrame, other: str) -> DataFrame:
    """Rows whose key is in no row of used."""
    return df.join(used.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def counted(df: DataFrame, key: str, children: DataFrame, parent: str, name: str) -> DataFrame:
    """df with the number of its children, 0 where it has none."""
    n = children.groupBy(F.col(parent).alias(key)).agg(F.count("*").alias(name))
    return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def _nested(s, d):
    o = options(s, d).withColumn("text", F.concat(F.col("part").cast("string"), F.lit("x"), F.col("quantity").cast("int").cast("string")))
    o = o.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "text", "correct"))).alias("a"))
    lines = F.transform("a", lambda x, i: F.concat(option_label(i), F.lit(") "), x["text"], F.when(x["correct"], "*").otherwise("")))
    return table(s, d, "orders").join(o, F.col("o_orderkey") == F.col("question"), "left").select("o_orderkey", F.coalesce(F.array_join(lines, "; "), F.lit("")).alias("options"))


def _links(s, d):
    """The first and all names linked to a part, in the order of the links."""
    names = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    link = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "s_name")
    return names.groupBy("l_partkey").agg(F.array_sort(F.collect_list(link)).alias("a")).select("l_partkey", F.col("a")[0]["s_name"].alias("first_supplier"), F.size("a").cast("long").alias("links"), F.array_join(F.transform("a", lambda x: x["s_name"]), ", ").alias("suppliers"))


def contained(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str) -> DataFrame:
    """(key, item_key): which items stand in a text, wherever they begin and end in a word. Null and empty items stand in nothing.

    While all items together have MOST characters at most, as one sum tells, they are one automaton that every task runs over its texts; nothing is joined. Beyond
    that they are looked up by an index.
    """
    some = items.where(F.length(item) > 0).select(F.col(item_key).alias("item"), F.col(item).alias("text"))
    size = some.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    if size > MOST:
        return looked_up(texts, key, text, items.where(F.length(item) > 0), item_key, item)
    rows = [(r.item, r.text) for r in some.collect()]  # of MOST characters at most
    patterns = texts.sparkSession.sparkContext.broadcast(rows)

    def scan(batches):
        by: dict[str, list[int]] = {}
        for i, (_, t) in enumerate(patterns.value):
            by.setdefault(t, []).append(i)
        found = ahocorasick.Automaton()
        for t, own in by.items():
            found.add_word(t, own)
        found.make_automaton()
        for b in batches:
            at, which = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                hits = {i for _, own in found.iter(t) for i in own} if t and by else ()
                at += [k] * len(hits)
                which += [patterns.value[i][0] for i in sorted(hits)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(which, kind)], [key, item_key])

    kind = to_arrow_type(items.schema[item_key].dataType)
    name = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    return texts.select(key, text).mapInArrow(scan, f"{name(texts, key)}, {name(items, item_key)}").distinct()


def looked_up(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str) -> DataFrame:
    """contained() by an index of what items share with texts, however many items there are.

    An item of three words or more is looked up by the words between its first and its last, which stand whole in any text that
    holds it: runs of so many words, of all lengths that items have, up to five; shorter ones by their first characters. Only keys and hashes
    of runs, or characters, are joined; texts are fetched for what they find.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    it = items.select(F.col(item_key).alias("_item"), F.col(item).alias("_text"), words(F.col(item)).alias("_w")).where("_text <> ''")
    starts = F.col(item).rlike(r"^\s"), F.col(item).rlike(r"\s$")
    it = it.join(items.select(F.col(item_key).alias("_item"), starts[0].cast("int").alias("_a"), starts[1].cast("int").alias("_z")), "_item")
    it = it.withColumn("_inner", F.expr("slice(_w, 2 - _a, greatest(0, least(5, size(_w) - 2 + _a + _z)))"))
    long = it.where("size(_inner) > 0").select("_item", "_text", F.size("_inner").alias("_n"), F.xxhash64("_inner").alias("_h"))
    docs = texts.select(F.col(key).alias("_key"), words(F.col(text)).alias("_w"))
    # Of each length that items have, five at most: the hashes of a text's runs, each once.
    lengths = sorted(r._n for r in long.select("_n").distinct().collect())
    runs = [F.expr(f"if(size(_w) >= {n}, transform(sequence(1, size(_w) - {n - 1}), i -> xxhash64(slice(_w, i, {n}))), cast(array() as array<bigint>))") for n in lengths]
    hits = docs.select("_key", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<bigint>"))).alias("_h"))
    hits = hits.join(long, "_h").select("_key", "_item", "_text")
    found = hits.join(texts.select(F.col(key).alias("_key"), F.col(text).alias("_whole")), "_key").where(F.col("_whole").contains(F.col("_text"))).select("_key", "_item")
    # Items of one or two words may begin and end anywhere: they are looked up by their first characters, GRAM at most, among those of all places of a text.
    short = it.where("size(_inner) = 0").selectExpr("_item", "_text", f"left(_text, {GRAM}) as _g")
    sizes = sorted(r._n for r in short.select(F.length("_g").alias("_n")).distinct().collect())  # GRAM numbers at most
    grams = [F.expr(f"if(length(_whole) >= {n}, transform(sequence(1, length(_whole) - {n - 1}), i -> substring(_whole, i, {n})), cast(array() as array<string>))") for n in sizes]
    whole = texts.select(F.col(key).alias("_key"), F.col(text).alias("_whole"))
    starts_ = whole.select("_key", F.explode(F.array_distinct(F.concat(*grams) if grams else F.array().cast("array<string>"))).alias("_g"))
    # Grams of no item go before anything is shuffled where the items' grams are few, and texts are fetched for the rest alone.
    near = starts_.join(short.select("_g").distinct(), "_g", "left_semi").join(short, "_g").select("_key", "_item", "_text")
    one = near.join(whole, "_key").where(F.col("_whole").contains(F.col("_text"))).select("_key", "_item")
    return found.union(one).distinct().select(F.col("_key").alias(key), F.col("_item").alias(item_key))


def _items(s, d):
    """Benchmark items, and their openings of 1 to 6 words cut inside the last word."""
    df = table(s, d, "benchmark").select("item_id", "text")
    cut = df.withColumn("w", F.split("text", " ")).withColumn("n", (F.col("item_id") % 6 + 1).cast("int"))
    cut = cut.select((F.col("item_id") + 1_000_000).alias("item_id"), F.expr("array_join(slice(w, 1, n), ' ')").alias("text"))
    return df.union(cut.select("item_id", F.expr("left(text, greatest(1, length(text) - 2))").alias("text")))


def _trash(s, d):
    """Trashed orders: those of deleted customers; restorable when the parent is live."""
    tree = nodes(s, d).where("kind <> 'CHAPTER'").withColumn("deleted", F.expr("pmod(cast(substring(id, 2) as bigint), 7) = 0"))
    gone = tree.where("deleted")
    return gone.join(gone.select(F.col("id").alias("pid")), gone["parent_id"] == F.col("pid"), "left").select("id", F.col("pid").isNull().alias("restorable"))


def earlier_likes(docs: DataFrame) -> DataFrame:
    """First signal that finds a document's like among all documents of smaller ids: same text, else same folded text and source.

    Texts are compared by hash; the least id of each key is formed before the join, so copies never meet one another. The like
    of the first of its kind would be itself and counts as none.
    """
    folded = F.trim(F.regexp_replace(fold(F.col("text")), r"[^\p{L}\p{N}]+", " "))
    df = docs.select("doc_id", F.sha2("text", 256).alias("t"), F.sha2(F.nullif(folded, F.lit("")), 256).alias("k"), "source")
    by_text = df.groupBy("t").agg(F.min("doc_id").alias("by_text"))
    by_key = df.groupBy("k", "source").agg(F.min("doc_id").alias("by_key"))
    earlier = lambda c: F.when(F.col(c) < F.col("doc_id"), F.col(c))
    df = df.join(by_text, "t", "left").join(by_key, ["k", "source"], "left").withColumns({"by_text": earlier("by_text"), "by_key": earlier("by_key")})
    return df.select("doc_id", F.coalesce("by_text", "by_key").alias("found"), F.when(F.col("by_text").isNotNull(), "text").when(F.col("by_key").isNotNull(), "folded").otherwise("none").alias("signal"))


def dup_signals(new: DataFrame, known: DataFrame) -> DataFrame:
    """The first signal by which a row of new is like one of known: external id, then ISBN, then folded title and first author.

    Both have id, external, isbn, title and author. known has one row per key before the joins, its least id, so rows of one key
    never meet one another.
    """
    keys = {
        "external-id": F.col("external"),
        "isbn": F.nullif(F.upper(F.regexp_replace("isbn", r"[\s-]", "")), F.lit("")),
        "title-and-author": F.trim(F.regexp_replace(fold(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))), "[^a-z0-9|]+", " ")),
    }
    found = []
    for i, (_, key) in enumerate(keys.items()):
        by = known.select(F.col("id"), key.alias(f"k{i}")).where(f"k{i} is not null").groupBy(f"k{i}").agg(F.min("id").alias(f"b{i}"))
        new = new.withColumn(f"k{i}", key).join(by, f"k{i}", "left")
        found.append(F.col(f"b{i}"))
    signal = F.coalesce(*[F.when(b.isNotNull(), name) for b, name in zip(found, keys)])
    return new.select("id", F.coalesce(*found).alias("found"), signal.alias("signal"), signal.isin("external-id", "isbn").alias("blocks"))


def _publications(s, d):
    """Parts as publications: entries of odd keys are new, those of even keys known; sizes and brands repeat among them."""
    df = table(s, d, "part").selectExpr("p_partkey as id", "case when p_partkey % 5 < 2 then concat('x', p_partkey div 10) end as external", "case when p_partkey % 3 = 0 then concat(p_size, '-', p_partkey % 40, ' x') when p_partkey % 7 = 0 then ' - ' end as isbn", "p_name as title", "p_brand as author")
    return df.where("id % 2 = 1"), df.where("id % 2 = 0")


def nested(parents: DataFrame, key: str, lists: dict[str, DataFrame], last: dict[str, DataFrame]) -> DataFrame:
    """parents with an array of the values of each child of lists, in order, and the value of the latest row of each child of last, or null.

    Children are (parent, at, value), at and value texts. All of them come in one union with a tag, so one shuffle brings every child of a parent, and the latest ones
    are maxima, formed before it. Lists of a parent are as long as the parent's children are many.
    """
    parts = [df.select(F.col("parent").alias("_parent"), F.lit(name).alias("_tag"), "at", "value") for name, df in (lists | last).items()]
    rows = reduce(DataFrame.union, parts)
    of = lambda name: F.when(F.col("_tag") == name, F.struct("at", "value"))
    told = [F.collect_list(of(name)).alias(name) for name in lists] + [F.max(of(name)).alias(name) for name in last]
    by = rows.groupBy("_parent").agg(*told)
    df = parents.join(by, parents[key] == by["_parent"], "left")
    for name in lists:
        df = df.withColumn(name, F.transform(F.array_sort(F.coalesce(name, F.array().cast("array<struct<at:string,value:string>>"))), lambda x: x["value"]))
    return df.withColumns({name: F.col(name)["value"] for name in last}).drop("_parent")


def _whole_questions(s, d):
    """Documents with the lines of the order of their number as options, the words of the part's name as tags, and the last event of the user as render."""
    key = F.concat_ws("-", F.lpad("l_linenumber", 3, "0"), F.lpad("l_partkey", 9, "0"), F.lpad("l_suppkey", 9, "0"), F.lpad((F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("parent"), key.alias("at"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "R", "*").otherwise("")).alias("value"))
    t = table(s, d, "part").select(F.col("p_partkey").alias("parent"), F.explode(F.split("p_name", " ")).alias("value")).select("parent", F.col("value").alias("at"), "value")
    r = table(s, d, "events").select(F.col("user_id").alias("parent"), F.concat(F.col("ts").cast("string"), F.lit(" "), F.lpad("event_id", 12, "0")).alias("at"), F.col("event_type").alias("value"))
    df = nested(table(s, d, "documents").select("doc_id"), "doc_id", {"options": o, "tags": t}, {"render": r})
    return df.select("doc_id", F.array_join("options", ";").alias("options"), F.array_join("tags", ",").alias("tags"), "render")


QUERIES = {
    "catalog_counts": lambda s, d: counted(counted(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", table(s, d, "customer"), "c_nationkey", "customers"), "n_nationkey", table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "orders"),
    "candidates_not_used": lambda s, d: unused(table(s, d, "part"), "p_partkey", table(s, d, "lineitem").where("l_quantity > 49"), "l_partkey").select("p_partkey", "p_name"),
    "nested_options": _nested,
    "whole_questions": _whole_questions,
    "link_join_ordered": _links,
    "left_chain_default": lambda s, d: table(s, d, "supplier").join(table(s, d, "nation").where("n_nationkey % 3 <> 0"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("Geral")).alias("subgroup"), F.coalesce("r_name", F.lit("Geral")).alias("grp")),
    "unmatched_report": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing")),
    "dup_signal": lambda s, d: dup_signals(*_publications(s, d)),
    "earlier_like": lambda s, d: earlier_likes(table(s, d, "documents")),
    "scope_exists": lambda s, d: table(s, d, "nation").join(table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 490000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("n_nationkey", "n_name"),
    "fk_chain": lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order")),
    "text_containment_join": lambda s, d: contained(table(s, d, "documents"), "doc_id", "text", _items(s, d), "item_id", "text"),
    "trash_annotation": _trash,
    "usage_flags": lambda s, d: questions(s, d).join(table(s, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("doc_id"), F.lit(True).alias("c")).distinct(), "doc_id", "left").join(table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), F.lit(True).alias("e")).distinct(), "doc_id", "left").select("doc_id", (F.col("c").isNotNull() | F.col("e").isNotNull()).alias("used")),
}

ORACLE_SQL = {
    "catalog_counts": "select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = n_nationkey) as orders from nation",
    "candidates_not_used": "select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)",
    "whole_questions": """with o as (select l_orderkey as k, string_agg(cast(cast(l_quantity as int) as varchar) || case when l_returnflag = 'R' then '*' else '' end, ';' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as options from lineitem group by l_orderkey),
t as (select p_partkey as k, array_to_string(list_sort(string_split(p_name, ' ')), ',') as tags from part), r as (select user_id as k, arg_max(event_type, (ts, event_id)) as render from events group by user_id)
select doc_id, coalesce(options, '') as options, coalesce(tags, '') as tags, render from documents left join o on o.k = doc_id left join t on t.k = doc_id left join r on r.k = doc_id""",
    "nested_options": "with o as (select l_orderkey, cast(l_partkey as varchar) || 'x' || cast(cast(l_quantity as int) as varchar) as text, l_returnflag = 'R' as correct, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem) select o_orderkey, coalesce((select string_agg(chr(cast(97 + i as int)) || ') ' || text || case when correct then '*' else '' end, '; ' order by i) from o where l_orderkey = o_orderkey), '') as options from orders",
    "link_join_ordered": "select l_partkey, arg_min(s_name, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) as first_supplier, count(*) as links, string_agg(s_name, ', ' order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as suppliers from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey",
    "left_chain_default": "select s_suppkey, coalesce(n_name, 'Geral') as subgroup, coalesce(r_name, 'Geral') as grp from supplier left join (select * from nation where n_nationkey % 3 <> 0) on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "unmatched_report": "select lang, count(*) as missing from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) group by lang",
    "dup_signal": "with p as (select p_partkey as id, case when p_partkey % 5 < 2 then 'x' || p_partkey // 10 end as external, nullif(upper(regexp_replace(case when p_partkey % 3 = 0 then p_size || '-' || p_partkey % 40 || ' x' when p_partkey % 7 = 0 then ' - ' end, '[ -]', '', 'g')), '') as isbn, trim(regexp_replace(lower(p_name || '|' || p_brand), '[^a-z0-9|]+', ' ', 'g')) as title from part), k as (select * from p where id % 2 = 0), e as (select external, min(id) as e from k group by external), i as (select isbn, min(id) as i from k group by isbn), t as (select title, min(id) as t from k group by title) select id, coalesce(e, i, t) as found, case when e is not null then 'external-id' when i is not null then 'isbn' when t is not null then 'title-and-author' end as signal, case when e is not null or i is not null then true when t is not null then false end as blocks from p left join e on e.external = p.external left join i on i.isbn = p.isbn left join t on t.title = p.title where id % 2 = 1",
    "earlier_like": r"with f as (select doc_id, text, source, nullif(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), '') as k from documents), t as (select text, min(doc_id) as t from f group by text), k as (select k, source, min(doc_id) as b from f where k is not null group by k, source), j as (select doc_id, case when t.t < doc_id then t.t end as by_text, case when k.b < doc_id then k.b end as by_key from f left join t on t.text = f.text left join k on k.k = f.k and k.source = f.source) select doc_id, coalesce(by_text, by_key) as found, case when by_text is not null then 'text' when by_key is not null then 'folded' else 'none' end as signal from j",
    "scope_exists": "select n_nationkey, n_name from nation where exists (select 1 from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey and o_totalprice > 490000)",
    "fk_chain": "select r_name, count(*) as n, min(o_orderkey) as first_order from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "text_containment_join": "with c as (select item_id + 1000000 as item_id, array_to_string(string_split(text, ' ')[1:item_id % 6 + 1], ' ') as text from benchmark), i as (select item_id, text from benchmark union all select item_id, left(text, greatest(1, length(text) - 2)) from c) select doc_id, item_id from documents d, i where contains(d.text, i.text)",
    "trash_annotation": "with t as (select 'c' || c_custkey as id, cast(null as varchar) as parent_id from customer where c_custkey % 7 = 0 union all select 'o' || o_orderkey, 'c' || o_custkey from orders where o_orderkey % 7 = 0) select id, not exists (select 1 from t p where p.id = t.parent_id) as restorable from t",
    "usage_flags": f"with {QUESTIONS_SQL} select doc_id, exists (select 1 from events where user_id = doc_id and event_type in ('click', 'error')) as used from questions",
}
