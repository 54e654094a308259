"""Import and export of libraries, capture queue, provenance and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import relative_age
from quire.operators.ranges import ranked, running
from quire.operators.tree import forest
from quire.sources.tables import NODES_SQL, QUESTIONS_SQL, nodes, questions, table, written

#: Kinds of assets by extension.
KINDS = {"html": "SOURCE_PAGE", "png": "FIGURE", "pdf": "DOCUMENT"}


def exported(s, d) -> DataFrame:
    """A JSON row per nation, customer and order, with its own and its parent's stable reference and a checksum.

    Rows are made one by one, so a nation with most of the rows is no row or task of its own.
    """
    n = table(s, d, "nation").selectExpr("'n' as level", "n_nationkey as key", "cast(null as bigint) as parent", "n_name as title")
    c = table(s, d, "customer").selectExpr("'c' as level", "c_custkey as key", "c_nationkey as parent", "c_name as title")
    o = table(s, d, "orders").selectExpr("'o' as level", "o_orderkey as key", "o_custkey as parent", "o_orderpriority as title")
    df = n.unionByName(c).unionByName(o)
    return df.select(F.to_json(F.struct(F.lit(1).alias("version"), "level", "key", "parent", "title")).alias("data")).withColumn("sha256", F.sha2("data", 256))


SCHEMA = "version int, level string, key bigint, parent bigint, title string"
#: Level of the parent of a customer and of an order.
ABOVE = "case level when 'c' then 'n' when 'o' then 'c' end"


def opened(archive: DataFrame) -> DataFrame:
    """Nodes of exported rows, and whether the checksum and version of each hold."""
    df = archive.select((F.sha2("data", 256) == F.col("sha256")).alias("same"), F.from_json("data", SCHEMA).alias("x"))
    return df.select("x.level", "x.key", "x.parent", "x.title", F.coalesce(F.expr("same and x.version = 1"), F.lit(False)).alias("ok"))


def imported(archive: DataFrame) -> DataFrame:
    """Nodes below nations of exported rows whose checksum and version hold."""
    df = opened(archive).where("ok and level <> 'n'")
    return df.selectExpr("concat(level, key) as id", f"concat({ABOVE}, parent) as parent_id")


def sections(archive: DataFrame) -> DataFrame:
    """Per nation its number of customers, and whether all their rows and its own hold."""
    df = opened(archive).where("level <> 'o'").withColumn("n_nationkey", F.expr("if(level = 'n', key, parent)"))
    return df.groupBy("n_nationkey").agg(F.count_if(F.col("level") == "c").alias("sections"), F.min("ok").alias("ok")).where("sections > 0")


def queue_state(used: str, failed: str, read: str):
    """approved, then error, then review, then queued."""
    return F.expr(f"case when {used} then 'approved' when {failed} then 'error' when {read} then 'review' else 'queued' end")


def _queue(s, d):
    df = table(s, d, "events").selectExpr("event_id", "ts", "event_id % 11 = 0 as used", "event_type = 'error' as failed", "event_type = 'view' as read")
    return df.select("event_id", "ts", queue_state("used", "failed", "read").alias("state"))


def _classify(s, d):
    ext = F.lower(F.regexp_extract("url", r"\.([a-z0-9]+)$", 1))
    table_ = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(s, d, "pages").select("page_id", F.coalesce(F.try_element_at(table_, ext), F.lit("OTHER")).alias("kind"))


def _rect(s, d):
    """Normalised boxes as pixels of a page of 1240 by 1754: outward rounding, within the page."""
    df = table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount as x", "l_tax as y", "l_quantity / 100 as w")
    return df.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "cast(floor(x * 1240) as bigint) as x0", "cast(floor(y * 1754) as bigint) as y0", "cast(least(1240, ceil((x + w) * 1240)) as bigint) as x1")


def _provenance(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("o_orderkey", F.format_string("%s, p. %d (%d%%)", "n_name", (F.col("c_custkey") % 300).cast("int"), (F.col("o_orderkey") % 100).cast("int")).alias("reference"))


def _lost(s, d):
    """Nodes that an archive damaged in every hundredth row doesn't give back."""
    hurt = F.expr("from_json(data, 'key bigint').key % 100 = 7")
    archive = exported(s, d).withColumn("data", F.when(hurt, F.regexp_replace("data", '"title":"', '"title":"x')).otherwise(F.col("data")))
    gone = nodes(s, d).where("parent_id is not null").join(imported(archive), ["id", "parent_id"], "left_anti")
    return gone.groupBy(F.left("id", F.lit(1)).alias("level")).agg(F.count("*").alias("lost"))


def references(tree: DataFrame) -> DataFrame:
    """(ref, parent_ref, question_ref, sort_key, title, kind) of all nodes: node-1, node-2 and so on in pre-order over all roots, and q-1, q-2 ... of questions among them.

    Places come from range partitions of the paths, so numbers follow one another over all partitions without a task that sees every row. References depend on the order of the
    tree alone, not on its ids.
    """
    rows = written(tree, "tree")
    order = forest(rows, promote=True).select("id", "path").join(rows.select("id", "kind"), "id").withColumn("_all", F.lit(1))
    order = ranked(order, "_all", [F.col("path")], "_node")
    order = written(running(order, "_all", [F.col("path")], F.when(F.col("kind") == "QUESTION", 1).otherwise(0), "_question"), "order")
    ref = lambda name, n: F.concat(F.lit(f"{name}-"), (n + 1).cast("string"))
    own = order.select("id", ref("node", F.col("_node")).alias("ref"), F.when(F.col("kind") == "QUESTION", ref("q", F.col("_question"))).alias("question_ref"))
    up = own.select(F.col("id").alias("parent_id"), F.col("ref").alias("parent_ref"))
    return rows.join(own, "id").join(up, "parent_id", "left").select("ref", "parent_ref", "question_ref", "sort_key", "title", "kind")


def received(refs: DataFrame, into: str) -> DataFrame:
    """The tree of references() with new ids, hashes of the import's name and the reference: first every row gets its id, then parents are looked up among them."""
    new = written(refs.withColumn("id", F.sha2(F.concat(F.lit(f"{into}:"), "ref"), 256)), "received")
    up = new.select(F.col("ref").alias("parent_ref"), F.col("id").alias("parent_id"))
    return new.join(up, "parent_ref", "left").select("id", "parent_id", "sort_key", "title", "kind")


def _backwards(s, d) -> DataFrame:
    return nodes(s, d).withColumn("sort_key", F.concat(F.lit("a"), F.reverse(F.expr("substring(id, 2)"))))


def _received(s, d):
    """The tree sent and taken in under new ids, which are left out: parents by title and key."""
    df = received(references(_backwards(s, d)), "copy")
    up = df.select(F.col("id").alias("parent_id"), F.col("sort_key").alias("parent_key"), F.col("title").alias("parent_title"))
    return df.join(up, "parent_id", "left").select("kind", "sort_key", "title", "parent_key", "parent_title", (F.length("id") == 64).alias("new"))


QUERIES = {
    "reference_export": lambda s, d: references(_backwards(s, d)),
    "reference_import": _received,
    "portable_export": lambda s, d: sections(exported(s, d)),
    "portable_roundtrip": lambda s, d: imported(exported(s, d)),
    "portable_lost": _lost,
    "archive_counts": lambda s, d: imported(exported(s, d)).groupBy(F.left("id", F.lit(1)).alias("level")).agg(F.count("*").alias("n")),
    "classify_codes": lambda s, d: table(s, d, "part").select("p_partkey", F.expr("case p_size % 4 when 0 then 'none' when 1 then 'arabic' when 2 then 'roman' else 'alpha' end").alias("numbering"), F.expr("case when p_size <= 10 then 2 when p_size <= 30 then 5 else 7 end").alias("difficulty"), F.expr("p_size > 30").alias("coerced")),
    "classify_ext": _classify,
    "import_policy": lambda s, d: table(s, d, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey"))).select("p_partkey", F.expr("case when n = 1 then 'create' when n = 2 then 'merge' else 'skip' end").alias("action")),
    "import_report": lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("read"), F.count_distinct("text").alias("created"), (F.count("*") - F.count_distinct("text")).alias("duplicates")),
    "dry_run_counts": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").agg(F.count_if(F.col("quality").isNull()).alias("would_create"), F.count_if(F.col("quality").isNotNull()).alias("collisions")),
    "pending_queue": lambda s, d: _queue(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).where("state <> 'approved'").select("event_id", "state"),
    "queue_histogram": lambda s, d: _queue(s, d).groupBy("state").agg(F.count("*").alias("n")),
    "discard_reason": lambda s, d: questions(s, d).select("doc_id", F.expr("case when deleted then 'absent' when validation_status = 'VALID' then 'in_use' else 'discarded' end").alias("outcome")),
    "provenance": _provenance,
    "pixel_rect": _rect,
    "confidence": lambda s, d: table(s, d, "lineitem").groupBy(F.expr("case when l_discount * 10 >= 0.9 then 'high' when l_discount * 10 >= 0.6 then 'medium' else 'low' end").alias("band")).agg(F.count("*").alias("n")),
    "candidate_warn": lambda s, d: table(s, d, "documents").select("doc_id", F.concat_ws(",", F.when(F.length("text") < 20, "short"), F.when(F.col("text").contains("$$$"), "symbols"), F.when(F.col("lang") != "en", "language")).alias("warnings")),
    "relative_age": lambda s, d: table(s, d, "orders").select("o_orderkey", relative_age(F.col("o_orderdate").cast("timestamp"), F.lit("2001-01-01 12:00:00").cast("timestamp")).alias("age")),
}

_Q = "q as (select event_id, ts, case when event_id % 11 = 0 then 'approved' when event_type = 'error' then 'error' when event_type = 'view' then 'review' else 'queued' end as state from events)"
_AGE = "cast(floor({}) as bigint)"
_KEYS = "k as (select *, 'a' || reverse(substr(id, 2)) as key from nodes)"
ORACLE_SQL = {
    "reference_export": f"""with recursive {NODES_SQL}, {_KEYS}, t as (select id, [{{'k': key, 'i': id}}] as path from k where parent_id is null union all select n.id, list_append(t.path, {{'k': n.key, 'i': n.id}}) from t join k n on n.parent_id = t.id),
p as (select id, row_number() over (order by path) as n, sum((id like 'o%')::int) over (order by path) as q from t)
select 'node-' || p.n as ref, 'node-' || u.n as parent_ref, case when kind = 'QUESTION' then 'q-' || cast(p.q as bigint) end as question_ref, key as sort_key, title, kind from k join p using (id) left join p u on u.id = k.parent_id""",
    "reference_import": f"with {NODES_SQL}, {_KEYS} select k.kind, k.key as sort_key, k.title, u.key as parent_key, u.title as parent_title, true as new from k left join k u on u.id = k.parent_id",
    "portable_export": "select c_nationkey as n_nationkey, count(*) as sections, true as ok from customer group by c_nationkey",
    "portable_roundtrip": "select 'c' || c_custkey as id, 'n' || c_nationkey as parent_id from customer union all select 'o' || o_orderkey, 'c' || o_custkey from orders",
    "portable_lost": "select 'c' as level, count(*) as lost from customer where c_custkey % 100 = 7 union all select 'o', count(*) from orders where o_orderkey % 100 = 7",
    "archive_counts": "select 'c' as level, count(*) as n from customer union all select 'o', count(*) from orders",
    "classify_codes": "select p_partkey, case p_size % 4 when 0 then 'none' when 1 then 'arabic' when 2 then 'roman' else 'alpha' end as numbering, case when p_size <= 10 then 2 when p_size <= 30 then 5 else 7 end as difficulty, p_size > 30 as coerced from part",
    "classify_ext": r"select page_id, case lower(regexp_extract(url, '\.([a-z0-9]+)$', 1)) when 'html' then 'SOURCE_PAGE' when 'png' then 'FIGURE' when 'pdf' then 'DOCUMENT' else 'OTHER' end as kind from pages",
    "import_policy": "select p_partkey, case row_number() over (partition by p_name, p_brand order by p_partkey) when 1 then 'create' when 2 then 'merge' else 'skip' end as action from part",
    "import_report": "select lang, count(*) as read, count(distinct text) as created, count(*) - count(distinct text) as duplicates from documents group by lang",
    "dry_run_counts": "select count(*) filter (quality is null) as would_create, count(*) filter (quality is not null) as collisions from documents left join labels using (doc_id)",
    "pending_queue": f"with {_Q} select event_id, state from (select * from q order by ts desc, event_id desc limit 200) where state <> 'approved'",
    "queue_histogram": f"with {_Q} select state, count(*) as n from q group by state",
    "discard_reason": f"with {QUESTIONS_SQL} select doc_id, case when deleted then 'absent' when validation_status = 'VALID' then 'in_use' else 'discarded' end as outcome from questions",
    "provenance": "select o_orderkey, n_name || ', p. ' || (c_custkey % 300) || ' (' || (o_orderkey % 100) || '%)' as reference from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "pixel_rect": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(floor(l_discount * 1240) as bigint) as x0, cast(floor(l_tax * 1754) as bigint) as y0, cast(least(1240, ceil((l_discount + l_quantity / 100) * 1240)) as bigint) as x1 from lineitem",
    "confidence": "select case when l_discount * 10 >= 0.9 then 'high' when l_discount * 10 >= 0.6 then 'medium' else 'low' end as band, count(*) as n from lineitem group by band",
    "candidate_warn": "select doc_id, concat_ws(',', case when length(text) < 20 then 'short' end, case when contains(text, '$$$') then 'symbols' end, case when lang <> 'en' then 'language' end) as warnings from documents",
    "relative_age": "with a as (select o_orderkey, epoch(timestamp '2001-01-01 12:00:00') - epoch(o_orderdate) as s from orders), b as (select o_orderkey, cast(floor(s / 60) as bigint) as m, cast(floor(s / 3600) as bigint) as h, cast(floor(s / 86400) as bigint) as d from a) select o_orderkey, case when m < 1 then 'agora' when h < 1 then 'há ' || m || case when m = 1 then ' minuto' else ' minutos' end when d < 1 then 'há ' || h || case when h = 1 then ' hora' else ' horas' end when d = 1 then 'ontem' when d < 30 then 'há ' || d || case when d = 1 then ' dia' else ' dias' end when d < 365 then 'há ' || (d // 30) || case when d // 30 = 1 then ' mês' else ' meses' end else 'há ' || (d // 365) || case when d // 365 = 1 then ' ano' else ' anos' end end as age from b",
}
