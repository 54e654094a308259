"""Counts, facets, dashboards, and the latest, next, best and first rows of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import tag_key
from quire.operators.search import latest_with
from quire.sources.tables import QUESTIONS_SQL, options, questions, table


def tag_facets(df: DataFrame, key: str, tags: Column) -> DataFrame:
    """Each tag key once per row, with its first spelling; the most frequent first, then by label as Portuguese sorts it."""
    each = df.select(key, F.posexplode(tags).alias("pos", "name")).withColumn("key", tag_key(F.col("name"))).where("key <> ''")
    one = each.groupBy(key, "key").agg(F.min_by("name", "pos").alias("name"))
    return one.groupBy("key").agg(F.count("*").alias("n"), F.min_by("name", key).alias("label")).orderBy(F.desc("n"), *portuguese(F.col("label")))


def portuguese(text: Column) -> list[Column]:
    """Order of texts in Portuguese: by letters, then accents, then case, then bytes."""
    return [F.collate(text, "pt"), text]


def best_per_key(df: DataFrame, key: list[str], richness: Column, position: str) -> DataFrame:
    """The richest row of each key, first among equals, at the place of the key's first row."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(richness, -F.col(position))).alias("_best"), F.min(position).alias("place"))
    return best.select(*key, "_best.*", "place")


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of the latest row of each key, by one aggregation without a sort."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order))[order[0]].alias(order[0]))


def _tag_facets(s, d):
    return tag_facets(table(s, d, "part"), "p_partkey", F.split("p_name", " "))


def _dashboard(s, d):
    failed = F.col("event_type") == "error"
    return table(s, d, "events").agg(F.count("*").alias("jobs"), F.count_if(failed).alias("failed"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("total"), F.max_by("event_id", F.when(failed, F.struct("ts", "event_id"))).alias("last_failed"))


def _dup_options(s, d):
    o = options(s, d)
    w = Window.partitionBy("question", "part").orderBy("at")
    return o.withColumn("n", F.row_number().over(w)).where("n > 1").select("question", "number", "part")


def _two_level(s, d):
    per = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("total"), F.max("n").alias("most"))


def _budget(s, d):
    df = table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " › ").alias("path"))
    return df.withColumn("fits", F.col("chars") <= 3000)


QUERIES = {
    "tag_facets": _tag_facets,
    "catalog_by_format": lambda s, d: table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")),
    "render_dashboard": _dashboard,
    "latest_render": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").cast("timestamp").alias("ts")),
    "next_revision": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.max_by("role", "turn").alias("last_role")),
    "best_row_per_key": lambda s, d: best_per_key(table(s, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], F.col("n_chars"), "doc_id").select("source", "lang", "doc_id", "n_chars", "place"),
    "dup_options": _dup_options,
    "invalid_count": lambda s, d: questions(s, d).agg(F.count_if(F.col("validation_status") == "INVALID").alias("invalid")),
    "child_counts": lambda s, d: table(s, d, "region").join(table(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("k")), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "r_name", F.coalesce("k", F.lit(0)).cast("long").alias("publications")),
    "two_level_sum": _two_level,
    "totals": lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("archives"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"), ((F.count_if(F.col("l_quantity") < 1) == 0) & (F.count("*") >= 1)).alias("ok")),
    "context_budget": _budget,
    "state_histogram": lambda s, d: table(s, d, "events").agg(*[F.count_if(F.col("event_type") == x).alias(x) for x in ("click", "error", "purchase", "never")]),
    "array_set_ops": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")),
    "proposal_dedupe": lambda s, d: table(s, d, "conversations").groupBy("role", F.sha2("text", 256).alias("sha256")).agg(F.min(F.struct("conv_id", "turn")).alias("f"), F.count("*").alias("n")).select("role", "sha256", F.col("f.conv_id").alias("conv_id"), F.col("f.turn").alias("turn"), "n"),
    "content_hash_dedupe": lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")),
    "json_first_error": lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("L"), F.from_json("props", "k int")["k"].cast("string"), F.lit(": error")).alias("message")),
    "relative_order": lambda s, d: latest_with(table(s, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 1).select("o_custkey", F.col("o_orderkey").alias("first_order")),
}

ORACLE_SQL = {
    "tag_facets": "with t as (select p_partkey, unnest(string_split(p_name, ' ')) as name, generate_subscripts(string_split(p_name, ' '), 1) as pos from part), o as (select p_partkey, lower(name) as key, arg_min(name, pos) as name from t group by p_partkey, lower(name)) select key, count(*) as n, arg_min(name, p_partkey) as label from o group by key",
    "catalog_by_format": "select p_type, count(*) as n from part group by p_type",
    "render_dashboard": "select count(*) as jobs, count(*) filter (event_type = 'error') as failed, coalesce(round(sum(value), 4), 0) as total, arg_max(event_id, (ts, event_id)) filter (event_type = 'error') as last_failed from events",
    "latest_render": "select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as ts from events group by user_id",
    "next_revision": "select conv_id, max(turn) + 1 as next_turn, arg_max(role, turn) as last_role from conversations group by conv_id",
    "best_row_per_key": "select source, lang, doc_id, n_chars, min(doc_id) over (partition by source, lang) as place from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1",
    "dup_options": "select l_orderkey as question, l_linenumber as number, l_partkey as part from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1",
    "invalid_count": "select count(*) filter (quality = 0) as invalid from documents left join labels using (doc_id)",
    "child_counts": "select r_regionkey, r_name, (select count(*) from nation where n_regionkey = r_regionkey) as publications from region",
    "two_level_sum": "select c_nationkey, cast(sum(n) as bigint) as total, max(n) as most from (select o_custkey, count(*) as n from orders group by o_custkey) join customer on o_custkey = c_custkey group by c_nationkey",
    "totals": "select count(*) as archives, cast(sum(cast(l_quantity as bigint)) as bigint) as bytes, count(*) filter (l_quantity < 1) = 0 and count(*) >= 1 as ok from lineitem",
    "context_budget": "select conv_id, cast(sum(length(text)) as bigint) as chars, string_agg(role, ' › ' order by turn) as path, sum(length(text)) <= 3000 as fits from conversations group by conv_id",
    "state_histogram": "select count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'never') as never from events",
    "array_set_ops": "select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds from events group by user_id",
    "proposal_dedupe": "select role, sha256(text) as sha256, arg_min(conv_id, (conv_id, turn)) as conv_id, arg_min(turn, (conv_id, turn)) as turn, count(*) as n from conversations group by role, sha256(text)",
    "content_hash_dedupe": "select sha256(text) as sha256, count(*) as copies, min(doc_id) as first from documents group by sha256(text)",
    "json_first_error": "select event_id, 'L' || json_extract_string(props, '$.k') || ': error' as message from events where event_type = 'error'",
    "relative_order": "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order from orders group by o_custkey",
}
