"""Revisions, patches and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import options, table


def versions(s, d) -> DataFrame:
    """Each turn beside the next one of its conversation, as two snapshots of an entity."""
    df = table(s, d, "conversations")
    after = df.selectExpr("conv_id", "turn - 1 as turn", "role as role2", "text as text2")
    return df.join(after, ["conv_id", "turn"])


def word_changes(before, after) -> tuple:
    """Words added and removed, as sorted sets."""
    split = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return F.array_sort(F.array_except(split(after), split(before))), F.array_sort(F.array_except(split(before), split(after)))


def _snapshot_diff(s, d):
    added, removed = word_changes(F.col("text"), F.col("text2"))
    return versions(s, d).select("conv_id", "turn", (F.col("role") != F.col("role2")).alias("role_changed"), F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"))


def _option_diff(s, d):
    """Options of orders 2k and 2k + 1 as two snapshots: added, removed, changed, by part; a full outer join."""
    o = options(s, d).groupBy("question", "part").agg(F.max("quantity").alias("quantity"))
    a = o.where("question % 2 = 0").selectExpr("question div 2 as q", "part", "quantity as qa")
    b = o.where("question % 2 = 1").selectExpr("question div 2 as q", "part", "quantity as qb")
    df = a.join(b, ["q", "part"], "full").withColumn("change", F.expr("case when qa is null then 'added' when qb is null then 'removed' when qa <> qb then 'changed' end"))
    return df.where("change is not null").select("q", "part", "change")


def _partial(s, d):
    """Approved changes that are still live are applied; others are stale."""
    live = table(s, d, "conversations").where("turn % 2 = 0").select("conv_id", "turn", F.lit(True).alias("live"))
    approved = table(s, d, "conversations").where("(conv_id + turn) % 3 = 0").select("conv_id", "turn")
    return approved.join(live, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("live"), "applied").otherwise("stale").alias("outcome"))


def _defaults(s, d):
    """Snapshots as JSON of which some lack fields; what lacks gets a default."""
    df = table(s, d, "events").select("event_id", F.from_json("props", "k int, label string, tags array<string>").alias("x"))
    return df.select("event_id", F.coalesce("x.k", F.lit(0)).alias("k"), F.coalesce("x.label", F.lit("")).alias("label"), F.coalesce(F.size("x.tags"), F.lit(0)).cast("long").alias("tags"))


def exclusive(o: DataFrame) -> DataFrame:
    """Making the first line of each order the one correct option: only lines that change."""
    first = o.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("f"))
    now = (F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice") == F.col("f")).alias("now")
    return o.join(first, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", now, (F.col("l_returnflag") == "R").alias("was")).where("now <> was")


QUERIES = {
    "snapshot_diff": _snapshot_diff,
    "option_diff": _option_diff,
    "snapshot_defaults": _defaults,
    "patch_diff": lambda s, d: versions(s, d).where("text <> text2").select("conv_id", "turn", (F.length("text2") - F.length("text")).cast("long").alias("delta")),
    "partial_apply": _partial,
    "patch_rules": lambda s, d: options(s, d).groupBy("question").agg(F.count_if("correct").alias("c"), F.count("*").alias("n"), F.count_distinct("part").alias("k")).where("c > 1 or n <> k").select("question", F.expr("case when c > 1 then 'many_correct' else 'repeated_option' end").alias("refusal")),
    "exclusive_answer": lambda s, d: exclusive(table(s, d, "lineitem")),
    "changed_fields": lambda s, d: versions(s, d).select("conv_id", "turn", F.concat_ws(",", F.when(F.expr("role is distinct from role2"), "role"), F.when(F.expr("text is distinct from text2"), "text"), F.when(F.expr("left(text, 1) is distinct from left(text2, 1)"), "initial")).alias("changed")),
    "revision_list": lambda s, d: table(s, d, "conversations").where("conv_id = 3").orderBy(F.desc("turn")).limit(50).select("turn", "role"),
}

_V = "v as (select a.conv_id, a.turn, a.role, a.text, b.role as role2, b.text as text2 from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"
_W = "list_distinct(regexp_split_to_array(lower({}), '\\s+'))"
ORACLE_SQL = {
    "snapshot_diff": f"with {_V}, w as (select *, {_W.format('text')} as a, {_W.format('text2')} as b from v) select conv_id, turn, role <> role2 as role_changed, len(list_filter(b, lambda x: not list_contains(a, x))) as added, len(list_filter(a, lambda x: not list_contains(b, x))) as removed from w",
    "option_diff": "with o as (select l_orderkey as question, l_partkey as part, max(l_quantity) as quantity from lineitem group by all), a as (select question // 2 as q, part, quantity as qa from o where question % 2 = 0), b as (select question // 2 as q, part, quantity as qb from o where question % 2 = 1) select q, part, case when qa is null then 'added' when qb is null then 'removed' else 'changed' end as change from a full join b using (q, part) where qa is distinct from qb",
    "snapshot_defaults": "select event_id, coalesce(cast(json_extract_string(props, '$.k') as int), 0) as k, '' as label, cast(0 as bigint) as tags from events",
    "patch_diff": f"with {_V} select conv_id, turn, length(text2) - length(text) as delta from v where text <> text2",
    "partial_apply": "select conv_id, turn, case when turn % 2 = 0 then 'applied' else 'stale' end as outcome from conversations where (conv_id + turn) % 3 = 0",
    "patch_rules": "select l_orderkey as question, case when count(*) filter (l_returnflag = 'R') > 1 then 'many_correct' else 'repeated_option' end as refusal from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') > 1 or count(*) <> count(distinct l_partkey)",
    "exclusive_answer": "with o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 as now, l_returnflag = 'R' as was from lineitem) select l_orderkey, l_linenumber, l_partkey, now, was from o where now <> was",
    "changed_fields": f"with {_V} select conv_id, turn, concat_ws(',', case when role is distinct from role2 then 'role' end, case when text is distinct from text2 then 'text' end, case when left(text, 1) is distinct from left(text2, 1) then 'initial' end) as changed from v",
    "revision_list": "select turn, role from conversations where conv_id = 3 order by turn desc limit 50",
}
