"""Trees as adjacency lists: forests, pre-order, subtrees, filters that keep ancestors, orphans and cycles.

Pointers to parents are doubled in written tables, so the rounds are the logarithm of the depth, and no depth, number of rows or
cycle is too much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import excerpt, fold
from quire.operators.ranges import ranked
from quire.sources.tables import NODES_SQL, QUESTIONS_SQL, nodes, questions, table, written

CONTAINERS = ("CHAPTER", "SECTION")


def climbed(rows: DataFrame) -> DataFrame:
    """rows (id, up, path) as id, root, depth and path: the end of up to which a row leads, its distance and the paths on the way.

    Rows that lead to no end, in or below a cycle or a missing row, are left out. A row's pointer doubles in each round, so a round
    in which no row arrives shows that none is on the way any more.
    """
    at = written(rows.selectExpr("id", "coalesce(up, id) as top", "if(up is null, 0, 1) as depth", "path", "up is null as done"), "climbed")
    left = None
    while (n := at.where("not done").count()) not in (0, left):
        left = n
        above = at.selectExpr("id as top", "top as _top", "depth as _depth", "path as _path", "done as _done")
        more = at.where("not done").join(above, "top").selectExpr("id", "_top as top", "depth + _depth as depth", "concat(_path, path) as path", "_done as done")
        at = written(at.where("done").unionByName(more), "climbed")
    return at.where("done").selectExpr("id", "top as root", "depth", "path")


def cycle_starts(rows: DataFrame) -> DataFrame:
    """The least id of each cycle among rows (id, up) that all are in or below one.

    After at least as many steps as there are rows all pointers are on cycles, and each row of a cycle is pointed to.
    """
    n, steps = rows.count(), 1
    at = rows.selectExpr("id", "up as top", "id as low")
    while steps < n:
        above = at.selectExpr("id as top", "top as _top", "low as _low")
        at, steps = written(at.join(above, "top").selectExpr("id", "_top as top", "least(low, _low) as low"), "cycles"), 2 * steps
    return at.where("id = low").select("id").join(at.selectExpr("top as id").distinct(), "id", "left_semi")


def forest(df: DataFrame, promote: bool = False) -> DataFrame:
    """id, root, depth and path of each row; rows whose parent is missing are roots.

    path is an array of (sort key, id) from the root down; such arrays sort as the rows do in pre-order, whatever characters keys and ids have.

    Rows in or below a cycle are reached from no root. With promote the least id of each cycle is made a root, so that every row is
    kept once; else they are left out here and found by cycles().
    """
    ids = df.select(F.col("id").alias("up"))
    rows = written(df.join(ids, df["parent_id"] == ids["up"], "left").selectExpr("id", "up", "array(struct(sort_key, id)) as path"), "nodes")
    found = climbed(rows)
    if not promote:
        return found
    loose = written(rows.join(found.select("id"), "id", "left_anti"), "loose")
    if loose.isEmpty():
        return found
    starts = cycle_starts(loose).withColumn("start", F.lit(True))
    return found.unionByName(climbed(loose.join(starts, "id", "left").selectExpr("id", "if(start, null, up) as up", "path")))


def subtree(df: DataFrame, root: str) -> DataFrame:
    """id and depth of root and all below it; root's own parent doesn't count, so cycles end."""
    rows = df.select("id", F.when(F.col("id") != root, F.col("parent_id")).alias("up"), F.array().cast("array<string>").alias("path"))
    return climbed(rows).where(F.col("root") == root).select("id", "depth")


def with_ancestors(df: DataFrame, hits: DataFrame) -> DataFrame:
    """id, and whether it is a hit, of the hits and all their ancestors.

    Rows seen so far hold all ancestors nearer than a jump; when jumps from them lead to rows seen alone, none is missing.
    """
    hits = written(df.select("id").join(hits.select("id"), "id", "left_semi").distinct(), "hits")
    ids = df.select(F.col("id").alias("up"))
    jump = written(df.selectExpr("id", "parent_id as up").join(ids, "up", "left_semi").select("id", "up"), "jumps")
    seen = hits
    while not (new := written(seen.join(jump, "id").selectExpr("up as id").distinct().join(seen, "id", "left_anti"), "ancestors")).isEmpty():
        seen = seen.union(new)
        jump = written(jump.join(jump.selectExpr("id as up", "up as next"), "up").selectExpr("id", "next as up"), "jumps")
    return seen.join(hits.withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


def orphans(df: DataFrame) -> DataFrame:
    return df.where("parent_id is not null").join(df.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def cycles(df: DataFrame) -> DataFrame:
    """Ids in a cycle or leading into one: those that no root reaches."""
    return df.select("id").join(forest(df).select("id"), "id", "left_anti")


def node_status(latest: str, validation: str, unsaved: str = "false"):
    """Unsaved work and failures first, then validation, then the last render."""
    return F.expr(f"case when {unsaved} then 'unsaved' when {latest} = 'error' then 'render_failed' when {validation} = 'INVALID' then 'invalid' when {validation} = 'VALID' then 'valid' when {latest} is not null then 'render_done' end")


def _injected(s, d):
    """The tree with every 50th customer's nation missing, and orders in cycles of three."""
    df = nodes(s, d).withColumn("parent_id", F.expr("case when kind = 'SECTION' and cast(substring(id, 2) as bigint) % 50 = 0 then 'n999' else parent_id end"))
    loops = s.range(30).selectExpr("concat('x', id) as id", "concat('x', id div 3 * 3 + (id + 1) % 3) as parent_id", "lpad(id, 9, '0') as sort_key", "'loop' as title", "'SECTION' as kind")
    tail = s.range(5).selectExpr("concat('y', id) as id", "concat('x', id) as parent_id", "lpad(id, 9, '0') as sort_key", "'tail' as title", "'SECTION' as kind")
    return df.unionByName(loops).unionByName(tail)


_INJECTED_SQL = """small as (select id, case when kind = 'SECTION' and cast(substr(id, 2) as bigint) % 50 = 0 then 'n999' else parent_id end as parent_id from nodes
  union all select 'x' || i, 'x' || (i // 3 * 3 + (i + 1) % 3) from range(30) r(i) union all select 'y' || i, 'x' || i from range(5) r(i))"""


def _filter(s, d):
    tree = nodes(s, d)
    hits = tree.where((F.col("kind") == "QUESTION") & fold(F.col("title")).contains("urgent"))
    return with_ancestors(tree, hits)


def _path(s, d):
    """Titles from the root down to an order, blank ones left out: a join per level, five at most."""
    tree = nodes(s, d).select("id", "parent_id", "title")
    df = tree.where("id like 'o%'").select("id", F.col("parent_id").alias("up"), F.array("title").alias("titles"))
    for _ in range(5):
        level = tree.select(F.col("id").alias("up"), F.col("parent_id").alias("next"), "title")
        df = df.join(level, "up", "left").select("id", F.col("next").alias("up"), F.concat(F.array("title"), F.col("titles")).alias("titles"))
    return df.select("id", F.array_join(F.filter("titles", lambda x: F.trim(x) != ""), " › ").alias("path"))


def _status(s, d):
    last = table(s, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return questions(s, d).join(last, "doc_id", "left").select("doc_id", node_status("latest", "validation_status", "doc_id % 9 = 4").alias("status"), F.expr("coalesce(latest = 'error', false) or validation_status = 'INVALID'").alias("has_problem"))


def copy_plan(tree: DataFrame, root: str, children: dict[str, DataFrame]) -> DataFrame:
    """What a copy of a subtree writes, in this order: (kind, id, new_id, new_parent, sort_key, place, status, render).

    Nodes come in pre-order, then the rows of children (name -> id, parent, sort_key), each kind in the order of its node and its keys. Keys are kept; the top keeps its
    parent; nodes become drafts that were never rendered.
    """
    rows = written(tree.join(subtree(tree, root).select("id"), "id", "left_semi"), "subtree")
    order = preorder(rows.withColumn("parent_id", F.when(F.col("id") != root, F.col("parent_id"))))
    new = lambda c: F.concat(F.lit("copy-"), c)
    top = F.when(F.col("id") == root, F.col("parent_id")).otherwise(new(F.col("parent_id")))
    nodes_ = rows.join(order.select("id", "place"), "id").select(F.lit("node").alias("kind"), "id", new(F.col("id")).alias("new_id"), top.alias("new_parent"), "sort_key", "place", F.lit("DRAFT").alias("status"), F.lit(None).cast("string").alias("render"))
    out = nodes_
    for name, df in children.items():
        own = df.join(order.select(F.col("id").alias("parent"), F.col("place").alias("_node")), "parent")
        own = ranked(own.withColumn("_all", F.lit(1)), "_all", [F.col("_node"), F.col("sort_key"), F.col("id")])
        none = F.lit(None).cast("string")
        out = out.union(own.select(F.lit(name), "id", new(F.col("id")), new(F.col("parent")), "sort_key", "place", none, none))
    return out


def _copy_plan(s, d):
    """A customer's subtree with the lines of its orders as options and their flags as tags."""
    tree = nodes(s, d).withColumn("sort_key", F.concat(F.lit("a"), F.reverse(F.expr("substring(id, 2)"))))
    line = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)")).alias("id"), F.lpad("l_linenumber", 3, "0").alias("sort_key"), "l_returnflag")
    tags = line.select("parent", F.concat_ws("-", "parent", "l_returnflag").alias("id"), F.col("l_returnflag").alias("sort_key")).distinct()
    return copy_plan(tree, "c7", {"option": line.select("parent", "id", "sort_key"), "tag": tags})


def _title(s, d):
    text = excerpt(F.regexp_replace("text", r"[|#*$%&]", " "), 57)
    return table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Questão "), F.col("doc_id").cast("string"))).when(F.length("text") > 30, text).otherwise("Sem título").alias("title"))


def restorable(tree: DataFrame) -> DataFrame:
    """Deleted rows of a tree (id, parent_id, deleted): ok, or refused while their parent is deleted."""
    gone = tree.where("deleted")
    above = gone.select(F.col("id").alias("parent_id"), F.lit(True).alias("held"))
    return gone.join(above, "parent_id", "left").select("id", F.when(F.col("held"), "parent_deleted").otherwise("ok").alias("reason"))


def _restore(s, d):
    return restorable(nodes(s, d).withColumn("deleted", F.expr("cast(substring(id, 2) as bigint) % 3 = 0")))


def preorder(df: DataFrame) -> DataFrame:
    """id, root, depth and place: where each row comes among those of its root when the tree is read from the top, from 0."""
    return ranked(forest(df, promote=True), "root", [F.col("path")]).select("id", "root", "depth", "place")


def _preorder(s, d):
    """The tree with keys of many lengths, of which some begin others: numbers backwards."""
    return preorder(nodes(s, d).withColumn("sort_key", F.concat(F.lit("a"), F.reverse(F.expr("substring(id, 2)")))))


QUERIES = {
    "tree_preorder": _preorder,
    "subtree": lambda s, d: subtree(nodes(s, d), "n3"),
    "soft_delete_subtree": lambda s, d: nodes(s, d).join(subtree(nodes(s, d), "n5").select("id", F.lit(True).alias("x")), "id", "left").groupBy("kind", F.coalesce("x", F.lit(False)).alias("deleted")).agg(F.count("*").alias("n")),
    "tree_filter_ancestors": _filter,
    "ancestor_path": _path,
    "orphans": lambda s, d: orphans(_injected(s, d)),
    "cycles": lambda s, d: cycles(_injected(s, d)),
    "node_status": _status,
    "move_guard": lambda s, d: nodes(s, d).select(F.col("id").alias("target")).join(subtree(nodes(s, d), "n4").select(F.col("id").alias("target"), F.lit(True).alias("inside")), "target", "left").select("target", F.col("inside").isNull().alias("allowed")),
    "restore_guard": _restore,
    "container_rule": lambda s, d: nodes(s, d).groupBy("kind", F.when(F.col("kind").isin(*CONTAINERS), "lastChild").otherwise("after").alias("placement")).agg(F.count("*").alias("n")),
    "subtree_copy_plan": _copy_plan,
    "node_title": _title,
    "distinct_kinds": lambda s, d: nodes(s, d).groupBy(F.right("id", F.lit(1)).alias("digit"), F.length("id").alias("size")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")),
}

_WALK = "k as (select *, 'a' || reverse(substr(id, 2)) as key from nodes), t as (select id, id as root, 0 as depth, [{'k': key, 'i': id}] as path from k where parent_id is null union all select n.id, t.root, t.depth + 1, list_append(t.path, {'k': n.key, 'i': n.id}) from t join k n on n.parent_id = t.id)"
_TITLE = "trim(regexp_replace(regexp_replace(text, '[|#*$%&]', ' ', 'g'), '[\\s\\x{00a0}]+', ' ', 'g'))"
_SUB = "t as (select id, 0 as depth from nodes where id = '{}' union all select n.id, t.depth + 1 from t join nodes n on n.parent_id = t.id)"
ORACLE_SQL = {
    "tree_preorder": f"with recursive {NODES_SQL}, {_WALK} select id, root, depth, row_number() over (partition by root order by path) - 1 as place from t",
    "subtree": f"with recursive {NODES_SQL}, {_SUB.format('n3')} select * from t",
    "soft_delete_subtree": f"with recursive {NODES_SQL}, {_SUB.format('n5')} select kind, id in (select id from t) as deleted, count(*) as n from nodes group by all",
    "tree_filter_ancestors": f"with recursive {NODES_SQL}, t as (select id, parent_id, true as hit from nodes where kind = 'QUESTION' and contains(lower(title), 'urgent') union all select n.id, n.parent_id, false from t join nodes n on n.id = t.parent_id) select id, max(hit) as hit from t group by id",
    "ancestor_path": "select 'o' || o_orderkey as id, n_name || ' › ' || c_name || ' › ' || o_orderpriority as path from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "orphans": f"with {NODES_SQL}, {_INJECTED_SQL} select id, parent_id from small s where parent_id is not null and not exists (select 1 from small p where p.id = s.parent_id)",
    "cycles": f"with recursive {NODES_SQL}, {_INJECTED_SQL}, t as (select id from small s where not exists (select 1 from small p where p.id = s.parent_id) union all select n.id from t join small n on n.parent_id = t.id) select id from small where id not in (select id from t)",
    "node_status": f"with {QUESTIONS_SQL}, last as (select user_id, arg_max(event_type, (ts, event_id)) as latest from events group by user_id) select doc_id, case when doc_id % 9 = 4 then 'unsaved' when latest = 'error' then 'render_failed' when validation_status = 'INVALID' then 'invalid' when validation_status = 'VALID' then 'valid' when latest is not null then 'render_done' end as status, coalesce(latest = 'error', false) or validation_status = 'INVALID' as has_problem from questions left join last on user_id = doc_id",
    "move_guard": f"with recursive {NODES_SQL}, {_SUB.format('n4')} select id as target, id not in (select id from t) as allowed from nodes",
    "restore_guard": f"with {NODES_SQL}, g as (select id, parent_id, kind, hash_of % 3 = 0 as deleted from (select *, cast(substr(id, 2) as bigint) as hash_of from nodes)) select id, case when exists (select 1 from g p where p.id = g.parent_id and p.deleted) then 'parent_deleted' else 'ok' end as reason from g where deleted",
    "container_rule": f"with {NODES_SQL} select kind, case when kind in ('CHAPTER', 'SECTION') then 'lastChild' else 'after' end as placement, count(*) as n from nodes group by all",
    "subtree_copy_plan": f"""with recursive {NODES_SQL}, k as (select *, 'a' || reverse(substr(id, 2)) as key from nodes), t as (select id, parent_id, key, [{{'k': key, 'i': id}}] as path from k where id = 'c7' union all select n.id, n.parent_id, n.key, list_append(t.path, {{'k': n.key, 'i': n.id}}) from t join k n on n.parent_id = t.id),
p as (select *, row_number() over (order by path) - 1 as place from t), l as (select p.id as parent, place as node, l_returnflag as tag, lpad(cast(l_linenumber as varchar), 3, '0') as key, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_extendedprice as decimal(20, 2)) as id from lineitem join p on p.id = 'o' || l_orderkey),
g as (select distinct parent, node, parent || '-' || tag as id, tag as key from l)
select 'node' as kind, id, 'copy-' || id as new_id, case when id = 'c7' then parent_id else 'copy-' || parent_id end as new_parent, key as sort_key, place, 'DRAFT' as status, cast(null as varchar) as render from p
union all select 'option', id, 'copy-' || id, 'copy-' || parent, key, row_number() over (order by node, key, id) - 1, null, null from l union all select 'tag', id, 'copy-' || id, 'copy-' || parent, key, row_number() over (order by node, key, id) - 1, null, null from g""",
    "node_title": f"select doc_id, case when doc_id % 5 = 0 then 'Questão ' || doc_id when length(text) > 30 then case when length({_TITLE}) > 57 then left({_TITLE}, 57) || '…' else {_TITLE} end else 'Sem título' end as title from documents",
    "distinct_kinds": f"with {NODES_SQL} select right(id, 1) as digit, cast(length(id) as int) as size, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from nodes group by right(id, 1), length(id)",
}
