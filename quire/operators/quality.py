"""Validation rules and import invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import brace_balance, dollars, isbn_valid
from quire.operators.composed import trimmed
from quire.operators.tree import _INJECTED_SQL, _injected, cycles, orphans
from quire.sources.tables import NODES_SQL, QUESTIONS_SQL, options, questions, table

#: Question types and the rules of each: most correct options that it takes, and whether it takes options.
PLUGINS = {"MULTIPLE_CHOICE": (1, True), "MULTIPLE_CORRECT": (None, True), "DISCURSIVE": (0, False)}


def correct_counts(q: DataFrame, key: str, o: DataFrame) -> DataFrame:
    """Questions with other than one correct option: missing or multiple."""
    n = o.groupBy("question").agg(F.count_if("correct").alias("n"))
    df = q.join(n, q[key] == n["question"], "left").select(q[key].alias("question"), F.coalesce("n", F.lit(0)).alias("n"))
    return df.where("n <> 1").select("question", F.when(F.col("n") == 0, "missing").otherwise("multiple").alias("problem"), "n")


def violations(parts: dict[str, DataFrame]) -> DataFrame:
    """All violations (rule, id), one table for all rules."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), F.col(df.columns[0]).cast("string").alias("id")) for rule, df in parts.items()])


def common_checks(text: Column, solution: Column) -> list[Column]:
    """struct<rule, severity> of each rule that holds for every type, null where it is kept; null texts are empty."""
    blank = lambda c: trimmed(F.coalesce(c, F.lit(""))) == ""
    told = lambda rule, severity: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    return [
        F.when(blank(text), told("statement_empty", "error")), F.when(blank(solution), told("solution_empty", "warning")),
        F.when(brace_balance(text) != 0, told("unbalanced_braces", "error")), F.when(dollars(text) % 2 == 1, told("unbalanced_math", "error")),
    ]


def common_rules(df: DataFrame, key: str, text: str, solution: str) -> DataFrame:
    """(key, rule, severity) of the rules that hold for every type."""
    checks = F.array(*common_checks(F.col(text), F.col(solution)))
    return df.select(key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x")).select(key, "x.rule", "x.severity")


def _braces(s, d):
    return table(s, d, "documents").select("doc_id", brace_balance(F.col("text")).alias("unbalanced"), dollars(F.col("text")).alias("dollars"))


def _checklist(s, d):
    o = options(s, d).groupBy("question").agg(F.count("*").alias("options"), F.count_if("correct").alias("correct"))
    df = questions(s, d).join(o, F.col("doc_id") == F.col("question"), "left").na.fill(0, ["options", "correct"])
    state = lambda ok: F.when(ok, "ok").otherwise("todo")
    return df.select("doc_id", F.concat_ws(",", state(F.length(F.trim("text")) > 0), state(F.col("options") >= 2), state(F.col("correct") == 1), state(F.col("validation_status") == "VALID")).alias("states"))


def _question_rules(s, d):
    """Worst severity of each question by the rules of its type."""
    kind = F.element_at(F.array(*[F.lit(k) for k in PLUGINS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = options(s, d).groupBy("question").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    df = table(s, d, "orders").select("o_orderkey", kind.alias("type")).join(o, F.col("o_orderkey") == F.col("question"), "left").na.fill(0, ["n", "c"])
    worst = F.expr("case when type = 'DISCURSIVE' then case when n > 0 then 'warning' else 'none' end when n < 2 or c = 0 then 'error' when type = 'MULTIPLE_CHOICE' and c > 1 then 'error' else 'none' end")
    return df.withColumn("worst", worst).groupBy("type", "worst").agg(F.count("*").alias("n"))


def _metadata(s, d):
    year = F.col("p_size") + 1980
    df = table(s, d, "part").select("p_partkey", F.when((year < 1990) | (year > 2025), "year").alias("a"), F.when(~(F.col("p_size") % 5).isin(0, 2), "difficulty").alias("b"), F.when((F.col("p_brand") == "Brand#1") & (year > 2000), "year_without_board").alias("c"))
    return df.select("p_partkey", F.concat_ws(",", "a", "b", "c").alias("problems"))


def _isbn(s, d):
    ten = F.lpad((F.col("p_partkey") * 7919).cast("string"), 9, "0")
    return table(s, d, "part").select("p_partkey", isbn_valid(F.concat(ten, (F.col("p_partkey") % 10).cast("string"))).alias("ten"), isbn_valid(F.concat(F.lit("978-"), ten, (F.col("p_partkey") % 10).cast("string"))).alias("thirteen"))


def _box(s, d):
    """Normalised boxes from prices and sizes: inside the page, with a right angle."""
    df = table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount * 10 as x", "l_tax * 10 as y", "l_quantity / 100 as w", "(l_linenumber - 1) * 45 as rotation")
    ok = "x >= 0 and y >= 0 and w > 0 and x + w <= 1.000001 and y <= 1.000001 and rotation in (0, 90, 180, 270)"
    return df.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{ok} as valid", "case when rotation <> 0 then cast(rotation as bigint) end as rotation")


def _upload(s, d):
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#]|$)", 1))
    return table(s, d, "pages").select("page_id", F.when(ext == "", "no_extension").when(~ext.isin("html", "png", "pdf"), "extension").when(F.length("html") > 20000, "size").otherwise("ok").alias("verdict"))


def import_counts(rows: DataFrame, key, skip) -> DataFrame:
    """Of imported rows how many were written, were duplicates by key or were skipped, and whether that is all of them.

    A key is counted by its hash, formed once; rows that are skipped are never written.
    """
    df = rows.select(F.sha2(key, 256).alias("k"), skip.alias("skip")).groupBy("k", "skip").agg(F.count("*").alias("n"))
    df = df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("source"), F.count_if(~F.col("skip")).alias("written"), F.coalesce(F.sum(F.when(~F.col("skip"), F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("skip"), F.col("n"))), F.lit(0)).alias("skipped"))
    return df.withColumn("balanced", F.expr("source = written + duplicates + skipped"))


def _balance(s, d):
    """Documents of fewer than five words are skipped."""
    short = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) < 5
    return import_counts(table(s, d, "documents"), F.col("text"), short)


def imported(known: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a batch that an import creates: one of each key that isn't known."""
    return batch.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")


def _rerun(s, d):
    """An import of all parts into a bank that has every third of them, and the same import again."""
    part, key = table(s, d, "part"), ["p_name", "p_brand"]
    known = part.where("p_partkey % 3 = 0")
    new = imported(known, part, key)
    again = imported(known.select(*key).union(new), part, key)
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((new, "created"), (again, "again"), (part, "rows"))]
    return counts[0].join(counts[1], F.lit(True)).join(counts[2], F.lit(True)).selectExpr("created", "again", "rows - created as kept")


def collisions(incoming: DataFrame, existing: DataFrame, signals: list[str], key: str) -> DataFrame:
    """For each signal how many incoming rows meet an existing one, and the first of them."""
    found = [incoming.join(existing.select(x).distinct(), x, "left_semi").agg(F.lit(x).alias("signal"), F.count("*").alias("n"), F.min(key).alias("first")) for x in signals]
    return reduce(DataFrame.unionByName, found)


def _collisions(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.md5(F.concat("p_name", (F.col("p_partkey") % 50).cast("string"))).alias("uuid"))
    incoming, existing = rows.where("k % 2 = 0").withColumn("legacy", F.col("k")), rows.where("k % 3 = 0").withColumn("legacy", F.col("k") + 1)
    return collisions(incoming, existing, ["legacy", "uuid"], "legacy")


QUERIES = {
    "one_correct_invariant": lambda s, d: correct_counts(table(s, d, "orders"), "o_orderkey", options(s, d)),
    "import_invariants": lambda s, d: violations({"one_correct": correct_counts(table(s, d, "orders"), "o_orderkey", options(s, d)), "orphan": orphans(_injected(s, d)), "cycle": cycles(_injected(s, d))}).groupBy("rule").agg(F.count("*").alias("n"), F.min(F.when(F.col("rule") == "orphan", "n999").otherwise(F.col("id"))).alias("first")),
    "import_balance": _balance,
    "brace_dollar_balance": _braces,
    "common_rules": lambda s, d: common_rules(table(s, d, "documents").withColumn("solution", F.expr("case when doc_id % 5 = 0 then '  ' when doc_id % 7 > 0 then lang end")), "doc_id", "text", "solution"),
    "checklist": _checklist,
    "question_rules": _question_rules,
    "metadata_rules": _metadata,
    "isbn_check": _isbn,
    "box_rules": _box,
    "upload_rules": _upload,
    "bundle_rules": lambda s, d: table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).select("p_name", "first", F.expr("case when not p_name rlike '^[a-z ]+$' then 'name' when n > 30 then 'repeated' else 'ok' end").alias("verdict")),
    "idempotent_rerun": _rerun,
    "collisions": _collisions,
}

_ISBN = "(with x as (select string_split(%s, '') as d) select sum(cast(d[i] as int) * %s) %% %s = 0 from x, range(1, %s) r(i))"
ORACLE_SQL = {
    "one_correct_invariant": "select o_orderkey as question, case when n = 0 then 'missing' else 'multiple' end as problem, n from (select o_orderkey, count(*) filter (l_returnflag = 'R') as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey) where n <> 1",
    "import_invariants": f"with recursive {NODES_SQL}, {_INJECTED_SQL}, t as (select id from small s where not exists (select 1 from small p where p.id = s.parent_id) union all select n.id from t join small n on n.parent_id = t.id), v as (select 'one_correct' as rule, cast(o_orderkey as varchar) as id from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey having count(*) filter (l_returnflag = 'R') <> 1 union all select 'orphan', id from small s where parent_id is not null and not exists (select 1 from small p where p.id = s.parent_id) union all select 'cycle', id from small where id not in (select id from t)) select rule, count(*) as n, min(case when rule = 'orphan' then 'n999' else id end) as first from v group by rule",
    "import_balance": "with d as (select text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) < 5 as short from documents) select count(*) as source, count(distinct text) filter (not short) as written, count(*) filter (not short) - count(distinct text) filter (not short) as duplicates, count(*) filter (short) as skipped, true as balanced from d",
    "brace_dollar_balance": r"with t as (select doc_id, regexp_replace(text, '\\[\s\S]', '', 'g') as x from documents) select doc_id, length(x) - length(replace(x, '{', '')) - (length(x) - length(replace(x, '}', ''))) as unbalanced, length(x) - length(replace(x, '$', '')) as dollars from t",
    "common_rules": r"with t as (select doc_id, text, regexp_replace(text, '\\[\s\S]', '', 'g') as x from documents) select doc_id, 'statement_empty' as rule, 'error' as severity from t where trim(text) = '' union all select doc_id, 'solution_empty', 'warning' from documents where doc_id % 5 = 0 or doc_id % 7 = 0 or lang is null union all select doc_id, 'unbalanced_braces', 'error' from t where length(replace(x, '{', '')) <> length(replace(x, '}', '')) union all select doc_id, 'unbalanced_math', 'error' from t where (length(x) - length(replace(x, '$', ''))) % 2 = 1",
    "checklist": f"with {QUESTIONS_SQL}, o as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as c from lineitem group by l_orderkey) select doc_id, concat_ws(',', case when length(trim(text)) > 0 then 'ok' else 'todo' end, case when n >= 2 then 'ok' else 'todo' end, case when c = 1 then 'ok' else 'todo' end, case when validation_status = 'VALID' then 'ok' else 'todo' end) as states from questions left join o on l_orderkey = doc_id",
    "question_rules": "with o as (select o_orderkey, ['MULTIPLE_CHOICE', 'MULTIPLE_CORRECT', 'DISCURSIVE'][o_orderkey % 3 + 1] as type, count(l_orderkey) as n, count(*) filter (l_returnflag = 'R') as c from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey), w as (select type, case when type = 'DISCURSIVE' then case when n > 0 then 'warning' else 'none' end when n < 2 or c = 0 then 'error' when type = 'MULTIPLE_CHOICE' and c > 1 then 'error' else 'none' end as worst from o) select type, worst, count(*) as n from w group by all",
    "metadata_rules": "select p_partkey, concat_ws(',', case when p_size + 1980 < 1990 or p_size + 1980 > 2025 then 'year' end, case when p_size % 5 not in (0, 2) then 'difficulty' end, case when p_brand = 'Brand#1' and p_size + 1980 > 2000 then 'year_without_board' end) as problems from part",
    "isbn_check": f"with p as (select p_partkey, lpad(cast(p_partkey * 7919 as varchar), 9, '0') || cast(p_partkey % 10 as varchar) as i from part) select p_partkey, {_ISBN % ('i', '(11 - i)', '11', '11')} as ten, {_ISBN % (chr(39) + '978' + chr(39) + ' || i', 'case when i % 2 = 1 then 1 else 3 end', '10', '14')} as thirteen from p",
    "box_rules": "with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 as x, l_tax * 10 as y, l_quantity / 100 as w, (l_linenumber - 1) * 45 as rotation from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, x >= 0 and y >= 0 and w > 0 and x + w <= 1.000001 and y <= 1.000001 and rotation in (0, 90, 180, 270) as valid, case when rotation <> 0 then cast(rotation as bigint) end as rotation from b",
    "upload_rules": r"with p as (select page_id, html, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#]|$)', 1)) as ext from pages) select page_id, case when ext = '' then 'no_extension' when ext not in ('html', 'png', 'pdf') then 'extension' when length(html) > 20000 then 'size' else 'ok' end as verdict from p",
    "bundle_rules": "select p_name, min(p_partkey) as first, case when not regexp_full_match(p_name, '[a-z ]+') then 'name' when count(*) > 30 then 'repeated' else 'ok' end as verdict from part group by p_name",
    "idempotent_rerun": "with k as (select distinct p_name, p_brand from part where p_partkey % 3 = 0), b as (select distinct p_name, p_brand from part), n as (select * from b except select * from k) select (select count(*) from n) as created, (select count(*) from (select * from b except (select * from k union select * from n))) as again, (select count(*) from part) - (select count(*) from n) as kept",
    "collisions": "with i as (select p_partkey as legacy, md5(p_name || p_partkey % 50) as uuid from part where p_partkey % 2 = 0), e as (select p_partkey + 1 as legacy, md5(p_name || p_partkey % 50) as uuid from part where p_partkey % 3 = 0) select 'legacy' as signal, count(*) as n, min(legacy) as first from i where legacy in (select legacy from e) union all select 'uuid', count(*), min(legacy) from i where uuid in (select uuid from e)",
}
