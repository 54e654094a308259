"""Question types as plugins: a registry of rules by type, and the validation of questions by them.

A rule is a code, a severity and how often it is broken, an expression over counts of a question's options: n, correct, blank
(without text) and repeated (nonblank texts beyond the first of their kind). New types are registered by name; questions of a
type that nobody registered stay UNVALIDATED, since nothing can be said of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.quality import common_checks
from quire.sources.tables import table


class Rule(NamedTuple):
    code: str
    severity: str
    times: str


FEW, NONE, BLANK = Rule("too_few_options", "error", "if(n < 2, 1, 0)"), Rule("no_correct_option", "error", "if(correct = 0, 1, 0)"), Rule("empty_option", "error", "blank")
REGISTRY: dict[str, tuple[Rule, ...]] = {}


def register(kind: str, *rules: Rule) -> None:
    """Adds or replaces the rules of a type."""
    REGISTRY[kind] = rules


register("MULTIPLE_CHOICE", FEW, NONE, Rule("multiple_correct_options", "error", "if(correct > 1, 1, 0)"), BLANK, Rule("duplicate_option", "warning", "repeated"))
register("MULTIPLE_CORRECT", FEW, NONE, Rule("all_options_correct", "warning", "if(correct = n and n > 0, 1, 0)"), Rule("single_correct_option", "warning", "if(correct = 1, 1, 0)"), BLANK)
register("DISCURSIVE", Rule("discursive_has_options", "warning", "if(n > 0, 1, 0)"))


def issues(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(id, code, severity, times) of all broken rules; questions (id, type, text, solution), options (question, text, correct).

    Repeats are counted by texts within a question, formed before the shuffle; no question's options are gathered.
    """
    by = options.select("question", F.trim("text").alias("t"), "correct").groupBy("question", "t").agg(F.count("*").alias("k"), F.count_if("correct").alias("c"))
    by = by.groupBy("question").agg(F.sum("k").alias("n"), F.sum("c").alias("correct"), F.coalesce(F.sum(F.expr("if(t = '', k, 0)")), F.lit(0)).alias("blank"), F.coalesce(F.sum(F.expr("if(t <> '', k - 1, 0)")), F.lit(0)).alias("repeated"))
    df = questions.join(by, questions["id"] == by["question"], "left").na.fill(0, ["n", "correct", "blank", "repeated"])
    rule = lambda code, severity, times: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), times.cast("long").alias("times"))
    told = [F.when(x.isNotNull(), F.struct(x["rule"].alias("code"), x["severity"].alias("severity"), F.lit(1).cast("long").alias("times"))) for x in common_checks(F.col("text"), F.col("solution"))]
    told = [F.when(F.col("type").isin(*REGISTRY), x) for x in told]
    told += [F.when(F.col("type") == kind, rule(r.code, r.severity, F.expr(r.times))) for kind, rules in REGISTRY.items() for r in rules]
    return df.select("id", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull() & (x["times"] > 0))).alias("x")).select("id", "x.*")


def statuses(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(id, status): INVALID with an error, VALID without, UNVALIDATED where no plugin knows the type."""
    bad = issues(questions, options).where("severity = 'error'").select("id", F.lit(True).alias("bad")).distinct()
    return questions.join(bad, "id", "left").select("id", F.when(~F.coalesce(F.col("type").isin(*REGISTRY), F.lit(False)), "UNVALIDATED").when(F.col("bad"), "INVALID").otherwise("VALID").alias("status"))


def _bank(s, d):
    """Orders of three known types and an unknown one, some without text or with a loose brace; lines as options, some blank."""
    kind = F.element_at(F.array(*map(F.lit, ("MULTIPLE_CHOICE", "MULTIPLE_CORRECT", "DISCURSIVE", "ESSAY"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.expr("case when o_orderkey % 13 = 0 then ' ' when o_orderkey % 11 = 0 then concat('{', o_orderpriority) when o_orderkey % 7 = 0 then concat('$', o_orderpriority) else o_orderpriority end")
    q = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("type"), text.alias("text"), F.expr("case when o_orderkey % 3 > 0 then 'r' when o_orderkey % 2 = 0 then ' ' end").alias("solution"))
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.expr("case when l_quantity > 48 then ' ' else cast(cast(l_quantity as int) % 20 as string) end").alias("text"), (F.col("l_returnflag") == "R").alias("correct"))
    return q, o


QUERIES = {
    "plugin_issues": lambda s, d: issues(*_bank(s, d)),
    "plugin_status": lambda s, d: statuses(*_bank(s, d)),
}

_ISSUES = """q as (select o_orderkey as id, ['MULTIPLE_CHOICE', 'MULTIPLE_CORRECT', 'DISCURSIVE', 'ESSAY'][o_orderkey % 4 + 1] as type, case when o_orderkey % 13 = 0 then 1 when o_orderkey % 11 = 0 then 2 when o_orderkey % 7 = 0 then 3 else 0 end as flaw from orders),
o as (select l_orderkey as id, case when l_quantity > 48 then '' else cast(cast(l_quantity as int) % 20 as varchar) end as t, l_returnflag = 'R' as correct from lineitem),
a as (select id, count(*) as n, count(*) filter (correct) as c, count(*) filter (t = '') as blank, count(*) filter (t <> '') - count(distinct t) filter (t <> '') as repeated from o group by id),
j as (select q.*, coalesce(n, 0) as n, coalesce(c, 0) as c, coalesce(blank, 0) as blank, coalesce(repeated, 0) as repeated from q left join a using (id) where type <> 'ESSAY'),
i as (select id, 'statement_empty' as code, 'error' as severity, 1::bigint as times from j where flaw = 1 union all select id, 'unbalanced_braces', 'error', 1 from j where flaw = 2 union all select id, 'unbalanced_math', 'error', 1 from j where flaw = 3 union all select id, 'solution_empty', 'warning', 1 from j where id % 3 = 0
union all select id, 'too_few_options', 'error', 1 from j where n < 2 and type <> 'DISCURSIVE' union all select id, 'no_correct_option', 'error', 1 from j where c = 0 and type <> 'DISCURSIVE' union all select id, 'multiple_correct_options', 'error', 1 from j where c > 1 and type = 'MULTIPLE_CHOICE'
union all select id, 'empty_option', 'error', blank from j where blank > 0 and type <> 'DISCURSIVE' union all select id, 'duplicate_option', 'warning', repeated from j where repeated > 0 and type = 'MULTIPLE_CHOICE' union all select id, 'all_options_correct', 'warning', 1 from j where c = n and n > 0 and type = 'MULTIPLE_CORRECT'
union all select id, 'single_correct_option', 'warning', 1 from j where c = 1 and type = 'MULTIPLE_CORRECT' union all select id, 'discursive_has_options', 'warning', 1 from j where n > 0 and type = 'DISCURSIVE')"""
ORACLE_SQL = {
    "plugin_issues": f"with {_ISSUES} select id, code, severity, times from i",
    "plugin_status": f"with {_ISSUES} select id, case when type = 'ESSAY' then 'UNVALIDATED' when id in (select id from i where severity = 'error') then 'INVALID' else 'VALID' end as status from q",
}
