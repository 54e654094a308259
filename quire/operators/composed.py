"""Bodies of questions as blocks with an origin, and where in a question's fields a line of its body came from.

A block is some entries of lines, of which the first ``prefix`` are structure that nobody wrote. Blocks of a body are laid end to end, and the body is trimmed; blank lines that
go at its head move all spans up. A line that is structure points to the first line of its block's text, and a line in no block to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import option_label
from quire.operators.ranges import running, within
from quire.sources.tables import QUESTIONS_SQL, table

#: White space that trimming takes away.
BLANK = r"[\x{9}-\x{d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LIST_HEAD = r"\begin{enumerate}[label=\alph*), itemsep=2pt, topsep=4pt]"
SPAN = "struct<origin string, lines array<string>, prefix int>"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def block(origin: str, lines: Column, prefix: int | Column = 0) -> Column:
    return F.struct(F.lit(origin).alias("origin"), lines.alias("lines"), (F.lit(prefix) if isinstance(prefix, int) else prefix).cast("int").alias("prefix"))


def blocks(df: DataFrame, solutions: bool = True) -> DataFrame:
    """df with ``blocks``: the statement, the options, and with solutions the answer and the complement, as the kind of question asks for.

    df has kind (DISCURSIVE, MULTIPLE_CORRECT or any other, a choice), statement, solution, complement and options array<struct<text, correct>> in
    order; null texts are empty. Of a choice the first right option is the answer, of multiple right ones all are.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    filled = lambda c: trimmed(text(c)) != ""
    listed = F.coalesce("options", F.array().cast("array<struct<text string, correct boolean>>"))
    items = F.concat(F.array(F.lit(LIST_HEAD)), F.transform(listed, lambda o: F.concat(F.lit("  \\item "), F.coalesce(o["text"], F.lit("")))), F.array(F.lit("\\end{enumerate}")))
    right = F.filter(F.transform(listed, lambda o, i: F.when(o["correct"], option_label(i))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    gap = F.array(F.lit(""), F.lit("\\medskip"))
    answer = (
        F.when(F.size(right) == 0, none)
        .when(F.col("kind") == "MULTIPLE_CORRECT", F.concat(gap, F.array(F.concat(F.lit("\\textbf{Gabarito:} "), F.array_join(right, ", "), F.lit(".")))))
        .otherwise(F.concat(gap, F.array(F.concat(F.lit("\\textbf{Gabarito:} "), F.get(right, F.lit(0)), F.lit(".")))))
    )
    answer = F.concat(answer, F.when(filled("solution"), F.array(F.lit(""), F.concat(F.lit("\\textbf{Resolução.} "), text("solution")))).otherwise(none))
    open_ = F.col("kind") == "DISCURSIVE"
    reply = F.when(open_ & filled("solution"), F.concat(gap, F.array(F.concat(F.lit("\\textbf{Resposta.} "), text("solution"))))).when(open_, none).otherwise(answer)
    more = F.concat(gap, F.array(F.concat(F.lit("\\textbf{Complemento.} "), text("complement"))))
    parts = [block("statementLatex", F.split(text("statement"), "\n")), F.when(~open_ & (F.size(listed) > 0), block("options", items, 1))]
    if solutions:
        parts += [F.when(F.size(reply) > 0, block("solutionLatex", reply, F.size(reply) - 1)), F.when(filled("complement"), block("complementLatex", more, 2))]
    return df.withColumn("blocks", F.filter(F.array(*parts), lambda b: b.isNotNull()))


def composed(df: DataFrame) -> DataFrame:
    """df (with blocks) with latex, the trimmed body, and spans array<struct<origin, start, lines, text_start>> in its lines, from 1."""
    joined = F.array_join(F.flatten(F.transform("blocks", lambda b: b["lines"])), "\n")
    dropped = F.length(F.regexp_replace(F.regexp_extract("_joined", f"^({BLANK}*)", 1), "[^\n]", ""))
    sizes = F.transform("blocks", lambda b: F.size(b["lines"]))
    start = lambda i: 1 - F.col("_dropped") + F.aggregate(F.slice("_sizes", 1, i), F.lit(0), lambda a, x: a + x)
    span = lambda b, i: F.struct(b["origin"].alias("origin"), start(i).alias("start"), F.size(b["lines"]).alias("lines"), (start(i) + b["prefix"]).alias("text_start"))
    df = df.withColumn("_joined", joined).withColumns({"_dropped": dropped, "_sizes": sizes})
    return df.withColumns({"latex": trimmed(F.col("_joined")), "spans": F.transform("blocks", span)}).drop("_joined", "_dropped", "_sizes")


def origin_of(spans: Column, line: Column) -> Column:
    """struct<origin, line> of a line of the body, or null."""
    held = F.filter(spans, lambda s: (s["start"] <= line) & (line < s["start"] + s["lines"]))
    first = F.get(held, F.lit(0))
    return F.when(F.size(held) > 0, F.struct(first["origin"].alias("origin"), F.greatest(F.lit(1), line - first["text_start"] + 1).alias("line")))


def laid_out(df: DataFrame, body: str, order: list[Column]) -> DataFrame:
    """Spans of long bodies, made of many rows: (body, its own columns, first, last, text_first) of each block of df in its body's lines, from 1.

    df has blocks; rows of a body follow one another in order. Only rows are put in order, by range partitions, so a body of most rows is no task's alone.
    """
    rows = df.withColumn("_lines", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.size(b["lines"])))
    rows = running(rows, body, order, "_lines", "_before")
    sizes = F.transform("blocks", lambda b: F.size(b["lines"]))
    start = lambda i: F.col("_before") + 1 + F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.transform("blocks", lambda b, i: F.struct(b["origin"].alias("origin"), start(i).alias("first"), (start(i) + F.size(b["lines"]) - 1).alias("last"), (start(i) + b["prefix"]).alias("text_first")))
    return rows.withColumn("_span", F.explode(spans)).select(*[c for c in df.columns if c != "blocks"], "_span.*")


def located(lines: DataFrame, spans: DataFrame, body: str, line: str) -> DataFrame:
    """lines (body, line and others) with the columns of the span that holds them, and own_line, the line in the span's text; null where none does."""
    found = within(lines, spans, body, line, "first", "last", how="left")
    return found.withColumn("own_line", F.when(F.col("first").isNotNull(), F.greatest(F.lit(1).cast("long"), F.col(line) - F.col("text_first") + 1)))


def _bank(s, d) -> DataFrame:
    """Documents as questions of three kinds, some with blank lines at their head; the lines of the order of the same number are the options, and labels decide who has a complement."""
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.col("l_partkey").cast("string"), F.lit("x")).alias("text"), (F.col("l_returnflag") == "R").alias("correct")).alias("o"))
    o = o.groupBy("doc_id").agg(F.array_sort(F.collect_list("o")).alias("o")).select("doc_id", F.transform("o", lambda x: F.struct(x["text"], x["correct"])).alias("options"))
    df = table(s, d, "documents").join(o, "doc_id", "left")
    return df.select(
        "doc_id", "source", F.expr("case doc_id % 3 when 0 then 'DISCURSIVE' when 1 then 'MULTIPLE_CHOICE' else 'MULTIPLE_CORRECT' end").alias("kind"),
        F.concat(F.expr(r"case doc_id % 5 when 0 then '\n \n' when 1 then ' ' else '' end"), "text").alias("statement"), F.expr("case when doc_id % 4 > 0 then concat('por ', lang) when doc_id % 8 = 0 then ' \\n' end").alias("solution"),
        F.expr("case when doc_id % 7 < 3 then lang end").alias("complement"), "options",
    )


def _asked(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 23 - 2).cast("int").alias("line"))


def _origins(s, d):
    """The field and line that each event's line of its user's question came from."""
    spans = composed(blocks(_bank(s, d))).select("doc_id", "spans")
    at = origin_of(F.col("spans"), F.col("line"))
    return _asked(s, d).join(spans, "doc_id").select("event_id", "doc_id", "line", at.alias("o")).select("event_id", "doc_id", "line", "o.origin", F.col("o.line").cast("int").alias("own_line"))


def _books(s, d):
    """Each source as one long body; every event asks for one line of the source of its user's document."""
    df = blocks(_bank(s, d)).select("source", "doc_id", "blocks")
    spans = laid_out(df, "source", [F.col("doc_id")])
    asked = table(s, d, "events").select("event_id", F.col("user_id").alias("asker"), (F.col("event_id") * 37 % 9001).cast("long").alias("line"))
    asked = asked.join(table(s, d, "documents").select(F.col("doc_id").alias("asker"), "source"), "asker").drop("asker")
    return located(asked, spans, "source", "line").select("event_id", "source", "line", "doc_id", "origin", "own_line")


def _bodies(s, d):
    """Number of lines and hash of each question's body."""
    df = composed(blocks(_bank(s, d)))
    return df.select("doc_id", F.md5("latex").alias("md5"), F.size("spans").cast("long").alias("spans"))


_BANK = r"""o as (select l_orderkey as doc_id, list(l_partkey || 'x' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as t, list(l_returnflag = 'R' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as c from lineitem group by l_orderkey),
b as (select d.doc_id, source, doc_id % 3 as kind, case doc_id % 5 when 0 then chr(10) || ' ' || chr(10) when 1 then ' ' else '' end || text as statement, case when doc_id % 4 > 0 then 'por ' || lang end as solution, case when doc_id % 7 < 3 then lang end as complement, coalesce(t, []) as t, coalesce(c, []) as c
  from documents d left join o using (doc_id)),
letters as (select *, list_filter(list_transform(range(1, len(c) + 1), lambda i: case when c[i] then chr(96 + cast(i as int)) end), lambda x: x is not null) as r from b),
lines as (
  select doc_id, source, 1 as k, 'statementLatex' as origin, string_split(statement, chr(10)) as l, 0 as prefix from letters
  union all select doc_id, source, 2, 'options', list_concat(list_concat(['\begin{enumerate}[label=\alph*), itemsep=2pt, topsep=4pt]'], list_transform(t, lambda x: '  \item ' || x)), ['\end{enumerate}']), 1 from letters where kind <> 0 and len(t) > 0
  union all select doc_id, source, 3, 'solutionLatex', l, cast(len(l) as int) - 1 from (select doc_id, source, case when kind = 0 then case when solution is null then [] else ['', '\medskip', '\textbf{Resposta.} ' || solution] end else
    list_concat(case when len(r) = 0 then [] when kind = 2 then ['', '\medskip', '\textbf{Gabarito:} ' || array_to_string(r, ', ') || '.'] else ['', '\medskip', '\textbf{Gabarito:} ' || r[1] || '.'] end, case when solution is null then [] else ['', '\textbf{Resolução.} ' || solution] end) end as l from letters) where len(l) > 0
  union all select doc_id, source, 4, 'complementLatex', ['', '\medskip', '\textbf{Complemento.} ' || complement], 2 from letters where complement is not null),
bodies as (select doc_id, string_agg(array_to_string(l, chr(10)), chr(10) order by k) as joined, count(*) as spans from lines group by doc_id),
heads as (select *, length(regexp_replace(regexp_extract(joined, '^[\x{9}-\x{d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*'), '[^\n]', '', 'g')) as dropped from bodies)"""
_SPAN_SQL = "coalesce(sum(len(l)) over (partition by {by} rows between unbounded preceding and 1 preceding), 0) + 1"
QUERIES = {"line_origin": _origins, "book_line_origin": _books, "question_bodies": _bodies}
ORACLE_SQL = {
    "line_origin": f"""with {_BANK}, spans as (select x.doc_id, origin, {_SPAN_SQL.format(by='x.doc_id order by k')} - dropped as first, len(l) as n, prefix from lines x join heads using (doc_id))
select event_id, user_id as doc_id, cast(event_id % 23 - 2 as int) as line, origin, cast(case when origin is not null then greatest(1, event_id % 23 - 2 - first - prefix + 1) end as int) as own_line
from events e join documents d on d.doc_id = e.user_id left join spans s on s.doc_id = e.user_id and event_id % 23 - 2 >= first and event_id % 23 - 2 < first + n""",
    "book_line_origin": f"""with {_BANK}, spans as (select source, doc_id, origin, {_SPAN_SQL.format(by='source order by doc_id, k')} as first, len(l) as n, prefix from lines)
select event_id, d.source, cast(event_id * 37 % 9001 as bigint) as line, s.doc_id, origin, cast(case when origin is not null then greatest(1, event_id * 37 % 9001 - first - prefix + 1) end as bigint) as own_line
from events e join documents d on d.doc_id = e.user_id left join spans s on s.source = d.source and event_id * 37 % 9001 >= first and event_id * 37 % 9001 < first + n""",
    "question_bodies": f"with {_BANK} select doc_id, md5(regexp_replace(joined, '^[\\x{{9}}-\\x{{d}} \\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+|[\\x{{9}}-\\x{{d}} \\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+$', '', 'g')) as md5, spans from heads",
}
