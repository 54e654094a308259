"""TeX sources and logs: comments, escapes, previews, diagnostics, names and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_latex, collapse, completion_start, first_stop, header_text, label_text, slug, snippet, strip_comments, tex_escape, width_fraction
from quire.operators.ranges import beside, ranked, running, within
from quire.sources.tables import table, written

#: What a preview shows as one piece: display and inline maths, breaks, commands with an argument, text.
PIECES = r"(\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\$[^$]*\$|\\\\|\\[a-zA-Z]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?|\\[^a-zA-Z]|[^\\$]+|\$)"
LOG_LIMIT = 131_072


def preview(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pieces of a source in order: kind and content. Nested groups come as the text between their commands."""
    pieces = df.select(key, F.posexplode(F.regexp_extract_all(strip_comments(F.col(text)), F.lit(PIECES), F.lit(1))).alias("pos", "piece"))
    kind = (
        F.when(F.col("piece").rlike(r"^(\$\$|\\\[)"), "display").when(F.col("piece").rlike(r"^\$[^$]*\$$"), "math").when(F.col("piece") == "\\\\", "break")
        .when(F.col("piece").rlike(r"^\\includegraphics"), "image").when(F.col("piece").rlike(r"^\\[a-zA-Z]"), "command").when(F.col("piece").startswith("\\"), "escape").otherwise("text")
    )
    content = F.when(F.col("piece").rlike(r"^\\[a-zA-Z]"), F.regexp_extract("piece", r"\{([^{}]*)\}", 1)).otherwise(F.col("piece"))
    return pieces.select(key, "pos", kind.alias("kind"), content.alias("content"))


def diagnostics(df: DataFrame, key: str, log: str) -> DataFrame:
    """Errors, warnings and box messages of compiler logs: severity, message, line and file, in log order."""
    lines = df.select(key, F.posexplode(F.split(log, "\n")).alias("at", "line"))
    by = Window.partitionBy(key).orderBy("at")
    number = F.regexp_extract("line", r"^l\.(\d+)", 1)
    soon = F.coalesce(*[F.nullif(F.lead(number, k).over(by), F.lit("")) for k in range(1, 6)])
    located = F.col("line").rlike(r"^[^:\s]+\.\w+:\d+: ") & ~F.col("line").contains("Fatal error occurred")
    kind = F.when(located, "located").when(F.col("line").startswith("! "), "error").when(F.col("line").rlike(r"^(Over|Under)full \\[hv]box"), "info").when(F.col("line").rlike(r"^(LaTeX|Package \w+|Class \w+)( \w+)? Warning: "), "warning")
    # A warning goes on until a blank line or the next message.
    found = lines.withColumn("kind", kind).withColumn("soon", soon)
    ends = F.col("kind").isNotNull() | (F.trim("line") == "") | F.col("line").startswith("!")
    found = found.withColumn("block", F.sum(F.when(ends, 1).otherwise(0)).over(by))
    more = found.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim(F.regexp_replace("line", r"^\(\w+\)\s*", "")).alias("l")))), lambda x: x["l"]), " ").alias("joined"))
    df = found.where("kind is not null").join(more, [key, "block"])
    message = (
        F.when(F.col("kind") == "located", F.regexp_replace(F.regexp_replace("line", r"^[^:\s]+:\d+: ", ""), r"^LaTeX Error:\s*", ""))
        .when(F.col("kind") == "error", F.regexp_replace("line", r"^! (?:LaTeX Error:\s*)?", "")).when(F.col("kind") == "info", F.col("line"))
        .otherwise(F.regexp_replace("joined", r"^(LaTeX|Package \w+|Class \w+)( \w+)? Warning: ", ""))
    )
    line = F.when(F.col("kind") == "located", F.regexp_extract("line", r":(\d+):", 1)).when(F.col("kind") == "error", F.col("soon")).when(F.col("kind") == "info", F.regexp_extract("line", r"at lines? (\d+)", 1)).otherwise(F.regexp_extract("joined", r"on input line (\d+)", 1))
    file = F.when(F.col("kind") == "located", F.regexp_extract("line", r"([^/:\s]+):\d+:", 1))
    severity = F.when(F.col("kind").isin("located", "error"), "error").otherwise(F.col("kind"))
    return df.select(key, "at", severity.alias("severity"), F.trim(message).alias("message"), F.nullif(line, F.lit("")).try_cast("int").alias("line"), file.alias("file"))


def in_body(df: DataFrame, offset: int) -> DataFrame:
    """Lines of the document as lines of its body; null before it and in other files."""
    line = F.when((F.coalesce("file", F.lit("main.tex")) == "main.tex") & (F.col("line") > offset), F.col("line") - offset)
    return df.withColumn("line", line.cast("int"))


def truncated(log, limit: int):
    """Head and tail of a long log, with the number of characters left out."""
    half = limit // 2
    return F.when(F.length(log) > limit, F.concat(F.left(log, F.lit(half)), F.lit("\n[... "), (F.length(log) - 2 * half).cast("string"), F.lit(" ...]\n"), F.right(log, F.lit(half)))).otherwise(log)


def _logs(s, d):
    """A log made of each document: errors, warnings over two lines, boxes."""
    text = F.concat(
        F.lit("./main.tex:"), (F.col("doc_id") % 40 + 1).cast("string"), F.lit(": Undefined control sequence.\n! LaTeX Error: File missing.\nx\nl."), (F.col("doc_id") % 7).cast("string"),
        F.lit(" \\foo\n\nLaTeX Warning: Reference `a' on page 1 undefined on input line "), (F.col("n_chars") % 90).cast("string"), F.lit(".\n\nPackage hyperref Warning: Token not allowed\n(hyperref)   removing it on input line 5.\n\nOverfull \\hbox (1.0pt too wide) in paragraph at lines 3--4\n"),
    )
    return table(s, d, "documents").select("doc_id", text.alias("log"))


def _spans(s, d):
    """First and last line of each document in its source's documents laid end to end, by running sums."""
    df = table(s, d, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    df = running(df, "source", [F.col("doc_id")], "lines").withColumn("first", F.col("before") + 1).withColumn("last", F.col("before") + F.col("lines"))
    return df.select("source", "doc_id", "first", "last")


def _wrapped(text):
    """Answers in all the wrappings that models use, by document."""
    fence = F.concat(F.lit("```latex\n"), text, F.lit("\n```"))
    return F.element_at(F.array(F.concat(F.lit(" $"), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("$")), fence, F.concat(F.lit("\\[ "), text, F.lit(" \\]")), F.concat(F.lit("$$"), text, F.lit("$$\n")), F.concat(F.lit("\\("), text, F.lit("\\)")), F.lit("$a$ e $b$")), (F.col("doc_id") % 6 + 1).cast("int"))


def _labels():
    """Labels as books print them."""
    return F.element_at(F.array(F.concat(F.lit("("), "p_brand", F.lit(")")), F.lit(" [ ] "), F.concat("p_name", "p_name", "p_name", F.lit(".")), F.concat(F.lit("[ "), "p_brand", F.lit(").. ")), F.concat("p_brand", F.lit("  ."))), (F.col("p_partkey") % 5 + 1).cast("int"))


def _graphics():
    size = F.col("p_size").cast("string")
    return F.element_at(F.array(F.concat(F.lit("\\includegraphics[width=0."), size, F.lit("\\textwidth]{x}")), F.concat(F.lit("[height=2cm, width = ."), size, F.lit(" \\columnwidth]")), F.concat(F.lit("width="), size, F.lit("cm")), F.concat(F.lit("width=1.2."), size, F.lit("\\linewidth"))), (F.col("p_partkey") % 4 + 1).cast("int"))


def _templates():
    return F.element_at(F.array(F.concat(F.lit("§"), "p_name", F.lit("§\r\n")), F.concat(F.lit("\\frac{§"), "p_name", F.lit("§}{§n§}")), F.concat(F.lit("\\frac{§"), "p_name", F.lit("}")), F.concat("p_name", F.lit("$"))), (F.col("p_partkey") % 4 + 1).cast("int"))


def _typed():
    return F.element_at(F.array(F.concat("p_name", F.lit(" \\al")), F.concat("p_name", F.lit(" \\al ")), F.concat("p_name", F.lit("\\")), F.concat("p_name", F.lit("\\x2\\@m"))), (F.col("p_partkey") % 4 + 1).cast("int"))


def unique_slugs(df: DataFrame, key: str, name: str, taken: DataFrame, most: int = 60) -> DataFrame:
    """key and slug of each row, all different, and different from the slugs of taken (slug).

    A name's slug is cut at 60 characters. The first row of each, by key, keeps it where it isn't taken; the others get -2, -3 and so on, in order, but for numbers that
    a name or a taken slug already ends in: so "a", "a" and "a 2" become a, a-3 and a-2. The k-th free number follows from the gaps between those used, which rows meet by interval, so
    a name that most rows share is numbered by all tasks.
    """
    base = F.regexp_replace(F.left(slug(F.col(name)), F.lit(most)), "-+$", "")
    rows = ranked(df.select(F.col(key).alias("_key"), base.alias("base")), "base", [F.col("_key")])
    held = taken.select(F.col("slug").alias("base")).distinct()
    rows = rows.join(held.withColumn("_held", F.lit(1)), "base", "left")
    # k: from 1, which of the free numbers a row gets; 0 keeps the base.
    rows = written(rows.select("_key", "base", (F.col("place") + F.coalesce("_held", F.lit(0))).cast("long").alias("k")), "slugs")
    ends = rows.select("base").union(held).distinct().select(F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,17})$", 1).alias("b"), F.regexp_extract("base", r"^(.+)-([1-9][0-9]{0,17})$", 2).try_cast("long").alias("n")).where("b <> '' and n >= 2")
    ends = ranked(ends, "b", [F.col("n")], "j")
    # Before the used number n there are n - 2 - j free ones; from the next on, one more number is skipped.
    ends = ends.select("b", (F.col("n") - F.col("j") - 1).alias("first"), (F.col("j") + 1).alias("skip")).groupBy("b", "first").agg(F.max("skip").alias("skip"))
    ends = beside(ends, "b", [F.col("first")], "first", None, "next")
    most_ = rows.groupBy(F.col("base").alias("b")).agg(F.max("k").alias("most"))
    spans = ends.join(most_, "b").select(F.col("b").alias("base"), "first", F.least(F.coalesce(F.col("next") - 1, F.col("most")), F.col("most")).alias("last"), "skip")
    found = within(rows.where("k > 0"), spans, "base", "k", "first", "last", how="left")
    numbered = found.select(F.col("_key"), F.concat("base", F.lit("-"), (F.col("k") + 1 + F.coalesce("skip", F.lit(0))).cast("string")).alias("slug"))
    return rows.where("k = 0").select("_key", F.col("base").alias("slug")).union(numbered).withColumnRenamed("_key", key)


def _slugs(s, d):
    """Parts named so that most names repeat and some end in the numbers that others would get; nations took some slugs before."""
    names = table(s, d, "part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then concat('Ítem  ', p_partkey % 5) when 1 then concat('item ', p_partkey % 5, ' ', p_partkey % 11) else concat(repeat('longo ', 10), p_name) end as name")
    taken = table(s, d, "nation").selectExpr("case when n_nationkey < 3 then concat('item-', n_nationkey) else concat('item-', n_nationkey % 5, '-', n_nationkey) end as slug")
    return unique_slugs(names, "p_partkey", "name", taken)


QUERIES = {
    "latex_preview": lambda s, d: preview(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    "tex_log": lambda s, d: in_body(diagnostics(_logs(s, d), "doc_id", "log"), 10).select("doc_id", "severity", "message", "line", "file"),
    "tex_escape": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(tex_escape(F.col("text"))).alias("md5")),
    "comments_stripped": lambda s, d: table(s, d, "documents").select("doc_id", F.length(strip_comments(F.col("text"))).cast("long").alias("n")),
    "clean_output": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(clean_latex(_wrapped(F.col("text")))).alias("md5")),
    "label_normalise": lambda s, d: table(s, d, "part").select("p_partkey", label_text(_labels()).alias("label")),
    "width_fraction": lambda s, d: table(s, d, "part").select("p_partkey", width_fraction(_graphics()).alias("width")),
    "snippet_convert": lambda s, d: table(s, d, "part").select("p_partkey", snippet(_templates()).alias("snippet")),
    "snippet_selection": lambda s, d: table(s, d, "part").select("p_partkey", first_stop(snippet(_templates()), F.col("p_brand")).alias("snippet")),
    "header_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(header_text(F.concat(F.col("text"), F.lit(" 5% ~x^2 a_b"), "lang"))).alias("md5")),
    "completion_column": lambda s, d: table(s, d, "part").select("p_partkey", completion_start(_typed(), F.lit(7)).cast("long").alias("col")),
    "asset_name": lambda s, d: table(s, d, "pages").select("page_id", F.concat(slug(F.regexp_extract("url", "://([^/]*)", 1)), F.lit("-"), F.left(F.sha2("html", 256), F.lit(8)), F.lit(".html")).alias("name")),
    "figure_text": lambda s, d: table(s, d, "pages").select("page_id", F.concat_ws("\n", F.lit("\\begin{figure}"), F.concat(F.lit("\\includegraphics{"), F.col("page_id").cast("string"), F.lit("}")), F.lit("\\end{figure}")).alias("figure")),
    "log_truncate": lambda s, d: table(s, d, "documents").select("doc_id", truncated(F.col("text"), 500).alias("log")),
    "line_spans": _spans,
    "canonical_hash": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.concat_ws("\n", "source", "lang", collapse(F.col("text"))), 256).alias("sha256")),
    "slug_unique": _slugs,
}

_FLAT = "trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'))"
_LOGX = r"""select doc_id, 'error' as severity, 'Undefined control sequence.' as message, case when doc_id % 40 + 1 > 10 then cast(doc_id % 40 + 1 - 10 as int) end as line, 'main.tex' as file from documents
union all select doc_id, 'error', 'File missing.', case when doc_id % 7 > 10 then cast(doc_id % 7 - 10 as int) end, null from documents
union all select doc_id, 'warning', 'Reference `a'' on page 1 undefined on input line ' || (n_chars % 90) || '.', case when n_chars % 90 > 10 then cast(n_chars % 90 - 10 as int) end, null from documents
union all select doc_id, 'warning', 'Token not allowed removing it on input line 5.', null, null from documents
union all select doc_id, 'info', 'Overfull \hbox (1.0pt too wide) in paragraph at lines 3--4', null, null from documents"""
ORACLE_SQL = {
    "tex_log": _LOGX,
    "tex_escape": r"select doc_id, md5(replace(replace(replace(regexp_replace(replace(replace(text, '\', chr(1)), '^', chr(2)), '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), chr(1), '\textbackslash{}'), chr(2), '\textasciicircum{}')) as md5 from documents",
    "comments_stripped": r"select doc_id, length(regexp_replace(text, '(\\[\s\S])|%[^\n]*', '\1', 'g')) as n from documents",
    "clean_output": r"with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents), w as (select doc_id, t, case doc_id % 6 when 0 then '$' || t || '$' when 5 then '$a$ e $b$' else t end as x from t) select doc_id, md5(case when starts_with(x, '$') and ends_with(x, '$') and length(x) >= 2 and not contains(substr(x, 2, length(x) - 2), '$') then regexp_replace(substr(x, 2, length(x) - 2), '^\s+|\s+$', '', 'g') else x end) as md5 from w",
    "label_normalise": "select p_partkey, case p_partkey % 5 when 1 then null when 2 then left(p_name || p_name || p_name, 40) when 3 then p_brand || ').' else p_brand end as label from part",
    "width_fraction": "select p_partkey, case p_partkey % 4 when 0 then cast('0.' || p_size as double) when 1 then cast('.' || p_size as double) end as width from part",
    "snippet_convert": r"select p_partkey, case p_partkey % 4 when 1 then '\\frac{${1:' || p_name || '}\}{${2:n}\}$0' when 2 then '\\frac{§' || p_name || '\}' when 3 then p_name || '\$' else '${1:' || p_name || '}' || chr(10) || '$0' end as snippet from part",
    "snippet_selection": r"select p_partkey, case p_partkey % 4 when 1 then '\\frac{${1:' || p_brand || '}\}{${2:n}\}$0' when 2 then '\\frac{§' || p_name || '\}' when 3 then p_name || '\$' else '${1:' || p_brand || '}' || chr(10) || '$0' end as snippet from part",
    "header_text": r"select doc_id, md5(regexp_replace(regexp_replace(text || ' 5% ~x^2 a_b' || lang, '([&%$#_{}])', '\\\1', 'g'), '([~^])', '\\\1{}', 'g')) as md5 from documents",
    "completion_column": "select p_partkey, case p_partkey % 4 when 0 then length(p_name) + 2 when 1 then 7 when 2 then length(p_name) + 1 else length(p_name) + 4 end as col from part",
    "asset_name": "select page_id, trim(regexp_replace(strip_accents(lower(regexp_extract(url, '://([^/]*)', 1))), '[^a-z0-9]+', '-', 'g'), '-') || '-' || left(sha256(html), 8) || '.html' as name from pages",
    "figure_text": r"select page_id, '\begin{figure}' || chr(10) || '\includegraphics{' || page_id || '}' || chr(10) || '\end{figure}' as figure from pages",
    "log_truncate": "select doc_id, case when length(text) > 500 then left(text, 250) || chr(10) || '[... ' || (length(text) - 500) || ' ...]' || chr(10) || right(text, 250) else text end as log from documents",
    "line_spans": "with l as (select source, doc_id, len(string_split(text, chr(10))) as lines from documents), r as (select *, cast(sum(lines) over (partition by source order by doc_id) as bigint) as last from l) select source, doc_id, last - lines + 1 as first, last from r",
    "canonical_hash": f"select doc_id, sha256(source || chr(10) || lang || chr(10) || {_FLAT}) as sha256 from documents",
    "slug_unique": r"""with n as (select p_partkey, case p_partkey % 3 when 0 then 'item-' || p_partkey % 5 when 1 then 'item-' || p_partkey % 5 || '-' || p_partkey % 11 else rtrim(left(repeat('longo-', 10) || replace(p_name, ' ', '-'), 60), '-') end as base from part),
held as (select distinct case when n_nationkey < 3 then 'item-' || n_nationkey else 'item-' || n_nationkey % 5 || '-' || n_nationkey end as base from nation),
r as (select *, row_number() over (partition by base order by p_partkey) - 1 + (base in (select base from held))::int as k from n),
used as (select regexp_extract(base, '^(.+)-([1-9][0-9]*)$', 1) as b, try_cast(regexp_extract(base, '^(.+)-([1-9][0-9]*)$', 2) as bigint) as n from (select base from n union select base from held)),
free as (select base, i, row_number() over (partition by base order by i) as k from (select base, max(k) as most from r group by base), range(2, 100000) x(i) where i <= most + 200 and not exists (select 1 from used where b = base and n = i))
select p_partkey, case when r.k = 0 then r.base else r.base || '-' || i end as slug from r left join free f on f.base = r.base and f.k = r.k""",
}
