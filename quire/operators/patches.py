"""Proposed changes to questions: a strict check of their JSON, what they really change, and the state after what was approved.

A patch is bounded by its format (4 fields, 64 options and so on), so a question and its patch meet in one row, and all is done by expressions over its arrays.
A refused patch changes nothing and names the places it was refused for; it never stops the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import option_label
from quire.operators.composed import BLANK, trimmed
from quire.sources.tables import table, written

#: Version of the format, fields with their labels, labels of metadata, the difficulty scale.
VERSION = 1
FIELDS = {"statementLatex": "Enunciado", "solutionLatex": "Resolução", "complementLatex": "Complemento", "nickname": "Apelido"}
METADATA = {"difficulty": "Dificuldade", "year": "Ano", "board": "Banca", "institution": "Instituição", "role": "Cargo", "roleLevel": "Nível do cargo", "publisher": "Origem", "videoUrl": "Vídeo"}
DIFFICULTIES = (0, 2, 5, 7, 10)
NOTHING, EXCERPT = "(vazio)", 40

Check = Callable[[Column], Column]


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def a_text(most: int, least: int = 0) -> Check:
    return lambda v: (kind(v) == "STRING") & F.length(F.try_variant_get(v, "$", "string")).between(least, most)


def a_whole(fits: Callable[[Column], Column]) -> Check:
    def check(v: Column) -> Column:
        n = F.try_variant_get(v, "$", "double")
        return kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (n == F.floor(n)) & fits(n)

    return check


def or_null(check: Check) -> Check:
    return lambda v: (kind(v) == "VOID") | check(v)


def a_list(most: int, each: Check, least: int = 0) -> Check:
    return lambda v: kind(v).startswith("ARRAY<") & F.size(items(v)).between(least, most) & F.forall(items(v), each)


FIELD = {"field": (True, lambda v: (kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*FIELDS)), "value": (True, a_text(200_000))}
OPTION = {"optionId": (True, a_text(200, 1)), "statementLatex": (False, a_text(50_000)), "isCorrect": (False, lambda v: kind(v) == "BOOLEAN")}
REORDER = {"optionIds": (True, a_list(64, a_text(200, 1), 2))}
ABOUT = {
    "difficulty": (False, a_whole(lambda n: n.isin(*map(float, DIFFICULTIES)))), "year": (False, or_null(a_whole(lambda n: n.between(1900, 2100)))),
    **{k: (False, or_null(a_text(200))) for k in ("board", "institution", "role", "roleLevel", "publisher")},
    "videoUrl": (False, or_null(lambda v: a_text(500)(v) & F.try_variant_get(v, "$", "string").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"))),
}
TAGS = {"names": (True, a_list(32, a_text(80, 1)))}
TOP = {"schemaVersion": (True, a_whole(lambda n: n == VERSION)), "summary": (True, a_text(500, 1)), "warnings": (False, a_list(20, a_text(300)))}
NESTED = {"reorder": REORDER, "metadata": ABOUT, "tags": TAGS}
LISTS = {"fields": (FIELD, 4), "options": (OPTION, 64)}
NONE = "cast(array() as array<string>)"


def strict(v: Column, at: Column, rules: dict[str, tuple[bool, Check]], known: tuple[str, ...] = ()) -> Column:
    """Places in an object that break its rules, as text after ``at``: missing, wrong and unknown keys."""
    m = members(v)
    wrong = []
    for name, (needed, check) in rules.items():
        value = F.try_element_at(m, F.lit(name))
        wrong.append(F.when(value.isNull() if needed else F.lit(False), F.concat(at, F.lit(name))).when(value.isNotNull() & ~F.coalesce(check(value), F.lit(False)), F.concat(at, F.lit(name))))
    unknown = F.transform(F.filter(F.map_keys(m), lambda k: ~k.isin(*rules, *known)), lambda k: F.concat(at, k))
    found = F.concat(F.filter(F.array(*wrong), lambda x: x.isNotNull()), unknown)
    return F.when(m.isNull(), F.array(F.regexp_replace(at, r"\.$", ""))).otherwise(found)


def _placed(name: str, rules: dict[str, tuple[bool, Check]]) -> Callable[[Column, Column], Column]:
    return lambda x, i: strict(x, F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(".")), rules)


def checked(df: DataFrame, json: str) -> DataFrame:
    """df with ``issues``, the sorted places for which the patch in column json is refused, and the parsed patch (null where it is refused):
    fields, entries, reorder, metadata and tags."""
    df = df.withColumn("_v", F.try_parse_json(json))
    v = F.col("_v")
    m = members(v)
    of = lambda name: F.try_element_at(m, F.lit(name))
    parts = [strict(v, F.lit(""), TOP, (*LISTS, *NESTED))]
    for name, rules in NESTED.items():
        parts.append(F.when(of(name).isNull(), F.expr(NONE)).otherwise(strict(of(name), F.lit(f"{name}."), rules)))
    for name, (rules, most) in LISTS.items():
        each = F.flatten(F.transform(items(of(name)), _placed(name, rules)))
        parts.append(F.when(of(name).isNull(), F.expr(NONE)).when(items(of(name)).isNull() | (F.size(items(of(name))) > most), F.array(F.lit(name))).otherwise(each))
    df = df.withColumn("_bad", F.when(m.isNull(), F.array(F.lit("$"))).otherwise(F.concat(*parts)))
    get = lambda path, t: F.try_variant_get(v, path, t)
    df = df.withColumn("_p", F.struct(
        F.coalesce(get("$.fields", "array<struct<field:string,value:string>>"), F.array().cast("array<struct<field:string,value:string>>")).alias("fields"),
        F.coalesce(get("$.options", "array<struct<optionId:string,statementLatex:string,isCorrect:boolean>>"), F.array().cast("array<struct<optionId:string,statementLatex:string,isCorrect:boolean>>")).alias("entries"),
        get("$.reorder.optionIds", "array<string>").alias("reorder"), get("$.metadata", "map<string,string>").alias("metadata"), get("$.tags.names", "array<string>").alias("tags"),
    ))
    p = F.col("_p")
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    # Rules over the whole are judged only where every part is as it should be.
    rules = [
        F.when((F.size(p["fields"]) == 0) & (F.size(p["entries"]) == 0) & of("reorder").isNull() & of("metadata").isNull() & of("tags").isNull(), "no change"),
        F.when(twice(F.transform(p["fields"], lambda x: x["field"])), "a field twice"), F.when(twice(F.transform(p["entries"], lambda x: x["optionId"])), "an option twice"),
        F.when(p["reorder"].isNotNull() & twice(p["reorder"]), "the order repeats an option"), F.when(F.size(F.filter(p["entries"], lambda x: x["isCorrect"])) > 1, "more than one right option"),
        F.when(F.exists(p["entries"], lambda x: x["statementLatex"].isNull() & x["isCorrect"].isNull()), "an option unchanged"),
    ]
    whole = F.filter(F.array(*rules), lambda x: x.isNotNull())
    df = df.withColumn("issues", F.array_sort(F.when(F.size("_bad") > 0, F.col("_bad")).otherwise(whole)))
    return df.withColumn("patch", F.when(F.size("issues") == 0, p)).drop("_v", "_bad", "_p")


def shown(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(NOTHING)).otherwise(c)


def brief(c: Column) -> Column:
    """An option's text in one line of 40 characters."""
    flat = trimmed(F.regexp_replace(c, f"{BLANK}+", " "))
    return F.when(F.length(flat) > EXCERPT, F.concat(F.left(flat, F.lit(EXCERPT)), F.lit("…"))).when(flat == "", "(vazia)").otherwise(flat)


def change(id_: Column, kind_: str, label: Column, before: Column, after: Column, latex: Column | bool) -> Column:
    return F.struct(id_.alias("id"), F.lit(kind_).alias("kind"), label.alias("label"), before.alias("before"), after.alias("after"), (F.lit(latex) if isinstance(latex, bool) else latex).alias("latex"))


def with_changes(df: DataFrame) -> DataFrame:
    """df with ``changes`` array<struct<id, kind, label, before, after, latex>>: what patch changes in the state beside it, in the patch's order.

    The state is statementLatex, solutionLatex, complementLatex, nickname, options array<struct<id, text, correct>> in order, metadata map and tags. What is
    rewritten alike is no change, and entries of options that are gone are dropped. Rows are written first, so that a patch is parsed once.
    """
    own = df.columns
    df = written(df.withColumns({
        "_places": F.transform("options", lambda o, i: F.struct(o.alias("o"), i.alias("i"))), "_ids": F.transform("options", lambda o: o["id"]),
        "_briefs": F.map_from_entries(F.transform("options", lambda o: F.struct(o["id"], brief(o["text"])))),
    }), "patches")
    p = F.col("patch")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    now = lambda name: F.coalesce(*[F.when(name == f, text(f)) for f in FIELDS])
    name_of = lambda name, names: F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in names.items()], name)
    fields = F.transform(p["fields"], lambda x: F.when(now(x["field"]) != x["value"], change(F.concat(F.lit("field:"), x["field"]), "field", name_of(x["field"], FIELDS), shown(now(x["field"])), shown(x["value"]), x["field"] != "nickname")))

    def of_option(x: Column) -> Column:
        found = F.get(F.filter("_places", lambda y: y["o"]["id"] == x["optionId"]), F.lit(0))
        o, label = found["o"], F.concat(F.lit("Alternativa "), option_label(found["i"]), F.lit(")"))
        say = lambda c: F.when(c, "correta").otherwise("incorreta")
        return F.array(
            F.when(x["statementLatex"] != o["text"], change(F.concat(F.lit("option:"), o["id"], F.lit(":text")), "option", label, shown(o["text"]), shown(x["statementLatex"]), True)),
            F.when(x["isCorrect"] != o["correct"], change(F.concat(F.lit("option:"), o["id"], F.lit(":correct")), "option", F.concat(label, F.lit(" — gabarito")), say(o["correct"]), say(x["isCorrect"]), False)),
        )

    entries = F.flatten(F.transform(p["entries"], of_option))
    listed = lambda a: F.array_join(F.transform(a, lambda i: F.coalesce(F.try_element_at("_briefs", i), F.lit("(alternativa removida)"))), " · ")
    order = F.array(F.when(p["reorder"].isNotNull() & (p["reorder"] != F.col("_ids")), change(F.lit("reorder"), "reorder", F.lit("Ordem das alternativas"), listed("_ids"), listed(p["reorder"]), False)))
    had = lambda k: F.try_element_at("metadata", k)
    blank = lambda c: F.coalesce(c, F.lit(""))
    about = F.transform(F.map_entries(p["metadata"]), lambda e: F.when(blank(had(e["key"])) != blank(e["value"]), change(F.concat(F.lit("metadata:"), e["key"]), "metadata", name_of(e["key"], METADATA), shown(had(e["key"])), shown(e["value"]), False)))
    a, b = F.array_sort("tags"), F.array_sort(p["tags"])
    tags = F.array(F.when(p["tags"].isNotNull() & (a != b), change(F.lit("tags"), "tags", F.lit("Tags"), shown(F.array_join(a, ", ")), shown(F.array_join(b, ", ")), False)))
    none = F.array().cast("array<struct<id:string,kind:string,label:string,before:string,after:string,latex:boolean>>")
    every = F.concat(*[F.coalesce(x, none) for x in (fields, entries, order, about, tags)])
    return df.withColumn("changes", F.coalesce(F.filter(every, lambda c: c.isNotNull()), none)).select(*own, "changes")


def described(changes: Column) -> Column:
    """One sentence: the labels, three at most."""
    labels = F.array_distinct(F.transform(changes, lambda c: c["label"]))
    more = F.concat(F.array_join(F.slice(labels, 1, 3), ", "), F.lit(" e mais "), (F.size(labels) - 3).cast("string"))
    return F.when(F.size(labels) == 0, "nada").when(F.size(labels) > 3, more).otherwise(F.array_join(labels, ", "))


def applied(df: DataFrame, approved: str, must: bool = False) -> DataFrame:
    """The state after the approved changes of with_changes(): state columns replaced, with applied, stale, refused and summary.

    approved is an array of ids. Of it, ids that no longer are changes are stale. Where nothing approved is left the state stays as it is and refused is
    true; with ``must`` that is an error. An order that is applied puts the options it names first; others follow as they were. A nickname of blanks becomes null.
    """
    p, ok, live = F.col("patch"), F.col("_ok"), F.transform("changes", lambda c: c["id"])
    df = written(df, "changes").withColumn("_ok", F.filter(live, lambda i: F.array_contains(F.coalesce(F.col(approved), F.expr(NONE)), i)))
    refused = F.size("_ok") == 0
    if must:
        df = df.withColumn("_ok", F.when(refused, F.raise_error(F.lit("Nenhuma mudança foi aprovada — não há o que aplicar."))).otherwise(ok))
    yes = lambda i: F.array_contains(ok, i)

    def field(name: str) -> Column:
        value = F.get(F.filter(p["fields"], lambda x: x["field"] == name), F.lit(0))["value"]
        value = F.when(trimmed(value) != "", value) if name == "nickname" else value
        return F.when(yes(F.lit(f"field:{name}")), value).otherwise(F.col(name))

    def option(o: Column) -> Column:
        e = F.get(F.filter(p["entries"], lambda x: x["optionId"] == o["id"]), F.lit(0))
        of = lambda what: yes(F.concat(F.lit("option:"), o["id"], F.lit(f":{what}")))
        return F.struct(o["id"].alias("id"), F.when(of("text"), e["statementLatex"]).otherwise(o["text"]).alias("text"), F.when(of("correct"), e["isCorrect"]).otherwise(o["correct"]).alias("correct"))

    options = F.transform("options", option)
    named = lambda o: F.array_position(F.coalesce(p["reorder"], F.expr(NONE)), o["id"])
    at = lambda o, i: F.when(yes(F.lit("reorder")) & (named(o) > 0), named(o)).when(yes(F.lit("reorder")), i + 1000).otherwise(i)
    options = F.transform(F.array_sort(F.transform(options, lambda o, i: F.struct(at(o, i).cast("long").alias("at"), o.alias("o")))), lambda x: x["o"])
    news = F.map_filter(p["metadata"], lambda k, v: yes(F.concat(F.lit("metadata:"), k)))
    kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(news), k))
    about = F.when(F.size(F.coalesce(news, F.create_map().cast("map<string,string>"))) > 0, F.map_concat(kept, F.map_filter(news, lambda k, v: v.isNotNull()))).otherwise(F.col("metadata"))
    return df.withColumns({
        **{f: field(f) for f in FIELDS}, "options": options, "metadata": about, "tags": F.when(yes(F.lit("tags")), p["tags"]).otherwise(F.col("tags")),
        "applied": ok, "stale": F.array_except(F.col(approved), live), "refused": F.size("_ok") == 0, "summary": described(F.filter("changes", lambda c: F.array_contains(ok, c["id"]))),
    }).drop("_ok")


def snapshot(df: DataFrame) -> Column:
    """The whole state as the JSON that a revision keeps."""
    options = F.transform("options", lambda o: F.struct(o["id"].alias("id"), o["text"].alias("statementLatex"), o["correct"].alias("isCorrect")))
    return F.to_json(F.struct("statementLatex", "solutionLatex", "complementLatex", "nickname", options.alias("options"), "metadata", "tags"), {"ignoreNullFields": "false"})


def _states(s, d) -> DataFrame:
    """Parts as questions; the suppliers of their lines are the options, in order."""
    line = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_quantity", "l_returnflag")).alias("m"))
    o = line.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", F.col("m.l_quantity").cast("int").cast("string").alias("text"), (F.col("m.l_returnflag") == "R").alias("correct")))).alias("o"))
    df = table(s, d, "part").join(o, F.col("p_partkey") == F.col("l_partkey"), "left")
    none = F.array().cast("array<struct<id:string,text:string,correct:boolean>>")
    options = F.coalesce(F.transform("o", lambda x: F.struct(x["l_suppkey"].cast("string").alias("id"), x["text"].alias("text"), x["correct"].alias("correct"))), none)
    about = F.map_filter(F.create_map(F.lit("board"), F.col("p_brand"), F.lit("year"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1950).cast("string"))), lambda k, v: v.isNotNull())
    return df.select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("statementLatex"), F.lit("").alias("solutionLatex"), F.lit(None).cast("string").alias("complementLatex"), F.col("p_name").alias("nickname"), options.alias("options"), about.alias("metadata"), F.split("p_name", " ").alias("tags"), "p_size", "p_brand")


def _proposals(s, d) -> DataFrame:
    """States with a patch each, as JSON: rewritten and equal fields, options by turns, orders with a stranger, metadata set and cleared, tags; some are faulty."""
    df = _states(s, d)
    k = F.col("entity")
    fields = F.expr("array(struct('statementLatex' as field, case when entity % 2 = 0 then concat(statementLatex, ' ', p_size % 3) else statementLatex end as value), struct('nickname' as field, case entity % 5 when 0 then '  ' when 1 then nickname else concat('x', entity) end as value))")
    entries = F.transform("options", lambda o, i: F.struct(o["id"].alias("optionId"), F.when(o["id"].cast("int") % 2 == 1, F.lit("7")).otherwise(o["text"]).alias("statementLatex"), F.when(i == 0, F.lit(True)).alias("isCorrect")))
    stray = F.array(F.struct(F.lit("none").alias("optionId"), F.lit("7").alias("statementLatex"), F.lit(None).cast("boolean").alias("isCorrect")))
    entries = F.concat(entries, stray, F.when(k % 10 == 7, stray).otherwise(F.slice(stray, 1, 0)))
    reorder = F.when(k % 3 == 0, F.struct(F.concat(F.reverse(F.transform("options", lambda o: o["id"])), F.when(k % 6 == 0, F.array(F.lit("gone"))).otherwise(F.expr(NONE))).alias("optionIds")))
    tags = F.when(k % 3 == 1, F.struct(F.reverse("tags").alias("names"))).when(k % 3 == 2, F.struct(F.array("p_brand").alias("names")))
    about = F.expr("concat('{\"board\":\"X', entity % 7, '\"', case entity % 4 when 0 then ',\"year\":null' when 1 then ',\"year\":2001' when 3 then concat(',\"year\":', 1950 + p_size) else '' end, case when entity % 10 = 5 then ',\"difficulty\":3' else '' end, '}')")
    full = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.when(k % 10 == 9, "").otherwise("muda").alias("summary"), F.when(k % 10 == 3, "READY").alias("status"), fields.alias("fields"), entries.alias("options"), reorder.alias("reorder"), tags.alias("tags")))
    json = F.when(k % 11 == 0, F.lit('{"schemaVersion":1,"summary":"nada"}')).when(k % 13 == 0, F.lit("{oops")).otherwise(F.concat(F.regexp_replace("_full", r"\}$", ',"metadata":'), about, F.lit("}")))
    return df.withColumn("_full", full).withColumn("json", json).drop("_full")


def _approved() -> Column:
    odd = F.transform(F.filter("options", lambda o: o["id"].cast("int") % 3 == 1), lambda o: F.concat(F.lit("option:"), o["id"], F.lit(":text")))
    first = F.transform(F.slice("options", 1, 1), lambda o: F.concat(F.lit("option:"), o["id"], F.lit(":correct")))
    some = F.expr("filter(array('field:statementLatex', 'field:nickname', 'reorder', 'metadata:year', 'tags', 'field:gone'), (x, i) -> entity % 6 <> i)")
    return F.when(F.col("entity") % 17 == 0, F.array(F.lit("field:gone"))).otherwise(F.concat(some, odd, first))


def _diff(s, d):
    df = with_changes(checked(_proposals(s, d), "json"))
    return df.select("entity", F.posexplode_outer("changes").alias("place", "c")).where("place is not null").select("entity", "place", "c.*")


def _after(s, d):
    df = applied(with_changes(checked(_proposals(s, d), "json")).withColumn("approved", _approved()), "approved")
    options = F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"], F.when(o["correct"], "*").otherwise(""))), ";")
    about = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return df.select("entity", "statementLatex", "nickname", options.alias("options"), about.alias("metadata"), F.array_join("tags", ",").alias("tags"), F.array_join("stale", ",").alias("stale"), "refused", "summary")


QUERIES = {
    "patch_check": lambda s, d: checked(_proposals(s, d), "json").select("entity", F.array_join("issues", "; ").alias("issues")),
    "patch_rows": _diff,
    "patch_apply": _after,
}
_BASE = """lines as (select l_partkey as entity, l_suppkey as id, arg_max({'q': l_quantity, 'f': l_returnflag}, {'q': l_quantity, 'f': l_returnflag}) as m from lineitem group by l_partkey, l_suppkey),
opts as (select entity, id, cast(cast(m.q as int) as varchar) as text, m.f = 'R' as correct, row_number() over (partition by entity order by id) - 1 as i, count(*) over (partition by entity) as n from lines),
parts as (select p_partkey as k, *, coalesce((select max(n) from opts where entity = p_partkey), 0) as n, case when p_size % 2 = 0 then cast(p_size + 1950 as varchar) end as year from part),
faults as (select k, case when k % 11 = 0 then 'no change' when k % 13 = 0 then '$' else array_to_string(list_sort(list_filter([case when k % 10 = 9 then 'summary' end, case when k % 10 = 3 then 'status' end, case when k % 10 = 5 then 'metadata.difficulty' end,
  case when k % 3 = 0 and n + (k % 6 = 0)::int < 2 then 'reorder.optionIds' end, case when n + 1 + (k % 10 = 7)::int > 64 then 'options' end], lambda x: x is not null)), '; ') end as own, k % 10 = 7 as twice from parts),
issues as (select k, case when own = '' and twice then 'an option twice' else own end as issues from faults),
good as (select parts.* from parts join issues using (k) where issues = ''),
label as (select entity, id, text, correct, i, 'Alternativa ' || case when i < 26 then chr(97 + cast(i as int)) else chr(96 + cast(i // 26 as int)) || chr(97 + cast(i % 26 as int)) end || ')' as label from opts),
changes as (
  select k, 0 as a, 0 as b, 'field:statementLatex' as id, 'field' as kind, 'Enunciado' as label, p_type as before, p_type || ' ' || p_size % 3 as after, true as latex from good where k % 2 = 0
  union all select k, 0, 1, 'field:nickname', 'field', 'Apelido', p_name, case when k % 5 = 0 then '  ' else 'x' || k end, false from good where k % 5 <> 1
  union all select k, 1, 2 * i, 'option:' || id || ':text', 'option', label, text, '7', true from good join label on entity = k where id % 2 = 1 and text <> '7'
  union all select k, 1, 2 * i + 1, 'option:' || id || ':correct', 'option', label || ' — gabarito', 'incorreta', 'correta', false from good join label on entity = k where i = 0 and not correct
  union all select k, 2, 0, 'reorder', 'reorder', 'Ordem das alternativas', (select string_agg(text, ' · ' order by i) from label where entity = k), (select string_agg(text, ' · ' order by i desc) from label where entity = k) || case when k % 6 = 0 then ' · (alternativa removida)' else '' end, false from good where k % 3 = 0 and (n > 1 or k % 6 = 0)
  union all select k, 3, 0, 'metadata:board', 'metadata', 'Banca', p_brand, 'X' || k % 7, false from good
  union all select k, 3, 1, 'metadata:year', 'metadata', 'Ano', coalesce(year, '(vazio)'), case k % 4 when 0 then '(vazio)' when 1 then '2001' else cast(1950 + p_size as varchar) end, false from good where k % 4 <> 2 and coalesce(year, '') <> case k % 4 when 0 then '' when 1 then '2001' else cast(1950 + p_size as varchar) end
  union all select k, 4, 0, 'tags', 'tags', 'Tags', array_to_string(list_sort(string_split(p_name, ' ')), ', '), p_brand, false from good where k % 3 = 2 and [p_brand] <> string_split(p_name, ' '))"""
ORACLE_SQL = {
    "patch_check": f"with {_BASE} select k as entity, issues from issues",
    "patch_rows": f"with {_BASE} select k as entity, cast(row_number() over (partition by k order by a, b) - 1 as int) as place, id, kind, label, before, after, latex from changes",
    "patch_apply": f"""with {_BASE},
wanted as (select k, case when k % 17 = 0 then ['field:gone'] else list_concat(list_concat(list_filter(['field:statementLatex', 'field:nickname', 'reorder', 'metadata:year', 'tags', 'field:gone'], lambda x, i: k % 6 <> i - 1),
  coalesce((select list('option:' || id || ':text' order by i) from opts where entity = k and id % 3 = 1), [])), coalesce((select list('option:' || id || ':correct') from opts where entity = k and i = 0), [])) end as w from parts),
done as (select c.* from changes c join wanted using (k) where list_contains(w, c.id)),
labels as (select k, list(label order by a, b) as l from (select k, label, min(a) as a, min(a * 1000 + b) as b from done group by k, label) group by k),
has as (select k, coalesce((select list(id) from done where done.k = parts.k), []) as h from parts),
after as (select p.*, h, o.id, case when list_contains(h, 'option:' || o.id || ':text') then '7' else text end as t, correct or list_contains(h, 'option:' || o.id || ':correct') as c, case when list_contains(h, 'reorder') then -i else i end as spot from parts p join has using (k) left join opts o on entity = k)
select k as entity, any_value(case when list_contains(h, 'field:statementLatex') then p_type || ' ' || p_size % 3 else p_type end) as "statementLatex",
  any_value(case when list_contains(h, 'field:nickname') then case when k % 5 = 0 then null else 'x' || k end else p_name end) as nickname, coalesce(string_agg(id || '=' || t || case when c then '*' else '' end, ';' order by spot), '') as options,
  any_value('board=' || p_brand || coalesce(case when list_contains(h, 'metadata:year') then case k % 4 when 0 then null when 1 then ';year=2001' else ';year=' || (1950 + p_size) end else ';year=' || year end, '')) as metadata,
  any_value(case when list_contains(h, 'tags') then p_brand else replace(p_name, ' ', ',') end) as tags,
  any_value((select coalesce(string_agg(x, ',' order by j), '') from (select unnest(w) as x, generate_subscripts(w, 1) as j from wanted where wanted.k = after.k) where not exists (select 1 from changes where changes.k = after.k and changes.id = x))) as stale,
  any_value(len(h) = 0) as refused, any_value(coalesce((select case when len(l) > 3 then array_to_string(l[1:3], ', ') || ' e mais ' || (len(l) - 3) else array_to_string(l, ', ') end from labels where labels.k = after.k), 'nada')) as summary
from after group by k""",
}
