"""Taking publications in from a catalog in one batch, as if one after the other.

An entry is blocked by a row that was there before, or by an entry of a smaller id that itself was taken in, with its external id or its ISBN, unless it is
forced; a like title and author alone warns. An ISBN that is not valid is dropped and the entry taken in without it, so it blocks no later one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fold, isbn_valid
from quire.sources.tables import table, written

#: Signals, the surest first; the first two block.
SIGNALS = ("external-id", "isbn", "title-and-author")
BEFORE = -1


def keys(dropped: Column) -> dict[str, Column]:
    """What rows are compared by, null where a row has none, as one without a title has none of the third kind; the ISBN counts where ``dropped`` is false."""
    isbn = F.nullif(F.upper(F.regexp_replace("isbn", r"[\s-]", "")), F.lit(""))
    both = F.concat_ws("|", "title", F.coalesce("author", F.lit("")))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.trim(F.regexp_replace(fold(both), "[^a-z0-9|]+", " ")))
    return dict(zip(SIGNALS, (F.nullif("external", F.lit("")), F.when(~dropped, isbn), title)))


def keyed(df: DataFrame, dropped: Column, *kept: str) -> DataFrame:
    """(kind, key, kept) rows of the keys that df has."""
    parts = [df.select(F.lit(i).alias("kind"), k.alias("key"), *kept) for i, k in enumerate(keys(dropped).values())]
    return reduce(DataFrame.union, parts).where("key is not null")


def taken(new: DataFrame, known: DataFrame) -> DataFrame:
    """(id, created, signal, found, isbn_dropped) of each row of new (id, external, isbn, title, author, force): whether it is taken in, and the least row
    that it is like by the first signal; found is null and the signal tells of a known row.

    Rows are decided in rounds. Per key, the least row taken in and the least row that is open are minima, formed before the shuffle: a row above one taken in is blocked, and
    a row that no open one precedes in any of its keys is taken in. Copies take two rounds, however many they are; a chain through different keys one for each link.
    """
    rows = new.select("id", "external", "isbn", "title", "author", F.coalesce("force", F.lit(False)).alias("force"))
    rows = written(rows.withColumn("dropped", ~F.coalesce(isbn_valid(F.col("isbn")), F.lit(True)) & (F.trim(F.coalesce("isbn", F.lit(""))) != "")), "entries")
    no = F.lit(False)
    asked = written(keyed(rows, no, "id").where("kind < 2"), "asked")
    offers = written(keyed(rows, F.col("dropped"), "id"), "offers")
    there = written(keyed(known, no).distinct(), "there")
    state = written(rows.select("id", F.when(F.col("force"), True).alias("created")), "state")
    while not state.where("created is null").isEmpty():
        least = offers.join(state, "id").groupBy("kind", "key").agg(F.min(F.expr("if(created, id, null)")).alias("taken"), F.min(F.expr("if(created is null, id, null)")).alias("open"))
        least = least.unionByName(there.select("kind", "key", F.lit(BEFORE).cast("long").alias("taken"), F.lit(None).cast("long").alias("open")))
        open_ = asked.join(state.where("created is null").select("id"), "id").join(least, ["kind", "key"])
        by = open_.groupBy("id").agg(F.max(F.expr("coalesce(taken < id, false)")).alias("held"), F.max(F.expr("coalesce(open < id, false)")).alias("waits"))
        told = F.when(F.col("created").isNotNull(), F.col("created")).when(F.col("held"), False).when(~F.coalesce("waits", no), True)
        state = written(state.join(by, "id", "left").select("id", told.alias("created")), "state")
    least = offers.join(state.where("created"), "id").groupBy("kind", "key").agg(F.min("id").alias("taken"))
    least = least.union(there.select("kind", "key", F.lit(BEFORE).cast("long"))).groupBy("kind", "key").agg(F.min("taken").alias("taken"))
    like = keyed(rows, no, "id").join(least, ["kind", "key"]).where("taken < id").groupBy("id").agg(F.min(F.struct("kind", "taken")).alias("b"))
    out = rows.select("id", "dropped").join(state, "id").join(like, "id", "left")
    signal = F.element_at(F.array(*map(F.lit, SIGNALS)), F.col("b.kind") + 1)
    return out.select("id", "created", F.when(F.col("b").isNotNull(), signal).alias("signal"), F.when(F.col("b.taken") != BEFORE, F.col("b.taken")).alias("found"), (F.col("created") & F.col("dropped")).alias("isbn_dropped"))


def _catalog(s, d):
    """Parts as entries: those of numbers divisible by 4 are known. External ids, ISBNs, titles and authors repeat; some ISBNs have a wrong digit, some entries are forced."""
    df = table(s, d, "part").withColumn("nine", F.lpad((F.col("p_size") * 7919 + F.col("p_partkey") % 6).cast("string"), 9, "0"))
    df = df.withColumn("sum", F.expr("aggregate(sequence(1, 9), 0, (a, j) -> a + (11 - j) * cast(substring(nine, j, 1) as int))"))
    df = df.withColumn("check", F.expr("(11 - sum % 11 + if(p_partkey % 7 = 0, 1, 0)) % 11"))
    df = df.selectExpr("p_partkey as id", "case when p_partkey % 5 < 2 then concat('x', p_partkey div 9) end as external", "case when p_partkey % 3 > 0 then concat(nine, '-', if(check = 10, 'X', cast(check as string))) when p_partkey % 2 = 0 then ' ' end as isbn", "p_name as title", "p_brand as author", "p_partkey % 13 = 1 as force")
    return df.where("id % 4 > 0"), df.where("id % 4 = 0").drop("force")


QUERIES = {"import_batch": lambda s, d: taken(*_catalog(s, d))}
ORACLE_SQL = {
    "import_batch": """with recursive n as (select *, lpad(cast(p_size * 7919 + p_partkey % 6 as varchar), 9, '0') as nine from part),
c as (select *, (11 - list_sum(list_transform(range(1, 10), lambda j: (11 - j) * cast(substr(nine, j, 1) as int))) % 11 + (p_partkey % 7 = 0)::int) % 11 as digit from n),
e as (select p_partkey as id, case when p_partkey % 5 < 2 then 'x' || p_partkey // 9 end as ext, case when p_partkey % 3 > 0 then nine || case when digit = 10 then 'X' else cast(cast(digit as int) as varchar) end end as isbn, p_partkey % 3 > 0 and p_partkey % 7 = 0 as wrong,
  p_name || '|' || p_brand as title, p_partkey % 13 = 1 as force from c),
o as (select *, row_number() over (order by id) as i from e where id % 4 > 0),
s as (select 0::bigint as i, null::bigint as id, false as created, (select list(ext) from e where id % 4 = 0 and ext is not null) as exts, (select list(isbn) from e where id % 4 = 0 and isbn is not null) as isbns
  union all select i, id, created, case when created and ext is not null then list_append(exts, ext) else exts end, case when created and isbn is not null and not wrong then list_append(isbns, isbn) else isbns end
  from (select o.*, s.exts, s.isbns, force or not (coalesce(list_contains(s.exts, ext), false) or coalesce(list_contains(s.isbns, isbn), false)) as created from s join o on o.i = s.i + 1)),
there as (select e.id, e.ext, case when e.wrong and e.id % 4 > 0 then null else e.isbn end as isbn, e.title, case when e.id % 4 = 0 then -1 else e.id end as spot from e left join s on s.id = e.id where e.id % 4 = 0 or s.created),
like_ as (select o.id, 0 as kind, min(spot) as spot from o join there t on t.ext = o.ext and spot < o.id group by o.id union all select o.id, 1, min(spot) from o join there t on t.isbn = o.isbn and spot < o.id group by o.id union all select o.id, 2, min(spot) from o join there t on t.title = o.title and spot < o.id group by o.id),
best as (select id, arg_min(kind, kind) as kind, arg_min(spot, kind) as spot from like_ group by id)
select o.id, s.created, case kind when 0 then 'external-id' when 1 then 'isbn' when 2 then 'title-and-author' end as signal, case when spot <> -1 then spot end as found, s.created and wrong as isbn_dropped from o join s using (id) left join best using (id)""",
}
