"""Scans, lookups, filtered search, pagination and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower, excerpt, fold, tag_key
from quire.sources.tables import QUESTIONS_SQL, questions, table

TEXT, LIMIT, MOST_OFFSET = 200, 200, 100_000


TYPES, DIFFICULTIES = ("MULTIPLE_CHOICE", "MULTIPLE_CORRECT", "DISCURSIVE", "ECONOMY", "STANDARD", "PROMO"), range(11)
LISTS = ("tags", "boards", "institutions", "years", "types", "difficulties")


def normalised(params: dict) -> dict:
    """Search parameters made valid: text cut, values that make no sense dropped, limit and offset in range."""

    def whole(x):
        try:
            n = float(x) if isinstance(x, (str, int, float)) and not isinstance(x, bool) else None
        except ValueError:
            return None
        return int(n) if n is not None and n.is_integer() else None

    def within(x, low, high, default):
        n = whole(x)
        return default if n is None else min(high, max(low, n))

    listed = lambda name: params.get(name) if isinstance(params.get(name), (list, tuple)) else ()
    strings = lambda name: [x.strip() for x in listed(name) if isinstance(x, str) and x.strip()]
    numbers = lambda name: [n for n in map(whole, listed(name)) if n is not None]
    text = params.get("text")
    return {
        "text": text.strip()[:TEXT] if isinstance(text, str) else "", "tags": strings("tags"), "boards": strings("boards"), "institutions": strings("institutions"),
        "years": [y for y in numbers("years") if 1900 <= y <= 2100], "types": [t for t in strings("types") if t in TYPES], "difficulties": [x for x in numbers("difficulties") if x in DIFFICULTIES],
        "limit": within(params.get("limit"), 1, LIMIT, 50), "offset": within(params.get("offset"), 0, MOST_OFFSET, 0),
    }


def active_filters(query: dict) -> int:
    """How many values a normalised query filters by; the text doesn't count."""
    return sum(len(query[x]) for x in LISTS)


def is_empty(query: dict) -> bool:
    """Whether a normalised query filters nothing."""
    return not query["text"] and not active_filters(query)


def matches(text: str, *columns: Column) -> Column:
    """Any column contains text; case of ASCII letters doesn't count, accents do."""
    found = F.lit(False)
    for c in columns:
        found = found | ascii_lower(c).contains(ascii_lower(F.lit(text)))
    return found if text else F.lit(True)


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One row more than the page, so that a further page shows without a count."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def search(df: DataFrame, text: str, boards: list[str], order: list[Column], limit: int, offset: int) -> DataFrame:
    df = df.where(~F.col("deleted")).where(matches(text, "text", "source"))
    if boards:
        df = df.where(F.col("lang").isin(boards))
    return page(df, order, limit, offset)


def all_tags(df: DataFrame, key: str, name: Column, tags: list[str]) -> DataFrame:
    """Keys of which every tag is a word of the name, by folded key."""
    wanted = F.array(*[tag_key(F.lit(t)) for t in tags])
    have = F.transform(F.split(name, " "), tag_key)
    return df.where(F.size(F.array_except(wanted, have)) == 0)


def latest_with(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def _search_page(s, d):
    df = search(questions(s, d), "the", [], [F.desc("n_chars"), F.asc("doc_id")], 50, 50)
    return df.select("doc_id", "n_chars", excerpt(F.col("text"), 180).alias("excerpt"))


def _tag_rank(s, d):
    tags = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("usage"))
    rank = F.when(F.col("tag").startswith("r"), 0).when(F.col("tag").contains("r"), 1)
    return tags.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("usage"), "tag").limit(10)


def _composite_sort(s, d):
    text = F.concat(F.lpad(F.greatest(F.lit(0), 1000 - F.col("p_size")).cast("string"), 5, "0"), "p_name")
    return table(s, d, "part").select("p_partkey", text.alias("sort_text")).orderBy("sort_text", "p_partkey")


def _scan(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_name", "c_custkey")


def _group_scope(s, d):
    """A query ignores the chosen group."""
    query, group = "ring", "ECONOMY"
    df = table(s, d, "part").where(fold(F.col("p_name")).contains(query) if query else F.col("p_type") == group)
    matched = F.broadcast(df.agg(F.count("*").alias("matched")))
    return df.select("p_partkey", "p_name").crossJoin(matched).orderBy("p_partkey").limit(400)


QUERIES = {
    "search_page": _search_page,
    "search_in_lists": lambda s, d: table(s, d, "part").where(F.col("p_brand").isin("Brand#2", "Brand#17") & F.col("p_type").isin("ECONOMY", "STANDARD") & F.col("p_size").isin(*range(5, 30))).select("p_partkey", "p_brand", "p_type", "p_size"),
    "search_all_tags": lambda s, d: all_tags(table(s, d, "part"), "p_partkey", F.col("p_name"), ["Réd", " ring "]).select("p_partkey", "p_name"),
    "search_all_rows": lambda s, d: questions(s, d).where(F.col("text").contains("tion")).select("doc_id", "deleted"),
    "fold_search": lambda s, d: table(s, d, "documents").where(fold(F.col("text")).contains("etre") & fold(F.col("text")).contains("ecole") | fold(F.col("text")).contains("eaux")).select("doc_id", "source").orderBy("doc_id").limit(200),
    "list_filter": lambda s, d: table(s, d, "documents").where(F.lower("text").contains("élé") | F.lower("source").contains("src1")).select("doc_id"),
    "tag_rank": _tag_rank,
    "composite_sort": _composite_sort,
    "group_scope_override": _group_scope,
    "scan_project": _scan,
    "point_lookup": lambda s, d: table(s, d, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_size"),
    "composite_lookup": lambda s, d: table(s, d, "lineitem").where("l_orderkey = 77 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
    "cast_or_lookup": lambda s, d: table(s, d, "part").where((F.col("p_name") == "17") | (F.col("p_partkey").cast("string") == "17")).select("p_partkey", "p_name"),
    "trash_vs_live": lambda s, d: questions(s, d).groupBy("deleted").agg(F.count("*").alias("n")),
    "top_recent": lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_name").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(6),
    "capped_then_filtered": lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).where("event_type <> 'error'").select("event_id", "event_type"),
    "candidate_topk": lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate", F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("sem título")).alias("title")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200),
    "keep_newest_n": lambda s, d: latest_with(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id"),
}

_FLAT = "trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'))"
ORACLE_SQL = {
    "search_page": f"with {QUESTIONS_SQL} select doc_id, n_chars, case when length({_FLAT}) > 180 then left({_FLAT}, 180) || '…' else {_FLAT} end as excerpt from questions where not deleted and (translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the%' or translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the%') order by n_chars desc, doc_id limit 51 offset 50",
    "search_in_lists": "select p_partkey, p_brand, p_type, p_size from part where p_brand in ('Brand#2', 'Brand#17') and p_type in ('ECONOMY', 'STANDARD') and p_size between 5 and 29",
    "search_all_tags": "select p_partkey, p_name from part where list_contains(string_split(p_name, ' '), 'red') and list_contains(string_split(p_name, ' '), 'ring')",
    "search_all_rows": f"with {QUESTIONS_SQL} select doc_id, deleted from questions where contains(text, 'tion')",
    "fold_search": "select doc_id, source from documents where (contains(strip_accents(lower(text)), 'etre') and contains(strip_accents(lower(text)), 'ecole')) or contains(strip_accents(lower(text)), 'eaux') order by doc_id limit 200",
    "list_filter": "select doc_id from documents where contains(lower(text), 'élé') or contains(lower(source), 'src1')",
    "tag_rank": "with t as (select unnest(string_split(p_name, ' ')) as tag from part), u as (select tag, count(*) as usage, case when tag like 'r%' then 0 when contains(tag, 'r') then 1 end as rank from t group by tag) select tag, usage, rank from u where rank is not null order by rank, usage desc, tag limit 10",
    "composite_sort": "select p_partkey, lpad(cast(greatest(0, 1000 - p_size) as varchar), 5, '0') || p_name as sort_text from part order by sort_text, p_partkey",
    "group_scope_override": "select p_partkey, p_name, count(*) over () as matched from part where contains(p_name, 'ring') order by p_partkey limit 400",
    "scan_project": "select c_custkey, c_name, c_mktsegment from customer order by c_name, c_custkey",
    "point_lookup": "select p_partkey, p_name, p_size from part where p_partkey = 42",
    "composite_lookup": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_orderkey = 77 and l_linenumber = 1",
    "cast_or_lookup": "select p_partkey, p_name from part where p_name = '17' or cast(p_partkey as varchar) = '17'",
    "trash_vs_live": f"with {QUESTIONS_SQL} select deleted, count(*) as n from questions group by deleted",
    "top_recent": "select o_orderkey, o_orderdate, c_name from orders join customer on o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 6",
    "capped_then_filtered": "select event_id, event_type from (select * from events order by ts desc, event_id desc limit 200) where event_type <> 'error'",
    "candidate_topk": "select o_orderkey, o_orderdate, coalesce(nullif(o_orderpriority, ''), 'sem título') as title from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') order by o_orderdate desc, o_orderkey limit 200",
    "keep_newest_n": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3",
}
