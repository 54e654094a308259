"""Fractional sort keys in base 62.

A key is an integer part, whose head letter gives its length (a to z for two and more digits upward, Z
to A downward), and a fraction without trailing zero. Keys sort bytewise. A key of many siblings follows from
its place among them, and places come from range partitions, so no list of siblings has to be in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.operators.ranges import beside, ranked
from quire.sources.tables import table

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
VALUE = {c: i for i, c in enumerate(DIGITS)}
FIRST, LEAST = "a0", "A" + "0" * 26
LONGEST = 32


def head_length(head: str) -> int:
    if "a" <= head <= "z":
        return ord(head) - ord("a") + 2
    if "A" <= head <= "Z":
        return ord("Z") - ord(head) + 2
    raise ValueError(f"no head of a key: {head!r}")


def parts(key: str) -> tuple[str, str]:
    """Integer part and fraction of a valid key."""
    n = head_length(key[:1] or " ")
    if len(key) < n or key == LEAST or key.endswith("0") and len(key) > n or any(c not in VALUE for c in key[1:]):
        raise ValueError(f"not a key: {key!r}")
    return key[:n], key[n:]


def is_valid(key: str) -> bool:
    try:
        return bool(parts(key))
    except ValueError:
        return False


def _ordinal(integer: str) -> int:
    """Place of an integer part on the line of all of them; a0 is 0."""
    digits = 0
    for c in integer[1:]:
        digits = digits * 62 + VALUE[c]
    n = len(integer) - 1
    if integer[0] >= "a":
        return sum(62**k for k in range(1, n)) + digits
    return digits - sum(62**k for k in range(1, n + 1))


def _integer(at: int) -> str | None:
    """The integer part at a place; None beyond either end."""
    n, low = 1, at
    if at >= 0:
        while low >= 62**n:
            low -= 62**n
            n += 1
        head = chr(ord("a") + n - 1)
    else:
        low = -at
        while low > 62**n:
            low -= 62**n
            n += 1
        low = 62**n - low
        head = chr(ord("Z") - n + 1)
    if n > 26:
        return None
    digits = ""
    for _ in range(n):
        low, d = divmod(low, 62)
        digits = DIGITS[d] + digits
    return head + digits


def between_fractions(a: str, b: str | None) -> str:
    """A short fraction above a and below b (None: no bound)."""
    out = ""
    while True:
        low = VALUE[a[0]] if a else 0
        high = 62 if b is None else VALUE[b[0]] if b else 0
        if b and low == high:
            out, a, b = out + b[0], a[1:], b[1:]
        elif high - low > 1:
            return out + DIGITS[(low + high + 1) // 2]
        elif b is not None and len(b) > 1:
            return out + b[0]
        else:
            out, a, b = out + DIGITS[low], a[1:], None


def key_between(a: str | None, b: str | None) -> str:
    """A key above a and below b; None is an end of the list."""
    if a is not None and b is not None and a >= b:
        raise ValueError("bounds out of order")
    ia, fa = parts(a) if a is not None else (None, "")
    ib, fb = parts(b) if b is not None else (None, "")
    if a is None and b is None:
        return FIRST
    if a is None:
        if ib == LEAST:
            return ib + between_fractions("", fb)
        lower = ib if fb else _integer(_ordinal(ib) - 1)
        if lower is None:
            raise ValueError("no key is left at the start")
        return lower
    if b is not None and ia == ib:
        return ia + between_fractions(fa, fb)
    upper = _integer(_ordinal(ia) + 1)
    if b is None:
        return upper if upper is not None else ia + between_fractions(fa, None)
    if upper is None:
        raise ValueError("no key is left at the end")
    return upper if upper < b else ia + between_fractions(fa, None)


def keys_between(a: str | None, b: str | None, n: int) -> list[str]:
    """n ascending keys between two bounds; between two given ones the range is halved, so keys stay short."""
    if n == 0:
        return []
    if a is None or b is None:
        keys: list[str] = []
        for _ in range(n):
            if b is None:
                a = key_between(a, None)
            else:
                b = key_between(None, b)
            keys.append(a if b is None else b)
        return keys if b is None else keys[::-1]
    middle = key_between(a, b)
    return [*keys_between(a, middle, n // 2), middle, *keys_between(middle, b, n - n // 2 - 1)]


#: The first place with so many digits, for places as far as a long reaches.
_STARTS = [sum(62**k for k in range(1, n)) for n in range(1, 12)]


def integer_at(at: Column) -> Column:
    """The integer part at a place on the line of all of them, by digits; a0 is at 0."""
    up = at >= 0
    low = F.when(up, at).otherwise(-at - 1)  # the part -1 is the last of its length, as 0 is the first
    n = F.lit(1)
    for k in range(2, 11):
        n = F.when(low >= _STARTS[k - 1], k).otherwise(n)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in _STARTS[:10]]), n)
    span = F.element_at(F.array(*[F.lit(62**k).cast("long") for k in range(1, 11)]), n)
    rest = F.when(up, low - start).otherwise(span - 1 - (low - start))
    power = F.array(*[F.lit(62**k).cast("long") for k in range(10)])
    digits = F.transform(F.sequence(n - 1, F.lit(0)), lambda k: F.substr(F.lit(DIGITS), (_div(rest, F.element_at(power, k + 1)) % 62 + 1).cast("int"), F.lit(1)))
    head = F.when(up, F.char(n + 96)).otherwise(F.char(F.lit(91) - n))
    return F.concat(head, F.array_join(digits, ""))


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def ordinal(key: Column) -> Column:
    """Place of a key's integer part; keys whose integer part is beyond a long's reach give null."""
    head = F.ascii(key)
    up = head >= 97
    n = F.when(up, head - 96).otherwise(91 - head)
    digits = F.transform(F.sequence(F.lit(2), n + 1), lambda i: F.instr(F.lit(DIGITS), F.substr(key, i, F.lit(1))) - 1)
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 62 + d)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in _STARTS[:10]]), n)
    span = F.element_at(F.array(*[F.lit(62**k).cast("long") for k in range(1, 11)]), n)
    return F.when(n <= 10, F.when(up, start + value).otherwise(value - span - start))


def key_at(a: str | None, b: str | None, i: int, n: int) -> str:
    """The i-th of keys_between(a, b, n), by as many steps as the logarithm of n, or one at an end of the list."""
    if not 0 <= i < n:
        raise ValueError("no such place")
    if a is None or b is None:
        first = key_between(a, b)
        step = i if b is None else i + 1 - n
        whole, rest = parts(first)
        at = _integer(_ordinal(whole) + step)
        if not rest and at is not None and at != LEAST:
            return at
        return keys_between(a, b, n)[i]  # at the very ends of the line of integers keys grow fractions
    while True:
        middle, half = key_between(a, b), n // 2
        if i == half:
            return middle
        if i < half:
            b, n = middle, half
        else:
            a, i, n = middle, i - half - 1, n - half - 1


def with_keys(df: DataFrame, place: str, name: str = "sort_key") -> DataFrame:
    """df with the key of each row's place, counted from 0, in a list of keys that starts empty: its integer parts in order."""
    return df.withColumn(name, integer_at(F.col(place).cast("long")))


def neighbours(df: DataFrame, parent: str, key: str, after: str) -> DataFrame:
    """Each row's key and the next key of its parent, with the one before as ``before``."""
    return beside(df, parent, [F.col(key)], key, "before", after)


def due(df: DataFrame, parent: str, key: str = "sort_key", longest: int = LONGEST) -> DataFrame:
    """Parents of which some key is so long that all of the parent's rows should get new ones."""
    return df.groupBy(parent).agg(F.max(F.length(key)).alias("_n")).where(F.col("_n") >= longest).select(parent)


def rebalanced(df: DataFrame, parent: str, order: list[Column], key: str = "sort_key", longest: int = LONGEST) -> DataFrame:
    """df with evenly spaced new keys, in the same order, for the rows of parents that are due; others keep theirs.

    Places come from range partitions, so a parent with most of the rows is renumbered by all tasks.
    """
    some = due(df, parent, key, longest).withColumnRenamed(parent, "_due")
    old = df.join(some, df[parent].eqNullSafe(some["_due"]), "left_anti")
    new = ranked(df.join(some, df[parent].eqNullSafe(some["_due"]), "left_semi"), parent, [F.col(key), *order], "_place")
    return old.unionByName(new.withColumn(key, integer_at(F.col("_place"))).drop("_place"))


def appended(df: DataFrame, new: DataFrame, parent: str, order: list[Column], key: str = "sort_key") -> DataFrame:
    """new with keys after the last one of their parent in df, in order; of a parent without rows from the start."""
    last = df.groupBy(F.col(parent).alias("_parent")).agg(F.max(key).alias("_last"))
    rows = ranked(new, parent, order, "_place")
    rows = rows.join(last, rows[parent].eqNullSafe(last["_parent"]), "left")
    return rows.withColumn(key, integer_at(F.coalesce(ordinal(F.col("_last")) + 1, F.lit(0)) + F.col("_place"))).drop("_parent", "_last", "_place")


@F.pandas_udf(StringType())
def keys_at(a: pd.Series, b: pd.Series, i: pd.Series, n: pd.Series) -> pd.Series:
    """key_at() of bounds (null: an end), place and number."""
    return pd.Series([key_at(w if w is not None and w == w else None, x if x is not None and x == x else None, int(y), int(z)) for w, x, y, z in zip(a, b, i, n)], dtype=object)


def spread(new: DataFrame, gap: list[str], low: str, high: str, order: list[Column], key: str = "sort_key") -> DataFrame:
    """new with keys between low and high, as many as rows share the columns of gap, in order; each key comes from its place alone."""
    rows = ranked(new, gap, order, "_place")
    many = new.groupBy(*gap).agg(F.count("*").alias("_n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(gap)], "_n")
    same = [rows[g].eqNullSafe(many[f"_g{i}"]) for i, g in enumerate(gap)]
    return rows.join(many, same).withColumn(key, keys_at(F.col(low), F.col(high), "_place", "_n")).select(*[c for c in new.columns if c != key], key)


def moved(items: DataFrame, parent: str, item: str, moves: DataFrame, key: str = "sort_key") -> DataFrame:
    """moves (parent, item, target: a place in the list of the others) with the bounds of the item's new key, low and high, and the key.

    An item is counted out of its own list before its target is looked up: places after its own shift by one. Targets beyond the ends are the ends.
    Each move meets two rows of its parent, those at the two places around its target.
    """
    rows = ranked(items.select(parent, item, key), parent, [F.col(key), F.col(item)], "_place")
    size = rows.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_size"))
    own = rows.select(F.col(parent).alias("_p"), F.col(item).alias("_i"), F.col("_place").alias("_own"))
    m = moves.join(own, (moves[parent] == own["_p"]) & (moves[item] == own["_i"])).drop("_p", "_i").join(size.withColumnRenamed("_p", "_q"), moves[parent] == F.col("_q")).drop("_q")
    m = m.withColumn("_to", F.greatest(F.lit(0), F.least(F.col("target"), F.col("_size") - 1)))
    # The others are the list without the item: the k-th of them is at k, or at k + 1 from the item's own place on.
    at = lambda k: F.when(k < F.col("_own"), k).otherwise(k + 1)
    m = m.withColumns({"_low": at(F.col("_to") - 1), "_high": at(F.col("_to"))})
    for name in ("low", "high"):
        side = rows.select(F.col(parent).alias("_p"), F.col("_place").alias("_at"), F.col(key).alias(name))
        m = m.join(side, (m[parent] == side["_p"]) & (m[f"_{name}"] == side["_at"]), "left").drop("_p", "_at")
    return m.withColumn("new_key", keys_at("low", "high", F.lit(0), F.lit(1))).select(*moves.columns, "low", "high", "new_key")


def _sort_keys(s, d):
    df = ranked(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [F.col("o_orderkey")])
    return with_keys(df, "place").select("o_orderkey", "o_custkey", F.col("place").cast("int").alias("place"), "sort_key")


def _inserted(s, d):
    """A key between every order and the next of its customer."""
    df = neighbours(_sort_keys(s, d), "o_custkey", "sort_key", "after")
    return df.select("o_orderkey", "sort_key", "after", keys_at("sort_key", "after", F.lit(0), F.lit(1)).alias("new_key"))


def _worn(s, d) -> DataFrame:
    """Orders with keys of up to 40 characters, as many insertions at one place leave; of customers of even numbers short ones."""
    key = F.concat(F.lit("a"), F.repeat(F.lit("V"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(F.col("o_orderkey") % 40).cast("int")), F.lpad("o_orderkey", 9, "0"), F.lit("1"))
    return table(s, d, "orders").select("o_orderkey", "o_custkey", key.alias("sort_key"))


def _long_keys(s, d):
    """Parents whose longest key is due for new ones."""
    df = table(s, d, "orders").select("o_custkey", F.concat(F.lit("a"), F.repeat(F.lit("V"), (F.col("o_orderkey") % 40).cast("int"))).alias("sort_key"))
    return df.groupBy("o_custkey").agg(F.max(F.length("sort_key")).cast("long").alias("longest")).withColumn("rebalance", F.col("longest") >= LONGEST)


def _appended(s, d):
    """Line items after the keys of the orders of their supplier's number, as of a customer."""
    new = table(s, d, "lineitem").selectExpr("l_suppkey as o_custkey", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(20,2))) as line", "struct(l_orderkey, l_linenumber, l_partkey, l_extendedprice) as at")
    return appended(_sort_keys(s, d), new, "o_custkey", [F.col("at")]).select("line", "o_custkey", "sort_key")


def _spread(s, d):
    """The suppliers of an order's lines, without repeats, between the keys of two places, one list per order."""
    new = table(s, d, "lineitem").selectExpr("l_orderkey", "l_suppkey", "'a0' as low", "'a1' as high").distinct()
    return spread(new, ["l_orderkey"], "low", "high", [F.col("l_suppkey")]).select("l_orderkey", "l_suppkey", "sort_key")


def _moved(s, d):
    """Every order moves to some place of its customer's list, some beyond its ends; each move on its own."""
    items = _sort_keys(s, d).select("o_custkey", "o_orderkey", "sort_key")
    moves = table(s, d, "orders").selectExpr("o_custkey", "o_orderkey", "cast(o_orderkey % 23 - 2 as int) as target")
    return moved(items, "o_custkey", "o_orderkey", moves).select("o_orderkey", "target", "low", "high", "new_key")


def _key_sql(place: str) -> str:
    """DuckDB: the key of a place below 3,906."""
    digit = lambda x: f"substr('{DIGITS}', cast({x} as bigint) + 1, 1)"
    return f"case when {place} < 62 then 'a' || {digit(place)} else 'b' || {digit(f'({place} - 62) // 62')} || {digit(f'({place} - 62) % 62')} end"


QUERIES = {
    "sort_keys": _sort_keys,
    "insert_keys": _inserted,
    "neighbour_keys": lambda s, d: neighbours(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", "after").select("o_orderkey", "before", "after"),
    "key_length_check": _long_keys,
    "rebalanced_keys": lambda s, d: rebalanced(_worn(s, d), "o_custkey", []),
    "appended_keys": _appended,
    "spread_keys": _spread,
    "moved_keys": _moved,
}
ORACLE_SQL = {
    "sort_keys": "with o as (select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as place from orders) select *, case when place < 62 then 'a' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', place + 1, 1) else 'b' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', (place - 62) // 62 + 1, 1) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', place % 62 + 1, 1) end as sort_key from o",
    "neighbour_keys": "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey) over w as after from orders window w as (partition by o_custkey order by o_orderkey)",
    "rebalanced_keys": f"""with k as (select o_orderkey, o_custkey, 'a' || repeat('V', case when o_custkey % 2 = 0 then 1 else o_orderkey % 40 end) || lpad(cast(o_orderkey as varchar), 9, '0') || '1' as sort_key from orders),
n as (select *, max(length(sort_key)) over (partition by o_custkey) >= 32 as due, row_number() over (partition by o_custkey order by sort_key) - 1 as place from k) select o_orderkey, o_custkey, case when due then {_key_sql('place')} else sort_key end as sort_key from n""",
    "appended_keys": f"""with n as (select o_custkey, count(*) as n from orders group by o_custkey), l as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_extendedprice as decimal(20,2)) as line, l_suppkey as o_custkey,
row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as place from lineitem), p as (select line, l.o_custkey, place + coalesce(n, 0) as place from l left join n using (o_custkey)) select line, o_custkey, {_key_sql('place')} as sort_key from p""",
    "spread_keys": f"""with recursive s as (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_suppkey) - 1 as place from (select distinct l_orderkey, l_suppkey from lineitem)),
t as (select l_orderkey, 0 as lo, 62 as hi, count(*) as n, 0 as skip from s group by l_orderkey union all select l_orderkey, case when half = 0 then lo else (lo + hi + 1) // 2 end, case when half = 0 then (lo + hi + 1) // 2 else hi end, case when half = 0 then n // 2 else n - n // 2 - 1 end, case when half = 0 then skip else skip + n // 2 + 1 end
  from t, (values (0), (1)) h(half) where n > 0)
select s.l_orderkey, l_suppkey, 'a0' || substr('{DIGITS}', cast((lo + hi + 1) // 2 as bigint) + 1, 1) as sort_key from s join t on t.l_orderkey = s.l_orderkey and t.n > 0 and s.place = skip + n // 2""",
    "moved_keys": f"""with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as own, count(*) over (partition by o_custkey) as n, o_orderkey % 23 - 2 as target from orders),
t as (select *, greatest(0, least(target, n - 1)) as dest from r), b as (select *, case when dest > 0 then case when dest - 1 < own then dest - 1 else dest end end as a, case when dest < n - 1 then case when dest < own then dest else dest + 1 end end as z from t)
select o_orderkey, cast(target as int) as target, case when a is not null then {_key_sql('a')} end as low, case when z is not null then {_key_sql('z')} end as high,
  case when a is null and z is null then 'a0' when a is null then case when z = 0 then 'Zz' else {_key_sql('(z - 1)')} end when z is null or z - a > 1 then {_key_sql('(a + 1)')} else {_key_sql('a')} || 'V' end as new_key from b""",
    "key_length_check": "with k as (select o_custkey, 1 + o_orderkey % 40 as n from orders) select o_custkey, max(n) as longest, max(n) >= 32 as rebalance from k group by o_custkey",
}
