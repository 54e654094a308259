"""Seeded draws, shuffles and exam variants.

A variant is one stream of draws, questions first and then the options of each in its new place, so a
variant is one row's work; variants are spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import option_label
from quire.sources.tables import options, table

MASK = (1 << 32) - 1


def draws(seed: int):
    """Endless 32-bit numbers of a seed (mulberry32; the constants are fixed values of that generator)."""
    state = seed & MASK
    while True:
        state = (state + 0x6D2B79F5) & MASK
        t = (state ^ state >> 15) * (state | 1) & MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & MASK)) & MASK
        yield t ^ t >> 14


def below(stream, bound: int) -> int:
    """A number from 0 to bound - 1 without bias: draws in the last, incomplete range are passed over."""
    if bound == 1:
        return 0
    whole = (1 << 32) // bound * bound
    return next(x for x in stream if x < whole) % bound


def shuffled(items, stream) -> list:
    """Fisher-Yates from the end, on a copy."""
    out = list(items)
    for i in reversed(range(1, len(out))):
        j = below(stream, i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def variant(questions: list[tuple], seed: int, shuffle_questions: bool = False) -> list[tuple[str, list[str]]]:
    """(question, options in order) of a variant; questions are (name, options, pinned) or (name, options, pinned, whether options are shuffled).

    Questions keep their order unless told; options are shuffled unless told. Pinned options come last, in their own order.
    """
    stream = draws(seed)
    chosen = shuffled(questions, stream) if shuffle_questions else questions
    out = []
    for name, opts, pinned, *told in chosen:
        free = [o for o in opts if o not in pinned]
        out.append((name, [*(shuffled(free, stream) if told in ([], [True]) else free), *(o for o in opts if o in pinned)]))
    return out


def seed_of(text: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of a text, by built-in functions.

    The prime 2^24 + 403 is applied as a shift and a product, which stay within a long.
    """
    units = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})"), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("long"))
    step = lambda h, c: (F.shiftleft(h.bitwiseXOR(c) % 256, 24) + h.bitwiseXOR(c) * 403) % (1 << 32)
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)


def display_shuffle(items: Column, draws_: Column) -> Column:
    """items shuffled for the screen by numbers from 0 to 1, one for each place from the last down to the second."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items) - 1)), lambda k: F.size(items) - k)

    def swap(a, i):
        j = F.floor(F.element_at(draws_, (F.size(items) - i).cast("int")) * (i + 1)).cast("int")
        return F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))

    return F.when(F.size(items) < 2, items).otherwise(F.aggregate(places, items, swap))


def _shuffle(s, d):
    """Five options of each part, shuffled by its key as seed."""

    @F.pandas_udf("array<string>")
    def mixed(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda x: shuffled(["o0", "o1", "o2", "o3", "o4"], draws(int(x))))

    return table(s, d, "part").select("p_partkey", mixed("p_partkey").alias("options")).select("p_partkey", F.array_join("options", ",").alias("options"))


def _variants(s, d):
    """A variant of each customer's orders as questions, with their lines as options; the last line is pinned."""
    o = options(s, d).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("a"))
    q = table(s, d, "orders").join(o, F.col("o_orderkey") == F.col("question"))
    one = q.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("q"), F.transform("a", lambda x, i: F.concat(F.col("o_orderkey").cast("string"), F.lit("."), i.cast("string"))).alias("o")))).alias("questions"))

    def run(batches):
        for pdf in batches:
            rows = []
            for c, qs in zip(pdf["o_custkey"], pdf["questions"]):
                for i, (name, opts) in enumerate(variant([(x["q"], list(x["o"]), {x["o"][-1]}) for x in qs], int(c), True)):
                    rows.append((c, i, name, ",".join(opts)))
            yield pd.DataFrame(rows, columns=["variant", "position", "question", "options"])

    return one.mapInPandas(run, "variant long, position long, question string, options string")


def _answers(s, d):
    """Letter of the first correct option of each question, in the printed order."""
    o = options(s, d).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "correct"))).alias("a"))
    at = F.array_position(F.transform("a", lambda x: x["correct"]), F.lit(True)) - 1
    return o.select("question", at.alias("i")).where("i >= 0").select("question", option_label(F.col("i")).alias("letter"))


def exam(lines: DataFrame) -> DataFrame:
    o = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    items = F.array_join(F.transform("a", lambda x: F.concat(F.lit("\\item "), x["l_partkey"].cast("string"))), "\n")
    return o.select("l_orderkey", F.concat(F.lit("\\begin{enumerate}\n"), items, F.lit("\n\\end{enumerate}")).alias("latex"))


def add_reason(parts: DataFrame, lines: DataFrame) -> DataFrame:
    used = lines.select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("used")).distinct()
    return parts.join(used, "p_partkey", "left").select("p_partkey", F.expr("case when used then 'already' when p_type = 'PROMO' then 'no_section' when p_brand = 'Brand#3' then 'foreign' else 'ok' end").alias("reason"))


def _items(s, d):
    df = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return df.select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey").orderBy("o_custkey", "o_orderkey", "l_linenumber", "l_partkey")


QUERIES = {
    "variant_shuffle": _shuffle,
    "build_variants": _variants,
    "seed_from_text": lambda s, d: table(s, d, "part").select("p_partkey", seed_of(F.col("p_name")).alias("seed")),
    "answer_labels": _answers,
    "first_correct": lambda s, d: options(s, d).where("correct").groupBy("question").agg(F.min(F.struct("at", "part"))["part"].alias("part")),
    "fingerprint": lambda s, d: options(s, d).groupBy("question").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"].cast("string")), "\n"), 256).alias("fingerprint")),
    "exam_text": lambda s, d: exam(table(s, d, "lineitem")),
    "add_item_reason": lambda s, d: add_reason(table(s, d, "part"), table(s, d, "lineitem")),
    "ordered_items": _items,
}
ORACLE_SQL = {
    "seed_from_text": "with recursive h as (select p_partkey, p_name, 1 as i, 2166136261::bigint as h from part union all select p_partkey, p_name, i + 1, (xor(h, ascii(substr(p_name, i, 1))::bigint) * 16777619) % 4294967296 from h where i <= length(p_name)) select p_partkey, h as seed from h where i = length(p_name) + 1",
    "answer_labels": "with o as (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem) select l_orderkey as question, chr(cast(97 + min(i) as int)) as letter from o where l_returnflag = 'R' group by l_orderkey",
    "first_correct": "select l_orderkey as question, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as part from lineitem where l_returnflag = 'R' group by l_orderkey",
    "fingerprint": "select l_orderkey as question, sha256(string_agg(cast(l_partkey as varchar), chr(10) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as fingerprint from lineitem group by l_orderkey",
    "exam_text": r"select l_orderkey, '\begin{enumerate}' || chr(10) || string_agg('\item ' || l_partkey, chr(10) order by l_linenumber, l_partkey) || chr(10) || '\end{enumerate}' as latex from lineitem group by l_orderkey",
    "add_item_reason": "select p_partkey, case when exists (select 1 from lineitem where l_partkey = p_partkey) then 'already' when p_type = 'PROMO' then 'no_section' when p_brand = 'Brand#3' then 'foreign' else 'ok' end as reason from part",
    "ordered_items": "select o_custkey, o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey order by o_custkey, o_orderkey, l_linenumber, l_partkey",
}
