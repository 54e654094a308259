"""Mixing sources to target weights by systematic sampling.

Sources share all words by weight, none above ``limit`` times its own size. Within a source every
document has the same expected number of copies, target / size. The expected copies are summed along
the documents in order of size, one random offset per source is added, and a document is emitted once
for each integer that its stretch of the sum crosses. Ordered by size, the words taken come as near
the target as the size of a document.

The order within a source is made by range partitions of (source, size, doc_id, text), not by a window
over the source: a partition knows how many documents of the source lie in the partitions before it,
so a source with most of the rows is spread over all tasks.

Defined cases: null or blank text has size 0 and takes no words; a null source is a source of its own,
ordered last; texts of any length count whole, and one that is above its source's target may be left out or
taken as its size allows; equal rows are placed next to each other, and share what falls to them; reruns agree,
since the offset is a hash of the source and the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import documents, n_words, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix"
OFFSET = "cast(conv(substring(sha2(concat('{seed}', case when source is null then '-' else concat('+', source) end), 256), 1, 8), 16, 10) as bigint) / 4294967296D"


def targets(sources: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sources (source, source_size) with target: water filling, one row per source in one window."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * float(limit))
    by = Window.orderBy(F.expr("cap / w"), F.col("source").asc_nulls_last())
    df = df.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
        "filled": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    # Filled up to this source, the level is what is left over the weights that are open; it falls from the first level on that is below its cap, and that one holds.
    df = df.withColumn("level", F.expr("(total - filled) / open"))
    df = df.withColumn("level", F.max(F.expr("case when level <= cap / w then level end")).over(Window.partitionBy()))
    return df.selectExpr("source", "source_size", "coalesce(least(cap, level * w), cap) as target")


def with_copies(df: DataFrame, weights=WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """df (doc_id, source, size, h and any others) with source_size, target and copies.

    Rows are first written in order, with their place in it.
    """
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("h")]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.expr("shiftright(_at, 33)")), "mix")
    k = F.expr("case when source is null then '-' else concat('+', source) end")
    parts = placed.groupBy("source", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_words"))
    parts = written(parts, "mix-parts")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).withColumn("_k", k)
    goal = targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, limit)
    goal = goal.withColumn("offset", F.expr(OFFSET.format(seed=seed))).withColumn("_k", k).drop("source")
    parts = parts.select("_k", "_part", "_start").join(goal, "_k")
    out = placed.withColumn("_k", k).join(parts, ["_k", "_part"])
    out = out.withColumn("_rate", F.expr("case when source_size = 0 then 0D else target / source_size end"))
    out = out.withColumns({"_whole": F.floor("_rate"), "_rank": F.expr("_at + _start")})
    out = out.withColumn("_frac", F.expr("_rate - _whole"))
    # Whole copies apart, so that no rounding of a long sum gives a document more than one copy above them.
    out = out.withColumn("copies", F.expr("_whole + least(1, floor(offset + (_rank + 1) * _frac) - floor(offset + _rank * _frac))"))
    return out.drop("_at", "_part", "_k", "_start", "_rate", "_whole", "_rank", "_frac", "offset")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and h, the hash of the text that orders rows of one doc_id."""
    return docs.select(docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"), F.md5(docs["text"].cast("binary")).alias("h"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    out = with_copies(written(sized(docs), "sizes"))
    return out.selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns only.

    The rows travel with their text through the range partitions, so null or repeated ids do no harm.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: own[docs.columns.index(n)] for n in ("doc_id", "source", "text")}
    df = docs.toDF(*own)
    df = df.withColumns({"doc_id": F.col(at["doc_id"]), "source": F.col(at["source"]), "size": n_words(F.col(at["text"])), "h": F.md5(F.col(at["text"]).cast("binary"))})
    out = with_copies(df).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*own).toDF(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


SQL = r"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(text) as h from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w, source_size * 3.0::double as cap from sources),
filled as (select *, (sum(source_size) over ())::double as total, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as open from weighed),
levels as (select *, max(case when (total - filled) / open <= cap / w then (total - filled) / open end) over () as level from filled),
goals as (select source, source_size, coalesce(least(cap, level * w), cap) as target,
  ('0x' || substr(sha256('mix' || case when source is null then '-' else '+' || source end), 1, 8))::bigint / 4294967296::double as u from levels),
ranked as (select s.doc_id, s.size, g.*, row_number() over (partition by s.source order by s.size, s.doc_id, s.h) - 1 as k,
  case when source_size = 0 then 0::double else target / source_size end as rate from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, cast((floor(rate) + least(1, floor(u + (k + 1) * (rate - floor(rate))) - floor(u + k * (rate - floor(rate))))) as bigint) * size as taken from ranked
"""
