"""Quality rules: base rules, and robust multivariate outliers by minimum covariance determinant.

Each document gets counts of its whole text, and four ratios of them as its statistic vector. Within
each (lang, source) the centre and scatter of the three quarters of documents that lie closest
together are found by concentration steps (the C-steps of the minimum covariance determinant), and a
document is rejected when its Mahalanobis distance from them is beyond a high chi-square quantile.

Only DataFrame and SQL functions run here. The text is read once, into a narrow table; all steps work
on that table. Counts and scatters are summed before the shuffle, so a source with most of the rows
costs no more than many small ones; the quantile of each step comes from a histogram of logarithmic
bins, which is exact for its bins, mergeable and of bounded size.

Defined cases: null or blank text has no words and fails the base rules; null lang or source is a
group value like any other; groups of fewer than ``min_group`` documents are judged together as one;
texts of any length are counted whole, in arrays of one row; repeated rows are judged one by one; other columns are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, only, words, written

#: Ratios: (numerator, value of a typical text, least standard deviation that is taken for real).
FEATURES = (
    ("word_chars", 5.2, 0.45),
    ("n_symbols", 0.0, 0.04),
    ("n_dup_lines", 0.0, 0.02),
    ("n_repeat_words", 0.0, 0.06),
)
#: A text counts as if so many typical words stood beside it: ratios of short texts vary more.
PRIOR_WORDS = 40
MIN_GROUP = 32
C_STEPS = 4
#: Chi-square of 4 degrees of freedom at 1 - 1e-6, and the consistency factor of its inner 3/4.
CUT = 33.38
CONSISTENCY = 1.4866
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KEY = "concat(case when lang is null then '-' else concat('+', lang) end, chr(10), case when source is null then '-' else concat('+', source) end)"
P = range(1, len(FEATURES) + 1)


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, the four counts and base_failed, all from its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_w": words(t), "_l": lines})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_l")
    # Hashes of the windows of 8 words, from pairs of windows of half their length.
    for half in (1, 2, 4):
        df = df.withColumn("_h", doubled("_h", half))
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("_h", "_w")
    same = F.expr("filter(_s, (e, j) -> (j > 0 and _s[j - 1].h = e.h) or (j < size(_s) - 1 and _s[j + 1].h = e.h))")
    df = df.withColumn("_p", F.array_sort(F.transform(same, lambda e: e["i"]))).drop("_s")
    covered = F.expr("aggregate(transform(_p, (p, j) -> if(j < size(_p) - 1, least(8, _p[j + 1] - p), 8)), 0, (a, x) -> a + x)")
    df = df.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), 0).otherwise(covered).cast("long")).drop("_p")
    return df.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def doubled(h: str, half: int) -> Column:
    """Hashes of windows of 2 * half words, from those of half words; none where the text is too short."""
    return F.expr(f"if(size({h}) > {half}, transform(sequence(0, size({h}) - {half} - 1), i -> xxhash64({h}[i], {h}[i + {half}])), cast(array() as array<bigint>))")


def vector(i: int) -> str:
    name, prior, _ = FEATURES[i - 1]
    return f"cast({name} + {prior * PRIOR_WORDS} as double) / (n_words + {PRIOR_WORDS})"


#: SQL that Spark and DuckDB both run: scatter with its least variances, Cholesky factor, squared distance.
MOMENTS = ["count(*) as n", *(f"avg(x{i}) as m{i}" for i in P), *(f"covar_pop(x{i}, x{j}) as v{i}{j}" for i in P for j in P if j <= i)]


def cholesky() -> list[list[tuple[str, str]]]:
    """Levels of (name, expression); each needs those before."""
    out = []
    for i in P:
        for j in range(1, i + 1):
            scale = f"{CONSISTENCY} * v{i}{j}" + (f" + {FEATURES[i - 1][2] ** 2:.6f}" if i == j else "")
            rest = f"{scale}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out.append([(f"l{i}{j}", f"sqrt({rest})" if i == j else f"({rest}) / l{j}{j}")])
    return out


def whitened() -> list[tuple[str, str]]:
    return [(f"y{i}", f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i}") for i in P]


D2 = " + ".join(f"y{i} * y{i}" for i in P)
BIN = "cast(floor(32 * ln(1 + d2)) as bigint)"
ENOUGH = "4 * cum >= 3 * n"


def estimate(points: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the scatter for each g of points (g, x1..x4)."""
    params = None
    for step in range(C_STEPS + 1):
        if params is None:
            inner = points
        else:
            far = distances(points, params).withColumn("bin", F.expr(BIN))
            hist = far.groupBy("g").agg(F.count("*").alias("n")).join(far.groupBy("g", "bin").agg(F.count("*").alias("c")), "g")
            hist = hist.selectExpr("g", "bin", "n", "sum(c) over (partition by g order by bin) as cum").where(ENOUGH)
            inner = far.join(hist.groupBy("g").agg(F.min("bin").alias("upto")), "g").where("bin <= upto")
        params = inner.groupBy("g").agg(*[F.expr(m) for m in MOMENTS])
        for level in cholesky():
            params = params.withColumns({n: F.expr(e) for n, e in level})
        keep = ["g", *(f"m{i}" for i in P), *(f"l{i}{j}" for i in P for j in P if j <= i)]
        params = written(params.select(*keep), f"mcd-{step}")
    return params


def distances(points: DataFrame, params: DataFrame) -> DataFrame:
    """points with the squared Mahalanobis distance d2 from the estimate of their g; null where g has none."""
    df = points.join(params, "g", "left")
    for n, e in whitened():
        df = df.withColumn(n, F.expr(e))
    return df.withColumn("d2", F.expr(D2)).select(*points.columns, "d2")


def with_group(stats: DataFrame) -> DataFrame:
    """stats (with lang, source and the counts) with the vector, its group k and the group g that judges it."""
    df = stats.withColumns({"k": F.expr(KEY), **{f"x{i}": F.expr(vector(i)) for i in P}})
    sizes = df.where("not base_failed").groupBy("k").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_GROUP)
    return df.join(sizes, "k", "left").withColumn("g", F.expr("case when size is null then '*' else k end"))


def judged(stats: DataFrame) -> DataFrame:
    """stats with kept; stats is read several times, so pass a written table."""
    df = with_group(stats)
    params = estimate(df.where("not base_failed").select("g", *[f"x{i}" for i in P]))
    return distances(df, params).withColumn("kept", F.expr(f"not base_failed and coalesce(d2 <= {CUT}, true)"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and base_failed of each row of docs."""
    return base_columns(only(docs, "doc_id", "lang", "source", "text")).drop("text")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the squared distance d2."""
    stats = written(statistics(docs), "quality")
    return judged(stats).select("doc_id", "n_words", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their own columns only.

    Verdicts are not joined back by doc_id, which may be null or repeated: one pass writes each row
    beside its counts, the estimates are made from the narrow columns of that table, and the small table
    of estimates is joined to it.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: own[docs.columns.index(n)] for n in ("text", "lang", "source")}
    df = base_columns(docs.toDF(*own).withColumns({n: F.col(c) for n, c in at.items()}))
    df = written(df.select(*own, "lang", "source", "n_words", *COUNTS, "base_failed"), "quality")
    grouped = with_group(df.drop(*own))
    params = estimate(grouped.where("not base_failed").select("g", *[f"x{i}" for i in P])).withColumnRenamed("g", "k")
    df = df.where("not base_failed").withColumns({"k": F.expr(KEY), **{f"x{i}": F.expr(vector(i)) for i in P}})
    rest = params.where("k = '*'").select(F.lit(1).alias("one"), *[F.col(c).alias(f"r_{c}") for c in params.columns if c != "k"])
    df = df.withColumn("one", F.lit(1)).join(params, "k", "left").join(F.broadcast(rest), "one", "left")  # one row at most
    df = df.withColumns({c: F.coalesce(c, f"r_{c}") for c in params.columns if c != "k"})
    for n, e in whitened():
        df = df.withColumn(n, F.expr(e))
    return df.where(F.expr(f"coalesce({D2} <= {CUT}, true)")).select(*own).toDF(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def base_sql(table: str = "documents") -> str:
    """DuckDB: the counts; table has doc_id, lang, source, text."""
    return f"""
words as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as l from {table}),
windows as (select r, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as s from words where len(w) >= 8),
twice as (select r, i, lead(i) over (partition by r order by i) as nxt from (select r, i, count(*) over (partition by r, s) as c from windows) where c > 1),
cover as (select r, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words from twice group by r),
counts as (select r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from words left join cover using (r)),
stats as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)"""


def verdict_sql() -> str:
    """DuckDB: CTEs after base_sql(), ending in judged (r, ..., d2)."""
    xs = ", ".join(f"{vector(i)} as x{i}" for i in P)
    out = [f"vec as (select *, {KEY} as k, {xs} from stats)",
           f"big as (select k, count(*) as size from vec where not base_failed group by k having count(*) >= {MIN_GROUP})",
           "pts as (select vec.*, case when size is null then '*' else vec.k end as g from vec left join big using (k))"]
    moments = ", ".join(MOMENTS)
    for s in range(C_STEPS + 1):
        src = "pts where not base_failed" if s == 0 else f"far{s} join upto{s} using (g) where bin <= upto"
        if s:
            out.append(f"far{s} as (select *, {BIN} as bin from ({distance_sql('(select * from pts where not base_failed)', f'par{s - 1}')}))")
            out.append(f"hist{s} as (select g, bin, sum(c) over (partition by g order by bin) as cum, sum(c) over (partition by g) as n from (select g, bin, count(*) as c from far{s} group by g, bin))")
            out.append(f"upto{s} as (select g, min(bin) as upto from hist{s} where {ENOUGH} group by g)")
        inner = f"(select g, {moments} from {src} group by g)"
        for level in cholesky():
            inner = f"(select *, {', '.join(f'{e} as {n}' for n, e in level)} from {inner})"
        out.append(f"par{s} as materialized (select * from {inner})")
    out.append(f"judged as ({distance_sql('pts', f'par{C_STEPS}')})")
    return ",\n".join(out)


def distance_sql(points: str, params: str) -> str:
    cols = ", ".join(f"q.{c}" for c in [*(f"m{i}" for i in P), *(f"l{i}{j}" for i in P for j in P if j <= i)])
    inner = f"(select p.*, {cols} from {points} p left join {params} q using (g))"
    for n, e in whitened():
        inner = f"(select *, {e} as {n} from {inner})"
    return f"select r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, g, x1, x2, x3, x4, {D2} as d2 from {inner}"


SQL = f"""with {base_sql()},
{verdict_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {CUT}, true) as kept from judged"""
