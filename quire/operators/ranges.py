"""Order without a task per key: running sums, ranks and neighbours by range partition, and joins of points with intervals.

A window over a key gathers all its rows in one task. Here rows are dealt by ranges of (key, order), so a key with most of the rows
lies in as many partitions as any others of that size; a partition sums its own rows, and what lies before it is added from a table of one row for each
key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import written


def placed(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """df in order of key and order, with its range partition _part and its place _at among all rows; equal rows of order keep to any order, once for all."""
    keys = [F.col(k) for k in ([key] if isinstance(key, str) else key)]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.expr("cast(shiftright(_at, 33) as int)")), "placed")


def running(df: DataFrame, key: str | list[str], order: list[Column], value: str | Column, name: str = "before") -> DataFrame:
    """df with ``name``: the sum of value over the earlier rows of its key, in order. Null keys are a key of their own."""
    keys = [key] if isinstance(key, str) else list(key)
    own = [f"_k{i}" for i in range(len(keys))]
    # Keys are never null in joins: an empty struct field stands for null.
    rows = placed(df.withColumn("_value", F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit(0))), keys, order)
    rows = rows.withColumns({o: F.struct(F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit(""))) for o, k in zip(own, keys)})
    inside = Window.partitionBy("_part", *own).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *own).agg(F.sum("_value").alias("_sum"))
    parts = parts.select("_part", *own, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(parts, ["_part", *own]).withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)


def ranked(df: DataFrame, key: str | list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row, from 0, among the rows of its key."""
    return running(df, key, order, F.lit(1), name)


def beside(df: DataFrame, key: str, order: list[Column], column: str, before: str | None, after: str | None) -> DataFrame:
    """df with the value of column in the rows before and after it of its key (None: not asked for); null at the ends.

    The last row of a partition meets the first of a later one by the table of edges, of one row for each key and partition.
    """
    rows = placed(df, key, order).withColumn("_k", F.struct(F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    inside = Window.partitionBy("_part", "_k").orderBy("_at")
    edges = rows.groupBy("_part", "_k").agg(F.min_by(column, "_at").alias("_first"), F.max_by(column, "_at").alias("_last"))
    by = Window.partitionBy("_k").orderBy("_part")
    edges = edges.select("_part", "_k", F.lag("_last").over(by).alias("_lag"), F.lead("_first").over(by).alias("_lead"))
    rows = rows.withColumn("_n", F.row_number().over(inside))
    rows = rows.withColumns({"_p": F.lag(column).over(inside), "_f": F.lead(column).over(inside), "_end": F.lead("_n").over(inside).isNull()})
    rows = rows.join(edges, ["_part", "_k"])
    told = {before: F.when(F.col("_n") == 1, F.col("_lag")).otherwise(F.col("_p")), after: F.when(F.col("_end"), F.col("_lead")).otherwise(F.col("_f"))}
    return rows.withColumns({n: e for n, e in told.items() if n}).select(*df.columns, *[n for n in told if n])


def within(points: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, width: int = 1024, how: str = "inner") -> DataFrame:
    """Rows of points joined to the rows of spans with the same key whose first <= at <= last.

    Spans are cut at the borders of bins of ``width`` and meet points in their bin alone, so a key's points and spans are spread
    over as many tasks as it has bins. A span gives as many rows as it has bins. Clashing columns other than the key are told apart by the caller; how: inner or left.
    """
    pieces = spans.where(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    pieces = pieces.withColumnRenamed(key, "_spankey")
    some = points.withColumn("_pbin", F.floor(F.col(at) / width))
    on = (some[key] == pieces["_spankey"]) & (some["_pbin"] == pieces["_bin"]) & (pieces[first] <= some[at]) & (some[at] <= pieces[last])
    return some.join(pieces, on, how).drop("_bin", "_pbin", "_spankey")
