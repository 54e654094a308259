"""Reading tables, and the logical views of a question bank over them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that the driver and all executors share.

    Only where it is unset in one local JVM, as in tests, a temporary folder is made and set; on a cluster that is an error,
    since a folder of one machine isn't seen by others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as questions; labels give trash (toxic) and validation (quality)."""
    labels = table(spark, folder, "labels")
    status = F.when(F.col("quality") == 1, "VALID").when(F.col("quality") == 0, "INVALID").otherwise("UNVALIDATED")
    df = table(spark, folder, "documents").join(labels, "doc_id", "left")
    return df.select("doc_id", "text", "lang", "source", "n_chars", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"), status.alias("validation_status"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations, customers and orders as a tree: id, parent_id, sort_key, title, kind."""
    n = table(spark, folder, "nation").selectExpr("concat('n', n_nationkey) as id", "cast(null as string) as parent_id", "lpad(n_nationkey, 9, '0') as sort_key", "n_name as title", "'CHAPTER' as kind")
    c = table(spark, folder, "customer").selectExpr("concat('c', c_custkey) as id", "concat('n', c_nationkey) as parent_id", "lpad(c_custkey, 9, '0') as sort_key", "c_name as title", "'SECTION' as kind")
    o = table(spark, folder, "orders").selectExpr("concat('o', o_orderkey) as id", "concat('c', o_custkey) as parent_id", "lpad(o_orderkey, 9, '0') as sort_key", "o_orderpriority as title", "'QUESTION' as kind")
    return n.unionByName(c).unionByName(o)


def options(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as options of the question l_orderkey, correct where returned; position is unique."""
    key = "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    return table(spark, folder, "lineitem").selectExpr("l_orderkey as question", "l_linenumber as number", "l_partkey as part", f"{key} as at", "l_returnflag = 'R' as correct", "l_quantity as quantity")


#: The same views in SQL.
NODES_SQL = """nodes as (
  select 'n' || n_nationkey as id, cast(null as varchar) as parent_id, lpad(cast(n_nationkey as varchar), 9, '0') as sort_key, n_name as title, 'CHAPTER' as kind from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, lpad(cast(c_custkey as varchar), 9, '0'), c_name, 'SECTION' from customer
  union all select 'o' || o_orderkey, 'c' || o_custkey, lpad(cast(o_orderkey as varchar), 9, '0'), o_orderpriority, 'QUESTION' from orders)"""
QUESTIONS_SQL = """questions as (
  select d.doc_id, text, lang, source, n_chars, coalesce(toxic = 1, false) as deleted,
    case when quality = 1 then 'VALID' when quality = 0 then 'INVALID' else 'UNVALIDATED' end as validation_status
  from documents d left join labels l on l.doc_id = d.doc_id)"""
