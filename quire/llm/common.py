"""What the operators of this subpackage share: words, shared tables and narrow keys."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import shared_dir, written  # noqa: F401

#: White space of every word rule here (fixed by the contract): U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def light(run):
    """A function for mapInArrow that gives the memory it used back to the system at its end.

    Spark keeps Python workers from task to task, and what an allocator keeps of a large task would count
    against the executor while later stages run.
    """
    def task(batches):
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    """Gives free memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, plans that run send Python tasks so many rows at once: long texts and packed rows by the ten thousand are much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of text; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name can't clash with computed ones."""
    return docs.select(*[docs[n] for n in names])

#: Residues that sift() broadcasts at most; a proven bound of its size, whatever the data.
RESIDUES = 1 << 19


def sift(df: DataFrame, key: str, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose long ``key`` may be among ``name`` of keys, rows for which it can't be).

    Only residues of the keys are broadcast. Rows of few keys so needn't be shuffled to find them; with
    very many keys nearly all rows may match, which costs no more than a join without this.
    """
    found = F.broadcast(keys.select(F.pmod(F.col(name), F.lit(RESIDUES)).alias("_residue")).where("_residue is not null").distinct())
    at = F.pmod(df[key], F.lit(RESIDUES)) == F.col("_residue")
    return df.join(found, at, "left_semi"), df.join(found, at, "left_anti")
