"""Changes to tables as new tables: Parquet has no updates, so each gives the rows that the table has afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows added whose key it lacks; rows it has stay as they are."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def replaced(table: DataFrame, rows: DataFrame, imported: str) -> DataFrame:
    """table with all imported rows (where the column imported isn't null) replaced by rows."""
    return table.where(F.col(imported).isNull()).unionByName(rows)


def replaced_children(table: DataFrame, rows: DataFrame, parent: list[str]) -> DataFrame:
    """table with the rows of the parents in rows replaced."""
    return table.join(rows.select(*parent).distinct(), parent, "left_anti").unionByName(rows)


def connected(table: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """table with the names it lacks, each once."""
    return table.unionByName(names.select(name).distinct().join(table.select(name), name, "left_anti"), allowMissingColumns=True)


def updated_if(table: DataFrame, edits: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(table with edits whose version is still the row's, edits in conflict).

    edits has key, version and new values of any columns.
    """
    values = [c for c in edits.columns if c not in (key, version)]
    new = edits.select(key, F.col(version).alias("_version"), *[F.col(c).alias(f"_{c}") for c in values])
    joined = table.join(new, key, "left")
    hit = F.col("_version") == F.col(version)
    out = joined.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
    conflicts = edits.join(table.select(key, version), [key, version], "left_anti")
    return out, conflicts


def trashed(table: DataFrame, ids: DataFrame, key: str, at) -> DataFrame:
    """table with deleted_at set on the ids that aren't in the trash yet."""
    marked = table.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_gone")


def without(table: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """The rows of table whose key is in keep."""
    return table.join(keep.select(*key).distinct(), key, "left_semi")


def restored(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """table with deleted_at cleared on the ids."""
    marked = table.join(ids.select(key).distinct().withColumn("_back", F.lit(True)), key, "left")
    return marked.withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).drop("_back")


def appended(path: str, rows: DataFrame) -> int:
    """Adds rows to the table at a path and says how many; they are counted as they are written."""
    seen = Observation("appended")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def nested(rows: DataFrame, key: str, children: str) -> tuple[DataFrame, DataFrame]:
    """An insert of rows with their children in an array: the rows without it, and a row per child with its parent's key and place."""
    parts = rows.select(F.col(key).alias(f"{key}_of"), F.posexplode(children).alias("position", "_child"))
    return rows.drop(children), parts.select(f"{key}_of", "position", "_child.*")
