"""Upserts as set operations: dedupe the batch, join it with what is there, merge field by field, and log changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of_each(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last by order."""
    rest = [c for c in batch.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*keys).agg(top.alias("r")).select(*keys, "r.*")


def kept_or_new(old: Column, new: Column) -> Column:
    """A missing value never erases."""
    return F.coalesce(new, old)


def changes(kinds: list[tuple[str, Column]]) -> Column:
    """The kinds that hold, the most important first."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """(keys, columns merged, change): change is new, a tracked column's name (the first that changed), or null.

    Keys compare null-safe. One full join; the batch is reduced to one row a key before it.
    """
    new = last_of_each(batch, keys, order)
    columns = [c for c in current.columns if c not in keys]
    c, n = current.alias("c"), new.alias("n")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    both = c.withColumn("__c", F.lit(1)).join(n.withColumn("__n", F.lit(1)), cond, "full")
    moved = [(k, F.col("__c").isNotNull() & F.col("__n").isNotNull() & F.col(f"n.{k}").isNotNull() & ~F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))) for k in tracked]
    kind = F.when(F.col("__c").isNull(), "new").otherwise(F.get(changes(moved), F.lit(0)))
    return both.select(*[F.coalesce(F.col(f"c.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[kept_or_new(F.col(f"c.{k}"), F.col(f"n.{k}")).alias(k) for k in columns], kind.alias("change"))


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """current and those rows whose key it lacks, one for each key."""
    return current.unionByName(rows.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti"))


def set_difference(current: DataFrame, desired: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(keys, action): insert, delete or update where anything compared differs."""
    c, d = current.select(*keys, *[F.col(x).alias(f"c_{x}") for x in compared], F.lit(1).alias("__c")), desired.select(*keys, *[F.col(x).alias(f"d_{x}") for x in compared], F.lit(1).alias("__d"))
    differs = F.lit(False)
    for x in compared:
        differs = differs | ~F.col(f"c_{x}").eqNullSafe(F.col(f"d_{x}"))
    action = F.when(F.col("__c").isNull(), "insert").when(F.col("__d").isNull(), "delete").when(differs, "update")
    return c.join(d, keys, "full").select(*keys, action.alias("action")).filter("action IS NOT NULL")


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows over those partitions that they have, and no others; writing them again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def first_per(window_keys: list[str], *order) -> Column:
    return F.row_number().over(W.partitionBy(*window_keys).orderBy(*order))
