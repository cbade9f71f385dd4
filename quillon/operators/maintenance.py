"""Catalog maintenance as snapshot rewrites (write the result to a new path, then swap)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import lapsed


def classify(existing: DataFrame, incoming: DataFrame, key: str, hash_: str = "content_hash") -> DataFrame:
    """(key, status): inserted, updated, unchanged, or absent for rows that only exist."""
    e, i = existing.select(key, F.col(hash_).alias("_old"), F.lit(True).alias("_e")), incoming.select(key, F.col(hash_).alias("_new"), F.lit(True).alias("_i"))
    both = e.join(i, key, "full")
    status = F.when(F.col("_i").isNull(), "absent").when(F.col("_e").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(key, status.alias("status"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, owned: list[str], clock: str) -> DataFrame:
    """The new snapshot: incoming values win but for owned columns and the first clock; the clock never goes back."""
    e, i = existing.alias("e"), incoming.alias("i")
    out = []
    for c in existing.columns:
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        pick = F.coalesce(old, new) if c == key else F.greatest(old, new) if c == clock else F.coalesce(old, new) if c in owned else F.when(F.col(f"i.{key}").isNotNull(), new).otherwise(old)
        out.append(pick.alias(c))
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full").select(*out)


def soft_delete(existing: DataFrame, incoming: DataFrame, key: str, group: str, seen: str, now: str, days: int = 7, share: float = 0.5, cadence: str | None = None) -> DataFrame:
    """(key, deactivate): absent rows not seen for `days`, or two of their cadences (a column of days) if that is longer, but only in groups of which the run saw enough."""
    marked = existing.join(incoming.select(key, F.lit(1).alias("_in")), key, "left")
    per = marked.groupBy(F.col(group).alias("_group")).agg((F.sum(F.coalesce("_in", F.lit(0))) >= share * F.count(F.lit(1))).alias("_enough"))
    marked, enough = marked.join(per, F.col(group).eqNullSafe(F.col("_group"))), F.col("_enough")
    old = lapsed(F.col(seen), F.col(cadence) if cadence else F.lit(0), F.expr(f"timestamp_ntz '{now}'"), days)
    return marked.select(key, (enough & F.col("_in").isNull() & old).alias("deactivate"))


def insert_missing(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those distinct rows whose key it lacks."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


def null_fill(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill nulls of base from patch, never overwrite."""
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(p, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in base.columns))
