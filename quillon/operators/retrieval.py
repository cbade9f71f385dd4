"""Constants of ranked retrieval, boosts and limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
K1, B, FLOOR, LIMIT, EXPANSION = 1.2, 0.75, 2.0, 120, 0.6


def boosted(parts: DataFrame, query: str, doc: str, boosts: Mapping[str, float]) -> DataFrame:
    """(query, doc, score)."""
    boost = F.coalesce(*(F.when(F.col("field") == n, F.lit(float(b))) for n, b in boosts.items()))
    return parts.where(F.col("field").isin(*boosts)).groupBy(query, doc).agg(F.sum(boost * F.col("part")).alias("score"))


def top_k(scores: DataFrame, query: str, doc: str, k: int = LIMIT, floor: float | None = None) -> DataFrame:
    """Add rank (score descending, document ascending), keep k at most and scores of floor or more."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))
    out = scores.withColumn("rank", rank).where(F.col("rank") <= clamp_limit(k))
    return out.where(F.col("score") >= floor) if floor is not None else out


def clamp_limit(k: int | None) -> int:
    return LIMIT if k is None else max(1, min(500, int(k)))


def check_boost(b: float) -> float:
    if not 0 < b <= 100:  # also refuses nan
        raise ValueError(f"boost {b} is not in (0, 100]")
    return round(b, 3)
