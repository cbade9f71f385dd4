"""Graded relevance metrics over (query, rank, grade) rows and judgments (query, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column) -> Column:
    return F.when(grade > 0, F.pow(F.lit(2.0), grade) - 1).otherwise(0.0)


def dcg(grade: Column, rank: Column) -> Column:
    return F.sum(gain(grade) / F.log2(rank + 1))


def ndcg(ranked: DataFrame, judged: DataFrame, query: str, k: int) -> DataFrame:
    """(query, ndcg); null where no judgment has a gain."""
    got = ranked.where(F.col("rank") <= k).groupBy(query).agg(dcg(F.coalesce("grade", F.lit(0)), F.col("rank")).alias("dcg"))
    ideal = judged.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade")))).where(F.col("_r") <= k)
    best = ideal.groupBy(query).agg(dcg(F.col("grade"), F.col("_r")).alias("ideal"))
    return best.join(got, query, "left").select(query, F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def recall(ranked: DataFrame, judged: DataFrame, query: str, k: int, least: int = 2) -> DataFrame:
    found = ranked.where((F.col("rank") <= k) & (F.col("grade") >= least)).groupBy(query).agg(F.count(F.lit(1)).alias("hit"))
    total = judged.groupBy(query).agg(F.sum((F.col("grade") >= least).cast("int")).alias("n"))
    return total.join(found, query, "left").select(query, F.when(F.col("n") > 0, F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def mrr(ranked: DataFrame, judged: DataFrame, query: str, k: int, best: int = 3) -> DataFrame:
    first = ranked.where((F.col("rank") <= k) & (F.col("grade") == best)).groupBy(query).agg(F.min("rank").alias("first"))
    any_ = judged.groupBy(query).agg(F.max((F.col("grade") == best).cast("int")).alias("any"))
    return any_.join(first, query, "left").select(query, F.when(F.col("any") == 1, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def precision(ranked: DataFrame, query: str, k: int, least: int = 2) -> DataFrame:
    return ranked.where(F.col("rank") <= k).groupBy(query).agg(F.avg((F.coalesce("grade", F.lit(0)) >= least).cast("double")).alias("precision"))


def standard_error(value: str) -> Column:
    return F.when(F.count(value) >= 2, F.stddev_samp(value) / F.sqrt(F.count(value)))


def summary(cases: DataFrame, by: str, recall_: str, gate: str, mean_least: float, worst_least: float) -> DataFrame:
    """(by, cases, recall, gates, passed): passed if mean recall, every gate and the worst recall reach what they must; no judged case fails."""
    holds = (F.avg(recall_) >= mean_least) & F.every(gate) & (F.min(recall_) >= worst_least)
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(recall_), 6).alias("recall"), F.every(gate).alias("gates"), F.coalesce(holds, F.lit(False)).alias("passed"))


def delta(now: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, delta): against a stored baseline; delta is null for a key that the baseline lacks, and keys that are no more are left out."""
    old = baseline.select(F.col(key), F.col(value).alias("_old"))
    return now.join(old, key, "left").select(key, value, (F.col(value) - F.col("_old")).alias("delta"))
