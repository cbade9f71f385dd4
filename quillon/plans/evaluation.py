"""Evaluation queries: documents ranked by length within a source, graded by labels (toxic 0, good 3, else 1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as e
from .query import query

_J = "j AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 3 ELSE 1 END AS grade FROM documents JOIN labels USING (doc_id)), r AS (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank, coalesce(j.grade, 0) AS grade FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id)"


def _both(read):
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 3).otherwise(1)
    judged = read("documents").join(read("labels"), "doc_id").select("doc_id", "source", grade.alias("grade"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = read("documents").select("source", "doc_id", rank.alias("rank")).join(judged.select("doc_id", "grade"), "doc_id", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return ranked, judged


@query(f"WITH {_J}, g AS (SELECT source, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg FROM r WHERE rank <= 10 GROUP BY 1), i AS (SELECT source, sum((2 ** grade - 1) / log2(k + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade DESC) AS k FROM j) WHERE k <= 10 GROUP BY 1) SELECT source, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END, 6) AS ndcg FROM i LEFT JOIN g USING (source)")
def ndcg_at_k(read):
    return e.ndcg(*_both(read), "source", 10).select("source", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_J}, h AS (SELECT source, count(*) AS hit FROM r WHERE rank <= 20 AND grade >= 2 GROUP BY 1) SELECT source, round(CASE WHEN n > 0 THEN coalesce(hit, 0) / n::DOUBLE END, 6) AS recall FROM (SELECT source, sum((grade >= 2)::INT) AS n FROM j GROUP BY 1) LEFT JOIN h USING (source)")
def recall_at_k(read):
    return e.recall(*_both(read), "source", 20).select("source", F.round("recall", 6).alias("recall"))


@query(f"WITH {_J}, f AS (SELECT source, min(rank) AS f FROM r WHERE rank <= 10 AND grade = 3 GROUP BY 1) SELECT source, round(CASE WHEN a THEN coalesce(1.0::DOUBLE / f, 0) END, 6) AS mrr FROM (SELECT source, bool_or(grade = 3) AS a FROM j GROUP BY 1) LEFT JOIN f USING (source)")
def mrr_at_k(read):
    return e.mrr(*_both(read), "source", 10).select("source", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_J} SELECT source, round(avg((grade >= 2)::INT), 6) AS precision FROM r WHERE rank <= 10 GROUP BY 1")
def precision_at_k(read):
    return e.precision(_both(read)[0], "source", 10).select("source", F.round("precision", 6).alias("precision"))


@query("SELECT user_id, 1 - least(sum((event_type = 'purchase')::INT), 5) / 5.0::DOUBLE AS behaviour FROM events GROUP BY 1")
def zero_behaviour(read):
    n = F.count_if(F.col("event_type") == "purchase")
    return read("events").groupBy("user_id").agg((1 - F.least(n, F.lit(5)) / 5.0).alias("behaviour"))


@query(f"WITH {_J} SELECT source, bool_or(rank <= 10 AND grade = 3) AS passed FROM r GROUP BY 1")
def gate_pass(read):
    return _both(read)[0].groupBy("source").agg(F.max((F.col("rank") <= 10) & (F.col("grade") == 3)).alias("passed"))


@query(f"WITH {_J}, p AS (SELECT source, avg((grade >= 2)::INT) AS p FROM r WHERE rank <= 10 GROUP BY 1) SELECT round(avg(p), 6) AS mean, round(stddev_samp(p) / sqrt(count(p)), 6) AS se, min(p) >= 0.05 AS passed FROM p")
def eval_summary(read):
    per = e.precision(_both(read)[0], "source", 10)
    return per.agg(F.round(F.avg("precision"), 6).alias("mean"), F.round(e.standard_error("precision"), 6).alias("se"), (F.min("precision") >= 0.05).alias("passed"))


@query(f"WITH {_J}, p AS (SELECT source, avg((grade >= 2)::INT) FILTER (rank <= 10) AS now, avg((grade >= 2)::INT) FILTER (rank <= 5) AS base FROM r GROUP BY 1) SELECT source, round(now - base, 6) AS delta FROM p")
def baseline_delta(read):
    """A metric of this run less that of the baseline (here precision at 10 and at 5)."""
    ranked = _both(read)[0]
    now, base = e.precision(ranked, "source", 10), e.precision(ranked, "source", 5).withColumnRenamed("precision", "base")
    return now.join(base, "source").select("source", F.round(F.col("precision") - F.col("base"), 6).alias("delta"))


@query("SELECT p_type, row_number() OVER (ORDER BY a DESC, b DESC, p_type) AS place FROM (SELECT p_type, round(avg(p_size), 6) AS a, round(avg(p_retailprice), 6) AS b FROM part GROUP BY 1)")
def sweep_rank(read):
    per = read("part").groupBy("p_type").agg(F.round(F.avg("p_size"), 6).alias("a"), F.round(F.avg("p_retailprice"), 6).alias("b"))
    return per.select("p_type", F.row_number().over(Window.orderBy(F.desc("a"), F.desc("b"), "p_type")).cast("long").alias("place"))  # a row per configuration
