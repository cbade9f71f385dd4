"""Ranked-list assembly over part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from .query import query

_TOP = "(SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT {n})"


def _top(read, n):
    by = (F.desc("p_retailprice"), F.asc("p_partkey"))
    return read("part").orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # n rows


@query(f"WITH t AS {_TOP.format(n=120)}, o AS (SELECT *, (row_number() OVER (PARTITION BY p_type ORDER BY rank) > 8)::INT AS over FROM t) SELECT p_partkey, p_type, place FROM (SELECT *, row_number() OVER (ORDER BY over, rank) AS place FROM o) WHERE place <= 60")
def brand_cap_window(read):
    return ranking.diversity_cap(_top(read, 120), "p_type", 60, 0.14).select("p_partkey", "p_type", F.col("place").cast("long").alias("place"))


@query(f"WITH t AS {_TOP.format(n=120)} SELECT p_partkey, row_number() OVER (ORDER BY seg, pos) AS place, seg AS segment FROM (SELECT p_partkey, CASE WHEN rank > 60 THEN 2 WHEN rank % 9 = 0 THEN 0 ELSE 1 END AS seg, CASE WHEN rank <= 60 AND rank % 9 = 0 THEN 100 - rank ELSE rank END AS pos FROM t)")
def head_tail_merge(read):
    top = _top(read, 120)
    window, tail = top.where("rank <= 60"), top.where("rank > 60")
    picks = window.where("rank % 9 = 0").select("p_partkey", (100 - F.col("rank")).alias("pick"))
    return ranking.head_tail(window, picks, tail, "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"), "segment")


@query(f"SELECT p_partkey, CASE WHEN rank <= 60 THEN 'window' ELSE 'tail' END AS part_of FROM {_TOP.format(n=120)}")
def window_tail_split(read):
    return _top(read, 120).select("p_partkey", F.when(F.col("rank") <= 60, "window").otherwise("tail").alias("part_of"))


@query(f"SELECT p_partkey, p_name || ' ' || p_brand AS name, lower(p_type) || ',' || p_size AS attributes, 'https://shop.example/p/' || p_partkey || '?utm_source=search' AS url FROM {_TOP.format(n=120)}")
def result_projection(read):
    url = F.concat(F.lit("https://shop.example/p/"), "p_partkey", F.lit("?utm_source=search"))
    return _top(read, 120).select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.concat_ws(",", F.lower("p_type"), "p_size").alias("attributes"), url.alias("url"))


@query("SELECT count(*) AS n, sum((p_type = 'PROMO')::INT)::BIGINT AS curated, CASE WHEN count(*) = 0 THEN 'no match' ELSE '' END AS reason FROM part WHERE p_size > 25")
def search_meta(read):
    n = F.count(F.lit(1))
    return read("part").where("p_size > 25").agg(n.alias("n"), F.count_if(F.col("p_type") == "PROMO").alias("curated"), F.when(n == 0, "no match").otherwise("").alias("reason"))


@query("WITH a AS (SELECT p_partkey AS first, p_brand AS brand FROM part ORDER BY p_partkey LIMIT 1) SELECT first, coalesce(min(p_partkey) FILTER (p_brand <> brand), min(p_partkey)) AS second FROM a JOIN part ON p_partkey > first GROUP BY 1")
def pick_pair(read):
    """The first item and the next one of another brand; the first two where all have one brand."""
    part = read("part").select("p_partkey", "p_brand")
    first = part.orderBy("p_partkey").limit(1).select(F.col("p_partkey").alias("first"), F.col("p_brand").alias("brand"))
    rest = part.join(F.broadcast(first), F.col("p_partkey") > F.col("first"))  # one row
    least = rest.groupBy("first").agg(F.min(F.when(F.col("p_brand") != F.col("brand"), F.col("p_partkey"))).alias("other"), F.min("p_partkey").alias("next"))
    return least.select("first", F.coalesce("other", "next").alias("second"))
