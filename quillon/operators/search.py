"""Ranked search over a stored index: several boosted fields, expansion terms of lower weight, filters inside retrieval.

Frequencies, lengths and document counts belong to the whole index; filters restrict what is ranked and never change scores. A
batch of requests is ranked at once. Its weighted terms are a small stored table, which Spark broadcasts if its files are small enough."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..functions.text import tokens
from ..sources.tables import stored
from .index import Index, tf_part
from .retrieval import EXPANSION, LIMIT, check_boost, clamp_limit

# Fixed values.
BOOSTS = {"title": 4.0, "attrs": 2.5, "material": 1.0, "body": 1.0}


def adds_something(text: Column, expanded: Column) -> Column:
    """Whether an expansion is neither blank nor the text itself in other case."""
    return F.coalesce((F.trim(expanded) != "") & (F.lower(F.trim(expanded)) != F.lower(F.trim(F.coalesce(text, F.lit(""))))), F.lit(False))


def request_terms(requests: DataFrame, key: str, analyzer: str = "none") -> DataFrame:
    """(key, term, w) of the columns text and expanded: occurrences, those of an expansion that adds something at EXPANSION."""
    groups = F.array(F.struct(tokens(F.col("text")).alias("ts"), F.lit(1.0).alias("w")), F.struct(F.when(adds_something(F.col("text"), F.col("expanded")), tokens(F.col("expanded"))).alias("ts"), F.lit(EXPANSION).alias("w")))
    words = requests.select(key, F.explode(groups).alias("g")).select(key, F.explode("g.ts").alias("term"), "g.w")
    return (stemmed(words) if analyzer == "english" else words).groupBy(key, "term").agg(F.sum("w").alias("w"))


def weighted(index: Index, terms: DataFrame, query: str, boosts: Mapping[str, float]) -> DataFrame:
    """(query, field, term, df, weight, most): what an occurrence is worth and at most adds, stored."""
    boost = F.coalesce(*(F.when(F.col("field") == n, F.lit(check_boost(b))) for n, b in boosts.items()))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = index.terms.where(F.col("field").isin(*boosts)).join(F.broadcast(index.fields), "field")  # a row for each field
    each = known.join(terms, "term").withColumn("weight", F.col("w") * idf * boost)
    return stored(each.select(query, "field", "term", "df", "avgdl", "weight", (F.col("weight") * F.col("top")).alias("most")), "terms")


def _part() -> Column:
    return F.col("weight") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))


def parts(index: Index, terms: DataFrame, query: str) -> DataFrame:
    """(query, key, field, part) of weighted() terms. Buckets hold whole documents: nothing is exchanged but small sides."""
    post = index.postings.select(index.key, "field", "term", "tf", "dl")
    return post.join(terms.drop("df", "most"), ["field", "term"]).groupBy(query, index.key, "field").agg(F.sum(_part()).alias("part"))


def matches(requests: DataFrame) -> Column:
    """The filters of a request against the stored columns brand, price_cents and active; null filters let all through."""
    brand, price = F.col("brand"), F.col("price_cents")
    checks = {
        "brands": F.col("brands").isNull() | (F.size("brands") == 0) | F.array_contains("brands", brand),
        "exclude_brands": F.col("exclude_brands").isNull() | ~F.coalesce(F.array_contains("exclude_brands", brand), F.lit(False)),
        "price_min": F.col("price_min").isNull() | (price >= F.col("price_min")), "price_max": F.col("price_max").isNull() | (price <= F.col("price_max")),
    }
    out = F.coalesce(F.col("active"), F.lit(False))
    for name, check in checks.items():
        if name in requests.columns:
            out = out & F.coalesce(check, F.lit(False))
    return out


def search(index: Index, requests: DataFrame, query: str, boosts: Mapping[str, float] = BOOSTS, k: int | None = LIMIT, floor: float | None = None, analyzer: str = "none", prune: bool = True, digits: int = 6) -> DataFrame:
    """(query, key, score, rank) of the best k documents of each request, ties to the smaller key, scores below floor dropped.

    Scores are rounded to `digits` before they are ranked: sums in another order then give the same ranks.
    Requests: query, text, expanded and any of brands, exclude_brands, price_min, price_max. A document needs one term at least.
    With prune, documents that cannot reach the k best are not scored: partial scores of a request's strongest terms give a
    score that k documents reach; terms that together stay below it, by their upper bounds, cannot bring in a document alone."""
    k, key = clamp_limit(k), index.key
    filters = [c for c in ("brands", "exclude_brands", "price_min", "price_max") if c in requests.columns]
    terms = weighted(index, request_terms(requests, query, analyzer), query, boosts)
    asked = stored(requests.select(query, *filters), "requests")
    live = index.rows.where("active")
    post = index.postings.select(key, "field", "term", "tf", "dl")

    def ranked(of: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
        return of.withColumn("score", F.round("score", digits)).withColumn("rank", rank).where(F.col("rank") <= k)

    def allowed(of: DataFrame) -> DataFrame:
        if not filters:
            return of.join(live.select(key).hint("shuffle_hash"), key, "left_semi")
        return of.join(live.hint("shuffle_hash"), key).join(asked, query).where(matches(requests)).select(of.columns)

    def scored(of: DataFrame) -> DataFrame:
        return of.groupBy(query, key).agg(F.sum(_part()).alias("score"))

    def found(some: DataFrame) -> DataFrame:
        return ranked(allowed(scored(post.join(some.drop("df", "most"), ["field", "term"]))))

    best = ranked(scored(candidate_postings(index, terms, query, found, allowed, k))) if prune else found(terms)
    return best if floor is None else best.where(F.col("score") >= floor)


def candidate_postings(index: Index, terms: DataFrame, query: str, best: Callable, allowed: Callable, k: int) -> DataFrame:
    """Postings with weights of the pairs (query, document) that can be among the k best."""
    key = index.key
    strongest = Window.partitionBy(query).orderBy(F.desc("most"), "field", "term")
    first = terms.withColumn("seen", F.sum("df").over(strongest) - F.col("df")).where(F.col("seen") < 4 * k).drop("seen")
    reached = best(first).where(F.col("rank") == k).select(query, F.col("score").alias("reached"))  # none where fewer than k documents hold these terms
    weakest = Window.partitionBy(query).orderBy(F.asc("most"), "field", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounds = terms.withColumn("sum", F.sum("most").over(weakest)).join(stored(reached, "reached"), query, "left")
    needed = stored(bounds.where(F.col("reached").isNull() | (F.col("sum") * (1 + 1e-9) + 1e-3 >= F.col("reached"))).select(query, "field", "term"), "needed")
    post = index.postings.select(key, "field", "term", "tf", "dl")
    pairs = allowed(post.select(key, "field", "term").join(needed, ["field", "term"]).select(query, key).distinct())
    near = stored(pairs.repartition(post.rdd.getNumPartitions(), key), "pairs")
    return near.join(post, key).join(terms.drop("df", "most"), [query, "field", "term"])


def sweep(parts_: DataFrame, query: str, key: str, grid: Mapping[str, list[float]], k: int) -> DataFrame:
    """(vector, query, key, score, rank): the k best of each request under every combination of boosts, by one pass over the per-field parts.

    A document that under the largest boosts stays below what k documents have under the smallest is in no list, and goes first."""
    names = list(grid)
    wide = parts_.groupBy(query, key).agg(*(F.coalesce(F.sum(F.when(F.col("field") == n, F.col("part"))), F.lit(0.0)).alias(n) for n in names))
    total = lambda pick: sum((F.col(n) * float(pick(grid[n])) for n in names), F.lit(0.0))
    order = Window.partitionBy(query).orderBy(F.desc("low"))
    low = wide.withColumn("low", total(min))
    kth = low.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).groupBy(query).agg(F.min("low").alias("least"), F.max("at").alias("at"))
    near = low.join(kth, query).where((F.col("at") < k) | (total(max) * (1 + 1e-9) >= F.col("least")))
    vectors = F.array(*(F.struct(*(F.lit(float(b)).alias(n) for n, b in zip(names, v))) for v in product(*grid.values())))
    each = near.select(query, key, *names, F.explode(vectors).alias("vector"))
    score = sum((F.col(n) * F.col(f"vector.{n}") for n in names), F.lit(0.0))
    scored = each.select("vector", query, key, F.round(score, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("vector", query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
