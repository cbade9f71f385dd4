"""Exact top-k inner product by best-first search in M-trees.

A vector x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm; a query q becomes (q, 0). Then
|q - x|^2 = |q|^2 + M - 2 q.x, so the nearest neighbours are the largest products. Vectors are dealt to the nearest of a bounded
sample of pivots, and a cell of more than TREE vectors is cut into rings by their distance to its pivot; each ring is a tree. A
tree has pages of at most PAGE entries; an entry keeps its distance to the page's routing vector, a page its covering radius and
its distance to the parent. Each query first searches one ring of the cell whose pivot is nearest; its k-th score bounds the
search of every other tree, which stored distances (to the pivot's ring, to the tree's centre) may exclude. Of equal vectors only
the k + 1 smallest ids can be among a query's k answers, so only these are indexed.

Scores are integer products, ties go to smaller ids. Null vectors, vectors with null or non-finite components, and null ids
take no part; nor do vectors of other than the commonest length, and those so long that products may pass 64 bits (squared
length of 2^62 or more)."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

TREE, PAGE, PIVOTS, ASKS = 4096, 48, 512, 2048
SLACK = 1e-7  # of a distance, far above the rounding of doubles


def integer_vectors(df: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, only rows that take part."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).where(fine)
    fits = F.aggregate(column, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0))) < 2.0**62
    return rows.where(fits).select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _lift(v: np.ndarray, most: int) -> np.ndarray:
    return np.column_stack((v, np.sqrt(np.maximum(0, most - (v * v).sum(1))))).astype(float)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((x - y) ** 2).sum(-1)))


def build(ids: np.ndarray, v: np.ndarray, most: int) -> dict:
    """Pages of a tree. A leaf has ids, vectors and distances to its routing vector; an inner page has children, their radii
    and parent distances."""
    x, rng = _lift(v, most), np.random.default_rng(0)

    def page(rows: np.ndarray, parent: np.ndarray | None) -> dict:
        route = x[rows].mean(0)
        d = _distance(x[rows], route)
        out = {"route": route, "radius": float(d.max()), "parent": 0.0 if parent is None else float(_distance(route, parent))}
        if len(rows) <= PAGE or out["radius"] == 0:
            by = np.argsort(d, kind="stable")
            return out | {"ids": ids[rows[by]], "v": v[rows[by]], "d": d[by]}
        seeds = [int(d.argmax())]
        gap = _distance(x[rows], x[rows[seeds[0]]])
        for _ in range(min(7, -(-len(rows) // PAGE) - 1) or 1):  # far from each other
            seeds.append(int(gap.argmax()))
            gap = np.minimum(gap, _distance(x[rows], x[rows[seeds[-1]]]))
        near = np.argmin([_distance(x[rows], x[rows[s]]) for s in seeds], axis=0)
        groups = [rows[near == k] for k in range(len(seeds)) if (near == k).any()]
        if max(map(len, groups)) > 0.9 * len(rows):  # no use: cut at random
            groups = np.array_split(rng.permutation(rows), len(seeds))
        return out | {"children": [page(np.asarray(g), route) for g in groups if len(g)]}

    return page(np.arange(len(ids)), None)


def search(tree: dict, q: np.ndarray, own: int | None, k: int, most: int, floor: int | None = None) -> list[tuple[int, int]]:
    """The best (score, id) of a tree: k at most, none below `floor`. Best-first by the least distance a page can have."""
    point, norm = np.append(q, 0.0), int((q * q).sum())
    best: list[tuple[int, int]] = []  # a heap of (score, -id)

    def reach() -> float:
        s = best[0][0] if len(best) == k else floor
        if s is None:
            return float("inf")
        return np.sqrt(max(0, norm + most - 2 * s)) * (1 + SLACK) + SLACK

    first = float(_distance(point, tree["route"]))
    queue = [(max(0.0, first - tree["radius"]), 0, first, tree)]
    made = 1
    while queue and queue[0][0] <= reach():
        _, _, d, page = heapq.heappop(queue)
        if "children" in page:
            for c in page["children"]:
                if abs(d - c["parent"]) - c["radius"] > reach() + SLACK:  # by the stored distance alone
                    continue
                e = float(_distance(point, c["route"]))
                if e - c["radius"] <= reach() + SLACK:
                    heapq.heappush(queue, (max(0.0, e - c["radius"]), made, e, c))
                    made += 1
            continue
        there = slice(*np.searchsorted(page["d"], [d - reach() - SLACK, d + reach() + SLACK], "left")) if np.isfinite(reach()) else slice(None)
        for s, i in zip((page["v"][there] @ q).tolist(), page["ids"][there].tolist()):
            if i != own and (floor is None or s >= floor):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries (vec_id, v) against all rows of vectors but the query's own."""
    spark = vectors.sparkSession
    common = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return spark.createDataFrame([], schema)
    vectors, queries = (x.where(F.size("v") == common["n"]) for x in (vectors, queries))
    few = materialize(vectors.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    most = few.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0]
    total = few.count()
    wanted = max(1, min(PIVOTS, round(total / TREE)))
    pivots = np.array([r["v"] for r in few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()], np.int64)  # PIVOTS at most
    lifted = _lift(pivots, most)

    def near(v: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and distance of each vector, with or without its last lifted coordinate."""
        x = _lift(v, most) if last else np.column_stack((v, np.zeros(len(v)))).astype(float)
        pivot = np.argmin((lifted**2).sum(1) - 2 * x @ lifted.T, axis=1)
        return pivot.astype(np.int32), _distance(x, lifted[pivot])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pivot, gap = near(np.stack(pdf["v"]), True)
                yield pdf.assign(pivot=pivot, gap=gap)

    routed = materialize(few.mapInPandas(route, "vec_id long, v array<long>, pivot int, gap double"), "routed")
    sizes = routed.groupBy("pivot").count()  # a row for each pivot
    rings = max(1, -(-(sizes.agg(F.max("count")).first()[0] or 0) // TREE))
    shares = [k / rings for k in range(1, rings)] or [0.5]
    # a cell takes as many of the cuts as it has trees
    own = F.ceil(F.col("n") / F.lit(TREE))
    cuts = routed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gap", shares, 10_000).alias("cuts"))
    cuts = cuts.select("pivot", F.filter("cuts", lambda x, i: (F.lit(rings) > 1) & (F.floor((i + 1) * own / rings) > F.floor(i * own / rings))).alias("cuts"))
    ring = lambda rows: rows.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda x: x < F.col("gap")))).drop("cuts")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["vec_id"].to_numpy(), np.stack(pdf["v"]).astype(np.int64), most)
        return pd.DataFrame({"pivot": [pdf["pivot"].iloc[0]], "ring": [pdf["ring"].iloc[0]], "low": [pdf["gap"].min()], "high": [pdf["gap"].max()], "route": [tree["route"]], "radius": [tree["radius"]], "pages": [pickle.dumps(tree)]})

    trees = materialize(ring(routed).groupBy("pivot", "ring").applyInPandas(grow, "pivot int, ring int, low double, high double, route array<double>, radius double, pages binary"), "trees")

    def explore(pdf: pd.DataFrame, tree: dict) -> pd.DataFrame:
        rows = []
        for q, v, floor in zip(pdf["query_id"], pdf["v"], pdf["floor"]):
            rows += [(q, i, s) for s, i in search(tree, np.asarray(v, np.int64), q, k, most, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def visits(asks: DataFrame) -> DataFrame:
        """Search of the trees (pivot, ring) of asks. A tree's asks come in parts of about ASKS, so a tree that all want is no single task."""
        spread = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(F.col("asked") / F.lit(ASKS)))).alias("part")
        wanted = asks.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("asked"))
        dealt = asks.join(wanted, ["pivot", "ring"]).select(*asks.columns, spread)
        named = [F.col(c).alias(f"{c}_") for c in ("pivot", "ring", "part")]
        held = dealt.select("pivot", "ring", "part").distinct().join(trees.select("pivot", "ring", "pages"), ["pivot", "ring"]).select(*named, "pages")

        def visit(asked: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(grown):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return pd.concat([explore(asked, pickle.loads(p)) for p in grown["pages"]])

        return dealt.groupBy("pivot", "ring", "part").cogroup(held.groupBy("pivot_", "ring_", "part_")).applyInPandas(visit, "query_id long, vec_id long, score long")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pivot, gap = near(np.stack(pdf["v"]), False)
                yield pdf.assign(pivot=pivot, gap=gap)

    at = ring(queries.select(F.col("vec_id").alias("query_id"), "v").mapInPandas(home, "query_id long, v array<long>, pivot int, gap double"))
    asks = materialize(at.select("query_id", "v", "pivot", "ring"), "queries")
    first = materialize(visits(asks.withColumn("floor", F.lit(None).cast("long"))), "near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def reaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's pivots with its distance to them and how far a better vector may be: PIVOTS rows at most."""
        for pdf in batches:
            out = []
            for q, v, home_pivot, home_ring, floor in zip(pdf["query_id"], pdf["v"], pdf["pivot"], pdf["ring"], pdf["floor"]):
                x = np.append(np.asarray(v, float), 0.0)
                reach = np.inf if pd.isna(floor) else np.sqrt(max(0, float((x * x).sum()) + most - 2 * floor)) * (1 + SLACK) + SLACK
                out.append(pd.DataFrame({"query_id": q, "floor": floor, "reach": reach, "home_pivot": home_pivot, "home_ring": home_ring, "pivot": np.arange(len(lifted), dtype=np.int32), "gap": _distance(lifted, x)}))
            if out:
                yield pd.concat(out).astype({"floor": "Int64"})

    far = asks.join(floors, "query_id", "left").mapInPandas(reaching, "query_id long, floor long, reach double, home_pivot int, home_ring int, pivot int, gap double")
    met = far.join(trees.select("pivot", "ring", "low", "high", "route", "radius"), "pivot").where("(pivot <> home_pivot or ring <> home_ring) and gap - high <= reach and low - gap <= reach")
    centre = F.sqrt(F.aggregate(F.zip_with("route", F.concat("v", F.array(F.lit(0).cast("long"))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    more = met.join(asks.select("query_id", "v"), "query_id").where(centre - F.col("radius") <= F.col("reach")).select("query_id", "v", "pivot", "ring", "floor")
    found = first.unionByName(visits(more)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
