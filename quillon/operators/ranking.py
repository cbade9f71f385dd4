"""Operators on ranked lists. A list's order is its rank column (from 1), never the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diversity_cap(ranked: DataFrame, group: str, window: int, share: float = 0.4, by: list[str] | None = None) -> DataFrame:
    """The first `window` rows, at most max(1, floor(window x share)) of a group before any overflow; new column place.

    A list of `window` rows or fewer keeps its order."""
    by = by or []
    cap = max(1, int(window * share))
    rank_in = F.row_number().over(Window.partitionBy(*by, group).orderBy("rank"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by)) if by else None
    out = ranked.withColumn("_over", (rank_in > cap).cast("int"))
    if n is None:
        few = ranked.limit(window + 1).agg((F.count(F.lit(1)) <= window).alias("_few"))  # one row
        out = out.crossJoin(F.broadcast(few)).withColumn("_over", F.when(F.col("_few"), 0).otherwise(F.col("_over"))).drop("_few")
        head = out.orderBy("_over", "rank").limit(window)  # a top-k, not a global sort
        return head.withColumn("place", F.row_number().over(Window.orderBy("_over", "rank"))).drop("_over")
    out = out.withColumn("_over", F.when(n <= window, 0).otherwise(F.col("_over")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_over", "rank"))).where(F.col("place") <= window).drop("_over")


def rank_decay(rank: Column, n: Column, least: int = 10) -> Column:
    return F.greatest(F.lit(0.0), 1 - (rank - 1) / F.greatest(F.lit(least), n - 1))


def _scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((value - low) / (high - low))


def min_max(value: Column, window) -> Column:
    """Value scaled to [0, 1] in its window, which should be a list of bounded length; 0.5 where all are equal."""
    return _scaled(value, F.min(value).over(window), F.max(value).over(window))


def min_max_by(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add the value scaled to [0, 1] among all rows of its group, however many: ends are aggregated and joined. Rows with a null key are a group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).select(*(F.col(c).alias(f"_{c}") for c in by), "_low", "_high")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return df.join(ends, same).withColumn(out, _scaled(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high", *(f"_{c}" for c in by))


def type_gate(ranked: DataFrame, query: str, eligible: Column, floor: int = 5) -> DataFrame:
    """Keep eligible rows of a query where at least `floor` are; else all rows. Order is kept."""
    n = F.sum(F.coalesce(eligible, F.lit(True)).cast("int")).over(Window.partitionBy(query))
    return ranked.withColumn("_n", n).where((F.col("_n") < floor) | F.coalesce(eligible, F.lit(True))).drop("_n")


def mentions(text: Column, term: Column, forms: Mapping[str, Sequence[str]]) -> Column:
    """Whether a text holds a form of the term as whole words, in any case; a term without forms stands for itself, with spaces for hyphens."""
    table = F.create_map(*(x for k, v in forms.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if forms else F.lit(None).cast("map<string, array<string>>")
    own = F.coalesce(F.try_element_at(table, term), F.array(F.replace(term, F.lit("-"), F.lit(" "))))
    return F.coalesce(F.exists(own, lambda f: F.rlike(text, F.concat(F.lit(r"(?i)(^|\W)\Q"), f, F.lit(r"\E(\W|$)")))), F.lit(False))


def intent_gate(ranked: DataFrame, requests: DataFrame, query: str, forms: Mapping[str, Sequence[str]], floor: int = 5) -> DataFrame:
    """Keep of each request's list what its type intent allows; a filter that never reorders.

    requests: query, text, want_category, want_subcategory (both may be null); ranked has category and subcategory. Eligible: the wanted
    subcategory, the wanted category, or no type at all. A list stays whole where there is no intent, where the text names neither
    wanted type (the model inferred it), and where fewer than `floor` rows are eligible."""
    asked = requests.select(query, "text", "want_category", "want_subcategory")
    c, sub = F.col("category"), F.col("subcategory")
    grounded = mentions(F.col("text"), F.col("want_category"), forms) | mentions(F.col("text"), F.col("want_subcategory"), forms)
    exact, untyped = F.coalesce(sub == F.col("want_subcategory"), F.lit(False)), c.isNull() & sub.isNull()
    fits = exact | untyped | F.coalesce(c == F.col("want_category"), F.col("want_category").isNull())
    rows = ranked.join(asked, query, "left").withColumn("_fits", fits).withColumn("_n", F.count_if("_fits").over(Window.partitionBy(query)))  # lists are of bounded length
    return rows.where(F.col("_fits") | ~grounded | (F.col("_n") < floor)).select(ranked.columns)


def head_tail(window: DataFrame, picks: DataFrame | None, tail: DataFrame, key: str, limit: int = 120, default: int = 10) -> DataFrame:
    """Picks in their order, the rest of the window, then the tail; new column place. picks: key, pick (from 1); without picks the first `default` stay first."""
    if picks is None:
        picks = window.where(F.col("rank") <= default).select(key, F.col("rank").alias("pick"))
    merged = window.join(picks, key, "left").select(key, "rank", F.when(F.col("pick").isNotNull(), 0).otherwise(1).alias("segment"), F.coalesce("pick", "rank").alias("pos"))
    rows = merged.unionByName(tail.select(key, "rank", F.lit(2).alias("segment"), F.col("rank").alias("pos")))
    return rows.orderBy("segment", "pos").limit(limit).withColumn("place", F.row_number().over(Window.orderBy("segment", "pos"))).select(key, "place", "segment")


def page(ranked: DataFrame, number: int, size: int = 50) -> DataFrame:
    return ranked.where(F.col("rank").between((number - 1) * size + 1, number * size))


def page_numbers(current: int, count: int) -> list[int | None]:
    """All pages up to seven; else the first, the neighbours of the current one and the last, None for gaps."""
    if count <= 7:
        return list(range(1, count + 1))
    shown = sorted({1, count, *(p for p in (current - 1, current, current + 1) if 1 <= p <= count)})
    out: list[int | None] = []
    for p in shown:
        if out and p - out[-1] > 1:  # type: ignore[operator]
            out.append(None)
        out.append(p)
    return out
