"""Preference learning and blending. Unknown is neutral: 0.5, never 0."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of the components, of the blend, the step and the stable count.
WEIGHTS = {"brand": 0.30, "fiber": 0.20, "material": 0.15, "styling": 0.10, "aesthetic": 0.10, "silhouette": 0.10, "price": 0.05}
BLEND, K, STABLE = 0.35, 0.1, 20


def elo_step(score: Column, won: Column, k: float) -> Column:
    """w + k(1 - w) for a win, l - k l for a loss, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(won, score + F.lit(k) * (1 - score)).otherwise(score - F.lit(k) * score)))


def time_slices(log: DataFrame, column: str, slices: int) -> Column:
    """The number of the slice, from 0, of the column's equal shares of the rows; equal values lie in one slice, null in the first."""
    kind = dict(log.dtypes)[column]
    at = F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(column)
    if kind == "string":
        return F.lit(0)
    cuts = log.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1000)).first()[0]  # `slices` numbers at most
    cuts = sorted(set(cuts or []))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0), F.lit(0))


def elo_scores(log: DataFrame, by: list[str], order: list[str], won: str, ks: list[float], start: float = 0.5, slices: int = 32) -> DataFrame:
    """(by, scores, n): the ordered fold of each key's wins and losses, for every step size of ks in one pass.

    A step is s -> (1 - k) * s + k * won, so a run of n rows is s -> (1 - k)^n * s + the sum of k * (1 - k)^(rows behind) of its wins:
    sums that Spark combines. Each key's log is cut into slices of time, so a long one is spread; a key's slices are then folded in order.
    Null wins count as losses. With ks and start in [0, 1] no step leaves that range."""
    if not all(0 <= k <= 1 for k in [*ks, start]):
        raise ValueError("ks and start must lie in [0, 1]")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = log.select(*(F.col(c).alias(n) for c, n in zip(by, keys)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.coalesce(F.col(won), F.lit(False)).alias("_won"), time_slices(log, order[0], slices).alias("_slice"))
    last = Window.partitionBy(*keys, "_slice").orderBy(*(F.desc(f"_o{i}") for i in range(len(order))), F.desc("_won"))
    behind = rows.withColumn("_behind", F.row_number().over(last) - 1)
    gains = [F.sum(F.when(F.col("_won"), F.lit(float(k)) * F.pow(F.lit(1.0 - k), "_behind")).otherwise(0.0)) for k in ks]
    runs = behind.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("n"), F.array(*gains).alias("gains"))
    per = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "n", "gains"))).alias("runs"), F.sum("n").cast("int").alias("n"))  # at most `slices` each
    scores = [_folded(i, k, start) for i, k in enumerate(ks)]
    return per.select(*(F.col(n).alias(c) for c, n in zip(by, keys)), F.array(*scores).alias("scores"), "n")


def _folded(i: int, k: float, start: float) -> Column:
    return F.aggregate("runs", F.lit(float(start)), lambda s, r: s * F.pow(F.lit(1.0 - k), r["n"]) + r["gains"][i])


def elo_replay(log: DataFrame, by: list[str], order: list[str], won: str, k: float = K, start: float = 0.5) -> DataFrame:
    """(by, score, n) at one step size."""
    return elo_scores(log, by, order, won, [k], start).select(*by, F.col("scores")[0].alias("score"), "n")


def elo_dimensions(log: DataFrame, by: list[str], order: list[str], sides: Mapping[str, tuple[str, str]], ks: list[float], start: float = 0.5) -> DataFrame:
    """(by, dimension, key, scores, n) of a log of comparisons; sides: the winner's and the loser's column of each dimension.

    Sides with equal keys say nothing in their dimension; where one side has no key (null or empty), the other moves alone. All dimensions and sides are replayed in one shuffle."""
    each = []
    for name, (winner, loser) in sides.items():
        for own, other, won in ((winner, loser, True), (loser, winner, False)):
            here, there = F.nullif(F.col(own).cast("string"), F.lit("")), F.nullif(F.col(other).cast("string"), F.lit(""))
            each.append(F.when(here.isNotNull() & ~here.eqNullSafe(there), F.struct(F.lit(name).alias("dimension"), here.alias("key"), F.lit(won).alias("won"))))
    rows = log.select(*by, *order, F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())).alias("_s")).select(*by, *order, "_s.*")
    return elo_scores(rows, [*by, "dimension", "key"], order, "won", ks, start)


def comparisons_to_sides(log: DataFrame, winner: str, loser: str) -> DataFrame:
    """Both sides of each comparison as rows (key, won); equal keys say nothing and vanish, a missing side leaves the other."""
    informative = log.where(F.coalesce(F.col(winner) != F.col(loser), F.lit(True)))
    sides = F.explode(F.array(F.struct(F.col(winner).alias("key"), F.lit(True).alias("won")), F.struct(F.col(loser).alias("key"), F.lit(False).alias("won"))))
    return informative.withColumn("_s", sides).select(*log.columns, "_s.key", "_s.won").where("key is not null")


def seeded(answers: DataFrame, who: str, weights: DataFrame) -> DataFrame:
    """(who, target, seeds): for each target a map of keys to weights, from answers (who, question, answer) and the weight table
    (question, answer, target, key, weight; a fixed table). A key that several answers give takes the largest weight; unknown answers say nothing."""
    best = answers.join(F.broadcast(weights), ["question", "answer"]).groupBy(who, "target", "key").agg(F.max("weight").alias("weight"))
    return best.groupBy(who, "target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "weight")))).alias("seeds"))  # of a fixed table's keys


def brand_score(brand: Column, scores: Column) -> Column:
    known = F.map_values(scores)
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.coalesce(F.try_element_at(scores, brand), F.when(F.size(known) > 0, F.greatest(F.lit(0.0), mean - 0.1)), F.lit(0.5))


def known_score(value: Column, scores: Column) -> Column:
    """The learned score of a value; unknown is neutral."""
    return F.coalesce(F.try_element_at(scores, value), F.lit(0.5))


def rule_hits(items: DataFrame, key: list[str], rules: DataFrame) -> DataFrame:
    """key, rule, h, m: how many attributes of an item hold a preferred and how many an avoided value; an attribute with several such values counts once.

    items: key, attr, value; rules: rule, attr, prefers, avoids and, if rules have conditions, when (map of the context's attributes to values; null: always) (a fixed table)."""
    met = items.join(F.broadcast(rules), "attr")
    hit, miss = (F.coalesce(F.array_contains(side, F.col("value")), F.lit(False)) for side in ("prefers", "avoids"))
    per = met.groupBy(*key, "rule", "attr").agg(F.max(hit.cast("int")).alias("h"), F.max(miss.cast("int")).alias("m"))
    return per.groupBy(*key, "rule").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))


def applicable(context: Column, when: Column) -> Column:
    """Whether a context (map) has all values of a condition (map); no condition always holds."""
    return F.coalesce(F.forall(F.map_entries(when), lambda e: F.coalesce(F.try_element_at(context, e["key"]) == e["value"], F.lit(False))), F.lit(True))


def _ratio() -> Column:
    return (F.col("h") - F.col("m")) / F.greatest(F.lit(1), F.col("h") + F.col("m"))


def best_reason(items: DataFrame, key: list[str], rules: DataFrame, least: int = 1) -> DataFrame:
    """key, reason of the rule with the best positive (hits - misses) / max(1, hits + misses) and at least `least` hits; the first such rule, null without one.

    rules: as for rule_hits(), with place and reason."""
    of = rules.withColumn("rule", F.col("place"))
    per = rule_hits(items, key, of).where((F.col("h") > F.col("m")) & (F.col("h") >= least))
    best = per.join(F.broadcast(of.groupBy("rule").agg(F.first("reason").alias("reason"))), "rule").groupBy(*key).agg(F.max_by("reason", F.struct(_ratio().alias("ratio"), F.negative("rule"))).alias("reason"))
    return items.select(*key).distinct().join(best, key, "left").select(*key, "reason")


def closeness(ratio: Column, preferred: Column) -> Column:
    return F.coalesce(1 - F.abs(ratio - preferred), F.lit(0.5))


def price_fit(cents: Column, low: Column, high: Column) -> Column:
    below = F.greatest(F.lit(0.4), 1 - (low - cents) / F.greatest(low, F.lit(1)))
    above = F.greatest(F.lit(0.0), 1 - (cents - high) / F.greatest(high, F.lit(1)))
    return F.when(cents.isNull() | (low.isNull() & high.isNull()), 0.5).when(cents < low, below).when(cents > high, above).otherwise(1.0)


def weighted(components: Mapping[str, Column]) -> Column:
    """Weighted sum; components that are not given are neutral."""
    return sum((F.lit(w) * components.get(n, F.lit(0.5)) for n, w in WEIGHTS.items()), F.lit(0.0))


def blend(rank_norm: Column, affinity_norm: Column) -> Column:
    return (1 - BLEND) * rank_norm + BLEND * affinity_norm


def rule_scores(items: DataFrame, key: list[str], rules: DataFrame) -> DataFrame:
    """key, score: the mean of (hits - misses) / max(1, hits + misses) over rules with a hit or a miss, mapped to [0, 1]; 0.5 without any."""
    mean = rule_hits(items, key, rules).where("h + m > 0").groupBy(*key).agg(F.avg(_ratio()).alias("mean"))
    return items.select(*key).distinct().join(mean, key, "left").select(*key, F.coalesce((F.col("mean") + 1) / 2, F.lit(0.5)).alias("score"))


def conditional_scores(items: DataFrame, key: list[str], contexts: DataFrame, who: list[str], rules: DataFrame) -> DataFrame:
    """who, key, score: rule_scores() of every item for every context over the rules whose conditions the context meets.

    contexts: who, context (map). Contexts that meet the same rules share one scoring, so items are joined with sets of rules, of which a fixed table of rules has few."""
    table = rules.groupBy("rule").agg(F.first("when").alias("when"))
    met = contexts.join(F.broadcast(table)).where(applicable(F.col("context"), F.col("when"))).groupBy(*who).agg(F.array_sort(F.collect_set("rule")).alias("met"))
    sets = contexts.select(*who).join(met, who, "left").withColumn("met", F.coalesce("met", F.array().cast(met.schema["met"].dataType)))
    per = rule_hits(items, key, rules.drop("when")).where("h + m > 0").select(*key, "rule", _ratio().alias("ratio"))
    kinds = sets.select("met").distinct()
    means = per.join(F.broadcast(kinds), F.array_contains("met", F.col("rule"))).groupBy(*key, "met").agg(F.avg("ratio").alias("mean"))
    every = items.select(*key).distinct().join(F.broadcast(kinds)).join(means, [*key, "met"], "left")
    return sets.join(every, "met").select(*who, *key, F.coalesce((F.col("mean") + 1) / 2, F.lit(0.5)).alias("score"))


def guidance(rules: Column, prefer: int = 5, avoid: int = 4) -> Column:
    """A line for each rule (reason, prefers, avoids) of a list: the reason, then 'prefer: ...' and 'avoid: ...' with the first values of each, where it has any."""

    def side(word: str, values: Column, most: int) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{word}: "), F.array_join(F.slice(values, 1, most), ", ")))

    return F.transform(rules, lambda r: F.concat_ws(" — ", r["reason"], side("prefer", r["prefers"], prefer), side("avoid", r["avoids"], avoid)))
