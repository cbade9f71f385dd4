"""Preference queries: events as comparison log, part and customer as catalog and shoppers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import preferences as p, ranking
from .query import query

_FOLD = "list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY ts, event_id)), lambda s, e: CASE WHEN e > 0 THEN s + {k}::DOUBLE * (1 - s) ELSE s - {k}::DOUBLE * s END)"
_LOG = "FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id"


def _log(read):
    return read("events").where(F.col("event_type").isin("purchase", "error")).withColumn("won", F.col("event_type") == "purchase")


@query(f"SELECT user_id, round({_FOLD.format(k='0.1')}, 9) AS score, count(*)::INTEGER AS n {_LOG}")
def elo_replay(read):
    return p.elo_replay(_log(read), ["user_id"], ["ts", "event_id"], "won").select("user_id", F.round("score", 9).alias("score"), "n")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k}::DOUBLE AS k, user_id, round({_FOLD.format(k=k)}, 9) AS score {_LOG}" for k in ("0.05", "0.1", "0.2")) + ")")
def elo_k_sweep(read):
    ks = [0.05, 0.1, 0.2]
    each = p.elo_scores(_log(read), ["user_id"], ["ts", "event_id"], "won", ks).select("user_id", F.posexplode("scores").alias("i", "score"))
    return each.select(F.array(*map(F.lit, ks))[F.col("i")].alias("k"), "user_id", F.round("score", 9).alias("score"))


_SIDES = {"brand": ("w_brand", "l_brand"), "type": ("w_type", "l_type"), "size": ("w_size", "l_size")}


@query(f"""WITH p AS (SELECT p_partkey, p_brand AS brand, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS type, (p_size // 10)::VARCHAR AS size FROM part),
l AS (SELECT l_orderkey, l_linenumber, p.* FROM lineitem JOIN p ON p_partkey = l_partkey WHERE l_linenumber <= 2),
c AS (SELECT o_custkey AS who, a.l_orderkey AS o, a.brand AS w_brand, b.brand AS l_brand, a.type AS w_type, b.type AS l_type, a.size AS w_size, b.size AS l_size
      FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 JOIN orders ON o_orderkey = a.l_orderkey),
s AS ({" UNION ALL ".join(f"SELECT who, o, '{d}' AS dimension, {own} AS key, {won}::DOUBLE AS won FROM c WHERE {own} IS NOT NULL AND {own} IS DISTINCT FROM {other}" for d, (w, x) in _SIDES.items() for own, other, won in ((w, x, "1.0"), (x, w, "0.0")))}),
f AS (SELECT who, dimension, key, count(*)::INTEGER AS n, list(won ORDER BY o, won) AS ws FROM s GROUP BY 1, 2, 3)
SELECT who, dimension, key, n, round(list_reduce(list_prepend(0.5::DOUBLE, ws), lambda s, w: s + 0.1::DOUBLE * (w - s)), 9) AS score FROM f""")
def elo_dimensions(read):
    """The first line of an order beats the second: brand, type (economy is unknown) and size of the parts."""
    parts = read("part").select("p_partkey", F.col("p_brand").alias("brand"), F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("type"), F.call_function("div", F.col("p_size"), F.lit(10)).cast("string").alias("size"))
    lines = read("lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    side = lambda k, name: lines.where(F.col("l_linenumber") == k).select("l_orderkey", *(F.col(c).alias(f"{name}_{c}") for c in ("brand", "type", "size")))
    log = side(1, "w").join(side(2, "l"), "l_orderkey").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("who")), "l_orderkey")
    found = p.elo_dimensions(log, ["who"], ["l_orderkey"], _SIDES, [p.K])
    return found.select("who", "dimension", "key", "n", F.round(F.col("scores")[0], 9).alias("score"))


@query(f"SELECT user_id, count(*) >= 20 AS stable {_LOG}")
def stable_users(read):
    return _log(read).groupBy("user_id").agg((F.count(F.lit(1)) >= p.STABLE).alias("stable"))


@query("SELECT DISTINCT p_brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS prior FROM part")
def brand_priors(read):
    return read("part").select("p_brand", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 0.7).otherwise(0.5).alias("prior")).distinct()


@query("SELECT p_partkey, round(CASE WHEN p_retailprice < 920 THEN greatest(0.4, 1 - (920 - p_retailprice) / 920) WHEN p_retailprice > 960 THEN greatest(0.0, 1 - (p_retailprice - 960) / 960) ELSE 1.0 END, 6) AS fit FROM part")
def price_fit(read):
    return read("part").select("p_partkey", F.round(p.price_fit(F.col("p_retailprice"), F.lit(920.0), F.lit(960.0)), 6).alias("fit"))


_AFF = "0.30::DOUBLE * CASE p_brand WHEN 'Brand#1' THEN 0.9::DOUBLE WHEN 'Brand#2' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END + 0.20::DOUBLE * (1 - abs(p_size / 50.0::DOUBLE - 0.4::DOUBLE)) + 0.05::DOUBLE * CASE WHEN p_retailprice > 960 THEN greatest(0.0::DOUBLE, 1 - (p_retailprice - 960) / 960) WHEN p_retailprice < 920 THEN greatest(0.4::DOUBLE, 1 - (920 - p_retailprice) / 920) ELSE 1.0::DOUBLE END + 0.45::DOUBLE * 0.5::DOUBLE"


def _affinity(read):
    scores = F.create_map(F.lit("Brand#1"), F.lit(0.9), F.lit("Brand#2"), F.lit(0.3))
    parts = {"brand": p.brand_score(F.col("p_brand"), scores), "fiber": p.closeness(F.col("p_size") / 50.0, F.lit(0.4)), "price": p.price_fit(F.col("p_retailprice"), F.lit(920.0), F.lit(960.0))}
    return p.weighted(parts)


@query(f"SELECT p_partkey, round({_AFF}, 10) AS affinity FROM part")
def affinity_score(read):
    return read("part").select("p_partkey", F.round(_affinity(read), 10).alias("affinity"))


@query(f"WITH a AS (SELECT *, {_AFF} AS aff, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT *, count(*) OVER w AS n, min(aff) OVER w AS lo, max(aff) OVER w AS hi FROM a WHERE r <= 120 WINDOW w AS (PARTITION BY p_type)), c AS (SELECT p_type, p_partkey, r, round(0.65::DOUBLE * greatest(0.0::DOUBLE, 1 - (r - 1) / greatest(10, n - 1)::DOUBLE) + 0.35::DOUBLE * CASE WHEN hi - lo < 1e-9 THEN 0.5::DOUBLE ELSE (aff - lo) / (hi - lo) END, 6) AS final FROM b) SELECT p_type, p_partkey, final, row_number() OVER (PARTITION BY p_type ORDER BY final DESC, r) AS place FROM c")
def affinity_blend(read):
    """Lists of 120 at most, reordered by rank and affinity; equal blends keep their order."""
    w = Window.partitionBy("p_type")
    top = read("part").withColumn("aff", _affinity(read)).withColumn("r", F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey"))).where("r <= 120")
    listed = top.withColumn("n", F.count(F.lit(1)).over(w))
    final = listed.select("p_type", "p_partkey", "r", F.round(p.blend(ranking.rank_decay(F.col("r"), F.col("n")), ranking.min_max(F.col("aff"), w)), 6).alias("final"))
    return final.select("p_type", "p_partkey", "final", F.row_number().over(w.orderBy(F.desc("final"), "r")).cast("long").alias("place"))


_RULES = [("calm", "type", ["SMALL", "MEDIUM"], ["PROMO"]), ("calm", "tone", ["blue", "cold"], ["red", "hot"]), ("bold", "tone", ["red", "hot"], ["old"]), ("bold", "type", ["PROMO", "LARGE"], [])]


@query("""WITH i AS (SELECT p_partkey, 'type' AS attr, p_type AS value FROM part UNION ALL SELECT p_partkey, 'tone', string_split(p_name, ' ')[1] FROM part),
r AS (SELECT * FROM (VALUES ('calm', 'type', ['SMALL', 'MEDIUM'], ['PROMO']), ('calm', 'tone', ['blue', 'cold'], ['red', 'hot']), ('bold', 'tone', ['red', 'hot'], ['old']), ('bold', 'type', ['PROMO', 'LARGE'], []::VARCHAR[])) t(rule, attr, p, a)),
s AS (SELECT p_partkey, rule, sum(list_contains(p, value)::INT) AS h, sum(list_contains(a, value)::INT) AS m FROM i JOIN r USING (attr) GROUP BY 1, 2),
g AS (SELECT p_partkey, avg((h - m) / (h + m)::DOUBLE) AS mean FROM s WHERE h + m > 0 GROUP BY 1)
SELECT p_partkey, round(coalesce((mean + 1) / 2, 0.5), 6) AS score FROM part LEFT JOIN g USING (p_partkey)""")
def rule_scores(read):
    part = read("part")
    rules = part.sparkSession.createDataFrame(_RULES, "rule string, attr string, prefers array<string>, avoids array<string>")
    attrs = F.explode(F.array(F.struct(F.lit("type").alias("attr"), F.col("p_type").alias("value")), F.struct(F.lit("tone").alias("attr"), F.split("p_name", " ")[0].alias("value")))).alias("x")
    return p.rule_scores(part.select("p_partkey", attrs).select("p_partkey", "x.*"), ["p_partkey"], rules).select("p_partkey", F.round("score", 6).alias("score"))


_ITEMS = "i AS (SELECT p_partkey, 'type' AS attr, p_type AS value FROM part UNION ALL SELECT p_partkey, 'tone', string_split(p_name, ' ')[1] FROM part)"
_TABLE = "r AS (SELECT *, CASE rule WHEN 'calm' THEN 1 ELSE 2 END AS place FROM (VALUES ('calm', 'type', ['SMALL', 'MEDIUM'], ['PROMO']), ('calm', 'tone', ['blue', 'cold'], ['red', 'hot']), ('bold', 'tone', ['red', 'hot'], ['old']), ('bold', 'type', ['PROMO', 'LARGE'], []::VARCHAR[])) t(rule, attr, p, a))"


def _items(read):
    attrs = F.explode(F.array(F.struct(F.lit("type").alias("attr"), F.col("p_type").alias("value")), F.struct(F.lit("tone").alias("attr"), F.split("p_name", " ")[0].alias("value")))).alias("x")
    return read("part").select("p_partkey", attrs).select("p_partkey", "x.*")


@query(f"""WITH {_ITEMS}, {_TABLE}, s AS (SELECT p_partkey, rule, place, sum(list_contains(p, value)::INT) AS h, sum(list_contains(a, value)::INT) AS m FROM i JOIN r USING (attr) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY (h - m) / greatest(1, h + m)::DOUBLE DESC, place) AS n FROM s WHERE h > m)
SELECT p_partkey, b.rule || ' style' AS reason FROM part LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (p_partkey)""")
def best_reason(read):
    """The reason of each part's best positive rule; the first of equals."""
    items = _items(read)
    rules = items.sparkSession.createDataFrame([({"calm": 1, "bold": 2}[n], a, p_, m, f"{n} style") for n, a, p_, m in _RULES], "place int, attr string, prefers array<string>, avoids array<string>, reason string")
    return p.best_reason(items, ["p_partkey"], rules)


@query(f"WITH {_ITEMS}, {_TABLE} SELECT p_partkey, rule, list_contains(p, value) AS hit, list_contains(a, value) AS miss FROM i JOIN r USING (attr)")
def rule_hits(read):
    """Whether each value is among those that a rule prefers or avoids; an empty list or a null value is no hit."""
    items = _items(read)
    rules = F.broadcast(items.sparkSession.createDataFrame(_RULES, "rule string, attr string, prefers array<string>, avoids array<string>"))
    has = lambda c: F.coalesce(F.arrays_overlap(c, F.array("value")), F.lit(False))
    return items.join(rules, "attr").select("p_partkey", "rule", has("prefers").alias("hit"), has("avoids").alias("miss"))


_WHEN = [("calm", "type", ["SMALL", "MEDIUM"], ["PROMO"], {"segment": "BUILDING"}), ("calm", "tone", ["blue", "cold"], ["red", "hot"], {"segment": "BUILDING"}), ("bold", "tone", ["red", "hot"], ["old"], {}), ("rich", "type", ["PROMO", "LARGE"], ["SMALL"], {"segment": "AUTOMOBILE", "rich": "yes"})]
_WHEN_SQL = f"""{_ITEMS},
r AS (SELECT * FROM (VALUES ('calm', 'type', ['SMALL', 'MEDIUM'], ['PROMO'], 'BUILDING', NULL), ('calm', 'tone', ['blue', 'cold'], ['red', 'hot'], 'BUILDING', NULL),
  ('bold', 'tone', ['red', 'hot'], ['old'], NULL, NULL), ('rich', 'type', ['PROMO', 'LARGE'], ['SMALL'], 'AUTOMOBILE', 'yes')) t(rule, attr, p, a, ws, wr)),
c AS (SELECT DISTINCT c_mktsegment AS segment, CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich FROM customer)"""


def _conditions(read):
    spark = read("part").sparkSession
    rules = spark.createDataFrame(_WHEN, "rule string, attr string, prefers array<string>, avoids array<string>, when map<string, string>")
    contexts = read("customer").select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no").alias("rich")).distinct()
    return rules, contexts.withColumn("context", F.create_map(F.lit("segment"), "segment", F.lit("rich"), "rich"))


@query(f"""WITH {_WHEN_SQL},
s AS (SELECT segment, rich, p_partkey, rule, sum(list_contains(p, value)::INT) AS h, sum(list_contains(a, value)::INT) AS m FROM c JOIN r ON (ws IS NULL OR ws = segment) AND (wr IS NULL OR wr = rich) JOIN i USING (attr) GROUP BY ALL),
g AS (SELECT segment, rich, p_partkey, avg((h - m) / (h + m)::DOUBLE) AS mean FROM s WHERE h + m > 0 GROUP BY ALL)
SELECT segment, rich, p_partkey, round(coalesce((mean + 1) / 2, 0.5), 6) AS score FROM c CROSS JOIN (SELECT p_partkey FROM part) LEFT JOIN g USING (segment, rich, p_partkey)""")
def conditional_rules(read):
    """Every part for every kind of customer, by the rules whose conditions that kind meets."""
    rules, contexts = _conditions(read)
    return p.conditional_scores(_items(read), ["p_partkey"], contexts, ["segment", "rich"], rules).select("segment", "rich", "p_partkey", F.round("score", 6).alias("score"))


@query(f"""WITH {_WHEN_SQL},
f AS (SELECT segment, rich, rule, flatten(list(p ORDER BY attr))[1:5] AS p, flatten(list(a ORDER BY attr))[1:4] AS a FROM c JOIN r ON (ws IS NULL OR ws = segment) AND (wr IS NULL OR wr = rich) GROUP BY 1, 2, 3)
SELECT segment, rich, string_agg(rule || ' style' || CASE WHEN len(p) > 0 THEN ' — prefer: ' || array_to_string(p, ', ') ELSE '' END || CASE WHEN len(a) > 0 THEN ' — avoid: ' || array_to_string(a, ', ') ELSE '' END, chr(10) ORDER BY rule) AS guidance FROM f GROUP BY 1, 2""")
def guidance_lines(read):
    """What the rules say to each kind of customer."""
    rules, contexts = _conditions(read)
    met = contexts.join(F.broadcast(rules), p.applicable(F.col("context"), F.col("when")))
    side = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("attr", c))), lambda x: x[c]))
    each = met.groupBy("segment", "rich", "rule").agg(side("prefers").alias("prefers"), side("avoids").alias("avoids")).withColumn("reason", F.concat("rule", F.lit(" style")))
    lists = each.groupBy("segment", "rich").agg(F.array_sort(F.collect_list(F.struct("reason", "prefers", "avoids"))).alias("rules"))  # of a fixed table
    return lists.select("segment", "rich", F.array_join(p.guidance(F.col("rules")), "\n").alias("guidance"))


@query("SELECT p_partkey, CASE string_split(p_name, ' ')[1] WHEN 'red' THEN 0.8::DOUBLE WHEN 'blue' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS score FROM part")
def known_score(read):
    scores = F.create_map(F.lit("red"), F.lit(0.8), F.lit("blue"), F.lit(0.2))
    return read("part").select("p_partkey", p.known_score(F.split("p_name", " ")[0], scores).alias("score"))


@query("SELECT w, max(v) AS weight FROM (SELECT unnest([lower(c_mktsegment), 'any']) AS w, unnest([0.65::DOUBLE, 0.5::DOUBLE]) AS v FROM customer) GROUP BY w")
def seed_pref_max(read):
    seeds = F.explode(F.array(F.struct(F.lower("c_mktsegment").alias("w"), F.lit(0.65).alias("v")), F.struct(F.lit("any").alias("w"), F.lit(0.5).alias("v")))).alias("s")
    return read("customer").select(seeds).groupBy("s.w").agg(F.max("s.v").alias("weight"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' END, c_mktsegment) AS segment FROM customer")
def patch_merge(read):
    patch = read("customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("PATCHED").alias("p"))
    return read("customer").join(patch, "c_custkey", "left").select("c_custkey", F.coalesce("p", "c_mktsegment").alias("segment"))
