"""Queries on the small rules of a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import ranking
from ..operators import evaluation as e
from ..operators import preferences as p
from ..sources import tables
from .catalog import _top
from .evaluation import _J, _both
from .preferences import _AFF, _RULES, _items
from .query import query


@query("""WITH j AS (SELECT d.doc_id, quality, toxic, n_chars, text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id FROM j WHERE coalesce(quality < 1, true) OR toxic IS NULL OR CASE toxic WHEN 0 THEN 'a' ELSE 'b' END <> 'a' OR n_chars IS DISTINCT FROM length(text) + (doc_id % 3 // 2)""")
def stale_rows(read):
    """A label's quality as version, its toxicity as time and model, lengths as the hash of the input."""
    j = read("documents").join(read("labels"), "doc_id", "left")
    model = F.when(F.col("toxic") == 0, "a").when(F.col("toxic").isNotNull(), "b")
    wanted = (F.length("text") + F.call_function("div", F.col("doc_id") % 3, F.lit(2))).cast("long")
    return j.where(c.stale(F.col("quality"), 1, F.col("toxic"), model, "a", F.col("n_chars"), wanted)).select("doc_id")


@query("""SELECT c_custkey, coalesce(enabled, false) AND coalesce(last + to_days(days) <= TIMESTAMP '2024-01-15 12:00:00', true) AS due
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 < 6 THEN c_acctbal > 0 END AS enabled, max(ts) AS last, (c_custkey % 9)::INTEGER AS days FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1, 2, 4)""")
def due_rows(read):
    """Customers with their last event: some never, some not enabled, half a day of slack."""
    last = read("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    rows = read("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 < 6, F.col("c_acctbal") > 0).alias("enabled")).join(last, "c_custkey", "left")
    return rows.select("c_custkey", c.due(F.col("enabled"), F.col("last"), F.make_dt_interval((F.col("c_custkey") % 9).cast("int")), F.expr("timestamp_ntz '2024-01-15 00:00:00'")).alias("due"))


@query("""WITH s AS (SELECT n_nationkey, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, CASE WHEN k >= 5 THEN 14 WHEN k > 0 THEN 3 ELSE 7 END AS days, k <> 4 AS enabled FROM s""")
def cadence_patch(read):
    """Cadences and switches of nations, patched for those with suppliers; a patch for an unknown nation would stop the query."""
    table = read("nation").select("n_nationkey", F.lit(7).alias("days"), F.lit(True).alias("enabled"))
    counts = read("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    patch = counts.select("n_nationkey", F.when(F.col("k") >= 5, 14).otherwise(3).alias("days"), F.when(F.col("k") == 4, False).alias("enabled"))
    return c.patched(table, patch, "n_nationkey", ["days", "enabled"])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def guarded_count(read):
    """Counts of lines, all of whose orders must be known; order keys must be unique."""
    orders = c.require_unique(read("orders").select("o_orderkey"), "o_orderkey")
    return c.require_known(read("lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", orders, "o_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT c_custkey, MAP {'a': c_acctbal, 'b': 1.0} AS learned, CASE WHEN c_custkey % 4 = 0 THEN MAP {'c': 2.0::DOUBLE} END AS given, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END AS segment, c_mktsegment FROM customer)
SELECT c_custkey, coalesce(segment, c_mktsegment) AS segment, array_to_string(list_sort(map_keys(coalesce(given, learned))), ',') AS keys, round(list_sum(map_values(coalesce(given, learned))), 6) AS total FROM m""")
def profile_patch(read):
    """Only supplied fields change; an answered map replaces the learned one."""
    current = read("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.create_map(F.lit("a"), "c_acctbal", F.lit("b"), F.lit(1.0)).alias("learned"))
    key = F.col("c_custkey")
    patch = read("customer").where((key % 4 == 0) | (key % 3 == 0)).select("c_custkey", F.when(key % 3 == 0, "NEW").alias("segment"), F.when(key % 4 == 0, F.create_map(F.lit("c"), F.lit(2.0))).alias("learned"))
    out = c.patched_profile(current, patch, "c_custkey", ["segment"], ["learned"])
    return out.select("c_custkey", "segment", F.array_join(F.array_sort(F.map_keys("learned")), ",").alias("keys"), F.round(F.aggregate(F.map_values("learned"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH x AS (SELECT p_partkey, [CASE WHEN p_size % 2 = 0 THEN 'Category: ' || p_type ELSE 'kind:x' END, CASE p_size % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'unisex' ELSE 'Male' END, CASE WHEN p_size % 5 = 0 THEN 'MALE' ELSE 'sale' END] AS tags, p_name, p_type, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS category, p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size % 5 <> 0) AS women, CASE WHEN p_size % 2 = 0 THEN lower(p_type) NOT IN ('promo', 'large') ELSE NOT regexp_matches(p_name, '(?i)ring|bolt') END AS garment,
  list_filter(['red', 'new', string_split(p_name, ' ')[1]], lambda v: v IN ('red', 'blue', 'hot')) AS allowed FROM x""")
def tag_rules(read):
    size = F.col("p_size")
    tags = F.array(F.when(size % 2 == 0, F.concat(F.lit("Category: "), "p_type")).otherwise("kind:x"), F.when(size % 3 == 0, "Female").when(size % 3 == 1, "unisex").otherwise("Male"), F.when(size % 5 == 0, "MALE").otherwise("sale"))
    given = F.array(F.lit("red"), F.lit("new"), F.split("p_name", " ")[0])
    return read("part").select("p_partkey", c.tag_value(tags, "category").alias("category"), c.for_women(tags).alias("women"), c.is_garment(tags, F.col("p_name"), ["promo", "large"], "(?i)ring|bolt").alias("garment"), c.many_of(given, ["red", "blue", "hot"]).alias("allowed"))


@query(r"""WITH x AS (SELECT p_partkey, unnest([' ' || lower(left(p_type, 1)), '0' || p_size, p_size || ' x ' || (p_size + 1), 'one size', '2xl', 'SKU-' || p_size, '', '2XL']) AS raw, unnest(range(8)) AS i FROM part),
n AS (SELECT p_partkey, i, regexp_replace(upper(raw), '\s+', '', 'g') AS s FROM x),
v AS (SELECT p_partkey, i, CASE WHEN regexp_matches(s, '^(X{0,3}S|M|X{0,3}L|[234]XL|\d{1,3}(X\d{1,2})?)$') THEN s WHEN s IN ('ONESIZE', 'OS', 'FREE', 'F') THEN 'ONE SIZE' END AS size FROM n)
SELECT p_partkey, string_agg(size, ',' ORDER BY i) AS sizes FROM (SELECT p_partkey, size, min(i) AS i FROM v WHERE size IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def size_lists(read):
    raw = F.array(F.concat(F.lit(" "), F.lower(F.substring("p_type", 1, 1))), F.concat(F.lit("0"), "p_size"), F.concat("p_size", F.lit(" x "), F.col("p_size") + 1), F.lit("one size"), F.lit("2xl"), F.concat(F.lit("SKU-"), "p_size"), F.lit(""), F.lit("2XL"))
    return read("part").select("p_partkey", F.array_join(c.size_values(raw), ",").alias("sizes"))


@query("""WITH x AS (SELECT p_partkey, lower(p_type) AS t, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_brand, p_size, CASE p_size % 3 WHEN 0 THEN '95% ' || p_name || ', 5% ' || p_brand WHEN 1 THEN 'a very long first part of ' || p_name || ', rest' END AS clean FROM part),
y AS (SELECT *, CASE p_size % 3 WHEN 0 THEN '95% ' || a || ' ' || b WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'wool' END END AS badge, list_concat([t, a], CASE WHEN p_size > 20 THEN ['size-' || p_size] ELSE [] END, [b, 'deep-' || b]) AS attrs FROM x)
SELECT p_partkey, badge, array_to_string(attrs, ',') AS attributes, trim(replace(array_to_string(attrs[1:4], ' ') || ' ' || coalesce(badge, ''), '-', ' ')) AS similar, 'https://shop.example/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '?a=1&' ELSE '?' END || 'utm_source=catalog&utm_medium=referral' AS url FROM y""")
def result_rows(read):
    """Badge, attributes, outbound address and the next query of a result."""
    words, size = F.split("p_name", " "), F.col("p_size")
    clean = F.when(size % 3 == 0, F.concat(F.lit("95% "), "p_name", F.lit(", 5% "), "p_brand")).when(size % 3 == 1, F.concat(F.lit("a very long first part of "), "p_name", F.lit(", rest")))
    attrs = c.attributes([F.lower("p_type"), words[0], F.when(size > 20, F.concat(F.lit("size-"), size))], F.array(words[1], F.concat(F.lit("deep-"), words[1]), F.lit("third")))
    badge = c.material_badge(clean, F.when(size % 2 == 0, "wool"))
    url = c.outbound(F.concat(F.lit("https://shop.example/"), "p_partkey", F.when(size % 2 == 0, "?a=1").otherwise("")), "catalog")
    return read("part").select("p_partkey", badge.alias("badge"), F.array_join(attrs, ",").alias("attributes"), c.similar_query(attrs, badge).alias("similar"), url.alias("url"))


_FORMS = {"small": ("mini", "tiny", "small"), "ring-like": ("round", "band"), "hot": ("warm", "hot", "mini")}


@query("""WITH f AS (SELECT item_id, lower(text) AS q FROM benchmark UNION ALL SELECT 1000000 + p_partkey, lower(p_name || ' ' || p_type) FROM part),
l AS (SELECT item_id, q, list_concat(CASE WHEN contains(q, 'mini') OR contains(q, 'tiny') OR contains(q, 'small') THEN ['mini', 'tiny', 'small'] ELSE []::VARCHAR[] END, CASE WHEN contains(q, 'round') OR contains(q, 'band') OR contains(q, 'ring like') THEN ['round', 'band'] ELSE []::VARCHAR[] END, CASE WHEN contains(q, 'warm') OR contains(q, 'hot') OR contains(q, 'mini') THEN ['warm', 'hot', 'mini'] ELSE []::VARCHAR[] END) AS l FROM f),
r AS (SELECT item_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS lexical FROM l)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'cache' WHEN item_id % 5 = 0 THEN 'model' ELSE 'lexical' END AS origin, CASE WHEN item_id % 3 = 0 THEN 'kept' WHEN item_id % 5 = 0 THEN 'told' ELSE lexical END AS terms FROM r""")
def expansion_sources(read):
    """The expansion of each query from the cache, else from a model's answer, else from its words."""
    queries = read("benchmark").select("item_id", "text").unionByName(read("part").select((F.col("p_partkey") + 1000000).alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")))
    cache = queries.where("item_id % 3 = 0").select("item_id", F.lit("kept").alias("cached"))
    answers = queries.where("item_id % 5 = 0").select("item_id", F.lit("told").alias("answered"))
    both = queries.join(cache, "item_id", "left").join(answers, "item_id", "left")
    lexical = F.array_join(c.lexical_forms(F.col("text"), _FORMS), ",")
    return both.select("item_id", F.when(F.col("cached").isNotNull(), "cache").when(F.col("answered").isNotNull(), "model").otherwise("lexical").alias("origin"), F.coalesce("cached", "answered", lexical).alias("terms"))


@query(f"""WITH s AS (SELECT p_partkey, sum(CASE WHEN rule = 'calm' THEN r END) AS calm, sum(CASE WHEN rule = 'bold' THEN r END) AS bold FROM (SELECT p_partkey, rule, (h - m) / greatest(1, h + m)::DOUBLE AS r FROM (
  SELECT p_partkey, rule, sum(list_contains(p, value)::INT) AS h, sum(list_contains(a, value)::INT) AS m FROM (SELECT p_partkey, 'type' AS attr, p_type AS value FROM part UNION ALL SELECT p_partkey, 'tone', string_split(p_name, ' ')[1] FROM part)
  JOIN (SELECT * FROM (VALUES ('calm', 'type', ['SMALL', 'MEDIUM'], ['PROMO']), ('calm', 'tone', ['blue', 'cold'], ['red', 'hot']), ('bold', 'tone', ['red', 'hot'], ['old']), ('bold', 'type', ['PROMO', 'LARGE'], []::VARCHAR[])) t(rule, attr, p, a)) USING (attr) GROUP BY 1, 2) WHERE h + m > 0) GROUP BY 1)
SELECT p_partkey, round({_AFF} - 0.45::DOUBLE * 0.5::DOUBLE + 0.15::DOUBLE * CASE p_type WHEN 'SMALL' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END + 0.10::DOUBLE * coalesce((calm + 1) / 2, 0.5) + 0.10::DOUBLE * coalesce((bold + 1) / 2, 0.5)
  + 0.10::DOUBLE * CASE string_split(p_name, ' ')[2] WHEN 'ring' THEN 0.9::DOUBLE WHEN 'gear' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END, 9) AS affinity FROM part LEFT JOIN s USING (p_partkey)""")
def affinity_components(read):
    """All seven components: brand, natural share, material, styling rules, the aesthetic's rule, silhouette, price."""
    part, items = read("part"), _items(read)
    rules = part.sparkSession.createDataFrame(_RULES, "rule string, attr string, prefers array<string>, avoids array<string>")
    of = lambda name: p.rule_scores(items, ["p_partkey"], rules.where(F.col("rule") == name)).withColumnRenamed("score", name)
    rows = part.join(of("calm"), "p_partkey").join(of("bold"), "p_partkey")
    known = lambda value, **scores: p.known_score(value, F.create_map(*(F.lit(x) for e_ in scores.items() for x in e_)))
    brands = F.create_map(F.lit("Brand#1"), F.lit(0.9), F.lit("Brand#2"), F.lit(0.3))
    brand = p.brand_score(F.col("p_brand"), brands)
    parts = {
        "brand": brand, "fiber": p.closeness(F.col("p_size") / 50.0, F.lit(0.4)), "material": known(F.col("p_type"), SMALL=0.8), "styling": F.col("calm"), "aesthetic": F.col("bold"),
        "silhouette": known(F.split("p_name", " ")[1], ring=0.9, gear=0.1), "price": p.price_fit(F.col("p_retailprice"), F.lit(920.0), F.lit(960.0)),
    }
    return rows.select("p_partkey", F.round(p.weighted(parts), 9).alias("affinity"))


@query(f"""WITH {_J}, h AS (SELECT source, count(*) AS hit FROM r WHERE rank <= 20 AND grade >= 2 GROUP BY 1),
q AS (SELECT source, CASE WHEN n > 0 THEN coalesce(hit, 0) / n::DOUBLE END AS recall FROM (SELECT source, sum((grade >= 2)::INT) AS n FROM j GROUP BY 1) LEFT JOIN h USING (source)),
g AS (SELECT source, bool_or(rank <= 10 AND grade = 3) AS gate FROM r GROUP BY 1), a AS (SELECT 'len' || length(source) AS slice, recall, gate FROM q JOIN g USING (source)),
s AS (SELECT slice, recall, gate FROM a UNION ALL SELECT 'all', recall, gate FROM a)
SELECT slice, count(*) AS cases, round(avg(recall), 6) AS recall, bool_and(gate) AS gates, coalesce(avg(recall) >= 0.4 AND bool_and(gate) AND min(recall) >= 0.05, false) AS passed FROM s GROUP BY 1""")
def eval_slices(read):
    """Means by slice and overall, and whether all thresholds hold: mean recall, all gates, the worst recall."""
    ranked, judged = _both(read)
    gates = ranked.groupBy("source").agg(F.max((F.col("rank") <= 10) & (F.col("grade") == 3)).alias("gate"))
    cases = e.recall(ranked, judged, "source", 20).join(gates, "source").withColumn("slice", F.explode(F.array(F.concat(F.lit("len"), F.length("source")), F.lit("all"))))
    return e.summary(cases, "slice", "recall", "gate", 0.4, 0.05)


_LIST = "(SELECT p_partkey, p_type, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 120)"


@query(f"WITH t AS {_LIST}, w AS (SELECT p_partkey FROM t WHERE p_type <> 'PROMO' ORDER BY rank LIMIT 60) SELECT p_partkey, 'window' AS part_of FROM t WHERE p_partkey IN (SELECT p_partkey FROM w) UNION ALL SELECT p_partkey, 'tail' FROM t WHERE p_partkey NOT IN (SELECT p_partkey FROM w)")
def identity_split(read):
    """The reranked window by its keys, and the rest of the list without them."""
    top = _top(read, 120)
    window = top.where("p_type <> 'PROMO'").orderBy("rank").limit(60).select("p_partkey")
    inside, outside = top.join(window, "p_partkey", "left_semi"), top.join(window, "p_partkey", "left_anti")
    return inside.select("p_partkey", F.lit("window").alias("part_of")).unionByName(outside.select("p_partkey", F.lit("tail").alias("part_of")))


@query(f"WITH t AS {_LIST} SELECT p_partkey, rank AS place, (CASE WHEN rank <= 10 THEN 0 WHEN rank <= 60 THEN 1 ELSE 2 END)::INTEGER AS segment, round(1 - (rank - 1) / greatest(1, 120)::DOUBLE, 6) AS relevance FROM t")
def rerank_fallback(read):
    """Without a reranker's answer the first ten of the window stay first; relevance falls evenly along the list."""
    top = _top(read, 120)
    merged = ranking.head_tail(top.where("rank <= 60"), None, top.where("rank > 60"), "p_partkey")
    return merged.select("p_partkey", F.col("place").cast("long").alias("place"), "segment", F.round(c.upstream_relevance(F.col("place") - 1, F.lit(120)), 6).alias("relevance"))


@query("""SELECT c_custkey, coalesce(max(ts), TIMESTAMP '2024-02-01 00:00:00') AS seen, coalesce(max(ts) < TIMESTAMP '2024-02-01 00:00:00' - to_days(greatest(7, 2 * coalesce(any_value(cadence), 0))::INTEGER), false) AS lapsed
FROM (SELECT *, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 6 END AS cadence FROM customer) LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def last_seen(read):
    """When each customer was last seen, now where never, and whether that is two cadences ago."""
    cadence = F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 6).cast("int"))
    last = read("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    now = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    rows = read("customer").select("c_custkey", cadence.alias("cadence")).join(last, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("last", now).alias("seen"), F.coalesce(c.lapsed(F.col("last"), F.col("cadence"), now), F.lit(False)).alias("lapsed"))


@query("""WITH x AS (SELECT string_split(p_name, ' ') AS w, '[' || repeat('1,', p_size % 3) || '2]' AS j, p_size, p_retailprice FROM part)
SELECT count(*) AS n, count(*) FILTER (len(list_filter(w, lambda v: length(v) > 3)) > 0) AS named, count(*) FILTER (json_array_length(j) > 1) AS several, count(*) FILTER (p_size > 25) AS large, count(*) FILTER (p_retailprice > 950) AS dear FROM x""")
def array_coverage(read):
    """Counts of rows with a long word, several JSON elements, a size, a price."""
    long = F.size(F.filter(F.split("p_name", " "), lambda v: F.length(v) > 3)) > 0
    json = F.concat(F.lit("["), F.repeat(F.lit("1,"), F.col("p_size") % 3), F.lit("2]"))
    return read("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("named"), F.count_if(F.json_array_length(json) > 1).alias("several"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_retailprice") > 950).alias("dear"))


_WEIGHTS = [("segment", "BUILDING", "material", "wood", 0.65), ("segment", "BUILDING", "material", "steel", 0.6), ("segment", "MACHINERY", "material", "steel", 0.65), ("wealth", "rich", "material", "steel", 0.7), ("wealth", "rich", "brand", "gold", 0.65), ("wealth", "poor", "brand", "plain", 0.5)]


@query("""WITH a AS (SELECT c_custkey, 'segment' AS question, c_mktsegment AS answer FROM customer UNION ALL SELECT c_custkey, 'wealth', CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'poor' END FROM customer),
w AS (SELECT * FROM (VALUES ('segment', 'BUILDING', 'material', 'wood', 0.65::DOUBLE), ('segment', 'BUILDING', 'material', 'steel', 0.6), ('segment', 'MACHINERY', 'material', 'steel', 0.65), ('wealth', 'rich', 'material', 'steel', 0.7), ('wealth', 'rich', 'brand', 'gold', 0.65), ('wealth', 'poor', 'brand', 'plain', 0.5)) t(question, answer, target, key, weight))
SELECT c_custkey, target, key, max(weight) AS weight FROM a JOIN w USING (question, answer) GROUP BY 1, 2, 3""")
def questionnaire_seeds(read):
    """Answers made of a customer's fields, seeded through the weight table."""
    answers = F.explode(F.array(F.struct(F.lit("segment").alias("question"), F.col("c_mktsegment").alias("answer")), F.struct(F.lit("wealth").alias("question"), F.when(F.col("c_acctbal") > 5000, "rich").when(F.col("c_acctbal") < 0, "poor").alias("answer")))).alias("a")
    given = read("customer").select("c_custkey", answers).select("c_custkey", "a.*")
    weights = given.sparkSession.createDataFrame(_WEIGHTS, "question string, answer string, target string, key string, weight double")
    return p.seeded(given, "c_custkey", weights).select("c_custkey", "target", F.explode("seeds").alias("key", "weight"))


@query(f"WITH {_J}, n AS (SELECT source, avg((grade >= 2)::INT) AS precision FROM r WHERE rank <= 10 GROUP BY 1), b AS (SELECT source, avg((grade >= 2)::INT) AS precision FROM r WHERE rank <= 5 AND source <> 'src8' GROUP BY 1) SELECT source, round(n.precision, 6) AS precision, round(n.precision - b.precision, 6) AS delta FROM n LEFT JOIN b USING (source)")
def stored_baseline(read):
    """Precision now against a stored table of an earlier run, which lacks a source."""
    ranked = _both(read)[0]
    baseline = tables.stored(e.precision(ranked, "source", 5).where("source <> 'src8'"), "baseline")
    return e.delta(e.precision(ranked, "source", 10), baseline, "source", "precision").select("source", F.round("precision", 6).alias("precision"), F.round("delta", 6).alias("delta"))
