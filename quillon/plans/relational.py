"""Scans, filters, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking
from ..operators.evaluation import standard_error
from ..streaming import limits
from .query import query


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03")
def scan_project_filter(read):
    return read("lineitem").where("l_quantity > 40 and l_discount < 0.03").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def scan_with_partition_prune(read):
    return read("orders").where("o_orderdate >= timestamp_ntz '1997-01-01' and o_orderdate < timestamp_ntz '1998-01-01'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT strftime(max(ts), '%Y-%m-%d') AS run FROM events")
def latest_run(read):
    return read("events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("run"))


@query("SELECT count(*) AS n, sum((p_name IS NULL OR trim(p_name) = '' OR p_retailprice < 0)::INT)::BIGINT AS bad FROM part")
def schema_validation(read):
    bad = F.col("p_name").isNull() | (F.trim("p_name") == "") | (F.col("p_retailprice") < 0)
    return read("part").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("bad"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_totalprice BETWEEN 100000 AND 200000")
def in_not_in_filter(read):
    return read("orders").where(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & F.col("o_totalprice").between(100000, 200000)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type IS NULL OR p_name = '' OR len(string_split(p_name, ' ')) < 2 OR p_size < 3")
def incomplete_rows(read):
    return read("part").where(F.col("p_type").isNull() | (F.col("p_name") == "") | (F.size(F.split("p_name", " ")) < 2) | (F.col("p_size") < 3)).select("p_partkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def distinct_from(read):
    return read("documents").join(read("labels"), "doc_id", "left").where(~F.col("quality").eqNullSafe(1)).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality < 1 OR l.toxic IS DISTINCT FROM 0 OR d.n_chars <> length(d.text)")
def stale_predicate(read):
    j = read("documents").join(read("labels"), "doc_id", "left")
    return j.where(F.col("quality").isNull() | (F.col("quality") < 1) | ~F.col("toxic").eqNullSafe(0) | (F.col("n_chars") != F.length("text"))).select("doc_id")


@query("SELECT user_id, max(ts) + to_days((user_id % 5)::INTEGER) <= TIMESTAMP '2024-01-30 12:00:00' AS due FROM events GROUP BY user_id")
def due_filter(read):
    last = read("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", (F.col("last") + F.make_dt_interval(F.col("user_id") % 5) <= F.expr("timestamp_ntz '2024-01-30 12:00:00'")).alias("due"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 2 DAY > TIMESTAMP '2024-01-30 00:00:00'")
def unexpired(read):
    return read("events").where("ts > timestamp_ntz '2024-01-28 00:00:00'").select("event_id")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN p_size END AS size, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type END AS kind FROM part")
def range_guard(read):
    return read("part").select("p_partkey", F.when(F.col("p_size").between(10, 20), F.col("p_size")).alias("size"), F.when(F.col("p_type").isin("SMALL", "LARGE"), F.col("p_type")).alias("kind"))


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND NOT regexp_matches(source, '^src1') AND NOT contains(text, '|')")
def tag_predicates(read):
    return read("documents").where(F.col("lang").isin("fr", "de") & ~F.col("source").rlike("^src1") & ~F.contains("text", F.lit("|"))).select("doc_id")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join(read):
    return read("orders").join(read("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join(read):
    return read("documents").join(read("labels"), "doc_id", "left").select("doc_id", "quality")


@query("SELECT w.p_brand AS winner, l.p_brand AS loser, count(*) AS n FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) x JOIN part w ON w.p_partkey = a JOIN part l ON l.p_partkey = b GROUP BY 1, 2")
def role_playing_join(read):
    pairs = read("lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("b"))
    role = lambda n, k: read("part").select(F.col("p_partkey").alias(k), F.col("p_brand").alias(n))
    return pairs.join(role("winner", "a"), "a").join(role("loser", "b"), "b").groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, round(coalesce(c_acctbal + t, c_acctbal), 2) AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_from_agg(read):
    t = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
    return read("customer").join(t, "c_custkey", "left").select("c_custkey", F.round(F.coalesce(F.col("c_acctbal") + F.col("t"), "c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(read):
    return read("customer").join(read("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_name, count(*) AS n, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved FROM part GROUP BY 1")
def resolve_unique(read):
    n = F.count(F.lit(1))
    return read("part").groupBy("p_name").agg(n.alias("n"), F.when(n == 1, F.min("p_partkey")).alias("resolved"))


@query("SELECT item_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.n_chars < 500 THEN 'inactive' ELSE 'ok' END AS state FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 7")
def corpus_assert(read):
    d = read("documents").select((F.col("doc_id")).alias("k"), "n_chars")
    j = read("benchmark").withColumn("k", F.col("item_id") * 7).join(d, "k", "left")
    return j.select("item_id", F.when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") < 500, "inactive").otherwise("ok").alias("state"))


@query("WITH b AS (SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8)::BIGINT AS batch, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 8)::BIGINT AS idx FROM conversations) SELECT conv_id, turn, batch, idx FROM b")
def chunking(read):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return read("conversations").select("conv_id", "turn", F.floor(rn / 8).alias("batch"), (rn % 8).cast("long").alias("idx"))


@query("SELECT c.conv_id, c.turn, length(c.text)::INTEGER AS n FROM conversations c JOIN (SELECT conv_id, turn AS t FROM conversations WHERE role = 'assistant') a ON a.conv_id = c.conv_id AND a.t = c.turn + 1")
def batch_index_join(read):
    c = read("conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").alias("n"))


@query("SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def fk_check(read):
    return read("lineitem").join(read("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT count(*) AS n, count(quality) AS labelled, sum((quality = 1)::INT)::BIGINT AS good, sum((toxic = 1)::INT)::BIGINT AS toxic, sum((n_chars > 1000)::INT)::BIGINT AS long, sum((lang = 'en')::INT)::BIGINT AS english FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_report(read):
    j = read("documents").join(read("labels"), "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.count_if(F.col("lang") == "en").alias("english"))


@query("SELECT source, round(100.0::DOUBLE * count(quality) / count(*), 4) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage_pct(read):
    return read("documents").join(read("labels"), "doc_id", "left").groupBy("source").agg(F.round(F.try_divide(100.0 * F.count("quality"), F.count(F.lit(1))), 4).alias("pct"))


@query("SELECT user_id, max(ts) AS last_ts, max(value) AS top FROM events GROUP BY 1")
def group_max(read):
    return read("events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max("value").alias("top"))


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(read):
    return read("part").select("p_brand").distinct()


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def group_count(read):
    return read("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def group_collect(read):
    return read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN NULL ELSE value END), 6) AS mean FROM events GROUP BY 1")
def mean_nullable(read):
    return read("events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") <= 50, F.col("value"))), 6).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN count(*) >= 2 THEN round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) END AS se FROM lineitem GROUP BY 1, 2")
def standard_error_query(read):
    return read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(standard_error("l_extendedprice"), 6).alias("se"))


@query("SELECT p_partkey, round(CASE WHEN h - l < 1e-9 THEN 0.5 ELSE (p_retailprice - l) / (h - l) END, 6) AS norm FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS l, max(p_retailprice) OVER (PARTITION BY p_brand) AS h FROM part)")
def minmax_norm(read):
    return ranking.min_max_by(read("part").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", "norm").select("p_partkey", F.round("norm", 6).alias("norm"))


@query("SELECT l_linestatus, round(min(m), 6) AS worst FROM (SELECT l_linestatus, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def worst_slice(read):
    return read("lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_discount").alias("m")).groupBy("l_linestatus").agg(F.round(F.min("m"), 6).alias("worst"))


@query("SELECT source, round(avg((quality = 1)::INT), 6) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def group_hit_ratio(read):
    return read("documents").join(read("labels"), "doc_id").groupBy("source").agg(F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("ratio"))


@query("SELECT p_type, round(sum(l_quantity * p_retailprice), 2) AS cost, count(*) AS calls FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def usage_cost(read):
    return read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW), 6) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events")
def rolling_sum_60s(read):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(t).rangeBetween(-60_000_000, 0)
    return read("events").select("event_id", F.round(F.sum("value").over(w), 6).alias("total"), F.count(F.lit(1)).over(w).alias("hits"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hits FROM events")
def sliding_hits(read):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return read("events").select("event_id", F.count(F.lit(1)).over(w).alias("hits"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def ranked_rows(read):
    return read("part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("rank"))


@query("SELECT p_type, p_partkey, round(greatest(0.0, 1 - (r - 1) / greatest(10, n - 1)::DOUBLE), 6) AS decay FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part)")
def rank_decay(read):
    """Whole lists, however long: rows are numbered within a price of a type, behind the counts of the dearer ones."""
    of, part = ["p_type", "p_retailprice"], read("part").select("p_type", "p_partkey", "p_retailprice")
    counts = part.groupBy(*of).agg(F.count(F.lit(1)).alias("k"))
    dearer = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = counts.select(*(F.col(c).alias(f"_{c}") for c in of), F.coalesce(F.sum("k").over(dearer), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("p_type")).alias("n"))  # a row for each price of a type
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*of).orderBy("p_partkey"))
    rows = part.join(ends, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of])
    return rows.select("p_type", "p_partkey", F.round(ranking.rank_decay(rank, F.col("n")), 6).alias("decay"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(read):
    rn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return read("events").withColumn("rn", rn).where("rn = 1").select("user_id", "event_type", "event_id")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_simple(read):
    return read("supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_n(read):
    return read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 51 AND 100")
def page_slice(read):
    top = read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)  # the pages before it and itself
    return ranking.page(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))), 2).select("o_orderkey")


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1) WHERE r <= 4 GROUP BY 1")
def top_map_entries(read):
    per = read("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.filter(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type", "n")), lambda e: e["n"] > 1))
    line = F.array_join(F.transform(F.slice(entries, 1, 4), lambda e: F.concat(e["event_type"], F.lit(":"), e["n"])), ",")
    return per.groupBy("user_id").agg(line.alias("top")).where("top <> ''")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] || ',' || string_split(p_name, ' ')[2] || CASE WHEN lower(p_type) = string_split(p_name, ' ')[1] THEN '' ELSE ',' || lower(p_type) END AS u FROM part")
def array_union_ordered(read):
    return read("part").select("p_partkey", F.array_join(F.array_union(F.split("p_name", " "), F.array(F.lower("p_type"))), ",").alias("u"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def array_distinct(read):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return read("conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def sync_pending_anti(read):
    return read("orders").where("o_orderstatus = 'O'").join(read("lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey").distinct()


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(read):
    return read("part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(r"""WITH x AS (SELECT event_id, [401, 403, 429, 500, NULL][1 + user_id % 5] AS status,
  ['Insufficient quota', 'too many requests', 'Invalid API key', 'HTTP 429: payment due', '', NULL][1 + event_id % 6] || ' ' || event_type AS message FROM events)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN status IN (401, 403) OR regexp_matches(message, '(?i)invalid[_ ]api[_ ]key|authentication|unauthorized|permission') THEN 'terminal'
  WHEN (status = 429 OR regexp_matches(message, '\b429\b')) AND regexp_matches(message, '(?i)insufficient[_ ]quota|no credits|billing|exceeded your current quota|payment') THEN 'terminal' ELSE 'transient' END AS kind FROM x) GROUP BY 1""")
def error_classify(read):
    """Failures made of events: a status and a message, either of which may be missing."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    message = F.concat(pick(["Insufficient quota", "too many requests", "Invalid API key", "HTTP 429: payment due", "", None], F.col("event_id") % 6), F.lit(" "), "event_type")
    kind = text.failure_kind(pick([401, 403, 429, 500, None], F.col("user_id") % 5), message)
    return read("events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_LOG = "e AS (SELECT user_id, list({fields} ORDER BY ts, event_id) AS l FROM events WHERE user_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_LOG.format(fields="{'h': []::DOUBLE[], 'f': []::BIGINT[], 't': epoch_us(ts) / 1e6::DOUBLE, 'id': event_id}")},
r AS (SELECT list_reduce(list_prepend({{'h': []::DOUBLE[], 'f': []::BIGINT[], 't': 0::DOUBLE, 'id': 0::BIGINT}}, l), lambda s, x: CASE WHEN len(list_filter(s.h, lambda y: y > x.t - 3600)) < 5
  THEN {{'h': list_append(list_filter(s.h, lambda y: y > x.t - 3600), x.t), 'f': list_append(s.f, x.id), 't': x.t, 'id': x.id}} ELSE {{'h': list_filter(s.h, lambda y: y > x.t - 3600), 'f': s.f, 't': x.t, 'id': x.id}} END).f AS f FROM e),
a AS (SELECT unnest(f) AS event_id FROM r) SELECT event_id, event_id IN (SELECT event_id FROM a) AS admitted FROM events WHERE user_id IS NOT NULL""")
def rate_limit_fold(read):
    return limits.rate_limit(read("events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", 5, 3600.0).select("event_id", "admitted")


@query(f"""WITH {_LOG.format(fields="{'s': epoch_us(ts)::BIGINT, 'n': 1::BIGINT, 'ok': 1::BIGINT}")}
SELECT user_id, len(l)::INTEGER AS hits, list_reduce(list_prepend({{'s': -4000000000000000000::BIGINT, 'n': 0::BIGINT, 'ok': 0::BIGINT}}, l),
  lambda s, x: CASE WHEN x.s - s.s >= 86400000000 THEN {{'s': x.s, 'n': 1::BIGINT, 'ok': s.ok + 1}} ELSE {{'s': s.s, 'n': s.n + 1, 'ok': s.ok + (s.n < 3)::BIGINT}} END).ok::INTEGER AS admitted FROM e""")
def fixed_window_limit(read):
    return limits.fixed_window(read("events"), "user_id", "ts", "event_id", 3, 86_400)


@query(f"""WITH {_LOG.format(fields="{'t': epoch_us(ts)::BIGINT, 'bad': (event_type = 'error')::BIGINT, 'run': 0::BIGINT, 'trips': 0::BIGINT, 'no': 0::BIGINT}")},
r AS (SELECT user_id, list_reduce(list_prepend({{'t': -4000000000000000000::BIGINT, 'bad': 0::BIGINT, 'run': 0::BIGINT, 'trips': 0::BIGINT, 'no': 0::BIGINT}}, l),
  lambda s, x: CASE WHEN x.t < s.t THEN {{'t': s.t, 'bad': x.bad, 'run': s.run, 'trips': s.trips, 'no': s.no + 1}} WHEN x.bad = 0 THEN {{'t': s.t, 'bad': 0::BIGINT, 'run': 0::BIGINT, 'trips': s.trips, 'no': s.no}}
  WHEN s.run + 1 >= 2 THEN {{'t': x.t + 86400000000, 'bad': 1::BIGINT, 'run': s.run + 1, 'trips': s.trips + 1, 'no': s.no}} ELSE {{'t': s.t, 'bad': 1::BIGINT, 'run': s.run + 1, 'trips': s.trips, 'no': s.no}} END) AS z FROM e)
SELECT user_id, z.trips::INTEGER AS trips, z.no::INTEGER AS refused FROM r""")
def breaker_fold(read):
    return limits.breaker(read("events").withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "event_id", "failed", 2, 86_400)
