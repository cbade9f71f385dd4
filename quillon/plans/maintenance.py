"""Maintenance queries: orders split into an existing and an incoming snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators import sanitize, upkeep
from .query import query

_E = "e AS (SELECT *, sha256(o_orderkey || ':' || round(o_totalprice * 100)::BIGINT) AS h FROM orders WHERE o_orderkey % 10 <> 0)"
_I = "i AS (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice), sha256(o_orderkey || ':' || round((CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) * 100)::BIGINT) AS h FROM orders WHERE o_orderkey % 7 <> 0)"
_S = "s AS (SELECT coalesce(e.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN i.o_orderkey IS NULL THEN 'absent' WHEN e.o_orderkey IS NULL THEN 'inserted' WHEN e.h = i.h THEN 'unchanged' ELSE 'updated' END AS status FROM e FULL JOIN i ON e.o_orderkey = i.o_orderkey)"


def _snapshots(read):
    orders = read("orders")
    hashed = lambda df: df.withColumn("content_hash", F.sha2(F.concat("o_orderkey", F.lit(":"), F.round(F.col("o_totalprice") * 100).cast("long")), 256))
    new = F.when((F.col("o_orderkey") % 5 == 0) | (F.col("o_orderkey") % 11 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return hashed(orders.where("o_orderkey % 10 <> 0")), hashed(orders.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", new))


@query(f"WITH {_E}, {_I}, {_S} SELECT * FROM s")
def upsert_classify(read):
    return m.classify(*_snapshots(read), "o_orderkey")


@query(f"WITH {_E}, {_I}, {_S} SELECT status, count(*) AS n FROM s GROUP BY 1")
def upsert_stats(read):
    return m.classify(*_snapshots(read), "o_orderkey").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E}, {_I} SELECT coalesce(e.o_orderkey, i.o_orderkey) AS o_orderkey, round(coalesce(i.o_totalprice, e.o_totalprice), 2) AS o_totalprice, coalesce(e.o_orderpriority, i.o_orderpriority) AS o_orderpriority, greatest(e.o_orderdate, i.o_orderdate) AS o_orderdate FROM e FULL JOIN i ON e.o_orderkey = i.o_orderkey")
def upsert_result(read):
    e, i = _snapshots(read)
    return m.upsert(e, i, "o_orderkey", ["o_orderpriority"], "o_orderdate").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority", "o_orderdate")


@query(f"WITH {_E}, {_I} SELECT o_orderkey, k >= 0.5 * n AND f IS NULL AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY AS deactivate FROM (SELECT e.o_orderkey, e.o_orderdate, i.o_orderkey AS f, count(i.o_orderkey) OVER (PARTITION BY e.o_orderstatus) AS k, count(*) OVER (PARTITION BY e.o_orderstatus) AS n FROM e LEFT JOIN i USING (o_orderkey))")
def soft_delete_guard(read):
    return m.soft_delete(*_snapshots(read), "o_orderkey", "o_orderstatus", "o_orderdate", "2000-01-01 00:00:00")


@query("SELECT user_id, greatest(max(CASE WHEN event_id % 2 = 0 THEN ts END), max(CASE WHEN event_id % 3 = 0 THEN ts END)) AS seen FROM events GROUP BY 1")
def monotone_clock(read):
    side = lambda k: F.max(F.when(F.col("event_id") % k == 0, F.col("ts")))
    return read("events").groupBy("user_id").agg(F.greatest(side(2), side(3)).alias("seen"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 9 END, quality) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def null_fill_merge(read):
    base = read("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 9).alias("quality"))
    return m.null_fill(base, read("labels"), "doc_id", ["quality"])


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_custkey, 'new' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def insert_missing(read):
    target = read("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return m.insert_missing(target, read("orders").select(F.col("o_custkey").alias("k"), F.lit("new").alias("name")), "k")


@query("SELECT l_orderkey, sha256(string_agg(p, ':' ORDER BY p)) AS fingerprint FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS p FROM lineitem) GROUP BY 1")
def set_fingerprint(read):
    parts = F.array_sort(F.collect_set(F.col("l_partkey").cast("string")))
    return read("lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(parts, ":"), 256).alias("fingerprint"))


@query("SELECT p_partkey, sha256(json_object('p_name', p_name, 'p_brand', p_brand, 'p_type', p_type, 'p_size', p_size)::VARCHAR) AS hash FROM part")
def content_hash(read):
    """Of the fields as JSON, nulls included: no two rows of fields have one text."""
    fields = F.to_json(F.struct("p_name", "p_brand", "p_type", "p_size"), {"ignoreNullFields": "false"})
    return read("part").select("p_partkey", F.sha2(fields, 256).alias("hash"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 14 ELSE 7 END AS days, NOT (c_custkey % 5 = 0) AS enabled FROM customer")
def cadence_update(read):
    """A cadence and a switch set for the rows that a key names; the others keep theirs."""
    c = read("customer").select("c_custkey", "c_mktsegment", F.lit(7).alias("days"), F.lit(True).alias("enabled"))
    days = F.when(F.col("c_mktsegment") == "BUILDING", 14).otherwise(F.col("days"))
    return c.select("c_custkey", days.alias("days"), F.when(F.col("c_custkey") % 5 == 0, False).otherwise(F.col("enabled")).alias("enabled"))


@query("""WITH x AS (SELECT p_partkey, [lower(p_type), string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]] AS given FROM part)
SELECT p_partkey, array_to_string(list_filter(given, lambda v: v IN ('small', 'large', 'red', 'ring')), ',') AS kept, len(list_filter(given, lambda v: v NOT IN ('small', 'large', 'red', 'ring')))::INTEGER AS dropped FROM x""")
def sanitize_extraction(read):
    """Extracted values (JSON) held to the vocabulary, with the number that it refuses."""
    given = F.from_json(F.to_json(F.concat(F.array(F.lower("p_type")), F.slice(F.split("p_name", " "), 1, 2))), "array<string>")
    known = lambda v: v.isin("small", "large", "red", "ring")
    return read("part").select("p_partkey", given.alias("g")).select("p_partkey", F.array_join(F.filter("g", known), ",").alias("kept"), F.size(F.filter("g", lambda v: ~known(v))).alias("dropped"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_type IN ('SMALL', 'LARGE') THEN lower(p_type) END, CASE WHEN string_split(p_name, ' ')[1] IN ('small', 'large') THEN string_split(p_name, ' ')[1] END, 'unknown') AS size_class FROM part")
def facet_cascade(read):
    first = F.split("p_name", " ")[0]
    return read("part").select("p_partkey", F.coalesce(F.when(F.col("p_type").isin("SMALL", "LARGE"), F.lower("p_type")), F.when(first.isin("small", "large"), first), F.lit("unknown")).alias("size_class"))


_PICKS = "SELECT conv_id, turn, (turn % 7) - 1.5::DOUBLE + 0.75::DOUBLE * (conv_id % 2) AS pos, CASE turn % 4 WHEN 0 THEN 'Nice one ' || role WHEN 1 THEN text || ', null' WHEN 2 THEN 'null' ELSE left(text, 12) END AS why FROM conversations"


@query(f"""WITH x AS ({_PICKS}), k AS (SELECT *, floor(pos)::INTEGER AS i, row_number() OVER (PARTITION BY conv_id, floor(pos) ORDER BY turn) AS nth FROM x WHERE pos >= 0 AND floor(pos) < 4),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM k WHERE nth = 1),
r AS (SELECT *, trim(regexp_replace(trim(why), '(?i)[,;:\\s]*\\bnull\\b\\.?$', '')) AS bare FROM o WHERE place <= 10)
SELECT conv_id, place::INTEGER AS place, i AS "index", CASE WHEN length(bare) >= 8 AND NOT regexp_matches(bare, '(?i)^(good|great|nice|perfect|strong)\\b') THEN CASE WHEN length(bare) > 90 THEN left(bare, 87) || '...' ELSE bare END END AS reason FROM r""")
def rerank_picks(read):
    """Answers made of the turns of a conversation, for a list of four: places out of range, repeated ones, empty praise."""
    at = (F.col("turn") % 7) - 1.5 + 0.75 * (F.col("conv_id") % 2)
    fourth = F.col("turn") % 4
    why = F.when(fourth == 0, F.concat(F.lit("Nice one "), "role")).when(fourth == 1, F.concat("text", F.lit(", null"))).when(fourth == 2, "null").otherwise(F.substring("text", 1, 12))
    turns = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", at.cast("double").alias("index"), why.alias("reason")))).alias("t"))  # of one answer
    picks = sanitize.picks(F.transform("t", lambda x: F.struct(x["index"].alias("index"), x["reason"].alias("reason"))), F.lit(4))
    return turns.select("conv_id", F.posexplode(picks).alias("place", "p")).select("conv_id", (F.col("place") + 1).alias("place"), "p.index", "p.reason")


@query("""WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type, p_size FROM part)
SELECT p_partkey, array_to_string(list_concat([w[1], 'size ' || p_size], CASE WHEN p_size % 2 = 0 THEN [w[2]] ELSE [] END), '|') AS terms, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN lower(p_type) END AS size, CASE WHEN w[1] IN ('red', 'blue') THEN w[1] ELSE '' END AS tones,
  ((p_type NOT IN ('SMALL', 'LARGE'))::INT + CASE WHEN w[1] IN ('red', 'blue') THEN 1 ELSE 2 END)::INTEGER AS dropped, p_size > 40 AS has_negation FROM x""")
def sanitize_facets(read):
    """An expansion and an extraction made of a part's fields: unknown values, long and short terms, a negation."""
    words = F.split("p_name", " ")
    raw = F.struct(
        F.array(F.concat(F.lit(" "), F.upper(words[0])), F.concat(F.lit("Size "), "p_size"), F.when(F.col("p_size") % 2 == 0, words[1]).otherwise("x"), F.lit("one two three four")).alias("terms"),
        F.when(F.col("p_size") > 40, F.array("p_brand")).alias("negatedTerms"), F.lit(None).cast("boolean").alias("hasNegation"), F.col("p_type").alias("size"), F.array(F.upper(words[0]), F.lit("tartan")).alias("tones"),
    )
    single, many = {"size": ("small", "large")}, {"tones": ("red", "blue")}
    both = read("part").select("p_partkey", sanitize.expansion(raw, single, many).alias("e"), sanitize.extraction(raw, single, many).alias("x"))
    return both.select("p_partkey", F.array_join("e.terms", "|").alias("terms"), "x.size", F.array_join("x.tones", ",").alias("tones"), "x.dropped", "e.has_negation")


@query("""WITH s AS (SELECT MAP {'small': ['mini', 'small'], 'ring': ['band', 'ring']} AS m)
SELECT p_partkey, lower(p_name) AS title, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') AS attrs, '100% ' || lower(p_brand) || ' ' || array_to_string(coalesce(m[string_split(p_name, ' ')[2]], [string_split(p_name, ' ')[2]]), ' ') AS material, 'a ' || lower(p_name) || ' of ' || lower(p_brand) AS body
FROM (SELECT *, list_concat(coalesce(m[lower(p_type)], [replace(lower(p_type), '-', ' ')]), coalesce(m[string_split(p_name, ' ')[2]], [string_split(p_name, ' ')[2]])) AS l FROM part, s)""")
def search_fields(read):
    """The four fields of parts, synonyms included."""
    second = F.split("p_name", " ")[1]
    fields = upkeep.search_fields(F.col("p_name"), F.lit(None).cast("string"), [F.lower("p_type")], [F.array(second)], F.concat(F.lit("100% "), "p_brand"), F.array(second), F.lit(None).cast("array<string>"), F.concat(F.lit("A  "), "p_name", F.lit(" of "), "p_brand"), F.lit(None).cast("string"), {"small": ("mini", "small"), "ring": ("band", "ring")})
    return read("part").select("p_partkey", fields.alias("f")).select("p_partkey", "f.*")
