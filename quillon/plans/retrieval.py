"""Retrieval queries: index statistics, BM25 in its forms, phrases, gates and expansion."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import expand, first_match
from ..functions.stem import duck_stem
from ..functions.text import ENTITIES, html_text, tokens, whole_words
from ..operators import evaluation as e
from ..operators import index, ranking, search
from ..operators import retrieval as r
from ..sources import tables
from .query import query

_TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_INDEX = f"""
tk AS (SELECT doc_id, lang, source, {_TOK.format('text')} AS ts FROM documents),
ix AS (SELECT doc_id, lang, source, len(ts) AS dl, unnest(ts) AS term FROM tk),
po AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS tf, any_value(dl) AS dl FROM ix GROUP BY doc_id, term),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl) AS avgdl FROM (SELECT doc_id, any_value(dl) AS dl FROM ix GROUP BY doc_id)),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT item_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, any_value(lang) AS lang, any_value(source) AS source,
  sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY 1, 2)"""
_TOP = "SELECT item_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {}) WHERE rank <= 120{}"


def _documents(read, analyzer="none"):
    """The stored index of documents: written by the first query that asks, read by all others."""
    return index.open_index(read("documents"), "doc_id", {"text": F.col("text")}, ["lang", "source", F.lit(True).alias("active")], analyzer)


def _requests(read, expanded=None):
    return read("benchmark").select("item_id", "text", F.lit(expanded).cast("string").alias("expanded"))


def _scores(read, idx, expanded=None, analyzer="none"):
    terms = search.weighted(idx, search.request_terms(_requests(read, expanded), "item_id", analyzer), "item_id", {"text": 1.0})
    return search.parts(idx, terms, "item_id").withColumnRenamed("part", "score")


def _ranked(scores, k=120, floor=None):
    """Ranks go by the rounded score, so that sums in another order leave them as they are."""
    out = r.top_k(scores.withColumn("score", F.round("score", 6)), "item_id", "doc_id", k, floor)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(f"WITH {_INDEX} SELECT count(*) AS postings, (SELECT count(*) FROM df) AS terms, any_value(n_docs)::BIGINT AS n_docs, round(any_value(avgdl), 6) AS avgdl, sum(tf)::BIGINT AS tokens FROM po, st")
def bm25_index_stats(read):
    idx = _documents(read)
    sums = idx.terms.agg(F.sum("df").alias("postings"), F.count(F.lit(1)).alias("terms"))
    return sums.crossJoin(F.broadcast(idx.fields.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "tokens")))  # one row each


@query(f"WITH {_INDEX} " + _TOP.format("sc", ""))
def bm25_topk(read):
    return _ranked(_scores(read, _documents(read)))


@query(f"WITH {_INDEX} " + _TOP.format("sc", " AND round(score, 6) >= 8"))
def bm25_topk_floor(read):
    return _ranked(_scores(read, _documents(read)), floor=8.0)


@query(f"WITH {_INDEX} " + _TOP.format("(SELECT * FROM sc WHERE lang = 'en' AND source <> 'src0')", ""))
def bm25_filtered(read):
    """The filter is a join inside the index's buckets, before any score is summed."""
    idx = _documents(read)
    allowed = idx.rows.where((F.col("lang") == "en") & (F.col("source") != "src0")).select("doc_id")
    return _ranked(_scores(read, replace(idx, postings=idx.postings.join(allowed.hint("shuffle_hash"), "doc_id", "left_semi"))))


@query(f"""WITH {_INDEX},
ex AS (SELECT item_id, term, sum(w) AS w FROM (SELECT * FROM qt UNION ALL SELECT item_id, unnest(['tion', 'the']) AS term, 0.6::DOUBLE FROM benchmark) GROUP BY 1, 2),
s2 AS (SELECT item_id, doc_id, sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM po JOIN df USING (term) JOIN ex USING (term), st GROUP BY 1, 2) """ + _TOP.format("s2", ""))
def bm25_expanded(read):
    return _ranked(_scores(read, _documents(read), "tion the"))


def _stem_index():
    """_INDEX over English stems; w ends with the stems of all terms of documents and benchmark."""
    terms = f"(SELECT term FROM ix UNION SELECT unnest({_TOK.format('text')}) AS term FROM benchmark)"
    score = "sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))"
    return f"""{_INDEX.rpartition("df AS (")[0].rstrip().rstrip(",")},
{duck_stem(terms)},
sp AS (SELECT doc_id, stem AS term, sum(tf) AS tf, any_value(dl) AS dl FROM po JOIN stems USING (term) GROUP BY 1, 2),
sd AS (SELECT term, count(*) AS df FROM sp GROUP BY term),
sq AS (SELECT item_id, stem AS term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) JOIN stems USING (term) GROUP BY 1, 2),
ss AS (SELECT item_id, doc_id, {score} AS score FROM sp JOIN sd USING (term) JOIN sq USING (term), st GROUP BY 1, 2)"""


@query(f"WITH {_stem_index()} " + _TOP.format("ss", ""))
def bm25_stemmed(read):
    return _ranked(_scores(read, _documents(read, "english"), analyzer="english"))


_PART = {
    "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)", "attrs": "regexp_replace(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<[^>]*>', ' ', 'g')", "url": "url",
    "body": "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>|&[a-z]+;', ' ', 'g')",
}
_PAGES = f"""
pt AS ({" UNION ALL ".join(f"SELECT page_id, '{n}' AS field, {_TOK.format(c)} AS ts FROM pages" for n, c in _PART.items())}),
px AS (SELECT page_id, field, len(ts) AS dl, unnest(ts) AS term FROM pt),
pp AS (SELECT page_id, field, term, count(*) AS tf, any_value(dl) AS dl FROM px GROUP BY 1, 2, 3),
ps AS (SELECT field, count(*)::DOUBLE AS n_docs, avg(dl) AS avgdl FROM (SELECT page_id, field, any_value(dl) AS dl FROM px GROUP BY 1, 2) GROUP BY 1),
pd AS (SELECT field, term, count(*) AS df FROM pp GROUP BY 1, 2),
pq AS (SELECT item_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
pa AS (SELECT item_id, page_id, field, sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS part
  FROM pp JOIN pd USING (field, term) JOIN ps USING (field) JOIN pq USING (term) GROUP BY 1, 2, 3)"""
_LANG, _NUMBER = '<html lang="([a-z]+)"', "/([0-9]+)(?:[?#]|$)"


def _pages(read):
    fields = {
        "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "attrs": F.regexp_replace(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), "<[^>]*>", " "), "url": F.col("url"),
        "body": F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]*>|&[a-z]+;", " "),
    }
    stored = [F.regexp_extract("html", _LANG, 1).alias("brand"), F.regexp_extract("url", _NUMBER, 1).try_cast("int").alias("price_cents"), (~F.contains("url", F.lit("ref=x"))).alias("active")]
    return index.open_index(read("pages"), "page_id", fields, stored)


def _page_parts(read, boosts):
    """Parts with boosts of 1."""
    idx = _pages(read)
    return search.parts(idx, search.weighted(idx, search.request_terms(_requests(read), "item_id"), "item_id", dict.fromkeys(boosts, 1.0)), "item_id")


@query(f"WITH {_PAGES}, sc AS (SELECT item_id, page_id, sum(part * CASE field WHEN 'title' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM pa WHERE field IN ('title', 'url') GROUP BY 1, 2) SELECT item_id, rank, page_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, page_id) AS rank FROM sc) WHERE rank <= 20")
def bm25_multifield(read):
    boosts = {"title": 4.0, "url": 1.0}
    s = r.boosted(_page_parts(read, boosts), "item_id", "page_id", boosts).withColumn("score", F.round("score", 6))
    return r.top_k(s, "item_id", "page_id", 20).select("item_id", F.col("rank").cast("long").alias("rank"), "page_id", "score")


@query(f"""WITH {_PAGES},
rq AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN ' ' || lower(text) WHEN 1 THEN ' ' ELSE 'tion the que' END AS expanded, CASE WHEN item_id % 4 = 0 THEN ['en', 'fr'] END AS brands,
  CASE WHEN item_id % 4 = 1 THEN ['en'] END AS exclude_brands, CASE WHEN item_id % 2 = 0 THEN 100 END AS price_min, CASE WHEN item_id % 5 = 0 THEN 900 END AS price_max FROM benchmark),
rt AS (SELECT item_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM rq) GROUP BY 1, 2
  UNION ALL SELECT item_id, term, 0.6::DOUBLE * count(*) FROM (SELECT item_id, unnest({_TOK.format('expanded')}) AS term FROM rq WHERE trim(expanded) <> '' AND lower(trim(expanded)) <> lower(trim(text))) GROUP BY 1, 2),
rw AS (SELECT item_id, term, sum(w) AS w FROM rt GROUP BY 1, 2),
rd AS (SELECT page_id, regexp_extract(html, '{_LANG}', 1) AS brand, TRY_CAST(regexp_extract(url, '{_NUMBER}', 1) AS INTEGER) AS price, NOT contains(url, 'ref=x') AS active FROM pages),
sc AS (SELECT item_id, page_id, sum(CASE field WHEN 'title' THEN 4.0::DOUBLE WHEN 'attrs' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END * w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM pp JOIN pd USING (field, term) JOIN ps USING (field) JOIN rw USING (term) GROUP BY 1, 2),
al AS (SELECT sc.* FROM sc JOIN rd USING (page_id) JOIN rq USING (item_id) WHERE active AND (brands IS NULL OR list_contains(brands, brand)) AND (exclude_brands IS NULL OR NOT list_contains(exclude_brands, brand))
  AND (price_min IS NULL OR price >= price_min) AND (price_max IS NULL OR price <= price_max))
SELECT item_id, rank, page_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, page_id) AS rank FROM al) WHERE rank <= 120 AND round(score, 6) >= 2""")
def bm25_search(read):
    """Four boosted fields, expansion terms, brands of which any, excluded brands, a price range."""
    i = F.col("item_id")
    some = lambda test, value: F.when(test, value)
    requests = read("benchmark").select(
        "item_id", "text", F.when(i % 3 == 0, F.concat(F.lit(" "), F.lower("text"))).when(i % 3 == 1, " ").otherwise("tion the que").alias("expanded"), some(i % 4 == 0, F.array(F.lit("en"), F.lit("fr"))).alias("brands"),
        some(i % 4 == 1, F.array(F.lit("en"))).alias("exclude_brands"), some(i % 2 == 0, F.lit(100)).alias("price_min"), some(i % 5 == 0, F.lit(900)).alias("price_max"),
    )
    boosts = {"title": 4.0, "attrs": 2.5, "url": 1.0, "body": 1.0}
    return search.search(_pages(read), requests, "item_id", boosts, floor=r.FLOOR).select("item_id", F.col("rank").cast("long").alias("rank"), "page_id", "score")


_GRID = {"title": [3.0, 4.0, 5.0], "attrs": [1.5, 2.5, 3.5], "url": [0.5, 1.0, 1.5], "body": [0.5, 1.0]}


@query(f"""WITH {_PAGES},
g AS (SELECT t.b AS title, a.b AS attrs, u.b AS url, o.b AS body FROM (VALUES (3.0::DOUBLE), (4.0), (5.0)) t(b), (VALUES (1.5::DOUBLE), (2.5), (3.5)) a(b), (VALUES (0.5::DOUBLE), (1.0), (1.5)) u(b), (VALUES (0.5::DOUBLE), (1.0)) o(b)),
wd AS (SELECT item_id, page_id, coalesce(sum(part) FILTER (field = 'title'), 0) AS pt, coalesce(sum(part) FILTER (field = 'attrs'), 0) AS pa, coalesce(sum(part) FILTER (field = 'url'), 0) AS pu, coalesce(sum(part) FILTER (field = 'body'), 0) AS po FROM pa GROUP BY 1, 2),
sc AS (SELECT title, attrs, url, body, item_id, page_id, round(pt * title + pa * attrs + pu * url + po * body, 6) AS score FROM wd, g),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, attrs, url, body, item_id ORDER BY score DESC, page_id) AS rank FROM sc) WHERE rank <= 10),
j AS (SELECT item_id, page_id, least(3, count(*)) AS grade FROM pp JOIN pq USING (term) WHERE field = 'title' GROUP BY 1, 2),
k AS (SELECT title, attrs, url, body, item_id, sum((2 ** coalesce(grade, 0) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 2) AS hit FROM rk LEFT JOIN j USING (item_id, page_id) GROUP BY ALL),
i AS (SELECT item_id, sum((2 ** grade - 1) / log2(pos + 1)) FILTER (pos <= 10) AS ideal, count(*) FILTER (grade >= 2) AS n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC) AS pos FROM j) GROUP BY 1)
SELECT title, attrs, url, body, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(CASE WHEN n > 0 THEN coalesce(hit, 0) / n::DOUBLE END), 6) AS recall
FROM i CROSS JOIN g LEFT JOIN k USING (title, attrs, url, body, item_id) GROUP BY 1, 2, 3, 4""")
def boost_sweep(read):
    """54 boost vectors from one retrieval: every score is a weighted sum of the per-field parts. A page's grade is the number of query terms in its title, 3 at most."""
    found = tables.stored(search.sweep(_page_parts(read, _GRID), "item_id", "page_id", _GRID, 10), "found")  # ten rows a request and vector
    titles = _pages(read).postings.where("field = 'title'").select("page_id", "term")
    grades = titles.join(search.request_terms(_requests(read), "item_id").select("item_id", "term"), "term").groupBy("item_id", "page_id").agg(F.least(F.lit(3), F.count(F.lit(1))).alias("grade"))
    judged = tables.stored(grades, "grades")
    # grades are as many as pages times requests: they are counted for the ideal, and only those of found pages are joined
    counts = judged.groupBy("item_id").agg(*(F.count_if(F.col("grade") >= g).alias(f"n{g}") for g in (3, 2, 1)))
    at = lambda pos: F.when(F.col("n3") >= pos, 3).when(F.col("n2") >= pos, 2).when(F.col("n1") >= pos, 1).otherwise(0)
    ideal = counts.select("item_id", reduce(lambda x, y: x + y, (e.gain(at(pos)) / F.log2(F.lit(pos + 1)) for pos in range(1, 11))).alias("ideal"), F.col("n2").alias("n"))
    pairs = found.select("item_id", "page_id").distinct()
    hits = judged.join(F.broadcast(pairs), ["item_id", "page_id"], "left_semi")
    graded = found.join(hits.hint("merge"), ["item_id", "page_id"], "left")
    got = graded.groupBy("vector", "item_id").agg(e.dcg(F.coalesce("grade", F.lit(0)), F.col("rank")).alias("dcg"), F.count_if(F.col("grade") >= 2).alias("hit"))
    cases = ideal.withColumn("vector", F.explode(F.array(*(F.struct(*(F.lit(b).alias(n) for n, b in zip(_GRID, v))) for v in product(*_GRID.values())))))
    each = cases.join(got, ["vector", "item_id"], "left")
    recall = F.when(F.col("n") > 0, F.coalesce("hit", F.lit(0)) / F.col("n"))
    return each.groupBy("vector").agg(F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg"), F.round(F.avg(recall), 6).alias("recall")).select("vector.*", "ndcg", "recall")


@query(f"WITH tk AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), n AS (SELECT doc_id, len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) AS n FROM tk) SELECT doc_id, n::INTEGER AS n FROM n WHERE n > 0")
def phrase_match(read):
    return index.phrase(_documents(read), ["of", "the"], "text")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents) WHERE list_contains(ts, 'the') AND list_contains(ts, 'with') AND list_contains(ts, 'this')")
def conjunctive_match(read):
    return index.conjunctive(_documents(read), ["the", "with", "this"], "text")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 5000 AND source <> 'src1' GROUP BY lang")
def count_filtered(read):
    return read("documents").where(F.col("lang").isin("en", "de") & F.col("n_chars").between(500, 5000) & (F.col("source") != "src1")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\b(?:ring|bolt)s?\b') THEN 'small' WHEN regexp_matches(p_name, '(?i)\b(?:widget|gear)s?\b') THEN 'large' END AS grounded FROM part")
def type_grounding(read):
    rules = [(whole_words(["ring", "bolt"], True), "small"), (whole_words(["widget", "gear"], True), "large")]
    return read("part").select("p_partkey", first_match(F.col("p_name"), rules).alias("grounded"))


@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, sum((p_type = 'PROMO')::INT) OVER (PARTITION BY p_brand) AS k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 30) WHERE k < 5 OR p_type = 'PROMO'")
def type_gate(read):
    ranked = r.top_k(read("part").withColumnRenamed("p_retailprice", "score"), "p_brand", "p_partkey", 30)
    return ranking.type_gate(ranked, "p_brand", F.col("p_type") == "PROMO").select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query(r"""WITH b AS (SELECT DISTINCT p_brand FROM part),
q AS (SELECT p_brand, n, ['any promo-offer?', 'SALE bolts', 'quiet', 'a tiny thing', NULL][1 + n % 5] AS text, ['PROMO', 'PROMO', 'PROMO', NULL, 'SMALL'][1 + n % 5] AS wc, [NULL, 'bolt', NULL, 'small', NULL][1 + n % 5] AS ws FROM (SELECT p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER AS n FROM b)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 30),
t AS (SELECT r.p_brand, p_partkey, rank, text, wc, ws, CASE WHEN p_size % 10 > 0 THEN p_type END AS c, CASE WHEN p_size % 10 > 0 THEN string_split(p_name, ' ')[2] END AS s FROM r JOIN q USING (p_brand)),
f AS (SELECT *, coalesce(s = ws, false) OR (c IS NULL AND s IS NULL) OR coalesce(c = wc, wc IS NULL) AS fits,
  coalesce((wc = 'PROMO' AND regexp_matches(text, '(?i)(^|\W)(promo|sale|offer)(\W|$)')) OR (wc = 'SMALL' AND regexp_matches(text, '(?i)(^|\W)small(\W|$)')) OR (ws = 'bolt' AND regexp_matches(text, '(?i)(^|\W)bolt(\W|$)')) OR (ws = 'small' AND regexp_matches(text, '(?i)(^|\W)(mini|tiny|small)(\W|$)')), false) AS grounded FROM t)
SELECT p_brand, p_partkey, rank FROM (SELECT *, sum(fits::INT) OVER (PARTITION BY p_brand) AS n FROM f) WHERE fits OR NOT grounded OR n < 5""")
def intent_gate(read):
    """Lists of thirty parts of a brand, each with a request made of the brand's number: named, inferred and missing types."""
    n = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 5
    pick = lambda *values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), n)
    requests = read("part").select("p_brand").distinct().select("p_brand", pick("any promo-offer?", "SALE bolts", "quiet", "a tiny thing", None).alias("text"), pick("PROMO", "PROMO", "PROMO", None, "SMALL").alias("want_category"), pick(None, "bolt", None, "small", None).alias("want_subcategory"))
    typed = F.col("p_size") % 10 > 0
    ranked = r.top_k(read("part").withColumn("score", F.col("p_retailprice")), "p_brand", "p_partkey", 30).select("p_brand", "p_partkey", "rank", F.when(typed, F.col("p_type")).alias("category"), F.when(typed, F.split("p_name", " ")[1]).alias("subcategory"))
    return ranking.intent_gate(ranked, requests, "p_brand", {"PROMO": ("promo", "sale", "offer"), "small": ("mini", "tiny", "small")}).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


_SYN = {"small": ("mini", "tiny", "small"), "large": ("big", "large"), "promo": ("sale", "offer", "promo")}
_SYN_SQL = "MAP {'small': ['mini', 'tiny', 'small'], 'large': ['big', 'large'], 'promo': ['sale', 'offer', 'promo']}"


@query(f"SELECT p_partkey, array_to_string(coalesce({_SYN_SQL}[lower(p_type)], [lower(p_type)]), ' ') AS forms FROM part")
def synonym_expand(read):
    return read("part").select("p_partkey", F.array_join(expand(F.array(F.lower("p_type")), _SYN), " ").alias("forms"))


@query("SELECT p_partkey, list_sort(list_distinct(flatten([CASE WHEN contains(p_name, 'small') OR contains(p_name, 'mini') THEN ['mini', 'small', 'tiny'] ELSE []::VARCHAR[] END, CASE WHEN contains(p_name, 'large') OR contains(p_name, 'big') THEN ['big', 'large'] ELSE []::VARCHAR[] END]))) AS forms FROM part")
def lexical_expand(read):
    hit = lambda forms: F.when(F.exists(F.array(*map(F.lit, forms)), lambda w: F.contains(F.col("p_name"), w)), F.array(*map(F.lit, forms))).otherwise(F.array().cast("array<string>"))
    return read("part").select("p_partkey", F.array_sort(F.array_distinct(F.flatten(F.array(hit(("mini", "small", "tiny")), hit(("big", "large")))))).alias("forms"))


@query(f"SELECT item_id, list_filter({_TOK.format('text')}, lambda t: len(t) > 1)[1:20] AS terms FROM benchmark")
def sanitize_terms(read):
    return read("benchmark").select("item_id", F.slice(F.filter(tokens(F.col("text")), lambda t: F.length(t) > 1), 1, 20).alias("terms"))


@query(f"""WITH x AS (SELECT p_partkey, list_concat(list_filter({_TOK.format('p_name')}, lambda t: len(t) > 1), coalesce({_SYN_SQL}[lower(p_type)], [lower(p_type)])) AS ts FROM part)
SELECT p_partkey, array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), ' ') AS text FROM x""")
def expansion_text(read):
    """The terms of a query and the words of its expanded facets, in first-seen order."""
    terms = F.filter(tokens(F.col("p_name")), lambda t: F.length(t) > 1)
    words = F.flatten(F.transform(expand(F.array(F.lower("p_type")), _SYN), lambda w: F.split(w, " ")))
    return read("part").select("p_partkey", F.array_join(F.array_distinct(F.concat(terms, words)), " ").alias("text"))


@query("SELECT k AS cache_key, count(*) AS hits FROM (SELECT sha256('v1:' || trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS k FROM conversations WHERE role = 'user') GROUP BY k")
def cache_key_lookup(read):
    key = F.sha2(F.concat(F.lit("v1:"), F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))), 256)
    return read("conversations").where("role = 'user'").groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT p_partkey, concat_ws(' | ', p_name, lower(p_type), 'size ' || p_size, printf('%.2f', p_retailprice)) AS line FROM part")
def compact_render(read):
    return read("part").select("p_partkey", F.concat_ws(" | ", "p_name", F.lower("p_type"), F.concat(F.lit("size "), F.col("p_size")), F.format_string("%.2f", "p_retailprice")).alias("line"))


@query("SELECT p_partkey, replace(concat_ws(' ', lower(p_type), p_name, lower(p_brand)), '-', ' ') AS q FROM part")
def find_similar_query(read):
    return read("part").select("p_partkey", F.replace(F.concat_ws(" ", F.lower("p_type"), "p_name", F.lower("p_brand")), F.lit("-"), F.lit(" ")).alias("q"))


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE rtrim(regexp_replace(text, '(\\s*null)+$', '')) END AS t, role FROM conversations)
SELECT conv_id, turn, left(t, 90) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM x) WHERE rn = 1 AND t IS NOT NULL AND length(t) >= 8""")
def sanitize_rerank(read):
    """The first pick of each slot with a usable reason."""
    t = F.when(F.col("turn") % 3 != 0, F.rtrim(F.regexp_replace("text", r"(\s*null)+$", "")))
    rn = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return read("conversations").select("conv_id", "turn", t.alias("t"), rn.alias("rn")).where("rn = 1 and t is not null and length(t) >= 8").select("conv_id", "turn", F.substring("t", 1, 90).alias("reason"))


def _html_sql(html: str) -> str:
    """html_text() in DuckDB."""
    out = rf"regexp_replace(regexp_replace({html}, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    code = "CASE WHEN regexp_matches(p, '^[0-9]{1,7};') THEN TRY_CAST(regexp_extract(p, '^([0-9]{1,7});', 1) AS INTEGER) WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{1,6};') THEN TRY_CAST('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1) AS INTEGER) END"
    piece = f"CASE WHEN i = 1 THEN p WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) || regexp_replace(p, '^[^;]*;', '') ELSE '&#' || p END"
    out = f"array_to_string(list_transform(string_split({out}, '&#'), lambda p, i: {piece}), '')"
    for name, char in [*((n, c) for n, c in ENTITIES.items() if n != "amp"), ("amp", "&")]:
        out = "replace({}, '&{};', '{}')".format(out, name, char.replace("'", "''"))
    return rf"trim(regexp_replace({out}, '[\s\x{{A0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, {_html_sql('html')} AS text, {_html_sql('x')} AS title FROM (SELECT *, '<h1>' || chr(38) || '#' || (200 + page_id % 300) || '; ' || chr(38) || '#x' || to_hex(8400 + page_id % 40) || '; ' || chr(38) || '#99999999; ' || chr(38) || 'amp;lt; ' || url || '</h1>' AS x FROM pages)")
def html_strip(read):
    """The text of pages, and of headings with decimal, hexadecimal, impossible and double entities."""
    n = lambda of: (of).cast("string")
    head = F.concat(F.lit("<h1>&#"), n(200 + F.col("page_id") % 300), F.lit("; &#x"), F.hex(8400 + F.col("page_id") % 40), F.lit("; &#99999999; &amp;lt; "), F.col("url"), F.lit("</h1>"))
    return read("pages").select("page_id", html_text(F.col("html")).alias("text"), html_text(head).alias("title"))
