"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text as t
from ..operators import facets, material
from ..sources import pages, tables
from .query import query

_RULES = [(t.whole_words(["ring", "bolt", "rod"]), "fastener"), (t.whole_words(["gear", "widget"]), "part"), (t.whole_words(["red", "blue"]), "coloured")]
_W = r"(?i)\b(?:{})\b"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '{_W.format('ring|bolt|rod')}') THEN 'fastener' WHEN regexp_matches(p_name, '{_W.format('gear|widget')}') THEN 'part' WHEN regexp_matches(p_name, '{_W.format('red|blue')}') THEN 'coloured' END AS class FROM part")
def first_match_classify(read):
    return read("part").select("p_partkey", arrays.first_match(F.col("p_name"), _RULES).alias("class"))


@query(f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '{_W.format('ring|bolt|rod')}') THEN 'fastener' END, CASE WHEN regexp_matches(p_name, '{_W.format('gear|widget')}') THEN 'part' END, CASE WHEN regexp_matches(p_name, '{_W.format('red|blue')}') THEN 'coloured' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def all_match_tags(read):
    return read("part").select("p_partkey", F.array_join(arrays.all_matches(F.col("p_name"), _RULES), ",").alias("tags"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:the|der|la)\b') AS article, regexp_matches(text, '(?i)\b(?:thing|tion)s?\b') AS noun FROM documents")
def regex_rules(read):
    return read("documents").select("doc_id", F.col("text").rlike(t.whole_words(["the", "der", "la"])).alias("article"), F.col("text").rlike(t.whole_words(["thing", "tion"], True)).alias("noun"))


@query("SELECT doc_id, lower(nullif(regexp_extract(text, '(?i)licensed under (?:the )?([A-Za-z]+)', 1), '')) AS licence FROM documents")
def labelled_block(read):
    return read("documents").select("doc_id", F.lower(F.nullif(F.regexp_extract("text", "(?i)licensed under (?:the )?([A-Za-z]+)", 1), F.lit(""))).alias("licence"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def props_json(read):
    return read("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_KEYS = ("Sleeve Length", "Pattern Type", "Style", "Length", "Fit", "Type")


@query("""WITH b AS (SELECT p_partkey, '- Style: ' || p_type || ' - Sleeve Length: A-Line ' || p_name || ' Type : ' || p_brand || ' - Fit: - LENGTH: size ' || p_size || ' - style: ' || lower(p_name) AS block FROM part),
s AS (SELECT p_partkey, string_split(regexp_replace(block, '(?i)(Sleeve Length|Pattern Type|Length|Style|Type|Fit)\\s*:', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS pieces FROM b),
e AS (SELECT p_partkey, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS p FROM s),
v AS (SELECT p_partkey, i, lower(split_part(p, chr(2), 1)) AS key, trim(regexp_replace(regexp_replace(split_part(p, chr(2), 2), '[\\s-]+$', ''), '^[\\s-]+', '')) AS value FROM e)
SELECT p_partkey, key, arg_max(value, i) AS value FROM v WHERE value <> '' GROUP BY 1, 2""")
def kv_block_parse(read):
    """Blocks made of a part's fields: hyphens in values, a lost separator, a blank and a repeated key."""
    block = F.concat(F.lit("- Style: "), "p_type", F.lit(" - Sleeve Length: A-Line "), "p_name", F.lit(" Type : "), "p_brand", F.lit(" - Fit: - LENGTH: size "), "p_size", F.lit(" - style: "), F.lower("p_name"))
    rows = tables.spread(read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    return rows.select("p_partkey", F.explode(t.key_values(block, _KEYS)))


@query("SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 'signet' WHEN contains(p_name, 'widget') THEN 'device' WHEN contains(p_name, 'gear') THEN 'wheel' WHEN contains(p_name, 'ring') THEN 'circle' END AS found FROM part")
def dict_lookup_longest(read):
    table = {"red ring": "signet", "ring": "circle", "gear": "wheel", "widget": "device"}
    parts = sorted((k for k in table if " " not in k), key=lambda k: (-len(k), k))
    found = F.coalesce(F.when(F.col("p_name") == "red ring", table["red ring"]), *(F.when(F.contains("p_name", F.lit(k)), table[k]) for k in parts))
    return read("part").select("p_partkey", found.alias("found"))


@query("SELECT p_partkey, CASE WHEN string_split(p_name, ' ')[1] IN ('red', 'blue') THEN string_split(p_name, ' ')[1] END AS colour FROM part")
def first_token_vocab(read):
    return read("part").select("p_partkey", arrays.coerce(F.split("p_name", " ")[0], ["red", "blue"]).alias("colour"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) IN ('small', 'medium', 'large') THEN lower(p_type) END AS kind FROM part")
def vocab_coerce(read):
    return read("part").select("p_partkey", arrays.coerce(F.col("p_type"), ["small", "medium", "large"]).alias("kind"))


@query("SELECT p_partkey, array_to_string(list_filter([lower(p_type), string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda x: x IN ('small', 'large', 'red', 'ring')), ',') AS kinds FROM part WHERE lower(p_type) <> string_split(p_name, ' ')[1]")
def vocab_coerce_array(read):
    values = F.concat(F.array("p_type"), F.split("p_name", " "))
    rows = read("part").where(F.lower("p_type") != F.split("p_name", " ")[0])
    return rows.select("p_partkey", F.array_join(arrays.coerce_many(values, ["small", "large", "red", "ring"]), ",").alias("kinds"))


@query("SELECT doc_id, len(string_split(text, ' ')) <= 12 AS short, len(regexp_extract_all(text, '[0-9]+ ?%')) >= 2 AS shares, regexp_matches(lower(text), '\\b(?:the|is|with)\\b') AND len(string_split(text, ' ')) > 12 AND len(regexp_extract_all(text, '[0-9]+ ?%')) < 2 AS prose FROM documents")
def prose_detect(read):
    n, k = F.size(F.split("text", " ")), F.regexp_count("text", F.lit("[0-9]+ ?%"))
    return read("documents").select("doc_id", (n <= 12).alias("short"), (k >= 2).alias("shares"), (F.lower("text").rlike(t.whole_words(["the", "is", "with"])) & (n > 12) & (k < 2)).alias("prose"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 3) AS share, sum(l_quantity) < 90 AS incomplete FROM lineitem GROUP BY l_orderkey")
def weighted_share(read):
    q = F.col("l_quantity")
    return read("lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0)) / F.sum(q), 3).alias("share"), (F.sum(q) < 90).alias("incomplete"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS resolved, CASE WHEN l.quality IS NOT NULL AND (l.quality = 1) <> (d.n_chars > 1000) THEN 'length' ELSE '' END AS conflicts FROM documents d LEFT JOIN labels l USING (doc_id)")
def resolve_conflicts(read):
    j = read("documents").join(read("labels"), "doc_id", "left")
    resolved = F.coalesce(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"), "lang")
    clash = arrays.conflicts([("length", F.col("quality") == 1, F.col("n_chars") > 1000)])
    return j.select("doc_id", resolved.alias("resolved"), F.array_join(clash, ",").alias("conflicts"))


@query("SELECT p_partkey, lower(p_name) AS title, concat_ws(' ', lower(p_type), 'size', p_size) AS attrs, lower(p_brand) AS material FROM part")
def render_fields(read):
    return read("part").select("p_partkey", F.lower("p_name").alias("title"), F.concat_ws(" ", F.lower("p_type"), F.lit("size"), "p_size").alias("attrs"), F.lower("p_brand").alias("material"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN regexp_extract(text, '(?s)^(.{0,600})(?: |$)', 1) <> '' THEN regexp_extract(text, '(?s)^(.{0,600})(?: |$)', 1) ELSE left(text, 600) END AS body FROM documents")
def truncate_word(read):
    return read("documents").select("doc_id", t.truncate_words(F.col("text"), 600).alias("body"))


@query("SELECT doc_id, trim(string_split(text, '|')[1]) AS name, nullif(trim(coalesce(string_split(text, '|')[2], '')), '') AS variant FROM documents WHERE length(trim(string_split(text, '|')[1])) < 200")
def name_variant_split(read):
    parts = F.split("text", r"\|")
    out = read("documents").select("doc_id", F.trim(parts[0]).alias("name"), F.nullif(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("")).alias("variant"))
    return out.where(F.length("name") < 200)


_URL = "regexp_replace(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)), '^http:', 'https:') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, {_URL} || CASE WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' THEN '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) ELSE '' END AS url FROM pages")
def url_normalise(read):
    return read("pages").select("page_id", t.canonical_url(F.col("url"), ("page",)).alias("url"))


@query(f"SELECT {_URL} AS url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def canonical_url_dedupe(read):
    return read("pages").groupBy(t.canonical_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, round(regexp_extract(replace(printf('USD %.2f', p_retailprice * 3), ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1)::DOUBLE * 100)::INTEGER AS cents FROM part")
def parse_price(read):
    return read("part").select("p_partkey", t.price_cents(F.format_string("USD %,.2f", F.col("p_retailprice") * 3)).alias("cents"))


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM part")
def slugify(read):
    return read("part").select("p_partkey", t.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("SELECT p_partkey, CASE WHEN 150 + p_size BETWEEN 120 AND 220 THEN 150 + p_size END AS cm, round(5 * 30.48::DOUBLE + (p_size % 12) * 2.54::DOUBLE)::INTEGER AS from_feet FROM part")
def height_parse(read):
    metric = F.concat(F.lit("model is "), F.col("p_size") + 150, F.lit("cm"))
    feet = F.concat(F.lit("5'"), F.col("p_size") % 12, F.lit('"'))
    return read("part").select("p_partkey", t.height_cm(metric).alias("cm"), t.height_cm(feet).alias("from_feet"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'XL' WHEN p_size % 4 = 1 THEN p_size::VARCHAR WHEN p_size % 4 = 2 THEN 'ONE SIZE' END AS size FROM part")
def size_norm(read):
    raw = F.element_at(F.array(F.lit(" xl "), F.col("p_size").cast("string"), F.lit("one size"), F.lit("sku-99")), F.col("p_size") % 4 + 1)
    return read("part").select("p_partkey", t.size_label(raw).alias("size"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(replace(c_name, '#', '.')) || '+x@mail.example.com' END AS email FROM customer")
def email_normalise(read):
    raw = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.when(F.col("c_custkey") % 3 == 0, " at mail ").otherwise("+X@Mail.example.COM "))
    return read("customer").select("c_custkey", t.email(raw).alias("email"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'XL' ELSE lpad(p_size::VARCHAR, 3, '0') END AS size FROM part")
def zero_pad_strip(read):
    raw = F.when(F.col("p_size") % 2 == 0, "00XL").otherwise(F.lpad(F.col("p_size").cast("string"), 3, "0"))
    return read("part").select("p_partkey", t.unpadded_size(raw).alias("size"))


@query("SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))[1], list_filter(string_split(text, chr(10)), lambda x: len(x) > 80)[1]) AS line FROM documents")
def line_priority_pick(read):
    lines = F.split("text", "\n")
    pick = lambda f: F.get(F.filter(lines, f), F.lit(0))
    return read("documents").select("doc_id", F.coalesce(pick(lambda x: F.contains(x, F.lit("|"))), pick(lambda x: F.length(x) > 80)).alias("line"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+')[-1] AS last_number FROM documents")
def last_match_pick(read):
    return read("documents").select("doc_id", F.try_element_at(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), F.lit(-1)).alias("last_number"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))) AS link FROM pages")
def html_link_extract(read):
    return read("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1)))).alias("link"))


@query("SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS block, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs FROM pages")
def html_block_extract(read):
    return read("pages").select("page_id", F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1).alias("block"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query("SELECT sha256(html) AS content_id, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def content_address(read):
    return read("pages").groupBy(F.sha2("html", 256).alias("content_id")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, regexp_full_match(CASE WHEN page_id % 2 = 0 THEN sha256(url) ELSE url END, '[a-f0-9]{64}') AS valid FROM pages")
def hash_id_predicate(read):
    return read("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.sha2("url", 256)).otherwise(F.col("url")).rlike("^[a-f0-9]{64}$").alias("valid"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(page=|#top|/25)')")
def url_deny_regex(read):
    return read("pages").where(~F.col("url").rlike("(page=|#top|/25)")).select("page_id", "url")


@query("""WITH x AS (SELECT p_partkey, p_partkey % 6 AS shape, p_size + 40 AS a, 60 - p_size AS b FROM part)
SELECT p_partkey, CASE shape WHEN 0 THEN CASE WHEN a >= b THEN 'cotton' ELSE 'elastane' END WHEN 1 THEN CASE WHEN a >= b THEN 'polyester' ELSE 'wool' END WHEN 2 THEN 'silk' WHEN 4 THEN 'linen' END AS primary_fiber,
  CASE shape WHEN 0 THEN round(a / 100.0::DOUBLE, 3) WHEN 1 THEN round(b / 100.0::DOUBLE, 3) WHEN 2 THEN 1.0::DOUBLE WHEN 4 THEN 1.0::DOUBLE END AS natural_ratio, shape = 3 AND a < 90 AS incomplete,
  CASE shape WHEN 0 THEN CASE WHEN a >= b THEN a || '% cotton, ' || b || '% elastane' ELSE b || '% elastane, ' || a || '% cotton' END WHEN 1 THEN CASE WHEN a >= b THEN a || '% polyester, ' || b || '% wool' ELSE b || '% wool, ' || a || '% polyester' END WHEN 2 THEN '100% silk' WHEN 3 THEN a || '% nylon' WHEN 4 THEN '100% linen' END AS clean,
  CASE shape WHEN 0 THEN 'white' WHEN 2 THEN '' ELSE '' END AS colors, CASE shape WHEN 4 THEN 'jersey' WHEN 5 THEN 'chiffon' ELSE '' END AS fabric, (CASE shape WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 5 THEN 0 ELSE 1 END)::INTEGER AS n
FROM x WHERE NOT (shape = 3 AND a >= 90)""")
def material_parse(read):
    """Compositions of six shapes made of a part's fields: shares first with components, shares last, a bare name, a rest of one, prose, a fabric."""
    a, b, shape = F.col("p_size") + 40, 60 - F.col("p_size"), F.col("p_partkey") % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("[01 WHITE] Shell: "), a, F.lit("% Cotton, "), b, F.lit("% Spandex/ Lining: 100% Polyester [Other Colors] Shell: 50% Silk, 50% Wool Imported")))
        .when(shape == 1, F.concat(F.lit("Polyester "), a, F.lit(".0%, Wool "), b, F.lit(".0%"))).when(shape == 2, "Silk.").when(shape == 3, F.concat(a, F.lit("% Polyamide")))
        .when(shape == 4, F.lit("A long sentence that tells of a light and airy dress made with 100% linen jersey of the best kind")).otherwise("Georgette")
    )
    rows = tables.spread(read("part").where(~((shape == 3) & (a >= 90))).select("p_partkey", "p_size"), "p_partkey")
    m = material.parse_material(rows, text, "m")
    return m.select("p_partkey", "m.primary_fiber", "m.natural_ratio", "m.incomplete", "m.clean", F.array_join("m.colors", ",").alias("colors"), F.array_join("m.fabric", ",").alias("fabric"), F.size("m.fibers").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size + 40) || '% certified organic cotton, ' || (60 - p_size) || '% ' || lower(p_type) WHEN 1 THEN '92% coton' END AS composition FROM part")
def prose_composition(read):
    """Compositions found in copy made of a part's fields, in two languages, beside a price cut that is none."""
    third = F.col("p_partkey") % 3
    copy = (
        F.when(third == 0, F.concat(F.lit("30% off: "), F.col("p_size") + 40, F.lit("% certified organic cotton, "), 60 - F.col("p_size"), F.lit("% "), F.lower("p_type"), F.lit(" Machine wash cold.")))
        .when(third == 1, F.concat(F.col("p_name"), F.lit(" en 92% coton / Made in Portugal"))).otherwise(F.concat(F.lit("50% off cotton "), "p_name"))
    )
    return read("part").select("p_partkey", material.composition_in_prose(copy).alias("composition"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN p_name END AS name, CASE WHEN p_partkey % 5 < 4 THEN 'sku' || p_partkey END AS sku,
  CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '12.5' WHEN 2 THEN (p_size + 1)::VARCHAR END AS price, CASE p_partkey % 5 WHEN 0 THEN 'S,M' WHEN 1 THEN 'L' WHEN 3 THEN 'XS,XL' ELSE '' END AS sizes FROM part""")
def json_ld_products(read):
    """Pages made of a part's fields around JSON-LD: one node, a list behind a malformed block, @graph with an aggregate offer, a group with variants, none of a product."""
    name = F.to_json(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("sku"), "p_partkey").alias("sku")))
    head = F.regexp_replace(name, r"\}$", "")  # an open object
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    fifth = F.col("p_partkey") % 5
    html = (
        F.when(fifth == 0, script(head, F.lit(', "@type": "Product", "offers": [{"price": '), F.col("p_size").cast("string"), F.lit(', "size": "S"}, {"price": 9, "size": "M"}, {"size": "S"}]}')))
        .when(fifth == 1, F.concat(script(F.lit('{"@type": "Product", broken')), script(F.lit('[{"@type": "Organization"}, '), head, F.lit(', "@type": ["Thing", "Product"], "offers": {"price": "12.5", "size": "L"}}]'))))
        .when(fifth == 2, script(F.lit('{"@graph": [{"@type": "WebPage"}, '), head, F.lit(', "@type": "Product", "offers": {"lowPrice": "'), (F.col("p_size") + 1).cast("string"), F.lit('", "highPrice": "99"}}]}')))
        .when(fifth == 3, script(head, F.lit(', "@type": "ProductGroup", "hasVariant": [{"size": "XS"}, {"size": "XL"}, {"size": " "}]}'))).otherwise(script(F.lit('{"@type": "BreadcrumbList", "name": "no"}')))
    )
    found = read("part").select("p_partkey", pages.product(F.concat(F.lit("<html><head>"), html, F.lit("</head></html>"))).alias("p"))
    return found.select("p_partkey", "p.name", "p.sku", "p.price", F.coalesce(F.array_join("p.sizes", ","), F.lit("")).alias("sizes"))


@query("SELECT lang, url FROM (SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, url, row_number() OVER (PARTITION BY regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) ORDER BY page_id) AS n FROM pages WHERE regexp_matches(url, '/[0-9]+$') AND NOT contains(url, '/blog')) WHERE n <= 5")
def sitemap_urls(read):
    """A sitemap for each language of the pages; the first five addresses that end in a number."""
    by = read("pages").groupBy(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("of"))  # addresses of the saved pages of a language: one file's worth
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform("of", lambda p: F.concat(F.lit("<url><loc> "), p["url"], F.lit("</loc></url>"))), "\n"), F.lit("</urlset>"))
    return by.select("lang", F.explode(pages.sitemap_links(xml, r"/[0-9]+$", "/blog", 5)).alias("url"))


@query("""WITH x AS (SELECT p_partkey, p_size % 6 AS k, p_partkey % 2 = 1 AS told, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'dress' WHEN k IN (1, 5) THEN 'bottom' WHEN k = 2 THEN 'top' WHEN k = 3 THEN 'outerwear' WHEN told AND b = 'ring' THEN 'accessory' END AS category,
  CASE k WHEN 0 THEN 'mini-dress' WHEN 1 THEN 'shorts' WHEN 2 THEN 't-shirt' WHEN 3 THEN 'coat' WHEN 5 THEN 'skirt' END AS subcategory, CASE k WHEN 0 THEN 'sweetheart' WHEN 2 THEN 'mock-neck' END AS neckline, CASE k WHEN 0 THEN 'mini' WHEN 5 THEN 'midi' END AS length,
  CASE WHEN told THEN 'fitted' END AS fit, CASE WHEN k = 5 THEN 'wrap' WHEN told THEN 'slim' END AS silhouette, CASE WHEN told THEN 'high-rise' END AS rise,
  array_to_string(list_filter([CASE WHEN k = 1 THEN 'denim' END, CASE WHEN a IN ('red', 'blue') THEN a END], lambda v: v IS NOT NULL), ',') AS colors, CASE WHEN told THEN 'pockets' ELSE '' END AS details, CASE WHEN k = 3 THEN 'winter' ELSE '' END AS season FROM x""")
def garment_facets(read):
    """Names and copy made of a part's fields, through all rule tables; labelled blocks override."""
    words = F.split("p_name", " ")
    kinds = F.array(*map(F.lit, ("Sweetheart Neck Mini Dress", "Denim Shorts", "High Neck T-Shirt", "Puffer Vest", "Waver", "Wrap Midi Skirt")))
    name = F.concat_ws(" ", F.initcap(words[0]), F.get(kinds, F.col("p_size") % 6))
    copy = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("For any "), words[1], F.lit(", with pockets and a white lining. Fit: Slim. Rise: High rise.")))
    part = tables.spread(read("part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = part.select("p_partkey", facets.facets(name, copy).alias("f"), facets.labelled_facets(copy).alias("l")).select("p_partkey", facets.overridden(F.col("f"), F.col("l"), ["fit", "rise", "neckline"]).alias("f"))
    return rows.select("p_partkey", *(f"f.{c}" for c in ("category", "subcategory", "neckline", "length", "fit", "silhouette", "rise")), *(F.array_join(f"f.{c}", ",").alias(c) for c in ("colors", "details", "season")))


_TABLES = {"silhouette": {"ring": "round", "rod": "straight"}, "neckline": {}, "sleeve": {}, "pattern": {"red": "warm", "blue": "cold", "cold": "cold"}, "waist": {}, "position": {}, "shoulder": {}, "detail": {"gear": "toothed", "bolt": "threaded", "widget": "moving"}, "occasion": {"promo": "sale", "small": "travel"}, "season": {}}


@query("""WITH x AS (SELECT p_partkey, lower(p_type) AS t, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_size FROM part)
SELECT p_partkey, CASE b WHEN 'ring' THEN 'round' WHEN 'rod' THEN 'straight' END AS silhouette, CASE a WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cold' WHEN 'cold' THEN 'cold' END AS pattern, CASE WHEN p_size > 25 THEN 'fitted' ELSE 'regular' END AS fit,
  CASE b WHEN 'gear' THEN 'toothed' WHEN 'bolt' THEN 'threaded' WHEN 'widget' THEN 'moving' ELSE '' END AS details, CASE t WHEN 'promo' THEN 'sale' WHEN 'small' THEN 'travel' ELSE '' END AS occasion, 'Steel ' || p_size || '%' AS composition FROM x""")
def kv_facets(read):
    """Key-value blocks made of a part's fields, with facets that stand under a second key."""
    empty = {n: t or {"-": "-"} for n, t in _TABLES.items()}
    words = F.split("p_name", " ")
    block = F.concat(F.lit("- Style: "), "p_type", F.lit(" - Dress Type: old "), words[1], F.lit(" - Material: "), words[0], F.lit("/Gold - Embellishment: "), words[1], F.lit("s, none - Fabric Stretch: "), F.when(F.col("p_size") > 25, "High").otherwise("No"), F.lit(" stretch - Fabric: Steel "), "p_size", F.lit("%"))
    found = facets.block_facets(t.key_values(block, ("Fabric Stretch", "Dress Type", "Embellishment", "Material", "Fabric", "Style")), empty, ["gold"])
    rows = tables.spread(read("part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    return rows.select("p_partkey", found.alias("f")).select("p_partkey", "f.silhouette", "f.pattern", "f.fit", F.array_join("f.details", ",").alias("details"), F.array_join("f.occasion", ",").alias("occasion"), "f.composition")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 150 + p_size WHEN p_size % 3 = 1 THEN round(5 * 30.48 + (p_size % 12) * 2.54)::INTEGER END AS height_cm, CASE WHEN p_size % 4 > 0 THEN p_type END AS size FROM part WHERE p_size % 4 > 0
UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 4 = 0""")
def model_fit(read):
    """What a model wears, from copy made of a part's fields: metric heights, feet and inches, neither, and no such sentence."""
    size = F.col("p_size")
    height = F.when(size % 3 == 0, F.concat(150 + size, F.lit("cm"))).when(size % 3 == 1, F.concat(F.lit("5'"), size % 12, F.lit('"'))).otherwise("tall")
    copy = F.concat(F.lit("A "), "p_name", F.lit(". "), F.when(size % 4 > 0, F.concat(F.lit("The model is wearing a size "), "p_type", F.lit(" and is "), height, F.lit(". "))).otherwise(F.concat(F.lit("Height "), height, F.lit(". "))), F.lit("Wash cold."))
    return read("part").select("p_partkey", pages.model_fit(copy).alias("m")).select("p_partkey", "m.height_cm", "m.size")


_IMAGE = r'https://media\.example/img/[^"/]*/PRD/([^/"]+)/([^/"]+)/([^"]+)'


@query("""WITH x AS (SELECT p_partkey, 'p' || p_size AS id, string_split(p_name, ' ')[1] AS a, p_size % 2 = 0 AS known FROM part)
SELECT p_partkey, array_to_string(list_concat([id || '/' || a || '/x.1.jpg'], CASE WHEN known THEN []::VARCHAR[] ELSE [id || '/other/x.1.jpg'] END, [id || '/' || a || '/x.2.jpg', id || '/' || a || '/plain.jpg']), ',') AS images FROM x""")
def gallery(read):
    """The images of one product out of a page made of a part's fields: other products, other colours, repeats and cache tokens."""
    words, own = F.split("p_name", " "), F.concat(F.lit("p"), "p_size")
    image = lambda transform, product, color, file: F.concat(F.lit(f'<img src="https://media.example/img/{transform}/PRD/'), product, F.lit("/"), color, F.lit(f'/{file}">'))
    html = F.concat(image("a", own, words[0], "plain.jpg"), image("a", own, words[0], "x.2.jpg"), image("a", F.lit("else"), words[0], "x.0.jpg"), image("b", own, words[0], "x.1.jpg?_s=T"), image("c", own, words[0], "x.1.jpg"), image("a", own, F.lit("other"), "x.1.jpg"))
    color = F.when(F.col("p_size") % 2 == 0, words[0])
    return read("part").select("p_partkey", F.array_join(pages.gallery(html, _IMAGE, own, color), ",").alias("images"))
