"""Offline readers of saved shop pages: embedded JSON-LD, sitemaps and product lists, as Column expressions and scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import height_cm

_BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def json_ld_blocks(html: Column) -> Column:
    """Texts of the embedded JSON-LD blocks, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(_BLOCK), 1), lambda b: F.trim(b))


def _list(value: Column) -> Column:
    """A variant as a list: an array's elements, or the one value; nothing for null."""
    many = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(many, F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)), F.array().cast("array<variant>"))


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _json_ld_nodes(html: Column) -> Column:
    """All nodes of all blocks, in order: a block is a node, a list of nodes or a node with @graph; malformed blocks are passed over."""

    def nodes(block: Column) -> Column:
        none = F.array().cast("array<variant>")
        return _with(F.try_parse_json(block), lambda v: F.concat(_list(v), F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), none)))

    return F.flatten(F.transform(json_ld_blocks(html), nodes))


def _first(nodes: Column, kind: str) -> Column:
    def is_kind(node: Column) -> Column:
        types = F.transform(_list(F.try_variant_get(node, "$['@type']", "variant")), lambda t: F.try_variant_get(t, "$", "string"))
        return F.coalesce(F.array_contains(types, kind), F.lit(False))

    return F.get(F.filter(nodes, is_kind), F.lit(0))


def json_ld_node(html: Column, kind: str = "Product") -> Column:
    """The first node of a type in any block; null without one."""
    return _first(_json_ld_nodes(html), kind)


def offers(node: Column) -> Column:
    """The offers of a node, of which single ones are no list."""
    return _list(F.try_variant_get(node, "$.offers", "variant"))


def offer_price(node: Column) -> Column:
    """The price text: the first offer's price, else its lowest, else its highest, in either spelling."""
    first = F.get(offers(node), F.lit(0))
    return F.coalesce(*(F.try_variant_get(first, f"$.{name}", "string") for name in ("price", "lowprice", "lowPrice", "highprice", "highPrice")))


def sizes(node: Column) -> Column:
    """Size texts of the offers; of the variants where no offer has one; of the group that a variant belongs to where these have none. Each once, in order."""

    def named(items: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(items, lambda o: F.try_variant_get(o, "$.size", "string")), lambda s: s.isNotNull() & (F.trim(s) != "")))

    levels = [named(offers(node)), named(_list(F.try_variant_get(node, "$.hasVariant", "variant"))), named(_list(F.try_variant_get(node, "$.isVariantOf.hasVariant", "variant")))]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in levels), F.array().cast("array<string>"))


def product(html: Column) -> Column:
    """name, sku, price (text), sizes of the page's product, or of its product group where it has no product; null without both."""

    def read(node: Column) -> Column:
        fields = [F.try_variant_get(node, f"$.{n}", "string").alias(n) for n in ("name", "sku")]
        return F.when(node.isNotNull(), F.struct(*fields, offer_price(node).alias("price"), sizes(node).alias("sizes")))

    return _with(_with(_json_ld_nodes(html), lambda nodes: F.coalesce(_first(nodes, "Product"), _first(nodes, "ProductGroup"))), read)


def blocked(name: Column, title: Column) -> Column:
    """Whether a page is no product page: without a name, or a page that refuses the visitor."""
    return F.coalesce(F.trim(name) == "", F.lit(True)) | F.coalesce(title.rlike(r"(?i)access denied|are you a human|robot|captcha"), F.lit(False))


def sitemap_links(xml: Column, keep: str, skip: str | None = None, most: int | None = None) -> Column:
    """Addresses of a sitemap that match `keep` and not `skip`, the first `most`."""
    links = F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>([^<]+)</loc>"), 1), lambda u: F.trim(u))
    kept = F.filter(links, lambda u: u.rlike(keep) & (~u.rlike(skip) if skip else F.lit(True)))
    return kept if most is None else F.slice(kept, 1, most)


def read_product_lists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each product of files {"products": [...]}; schema: of one product. Files without products give none, malformed ones fail."""
    lists = spark.read.schema(f"products array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return lists.select(F.explode("products").alias("p")).select("p.*")


def model_fit(text: Column) -> Column:
    """height_cm, size, notes of the first sentence that tells what the model wears; nulls without one."""
    sentence = F.nullif(F.trim(F.regexp_extract(text, r"(?i)((?:the\s+)?model is wearing a size ([\w.]+)[^.]{0,120})", 1)), F.lit(""))
    size = F.nullif(F.regexp_extract(sentence, r"(?i)wearing a size ([\w.]+)", 1), F.lit(""))
    return F.struct(height_cm(sentence).alias("height_cm"), size.alias("size"), F.substring(sentence, 1, 400).alias("notes"))


def gallery(html: Column, path: str, product: Column, color: Column, most: int = 8) -> Column:
    """Image paths of one product, and of one colour if that is known, by the number in their names, each once, the first `most`.

    path: a pattern of an image address with groups for product, colour and file; what follows '?' in a file is dropped."""
    found = F.transform(F.regexp_extract_all(html, F.lit(f"({path})"), 1), lambda u: F.struct(F.regexp_extract(u, path, 1).alias("id"), F.regexp_extract(u, path, 2).alias("color"), F.split(F.regexp_extract(u, path, 3), r"\?")[0].alias("file")))
    own = F.filter(found, lambda x: (x["id"] == product) & (color.isNull() | (x["color"] == color)))
    place = lambda f: F.coalesce(F.nullif(F.regexp_extract(f, r"\.(\d+)\.", 1), F.lit("")).try_cast("int"), F.lit(99))
    names = F.array_distinct(F.transform(own, lambda x: F.concat_ws("/", x["id"], x["color"], x["file"])))
    sorted_ = F.array_sort(F.transform(names, lambda n, i: F.struct(place(n).alias("at"), i.alias("i"), n.alias("name"))))
    return F.slice(F.transform(sorted_, lambda s: s["name"]), 1, most)
