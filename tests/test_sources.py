"""Offline sources and sinks: runs, pages, sitemaps, product lists, content store."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import pages, readers


def block(text):
    return f'<script data-x="1" type="application/ld+json">\n{text}\n</script>'


PAGES = [
    (block('{"@type": "Product", "name": "a", "offers": [{"price": 10, "size": "S"}, {"size": "M"}, {"size": "S"}]}'), "a", "10", ["S", "M"]),
    (block("{broken") + block('[{"@type": "Brand"}, {"@type": ["X", "Product"], "name": "b", "offers": {"price": "12.5"}}]'), "b", "12.5", []),
    (block('{"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "c", "offers": {"lowPrice": 3, "highPrice": 9}}]}').replace('"application/ld+json"', "'application/ld+json'"), "c", "3", []),
    (block('{"@type": "ProductGroup", "name": "g", "hasVariant": [{"size": "XS"}, {"size": null}]}'), "g", None, ["XS"]),
    (block('{"@type": "ProductGroup", "name": "g"}') + block('{"@type": "Product", "name": "p", "isVariantOf": {"hasVariant": {"size": "L"}}}'), "p", None, ["L"]),
    (block('{"@type": "Organization", "name": "no"}'), None, None, None), ("<p>no block</p>", None, None, None), (block("null") + block("[]") + block('"text"'), None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_json_ld(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)], "i int, html string")
    got = {r["i"]: r["p"] for r in df.select("i", pages.product(F.col("html")).alias("p")).collect()}
    for i, (_, name, price, sizes) in enumerate(PAGES):
        assert (got[i] and (got[i]["name"], got[i]["price"], got[i]["sizes"])) == ((name, price, sizes) if name else None)


def test_sitemap_and_blocked(spark):
    xml = "<urlset><loc> https://a/products/x/1.html</loc><loc>https://a/products/boot/2.html</loc><loc>https://a/about</loc><loc>https://a/products/y/3.html </loc></urlset>"
    df = spark.createDataFrame([(xml,)], "xml string")
    assert df.select(pages.sitemap_links(F.col("xml"), r"/products/[^/]+/\d+\.html$", "boot")).first()[0] == ["https://a/products/x/1.html", "https://a/products/y/3.html"]
    assert df.select(pages.sitemap_links(F.col("xml"), "a", None, 1)).first()[0] == ["https://a/products/x/1.html"]
    rows = spark.createDataFrame([("a", "Shop"), (" ", "Shop"), (None, None), ("a", "Access Denied")], "n string, t string")
    assert [r[0] for r in rows.select(pages.blocked(F.col("n"), F.col("t"))).collect()] == [False, True, True, True]


def test_product_lists(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"products": [{"id": 1, "title": "a", "variants": [{"price": "5.00"}]}, {"id": 2, "title": "b", "variants": []}]}, indent=1))
    (tmp_path / "2.json").write_text('{"products": []}')
    rows = pages.read_product_lists(spark, str(tmp_path), "id long, title string, variants array<struct<price: string>>").collect()
    assert sorted((r["id"], r["title"], [v["price"] for v in r["variants"]]) for r in rows) == [(1, "a", ["5.00"]), (2, "b", [])]


RECORD = {"brand": "x", "name": "n", "product_url": "u", "description": None, "material": None, "price_cents": 5, "image_urls": [], "scraped_at": "2024-01-01T00:00:00Z"}


def test_runs(spark, tmp_path):
    for run, names in (("2024-01-01", ["x_products.json", "y_products.json"]), ("2024-02-01", ["x_products.json"]), ("2024-03-01", ["notes.txt"]), ("images", ["x_products.json"])):
        (tmp_path / run).mkdir()
        for n in names:
            (tmp_path / run / n).write_text(json.dumps([RECORD | {"brand": n[0]}], indent=1))
    latest = readers.latest_run(spark, str(tmp_path))
    assert latest.endswith("2024-02-01")
    first = str(tmp_path / "2024-01-01")
    assert sorted(r["brand"] for r in readers.read_run(spark, first).collect()) == ["x", "y"]
    assert [r["brand"] for r in readers.read_run(spark, first, ["y"]).collect()] == ["y"]
    (tmp_path / "2024-01-01" / "z_products.json").write_text(json.dumps([RECORD]))
    with pytest.raises(Exception, match="bad row"):
        readers.read_run(spark, first).collect()
    readers.write_run(readers.read_run(spark, str(tmp_path / "2024-02-01")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("brand", "name").collect() == [("x", "n")]
    with pytest.raises(FileNotFoundError):
        readers.latest_run(spark, str(tmp_path / "2024-03-01"))


def test_content_store(spark, tmp_path):
    """Two runs: the second adds only what is new, a repeated one nothing; a broken run is completed; a clashing key stops before writing."""
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(x, "name string, content binary")
    first = rows(("a", b"1"), ("b", b"1"), ("c", b"2"), ("d", None), ("a", b"1"))
    assert readers.store_content(first, "name", "content", path) == {"added": 2, "linked": 3, "missing": 1}
    assert readers.store_content(first, "name", "content", path) == {"added": 0, "linked": 0, "missing": 1}
    assert readers.store_content(rows(("e", b"2"), ("f", b"3")), "name", "content", path) == {"added": 1, "linked": 2, "missing": 0}
    for clash in (rows(("a", b"9"), ("new", b"8")), rows(("n", b"5"), ("n", b"6"))):
        with pytest.raises(ValueError, match="several contents"):
            readers.store_content(clash, "name", "content", path)
    assert {bytes(r["content"]) for r in spark.read.parquet(f"{path}/blobs").collect()} == {b"1", b"2", b"3"}
    half = str(tmp_path / "half")
    spark.createDataFrame([], "id string, content binary").write.parquet(f"{half}/blobs")  # a run that broke off before its links
    assert readers.store_content(first, "name", "content", half) == {"added": 2, "linked": 3, "missing": 1}


def test_summaries(spark, tmp_path):
    for n in (1, 2):
        readers.append_summary(spark.createDataFrame([(n, "ok")], "run int, state string"), str(tmp_path / "log"))
    assert sorted(r["run"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]
