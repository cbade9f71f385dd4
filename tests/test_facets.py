"""Golden classifications, labelled blocks and key-value facets."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import key_values
from quillon.operators import facets

NAMES = [
    ('3" Low Rise Denim Shorts', None, {"category": "bottom", "subcategory": "shorts", "rise": "low-rise", "colors": ["denim"]}),
    ("Cotton Gauze Easy Split-Hem Pants", "A minimalist silhouette with a relaxed drape and a split hem.", {"category": "bottom", "subcategory": "trousers", "length": None, "details": ["slit"], "season": ["summer"], "fit": "relaxed"}),
    ("Racer Back Bra Top", None, {"subcategory": "bra-top"}), ("String Bikini Top", None, {"subcategory": "bikini-top", "season": ["summer"]}), ("Sweetheart Neck Mini Dress", None, {"subcategory": "mini-dress", "neckline": "sweetheart", "length": "mini"}),
    ("Linen-Blend Embroidered Cami Maxi Dress", None, {"subcategory": "maxi-dress", "details": ["embroidery"]}), ("100% Cotton Pocket Sweater Vest", None, {"category": "knitwear", "subcategory": "vest", "details": ["pockets"]}),
    ("Oversized Icon Denim Jacket", None, {"subcategory": "jacket", "fit": "oversized"}), ("Quilted Puffer Vest", None, {"category": "outerwear", "season": ["winter"]}), ("HEATTECH Ultra Warm High Neck T-Shirt", None, {"neckline": "mock-neck", "subcategory": "t-shirt"}),
    ("Off White Turtle Tie Regular Sleeve Shirt", None, {"category": "top", "subcategory": "shirt", "neckline": "turtleneck", "colors": ["off-white", "white"], "details": ["self-tie"]}), ("Purple Mandarin Collar Slit Mermaid Dress", None, {"neckline": "mandarin-collar", "silhouette": "mermaid"}),
    ("Black Square Neck Sleeveless Button Midi Dress", None, {"neckline": "square", "sleeve_length": "sleeveless"}), ("CloseKnit Jersey Boatneck Crop Tank Top", None, {"neckline": "boat", "length": "cropped", "subcategory": "tank"}), ("Original Contour Waver Dress", None, {"neckline": None, "category": "dress", "subcategory": None}),
    ("Linen Shirt", "A crisp white linen shirt that pairs well with black denim.", {"colors": []}), ("The '90s Vintage Hi-Rise Baggy Denim Short", None, {"rise": "high-rise", "fit": "oversized"}), ("Reduced Committee Minimalist", None, {"category": None, "length": None, "colors": []}),
    ("Tie-Dye Tee", None, {"pattern": "tie-dye", "details": [], "subcategory": "t-shirt"}), (None, None, {"category": None, "details": [], "colors": [], "occasion": []}), ("Plain", "An office blazer", {"category": "outerwear", "pattern": "solid", "occasion": ["work"]}),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n, d) for i, (n, d, _) in enumerate(NAMES)], "i int, n string, d string")
    got = {r["i"]: r["f"] for r in df.select("i", facets.facets(F.col("n"), F.col("d")).alias("f")).collect()}
    for i, (name, _, want) in enumerate(NAMES):
        assert {k: got[i][k] for k in want} == want, name


def test_labelled(spark):
    cases = {"Soft. Fit: Relaxed, wide-leg. Rise: High rise. Crewneck. Short sleeves.": ("relaxed", "wide-leg", "high-rise", "crew", "short"), "A relaxed tee": (None,) * 5, None: (None,) * 5}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    rows = df.select("d", facets.labelled_facets(F.col("d")).alias("l"), facets.facets(F.lit("Slim low-rise tee"), F.col("d")).alias("f")).withColumn("o", facets.overridden(F.col("f"), F.col("l"), ["fit", "rise", "neckline"]))
    for r in rows.collect():
        assert tuple(r["l"]) == cases[r["d"]]
        assert r["o"]["fit"] == (cases[r["d"]][0] or "fitted") and r["o"]["rise"] == (cases[r["d"]][2] or "low-rise")


TABLES = {
    "silhouette": {"a-line": "a-line", "skater": "a-line", "loose": "relaxed"}, "neckline": {"sweetheart neck": "sweetheart", "v neck": "v-neck", "deep v neck": "plunge"}, "sleeve": {"sleeveless": "sleeveless", "short sleeve": "short"},
    "pattern": {"floral": "floral", "lace": "lace"}, "waist": {"natural waisted": "mid-rise", "empire": "high-rise"}, "position": {"natural waisted": "natural", "empire": "above-natural"}, "shoulder": {"straps": "strap", "puff sleeve": "puff"},
    "detail": {"ruched": "ruched", "zipper": "zip-front", "tie": "self-tie", "lace": "lace-trim"}, "occasion": {"daily": "everyday", "cute": "everyday", "party": "evening"}, "season": {"spring": "spring", "summer": "summer"},
}


def test_block(spark):
    keys = ["Back Neckline", "Fabric Stretch", "Sleeve Length", "Sleeve Type", "Pattern Type", "Dress Type", "Embellishment", "Silhouette", "Neckline", "Occasion", "Material", "Season", "Fabric", "Lining", "Waist", "Style"]
    full = "- Occasion: Daily - Style: Cute/Party - Season: Spring, Summer - Fabric Stretch: High Stretch - Waist: Natural Waisted Sleeve Length: Sleeveless - Pattern Type: Floral - Embellishment: Ruched, Zipper, Tie, Odd - Neckline: Sweetheart Neck - Dress Type: Skater - Silhouette: A-Line - Fabric: Polyester 65.0% - Material: Lace, Gold"
    fallback = "Dress Type: Skater - Sleeve Type: Puff Sleeve Short Sleeve - Material: Lace - Neckline: Wide Straps with Deep V Neck - Fabric Stretch: No Stretch - Waist: odd"
    df = spark.createDataFrame([(0, full), (1, fallback), (2, "nothing")], "i int, t string").withColumn("kv", key_values(F.col("t"), keys))
    got = {r["i"]: r["f"].asDict() for r in df.select("i", facets.block_facets(F.col("kv"), TABLES, ["lace", "satin"]).alias("f")).collect()}
    assert got[0] == {"silhouette": "a-line", "neckline": "sweetheart", "sleeve_length": "sleeveless", "pattern": "floral", "rise": "mid-rise", "fit": "fitted", "details": ["ruched", "zip-front", "self-tie"], "occasion": ["everyday", "evening"], "season": ["spring", "summer"], "fabric": ["lace"], "waist_position": "natural", "shoulder": None, "composition": "Polyester 65.0%"}
    assert {k: got[1][k] for k in ("silhouette", "sleeve_length", "pattern", "neckline", "shoulder", "fit", "rise")} == {"silhouette": "a-line", "sleeve_length": "short", "pattern": "lace", "neckline": "plunge", "shoulder": "puff", "fit": "regular", "rise": None}
    assert set(map(str, got[2].values())) == {"None", "[]"}


@pytest.mark.parametrize(("plural", "text", "hit"), [("", "minimalist", False), ("", "mini", True), ("", "reduced", False), ("+", "minis", True), ("", "minis", False)])
def test_words(spark, plural, text, hit):
    pattern, value = facets.rules(f"short{plural}: mini, red")[0]
    assert value == "short" and spark.range(1).select(F.lit(text).rlike(pattern)).first()[0] is hit
