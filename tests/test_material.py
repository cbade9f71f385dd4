"""Golden compositions and key-value blocks."""

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import key_values
from quillon.operators import material

MANY = "[00 WHITE] Shell: 96% Cotton, 4% Spandex/ Lining: 95% Cotton, 5% Spandex/ Binder-processed Part: 67% Cotton, 33% Polyester/ Cup ( Inner Lining ): 100% Polyester [Other Colors] Shell: 97% Cotton, 3% Spandex Imported"
TWICE = (
    "This item ships with one of the below options. Note that you cannot specify a preference at this time. [00 WHITE] Shell: 67% Polyester, 24% Cupro, 9% Spandex ( 45% Uses Recycled Polyester Fiber )/ Lining: 72% Nylon, 28% Spandex/ "
    "Cup ( Inner Lining ): 100% Polyester Shell: 71% Polyester, 19% Cupro, 10% Spandex"
)
SENTENCE = "This is a strapless babydoll dress with a smocked bodice and tie detail at the back that falls to a tiered mini skirt."
NAMING = "These are low-rise micro shorts with a drawcord waist. They're made with Mighty Cotton™ — heavyweight 100% cotton jersey with a soft-structured feel. Mighty comfortable."
GOLDEN = [
    ("78% cotton, 22% polyester, exclusive of ornamentation", {"fiber_names": ["cotton", "polyester"], "primary_fiber": "cotton", "natural_ratio": 0.78, "incomplete": False, "clean": "78% cotton, 22% polyester", "prose": None}),
    ("95% Cotton, 5% Spandex", {"fiber_names": ["cotton", "elastane"], "natural_ratio": 0.95, "clean": "95% cotton, 5% elastane"}),
    ("1% Elastane", {"fiber_names": ["elastane"], "incomplete": True, "primary_fiber": None, "natural_ratio": None}),
    ("96% Cotton, 4% Spandex Imported", {"fiber_names": ["cotton", "elastane"], "natural_ratio": 0.96, "incomplete": False}),
    (MANY, {"natural_ratio": 0.96, "primary_fiber": "cotton", "colors": ["white"], "main": ["cotton", "elastane"], "components": ["main", "main", "lining", "lining", "binder-processed part", "binder-processed part", "cup ( inner lining )"]}),
    ("Polyester 65.0%, Nylon 35.0%", {"fiber_names": ["polyester", "nylon"], "primary_fiber": "polyester", "natural_ratio": 0.0, "incomplete": False, "clean": "65% polyester, 35% nylon"}),
    ("Polyester 95.0%, Spandex(Elastane) 5.0%", {"fiber_names": ["polyester", "elastane"], "natural_ratio": 0.0}),
    ("Polyester", {"fiber_names": ["polyester"], "natural_ratio": 0.0, "clean": "100% polyester"}),
    ("Cotton 100.0%", {"natural_ratio": 1.0, "primary_fiber": "cotton"}),
    *((f, {"fiber_names": [], "fabric": [f.lower()], "clean": None}) for f in ("Chiffon", "Knit", "Worsted", "Jacquard")),
    ("Titanium Steel", {"fiber_names": ["other"], "natural_ratio": None, "clean": "other"}),
    (SENTENCE, {"prose": SENTENCE, "fiber_names": [], "clean": None}),
    ("60% Organic Cotton, 40% Recycled Polyester", {"fiber_names": ["cotton", "polyester"], "natural_ratio": 0.6, "organic": ["cotton"], "recycled": ["polyester"]}),
    ("50% TENCEL™ Lyocell, 50% Rayon", {"fiber_names": ["lyocell", "viscose"], "natural_ratio": 0.0}),
    ("70% Visocse, 30% Cotton", {"fiber_names": ["viscose", "cotton"]}),
    ("Polyamide 80.0%, Spandex 20.0%", {"fiber_names": ["nylon", "elastane"]}),
    (NAMING, {"prose": NAMING, "fiber_names": ["cotton"], "natural_ratio": 1.0, "clean": "100% cotton", "fabric": ["jersey"]}),
    (TWICE, {"prose": None, "main": ["polyester", "cupro", "elastane"], "primary_fiber": "polyester", "natural_ratio": 0.0, "recycled": ["polyester"], "colors": ["white"]}),
    ("feels like silk to me", {"fiber_names": []}),  # four words are no bare fibre
    ("Rib Knit", {"fabric": ["rib"]}),
    *((x, {"fiber_names": [], "clean": None, "natural_ratio": None, "fabric": [], "colors": [], "incomplete": False, "primary_fiber": None, "prose": None}) for x in (None, "", "   ")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(GOLDEN)], "i int, s string")
    return {r["i"]: r["material"] for r in material.parse_material(df, F.col("s")).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(parsed, i):
    m, want = parsed[i], GOLDEN[i][1]
    derived = {
        "main": [f["fiber"] for f in m["fibers"] if f["component"] == "main"], "components": [f["component"] for f in m["fibers"]],
        "organic": [f["fiber"] for f in m["fibers"] if f["organic"]], "recycled": [f["fiber"] for f in m["fibers"] if f["recycled"]],
    }
    assert {k: derived[k] if k in derived else m[k] for k in want} == want


def test_composition_in_prose(spark):
    cases = {
        "Take 30% off today! Body: 95% Cotton / Made in Peru": "95% Cotton", "92% coton, 3% polyester, 5% elasthanne. Doux": "92% coton, 3% polyester, 5% elasthanne", "50% off cotton": None, "made of 100% certified organic cotton Machine wash cold": "100% certified organic cotton",
        "70%  wool, 30% silk,": "70%  wool, 30% silk", "": None, None: None, "no share of cotton": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", material.composition_in_prose(F.col("s")).alias("f")).collect()} == cases


KEYS = ["Back Neckline", "Fabric Stretch", "Sleeve Length", "Sleeve Type", "Pattern Type", "Dress Type", "Embellishment", "Silhouette", "Neckline", "Occasion", "Material", "Season", "Fabric", "Lining", "Waist", "Style", "Length", "Fit", "Type"]


def test_key_values(spark):
    block = "- Occasion: Daily - Style: Cute - Season: Spring, Summer - Back Neckline: Corset - Waist: Natural Waisted Sleeve Length: Sleeveless - Silhouette: A-Line - Fabric: Polyester 65.0%, Nylon 35.0% - Lining: Polyester - material : Lace"
    cases = [
        (block, {"occasion": "Daily", "style": "Cute", "season": "Spring, Summer", "back neckline": "Corset", "waist": "Natural Waisted", "sleeve length": "Sleeveless", "silhouette": "A-Line", "fabric": "Polyester 65.0%, Nylon 35.0%", "lining": "Polyester", "material": "Lace"}),
        ("Fit: - Style: a - STYLE: b", {"style": "b"}), ("Style: a - Style: - ", {"style": "a"}), ("no keys", {}), ("", {}), (None, None),
    ]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    assert {r["i"]: r["m"] for r in df.select("i", key_values(F.col("s"), KEYS).alias("m")).collect()} == {i: m for i, (_, m) in enumerate(cases)}
