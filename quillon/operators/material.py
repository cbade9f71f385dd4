"""Composition strings as Column expressions: a grammar of segments, components and three shapes of shares.

A string is cleaned (colour markers harvested, claims and junk removed), its first segment with a percentage is cut at component
labels, and each component is read in one shape alone: share before name, name before share, or a bare name of three words at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_match, once

# Names, aliases, labels and patterns that published compositions use.
NATURAL = ("cotton", "linen", "wool", "cashmere", "silk", "leather")
FIBERS = {
    "spandex": "elastane", "spandex(elastane)": "elastane", "spandex (elastane)": "elastane", "elastane": "elastane", "lycra": "elastane", "stretch": "elastane", "polyamide": "nylon", "nylon": "nylon", "rayon": "viscose", "viscose": "viscose", "visocse": "viscose",
    "tencel": "lyocell", "tencel lyocell": "lyocell", "lyocell": "lyocell", "modal": "modal", "cupro": "cupro", "flax": "linen", "linen": "linen", "cotton": "cotton", "organic cotton": "cotton", "recycled cotton": "cotton", "supima cotton": "cotton", "polyester": "polyester", "recycled polyester": "polyester",
    "wool": "wool", "merino": "wool", "merino wool": "wool", "lambswool": "wool", "cashmere": "cashmere", "silk": "silk", "acrylic": "acrylic", "acetate": "acetate", "triacetate": "acetate", "leather": "leather", "polyurethane": "other", "pu": "other",
}
FABRICS = ("jersey", "knit", "denim", "chiffon", "satin", "lace", "jacquard", "poplin", "twill", "fleece", "gauze", "rib", "waffle", "mesh", "corduroy", "velvet", "worsted", "sweatfleece")
FABRIC_ALIASES = {"worsted woven": "worsted", "worsted": "worsted", "knitted": "knit", "knit": "knit", "rib knit": "rib", "ribbed": "rib", "sweat fleece": "sweatfleece", "sweatfleece": "sweatfleece", "georgette": "chiffon", "sateen": "satin"}
NON_TEXTILE = ("brass", "titanium steel", "stainless steel", "steel", "alloy", "zinc alloy", "resin", "glass", "copper", "silver", "gold")
MAIN = ("shell", "body", "main", "outer")
LABELS = (*MAIN, "lining", "liner", "rib", "binder-processed part", r"cup \( inner lining \)", r"cup \(inner lining\)", "cup", "trim", "contrast", "insert")
JUNK = ("exclusive of ornamentation", "exclusive of decoration", r"\bimported\b", r"\bmade in [a-z ]+", r"\bdry clean only\b", r"\bhand wash\b", r"\bmachine wash\b", r"this item ships with one of the below options\.?\s*note that you cannot specify a preference at this time\.?")
QUALIFIERS = r"\b(recycled|organic|uses|fiber|fibre|certified|premium|soft|brushed)\b"
SHARE = r"\d+(?:\.\d+)?\s*%"
SHARE_FIRST, SHARE_LAST = r"(\d+(?:\.\d+)?)\s*%\s*([A-Za-z][A-Za-z™®()\s-]{0,40})", r"([A-Za-z][A-Za-z™®()\s-]{0,30}?)\s*(\d+(?:\.\d+)?)\s*%"
CLAIM = r"(?i)\(\s*\d+\s*%\s*uses recycled[^)]*\)"
PROSE = r"(?i)\b(this|it|the|a|an|is|are|has|with|features|made)\b"
IN_PROSE = (
    r"(?i)\d{1,3}%(?!\s*off\b)\s*(?:[A-Za-z®™-]+[^\S\n]+){0,2}(?:cotton|coton|polyester|nylon|spandex|[ée]lasthanne|elastane|wool|laine|linen|lin|viscose|rayon|lyocell|modal|acrylic|acrylique|tencel|silk|soie|cashmere|cachemire|polyamide)"
    r"""[^\n."'\\<>{}\[\]]{0,40}"""
)
CARE = r"(?i)\s(?:Made in|Imported|Machine wash|Hand wash|Dry clean|Environmental)\b"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, rf"(?i){p}", " ")
    return _plain(text)


def _word(name: str) -> str:
    return rf"\b{name}\b"


def _first_word(text: Column, words: Sequence[tuple[str, str]]) -> Column:
    """first_match() of words, after one search for any of them."""
    return F.when(text.rlike("|".join(p for p, _ in words)), first_match(text, words))


def canonical_fibers(named: Column) -> Column:
    """(fiber, pct, component, recycled, organic) of structs (name, pct, component): by alias, by alias without qualifiers, by the first known word; others vanish."""
    table = F.create_map(*(F.lit(x) for entry in FIBERS.items() for x in entry))
    words = [(_word(a), f) for a, f in FIBERS.items() if " " not in a and "(" not in a]
    lower = F.transform(named, lambda x: F.struct(x["pct"].alias("pct"), x["component"].alias("component"), F.regexp_replace(_plain(F.regexp_replace(F.lower(x["name"]), "[™®]", "")), r"^(?:and|&)\s+", "").alias("s")))
    bare = F.transform(lower, lambda x: F.struct(x["pct"].alias("pct"), x["component"].alias("component"), x["s"].alias("s"), _plain(F.regexp_replace(x["s"], QUALIFIERS, "")).alias("t")))
    known = F.transform(
        bare,
        lambda x: F.struct(
            F.coalesce(F.try_element_at(table, x["s"]), F.try_element_at(table, x["t"]), _first_word(x["t"], words)).alias("fiber"), x["pct"].alias("pct"), x["component"].alias("component"), x["s"].rlike(r"\brecycled\b").alias("recycled"), x["s"].rlike(r"\borganic\b").alias("organic")
        ),
    )
    return F.filter(known, lambda x: x["fiber"].isNotNull())


def fabric(text: Column) -> Column:
    """The fabric that a text names: as a whole, or the first alias or fabric among its words."""
    exact = F.create_map(*(F.lit(x) for entry in FABRIC_ALIASES.items() for x in entry))
    words = [*((_word(a), f) for a, f in FABRIC_ALIASES.items()), *((_word(f), f) for f in FABRICS)]
    return once(_plain(F.lower(text)), lambda s: F.coalesce(F.try_element_at(exact, s), F.when(s.isin(*FABRICS), s), _first_word(s, words)))


def color_markers(text: Column) -> Column:
    """Colours in brackets, digits and 'other colors' dropped, each once."""
    each = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), 1), lambda m: F.split(m, ",")))
    names = F.transform(each, lambda c: F.lower(F.trim(F.regexp_replace(c, r"\d+", ""))))
    return F.array_distinct(F.filter(names, lambda c: (c != "") & ~c.rlike("other colors?")))


def components(text: Column) -> Column:
    """(component, text) of the first segment with a percentage: what a label heads; the labels of the main part, and what no label heads, are 'main'."""
    segments = F.filter(F.transform(F.split(text, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    first = once(segments, lambda of: F.coalesce(F.get(F.filter(of, lambda s: s.rlike(SHARE)), F.lit(0)), F.get(of, F.lit(0)), text))
    pieces = F.split(F.regexp_replace(first, rf"(?i)({'|'.join(LABELS)})\s*:", "\u0001$1\u0002"), "\u0001")
    label = lambda p: F.lower(F.substring_index(p, "\u0002", 1))
    named = lambda p: once(label(p), lambda n: F.when(n.isin(*MAIN), "main").otherwise(n))
    cut = F.transform(pieces, lambda p, i: F.when(i == 0, F.struct(F.lit("main").alias("component"), p.alias("text"))).otherwise(F.struct(named(p).alias("component"), F.substring_index(p, "\u0002", -1).alias("text"))))
    return once(cut, lambda of: F.filter(of, lambda c, i: (i > 0) | (F.trim(c["text"]) != "") | (F.size(of) == 1)))


def _named(c: Column, pattern: str, name: int, share: int) -> Column:
    found = F.regexp_extract_all(c["text"], F.lit(pattern), 0)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, name).alias("name"), F.regexp_extract(m, pattern, share).cast("double").alias("pct"), c["component"].alias("component")))


def _bare(c: Column) -> Column:
    text = F.trim(F.regexp_replace(_without(c["text"], *JUNK), "[.,;]", ""))
    one = F.array(F.struct(text.alias("name"), F.lit(100.0).alias("pct"), c["component"].alias("component")))
    return F.filter(one, lambda x: (x["name"] != "") & (F.size(F.split(x["name"], r"\s+")) <= 3) & ~F.lower(x["name"]).isin(*FABRICS))


def parse_material(df: DataFrame, text: Column, out: str = "material") -> DataFrame:
    """Add a struct: fibers, fiber_names, fabric, colors, natural_ratio, primary_fiber, incomplete, clean, prose.

    Main shares below 90 in sum are incomplete: kept, but without a primary fibre and a ratio. Long sentence-like texts with one
    percentage at most are prose: returned as such, while their fibres are still read. Null and blank texts have no fibres."""
    t = {k: F.col(f"_m_{k}") for k in ("input", "colors", "claim", "cleaned", "parts", "read", "fibers", "fabric", "main", "total", "by_share")}

    def step(df: DataFrame, **more: Column) -> DataFrame:
        """Each step is a projection of its own, so no expression is copied into later ones."""
        return df.withColumns({f"_m_{k}": c for k, c in more.items()})

    df = step(df, input=F.coalesce(_plain(text), F.lit("")))
    unmarked = F.regexp_replace(t["input"], r"\[[^\]]+\]", " | ")
    df = step(df, colors=color_markers(t["input"]), claim=unmarked.rlike(CLAIM), cleaned=_without(F.regexp_replace(unmarked, CLAIM, " "), *JUNK))
    df = step(df, parts=F.when(t["input"] == "", F.array().cast("array<struct<component: string, text: string>>")).otherwise(components(t["cleaned"])))
    shapes = F.transform("_m_parts", lambda c: F.struct(canonical_fibers(_named(c, SHARE_FIRST, 2, 1)).alias("a"), canonical_fibers(_named(c, SHARE_LAST, 1, 2)).alias("b"), canonical_fibers(_bare(c)).alias("c")))
    df = step(df, read=shapes, fabric=F.array_distinct(F.filter(F.transform("_m_parts", lambda c: fabric(c["text"])), lambda f: f.isNotNull())))
    df = step(df, all=F.flatten(F.transform("_m_read", lambda r: F.when(F.size(r["a"]) > 0, r["a"]).when(F.size(r["b"]) > 0, r["b"]).otherwise(r["c"]))))
    keys = F.transform("_m_all", lambda x: F.concat_ws(":", x["fiber"], x["component"]))
    df = step(df, once=F.filter("_m_all", lambda x, i: F.array_position(keys, F.concat_ws(":", x["fiber"], x["component"])) == i + 1))
    other = F.struct(F.lit("other").alias("fiber"), F.lit(None).cast("double").alias("pct"), F.lit("main").alias("component"), F.lit(False).alias("recycled"), F.lit(False).alias("organic"))
    metal = first_match(F.lower(t["cleaned"]), [(_word(n), n) for n in NON_TEXTILE]).isNotNull() & ~F.exists("_m_once", lambda x: x["fiber"] == "other")
    df = step(df, fibers=F.when(metal, F.concat("_m_once", F.array(other))).otherwise(F.col("_m_once")))
    claimed = F.array_position(F.transform("_m_fibers", lambda x: x["fiber"]), "polyester")
    df = step(df, fibers=F.transform("_m_fibers", lambda x, i: x.withField("recycled", x["recycled"] | (t["claim"] & (claimed == i + 1)))))
    df = step(df, main=F.filter("_m_fibers", lambda x: (x["component"] == "main") & x["pct"].isNotNull()))
    df = step(df, total=F.aggregate("_m_main", F.lit(0.0), lambda s, x: s + x["pct"]), by_share=F.array_sort(F.transform("_m_main", lambda x, i: F.struct((-x["pct"]).alias("minus"), i.alias("i"), x["fiber"].alias("fiber")))))
    natural = F.aggregate(F.filter("_m_main", lambda x: x["fiber"].isin(*NATURAL)), F.lit(0.0), lambda s, x: s + x["pct"])
    incomplete = (F.size("_m_main") > 0) & (t["total"] < 90)
    names = F.array_distinct(F.transform("_m_fibers", lambda x: x["fiber"]))
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    shares = F.array_join(F.transform("_m_by_share", lambda x: F.concat(number(-x["minus"]), F.lit("% "), x["fiber"])), ", ")
    prose = (F.size(F.regexp_extract_all("_m_input", F.lit(f"({SHARE})"), 1)) < 2) & (F.size(F.split("_m_input", " ")) > 12) & t["input"].rlike(PROSE)
    result = F.struct(
        t["fibers"].alias("fibers"), names.alias("fiber_names"), t["fabric"].alias("fabric"), t["colors"].alias("colors"), F.when((t["total"] > 0) & ~incomplete, F.round(natural / t["total"], 3)).alias("natural_ratio"),
        F.when(~incomplete, F.get(F.transform("_m_by_share", lambda x: x["fiber"]), F.lit(0))).alias("primary_fiber"), incomplete.alias("incomplete"), F.when(F.size("_m_main") > 0, shares).when(F.size("_m_fibers") > 0, F.array_join(names, ", ")).alias("clean"), F.when(prose, t["input"]).alias("prose"),
    )
    return df.withColumn(out, result).drop(*(f"_m_{k}" for k in (*t, "all", "once")))


def composition_in_prose(text: Column) -> Column:
    """The first composition that a text of any kind holds ('30% off' is none), without what follows it; null without one."""
    found = F.split(F.regexp_extract(text, IN_PROSE, 0), CARE)[0]
    return F.nullif(F.trim(F.regexp_replace(F.trim(found), r"[\s,;/|·-]+$", "")), F.lit(""))
