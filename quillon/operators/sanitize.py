"""What a model answers, brought to what the catalog accepts: unknown values go and are counted, never stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import coerce, coerce_many

# Limits, and how reasons that say nothing begin.
PICKS, TERMS, WORDS, NEGATED, REASON, LEAST_REASON = 10, 20, 3, 10, 90, 8
EMPTY_PRAISE = r"(?i)^(good|great|nice|perfect|strong)\b"


def reason(text: Column) -> Column:
    """Trimmed, a trailing word null dropped, cut at 90 characters; null if too short or mere praise."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?i)[,;:\s]*\bnull\b\.?$", ""))
    cut = F.when(F.length(bare) > REASON, F.concat(F.substring(bare, 1, REASON - 3), F.lit("..."))).otherwise(bare)
    return F.when((F.length(bare) >= LEAST_REASON) & ~bare.rlike(EMPTY_PRAISE), cut)


def picks(results: Column, count: Column, most: int = PICKS) -> Column:
    """(index, reason) of a list of answers (index, reason): whole indices below count, each once, the first `most`. Null lists are empty."""
    whole = F.transform(F.coalesce(results, F.array().cast("array<struct<index: double, reason: string>>")), lambda r: F.struct(F.when(r["index"] >= 0, F.floor(r["index"])).cast("int").alias("index"), r["reason"].alias("reason")))
    known = F.filter(whole, lambda r: r["index"].isNotNull() & (r["index"] < count))
    places = F.transform(known, lambda r: r["index"])
    once = F.filter(known, lambda r, i: F.array_position(places, r["index"]) == i + 1)
    return F.transform(F.slice(once, 1, most), lambda r: F.struct(r["index"].alias("index"), reason(r["reason"]).alias("reason")))


def _texts(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))


def expansion_terms(terms: Column) -> Column:
    """Terms of two characters and three words at least and at most, in lower case, the first twenty."""
    return F.slice(F.filter(_texts(terms), lambda t: (F.length(t) > 1) & (F.size(F.split(t, r"\s+")) <= WORDS)), 1, TERMS)


def negated_terms(terms: Column) -> Column:
    return F.slice(F.filter(_texts(terms), lambda t: t != ""), 1, NEGATED)


def expansion(raw: Column, single: Mapping[str, Sequence[str]], many: Mapping[str, Sequence[str]]) -> Column:
    """terms, facets (map of the known values, absent ones left out), negated, has_negation of a raw answer with terms, negatedTerms, hasNegation and a field for each facet."""
    facets = [F.struct(F.lit(n).alias("key"), F.filter(F.array(coerce(raw[n], v)), lambda x: x.isNotNull()).alias("value")) for n, v in single.items()]
    facets += [F.struct(F.lit(n).alias("key"), F.coalesce(coerce_many(raw[n], v), F.array().cast("array<string>")).alias("value")) for n, v in many.items()]
    negated = negated_terms(raw["negatedTerms"])
    return F.struct(
        expansion_terms(raw["terms"]).alias("terms"), F.map_from_entries(F.filter(F.array(*facets), lambda e: F.size(e["value"]) > 0)).alias("facets"),
        negated.alias("negated"), (F.coalesce(raw["hasNegation"], F.lit(False)) | (F.size(negated) > 0)).alias("has_negation"),
    )


def extraction(raw: Column, single: Mapping[str, Sequence[str]], many: Mapping[str, Sequence[str]]) -> Column:
    """A struct of all facets with known values, null or empty without one, and dropped: how many given values were unknown."""
    ones = {n: coerce(raw[n], v) for n, v in single.items()}
    lists = {n: F.coalesce(coerce_many(raw[n], v), F.array().cast("array<string>")) for n, v in many.items()}
    lost = [F.when(raw[n].isNotNull() & c.isNull(), 1).otherwise(0) for n, c in ones.items()]
    lost += [_unknown(raw[n], v) for n, v in many.items()]
    return F.struct(*(c.alias(n) for n, c in (ones | lists).items()), sum(lost, F.lit(0)).alias("dropped"))


def _unknown(values: Column, vocabulary: Sequence[str]) -> Column:
    return F.when(values.isNull(), 0).otherwise(F.size(F.filter(values, lambda x: coerce(x, vocabulary).isNull())))


def resolve(text: Mapping[str, Column], vision: Mapping[str, Column], vision_first: Sequence[str], text_first: Sequence[str]) -> tuple[dict[str, Column], Column]:
    """({field: value}, conflicts): of two sources the preferred one, else the other; conflicts (field, text_value, vision_value) where both are set and differ."""
    values = {f: F.coalesce(vision[f], text[f]) for f in vision_first} | {f: F.coalesce(text[f], vision[f]) for f in text_first}
    differ = [F.when(text[f].isNotNull() & vision[f].isNotNull() & (text[f] != vision[f]), F.struct(F.lit(f).alias("field"), text[f].alias("text_value"), vision[f].alias("vision_value"))) for f in values]
    return values, F.filter(F.array(*differ), lambda c: c.isNotNull())


def union(first: Column, second: Column) -> Column:
    """Values of both lists, each once, in first-seen order; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))
