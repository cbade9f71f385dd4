"""Array and vocabulary functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def coerce(value: Column, vocabulary: Sequence[str]) -> Column:
    """The value in canonical spelling if it is in the vocabulary, else null."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"[\s_]+", "-")
    return F.when(v.isin(*vocabulary), v)


def coerce_many(values: Column, vocabulary: Sequence[str]) -> Column:
    """Known values in first-seen order, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: coerce(v, vocabulary)), lambda v: v.isNotNull()))


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule (pattern, value) that matches."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in rules))


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The values of all rules that match, in rule order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(v)) for p, v in rules)), lambda v: v.isNotNull())


def literal_map(entries: Mapping[str, Sequence[str]]) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def expand(values: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Surface forms of all values, in order, each once; unknown values stand for themselves with spaces for hyphens."""
    table = literal_map(synonyms)
    forms = F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), F.array(F.replace(v, F.lit("-"), F.lit(" ")))))
    return F.array_distinct(F.flatten(forms))


def conflicts(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Fields whose two sources are both set and differ."""
    return F.filter(F.array(*(F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(n)) for n, a, b in pairs)), lambda v: v.isNotNull())
