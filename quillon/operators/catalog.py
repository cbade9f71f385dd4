"""Small rules of a catalog as Column expressions, and checks that stop a query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest badge, how many lexical forms and attributes are used, the slack of a due date.
BADGE, FORMS, ALIKE, SLACK = 24, 40, 4, "12 hours"


def require_none(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """df, whose reading fails with the message if `bad` has a row."""
    verdict = bad.limit(1).agg(F.when(F.count(F.lit(1)) > 0, F.raise_error(F.lit(message))).otherwise(F.lit(0)).cast("int").alias("_bad"))  # one row
    return df.crossJoin(F.broadcast(verdict)).where("_bad = 0").drop("_bad")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    return require_none(df, df.groupBy(key).count().where("count > 1"), f"{key} is not unique")


def require_known(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Every non-null key of df must be a known one."""
    lost = df.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)), key, "left_anti")
    return require_none(df, lost, f"{key} is unknown")


def patched(table: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """table with the patch's values where it has any; fails if the patch names a key that the table lacks, or one twice."""
    checked = require_unique(require_known(patch, key, table, key), key)
    given = checked.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(given, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def patched_profile(current: DataFrame, patch: DataFrame, key: str, values: Sequence[str], maps: Sequence[str]) -> DataFrame:
    """current with the supplied values; a map that is supplied replaces what was learned, an absent one leaves it."""
    given = patch.select(key, *(F.col(c).alias(f"_{c}") for c in (*values, *maps)))
    return current.join(given, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in (*values, *maps) else F.col(c) for c in current.columns))


def stale(version: Column, now: int, at: Column, model: Column, current: str, seen: Column, wanted: Column) -> Column:
    """Whether a derived row is to be made again: an older version, never made, another model, or another input."""
    older = F.coalesce(version < now, F.lit(True))
    return older | at.isNull() | ~model.eqNullSafe(F.lit(current)) | ~seen.eqNullSafe(wanted)


def due(enabled: Column, last: Column, cadence: Column, now: Column) -> Column:
    """Enabled, and never run or to be run within the slack."""
    return F.coalesce(enabled, F.lit(False)) & F.coalesce(last + cadence <= now + F.expr(f"interval {SLACK}"), F.lit(True))


def lapsed(last_seen: Column, cadence_days: Column, now: Column, least: int = 7) -> Column:
    """Not seen for two cadences, a week at least."""
    return last_seen < now - F.make_dt_interval(F.greatest(F.lit(least), 2 * F.coalesce(cadence_days, F.lit(0))))


def many_of(values: Column, allowed: Sequence[str]) -> Column:
    """The allowed ones of given values; null where none was given."""
    return F.filter(values, lambda v: v.isin(*allowed))


def upstream_relevance(i: Column, n: Column) -> Column:
    """Of the i-th of n, from 0."""
    return 1 - i / F.greatest(F.lit(1), n)


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows `prefix:` in the first tag that has it, in lower case."""
    hit = F.get(F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit(f"{prefix}:"))), F.lit(0))
    return F.lower(F.trim(F.regexp_replace(hit, r"(?s)^[^:]*:", "")))


def for_women(tags: Column) -> Column:
    low = F.transform(tags, lambda t: F.lower(t))
    return F.array_contains(low, "female") | (F.array_contains(low, "unisex") & ~F.array_contains(low, "male"))


def is_garment(tags: Column, title: Column, excluded: Sequence[str], deny: str) -> Column:
    """By the category tag if there is one, else by the title."""
    category = F.nullif(tag_value(tags, "category"), F.lit(""))
    return F.when(category.isNotNull(), ~category.isin(*excluded)).otherwise(~F.coalesce(title.rlike(deny), F.lit(False)))


def size_value(raw: Column) -> Column:
    """A letter size, a number or waist x length, ONE SIZE; null for anything else."""
    s = F.regexp_replace(F.upper(raw), r"\s+", "")
    return F.when(s.rlike(r"^(X{0,3}S|M|X{0,3}L|[234]XL)$") | s.rlike(r"^\d{1,3}(X\d{1,2})?$"), s).when(s.rlike("^(ONESIZE|OS|FREE|F)$"), "ONE SIZE")


def size_values(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(raw, lambda r: size_value(r)), lambda s: s.isNotNull()))


def material_badge(clean: Column, primary: Column) -> Column:
    """The first part of a composition if it is short, else the primary fibre."""
    first = F.nullif(F.trim(F.split(clean, ",")[0]), F.lit(""))
    return F.when(first.isNotNull(), F.when(F.length(first) <= BADGE, first).otherwise(primary))


def outbound(url: Column, source: str) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"utm_source={source}&utm_medium=referral"))


def attributes(singles: Sequence[Column], details: Column, most: int = 2) -> Column:
    """Given single values in their order, then the first details."""
    return F.filter(F.concat(F.array(*singles), F.slice(F.coalesce(details, F.array().cast("array<string>")), 1, most)), lambda v: v.isNotNull() & (v != ""))


def similar_query(attributes_: Column, badge: Column) -> Column:
    """The first attributes and the badge as words."""
    words = F.replace(F.concat_ws(" ", F.array_join(F.slice(attributes_, 1, ALIKE), " "), badge), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def lexical_forms(query: Column, synonyms: Mapping[str, Sequence[str]], most: int = FORMS) -> Column:
    """All forms of each entry of which a form, or the canonical with spaces, is a substring of the query; each once, the first `most`."""
    q = F.lower(query)
    hits = []
    for canonical, forms in synonyms.items():
        named = F.lit(False)
        for f in (*forms, canonical.replace("-", " ")):
            named = named | F.contains(q, F.lit(f))
        hits.append(F.when(named, F.array(*map(F.lit, forms))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.flatten(F.array(*hits))), 1, most)
