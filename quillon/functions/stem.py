"""The English (Porter 2) stemmer, run over distinct terms and joined back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIX = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
BEFORE = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}  # letters of which one must stand before the suffix

REGION = ".*?[aeiouy][^aeiouy]"  # what ends before a region
SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"  # a short syllable at the end


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    long = re.match("|".join(LONG_PREFIX), word) or re.match(REGION, word)
    first = long.end() if long else len(word)
    second = re.match(REGION, word[first:])
    return first, first + second.end() if second else len(word)


def _replace(word: str, rules: dict[str, str], start: int) -> str:
    """By the longest suffix that the word has, if it lies behind start."""
    found = next((s for s in sorted(rules, key=len, reverse=True) if word.endswith(s)), None)
    if found is None or len(word) - len(found) < start:
        return word
    rest = word[: len(word) - len(found)]
    return rest + rules[found] if found not in BEFORE or rest[-1:] and rest[-1] in BEFORE[found] else word


def _past(word: str, first: int) -> str:
    """Step 1b: -eed, -ed, -ing and their adverbs."""
    m = re.search("(?:eedly|ingly|edly|eed|ing|ed)$", word)
    if not m:
        return word
    rest = word[: m.start()]
    if m[0].startswith("eed"):
        return rest + "ee" if len(rest) >= first else word
    if not re.search("[aeiouy]", rest):
        return word
    if re.search("(?:at|bl|iz)$", rest):
        return rest + "e"
    if re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= first and re.search(SHORT, rest) else rest


def english_stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters stay."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    first, second = _regions(word)
    word = re.sub("(?:'s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif re.search("ie[ds]$", word):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif re.search("[aeiouy].*[^us]s$", word):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past(word, first)
    word = re.sub("(.[^aeiouy])[yY]$", r"\1i", word)
    word = _replace(word, STEP_2, first)
    word = _replace(word, STEP_3 if re.search("ative$", word) is None or len(word) - 5 >= second else {}, first)
    word = _replace(word, dict.fromkeys(STEP_4, ""), second)
    if word.endswith("e") and (len(word) - 1 >= second or len(word) - 1 >= first and not re.search(SHORT, word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms."""

    def stem(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(stem=[english_stem(t) for t in pdf[term]])

    return terms.select(term).where(F.col(term).isNotNull()).distinct().mapInPandas(stem, f"`{term}` string, stem string")


@lru_cache(1 << 18)
def _known(term: str) -> str:
    return english_stem(term)


def stem_of(term: str) -> Column:
    """The stem of a column of terms; a worker keeps those of its last terms."""
    return F.pandas_udf(lambda terms: terms.map(_known, na_action="ignore").astype(object), "string")(F.col(term))


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with the stem in place of the term: a join with the stems of the distinct terms, which Spark broadcasts if they are few."""
    plain = "_plain"
    return rows.withColumnRenamed(term, plain).join(stems(rows, term).withColumnRenamed(term, plain), plain).withColumnRenamed("stem", term).select(rows.columns)


def duck_stem(terms: str) -> str:
    """DuckDB: common table expressions of which the last, `stems`, has term and stem of the table expression `terms`, which has a column term."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    cut = lambda n: f"left(w, len(w) - {n})"

    def rules(table: dict[str, str], start: str, more: dict[str, str] | None = None) -> str:
        cases = []
        for s in sorted(table, key=len, reverse=True):
            before = f" AND contains('{BEFORE[s]}', substr(w, len(w) - {len(s)}, 1)) AND len(w) > {len(s)}" if s in BEFORE else ""
            cases.append(f"WHEN ends_with(w, '{s}') THEN CASE WHEN len(w) - {len(s)} >= {(more or {}).get(s, start)}{before} THEN {cut(len(s))} || '{table[s]}' ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    rest = "CASE WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN regexp_matches(r, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(r, len(r) - 1) WHEN len(r) <= a AND regexp_matches(r, '" + SHORT + "') THEN r || 'e' ELSE r END"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') THEN {cut(2)} WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN len(w) > 4 THEN {cut(2)} ELSE {cut(1)} END WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].*[^us]s$') THEN {cut(1)} ELSE w END",
        f"CASE WHEN w IN ({quoted(KEPT_AFTER_PLURAL)}) THEN w WHEN x LIKE 'eed%' THEN CASE WHEN len(r) >= a THEN r || 'ee' ELSE w END WHEN x = '' OR NOT regexp_matches(r, '[aeiouy]') THEN w ELSE {rest} END",
        "CASE WHEN k THEN w ELSE regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i') END", f"CASE WHEN k THEN w ELSE {rules(STEP_2, 'a')} END", f"CASE WHEN k THEN w ELSE {rules(STEP_3, 'a', {'ative': 'b'})} END", f"CASE WHEN k THEN w ELSE {rules(dict.fromkeys(STEP_4, ''), 'b')} END",
        f"CASE WHEN k THEN w WHEN ends_with(w, 'e') THEN CASE WHEN len(w) - 1 >= b OR (len(w) - 1 >= a AND NOT regexp_matches({cut(1)}, '{SHORT}')) THEN {cut(1)} ELSE w END WHEN ends_with(w, 'll') AND len(w) - 1 >= b THEN {cut(1)} ELSE w END",
    ]
    ctes = [
        f"sw AS (SELECT DISTINCT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {terms})",
        f"sa AS (SELECT term, w, CASE WHEN regexp_matches(w, '^({'|'.join(LONG_PREFIX)})') THEN len(regexp_extract(w, '^({'|'.join(LONG_PREFIX)})')) WHEN regexp_matches(w, '^{REGION}') THEN len(regexp_extract(w, '^{REGION}')) ELSE len(w) END AS a FROM sw)",
        f"s0 AS (SELECT term, w, a, CASE WHEN regexp_matches(substr(w, a + 1), '^{REGION}') THEN a + len(regexp_extract(substr(w, a + 1), '^{REGION}')) ELSE len(w) END AS b, false AS k, '' AS x, w AS r FROM sa)",
    ]
    for i, step in enumerate(steps, 1):
        ends = "regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$')"
        ctes.append(f"s{i} AS (SELECT term, w, a, b, k OR (w IN ({quoted(KEPT_AFTER_PLURAL)}) AND {i} = 1) AS k, {ends} AS x, left(w, len(w) - len({ends})) AS r FROM (SELECT term, {step} AS w, a, b, k FROM s{i - 1}))")
    special = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in SPECIAL.items())
    ctes.append(f"stems AS (SELECT term, CASE WHEN len(term) <= 2 OR term IN ({quoted(KEPT)}) THEN term ELSE CASE term {special} ELSE lower(w) END END AS stem FROM s{len(steps)})")
    return ",\n".join(ctes)

