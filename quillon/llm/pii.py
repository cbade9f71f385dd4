"""Surrogates for personal data: keyed, consistent in type, format, gender and script, distinct for distinct entities.

An entity's canonical form (case and separators dropped) is mapped by a keyed permutation, without fixed points, of all strings
of its shape, so equal entities agree across the corpus and different ones of one shape differ by construction. A person's
surnames are permuted by themselves, so 'Mr John Smith', 'Mr Smith' and an untitled 'John Smith', 'Smith' or 'John' elsewhere
in the same document keep one name; the given name comes from the list of the same script and gender, lengthened where later
surrogates need more. People are found by a title; a name that no title introduces in its document is not. A check over all
distinct entities finds surrogates that two entities share or that equal their entity; those entities take their next
surrogate; so do those whose surrogate is another real entity of the corpus, a bare surname apart: it stays with its full names.
The secret has no default: who knows it can undo the permutations. Null texts stay null; empty ones and those without
entities are unchanged; a text's memory is its own size's."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free_name, materialize, small_batches

# Titles and replacement given names by script and gender.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Sra": "f", "Mme": "f", "Madame": "f", "Dr": "n", "г-н": "m", "г-жа": "f", "κ.": "m", "κα": "f"}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Niels", "Oscar", "Paul"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Charlie", "Dominique", "Kim", "Luca", "Maxime", "Robin", "Sascha"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Максим"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("greek", "m"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
}
_ALPHABETS = {"d": "0123456789", "h": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "c": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "g": "αβγδεζηθικλμνξοπρστυφχψω", "e": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "k": "άέήίόύώ"}
_CLASS = {ch: k for k in "dacgek" for ch in _ALPHABETS[k]}
TRIES = 6  # to find a surrogate that is no real entity
_NAME = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ'’-]+|[А-Я][а-я-]+|[Α-ΩΆ-Ώ][α-ωά-ώ]+"
# In order of priority: kind, trigger that must be in the text, pattern.
PATTERNS = [
    ("email", re.compile("@"), re.compile(r"[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"[0-9A-Fa-f]{32}|AKIA|\b[sg][khp][_-]"), re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp)[_-][A-Za-z0-9]{20,})(?![0-9A-Za-z])")),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"\d{4}"), re.compile(r"(?<![\w+.])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\w)")),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")),
    ("phone", re.compile(r"[+(]\d|\d-\d"), re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)")),
    ("ssn", re.compile(r"\d{3}-\d\d-"), re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("person", re.compile("|".join(map(re.escape, TITLES))), re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\.?\s+(?:(?:{_NAME})\s+)?(?:{_NAME})(?: (?:{_NAME})){{0,2}}")),
]
_WORD = re.compile(rf"(?<!\w)(?:{_NAME})")


def find(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), in order of position; of overlapping ones the kind that is listed first."""
    found: list[tuple[int, int, str]] = []
    for kind, trigger, pattern in PATTERNS:
        if trigger.search(text):
            for m in pattern.finditer(text):
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                    continue
                if kind == "card" and m[0].isdigit() and not luhn(m[0]) and not (len(m[0]) == 16 and m[0][0] in "3456"):
                    continue
                end = m.start() + _bare(m[0]) if kind == "person" else m.end()
                if not any(m.start() < e and s < end for s, e, _ in found):
                    found.append((m.start(), end, kind))
    return sorted(found)


def _bare(name: str) -> int:
    """The length of name without a possessive ending or marks behind it."""
    return len((name[:-2] if name[-2:] in ("'s", "’s") else name).rstrip("'’-"))


def mentions(text: str) -> list[tuple[int, int, str, str, tuple[int, int] | None]]:
    """find() with the canonical entity of each place, and untitled repeats of a person's names with the range of names they give."""
    found = find(text)
    out = [(a, b, kind, canonical(kind, text[a:b]), None) for a, b, kind in found]
    forms: dict[tuple[str, ...], tuple[str, tuple[int, int]]] = {}
    for a, b, kind, entity, _ in out:
        if kind == "person":
            names = text[a:b].split()[1:]
            for i in range(len(names)):
                for j in range(i + 1, len(names) + 1):
                    forms.setdefault(tuple(names[i:j]), (entity, (i, j)))
    if not forms:
        return out
    longest, at, free = max(map(len, forms)), 0, []
    for m in _WORD.finditer(text):  # capitalised words outside the places found
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if at == len(found) or m.end() <= found[at][0]:
            free.append((m.start(), m.start() + _bare(m[0])))
    k = 0
    while k < len(free):
        for n in range(min(longest, len(free) - k), 0, -1):
            some = free[k : k + n]
            if all(text[x[1] : y[0]].isspace() for x, y in zip(some, some[1:])) and (hit := forms.get(tuple(text[a:b] for a, b in some))):
                out.append((some[0][0], some[-1][1], "person", *hit))
                k += n
                break
        else:
            k += 1
    return sorted(out, key=lambda x: x[:2])


def _permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a balanced Feistel network with cycle walking."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(7, -1, -1) if back else range(8):
            f = hmac.digest(key, tweak + bytes([r]) + (left if back else right).to_bytes(width, "big"), "sha256")
            f = int.from_bytes(f * (1 + width // 32), "big") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = (left << half) | right
        if value < size:
            return value


def _derange(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """One step on a keyed cycle through all of range(size): a permutation that moves every value."""
    return _permute((_permute(value, size, key, tweak) + 1) % size, size, key, tweak, True)


def _shaped(chars: str, key: bytes, tweak: str, kinds: str | None = None) -> str:
    """chars (lower case) permuted among the strings with the same classes of characters at each place; others stay.

    Only where no character has a class do they come back as they were."""
    classes = kinds or "".join(_CLASS.get(c, "-") for c in chars)
    value, size = 0, 1
    for c, k in zip(chars, classes):
        if k != "-":
            value, size = value * len(_ALPHABETS[k]) + _ALPHABETS[k].index(c), size * len(_ALPHABETS[k])
    value, out = _derange(value, size, key, f"{tweak}|{classes}".encode()) if size > 1 else 0, []
    for c, k in zip(reversed(chars), reversed(classes)):
        if k == "-":
            out.append(c)
        else:
            value, at = divmod(value, len(_ALPHABETS[k]))
            out.append(_ALPHABETS[k][at])
    return "".join(reversed(out))


def _letters(tweak: str, key: bytes, count: int, script: str = "latin") -> str:
    letters = _ALPHABETS[{"cyrillic": "c", "greek": "g"}.get(script, "a")]
    value = int.from_bytes(hmac.digest(key, f"{tweak}|letters".encode(), "sha256"), "big")
    return "".join(letters[value // len(letters) ** k % len(letters)] for k in range(count))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def canonical(kind: str, surface: str) -> str:
    if kind == "person":
        title, *names = surface.split()
        return f"{TITLES[title.rstrip('.')] if title.rstrip('.') in TITLES else TITLES.get(title, 'n')} {' '.join(names).lower()}"
    if kind in ("card", "phone", "ssn"):
        return ("+" if surface.startswith("+") else "") + re.sub(r"\D", "", surface)
    return re.sub(r"\s", "", surface).lower()


@lru_cache(20_000)
def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a canonical entity, itself canonical."""
    tweak = f"{kind}|{attempt}"
    if kind == "person":
        gender, *names = entity.split(" ")
        script = "cyrillic" if names[-1][0] in _ALPHABETS["c"] else "greek" if "Ͱ" <= names[-1][0] < "Ѐ" else "latin"
        # surnames don't depend on the given name, its gender or the attempt
        out = [x if (x := _shaped(n, key, "person|surname")) != n else n + _letters(n, key, 1, script) for n in names[min(1, len(names) - 1) :]]
        if len(names) > 1:
            given, own = GIVEN.get((script, gender)) or GIVEN.get((script, "m")), f"{tweak}|{' '.join(names)}"
            at = int.from_bytes(hmac.digest(key, own.encode(), "sha256")[:8], "big") % len(given)
            # after the first attempts the names grow by a letter each time, so a free one always comes
            out.insert(0, given[at].lower() + _letters(own, key, max(0, attempt - 2), script))
        return f"{gender} {' '.join(out)}"
    if kind == "card" and luhn(entity):  # numbers with a right check digit keep one
        body = _shaped(entity[:-1], key, tweak + "|luhn")
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "card":  # on along the cycle to the next one with a wrong check digit: distinct, and none of those above
        new = _shaped(entity, key, tweak)
        while luhn(new):
            new = _shaped(new, key, tweak)
        return new
    if kind == "ip":
        v = _derange(int.from_bytes(bytes(map(int, entity.split("."))), "big"), 2**32, key, tweak.encode())
        return ".".join(map(str, v.to_bytes(4, "big")))
    if kind == "phone":
        lead = 2 if entity.startswith("+1") else 3 if entity.startswith("+") else 0  # the country stays
        keep = entity[5:8] == "555" and lead == 2  # numbers reserved for fiction stay so
        free = entity[2:5] + entity[8:] if keep else entity[lead:]
        new = _shaped(free, key, tweak + "|" + entity[:lead])
        while lead == 2 and not keep and new[3:6] == "555":
            new = _shaped(new, key, tweak + "|" + entity[:lead])
        return entity[:lead] + (new[:3] + "555" + new[3:] if keep else new)
    if kind == "secret" and re.fullmatch("[0-9a-f]+", entity):
        return _shaped(entity, key, tweak, "h" * len(entity))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        head, _, top = domain.rpartition(".")
        new = _shaped(f"{local}@{head}", key, tweak + "|" + top)
        if new == f"{local}@{head}":  # marks alone: nothing to permute
            new = f"{local}{_letters(f'{tweak}|{entity}', key, attempt + 1)}@{head}"
        return f"{new}.{top}"
    if kind == "iban":
        return entity[:2] + _shaped(entity[2:], key, tweak + "|" + entity[:2])
    return _shaped(entity, key, tweak)


def render(kind: str, surface: str, new: str, part: tuple[int, int] | None = None) -> str:
    """new in the format of surface: separators, case and title as they were. part: which of a person's names an untitled surface has."""
    if kind == "person":
        gap = re.split(r"(\s+)", surface)
        names, title = (iter(new.split(" ")[1:][slice(*part)]), []) if part else (iter(new.split(" ")[1:]), gap[:1])
        return "".join(title + [x if x.isspace() else _cased(next(names), x) for x in gap[len(title) :]])
    if kind == "ip":
        return new
    chars, out = iter(new.lstrip("+") if kind in ("card", "phone", "ssn") else new), []
    for c in surface:
        if kind in ("card", "phone", "ssn"):
            out.append(next(chars) if c.isdigit() else c)
        elif c.isspace():
            out.append(c)
        else:
            x = next(chars)
            out.append(x.upper() if c.isupper() else x)
    return new if kind == "email" and len(new) > len(surface) else "".join(out)


def _cased(name: str, surface: str) -> str:
    return "".join(x.upper() if c.isupper() else x for x, c in zip(name, surface)) if len(name) == len(surface) else name.capitalize()


def _key(secret: str) -> bytes:
    if not secret:
        raise ValueError("surrogates need a secret")
    return hashlib.sha256(secret.encode()).digest()


def exceptions(docs: DataFrame, secret: str) -> DataFrame:
    """kind, entity, attempt of the entities that cannot take their first surrogate; checked over all distinct entities.

    A surrogate should not be another real entity either. Where TRIES attempts find no other string, because most of a shape's
    strings are real, that is given up and the first surrogate stays: no two entities share one in any case."""
    key = _key(secret)

    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(kind, entity) for t in pdf["text"] if t for _, _, kind, entity, _ in mentions(t)}
            yield pd.DataFrame([(k, e, surrogate(k, e, key)) for k, e in rows], columns=["kind", "entity", "new"])

    found = materialize(docs.select("text").mapInPandas(entities, "kind string, entity string, new string").distinct(), "entities")
    shared = found.groupBy("kind", "new").agg(F.min("entity").alias("keeps"), F.count(F.lit(1)).alias("n"))
    clash = found.join(shared.where("n > 1"), ["kind", "new"]).where("entity <> keeps").select("kind", "entity").unionByName(found.where("entity = new").select("kind", "entity"))
    real = found.select("kind", F.col("entity").alias("new")).distinct()
    movable = ~((F.col("kind") == "person") & (F.size(F.split("entity", " ")) == 2))  # a bare surname has one surrogate
    must = materialize(clash.select("kind", "entity").distinct(), "must")  # these have no surrogate without another attempt
    clash = must.unionByName(found.where(movable).join(real, ["kind", "new"], "left_semi").select("kind", "entity")).distinct()
    # the least free attempt: these entities are the rare ones. First surrogates stay reserved, so that one can be gone back to
    out, attempt = [], 1
    taken = found.select("kind", "new")
    while clash.limit(1).count():
        def again(batches: Iterator[pd.DataFrame], n: int = attempt) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(new=[surrogate(k, e, key, n) for k, e in zip(pdf["kind"], pdf["entity"])], attempt=n)

        tried = materialize(clash.mapInPandas(again, "kind string, entity string, new string, attempt int"), "attempts")
        free = tried.where("entity <> new").join(taken, ["kind", "new"], "left_anti")
        free = free.join(real, ["kind", "new"], "left_anti") if attempt <= TRIES else free
        free = materialize(free.groupBy("kind", "new").agg(F.min("entity").alias("entity"), F.first("attempt").alias("attempt")), "free")
        out.append(free.select("kind", "entity", "attempt"))
        taken, clash, attempt = taken.unionByName(free.select("kind", "new")), tried.join(free, ["kind", "entity"], "left_anti").select("kind", "entity"), attempt + 1
        if attempt > TRIES:  # a dense shape: the first surrogate, a permutation's, is distinct all the same
            clash = clash.join(must, ["kind", "entity"], "left_semi")
    if not out:
        return docs.sparkSession.createDataFrame([], "kind string, entity string, attempt int")
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def _with_rare(base: DataFrame, rare: DataFrame, column: str) -> DataFrame:
    """base with a column of the exceptional entities of its text and their attempts, joined by the text's digest."""

    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(hashlib.sha256(t.encode()).hexdigest(), kind, entity) for t in pdf["text"] if t for _, _, kind, entity, _ in mentions(t)}
            yield pd.DataFrame(list(rows), columns=["_key", "kind", "entity"])

    own = base.select("text").mapInPandas(entities, "_key string, kind string, entity string").distinct().join(rare, ["kind", "entity"])
    per = materialize(own.groupBy("_key").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(column)), "rare")  # of one text
    return base.join(per, F.sha2("text", 256) == F.col("_key"), "left").drop("_key")


def replace_private(docs: DataFrame, secret: str, most: int = 100_000) -> DataFrame:
    """All columns of docs with the text's entities replaced, and `entities`: their places in the original, kinds and surrogates.

    Where docs has a column of that name, the new one has underscores behind it. Up to `most` exceptional entities travel with
    the tasks; more of them are joined to the texts that have them."""
    small_batches(docs.sparkSession)
    key, rare = _key(secret), materialize(exceptions(docs, secret), "exceptions")
    few = rare.limit(most + 1).collect()
    joined = len(few) > most
    later = {} if joined else {(r["kind"], r["entity"]): r["attempt"] for r in few}
    place = "struct<start: int, end: int, kind: string, surrogate: string>"

    def swap(text: str | None, rare: list | None) -> tuple[str | None, list[dict]]:
        parts, at, own = [], 0, []
        attempts = {(r["kind"], r["entity"]): r["attempt"] for r in rare} if rare is not None else later
        for a, b, kind, e, part in mentions(text) if text else ():
            new = render(kind, text[a:b], surrogate(kind, e, key, int(attempts.get((kind, e), 0))), part)
            parts += [text[at:a], new]
            at = b
            own.append({"start": a, "end": b, "kind": kind, "surrogate": new})
        return text if not own else "".join([*parts, text[at:]]), own

    rows = (lambda *sides: pd.DataFrame([swap(*x) for x in zip(*sides)], columns=["text", "entities"]))
    kind = f"text string, entities array<{place}>"
    name, out, rare_name = free_name(docs, "entities"), free_name(docs, "_out"), free_name(docs, "_rare")
    if joined:
        udf = F.pandas_udf(lambda text, rare: rows(text, rare), kind)
        full = _with_rare(docs, rare, rare_name).withColumn(out, udf("text", rare_name))
    else:
        udf = F.pandas_udf(lambda text: rows(text, [None] * len(text)), kind)
        full = docs.withColumn(out, udf("text"))
    return full.select(*(F.col(f"{out}.text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.col(f"{out}.entities").alias(name))
