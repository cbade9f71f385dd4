"""Text functions as Column expressions (no Python in tasks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once

#: Entity names that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "eacute": "é", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "hellip": "…"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def s_stem(token: Column) -> Column:
    """Harman's S-stemmer."""
    return (
        F.when(token.rlike("ies$") & ~token.rlike("[ae]ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("es$") & ~token.rlike("[aeo]es$"), F.regexp_replace(token, "es$", "e"))
        .when(token.rlike("s$") & ~token.rlike("[us]s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def whole_words(words: list[str], plural: bool = False) -> str:
    """A pattern for any of the words between ASCII boundaries."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)}){'s?' if plural else ''}(?![A-Za-z0-9_])"


def slugify(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def price_cents(text: Column) -> Column:
    """The first number of a price text, commas dropped, in cents."""
    number = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+(?:\.\d+)?)", 1)
    return F.when(number != "", F.round(number.cast("double") * 100).cast("int"))


def truncate_words(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space at or before that place; hard where there is none."""
    head = F.regexp_extract(text, rf"(?s)^(.{{0,{most}}})(?: |$)", 1)
    return F.when(F.length(text) <= most, text).when(head != "", head).otherwise(F.substring(text, 1, most))


def numeric_entities(text: Column) -> Column:
    """&#233; and &#xe9; as characters; numbers that are none stay as they are."""
    pieces = F.split(text, "&#")

    def decoded(piece: Column) -> Column:
        dec, hexa = F.regexp_extract(piece, "^([0-9]{1,7});", 1), F.regexp_extract(piece, "^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(dec != "", dec.try_cast("long")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.concat(char, F.regexp_replace(piece, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(F.contains(text, F.lit("&#")), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags to spaces, entities decoded (numbers first, &amp; last), white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    out = numeric_entities(F.regexp_replace(out, r"<[^>]*>", " "))
    for name, char in ENTITIES.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(out, "[\\s\u00a0]+", " "))


def canonical_url(url: Column, keep: tuple[str, ...] = ()) -> Column:
    """Scheme and host in lower case, no fragment, no query but the parameters that identify an item."""
    base = F.regexp_replace(F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)", 1)), "^http:", "https:")
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    query = F.lit("")
    for name in keep:
        value = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
        query = F.concat(query, F.when(value != "", F.concat(F.when(query == "", "?").otherwise("&"), F.lit(f"{name}="), value)).otherwise(""))
    return F.concat(base, F.regexp_replace(path, "/+$", ""), query)


def height_cm(text: Column) -> Column:
    """Metric heights (120 to 220) first, then feet and inches."""
    metric = F.regexp_extract(text, r"(?i)(\d{3}(?:\.\d+)?)\s*cm", 1)
    feet, inches = F.regexp_extract(text, r"""([4-7])\s*(?:'|ft)""", 1), F.regexp_extract(text, r"""[4-7]\s*(?:'|ft)\s*(\d{1,2})""", 1)
    m = F.round(metric.try_cast("double")).cast("int")
    i = F.coalesce(inches.try_cast("int"), F.lit(0))
    return F.when(m.between(120, 220), m).when((feet != "") & (i <= 11), F.round(feet.try_cast("int") * 30.48 + i * 2.54).cast("int"))


def email(text: Column) -> Column:
    """Trimmed and in lower case, dots and plus kept; null where longer than 254 characters or of another shape."""
    t = F.lower(F.trim(text))
    return F.when((F.length(t) <= 254) & t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), t)


def unpadded_size(text: Column) -> Column:
    """Leading zeros before letters dropped ('0XL', '00S'); numbers stay."""
    return F.regexp_replace(text, r"^0+(?=[A-Za-z])", "")


def size_label(text: Column) -> Column:
    """XS to XXL, 2XL forms, numbers, waist x length and one size; other labels are null."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^(X{0,3}S|M|X{0,3}L|\dXL|\d{1,3}|\d{2}X\d{2}|ONE SIZE)$"), t)


def key_values(text: Column, keys: Sequence[str]) -> Column:
    """The map of a block 'key: value - key: value', cut where the next known key stands (longest first, in any case), so values may hold
    hyphens and separators may be missing. Keys in lower case; blank values are left out; the last of equal keys wins."""
    names = "|".join(sorted(keys, key=len, reverse=True))
    pieces = F.split(F.regexp_replace(text, rf"(?i)({names})\s*:", "\u0001$1\u0002"), "\u0001")
    value = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(p, "\u0002", -1), r"[\s-]+$", ""), r"^[\s-]+", ""))
    entries = F.transform(pieces, lambda p, i: F.when(i > 0, F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("key"), value(p).alias("value"))))
    filled = F.filter(entries, lambda e: e["value"] != "")
    last = lambda of: F.filter(of, lambda e, i: ~F.exists(F.slice(of, i + 2, F.size(of)), lambda later: later["key"] == e["key"]))
    return once(filled, lambda of: F.map_from_entries(last(of)))


def failure_kind(status: Column, message: Column) -> Column:
    """'terminal' for refused keys and for exhausted quotas, which 429 alone does not tell from a burst; else 'transient'. Nulls say nothing."""
    says = lambda pattern: F.coalesce(message.rlike(f"(?i){pattern}"), F.lit(False))
    refused = F.coalesce(status.isin(401, 403), F.lit(False)) | says(r"invalid[_ ]api[_ ]key|authentication|unauthorized|permission")
    limited = F.coalesce(status == 429, F.lit(False)) | says(r"\b429\b")
    spent = says(r"insufficient[_ ]quota|no credits|billing|exceeded your current quota|payment")
    return F.when(refused | (limited & spent), "terminal").otherwise("transient")
