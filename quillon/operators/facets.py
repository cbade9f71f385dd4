"""Facets of a garment from its name and copy: ordered rules, all-match tags, labelled blocks, dictionaries for key-value blocks.

A rule table is text: a line `value: pattern, pattern` for each value, most specific first; '+' before the colon lets patterns have a
plural s. Patterns are whole words in any case. Other catalogs bring tables of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import all_matches, first_match, once

# The garment vocabulary, category/subcategory in the first table.
GARMENTS = """
swimwear/bikini-top+: bikini top, swim top, bralette top
swimwear/bikini-bottom+: bikini bottom, swim bottom
swimwear/swimsuit+: one[- ]?piece, swimsuit, maillot
swimwear/bikini-top+: bikini
intimates/bra-top+: bra top, bra camisole, bralette
top/bodysuit+: bodysuit
dress/maxi-dress+: maxi dress, gown
dress/midi-dress+: midi dress
dress/mini-dress+: mini dress
dress+: dress
jumpsuit/romper+: romper, playsuit
jumpsuit+: jumpsuit, overall
knitwear/hoodie+: hoodie, hooded sweatshirt
knitwear/sweatshirt+: sweatshirt
knitwear/cardigan+: cardigan
knitwear/vest+: sweater vest
knitwear/sweater+: sweater, jumper, pullover, rollneck
outerwear/blazer+: blazer
outerwear/coat+: trench, parka, puffer, overcoat, coat
outerwear/jacket+: jacket, windbreaker, anorak, bomber
top/t-shirt+: t[- ]?shirt, tee shirt, tee
top/tank+: tank top, tank
top/camisole+: camisole, cami
top/blouse+: blouse
top/polo+: polo
top/shirt+: shirt
top+: bustier, corset top
bottom/jeans+: jean, denim pant
bottom/leggings+: legging
bottom/joggers+: jogger, sweatpant
bottom/shorts+: short, skort
bottom/skirt+: skirt
bottom/trousers+: pant, trouser, chino, slack
outerwear/vest+: vest, gilet
accessory+: necklace, earring, bracelet, ring, bag, belt, scarf, hat, cap, sock
top+: top
"""
SINGLE = {
    "neckline": """
turtleneck: turtle ?neck, turtleneck, turtle
mock-neck: mock ?neck, high ?neck, funnel ?neck
mandarin-collar: mandarin collar, band collar
sweetheart: sweetheart
halter: halter, halterneck
strapless: strapless, bandeau, tube top
off-shoulder: off[- ]shoulder
one-shoulder: one[- ]shoulder
square: square ?neck
boat: boat ?neck, boatneck, bateau
scoop: scoop ?neck
cowl: cowl ?neck, cowl
plunge: plunge, plunging, deep v
v-neck: v[- ]?neck
crew: crew ?neck, crewneck, round ?neck
collared: collared, shirt collar
""",
    "sleeve_length": """
sleeveless+: sleeveless, tank, cami
three-quarter: 3/4, three[- ]quarter
cap+: cap sleeve
long+: long ?sleeve
short+: short ?sleeve
strapless: strapless
""",
    "length": """
cropped: cropped, crop, baby tee, shrunken
longline: longline
maxi: maxi, floor length
midi: midi
mini: mini, micro
ankle: ankle
""",
    "rise": """
high-rise: high[- ]?rise, hi[- ]?rise, high[- ]?waisted, high[- ]?waist
mid-rise: mid[- ]?rise
low-rise: low[- ]?rise, lo[- ]?rise, low[- ]?waisted, low[- ]?waist
""",
    "fit": """
oversized: oversized, mega, roomy, slouchy, baggy
relaxed: relaxed, loose, easy
fitted: fitted, slim, skinny, body ?con
regular: regular, classic, straight
""",
    "silhouette": """
a-line: a[- ]line, fit and flare, skater
wide-leg: wide[- ]leg, palazzo, barrel
mermaid: mermaid, trumpet, fishtail
sheath: sheath, pencil, column
bodycon: body ?con
wrap: wrap
shift: shift
oversized: oversized, mega
boxy: boxy
bubble: bubble, balloon
tapered: tapered
relaxed: relaxed
slim: slim
""",
    "pattern": """
floral+: floral, flower
striped+: striped, stripe, pinstripe
plaid+: plaid, tartan
checked+: checked, check, gingham
polka-dot+: polka ?dot, spotted
animal+: leopard, zebra, snake print, animal print
colorblock: colou?r ?block
tie-dye: tie[- ]dye
ribbed: ribbed, rib
pointelle: pointelle
jacquard: jacquard
lace: lace
textured: waffle, textured, crinkle
graphic+: graphic, logo, letter print
solid: solid, plain
""",
}
TAGS = {
    "details": """
tie-back: tie[- ]back, back tie, ties at the back
self-tie: self[- ]tie, tie waist, tie detail, tie front, tie(?![- ]dye)
drawstring+: drawcord, drawstring
button-front: button[- ](?:front|up|down), single breasted, double breasted
half-button: half[- ]button, henley
zip-front: zip[- ](?:up|front), full zip
cut-out+: cut[- ]?out, keyhole, hollow out
slit+: slit, split
ruched: ruched, ruching, gathered
smocked: smocked, smocking
shirred: shirred
pleated+: pleated, pleat
pockets+: pocket, inseam pocket, patch pocket
belted: belted, belt, cinched
ruffle+: ruffle, frill, flounce
lace-trim: lace trim, lace detail
embroidery: embroidered, embroidery
sequins+: sequin, sequinned
rhinestones+: rhinestone, diamante
pearls+: pearl
backless: backless
open-back: open[- ]back, low back
corset-back: corset
drop-shoulder: drop(?:ped)? shoulder, drop(?:ped)? shoulders
puff-sleeve: puff(?:ed)? sleeve, puff(?:ed)? sleeves, balloon sleeve
raw-hem: raw hem, frayed hem
cuffed: cuffed
elastic-waist: elastic(?:ated)? waist, pull[- ]on
high-low: high[- ]low, asymmetric hem
""",
    "occasion": r"""
lounge: pyjama, pajama, \bpj\b, sleep, lounge, robe, cozy, cosy, sweatfleece, fleece, sweatpant, jogger, hoodie, sweatshirt
beach: swim, bikini, beach, surfside, vacation, resort, cover[- ]up, poolside, sail
active: active, activewear, sport, training, workout, performance, dry[- ]ex, running, yoga
work: blazer, tailored, suit, office, workwear, trouser
formal: gown, formal, wedding, bridal
evening: cocktail, party, evening, sequin, bustier, satin
everyday: everyday, essential, classic, all[- ]time, daily
""",
    "season": """
winter: fleece, sweatfleece, thermal, heattech, puffer, quilted, wool, cashmere, parka, overcoat, turtleneck
summer: linen, gauze, chiffon, seersucker, swim, bikini, beach, sleeveless, tank, camisole, sundress
""",
}
COLORS = """
off-white: off[- ]white
light-blue: light blue, powder blue, pale blue, sky blue
multicolor: multi[- ]?colou?r, rainbow
navy: navy, midnight
ivory: ivory
cream: cream
beige: beige, sand, oatmeal
tan: taupe, tan, camel
brown: brown, chocolate, espresso
black: black, noir
grey: grey, gray, charcoal, heather
denim: denim
olive: olive, khaki
teal: teal
green: green, sage, emerald, forest
yellow: yellow, butter, lemon
apricot: apricot, peach
orange: orange, rust, terracotta
pink: pink, blush, rose, fuchsia
wine: wine, burgundy, maroon
red: red, crimson, scarlet
purple: purple, lilac, lavender, violet
white: white
blue: blue, cobalt, indigo
"""


def rules(table: str) -> list[tuple[str, str]]:
    """(pattern, value) of a rule table."""
    out = []
    for line in table.strip().splitlines():
        value, _, patterns = line.partition(": ")
        plural = value.endswith("+")
        out.append((rf"(?i)\b(?:{'|'.join(patterns.split(', '))}){'s?' if plural else ''}\b", value.removesuffix("+")))
    return out


def _any(table: str) -> str:
    """A pattern that matches where one of the table's rules does: most texts match none, and are searched once."""
    return rf"(?i)\b(?:{'|'.join(p.removeprefix(r'(?i)')[2:-2] for p, _ in rules(table))})\b"


def _first(text: Column, table: str) -> Column:
    return F.when(text.rlike(_any(table)), first_match(text, rules(table)))


def _all(text: Column, table: str) -> Column:
    return F.when(text.rlike(_any(table)), F.array_distinct(all_matches(text, rules(table)))).otherwise(F.array().cast("array<string>"))


def facets(name: Column, description: Column) -> Column:
    """A struct of category, subcategory and the facets of SINGLE and TAGS, and colors. Single values come from the name if it has one,
    else from name and description; colours from the name alone, for copy names colours that a garment is not. Null texts are empty."""
    n = F.coalesce(name, F.lit(""))
    texts = F.struct(n.alias("name"), F.concat_ws(" ", n, F.coalesce(description, F.lit(""))).alias("both"))
    return once(texts, lambda t: once(F.split(_pick(t["name"], t["both"], GARMENTS), "/"), lambda garment: _facets(t["name"], t["both"], garment)))


def _pick(name: Column, both: Column, table: str) -> Column:
    return F.coalesce(_first(name, table), _first(both, table))


def _facets(name: Column, both: Column, garment: Column) -> Column:
    singles = [_pick(name, both, table).alias(f) for f, table in SINGLE.items()]
    tags = [_all(both, table).alias(f) for f, table in TAGS.items()]
    return F.struct(garment[0].alias("category"), F.get(garment, F.lit(1)).alias("subcategory"), *singles, _all(name, COLORS).alias("colors"), *tags)


def labelled_facets(description: Column) -> Column:
    """A struct of fit, silhouette (from 'Fit: ...'), rise (from 'Rise: ...'), neckline and sleeve_length (from sentences): null where the block says nothing."""
    block = lambda label: F.regexp_extract(description, rf"(?i)\b{label}:\s*([^.]+)\.", 1)
    found = {"fit": (block("Fit"), "fit"), "silhouette": (block("Fit"), "silhouette"), "rise": (block("Rise"), "rise"), "neckline": (description, "neckline"), "sleeve_length": (description, "sleeve_length")}
    read = lambda text, table: once(text, lambda t: _first(t, table))
    return F.struct(*(read(text, SINGLE[f]).alias(name) for name, (text, f) in found.items()))


def overridden(base: Column, over: Column, names: Sequence[str]) -> Column:
    """base with the values of over where it has any."""
    for n in names:
        base = base.withField(n, F.coalesce(over[n], base[n]))
    return base


def lookup(value: Column, table: Mapping[str, str]) -> Column:
    """By the whole value, else by the longest key that it contains; null for neither."""
    names = sorted(table, key=len, reverse=True)
    whole = F.create_map(*(F.lit(x) for e in table.items() for x in e))
    within = lambda k: F.coalesce(*(F.when(F.contains(k, F.lit(name)), F.lit(table[name])) for name in names))
    return once(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")), lambda k: F.coalesce(F.try_element_at(whole, k), within(k)))


def lookup_many(values: Column, table: Mapping[str, str]) -> Column:
    """lookup() of each part between commas and slashes, each result once; null is empty."""
    parts = F.filter(F.transform(F.split(values, "[,/]"), lambda v: F.trim(v)), lambda v: v != "")
    found = F.filter(F.transform(parts, lambda v: lookup(v, table)), lambda v: v.isNotNull())
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def block_facets(block: Column, tables: Mapping[str, Mapping[str, str]], fabrics: Sequence[str]) -> Column:
    """Facets of a key-value block (a map with keys in lower case), by the tables silhouette, neckline, sleeve, pattern, waist, position, shoulder, detail, occasion, season.

    Silhouette falls back on the dress type, sleeves on their type, the pattern on the material; what stands for the shoulder is in the sleeve type, else under neckline."""
    return once(block, lambda b: _block_facets(b, tables, fabrics))


def _block_facets(block: Column, tables: Mapping[str, Mapping[str, str]], fabrics: Sequence[str]) -> Column:
    at = lambda key: F.try_element_at(block, F.lit(key))
    first = lambda table, *keys: F.coalesce(*(lookup(at(k), tables[table]) for k in keys))
    many = lambda table, *keys: F.array_distinct(F.concat(*(lookup_many(at(k), tables[table]) for k in keys)))
    stretch = F.lower(at("fabric stretch"))
    cloth = F.filter(F.transform(F.split(at("material"), "[,/]"), lambda v: F.lower(F.trim(v))), lambda v: v.isin(*fabrics))
    return F.struct(
        first("silhouette", "silhouette", "dress type").alias("silhouette"), first("neckline", "neckline").alias("neckline"), first("sleeve", "sleeve length", "sleeve type").alias("sleeve_length"), first("pattern", "pattern type", "material").alias("pattern"),
        first("waist", "waist").alias("rise"), F.when(F.contains(stretch, F.lit("high stretch")), "fitted").when(F.contains(stretch, F.lit("no stretch")), "regular").alias("fit"), many("detail", "embellishment").alias("details"), many("occasion", "occasion", "style").alias("occasion"),
        many("season", "season").alias("season"), F.coalesce(F.array_distinct(cloth), F.array().cast("array<string>")).alias("fabric"), first("position", "waist").alias("waist_position"), first("shoulder", "sleeve type", "neckline").alias("shoulder"), at("fabric").alias("composition"),
    )
