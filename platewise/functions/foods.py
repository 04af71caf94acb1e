"""Rules of single foods: plausibility, ranks, codes, servings, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import to_float

#: National tables and their country; ``off`` is the branded export.
COUNTRY_OF_SOURCE = {
    "usda": "US", "ciqual": "FR", "bls": "DE", "bedca": "ES", "cofid": "UK", "matvaretabellen": "NO", "livsmedel": "SE", "fineli": "FI", "frida": "DK", "swiss": "CH", "tca": "PT", "cnf": "CA", "afcd": "AU", "nevo": "NL", "foodfiles": "NZ",
}
#: Where each source's ids begin.
ID_BASE = {
    "ciqual": 100_000_000, "usda": 200_000_000, "bls": 300_000_000, "bedca": 100_000_000_000, "cofid": 110_000_000_000, "matvaretabellen": 120_000_000_000, "livsmedel": 130_000_000_000, "fineli": 140_000_000_000, "frida": 150_000_000_000,
    "swiss": 160_000_000_000, "tca": 170_000_000_000, "cnf": 180_000_000_000, "afcd": 190_000_000_000, "nevo": 200_000_000_000, "foodfiles": 210_000_000_000, "off": 1_000_000_000_000,
}


def national_source(country: Column) -> Column:
    """The national table of a country's code, ``GB`` read as ``UK``; empty for a country without one."""
    table = F.create_map(*[F.lit(x) for source, code in COUNTRY_OF_SOURCE.items() for x in (code, source)])
    return F.coalesce(F.try_element_at(table, F.when(country == "GB", "UK").otherwise(country)), F.lit(""))


def atwater_predicted(protein: Column, fat: Column, carbs: Column) -> Column:
    """Energy of the macros: 4, 9 and 4 kcal a gram."""
    return protein * 4 + fat * 9 + carbs * 4


def atwater_discrepancy(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """Stated less predicted energy."""
    return kcal - atwater_predicted(protein, fat, carbs)


def atwater_ok(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """Within 35 kcal or 30 % of the stated energy, whichever is more."""
    return F.abs(atwater_discrepancy(kcal, protein, fat, carbs)) <= F.greatest(F.lit(35.0), kcal * 0.3)


def reject_reason(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """The first reason to reject a row of figures per 100 g, null if it may stay."""
    macros = (protein, fat, carbs)
    missing = protein.isNull() | fat.isNull() | carbs.isNull()
    outside = F.lit(False)
    for m in macros:
        outside = outside | (m < 0) | (m > 100)
    return (
        F.when(kcal.isNull(), "no energy").when((kcal < 0) | (kcal > 900), "energy range").when(missing, "incomplete macros").when(outside, "macro range")
        .when(protein + fat + carbs > 105, "macro sum").when((kcal == 0) & ((protein > 0.5) | (fat > 0.5)), "zero energy").when(~atwater_ok(kcal, *macros), "Atwater")
    )


def plausible(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """Whether figures that a person gives may be stored: the bounds, then the energy of the macros."""
    return F.coalesce(kcal.between(0, 900) & protein.between(0, 100) & fat.between(0, 100) & carbs.between(0, 100) & (protein + fat + carbs <= 105) & atwater_ok(kcal, protein, fat, carbs), F.lit(False))


def upstream_error(tags: Column) -> Column:
    """Whether the export's own checks flag a product."""
    out = F.lit(False)
    for part in ("energy-value", "value-total-over", "value-over-105", "greater-than"):
        out = out | F.coalesce(tags, F.lit("")).contains(part)
    return out


def contributable(kcal: Column, protein: Column, fat: Column, carbs: Column, name: Column, brand: Column) -> Column:
    """Whether a food may be offered to the export: plausible with energy, name (2) and brand (1) up to 120 characters, none of them hidden."""

    def text(c: Column, least: int) -> Column:
        return F.length(F.trim(c)).between(least, 120) & ~c.rlike(r"[\p{Cc}\p{Cf}\p{Co}]")

    return F.coalesce(plausible(kcal, protein, fat, carbs) & (kcal >= 1) & text(name, 2) & (brand.isNull() | text(brand, 1)), F.lit(False))


def goal_allowed(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """Whether targets are within 800 to 20,000 kcal and 0 to 5,000 g."""
    return F.coalesce(kcal.between(800, 20_000) & protein.between(0, 5_000) & fat.between(0, 5_000) & carbs.between(0, 5_000), F.lit(False))


def micro(value: Column, ceiling: float) -> Column:
    """A minor figure if it is between 0 and the ceiling."""
    return F.when(value.between(0, ceiling), value)


def clean_micros(fat: Column, carbs: Column, fibre: Column, sugar: Column, saturated: Column, sodium: Column) -> Column:
    """Struct of the four minor figures; a part above its whole (1 g, fibre 100 g allowed) is dropped."""
    f, s, a = micro(fibre, 100), micro(sugar, 100), micro(saturated, 100)
    return F.struct(F.when(f <= carbs + 100, f).alias("fibre"), F.when(s <= carbs + 1, s).alias("sugar"), F.when(a <= fat + 1, a).alias("saturated"), micro(sodium, 45).alias("sodium"))


def gtin_ok(code: Column) -> Column:
    """Whether a string is a code of 8, 12, 13 or 14 digits with the right check digit."""
    digits = F.transform(F.split(F.reverse(code), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce(code.rlike("^([0-9]{8}|[0-9]{12,14})$") & (total % 10 == 0), F.lit(False))


def clean_barcode(raw: Column) -> Column:
    """A trimmed code that a scanner can give, else null."""
    code = F.trim(raw)
    return F.when(gtin_ok(code), code)


#: Words that mark a preparation made from a food, compounds that are one, and words for the plain food.
DERIVATIVES = (
    "flour", "powder", "starch", "bran", "meal", "isolate", "concentrate", "extract", "dried", "dehydrated", "syrup", "nectar", "juice",
    "paste", "puree", "purée", "tart", "pie", "cake", "biscuit", "cookie", "pastry", "candy", "jam", "jelly", "oil",
)
COMPOUND_DERIVATIVES = (
    "cheesecake", "cheescake", "pancake", "oatcake", "fishcake", "hotcake", "minicake", "teacake", "rice-cake", "plumcake", "shortcake", "cornflour", "cornstarch", "oatbran", "sundried", "cornmeal",
    "tarte", "tartelette", "tartelete", "tartelle", "tarta", "tartine", "tartiner", "tartinade", "tartinable", "tartinata", "tartinette", "tartiflette", "tarteteig", "brandade", "tomatenpuree", "powdered",
    "jellybean", "candymix", "currypaste", "sesampaste", "tomatjuice", "pastete", "pastel", "biscuiti", "biscuithé", "boterbiscuit", "syrupwith", "concentrated", "pastryt", "nectarde", "starchy",
)
WHOLE = ("raw", "fresh", "whole", "unprocessed", "plain", "cru", "crua", "crus", "cruas")


#: Names that are milk itself, and whole milk as an ingredient.
MILK, WHOLE_MILK = r"^(milk(?![a-z])|whole milk(?! *[a-z]))", r"(?<![a-z])whole milk(?![a-z])"


def _words(words: tuple[str, ...]) -> str:
    """A pattern of whole words with an optional plural ending (none for ``meal``)."""
    return "(?<![a-z])(?:" + "|".join(w if w == "meal" else f"{w}s?" for w in words) + ")(?![a-z])"


def basic_rank(name: Column, source: Column, nova: Column) -> Column:
    """0 plain food, 1 ordinary, 2 made from a food. American biscuits are ordinary; whole milk as an ingredient is no mark
    of a plain food; for the branded export the processing group decides what the words leave open."""
    low = F.lower(name)
    derived = low.rlike(_words(DERIVATIVES)) | low.rlike(_words(COMPOUND_DERIVATIVES))
    american = (source == "usda") & ~low.rlike(_words(tuple(w for w in DERIVATIVES if w != "biscuit"))) & ~low.rlike(_words(COMPOUND_DERIVATIVES))
    is_milk = low.rlike(MILK)
    plain = F.when(is_milk, low).otherwise(F.regexp_replace(low, WHOLE_MILK, " ")).rlike("(?<![a-z])(?:" + "|".join(WHOLE) + ")(?![a-z])")
    branded = source == "off"
    return F.when(derived & ~american, 2).when(derived, 1).when(plain, 0).when(branded & (nova == 1), 0).when(branded & (nova == 4), 2).otherwise(1)


def source_rank(source: Column) -> Column:
    """0 for national tables, 1 for branded products."""
    return F.when(source.isin(*COUNTRY_OF_SOURCE), 0).otherwise(1)


def rank_name(source: Column, name: Column, aliases: Column) -> Column:
    """The English name by which a food is ranked: Dutch rows have it as an alias."""
    return F.when(source == "nevo", F.coalesce(F.get(F.filter(aliases, lambda a: a["lang"] == "en"), F.lit(0))["name"], name)).otherwise(name)


def quality_score(brand: Column, has_servings: Column, barcode: Column, source: Column, any_micro: Column, name: Column) -> Column:
    """40 and more for what a row has: brand 10, servings 15, code 5, national 20, a minor figure 5, a long name 5; at most 100."""

    def points(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    return F.least(F.lit(100), points(F.length(brand) > 0, 10) + points(has_servings, 15) + points(F.length(barcode) > 0, 5) + points(source.isin(*COUNTRY_OF_SOURCE), 20) + points(any_micro, 5) + points(F.length(name) >= 8, 5) + 40)


def display_key(name: Column, brand: Column, kcal: Column) -> Column:
    """What makes two records one line of a list: name, brand and energy in steps of 50 kcal."""
    return F.struct(F.lower(F.trim(name)).alias("name"), F.lower(F.trim(F.coalesce(brand, F.lit("")))).alias("brand"), F.floor(kcal / 50).alias("step"))


def stable_id(source: Column, key: Column) -> Column:
    """The id of a food from its publisher's key: the source's base and the key's number.

    German keys are read in base 36; UK keys ``left-right`` as left times 10,000 and right. Null for a key that has no number.
    """
    bases = F.create_map(*[F.lit(x) for kv in ID_BASE.items() for x in kv])
    german = F.conv(key, 36, 10).try_cast("long")
    uk = F.regexp_extract(key, r"^(\d+)-(\d+)$", 1).try_cast("long") * 10_000 + F.regexp_extract(key, r"^(\d+)-(\d+)$", 2).try_cast("long")
    number = F.when(source == "bls", german).when((source == "cofid") & key.contains("-"), uk).otherwise(F.regexp_replace(key, r"^[A-Z]", "").try_cast("long"))
    return F.try_element_at(bases, source).cast("long") + number


#: Portion words and their variants; labels that are units; the order in which portions are offered.
PORTIONS = {
    "serving": ("serving", "servings", "nlea serving", "pack serving", "portion"), "cup": ("cup", "cups"), "tablespoon": ("tbsp", "tablespoon", "tablespoons"), "teaspoon": ("tsp", "teaspoon", "teaspoons"), "slice": ("slice", "slices"),
    "piece": ("piece", "pieces"), "unit": ("unit", "units", "each"), "bar": ("bar", "bars"), "bottle": ("bottle", "bottles"), "can": ("can", "cans"), "package": ("package", "packages", "pack", "packet"), "small": ("small",), "medium": ("medium", "med"), "large": ("large",),
}
UNIT_LABELS = ("g", "gram", "grams", "kg", "oz", "ounce", "ounces", "fl oz", "fl. oz", "ml", "millilitre", "milliliter", "l", "litre", "liter", "lb", "pound", "quantity not specified", "undetermined")
OFFERED_FIRST = ("medium", "serving", "piece", "slice", "unit", "small", "large", "extra small", "extra large", "bar", "package", "can", "bottle", "jar", "steak", "fillet", "roast")
OFFERED_LAST = ("cup", "tablespoon", "teaspoon")
GRAMS = {"kg": 1000.0, "g": 1.0, "gram": 1.0, "grams": 1.0, "gramme": 1.0, "grammes": 1.0, "oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125}


def _lookup(pairs: list[tuple[str, object]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), key)


def serving_label(label: Column) -> Column:
    """A portion label as one of 14 words where it or what stands before its comma is one; else itself up to 24 characters."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(label, r"\s*\([^)]*\)", "")), "^,+|,+$", ""))
    words = [(v, k) for k, vs in PORTIONS.items() for v in vs]
    low = F.lower(clean)
    return F.coalesce(_lookup(words, low), _lookup(words, F.trim(F.split(low, ",")[0])), F.when(F.length(clean).between(1, 24), clean))


def is_named_serving(label: Column) -> Column:
    """Whether a label names a portion and not a unit."""
    return ~F.regexp_replace(F.lower(F.trim(label)), r"\.+$", "").isin(*UNIT_LABELS)


def serving_order(label: Column) -> Column:
    """Where a portion stands among others: known ones first, volumes last."""
    places = [*((w, i) for i, w in enumerate(OFFERED_FIRST)), *((w, 200 + i) for i, w in enumerate(OFFERED_LAST))]
    return F.coalesce(_lookup(places, F.lower(F.trim(label))), F.lit(100))


#: How a serving states a mass, or a volume.
MASS, VOLUME = r"(?i)([0-9.,]+)\s*(kg|g|gram(?:me)?s?|oz|ounces?)\b", r"(?i)([0-9.,]+)\s*(ml|cl|dl|l|litres?|liters?|fl\.?\s*oz)\b"


def serving_grams(text: Column, quantity: Column) -> Column:
    """Grams of a stated serving; null for volumes; the bare quantity only where no text stands."""
    s = F.trim(F.coalesce(text, F.lit("")))
    grams = to_float(F.regexp_extract(s, MASS, 1)) * _lookup(list(GRAMS.items()), F.lower(F.regexp_extract(s, MASS, 2)))
    return F.when(~s.rlike(VOLUME), F.when(s == "", quantity).otherwise(grams))


def clean_servings(servings: Column) -> Column:
    """An array of ``label, grams``: the first of each label with 1 to 2000 g, in the order offered, at most 8."""
    numbered = F.transform(servings, lambda s, i: F.struct(serving_order(s["label"]).alias("place"), i.alias("at"), s["label"].alias("label"), s["grams"].alias("grams"), F.lower(F.trim(s["label"])).alias("key")))
    fit = F.filter(numbered, lambda s: s["grams"].between(1, 2000))
    first = F.filter(fit, lambda s: ~F.exists(fit, lambda o: (o["key"] == s["key"]) & (o["at"] < s["at"])))
    return F.slice(F.transform(F.array_sort(first), lambda s: F.struct(s["label"].alias("label"), s["grams"].alias("grams"))), 1, 8)
