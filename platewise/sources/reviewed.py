"""The Dutch and the New Zealand set: strict files in, records and figures out, or nothing; and what was stored held against the files.

Rules that refuse a file are tables of violations: the first rows of one that isn't empty are named in the error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import parse_nutrient
from ..operators.tables import ContractError, assert_empty, assert_unique, unique_or_null
from .common import FIELDS

#: The figures that are taken of each set, by code: nutrient, unit, field of the record.
DUTCH = {
    "ENERCC": ("CALORIES", "kcal", "kcal"), "PROT": ("PROTEIN", "g", "protein"), "FAT": ("FAT", "g", "fat"), "CHO": ("CARBS", "g", "carbs"), "FIBT": ("FIBRE", "g", "fibre"), "SUGAR": ("SUGAR", "g", "sugar"),
    "FASAT": ("SATURATED_FAT", "g", "saturated"), "NA": ("SODIUM", "mg", "sodium"),
}
ZEALAND = {
    "ENERC_FSANZ2_KCAL": ("CALORIES", "kcal", "kcal"), "PROT": ("PROTEIN", "g", "protein"), "FAT": ("FAT", "g", "fat"), "CHOAVL_FSANZ": ("CARBS", "g", "carbs"), "FIBTG": ("FIBRE", "g", "fibre"), "SUGAR": ("SUGAR", "g", "sugar"),
    "FASAT": ("SATURATED_FAT", "g", "saturated"), "NA": ("SODIUM", "mg", "sodium"),
}
DUTCH_VERSION, ZEALAND_VERSION = "NEVO-Online 2025 9.0", "FOODfiles 2024 v1"
#: Headers of the Dutch files.
KEY, NL, EN, BASIS, RELEASE = "NEVO-code", "Voedingsmiddelnaam/Dutch food name", "Engelse naam/Food name", "Hoeveelheid/Quantity", "NEVO-versie/NEVO-version"
TRACE, FORTIFIED, FLAG, SYNONYM = "Bevat sporen van/Contains traces of", "Is verrijkt met/Is fortified with", "Spoor / Verrijkt/Trace / Fortified", "Synoniem"
CODE, VALUE, UNIT, SOURCE_CODE, REFERENCE = "Nutrient-code", "Gehalte/Value", "Eenheid/Unit", "Broncode/Source code", "Referentie/Reference"
#: Letters of a New Zealand figure's type, and where it comes from.
VALUE_TYPES = {"TR": "TRACE", "trace": "TRACE", "BL": "BELOW_DETECTION", "BQ": "BELOW_QUANTIFICATION", "BLX": "BELOW_DETECTION_OR_QUANTIFICATION", "LZ": "LOGICAL_ZERO", "UD": "UNDECIDABLE", "BE": "BEST_ESTIMATE", "AV": "AVERAGE", "W": "WEIGHTED", "X": "UNSPECIFIED"}
PROVENANCE = ("Source Code", "Acquisition Type Code", "Method Type Code", "Method Indicator Code")
#: Foods left out after review and the figures for which they were; portions hidden after review, with their weights;
#: the one portion of two weights, and the one that counts; the one row with a separator too many.
QUARANTINE = (("B1035", "FAT", "2.6", "LZ"), ("C59", "CHOAVL_FSANZ", "101", None), ("C59", "SUGAR", "101", None), ("P10010", "FAT", "20.4", None), ("P10010", "FASAT", "21.8", None))
HIDDEN = (
    ("P10005", "1 pinch fine", 0.32), ("P10007", "1 pinch fine", 0.38), ("P24", "1 teaspoon (5 mL)", 0.6), ("P27", "1 teaspoon (5 mL)", 0.6), ("P31", "1 teaspoon (5 mL)", 0.6), ("P40", "1 teaspoon (5 mL)", 0.6), ("P46", "1 teaspoon (5 mL)", 0.3),
    ("P54", "1 teaspoon (5 mL)", 0.7), ("X1014", "1 roll sushi (approximately, 42 g) seaweed wrap", 0.95),
)
TWO_WEIGHTS = ("M1148", "1 cup (250 mL) diced ", ((200.0, 0.8), (215.0, 0.86)), 215.0)
EXTRA_CELL = ("Names", "M1144")


def read_cells(spark: SparkSession, path: str, sep: str, required: list[str], *, licence: str | None = None, extra: str | None = None) -> DataFrame:
    """The required columns of a separated file with a header, as text; blank cells are empty, never null.

    Refused are files that lack a required column or repeat one, and rows of another length (but for one cell too many in the
    row whose first cell is ``extra``). ``licence``: what a first line before the header must match.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))
    first = [r["value"] for r in lines.limit(1 if licence is None else 2).collect()]
    if licence is not None and (not first or not spark.range(1).select(F.lit(first[0]).rlike(licence)).first()[0]):
        raise ContractError(f"{path}: first line")
    head = first[-1].split(sep) if len(first) == (1 if licence is None else 2) else []
    names = [h.strip('"') for h in head]
    if bad := [c for c in required if names.count(c) != 1]:
        raise ContractError(f"{path}: missing or repeated {bad}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.length(F.regexp_replace(F.regexp_replace("value", '"(?:[^"]|"")*"', ""), f"[^{sep}]", "")) + 1  # separators outside quotes, and one
    rows = lines.filter(~F.col("value").isin(*first) & (F.col("value") != "")).select("value", cells.alias("cells"), F.from_csv("value", schema, {"sep": sep}).alias("c"))
    wrong = (F.col("cells") != len(names)) & ~((F.col("cells") == len(names) + 1) & F.col("c.c0").eqNullSafe(F.lit(extra)))
    assert_empty(rows.filter(wrong).select("value"), f"{path}: cells")
    return rows.select(*[F.coalesce(F.col(f"c.c{names.index(c)}"), F.lit("")).alias(c) for c in required])


def assert_composition(foods: DataFrame, key: str, what: str) -> None:
    """Refuse foods without energy or a macro, or with figures out of range, a part above its whole, or macros without energy."""
    limit = F.lit(False)
    for f in FIELDS:
        limit = limit | ~F.coalesce(F.col(f).between(0, 900 if f == "kcal" else 45 if f == "sodium" else 100), F.lit(True))
    missing = F.col("kcal").isNull() | F.col("protein").isNull() | F.col("fat").isNull() | F.col("carbs").isNull()
    parts = F.coalesce(F.col("sugar") > F.col("carbs") + 1, F.lit(False)) | F.coalesce(F.col("saturated") > F.col("fat") + 1, F.lit(False))
    empty = (F.col("kcal") == 0) & ((F.col("protein") > 0.5) | (F.col("fat") > 0.5))
    assert_empty(foods.filter(missing | limit | (F.col("protein") + F.col("fat") + F.col("carbs") > 105) | parts | F.coalesce(empty, F.lit(False))).select(key), f"{what}: composition")


def _long(selected: dict[str, tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c, n, u, f) for c, (n, u, f) in selected.items()], "code string, nutrient string, unit string, field string"))


def _figures(cells: DataFrame, dataset: str, version: str) -> DataFrame:
    """``key, code, nutrient, field, figure, origin`` from ``key, code, nutrient, unit, field, raw, kind, references``; any that the grammar refuses refuse the source."""
    figure = parse_nutrient(F.col("raw"), F.col("unit"), F.col("nutrient"), F.col("kind"))
    origin = F.struct(F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), F.col("key").alias("food_id"), F.col("code").alias("nutrient_code"), "references")
    out = cells.select("key", "code", "nutrient", "field", figure.alias("figure"), origin.alias("origin"))
    assert_empty(out.filter("figure.error is not null").select("key", "code", "figure.error"), f"{dataset}: figures")
    return out


def _wide(figures: DataFrame) -> DataFrame:
    return figures.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("figure.value"))).alias(f) for f in FIELDS])


def _record(df: DataFrame, source: str, country: str, lang: str) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "id", "key", "name", none.cast("string").alias("brand"), none.cast("string").alias("barcode"), F.lit(source).alias("source"), F.lit(lang).alias("lang"), F.lit(country).alias("country"), *FIELDS, F.lit("available").alias("carbs_convention"), "basis",
        "density", none.cast("int").alias("nova"), F.lit(0).alias("popularity"), F.col("aliases").cast("array<struct<lang:string,name:string>>").alias("aliases"), F.col("servings").cast("array<struct<label:string,grams:double>>").alias("servings"),
        F.col("id").alias("ord"), none.cast("string").alias("reject_reason"),
    )


def dutch_id(code: Column) -> Column:
    """The id of a Dutch food."""
    return F.lit(200_000_000_000) + code.cast("long")


def zealand_id(code: Column) -> Column:
    """The id of a New Zealand food: its letter and number, whatever the order of rows."""
    return F.lit(210_000_000_000) + (F.ascii(code) - 65) * F.lit(100_000_000) + F.substring(code, 2, 8).cast("long")


def _annotated(cell: Column) -> Column:
    return F.filter(F.split(cell, ", "), lambda x: x != "")


def dutch_tables(spark: SparkSession, wide: str, definitions: str, details: str) -> dict[str, DataFrame]:
    """The three Dutch files as they are: ``wide``, ``definitions``, ``details``."""
    cells = [f"{c} ({u})" for c, (_, u, _) in DUTCH.items()]
    return {
        "wide": read_cells(spark, wide, "|", [KEY, NL, EN, BASIS, RELEASE, TRACE, FORTIFIED, SYNONYM, *cells]),
        "definitions": read_cells(spark, definitions, "|", [CODE, UNIT]),
        "details": read_cells(spark, details, "|", [KEY, NL, EN, BASIS, RELEASE, CODE, VALUE, UNIT, FLAG, SOURCE_CODE, REFERENCE]),
    }


def _dutch_cells(wide: DataFrame) -> DataFrame:
    """``key, code, nutrient, unit, field, raw, flag`` of the eight figures of each food, and what the details must repeat."""
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("nutrient"), F.lit(u).alias("unit"), F.lit(f).alias("field"), F.col(f"`{c} ({u})`").alias("raw")) for c, (n, u, f) in DUTCH.items()])
    long_ = wide.select(F.col(f"`{KEY}`").alias("key"), *[F.col(f"`{c}`").alias(a) for c, a in ((NL, "nl"), (EN, "en"), (BASIS, "basis"), (RELEASE, "release"))], _annotated(F.col(f"`{TRACE}`")).alias("trace"), _annotated(F.col(f"`{FORTIFIED}`")).alias("fortified"), F.explode(cells).alias("x"))
    flag = F.when(F.array_contains("trace", F.col("x.code")), "TR").when(F.array_contains("fortified", F.col("x.code")), "+").otherwise("")
    return long_.select("key", "nl", "en", "basis", "release", "x.*", flag.alias("flag"))


def load_dutch(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``foods`` (records) and ``figures`` of the Dutch set, after the wide table agrees with the definitions and all details.

    Refused: units other than agreed, malformed or repeated ids, another release or basis, a missing name, annotations of unknown
    nutrients or both of trace and fortified, details of unknown foods or nutrients or that differ from the wide table in any
    cell, a figure without a detail, figures that the grammar or the composition rules refuse. Repeated details may differ
    in their references only. A published synonym is one alias, whole.
    """
    wide, definitions, details = tables["wide"], tables["definitions"], tables["details"]
    spark, key = wide.sparkSession, F.col(f"`{KEY}`")
    units = definitions.select(F.col(f"`{CODE}`").alias("code"), F.col(f"`{UNIT}`").alias("defined")).distinct()
    assert_unique(units, "code")
    selected = _long(DUTCH, spark)
    assert_empty(selected.join(units, "code", "left").filter(~F.col("unit").eqNullSafe(F.col("defined"))).select("code"), "nevo: definitions")
    assert_empty(wide.filter(~key.rlike("^[1-9][0-9]{0,9}$")).select(key), "nevo: ids")
    assert_unique(wide.select(key.alias("key")), "key")
    release, basis = F.col(f"`{RELEASE}`"), F.col(f"`{BASIS}`")
    assert_empty(wide.filter((release != DUTCH_VERSION) | ~basis.isin("per 100g", "per 100ml")).select(key), "nevo: release or basis")
    assert_empty(wide.filter((F.trim(F.col(f"`{NL}`")) == "") | (F.trim(F.col(f"`{EN}`")) == "")).select(key), "nevo: names")
    trace, fortified = _annotated(F.col(f"`{TRACE}`")), _annotated(F.col(f"`{FORTIFIED}`"))
    assert_empty(wide.filter(F.arrays_overlap(trace, fortified)).select(key), "nevo: trace and fortified overlap")
    named = wide.select(key.alias("key"), F.explode(F.array_union(trace, fortified)).alias("code"))
    assert_empty(named.join(units, "code", "left_anti"), "nevo: unknown annotations")

    cells = _dutch_cells(wide)
    d = details.select(key.alias("key"), F.col(f"`{CODE}`").alias("code"), *[F.col(f"`{c}`").alias(f"d_{a}") for c, a in ((NL, "nl"), (EN, "en"), (BASIS, "basis"), (RELEASE, "release"), (VALUE, "raw"), (UNIT, "unit"), (FLAG, "flag"))], F.struct(F.col(f"`{SOURCE_CODE}`").alias("code"), F.col(f"`{REFERENCE}`").alias("reference")).alias("r"))
    assert_empty(d.select("key").join(wide.select(key.alias("key")), "key", "left_anti"), "nevo: details of unknown foods")
    assert_empty(d.select("code").join(units, "code", "left_anti"), "nevo: details of unknown nutrients")
    met = d.filter(F.col("code").isin(*DUTCH)).join(cells, ["key", "code"])
    differ = reduce(Column.__or__, [F.col(c) != F.col(f"d_{c}") for c in ("nl", "en", "basis", "release", "raw", "unit", "flag")])
    assert_empty(met.filter(differ).select("key", "code"), "nevo: wide and details differ")
    references = met.groupBy("key", "code").agg(F.array_sort(F.collect_set("r")).alias("references"))
    full = cells.join(references, ["key", "code"], "left")
    assert_empty(full.filter((F.col("raw") != "") & F.col("references").isNull()).select("key", "code"), "nevo: figures without details")
    full = full.withColumn("references", F.coalesce("references", F.array().cast("array<struct<code:string,reference:string>>"))).withColumn("kind", F.when(F.col("flag") == "TR", "TRACE"))
    figures = _figures(full, "nevo", DUTCH_VERSION)

    names = [F.when(F.col("en") != F.col("nl"), F.struct(F.lit("en").alias("lang"), F.col("en").alias("name"))), F.when((F.col("synonym") != "") & (F.col("synonym") != F.col("nl")), F.struct(F.lit("nl").alias("lang"), F.col("synonym").alias("name")))]
    foods = wide.select(key.alias("key"), F.col(f"`{NL}`").alias("nl"), F.col(f"`{EN}`").alias("en"), F.col(f"`{SYNONYM}`").alias("synonym"), F.when(basis == "per 100ml", "ml").otherwise("g").alias("basis")).join(_wide(figures), "key")
    assert_composition(foods, "key", "nevo")
    none = F.array()
    foods = foods.select(dutch_id(F.col("key")).alias("id"), "key", F.col("nl").alias("name"), "basis", F.lit(None).cast("double").alias("density"), *FIELDS, F.array_compact(F.array(*names)).alias("aliases"), none.alias("servings"))
    return {"foods": _record(foods, "nevo", "NL", "nl"), "figures": figures}


def zealand_tables(spark: SparkSession, folder: str, data: str) -> dict[str, DataFrame]:
    """The four New Zealand files as they are: ``names``, ``codes``, ``data``, ``portions``."""
    licence = "^© Copyright .*2024\\.\\s*$"
    return {
        "names": read_cells(spark, f"{folder}/Names", "~", ["FoodID", "Food Name", "Short Food Name", "AlternativeNames"], licence=licence, extra=EXTRA_CELL[1]),
        "codes": read_cells(spark, f"{folder}/StandardCodes", "~", ["Code", "Unit Code", "Matrix Unit Code"], licence=licence),
        "data": read_cells(spark, f"{folder}/{data}", "~", ["FoodID", "Component Identifier", "Value", "Unit Code", "Matrix Unit Code", "Value Type Code", *PROVENANCE], licence=licence),
        "portions": read_cells(spark, f"{folder}/Csm", "~", ["FoodID", "Food Name", "CSM", "Measure", "Density (g/cm3)"], licence=licence),
    }


def _zealand_portions(portions: DataFrame) -> DataFrame:
    """``key, label, grams, why``: one weight for each portion; ``why`` says why a portion is left out, else null."""
    spark = portions.sparkSession
    p = portions.select(F.col("FoodID").alias("key"), F.col("CSM").alias("label"), F.col("Measure").try_cast("double").alias("grams"), F.nullif("Density (g/cm3)", F.lit("")).alias("d")).withColumn("density", F.col("d").try_cast("double"))
    inf = float("inf")
    assert_empty(p.filter(~F.coalesce((F.col("grams") > 0) & (F.col("grams") < inf), F.lit(False)) | (F.col("d").isNotNull() & ~F.coalesce((F.col("density") > 0) & (F.col("density") < inf), F.lit(False)))).select("key", "label"), "foodfiles: weights")
    p = p.filter(~F.col("key").isin(*{k for k, *_ in QUARANTINE}))
    food, label, weights, chosen = TWO_WEIGHTS
    sets = p.groupBy("key", "label").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.struct("grams", "density"))).alias("all"))
    pinned = F.array(*[F.struct(F.lit(g).alias("grams"), F.lit(x).alias("density")) for g, x in weights])
    is_pinned = (F.col("key") == food) & (F.col("label") == label)
    assert_empty(sets.filter((F.col("n") > 1) & ~(is_pinned & (F.col("n") == 2) & (F.col("all") == pinned))).select("key", "label"), "foodfiles: ambiguous portions")
    one = sets.select("key", "label", F.when(F.col("n") > 1, F.lit(chosen)).otherwise(F.get("all", F.lit(0))["grams"]).alias("grams"))
    hidden = F.broadcast(spark.createDataFrame(HIDDEN, "key string, label string, reviewed double"))
    seen = one.join(hidden, ["key", "label"], "left")
    assert_empty(seen.filter("reviewed is not null and grams <> reviewed").select("key", "label"), "foodfiles: hidden portions changed")
    assert_empty(seen.filter("reviewed is null and grams not between 1 and 2000").select("key", "label", "grams"), "foodfiles: portions out of range")
    kept = seen.select("key", "label", "grams", F.when(F.col("reviewed").isNotNull(), "tiny portion hidden").alias("why"))
    other = sets.filter("n > 1").select("key", "label", F.explode("all").alias("x")).filter(F.col("x.grams") != chosen).select("key", "label", F.col("x.grams").alias("grams"), F.lit("another published weight is taken").alias("why"))
    return kept.unionByName(other)


def load_zealand(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``foods`` (records), ``figures``, ``omitted`` (portions) and ``quarantined`` (foods) of the New Zealand set.

    Refused: malformed or repeated ids, a missing name, units or matrix other than agreed, unknown or repeated components, a
    reviewed food whose figures have changed, portions that name another food, weigh nothing, are ambiguous or out of range
    (but for the reviewed ones), a missing figure (fibre may be), and what grammar or composition rules refuse. Density is a
    food's where all its portions agree. Short and alternative names are one alias.
    """
    names, codes, data, portions = tables["names"], tables["codes"], tables["data"], tables["portions"]
    spark = names.sparkSession
    assert_empty(names.filter(~F.col("FoodID").rlike("^[A-Z][1-9][0-9]{0,7}$") | (F.trim("Food Name") == "")).select("FoodID"), "foodfiles: ids or names")
    assert_unique(names, "FoodID")
    assert_unique(codes, "Code")
    selected = _long(ZEALAND, spark)
    agreed = selected.join(codes.withColumnRenamed("Code", "code"), "code", "left")
    assert_empty(agreed.filter(~F.col("Unit Code").eqNullSafe(F.col("unit")) | ~F.col("Matrix Unit Code").eqNullSafe(F.lit("W"))).select("code"), "foodfiles: definitions")
    rows = data.withColumnRenamed("FoodID", "key").withColumnRenamed("Component Identifier", "code")
    ids = names.select(F.col("FoodID").alias("key"))
    assert_empty(rows.select("key").join(ids, "key", "left_anti"), "foodfiles: figures of unknown foods")
    assert_empty(rows.select("code").join(codes.select(F.col("Code").alias("code")), "code", "left_anti"), "foodfiles: unknown components")
    mine = rows.filter(F.col("code").isin(*ZEALAND))
    assert_empty(mine.groupBy("key", "code").count().filter("count > 1"), "foodfiles: repeated components")
    pinned = F.broadcast(spark.createDataFrame(QUARANTINE, "key string, code string, raw string, kind string")).join(ids, "key", "left_semi")
    changed = pinned.join(mine.select("key", "code", "Value", "Value Type Code"), ["key", "code"], "left").filter(~F.col("Value").eqNullSafe(F.col("raw")) | (F.col("kind").isNotNull() & ~F.col("Value Type Code").eqNullSafe(F.col("kind"))))
    assert_empty(changed.select("key", "code"), "foodfiles: reviewed figures changed")
    wrong = portions.withColumnRenamed("Food Name", "said").join(names.select("FoodID", "Food Name"), "FoodID", "left").filter(~F.col("Food Name").eqNullSafe(F.col("said")) | (F.trim("CSM") == ""))
    assert_empty(wrong.select("FoodID", "CSM"), "foodfiles: portions of other foods")
    weights = _zealand_portions(portions)

    left_out = pinned.select("key").distinct()
    kept = ids.join(left_out, "key", "left_anti")
    cells = kept.crossJoin(selected).join(mine, ["key", "code"], "left")  # eight rows a food
    assert_empty(cells.filter("Value is null and field <> 'fibre'").select("key", "code"), "foodfiles: missing components")
    assert_empty(cells.filter(F.col("Value").isNotNull() & ((F.col("Unit Code") != F.col("unit")) | (F.col("Matrix Unit Code") != "W"))).select("key", "code"), "foodfiles: units")
    kinds = F.create_map(*[F.lit(x) for kv in VALUE_TYPES.items() for x in kv])
    letter = F.nullif("Value Type Code", F.lit(""))
    kind = F.when(letter.isNotNull() & (letter != "+"), F.coalesce(F.try_element_at(kinds, letter), letter))
    references = F.when(F.col("Value").isNotNull(), F.array(*[F.struct(F.lit(p).alias("code"), F.col(p).alias("reference")) for p in PROVENANCE])).otherwise(F.array().cast("array<struct<code:string,reference:string>>"))
    figures = _figures(cells.withColumn("raw", F.col("Value")).withColumn("kind", kind).withColumn("references", references), "foodfiles", ZEALAND_VERSION)

    density = unique_or_null(portions.select(F.col("FoodID").alias("key"), F.nullif("Density (g/cm3)", F.lit("")).cast("double").alias("density")).filter("density is not null"), "key", "density")
    servings = weights.filter("why is null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", "grams"))).alias("servings"))
    other = F.array_distinct(F.filter(F.array("Short Food Name", "AlternativeNames"), lambda x: (x != "") & (x != F.col("Food Name"))))
    alias = F.when(F.size(other) > 0, F.array(F.struct(F.lit("en").alias("lang"), F.array_join(other, "\n").alias("name")))).otherwise(F.array().cast("array<struct<lang:string,name:string>>"))
    foods = names.withColumnRenamed("FoodID", "key").select("key", F.col("Food Name").alias("name"), alias.alias("aliases")).join(_wide(figures), "key").join(density, "key", "left").join(servings, "key", "left")
    assert_composition(foods, "key", "foodfiles")
    foods = foods.withColumn("id", zealand_id(F.col("key"))).withColumn("basis", F.lit("g")).withColumn("servings", F.coalesce("servings", F.array().cast("array<struct<label:string,grams:double>>")))
    return {"foods": _record(foods, "foodfiles", "NZ", "en"), "figures": figures, "omitted": weights.filter("why is not null"), "quarantined": left_out}


def _compare(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str], what: str, tolerance: float) -> DataFrame:
    """``key, reason`` where a row is on one side only, or a column differs: numbers beyond a tolerance, all else exactly."""
    e, a = expected.select(*keys, F.struct(*columns).alias("e")), actual.select(*keys, F.struct(*columns).alias("a"))
    both = e.join(a, keys, "full_outer")
    reasons = [F.when(F.col("a").isNull(), F.lit(f"{what}: missing")), F.when(F.col("e").isNull(), F.lit(f"{what}: unexpected"))]
    for c in columns:
        x, y = F.col(f"e.{c}"), F.col(f"a.{c}")
        near = x.eqNullSafe(y)
        if isinstance(expected.schema[c].dataType, T.DoubleType):
            near = near | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
        reasons.append(F.when(F.col("a").isNotNull() & F.col("e").isNotNull() & ~near, F.lit(f"{what}: {c}")))
    return both.select(F.concat_ws("/", *keys).alias("key"), F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def _raw_number(text: Column, unit: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double") / F.when(unit == "mg", 1000.0).otherwise(1.0)


def reconcile_dutch(tables: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """``key, reason``: what a stored catalogue has otherwise than the three Dutch files, worked out from the cells and not by the loader.

    ``stored``: ``foods`` (records), ``aliases`` (``food_id, lang, name``), ``servings`` (``food_id``), ``figures``. Held against the
    files are ids, names, basis, that no density or portion was made up, aliases, each figure, its notation, unit and
    qualifier, its origin, and its set of references.
    """
    wide = tables["wide"]
    w = wide.select(F.col(f"`{KEY}`").cast("long").alias("n"), F.col(f"`{NL}`").alias("name"), F.col(f"`{EN}`").alias("en"), F.col(f"`{SYNONYM}`").alias("synonym"), F.when(F.col(f"`{BASIS}`") == "per 100ml", "ml").otherwise("g").alias("basis")).withColumn("id", F.col("n") + 200_000_000_000)
    none = F.lit(None).cast("double")
    foods = stored["foods"].filter("source = 'nevo'")
    parts = [_compare(w.withColumns({"lang": F.lit("nl"), "country": F.lit("NL"), "carbs_convention": F.lit("available"), "density": none}), foods, ["id"], ["name", "basis", "lang", "country", "carbs_convention", "density"], "food", 1e-14)]
    parts.append(stored["servings"].join(w.select(F.col("id").alias("food_id")), "food_id", "left_semi").select(F.col("food_id").cast("string").alias("key"), F.lit("serving: made up").alias("reason")))
    names = w.select(F.col("id").alias("food_id"), "name", F.explode(F.array(F.struct(F.lit("en").alias("lang"), F.col("en").alias("alias")), F.struct(F.lit("nl").alias("lang"), F.col("synonym").alias("alias")))).alias("x")).filter("x.alias <> '' and x.alias <> name").select("food_id", "x.lang", F.col("x.alias").alias("name"))
    mine = stored["aliases"].join(w.select(F.col("id").alias("food_id")), "food_id", "left_semi").select("food_id", "lang", "name")
    parts.append(_compare(names.withColumn("there", F.lit(1)), mine.filter("lang <> 'en-GB'").withColumn("there", F.lit(1)), ["food_id", "lang", "name"], ["there"], "alias", 0))
    cells = _dutch_cells(wide)
    flags = F.when(F.col("flag") == "TR", F.array(F.lit("TRACE"))).otherwise(F.array().cast("array<string>"))
    refs = tables["details"].filter(F.col(f"`{CODE}`").isin(*DUTCH)).groupBy(F.col(f"`{KEY}`").alias("key"), F.col(f"`{CODE}`").alias("code")).agg(F.array_sort(F.collect_set(F.struct(F.col(f"`{SOURCE_CODE}`").alias("code"), F.col(f"`{REFERENCE}`").alias("reference")))).alias("references"))
    expected = cells.join(refs, ["key", "code"], "left").select(
        "key", "code", _raw_number(F.col("raw"), F.col("unit")).alias("value"), F.col("raw").alias("notation"), "unit", flags.alias("qualifiers"), F.lit("nevo").alias("dataset"), F.col("release").alias("version"), F.col("key").alias("food_id"), F.col("code").alias("nutrient_code"),
        F.coalesce("references", F.array().cast("array<struct<code:string,reference:string>>")).alias("references"),
    )
    return reduce(DataFrame.unionByName, [*parts, _compare(expected, _stored_figures(stored["figures"], "nevo"), ["key", "code"], ["value", "notation", "unit", "qualifiers", "dataset", "version", "food_id", "nutrient_code", "references"], "figure", 1e-14), _written(expected, foods, DUTCH, F.col("key").cast("long") + 200_000_000_000)])


def _stored_figures(figures: DataFrame, dataset: str) -> DataFrame:
    return figures.filter(F.col("origin.dataset") == dataset).select("key", "code", "figure.value", F.col("figure.source_value").alias("notation"), F.col("figure.source_unit").alias("unit"), "figure.qualifiers", "origin.dataset", "origin.version", "origin.food_id", "origin.nutrient_code", "origin.references")


def _written(expected: DataFrame, foods: DataFrame, selected: dict[str, tuple[str, str, str]], number: Column) -> DataFrame:
    """The figures in the record's own columns against those of the files."""
    there = foods.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f).alias("value")) for c, (_, _, f) in selected.items()])).alias("x")).select("id", "x.*")
    return _compare(expected.select(number.alias("id"), "code", "value"), there, ["id", "code"], ["value"], "column", 1e-12)


def reconcile_zealand(tables: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """``key, reason``: what a stored catalogue has otherwise than the four New Zealand files, worked out from the cells and not by the loader.

    As :func:`reconcile_dutch`; here portions (``servings``: ``food_id, label, grams``), density and the joined alias are held against
    the files as well, less what was reviewed and left out.
    """
    gone = sorted({k for k, *_ in QUARANTINE})
    names = tables["names"].filter(~F.col("FoodID").isin(*gone)).withColumn("id", zealand_id(F.col("FoodID")))
    p = tables["portions"].filter(~F.col("FoodID").isin(*gone)).withColumn("id", zealand_id(F.col("FoodID"))).withColumn("grams", F.col("Measure").cast("double"))
    density = p.filter("`Density (g/cm3)` <> ''").groupBy("id").agg(F.collect_set(F.col("Density (g/cm3)").cast("double")).alias("d")).select("id", F.when(F.size("d") == 1, F.get("d", F.lit(0))).alias("density"))
    foods = stored["foods"].filter("source = 'foodfiles'")
    fixed = {"lang": F.lit("en"), "country": F.lit("NZ"), "basis": F.lit("g"), "carbs_convention": F.lit("available")}
    parts = [_compare(names.select("id", F.col("Food Name").alias("name")).withColumns(fixed).join(density, "id", "left"), foods, ["id"], ["name", "lang", "country", "basis", "carbs_convention", "density"], "food", 1e-12)]
    hidden = F.broadcast(p.sparkSession.createDataFrame([(k, x) for k, x, _ in HIDDEN], "FoodID string, CSM string"))
    two = (F.col("FoodID") == TWO_WEIGHTS[0]) & (F.col("CSM") == TWO_WEIGHTS[1]) & (F.col("grams") != TWO_WEIGHTS[3])
    portions = p.filter(~two).join(hidden, ["FoodID", "CSM"], "left_anti").select(F.col("id").alias("food_id"), F.col("CSM").alias("label"), "grams")
    mine = stored["servings"].join(foods.select(F.col("id").alias("food_id")), "food_id", "left_semi")
    parts.append(_compare(portions, mine, ["food_id", "label"], ["grams"], "portion", 0))
    cells = F.array_distinct(F.filter(F.array("Short Food Name", "AlternativeNames"), lambda x: (x != "") & (x != F.col("Food Name"))))
    alias = names.select(F.col("id").alias("food_id"), F.array_join(cells, "\n").alias("name")).filter("name <> ''")
    parts.append(_compare(alias, stored["aliases"].filter("lang = 'en'").join(foods.select(F.col("id").alias("food_id")), "food_id", "left_semi").select("food_id", "name"), ["food_id"], ["name"], "alias", 0))
    raw = tables["data"].select(F.col("FoodID").alias("key"), F.col("Component Identifier").alias("code"), "Value", F.col("Value Type Code").alias("letter"), F.array(*[F.struct(F.lit(x).alias("code"), F.col(x).alias("reference")) for x in PROVENANCE]).alias("references"))
    kinds = F.create_map(*[F.lit(x) for kv in VALUE_TYPES.items() for x in kv])
    slots = names.select(F.col("FoodID").alias("key")).crossJoin(_long(ZEALAND, names.sparkSession)).join(raw, ["key", "code"], "left")
    kind = F.try_element_at(kinds, F.col("letter"))
    expected = slots.select(
        "key", "code", _raw_number(F.col("Value"), F.col("unit")).alias("value"), F.col("Value").alias("notation"), "unit", F.array_compact(F.array(kind)).alias("qualifiers"), F.lit("foodfiles").alias("dataset"), F.lit(ZEALAND_VERSION).alias("version"), F.col("key").alias("food_id"),
        F.col("code").alias("nutrient_code"), F.coalesce("references", F.array().cast("array<struct<code:string,reference:string>>")).alias("references"),
    )
    return reduce(DataFrame.unionByName, [*parts, _compare(expected, _stored_figures(stored["figures"], "foodfiles"), ["key", "code"], ["value", "notation", "unit", "qualifiers", "dataset", "version", "food_id", "nutrient_code", "references"], "figure", 1e-12), _written(expected, foods, ZEALAND, zealand_id(F.col("key")))])
