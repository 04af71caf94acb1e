"""Strict sources (one bad row refuses the whole file), sheets that must agree, the branded export, and small text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.foods import clean_barcode, reject_reason, serving_grams, upstream_error
from ..functions.numbers import DIALECTS, parse_cell, to_float
from ..functions.text import clean_name, first_country
from ..operators.tables import ContractError, assert_empty, assert_unique, duplicates_by, pair_by_occurrence, set_difference, table_diff
from .common import FIELDS, delimited, finish

#: The export's columns.
OFF_COLUMNS = (
    "code", "product_name", "brands", "energy-kcal_100g", "proteins_100g", "fat_100g", "carbohydrates_100g", "fiber_100g", "sugars_100g", "saturated-fat_100g", "sodium_100g", "serving_size", "serving_quantity", "unique_scans_n", "nova_group",
    "data_quality_errors_tags", "countries_tags",
)


def load_branded(spark: SparkSession, path: str, codes: Column, parts: int | None = None) -> DataFrame:
    """The branded export (tab-separated, maybe one gzip file): records with their first reason to be rejected.

    One gzip file is read by one task, so rows are dealt out before any work. The order of reasons is fixed: short row, code,
    name, figures, upstream flags. ``codes`` maps country slugs to codes.
    """
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    head = lines.limit(1).collect()[0]["value"].split("\t")
    if missing := [c for c in OFF_COLUMNS if c not in head]:
        raise ContractError(f"missing {missing}")
    at = {c: head.index(c) for c in OFF_COLUMNS}
    rows = lines.filter("ord > 0" if not path.endswith(".gz") else "ord <> 0").filter(F.col("value") != "\t".join(head))
    rows = rows.repartition(parts) if parts else rows.hint("rebalance")
    cells = rows.withColumn("cells", F.split("value", "\t")).select("ord", (F.size("cells") <= max(at.values())).alias("short"), *[F.get("cells", F.lit(i)).alias(c) for c, i in at.items()])
    code = F.trim("code")
    num = {"kcal": "energy-kcal_100g", "protein": "proteins_100g", "fat": "fat_100g", "carbs": "carbohydrates_100g", "fibre": "fiber_100g", "sugar": "sugars_100g", "saturated": "saturated-fat_100g", "sodium": "sodium_100g"}
    df = cells.withColumns({f: to_float(F.col(f"`{c}`")) for f, c in num.items()}).withColumn("barcode", clean_barcode(code)).withColumn("clean", clean_name(F.col("product_name")))
    brand = F.trim(F.substring(F.trim("brands"), 1, 80))
    grams = serving_grams(F.col("serving_size"), to_float(F.col("serving_quantity")))
    why = (
        F.when(F.col("short"), "short row").when(F.col("barcode").isNull(), F.when(code.rlike("^([0-9]{8}|[0-9]{12,14})$"), "wrong check digit").otherwise("malformed code")).when(F.col("clean").isNull(), "unusable name")
    )
    why = F.coalesce(why, reject_reason(*[F.col(c) for c in FIELDS[:4]]), F.when(upstream_error(F.col("data_quality_errors_tags")), "flagged upstream"))
    df = df.select(
        F.col("barcode").alias("key"), F.col("product_name").alias("raw_name"), F.when((brand != "") & (F.lower(brand) != F.lower("clean")), brand).alias("brand"), "barcode", *FIELDS, first_country(F.col("countries_tags"), codes).alias("country"),
        F.nullif(F.floor(to_float(F.col("nova_group"))).cast("int"), F.lit(0)).alias("nova"), F.coalesce(F.floor(to_float(F.col("unique_scans_n"))).cast("int"), F.lit(0)).alias("popularity"),
        F.when((grams > 0) & (grams <= 2000), F.array(F.struct(F.lit("serving").alias("label"), grams.alias("grams")))).otherwise(F.array().cast("array<struct<label:string,grams:double>>")).alias("servings"), "ord", why.alias("why"),
    )
    return finish(df, "off", lang=None, why=F.col("why"))


def resolve_portions(portions: DataFrame, resolved: DataFrame) -> DataFrame:
    """One weight for each (food, label): a label with several must be one that is pinned with its choice, else the source is refused."""
    sets = portions.groupBy("key", "label").agg(F.array_sort(F.collect_set("grams")).alias("all"))
    joined = sets.join(resolved.select("key", "label", F.col("grams").alias("chosen"), F.col("all").alias("expected")), ["key", "label"], "left")
    assert_empty(joined.filter((F.size("all") > 1) & ~F.coalesce(F.col("all") == F.col("expected"), F.lit(False))).select("key", "label", "all"), "ambiguous portions")
    return joined.select("key", "label", F.coalesce("chosen", F.get("all", F.lit(0))).alias("grams"))


def join_sheets(first: DataFrame, second: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Two sheets of one table: the n-th row of a code on one meets the n-th on the other; names agree and none is left over."""
    both = pair_by_occurrence(first, second, key, order)
    assert_empty(both.filter(F.col("l").isNull() | F.col("r").isNull() | ~F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))).select(key, "n"), "sheets differ")
    return both.select("l.*", *[F.col(f"r.{c}") for c in second.columns if c not in first.columns])


def long_sheet(values: DataFrame, pinned: DataFrame) -> DataFrame:
    """A long sheet ``key, parameter, name, unit, value`` with pinned parameters, as wide: names and units as pinned, no repeats."""
    seen = values.select("parameter", "name", "unit").distinct().join(pinned.select("parameter", F.col("name").alias("pn"), F.col("unit").alias("pu"), "field"), "parameter")
    assert_empty(seen.filter("name <> pn or unit <> pu"), "parameters changed")
    assert_empty(duplicates_by(values, ["key", "parameter"]), "repeated parameter")
    fields = [r["field"] for r in pinned.select("field").distinct().orderBy("field").collect()]
    return values.join(pinned.select("parameter", "field"), "parameter").groupBy("key").pivot("field", fields).agg(F.max("value"))


def agreeing_languages(sheets: dict[str, DataFrame], key: str, cells: list[str], names: str, dialect: str = "swiss") -> DataFrame:
    """Sheets of one table in several languages: equal keys and equal cells (the case of marks apart), names by language.

    Every cell must be blank, a mark of the dialect, or a figure; a cell of other text refuses the table.
    """
    (lang, base), *rest = sheets.items()
    for c in cells:
        known = F.coalesce(F.trim(c), F.lit("")).isin("", *DIALECTS[dialect][0], *DIALECTS[dialect][1]) | parse_cell(F.col(c), dialect).isNotNull()
        assert_empty(base.filter(~known).select(key, c), f"{c}: no figure")
    out = base.withColumnRenamed(names, f"name_{lang}")
    for other, df in rest:
        assert_empty(set_difference(base, df, key), f"keys of {lang} and {other}")
        norm = [F.lower(F.trim(c)).alias(c) for c in cells]
        assert_empty(table_diff(base.select(key, *norm), df.select(key, *norm)), f"cells of {lang} and {other}")
        out = out.join(df.select(key, F.col(names).alias(f"name_{other}")), key)
    return out


def agreeing_components(sheet: DataFrame, headers: list[str], pinned: dict[str, str]) -> None:
    """A sheet that says which column holds each component (``component, header``) must say what is pinned, once, and the table have those columns."""
    said = {}
    for r in sheet.filter(F.col("component").isin(*pinned)).select("component", F.trim("header").alias("header")).distinct().collect():
        said.setdefault(r["component"], []).append(r["header"])
    if wrong := [c for c, h in pinned.items() if said.get(c) != [h] or headers.count(h) != 1]:
        raise ContractError(f"components {wrong}")


def agreeing_books(solid: DataFrame, liquid: DataFrame, key: str, name: str) -> None:
    """Every liquid food is among the solid ones, by the same name."""
    assert_empty(liquid.select(key, name).join(solid.select(key, F.col(name).alias("other")), key, "left").filter(~F.col(name).eqNullSafe(F.col("other"))), "liquid foods")


def columns_by_unit(df: DataFrame, unit: str) -> list[str]:
    """Columns whose header ends in a unit in brackets."""
    return [c for c in df.columns if c.rstrip().endswith(f"[{unit}]")]


def write_lexicon(words: DataFrame, path: str) -> None:
    """``source<TAB>lang<TAB>word`` lines in order."""
    words.select(F.concat_ws("\t", "source", "lang", "word").alias("value")).repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Words of a lexicon; lines that are short are skipped, carriage returns dropped."""
    cells = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c")).filter(F.size("c") >= 3)
    return cells.select(F.col("c")[0].alias("source"), F.col("c")[1].alias("lang"), F.col("c")[2].alias("word")).filter("word <> ''")


def verify_lexicon(words: DataFrame, stored: DataFrame) -> DataFrame:
    """Words of only one of two lexicons; none if they agree."""
    return table_diff(words.select("source", "lang", "word"), stored.select("source", "lang", "word"))


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries: ``query, country, language, acceptable, unacceptable``; comments are skipped, ``-`` expects no row."""
    cells = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("query_id", F.monotonically_increasing_id()).withColumn("c", F.split("value", "\t"))
    assert_empty(cells.filter(~F.size("c").between(4, 5)).select("value"), "cells")
    pattern = F.when(F.trim(F.col("c")[3]) != "-", F.trim(F.col("c")[3]))
    return cells.select("query_id", F.col("c")[0].alias("query"), F.col("c")[1].alias("country"), F.col("c")[2].alias("language"), pattern.alias("acceptable"), F.get("c", F.lit(4)).alias("unacceptable"))


def export_results(results: DataFrame, path: str, *, detail: bool = False) -> None:
    """Search results as text: a line for each (``query, place, name``), or JSON with id and source."""
    if detail:
        results.write.mode("overwrite").json(path)
    else:
        results.select("query", "place", "name").write.mode("overwrite").option("sep", "\t").csv(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Landed product responses that may become a food: found, with tags, name and code, four figures, plausible."""
    schema = "status int, code string, product struct<product_name:string,countries_tags:array<string>,nutriments:map<string,double>>"
    rows = spark.read.schema(schema).json(path)
    fig = {f: F.try_element_at("product.nutriments", F.lit(c)) for f, c in (("kcal", "energy-kcal_100g"), ("protein", "proteins_100g"), ("fat", "fat_100g"), ("carbs", "carbohydrates_100g"))}
    df = rows.select("status", clean_barcode(F.col("code")).alias("barcode"), clean_name(F.col("product.product_name")).alias("name"), F.size("product.countries_tags").alias("tags"), *[v.alias(k) for k, v in fig.items()])
    return df.filter("status = 1 and tags > 0 and name is not null and barcode is not null").filter(reject_reason(*[F.col(c) for c in FIELDS[:4]]).isNull())
