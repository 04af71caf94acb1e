"""Data-quality audit of a catalogue: one table of checks, counts and budgets; and reconciliation of two tables of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.foods import COUNTRY_OF_SOURCE, UNIT_LABELS, gtin_ok, source_rank
from ..functions.text import fold_name

#: Carbohydrate conventions and the sources that use another than ``available``.
CONVENTIONS = {"usda": "by_difference", "cnf": "by_difference", "cofid": "available_monosaccharide"}
KNOWN = (*COUNTRY_OF_SOURCE, "off")


def food_checks() -> dict[str, tuple[Column, int]]:
    """Row checks of foods: a condition that must not hold, and how many rows may break it."""
    c = F.col
    national = c("source").isin(*COUNTRY_OF_SOURCE)
    convention = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONVENTIONS.items() for x in kv]), c("source")), F.lit("available"))
    return {
        "html entity in name": (c("name").rlike(r"&(amp|quot|apos|lt|gt|nbsp|#\d+);"), 50),
        "address in name": (c("name").rlike(r"(?i)https?://|www\."), 0),
        "name equals brand": (F.lower(F.trim("name")) == F.lower(F.trim("brand")), 0),
        "zero energy with macros": ((c("kcal") == 0) & ((c("protein") > 0.5) | (c("fat") > 0.5)), 200),
        "sodium above 45": (c("sodium") > 45, 0),
        "sugar above carbs": (c("sugar") > c("carbs") + 1, 0),
        "saturated above fat": (c("saturated") > c("fat") + 1, 0),
        "energy out of range": (~c("kcal").between(0, 900), 0),
        "unknown source": (~c("source").isin(*KNOWN), 0),
        "basic rank not 0 to 2": (~c("basic_rank").isin(0, 1, 2), 0),
        "unknown convention": (~c("carbs_convention").isin("available", "by_difference", "available_monosaccharide"), 0),
        "convention not the source's": (c("carbs_convention") != convention, 0),
        "source rank not 0 or 1": (~c("source_rank").isin(0, 1), 0),
        "source rank not the source's": (c("source_rank") != source_rank(c("source")), 0),
        "national food without language": (national & c("lang").isNull(), 0),
        "branded food with language": ((c("source") == "off") & c("lang").isNotNull(), 0),
        "empty folded name": (c("name_folded").isNull() | (c("name_folded") == ""), 0),
        "capital in folded name": (c("name_folded").rlike("[A-Z]"), 0),
        "doubly encoded name": (c("name").contains("Ã") | c("name").contains("â€"), 0),
        "no letter in name": (~c("name").rlike(r"\p{L}"), 0),
        "control character in name": (c("name").rlike(r"\p{Cc}"), 0),
        "missing required figure": (c("kcal").isNull() | c("protein").isNull() | c("fat").isNull() | c("carbs").isNull(), 0),
    }


def _count(df: DataFrame, name: str, budget: int = 0) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", F.lit(budget).alias("budget"))


def row_checks(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """All row checks of a table in a single pass: ``check, n, budget``."""
    counts = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"c{i}") for i, (cond, _) in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("n"), F.lit(b).alias("budget")) for i, (n, (_, b)) in enumerate(checks.items())]))
    return counts.select(rows.alias("r")).select("r.*")


def empty_columns(foods: DataFrame, columns: list[str], by: str = "source") -> DataFrame:
    """Columns that have no value at all in a source."""
    counts = foods.groupBy(by).agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([by], columns, "column", "n").filter("n = 0").select(by, "column")


def audit(foods: DataFrame, aliases: DataFrame, barcodes: DataFrame, servings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``check, n, budget, passed`` of all checks. ``members``: ids that searches show (default: all foods)."""
    f = F.col("id").alias("food_id")
    ids = foods.select(f)
    shown = foods if members is None else foods.join(members.select("id"), "id", "left_semi")
    unit = F.regexp_replace(F.lower(F.trim("label")), r"\.+$", "").isin(*UNIT_LABELS)
    bag = foods.filter("alias_names is not null and alias_names <> ''").select(f, "alias_names")
    rebuilt = aliases.groupBy("food_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", fold_name(F.col("name")).alias("n")))), lambda x: x["n"]), "\n").alias("built"))
    named = aliases.join(foods.select(f, F.col("name").alias("food_name")), "food_id")
    parts = [
        row_checks(foods, food_checks()),
        row_checks(servings, {"serving without weight": (F.col("grams") <= 0, 0), "serving out of range": (~F.col("grams").between(1, 2000), 0), "serving label is a unit": (unit, 0)}),
        row_checks(aliases, {"malformed alias language": (~F.col("lang").rlike("^[a-z]{2}(-[A-Z]{2})?$"), 0)}),
        row_checks(barcodes, {"malformed barcode": (~F.col("barcode").rlike("^[0-9]{8,14}$"), 0), "wrong check digit": (~gtin_ok(F.col("barcode")), 0)}),
        _count(servings.groupBy("food_id", F.lower(F.trim("label")).alias("l")).count().filter("count > 1"), "repeated serving label"),
        _count(shown.groupBy("source", F.lower(F.trim("name")).alias("a"), F.lower(F.coalesce("brand", F.lit(""))).alias("b"), F.floor(F.col("kcal") / 50).alias("k")).count().filter("count > 1"), "repeated search row"),
        _count(empty_columns(foods, ["kcal", "protein", "fat", "carbs", "fibre", "sugar", "saturated", "sodium"]), "column empty for a source"),
        _count(servings.join(ids, "food_id", "left_anti"), "serving without food"),
        _count(aliases.join(ids, "food_id", "left_anti"), "alias without food"),
        _count(barcodes.join(ids, "food_id", "left_anti"), "barcode without food"),
        _count(aliases.select("food_id").distinct().join(bag, "food_id", "left_anti"), "aliases but no bag"),
        _count(bag.join(aliases, "food_id", "left_anti"), "bag but no aliases"),
        _count(named.filter("name = food_name"), "alias equals name"),
        _count(aliases.groupBy("food_id", "lang", "name").count().filter("count > 1"), "repeated alias"),
        _count(foods.filter("barcode is not null").select(f, "barcode").join(barcodes, ["food_id", "barcode"], "left_anti"), "own barcode can't be scanned"),
        _count(foods.filter("barcode is not null").select(F.col("id"), "barcode").join(barcodes, "barcode").filter("id <> food_id"), "barcode gives another food"),
        _count(rebuilt.join(bag, "food_id").filter("built <> alias_names"), "bag isn't the aliases in order"),
    ]
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn("passed", F.col("n") <= F.col("budget"))


def structure(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table of a catalogue; an empty catalogue has all tables with 0 rows."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def structural_checks(tables: dict[str, DataFrame], postings: DataFrame, probe: str = "a") -> DataFrame:
    """``check, passed`` of a written catalogue: tables that must have rows, members that are indexed (as many, and the same), no child of
    a food that isn't there, and a probe word's beginning that finds something."""
    foods, members = tables["foods"], tables["members"]
    shown = members.filter("preferred") if "preferred" in members.columns else members
    indexed = postings.select("id").distinct()
    counts = [("foods are there", foods.limit(1).count() == 1), ("search rows are there", members.limit(1).count() == 1), ("an index row for each member", indexed.join(members, "id", "left_anti").isEmpty() and members.select("id").distinct().join(indexed, "id", "left_anti").isEmpty())]
    counts += [(f"{name} belong to foods", tables[name].join(foods.select(F.col("id").alias("food_id")), "food_id", "left_anti").isEmpty()) for name in ("aliases", "barcodes", "servings")]
    counts += [("members are foods", shown.join(foods, "id", "left_anti").isEmpty()), ("a probe finds something", not postings.filter(F.startswith("word", F.lit(probe))).isEmpty())]
    return foods.sparkSession.createDataFrame(counts, "check string, passed boolean")


#: Everyday words whose first result must be the food itself, and words that name something made from one.
WHOLE_FOODS = ("banana", "milk", "egg", "bread", "apple", "potato", "tomato", "carrot", "salmon", "butter", "orange", "rice", "chicken breast")
MADE_FOODS = ("olive oil", "flour", "orange juice", "peanut butter")


def bears_word(name: Column, alias_names: Column, word: Column) -> Column:
    """Whether a name or one of its aliases contains a word."""
    return F.contains(F.lower(name), word) | F.coalesce(F.contains(F.lower(alias_names), word), F.lit(False))


def probe_queries(spark: SparkSession) -> DataFrame:
    """The probes as queries of no table and no reader, for the reduced ladder: ``query_id, q, tokens, whole`` and what a shelf reads."""
    probes = spark.createDataFrame([(w, w in WHOLE_FOODS) for w in (*WHOLE_FOODS, *MADE_FOODS)], "q string, whole boolean")
    none = F.lit("")
    return probes.select(F.col("q").alias("query_id"), "q", F.split("q", " ").alias("tokens"), F.array().cast("array<string>").alias("languages"), none.alias("source"), none.alias("head"), none.alias("lead_source"), F.lit(1).alias("limit"), "whole")


def rank_probes(foods: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, id, passed`` of the pinned probes: the first national result by the ladder without a reader bears the probe's first
    word in its name or aliases, and is no derivative where the food itself is asked for. No result at all fails."""
    from .search import NEVER_SENT, national, shelf

    probes = probe_queries(foods.sparkSession)
    top = shelf(probes, postings, foods, national()).select("query_id", "id")
    best = probes.join(top, "query_id", "left").join(foods.select("id", "name", "alias_names", "basic_rank").hint(NEVER_SENT), "id", "left")
    good = bears_word(F.col("name"), F.col("alias_names"), F.get(F.split("q", " "), F.lit(0))) & ((F.col("basic_rank") < 2) | ~F.col("whole"))
    return best.select("query_id", "id", F.coalesce(good, F.lit(False)).alias("passed"))


def reconcile_figures(expected: DataFrame, actual: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-14) -> DataFrame:
    """Errors between figures derived anew and those stored, long form: missing, unexpected, or different beyond a relative tolerance."""
    a, b = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("__e")), actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("__a"))
    both = a.join(b, keys, "full_outer")
    apart = F.abs(F.col("expected") - F.col("actual")) > tolerance * F.greatest(F.abs("expected"), F.abs("actual"))
    error = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("expected").isNull() != F.col("actual").isNull(), "null differs").when(apart, "differs")
    return both.withColumn("error", error).filter("error is not null").select(*keys, "expected", "actual", "error")


def explained_energy(protein: Column, fat: Column, carbs: Column, fibre: Column, alcohol: Column, polyols: Column, acids: Column) -> Column:
    """Energy with what a plain 4/9/4 leaves out: fibre 2, alcohol 7, organic acids 3, polyols 1.6 less than carbohydrate."""

    def z(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return z(protein) * 4 + z(fat) * 9 + z(carbs) * 4 + z(fibre) * 2 + z(alcohol) * 7 + z(acids) * 3 - z(polyols) * 1.6
