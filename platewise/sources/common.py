"""What all loaders share: the record they emit, reading delimited text with a declared header, naming and gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.foods import clean_servings, reject_reason, stable_id
from ..functions.text import clean_name
from ..operators.tables import ContractError

FIELDS = ("kcal", "protein", "fat", "carbs", "fibre", "sugar", "saturated", "sodium")
#: The record of every source: key and figures as columns, names in other languages and portions nested in order.
FOOD_SCHEMA = (
    "id long, key string, name string, brand string, barcode string, source string, lang string, country string, kcal double, protein double, fat double, carbs double, fibre double, sugar double, "
    "saturated double, sodium double, carbs_convention string, basis string, density double, nova int, popularity int, aliases array<struct<lang:string,name:string>>, servings array<struct<label:string,grams:double>>, ord long, reject_reason string"
)
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale folder; only the columns that are used later are read."""
    if name not in DRIVER_TABLES:
        raise ContractError(f"no table {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delimited(spark: SparkSession, path: str, columns: list[str], *, sep: str = ",", charset: str = "UTF-8", quote: str = '"', pinned: dict[int, str] | None = None) -> DataFrame:
    """A delimited file with a header, all as text; the header must have the columns, and the pinned ones at their positions.

    Only the header line is read ahead. A byte order mark before the first name is dropped. ``ord`` counts the lines.
    """
    if charset.lower() in ("cp1252", "windows-1252"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    head = spark.read.option("sep", sep).option("charset", charset).option("quote", quote).csv(path).limit(1).collect()
    names = [(x or "").lstrip("﻿").strip() for x in head[0]] if head else []
    missing = [c for c in columns if c not in names]
    repeated = sorted({c for c in columns if names.count(c) > 1})
    moved = [c for i, c in (pinned or {}).items() if i >= len(names) or names[i] != c]
    if missing or repeated or moved:
        raise ContractError(f"{path}: missing {missing}, repeated {repeated}, moved {moved}")
    unique = [c if names.index(c) == i else f"{c}__{i}" for i, c in enumerate(names)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in unique])
    rows = spark.read.schema(schema).option("sep", sep).option("charset", charset).option("quote", quote).option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("ord"))


def alias(lang: str, name: Column) -> Column:
    """One alias, null if there is no usable name."""
    return F.when(name.isNotNull(), F.struct(F.lit(lang).alias("lang"), name.alias("name")))


def finish(df: DataFrame, source: str, *, lang: str | None, convention: str = "available", names: dict[str, str] | None = None, why: Column | None = None, number: Column | None = None) -> DataFrame:
    """Rows with ``key``, ``raw_name``, the figures and maybe more, as records of one source with their first reject reason.

    ``names``: alias language to column of raw names; a name equal to the food's own (a loanword) is no alias. ``why``
    gives earlier reasons; then come an unusable name, a key without number, and the quality gate.
    """
    have = set(df.columns)

    def col(name: str, kind: str, default=None) -> Column:
        return (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)

    named = df.withColumn("name", clean_name(F.col("raw_name")))
    other = [alias(k, F.when(F.col(f"__{k}") != F.col("name"), F.col(f"__{k}"))) for k in names or {}]
    named = named.withColumns({f"__{k}": clean_name(F.col(c)) for k, c in (names or {}).items()})
    number = stable_id(F.lit(source), F.col("key")) if number is None else number
    gate = reject_reason(*[F.col(c) for c in FIELDS[:4]])
    reason = F.coalesce(*([] if why is None else [why]), F.when(F.col("name").isNull(), "unusable name"), F.when(number.isNull(), "non-standard key"), gate)
    aliases = F.array_compact(F.array(*other)) if other else F.array()
    servings = clean_servings(F.col("servings")) if "servings" in have else F.array()
    return named.select(
        number.cast("long").alias("id"), F.col("key").cast("string").alias("key"), "name", col("brand", "string"), col("barcode", "string"), F.lit(source).alias("source"), F.lit(lang).cast("string").alias("lang"), col("country", "string"),
        *[col(c, "double") for c in FIELDS], F.lit(convention).alias("carbs_convention"), col("basis", "string", "g"), col("density", "double"), col("nova", "int"), col("popularity", "int", 0),
        aliases.cast("array<struct<lang:string,name:string>>").alias("aliases"), F.coalesce(servings, F.array()).cast("array<struct<label:string,grams:double>>").alias("servings"), col("ord", "long", 0), reason.alias("reject_reason"),
    )


def kept(foods: DataFrame) -> DataFrame:
    """Records that were not rejected."""
    return foods.filter("reject_reason is null").drop("reject_reason", "key")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' records as one table; a source that was asked for and gives no row fails the build."""
    from functools import reduce

    all_ = reduce(DataFrame.unionByName, sources.values())
    there = {r[0] for r in all_.select("source").distinct().collect()}
    if gone := sorted(set(sources) - there):
        raise ContractError(f"no rows from {gone}")
    return all_
