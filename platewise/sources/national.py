"""Loaders of national tables, a family of layouts each, on :mod:`.common`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.foods import is_named_serving, serving_label
from ..functions.numbers import KJ_PER_KCAL, parse_cell, to_canonical_unit, to_float
from ..functions.text import clean_name, sentence_case
from ..operators.tables import ContractError, assert_empty, pivot_values, reject_ambiguous, set_difference
from .common import delimited, finish

#: Nutrient numbers of the American and Canadian sets.
USDA = {"1008": "kcal", "1003": "protein", "1004": "fat", "1005": "carbs", "1079": "fibre", "2000": "sugar", "1258": "saturated", "1093": "sodium"}
CNF = {"208": "kcal", "203": "protein", "204": "fat", "205": "carbs", "291": "fibre", "269": "sugar", "606": "saturated", "307": "sodium"}
CIQUAL = {"328": "kcal", "333": "kcal_alt", "25000": "protein", "40000": "fat", "31000": "carbs", "34100": "fibre", "32000": "sugar", "40302": "saturated", "10110": "sodium"}


def _wide(values: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Long ``key, code, value, ord`` as one row a key with the named fields; the last value of a field counts."""
    out = pivot_values(values.filter("value is not null"), "key", "code", "value", ["ord"], list(codes))
    return out.select("key", *[F.col(f"`{c}`").alias(n) for c, n in codes.items()])


def load_usda(spark: SparkSession, folder: str) -> DataFrame:
    """American relational set: foods of two kinds, long nutrients, portions with unit names. Sodium is in mg."""
    food = delimited(spark, f"{folder}/food.csv", ["fdc_id", "data_type", "description"]).filter(F.col("data_type").isin("foundation_food", "sr_legacy_food"))
    nutrient = delimited(spark, f"{folder}/food_nutrient.csv", ["fdc_id", "nutrient_id", "amount"]).filter(F.col("nutrient_id").isin(*USDA))
    unit = delimited(spark, f"{folder}/measure_unit.csv", ["id", "name"]).select(F.col("id").alias("measure_unit_id"), F.col("name").alias("unit_name"))
    portion = delimited(spark, f"{folder}/food_portion.csv", ["fdc_id", "gram_weight", "portion_description", "measure_unit_id", "modifier"])
    values = _wide(nutrient.select(F.col("fdc_id").alias("key"), F.col("nutrient_id").alias("code"), to_float(F.col("amount")).alias("value"), "ord"), USDA)
    text = F.trim(F.coalesce("portion_description", F.lit("")))
    parts = F.filter(F.array(F.coalesce("unit_name", F.lit("")), F.trim(F.coalesce("modifier", F.lit("")))), lambda p: (p != "") & (p != "undetermined"))
    label = serving_label(F.when(text != "", text).otherwise(F.array_join(parts, " ")))
    named = portion.join(unit, "measure_unit_id", "left").select(F.col("fdc_id").alias("key"), "ord", label.alias("label"), to_float(F.col("gram_weight")).alias("grams")).filter("grams > 0 and label is not null").filter(is_named_serving(F.col("label")))
    servings = named.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label", "grams"))), lambda s: F.struct(s["label"].alias("label"), s["grams"].alias("grams"))).alias("servings"))
    df = food.select(F.col("fdc_id").alias("key"), F.col("description").alias("raw_name"), "ord").join(values, "key", "left").join(servings, "key", "left").withColumn("sodium", F.col("sodium") / 1000)
    return finish(df, "usda", lang="en", convention="by_difference")


def load_cnf(spark: SparkSession, folder: str) -> DataFrame:
    """Canadian relational set with French aliases."""
    food = delimited(spark, f"{folder}/Food_Name.csv", ["Food_Code", "Food_Description_EN", "Food_Description_FR"])
    amount = delimited(spark, f"{folder}/Nutrient_Amount.csv", ["Food_Code", "Nutrient_Code", "Nutrient_Amount"])
    values = _wide(amount.select(F.col("Food_Code").alias("key"), F.col("Nutrient_Code").alias("code"), to_float(F.col("Nutrient_Amount")).alias("value"), "ord"), CNF)
    df = food.select(F.col("Food_Code").alias("key"), F.col("Food_Description_EN").alias("raw_name"), F.col("Food_Description_FR").alias("fr"), "ord").join(values, "key", "left").withColumn("sodium", F.col("sodium") / 1000)
    return finish(df, "cnf", lang="en", convention="by_difference", names={"fr": "fr"})


def load_ciqual(spark: SparkSession, names: str, values: str) -> DataFrame:
    """French XML: names and long values. A stated energy of 0 falls through to the other energy figure. Sodium is in mg."""
    food = spark.read.format("xml").option("rowTag", "ALIM").schema("alim_code string, alim_nom_fr string, alim_nom_eng string").load(names)
    long_ = spark.read.format("xml").option("rowTag", "COMPO").schema("alim_code string, const_code string, teneur string").load(values).withColumn("ord", F.monotonically_increasing_id())
    wide = _wide(long_.select(F.trim("alim_code").alias("key"), F.trim("const_code").alias("code"), to_float(F.col("teneur")).alias("value"), "ord"), CIQUAL)
    wide = wide.withColumn("kcal", F.when(F.col("kcal") != 0, F.col("kcal")).otherwise(F.col("kcal_alt"))).withColumn("sodium", F.col("sodium") / 1000)
    df = food.select(F.trim("alim_code").alias("key"), F.coalesce(F.when(F.trim("alim_nom_eng") != "", F.trim("alim_nom_eng")), F.trim("alim_nom_fr")).alias("raw_name"), F.trim("alim_nom_fr").alias("fr")).join(wide, "key", "left")
    return finish(df, "ciqual", lang="en", names={"fr": "fr"})


@dataclass
class Wide:
    """A wide table: which columns hold key, name, figures (and by what they are divided), aliases, and how cells are read.

    ``or_name``: a column whose name counts where the first is no usable one.
    """

    source: str
    key: str
    name: str
    figures: dict[str, str]
    divide: dict[str, float] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    dialect: str = "plain"
    lang: str = "en"
    convention: str = "available"
    sep: str = ","
    charset: str = "UTF-8"
    key_pattern: str | None = None
    group: str | None = None
    rejected_groups: tuple[str, ...] = ()
    unique_key: bool = False
    or_name: str | None = None


#: Headers of the national tables. German ones are codes with text after them.
BLS = Wide(
    "bls", "BLS", "Food", {"kcal": "ENERCC", "protein": "PROT625", "fat": "FAT", "carbs": "CHO", "fibre": "FIBT", "sugar": "SUGAR", "saturated": "FASAT", "sodium": "NA"}, {"sodium": 1000}, {"de": "Lebensmittelbezeichnung"},
    dialect="german", or_name="Lebensmittelbezeichnung",
)
COFID = Wide(
    "cofid", "Food Code", "Food Name", {"protein": "PROT", "fat": "FAT", "carbs": "CHO", "kcal": "KCALS", "sugar": "TOTSUG", "fibre": "AOACFIB", "saturated": "SATFOD", "sodium": "NA"}, {"sodium": 1000}, dialect="uk",
    convention="available_monosaccharide", unique_key=True,
)
FRIDA = Wide("frida", "FoodID", "FoodName", {"kcal": "KCAL", "protein": "PROTEIN", "fat": "FAT", "saturated": "SAT_FAT", "carbs": "CARBS", "fibre": "FIBRE", "sugar": "SUGAR", "sodium": "SODIUM"}, {"sodium": 1000}, {"da": "FodevareNavn"})
_CAPITALS = {"kcal": "KCAL", "fat": "FAT", "saturated": "SAT_FAT", "carbs": "CARBS", "sugar": "SUGAR", "fibre": "FIBER", "protein": "PROTEIN", "sodium": "SODIUM"}
SWISS = Wide("swiss", "ID", "NAME", _CAPITALS, {"sodium": 1000}, {"de": "NAME_DE", "fr": "NAME_FR", "it": "NAME_IT"}, dialect="swiss")
TCA = Wide("tca", "COD", "NOME", _CAPITALS, {"sodium": 1000}, lang="pt", group="NIVEL1", rejected_groups=("Bebidas alcoólicas",))
AFCD = Wide(
    "afcd", "Public Food Key", "Food Name", {"kcal": "E_KJ", "protein": "PROTEIN", "fat": "FAT", "carbs": "AVAIL_CHO", "fibre": "FIBRE", "sugar": "SUGAR", "saturated": "SATFAT", "sodium": "SODIUM"}, {"sodium": 1000, "kcal": KJ_PER_KCAL},
    key_pattern=r"^F\d{6}$",
)


def load_wide(spark: SparkSession, path: str, spec: Wide) -> DataFrame:
    """A wide table by its description. Columns may be headed by a code and more text (``PROT Protein (g)``); the code counts."""
    wanted = [spec.key, spec.name, *spec.figures.values(), *spec.aliases.values(), *([spec.group] if spec.group else [])]
    try:
        raw = delimited(spark, path, wanted, sep=spec.sep, charset=spec.charset)
    except ContractError:
        head = spark.read.option("sep", spec.sep).option("charset", spec.charset).csv(path).limit(1).collect()[0]
        full = {c: next((h.strip() for h in reversed(head) if h and h.strip().split(" ")[0] == c), c) if c not in head else c for c in wanted}
        raw = delimited(spark, path, list(full.values()), sep=spec.sep, charset=spec.charset).select(*[F.col(f"`{h}`").alias(c) for c, h in full.items()], "ord")
    name = F.col(f"`{spec.name}`")
    if spec.or_name:
        name = F.when(clean_name(name).isNotNull(), name).otherwise(F.col(f"`{spec.or_name}`"))
    df = raw.select(
        F.trim(F.col(f"`{spec.key}`")).alias("key"), name.alias("raw_name"), "ord", *[F.col(f"`{c}`").alias(f"alias_{k}") for k, c in spec.aliases.items()], *([F.col(f"`{spec.group}`").alias("food_group")] if spec.group else []),
        *[(parse_cell(F.col(f"`{c}`"), spec.dialect) / spec.divide.get(f, 1)).alias(f) for f, c in spec.figures.items()],
    )
    why = []
    if spec.unique_key:
        df = reject_ambiguous(df, "key").withColumnRenamed("reject_reason", "early")
        why.append(F.col("early"))
    if spec.rejected_groups:
        why.append(F.when(F.trim("food_group").isin(*spec.rejected_groups), "food group not per 100 g"))
    if spec.key_pattern:
        why.append(F.when(~F.col("key").rlike(spec.key_pattern), "non-standard key"))
    return finish(df, spec.source, lang=spec.lang, convention=spec.convention, names={k: f"alias_{k}" for k in spec.aliases}, why=F.coalesce(*why) if why else None)


def alias_report(foods: DataFrame, raw: DataFrame, languages: dict[str, str]) -> DataFrame:
    """By language, how many names were attached, equal to the food's (loanwords) or unusable. ``raw``: ``key`` and the names."""
    both = foods.select("key", "name").join(raw, "key")
    long_ = both.select("name", F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), clean_name(F.col(c)).alias("n")) for k, c in languages.items()])).alias("x")).select("name", "x.*")
    return long_.groupBy("lang").agg(F.count_if((F.col("n") != F.col("name"))).alias("attached"), F.count_if(F.col("n") == F.col("name")).alias("loanword"), F.count_if(F.col("n").isNull()).alias("unusable"))


#: Columns of the Spanish table.
BEDCA = {"ENERC": "kcal", "PROT": "protein", "FAT": "fat", "CHO": "carbs", "FIBT": "fibre", "SUGAR": "sugar", "FASAT": "saturated", "NA": "sodium"}


def load_bedca(spark: SparkSession, wide: str, basis: str) -> DataFrame:
    """Spanish wide table, each figure with its unit, and a long table of their bases; figures of another basis are dropped."""
    cols = [x for c in BEDCA for x in (c, f"{c}_unit")]
    raw = delimited(spark, wide, ["f_id", "f_eng_name", "f_ori_name", *cols])
    long_ = delimited(spark, basis, ["f_id", "eur_name", "moex"]).groupBy("f_id", F.col("eur_name").alias("code")).agg(F.max_by("moex", "ord").alias("basis"))
    cells = raw.select("f_id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("raw"), F.trim(F.col(f"{c}_unit")).alias("unit")) for c in BEDCA])).alias("x")).select("f_id", "x.*")
    based = cells.join(long_, ["f_id", "code"], "left").withColumn("basis", F.coalesce("basis", F.lit("")))
    value = to_canonical_unit(to_float(F.col("raw")), F.col("unit"), F.col("basis"), F.col("code"))
    values = _wide(based.select(F.col("f_id").alias("key"), "code", value.alias("value"), F.lit(0).alias("ord")), BEDCA)
    df = raw.select(F.col("f_id").alias("key"), F.col("f_eng_name").alias("raw_name"), F.col("f_ori_name").alias("es"), "ord").join(values, "key", "left")
    return finish(df, "bedca", lang="en", names={"es": "es"})


#: Nutrient names of the Norwegian, Swedish and Finnish tables.
MATVARETABELLEN = {"Protein": "protein", "Fett": "fat", "Karbo": "carbs", "Sukker": "sugar", "Fiber": "fibre", "Mettet": "saturated", "Na": "sodium"}
LIVSMEDEL = {"ENERC": "kcal", "PROT": "protein", "FAT": "fat", "CHO": "carbs", "FIBT": "fibre", "SUGAR": "sugar", "FASAT": "saturated", "NA": "sodium"}
FINELI = {"ENERC": "kcal", "PROT": "protein", "FAT": "fat", "CHOAVL": "carbs", "FIBC": "fibre", "SUGAR": "sugar", "FASAT": "saturated", "NA": "sodium"}
FINELI_UNITS = {"ENERC": "KJ", "PROT": "G", "FAT": "G", "CHOAVL": "G", "FIBC": "G", "SUGAR": "G", "FASAT": "G", "NA": "MG"}


def load_matvaretabellen(spark: SparkSession, english: str, norwegian: str) -> DataFrame:
    """Norwegian documents in two languages: the same unique ids, or the source is refused. Energy is a field of its own."""
    schema = "foods array<struct<foodId:string,foodName:string,calories:struct<quantity:double>,constituents:array<struct<nutrientId:string,quantity:double,unit:string>>>>"
    en, nb = (spark.read.schema(schema).option("multiLine", True).json(p).select(F.posexplode("foods").alias("ord", "f")).select(F.trim("f.foodId").alias("key"), "ord", "f") for p in (english, norwegian))
    assert_empty(set_difference(en, nb, "key"), "ids of the two languages differ")
    assert_empty(en.groupBy("key").count().filter("count > 1").union(nb.groupBy("key").count().filter("count > 1")), "repeated ids")
    by = F.map_from_entries(F.filter(F.transform("f.constituents", lambda c: F.struct(c["nutrientId"].alias("k"), F.when(c["unit"] == "mg", c["quantity"] / 1000).otherwise(c["quantity"]).alias("v"))), lambda e: e["k"].isin(*MATVARETABELLEN)))
    figures = [F.try_element_at("m", F.lit(c)).alias(n) for c, n in MATVARETABELLEN.items()]
    df = en.withColumn("m", by).select("key", F.col("f.foodName").alias("raw_name"), F.col("f.calories.quantity").alias("kcal"), "ord", *figures).join(nb.select("key", F.col("f.foodName").alias("nb")), "key")
    number = F.lit(120_000_000_000) + F.regexp_extract("key", r"^(\d+)\.(\d+)$", 1).try_cast("long") * 1000 + F.regexp_extract("key", r"^(\d+)\.(\d+)$", 2).try_cast("long")
    return finish(df, "matvaretabellen", lang="en", names={"nb": "nb"}, number=number)


def load_livsmedel(spark: SparkSession, english: str, swedish: str, values: str) -> DataFrame:
    """Swedish documents: two lists of names and lines of nested values; the three sets of ids must agree."""
    names = "livsmedel array<struct<nummer:long,namn:string>>"
    en, sv = (spark.read.schema(names).option("multiLine", True).json(p).select(F.posexplode("livsmedel").alias("ord", "f")).select(F.col("f.nummer").cast("string").alias("key"), "ord", F.col("f.namn").alias("n")) for p in (english, swedish))
    long_ = spark.read.schema("nummer long, naringsvarden array<struct<euroFIRkod:string,enhet:string,varde:double,matrisenhetkod:string>>").json(values).select(F.col("nummer").cast("string").alias("key"), F.posexplode("naringsvarden").alias("ord", "v"))
    for other in (sv, long_):
        assert_empty(set_difference(en, other, "key"), "ids of the three files differ")
    rows = long_.select("key", F.col("v.euroFIRkod").alias("code"), "ord", to_canonical_unit(F.col("v.varde"), F.col("v.enhet"), F.col("v.matrisenhetkod"), F.col("v.euroFIRkod")).alias("value"), F.col("v.enhet").alias("unit"))
    rows = rows.filter((F.col("code") != "ENERC") | (F.col("unit") == "kcal"))
    df = en.select("key", F.col("n").alias("raw_name"), "ord").join(sv.select("key", F.col("n").alias("sv")), "key").join(_wide(rows, LIVSMEDEL), "key", "left")
    return finish(df, "livsmedel", lang="en", names={"sv": "sv"})


def load_fineli(spark: SparkSession, folder: str) -> DataFrame:
    """Finnish relational set (semicolons, cp1252): names in three languages with equal ids, pinned component units, energy in kJ."""

    def read(name: str, columns: list[str]) -> DataFrame:
        return delimited(spark, f"{folder}/{name}.csv", columns, sep=";", charset="cp1252")

    food = read("food", ["FOODID"]).select(F.trim("FOODID").alias("key"), "ord")
    names = {x: read(f"foodname_{x}", ["FOODID", "FOODNAME"]).select(F.trim("FOODID").alias("key"), sentence_case(F.trim("FOODNAME")).alias(x)) for x in ("EN", "FI", "SV")}
    for x in ("FI", "SV"):
        assert_empty(set_difference(names["EN"], names[x], "key"), "ids of the names differ")
    units = {r["EUFDNAME"]: r["COMPUNIT"] for r in read("component", ["EUFDNAME", "COMPUNIT"]).filter(F.col("EUFDNAME").isin(*FINELI_UNITS)).collect()}
    if units != FINELI_UNITS:
        raise ContractError(f"units {units}")
    values = read("component_value", ["FOODID", "EUFDNAME", "BESTLOC"]).select(F.trim("FOODID").alias("key"), F.col("EUFDNAME").alias("code"), to_float(F.col("BESTLOC")).alias("value"), "ord")
    df = food.join(names["EN"], "key").join(names["FI"], "key").join(names["SV"], "key").join(_wide(values, FINELI), "key", "left")
    df = df.withColumn("raw_name", F.col("EN")).withColumn("kcal", F.col("kcal") / KJ_PER_KCAL).withColumn("sodium", F.col("sodium") / 1000).withColumn("ord", F.col("key").try_cast("long"))
    return finish(df, "fineli", lang="en", names={"fi": "FI", "sv": "SV"})
