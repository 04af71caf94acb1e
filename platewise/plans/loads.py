"""Registered queries of the loaders: ``part`` is written out in a publisher's layout, loaded back, and held against SQL.

Each layout gets its own marks for traces, missing figures and limits, names that are unusable or equal, keys that don't
fit, figures that fail the gate; the SQL says what the loader must make of every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.foods import ID_BASE
from ..operators.staging import setting, work_dir
from ..sources import national, strict
from ..sources.common import driver_table, union_sources
from .registry import register

#: What all layouts say of a row of ``part``, for both engines: names, and cells as text.
NAME = "case when k % 23 = 0 then 'x' else n end"
OTHER = "case when k % 29 = 0 then n else concat(n, ' ', lower(t)) end"
CELLS = {"protein": "cast(s as varchar(20))", "carbs": "cast(s as varchar(20))", "fat": "cast(s % 10 as varchar(20))", "sugar": "cast(s % 12 as varchar(20))", "saturated": "cast(s % 4 as varchar(20))", "sodium": "cast(k % 50 as varchar(20))"}
KCAL = "case when k % 17 = 0 then '' when k % 19 = 0 then '5000' else cast(8 * s + 9 * (s % 10) as varchar(20)) end"
KJ = "case when k % 17 = 0 then '' when k % 19 = 0 then '50000' else cast(33 * s + 38 * (s % 10) as varchar(20)) end"
ROWS = "select p_partkey as k, p_name as n, p_type as t, cast(p_size as int) as s from part"
#: What becomes of them.
FIGURES = {"kcal": "case when k % 17 = 0 then null when k % 19 = 0 then 5000.0 else 8.0 * s + 9 * (s % 10) end", "protein": "1.0 * s", "carbs": "1.0 * s", "fat": "1.0 * (s % 10)", "sugar": "1.0 * (s % 12)", "saturated": "1.0 * (s % 4)", "sodium": "(k % 50) / 1000.0"}
KJ_READ = "case when k % 17 = 0 then null when k % 19 = 0 then 50000 / 4.184 else (33 * s + 38 * (s % 10)) / 4.184 end"
GATE = "case when k % 17 = 0 then 'no energy' when k % 19 = 0 then 'energy range' when 2 * s + s % 10 > 105 then 'macro sum' end"
FIELDS = ("kcal", "protein", "fat", "carbs", "fibre", "sugar", "saturated", "sodium")


def _fibre(trace: str, missing: str) -> str:
    return f"case k % 6 when 0 then '{trace}' when 1 then '{missing}' when 2 then '<1.0' when 3 then '1,5' else cast(s % 7 as varchar(20)) end"


FIBRE = "case k % 6 when 0 then 0.0 when 1 then null when 2 then 0.5 when 3 then 1.5 else 1.0 * (s % 7) end"


def _table(spark: SparkSession, d: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    """Rows of ``part`` as columns of text."""
    cells = ", ".join(f"{sql} as `{name}`" for name, sql in columns.items())
    return spark.sql(f"with rows as ({ROWS.replace('from part', 'from {t}')}) select {cells} from rows where {where}", t=driver_table(spark, d, "part"))


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/layout-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, sep: str = ",", charset: str = "UTF-8") -> str:
    with setting(df.sparkSession, spark__sql__legacy__javaCharsets="true"):
        df.write.option("header", True).option("sep", sep).option("encoding", charset).option("emptyValue", "").csv(path)
    return path


def _shown(foods: DataFrame) -> DataFrame:
    """What queries say of loaded records."""
    aliases = F.array_join(F.transform("aliases", lambda a: F.concat(a["lang"], F.lit(":"), a["name"])), "|")
    servings = F.array_join(F.transform("servings", lambda s: F.concat(s["label"], F.lit(":"), s["grams"].cast("int").cast("string"))), "|")
    return foods.select("id", "key", "name", "lang", aliases.alias("aliases"), servings.alias("servings"), *[F.round(F.col(c), 6).alias(c) for c in FIELDS], "carbs_convention", "reject_reason")


def _expected(source: str, *, key: str = "cast(k as varchar(20))", number: str = "k", lang: str = "en", convention: str = "available", aliases: dict[str, str] | None = None, why: str = "null", late: str = "null", name: str = NAME, servings: str = "''", where: str = "true", **figures: str) -> str:
    """SQL of what a loader must say. ``why`` comes before an unusable name, ``late`` (a key without number) after it."""
    usable = "case when length(nm) between 2 and 120 then nm end"
    bag = ", ".join(f"case when {sql} <> nm and length(nm) > 1 then concat('{x}:', {sql}) end" for x, sql in (aliases or {}).items())
    all_ = FIGURES | {"fibre": FIBRE} | figures
    cols = ", ".join(f"round(cast({all_[f]} as double), 6) as {f}" for f in FIELDS)
    return (
        f"with rows as ({ROWS}), named as (select *, {name} as nm from rows where {where}) select {ID_BASE[source]} + {number} as id, {key} as key, {usable} as name, '{lang}' as lang, {f'concat_ws({chr(39)}|{chr(39)}, {bag})' if bag else repr('')} as aliases, {servings} as servings, "
        f"{cols}, '{convention}' as carbs_convention, coalesce({why}, case when length(nm) < 2 then 'unusable name' end, {late}, {GATE}) as reject_reason from named"
    )


def _wide(spark: SparkSession, d: str, spec: national.Wide, key: str, *, trace: str = "traces", missing: str = "-", kcal: str = KCAL, aliases: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """The table in a wide layout, by the description that its loader goes by."""
    cells = CELLS | {"kcal": kcal, "fibre": _fibre(trace, missing)}
    columns = {spec.key: key, spec.name: NAME, **{c: (aliases or {"": OTHER}).get(x, OTHER) for x, c in spec.aliases.items()}, **{c: cells[f] for f, c in spec.figures.items()}, **(more or {})}
    return national.load_wide(spark, _csv(_table(spark, d, columns), _folder(spark)), spec)


_GERMAN = "concat('C', lpad(cast(k as varchar(20)), 6, '0'))"
_BASE36 = "12 * 2176782336 + " + " + ".join(f"(cast(floor(k / {10**i}) as bigint) % 10) * {36**i}" for i in range(6))


@register(_expected("bls", key=_GERMAN, number=f"({_BASE36})", aliases={"de": OTHER}, name=f"case when k % 23 = 0 then {OTHER} else n end"))
def loaded_german(spark, d):
    """A wide table headed by codes and text, keys in base 36, a German name where there is no usable English one."""
    return _shown(_wide(spark, d, national.BLS, _GERMAN, trace="TR", missing="<LOD"))


_UK = "case when k % 31 = 0 then '77-1' else concat(cast(cast(floor(k / 10) as bigint) + 100 as varchar(20)), '-', cast(k % 10 as varchar(20))) end"


@register(_expected("cofid", key=_UK, number="case when k % 31 = 0 then 770001 else (cast(floor(k / 10) as bigint) + 100) * 10000 + k % 10 end", convention="available_monosaccharide", why="case when k % 31 = 0 then 'ambiguous code' end"))
def loaded_british(spark, d):
    """A wide table whose repeated codes are all rejected."""
    return _shown(_wide(spark, d, national.COFID, _UK, trace="Tr", missing="N"))


_ODD = "case when k % 37 = 0 then concat('x', cast(k as varchar(20))) else cast(k as varchar(20)) end"


@register(_expected("frida", key=_ODD, number="case when k % 37 = 0 then null else k end", aliases={"da": OTHER}, late="case when k % 37 = 0 then 'non-standard key' end"))
def loaded_danish(spark, d):
    """A wide table with a second language, some keys without a number."""
    return _shown(_wide(spark, d, national.FRIDA, _ODD))


_FRENCH = "concat(n, ' fr')"


@register(_expected("swiss", aliases={"de": OTHER, "fr": _FRENCH}))
def loaded_swiss(spark, d):
    """A wide table in four languages, one of them empty."""
    return _shown(_wide(spark, d, national.SWISS, "cast(k as varchar(20))", trace="tr.", missing="n.d.", aliases={"de": OTHER, "fr": _FRENCH, "it": "''"}))


@register(_expected("tca", lang="pt", why="case when k % 7 = 0 then 'food group not per 100 g' end"))
def loaded_portuguese(spark, d):
    """A wide table of which one group is rejected."""
    return _shown(_wide(spark, d, national.TCA, "cast(k as varchar(20))", more={"NIVEL1": "case when k % 7 = 0 then 'Bebidas alcoólicas' else 'Frutos' end"}))


_AUSTRALIAN = "case when k % 37 = 0 then 'X1' else concat('F', lpad(cast(k as varchar(20)), 6, '0')) end"


@register(_expected("afcd", key=_AUSTRALIAN, number="case when k % 37 = 0 then 1 else k end", why="case when k % 37 = 0 then 'non-standard key' end", kcal=KJ_READ))
def loaded_australian(spark, d):
    """A wide table with energy in kJ and keys of one pattern."""
    return _shown(_wide(spark, d, national.AFCD, _AUSTRALIAN, kcal=KJ))


def _long(spark: SparkSession, d: str, codes: dict[str, str], key: str, code: str, value: str, **cells: str) -> DataFrame:
    """Figures in long form; where 41 divides the key a wrong protein stands before the right one."""
    all_ = CELLS | {"kcal": KCAL, "fibre": _fibre("traces", "-")} | cells
    first = {"k": "cast(k as varchar(20))", **{f: all_[f] for f in codes.values()}, "wrong": "case when k % 41 = 0 then '99' end"}
    wide = _table(spark, d, first)
    pairs = [(c, F.col(f)) for c, f in codes.items()]
    pairs.insert(0, (next(c for c, f in codes.items() if f == "protein"), F.col("wrong")))
    return wide.select(F.col("k").alias(key), F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias(code), x.alias(value)) for c, x in pairs]), lambda p: p[value].isNotNull())).alias("p")).select(key, f"p.{code}", f"p.{value}")


_KIND = "case k % 3 when 0 then 'branded_food' when 1 then 'foundation_food' else 'sr_legacy_food' end"
_SERVING = "case when s < 1 then '' when k % 4 = 1 then concat('cup:', cast(s as varchar(20))) when k % 4 = 2 then concat('tablespoon:', cast(s as varchar(20))) else '' end"


@register(_expected("usda", convention="by_difference", servings=_SERVING, where="k % 3 <> 0"))
def loaded_american(spark, d):
    """A relational set: foods of two kinds, long figures of which the last counts, portions by description or unit."""
    path = _folder(spark)
    key = "cast(k as varchar(20))"
    _csv(_table(spark, d, {"fdc_id": key, "data_type": _KIND, "description": NAME}), f"{path}/food.csv")
    _csv(_long(spark, d, national.USDA, "fdc_id", "nutrient_id", "amount"), f"{path}/food_nutrient.csv")
    _csv(spark.createDataFrame([("1", "tbsp"), ("2", "undetermined"), ("3", "gram")], "id string, name string"), f"{path}/measure_unit.csv")
    said = {"portion_description": "case when k % 4 = 1 then 'cups' else '' end", "measure_unit_id": "case k % 4 when 2 then '1' when 3 then '3' else '2' end", "modifier": "''"}
    _csv(_table(spark, d, {"fdc_id": key, "gram_weight": "cast(s as varchar(20))", **said}), f"{path}/food_portion.csv")
    return _shown(national.load_usda(spark, path))


@register(_expected("cnf", convention="by_difference", aliases={"fr": OTHER}))
def loaded_canadian(spark, d):
    """A bilingual relational set."""
    path = _folder(spark)
    _csv(_table(spark, d, {"Food_Code": "cast(k as varchar(20))", "Food_Description_EN": NAME, "Food_Description_FR": OTHER}), f"{path}/Food_Name.csv")
    _csv(_long(spark, d, national.CNF, "Food_Code", "Nutrient_Code", "Nutrient_Amount"), f"{path}/Nutrient_Amount.csv")
    return _shown(national.load_cnf(spark, path))


@register(_expected("ciqual", aliases={"fr": OTHER}, name=f"case when k % 43 = 0 then {OTHER} else {NAME} end", kcal="case when k % 17 = 0 then 1.0 * s when k % 19 = 0 then 5000.0 else 8.0 * s + 9 * (s % 10) end").replace(GATE, "case when k % 17 = 0 and abs(s - (8 * s + 9 * (s % 10))) > greatest(35, 0.3 * s) and 2 * s + s % 10 <= 105 then 'Atwater' when k % 19 = 0 and k % 17 <> 0 then 'energy range' when 2 * s + s % 10 > 105 then 'macro sum' end"))
def loaded_french(spark, d):
    """Names and long values as XML; an energy of 0 falls through to the other figure, a missing English name to the French one."""
    path = _folder(spark)
    xml = {"compression": "none"}
    names = _table(spark, d, {"alim_code": "concat(' ', cast(k as varchar(20)), ' ')", "alim_nom_fr": OTHER, "alim_nom_eng": f"case when k % 43 = 0 then ' ' else {NAME} end"})
    names.write.format("xml").options(rowTag="ALIM", rootTag="TABLE", **xml).save(f"{path}/names")
    codes = national.CIQUAL
    values = _long(spark, d, codes, "alim_code", "const_code", "teneur", kcal=KCAL.replace("''", "'0'"), kcal_alt="cast(s as varchar(20))")
    values.write.format("xml").options(rowTag="COMPO", rootTag="TABLE", **xml).save(f"{path}/values")
    return _shown(national.load_ciqual(spark, f"{path}/names", f"{path}/values"))


@register(_expected("bedca", aliases={"es": OTHER}, kcal=KJ_READ, sodium="case k % 3 when 0 then (k % 50) / 1000.0 when 1 then (k % 50) / 10000.0 else null end", sugar="case when k % 5 = 0 then null else 1.0 * (s % 12) end", saturated="(s % 4) / 1000.0"))
def loaded_spanish(spark, d):
    """A wide table with a unit beside each figure, and a long one of what the figures are based on."""
    path = _folder(spark)
    key = "cast(k as varchar(20))"
    cells = CELLS | {"kcal": KJ, "fibre": _fibre("traces", "-")}
    units = {"ENERC": "kJ", "FASAT": "mg"}
    wide = {"f_id": key, "f_eng_name": NAME, "f_ori_name": OTHER}
    for c, f in national.BEDCA.items():
        wide |= {c: cells[f], f"{c}_unit": f"'{units.get(c, 'g')}'"}
    _csv(_table(spark, d, wide), f"{path}/wide")
    basis = {c: "'W'" for c in national.BEDCA} | {"NA": "case k % 3 when 0 then 'W' when 1 then 'WKG' else 'X' end", "SUGAR": "case when k % 5 = 0 then 'D' else 'W' end"}
    flat = _table(spark, d, {"f_id": key, **basis})
    long_ = flat.select("f_id", F.explode(F.array(*[F.struct(F.lit(c).alias("eur_name"), F.col(c).alias("moex")) for c in basis])).alias("x")).select("f_id", "x.*")
    return _shown(national.load_bedca(spark, f"{path}/wide", _csv(long_, f"{path}/basis")))


def _documents(df: DataFrame, field: str, columns: list[str], path: str) -> str:
    """JSON documents of up to 500 records each, one a file."""
    docs = df.withColumn("doc", F.floor(F.col("k").cast("long") / 500)).groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias(field))
    docs.repartition("doc").write.partitionBy("doc").json(path)
    return path


@register(_expected("matvaretabellen", key="concat(cast(cast(floor(k / 100) as bigint) as varchar(20)), '.', lpad(cast(k % 100 as varchar(20)), 3, '0'))", number="cast(floor(k / 100) as bigint) * 1000 + k % 100", aliases={"nb": OTHER}, fibre="1.0 * (s % 7)"))
def loaded_norwegian(spark, d):
    """Documents in two languages, joined by id; constituents nested."""
    path = _folder(spark)
    part = ["protein", "fat", "carbs", "sugar", "saturated"]
    rows = _table(spark, d, {"k": "k", "foodId": "concat(cast(cast(floor(k / 100) as bigint) as varchar(20)), '.', lpad(cast(k % 100 as varchar(20)), 3, '0'))", "en": NAME, "nb": OTHER, "kcal": KCAL, "fibre": "cast(s % 7 as varchar(20))", **{f: CELLS[f] for f in [*part, "sodium"]}})
    by = {f: c for c, f in national.MATVARETABELLEN.items()}
    constituents = F.array(*[F.struct(F.lit(by[f]).alias("nutrientId"), F.col(f).cast("double").alias("quantity"), F.lit("mg" if f == "sodium" else "g").alias("unit")) for f in [*part, "fibre", "sodium"]])
    rows = rows.withColumn("constituents", constituents).withColumn("calories", F.struct(F.expr("try_cast(kcal as double)").alias("quantity")))
    paths = [_documents(rows.withColumn("foodName", F.col(x)), "foods", ["foodId", "foodName", "calories", "constituents"], f"{path}/{x}") for x in ("en", "nb")]
    return _shown(national.load_matvaretabellen(spark, *paths))


@register(_expected("livsmedel", aliases={"sv": OTHER}, fibre="1.0 * (s % 7)"))
def loaded_swedish(spark, d):
    """Two documents of names and lines of nested values; energy in kJ beside kcal is passed over."""
    path = _folder(spark)
    by = {f: c for c, f in national.LIVSMEDEL.items()}
    rows = _table(spark, d, {"k": "k", "en": NAME, "sv": OTHER, "kcal": KCAL, "fibre": "cast(s % 7 as varchar(20))", **CELLS}).withColumn("nummer", F.col("k").cast("long"))
    en, sv = (_documents(rows.withColumn("namn", F.col(x)), "livsmedel", ["nummer", "namn"], f"{path}/{x}") for x in ("en", "sv"))

    def value(code: str, unit: str, amount) -> F.Column:
        return F.struct(F.lit(code).alias("euroFIRkod"), F.lit(unit).alias("enhet"), amount.alias("varde"), F.lit("W").alias("matrisenhetkod"))

    number = {f: F.expr(f"try_cast({f} as double)") for f in by}
    values = F.array(value("ENERC", "kJ", F.lit(1.0)), *[value(by[f], "kcal" if f == "kcal" else "mg" if f == "sodium" else "g", number[f]) for f in FIELDS], value("ENERC", "kJ", F.lit(2.0)))
    rows.select("nummer", values.alias("naringsvarden")).write.json(f"{path}/values")
    return _shown(national.load_livsmedel(spark, en, sv, f"{path}/values"))


@register(_expected("fineli", name="case when k % 23 = 0 then 'X' else concat(upper(substr(n, 1, 1)), substr(n, 2)) end", aliases={"fi": "concat('Ä', lower(substr(n, 1)))", "sv": OTHER}, kcal=KJ_READ))
def loaded_finnish(spark, d):
    """A relational set with semicolons in cp1252: three tables of names, capitals lowered, energy in kJ."""
    path = _folder(spark)
    key = "cast(k as varchar(20))"

    def put(name: str, df: DataFrame) -> None:
        _csv(df, f"{path}/{name}.csv", ";", "windows-1252")

    put("food", _table(spark, d, {"FOODID": key}))
    for x, name in (("EN", f"upper({NAME})"), ("FI", "upper(concat('ä', n))"), ("SV", OTHER)):
        put(f"foodname_{x}", _table(spark, d, {"FOODID": key, "FOODNAME": name}))
    put("component", spark.createDataFrame(list(national.FINELI_UNITS.items()), "EUFDNAME string, COMPUNIT string"))
    put("component_value", _long(spark, d, national.FINELI, "FOODID", "EUFDNAME", "BESTLOC", kcal=KJ))
    return _shown(national.load_fineli(spark, path))


_EAN = [f"cast(floor(k / {10**i}) as bigint) % 10" for i in range(7)]
_CHECK = f"(10 - (3 * ({_EAN[0]} + {_EAN[2]} + {_EAN[4]} + {_EAN[6]}) + {_EAN[1]} + {_EAN[3]} + {_EAN[5]}) % 10) % 10"
_CODE = f"case when k % 31 = 0 then '12x' else concat(lpad(cast(k as varchar(20)), 7, '0'), cast(case when k % 37 = 0 then ({_CHECK} + 1) % 10 else {_CHECK} end as varchar(20))) end"
_FLAG = "case when k % 47 = 0 then 'en:energy-value-in-kcal-greater-than-in-kj' else '' end"


@register(
    f"with rows as ({ROWS}) select {ID_BASE['off']} + cast({_CODE} as bigint) as id, n as name, case when k % 5 = 0 then null else concat('Brand ', cast(k % 9 as varchar(20))) end as brand, round(cast({FIGURES['kcal']} as double), 6) as kcal, round(cast({FIBRE} as double), 6) as fibre, round(k % 50 / 1000.0, 6) as sodium, "
    f"case k % 3 when 0 then 'DE' when 1 then 'FR' end as country, cast(nullif(k % 5, 0) as int) as nova, cast(k % 31 as int) as popularity, case when s between 1 and 2000 and k % 2 = 0 then concat('serving:', cast(s as varchar(20))) else '' end as servings from rows "
    f"where k % 31 <> 0 and k % 37 <> 0 and k % 53 <> 0 and k % 23 <> 0 and k % 47 <> 0 and ({GATE}) is null"
)
def loaded_branded(spark, d):
    """The tab-separated branded export: what is kept of it, with barcode, brand, country, processing group and serving."""
    cells = CELLS | {"kcal": KCAL, "fibre": _fibre("traces", "-"), "sodium": "concat('0.', lpad(cast(k % 50 as varchar(20)), 3, '0'))"}
    by = {"energy-kcal_100g": "kcal", "proteins_100g": "protein", "fat_100g": "fat", "carbohydrates_100g": "carbs", "fiber_100g": "fibre", "sugars_100g": "sugar", "saturated-fat_100g": "saturated", "sodium_100g": "sodium"}
    said = {"code": _CODE, "product_name": NAME, "brands": f"case when k % 5 = 0 then {NAME} else concat('Brand ', cast(k % 9 as varchar(20))) end", **{c: cells[f] for c, f in by.items()}}
    said |= {"serving_size": "case when k % 2 = 0 then concat(cast(s as varchar(20)), ' g') else '250 ml' end", "serving_quantity": "''", "unique_scans_n": "cast(k % 31 as varchar(20))", "nova_group": "cast(k % 5 as varchar(20))", "data_quality_errors_tags": _FLAG}
    said["countries_tags"] = "case k % 3 when 0 then 'en:germany' when 1 then 'en:france,en:germany' else 'en:nowhere' end"
    rows = _table(spark, d, {c: said[c] for c in strict.OFF_COLUMNS} | {"k": "k"})
    line = F.concat_ws("\t", *[F.col(f"`{c}`") for c in strict.OFF_COLUMNS])
    short = F.when(F.col("k") % 53 == 0, F.substring_index(line, "\t", 5)).otherwise(line)
    path = f"{_folder(spark)}/export.tsv"
    head = spark.createDataFrame([("\t".join(strict.OFF_COLUMNS),)], "value string")
    lines = head.withColumn("o", F.lit(0)).unionByName(rows.select(short.alias("value"), F.lit(1).alias("o")))
    lines.repartitionByRange(4, "o").sortWithinPartitions("o").select("value").write.text(path)
    codes = F.create_map(*[F.lit(x) for x in ("germany", "DE", "france", "FR")])
    kept = strict.load_branded(spark, path, codes).filter("reject_reason is null")
    servings = F.array_join(F.transform("servings", lambda s: F.concat(s["label"], F.lit(":"), s["grams"].cast("int").cast("string"))), "|")
    return kept.select("id", "name", "brand", *[F.round(F.col(c), 6).alias(c) for c in ("kcal", "fibre", "sodium")], "country", "nova", "popularity", servings.alias("servings"))


@register("with a as (" + _expected("frida", aliases={"da": OTHER}) + "), b as (" + _expected("swiss", aliases={"de": OTHER, "fr": _FRENCH}) + ") select source, reason, count(*) as n from (select 'frida' as source, coalesce(reject_reason, 'kept') as reason from a union all select 'swiss', coalesce(reject_reason, 'kept') from b) group by all")
def united_sources(spark, d):
    """Records of several sources as one table: by source, how many are kept and how many go for which reason."""
    key = "cast(k as varchar(20))"
    both = union_sources({"frida": _wide(spark, d, national.FRIDA, key), "swiss": _wide(spark, d, national.SWISS, key, trace="tr.", missing="n.d.", aliases={"de": OTHER, "fr": _FRENCH, "it": "''"})})
    return both.groupBy("source", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
