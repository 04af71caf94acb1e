"""Smaller operators on small tables with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from platewise.functions import numbers, nutrition
from platewise.operators import audit, catalogue, search
from platewise.operators.tables import ContractError
from platewise.sources import strict

FOODS = "id long, name string, name_folded string, alias_names string, aliases array<struct<lang:string,name:string>>, search_extra string, brand string, source string, lang string, basic_rank int, quality int, preferred boolean"


def food(i, name, source="bls", rank=1, alias=None):
    return (i, name, name.lower(), alias, [], None, None, source, "de", rank, 50, True)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_rank_probes(spark):
    foods = spark.createDataFrame([food(1, "Banana, raw", rank=0), food(2, "Milk powder", rank=2), food(3, "Huevo", alias="egg"), food(4, "Flour, wheat", rank=2), food(5, "Bread", "off")], FOODS)
    got = {r.query_id: (r.id, r.passed) for r in audit.rank_probes(foods, search.build_postings(foods)).collect()}
    assert len(got) == 17
    assert got["banana"] == (1, True) and got["milk"] == (2, False) and got["egg"] == (3, True) and got["flour"] == (4, True) and got["bread"] == (None, False)


def test_structure(spark):
    foods = spark.createDataFrame([food(1, "Apple")], FOODS)
    ids = spark.createDataFrame([(1,)], "food_id long")
    tables = {"foods": foods, "members": foods.select("id", "preferred"), "aliases": ids, "barcodes": ids.limit(0), "servings": ids}
    assert all(r.passed for r in audit.structural_checks(tables, search.build_postings(foods)).collect())
    broken = {**tables, "servings": spark.createDataFrame([(9,)], "food_id long")}
    assert [r.check for r in audit.structural_checks(broken, search.build_postings(foods.limit(0)), "z").collect() if not r.passed] == ["an index row for each member", "servings belong to foods", "a probe finds something"]
    assert rows(audit.structure({n: t.limit(0) for n, t in tables.items()}), "n") == [(0,)] * 5


def test_custom_foods_come_first(spark):
    foods = spark.createDataFrame([food(1, "Butter"), food(2, "Butter, gesalzen"), food(3, "Butterkeks")], FOODS)
    served = spark.createDataFrame([("bls", "de", 1)], "source string, lang string, place int")
    q = spark.createDataFrame([(1, "butter", ["butter"], "bls", ["de"], 3), (2, "butter", ["butter"], "bls", ["de"], 1)], "query_id long, q string, tokens array<string>, source string, languages array<string>, limit int")
    custom = spark.createDataFrame([(1, 70, 1), (2, 70, 1), (2, 71, 2)], "query_id long, id long, place int")
    got = sorted((r.query_id, r.place, r.id, r.shelf) for r in search.search(q, foods, served, custom).collect())
    assert got == [(1, 1, 70, -1), (1, 2, 1, 0), (1, 3, 2, 0), (2, 1, 70, -1)]
    members = spark.createDataFrame([(1, True), (2, False)], "id long, preferred boolean")
    assert rows(search.with_preference(foods, members), "id", "preferred") == [(1, True), (2, False), (3, False)]


def test_aliases_of_a_group_cut_into_strides(spark, monkeypatch):
    alias = "array<struct<lang:string,name:string>>"
    data = [(i, "Milk" if i % 3 else "milk", (i * 7) % 11, i % 4, [(f"l{i % 5}", "Milk" if i % 6 == 0 else f"n{i}")] if i % 2 else [], i * 3) for i in range(60)]
    df = spark.createDataFrame([(i, n, None, 60.0, p, q, a, o) for i, n, p, q, a, o in data], f"id long, name string, brand string, kcal double, popularity int, quality int, aliases {alias}, ord long")
    now = None
    for i, n, p, q, a, _ in data:  # the rule, one row after the other
        if now is None or (p, q) > (now[2], now[3]):
            old, now = now, [i, n, p, q, list(a)]
            more = old[4] if old else []
        else:
            more = a
        for lang, name in more:
            if name != now[1] and lang not in [x[0] for x in now[4]]:
                now[4].append((lang, name))
    for stride in (5, 4096):
        monkeypatch.setattr(catalogue, "STRIDE", stride)
        r = catalogue.merge_aliases(df.repartition(3)).first()
        assert (r.id, [(a.lang, a.name) for a in r.aliases]) == (now[0], now[4])


def test_sheets(spark):
    en = spark.createDataFrame([("1", "Bread", "5", "tr."), ("2", "Roll", "n.d.", "")], "key string, name string, a string, b string")
    de = en.withColumn("name", F.concat(F.lit("de "), "name")).withColumn("b", F.upper("b"))
    assert rows(strict.agreeing_languages({"en": en, "de": de}, "key", ["a", "b"], "name"), "key", "name_en", "name_de") == [("1", "Bread", "de Bread"), ("2", "Roll", "de Roll")]
    for bad in (de.withColumn("a", F.lit("6")), de.filter("key = '1'")):
        with pytest.raises(ContractError):
            strict.agreeing_languages({"en": en, "de": bad}, "key", ["a", "b"], "name")
    with pytest.raises(ContractError):
        strict.agreeing_languages({"en": en.withColumn("a", F.lit("about 5"))}, "key", ["a"], "name")
    sheet = spark.createDataFrame([("Energia", "KCAL "), ("Sal", "SALT")], "component string, header string")
    strict.agreeing_components(sheet, ["COD", "KCAL"], {"Energia": "KCAL"})
    for headers, pinned in ((["COD"], {"Energia": "KCAL"}), (["KCAL"], {"Energia": "KJ"}), (["KCAL"], {"Proteína": "P"})):
        with pytest.raises(ContractError):
            strict.agreeing_components(sheet, headers, pinned)
    values = spark.createDataFrame([("1", "172", "Available carbohydrates", "g", "5"), ("1", "1", "Energy", "kJ", "9"), ("2", "172", "Available carbohydrates", "g", "6")], "key string, parameter string, name string, unit string, value string")
    pinned = spark.createDataFrame([("172", "Available carbohydrates", "g", "carbs")], "parameter string, name string, unit string, field string")
    assert rows(strict.long_sheet(values, pinned), "key", "carbs") == [("1", "5"), ("2", "6")]
    for bad in (values.withColumn("unit", F.lit("mg")), values.union(values)):
        with pytest.raises(ContractError):
            strict.long_sheet(bad, pinned)
    strict.agreeing_books(en, en.limit(1), "key", "name")
    with pytest.raises(ContractError):
        strict.agreeing_books(en, de, "key", "name")
    assert strict.columns_by_unit(spark.createDataFrame([(1, 2, 3)], "`FAT [g]` int, `NA [mg]` int, name int"), "g") == ["FAT [g]"]


def test_products_and_results(spark, tmp_path):
    figures = {"energy-kcal_100g": 60.0, "proteins_100g": 3.0, "fat_100g": 3.5, "carbohydrates_100g": 4.6}

    def product(code, status=1, name="Milk", tags=("en:france",), **more):
        return json.dumps({"status": status, "code": code, "product": {"product_name": name, "countries_tags": list(tags), "nutriments": {**figures, **more}}})

    lines = [product("96385074"), product("96385075"), product("4006381333931", status=0), product("4006381333931", tags=()), product("4006381333931", name="1"), product("4006381333931", fat_100g=101.0)]
    (tmp_path / "p.json").write_text("\n".join(lines))
    assert rows(strict.read_products(spark, f"file://{tmp_path}/p.json"), "barcode", "name", "kcal") == [("96385074", "Milk", 60.0)]
    found = spark.createDataFrame([("milk", 1, "Milk", 7, "bls")], "query string, place int, name string, id long, source string")
    strict.export_results(found, f"file://{tmp_path}/tsv")
    strict.export_results(found, f"file://{tmp_path}/json", detail=True)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/tsv").collect()] == ["milk\t1\tMilk"] and spark.read.json(f"file://{tmp_path}/json").first().source == "bls"


def test_targets_and_subsets(spark, tmp_path):
    df = spark.createDataFrame([("", 5.0), ("x", 5.0), ("7,5", 5.0)], "t string, inherited double")
    assert [r[0] for r in df.select(nutrition.resolve_target(numbers.parse_number(F.col("t")), F.col("inherited"))).collect()] == [5.0, None, 7.5]
    foods = spark.createDataFrame([(1, "usda"), (2, "bls")], "id long, source string")
    codes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "food_id long, barcode string")
    sub = catalogue.export_subset(foods, {"barcodes": codes}, "usda")
    flat = catalogue.flat_export(sub["foods"], sub["barcodes"])
    assert catalogue.verify_subset(sub, flat, "usda") == {"foods": 1, "barcodes": 2, "flat": 1}
    for bad, out in (({**sub, "foods": foods}, flat), ({**sub, "barcodes": codes}, flat), (sub, flat.union(flat))):
        with pytest.raises(ContractError):
            catalogue.verify_subset(bad, out, "usda")
    catalogue.write_flat(flat, f"file://{tmp_path}/flat")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/flat").first().barcodes == "a;b" and list((tmp_path / "flat").glob("*.csv.gz"))
