"""Operators on small tables with results worked out by hand."""

import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from platewise.operators import audit, catalogue, diary, maintain, search, tables
from platewise.sources import common, national, strict
from platewise.streaming import live

D = datetime.date
ALIAS = "array<struct<lang:string,name:string>>"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_asof_join_and_gaps(spark):
    entries = spark.createDataFrame([(1, D(2024, 1, 1), 100.0), (1, D(2024, 1, 3), 50.0), (2, D(2024, 1, 2), None)], "user_id long, log_date date, kcal double")
    goals = spark.createDataFrame([(1, D(2024, 1, 2), 2000.0), (1, D(2023, 1, 1), 1800.0), (2, D(2024, 1, 3), 1.0)], "user_id long, effective_from date, calories_target double")
    got = rows(diary.history(entries, goals, ["kcal"]), "user_id", "log_date", "entries", "kcal", "calories_target")
    assert got == [(1, D(2024, 1, 1), 1, 100.0, 1800.0), (1, D(2024, 1, 2), None, None, 2000.0), (1, D(2024, 1, 3), 1, 50.0, 2000.0), (2, D(2024, 1, 2), 1, None, None)]
    summary = rows(diary.history_summary(diary.history(entries, goals, ["kcal"]), "kcal", "calories_target", ["user_id"]))
    assert summary == [(1, 2, 3, 75.0, None), (2, 0, 1, None, None)]
    window = rows(diary.window_days(spark.createDataFrame([(1, D(2024, 5, 9), D(2024, 5, 3))], "user_id long, selected date, today date"), 3))
    assert window == [(1, D(2024, 5, 1)), (1, D(2024, 5, 2)), (1, D(2024, 5, 3))]


def test_days_are_summed_in_the_order_of_the_table(spark, tmp_path):
    """What is left is rounded at a half, so the order of addition shows: rows that are dealt otherwise must not change it."""
    from platewise.plans.queries import remaining_and_progress

    values, day = (23.82, 8.15, 62.99, 17.74), datetime.datetime(2024, 1, 13, 9)
    rows = [(u * 10 + 9, day, u, "signup", 73.32, "{}") for u in range(24)]
    rows += [(u * 10 + i, day, u, "view", values[i], '{"k": 1}') for u, places in enumerate(itertools.permutations(range(4))) for i in places]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    total = ((values[0] + values[1]) + values[2]) + values[3]
    assert {r.remaining for r in remaining_and_progress(spark, f"file://{tmp_path}").collect()} == {(73.32 * 10 - total + 0.5) // 1}


def test_nutrient_sums(spark):
    v = "struct<value:double,qualifiers:array<string>,incomplete:boolean,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean,dataset:string>"
    one = (0.5, ["LOGICAL_ZERO"], False, None, None, True, True, "x")
    data = [("a", {"FAT": one}), ("b", {"FAT": (1.0, [], False, None, None, True, True, "x")}), ("b", {"FAT": (0.2, ["BOUNDED"], False, None, 0.2, True, False, "y")}), ("c", {"FAT": one}), ("c", {}), ("d", {"FAT": (3.0, ["UNDECIDABLE"], False, None, None, True, True, "x")}), ("d", {"FAT": one})]
    df = spark.createDataFrame(data, f"k string, nutrients map<string,{v}>")
    got = {r.k: r.v for r in diary.nutrient_totals(df, ["k"]).collect()}
    assert (got["a"].value, got["a"].qualifiers) == (0.5, ["LOGICAL_ZERO"])
    assert (got["b"].value, got["b"].upper, got["b"].upper_inclusive, got["b"].incomplete, got["b"].qualifiers) == (1.2, 1.2, False, False, ["BOUNDED"])
    assert got["c"].incomplete and got["d"].incomplete and got["d"].value == 0.5
    assert rows(diary.datasets_in(df, ["k"])) == [("a", ["x"]), ("b", ["x", "y"]), ("c", ["x"]), ("d", ["x"])]


def test_merge_aliases_is_a_fold(spark):
    data = [(1, "Milk", 1, 50, [("fr", "lait")], 0), (2, "milk ", 5, 50, [("de", "Milch"), ("fr", "LAIT")], 1), (3, "MILK", 5, 40, [("es", "leche"), ("de", "x")], 2), (4, "Tea", 1, 1, [], 3)]
    df = spark.createDataFrame([(i, n, None, 60.0, p, q, a, o) for i, n, p, q, a, o in data], f"id long, name string, brand string, kcal double, popularity int, quality int, aliases {ALIAS}, ord long")
    for parts in (1, 4):
        got = {r.id: [(a.lang, a.name) for a in r.aliases] for r in catalogue.merge_aliases(df.repartition(parts)).collect()}
        assert got == {2: [("de", "Milch"), ("fr", "LAIT"), ("es", "leche")], 4: []}
    assert rows(catalogue.display_groups(df), "id", "winner_id") == [(1, 2), (2, 2), (3, 2), (4, 4)]


def test_promotion(spark):
    df = spark.createDataFrame([(1, "Milk", "bls", "en", [("de", "Milch"), ("fr", "lait")]), (2, "Ketchup", "bls", "en", []), (3, "Tea", "usda", "en", [("de", "Tee")])], f"id long, name string, source string, lang string, aliases {ALIAS}")
    got = {r.id: (r.name, r.lang, [(a.lang, a.name) for a in r.aliases], r.promotion) for r in catalogue.promote_native_names(df).collect()}
    assert got == {1: ("Milch", "de", [("en", "Milk"), ("fr", "lait")], "promoted"), 2: ("Ketchup", "de", [], "already native"), 3: ("Tea", "en", [("de", "Tee")], None)}


def test_words_and_compounds(spark):
    names = spark.createDataFrame([(1, "de", "rinderbraten"), (2, "de", "braten rind"), (3, "de", "braten rind"), (4, "en", "rinderbraten")], "id long, lang string, folded string")
    assert rows(catalogue.compound_heads(names)) == [(1, "braten")]
    words = catalogue.lexicon(names, ["lang"]).select("lang", "word")
    asked = spark.createDataFrame([("de", "rinderbraten"), ("de", "rinds"), ("de", "rind")], "lang string, token string")
    assert rows(catalogue.split_compounds(asked, words, ["lang"]), "token", "stem", "head") == [("rinderbraten", "rind", "braten")]
    assert rows(catalogue.depluralize(asked, words, ["lang"]), "token", "stem") == [("rinds", "rind")]


FOODS = "id long, name string, name_folded string, alias_names string, aliases array<struct<lang:string,name:string>>, search_extra string, brand string, source string, lang string, basic_rank int, quality int, preferred boolean"


def test_ranked_search(spark):
    def food(i, name, source, lang, rank=1, extra=None, aliases=(), brand=None):
        return (i, name, name.lower(), "\n".join(a[1].lower() for a in aliases) or None, list(aliases), extra, brand, source, lang, rank, 50, True)

    foods = spark.createDataFrame([food(1, "Butter", "bls", "de", 0), food(2, "Butter, gesalzen", "bls", "de"), food(3, "Butterkeks", "bls", "de"), food(4, "Erdnuss Butter", "bls", "de"), food(5, "Butter", "usda", "en", 0), food(6, "Butter Deluxe", "off", None, brand="Acme"), food(7, "Gurke", "usda", "en"), food(8, "Butter", "bls", "de", 2), food(9, "Gurke", "swiss", "de")], FOODS)
    served = spark.createDataFrame([("bls", "de", 1), ("usda", "en", 1), ("swiss", "de", 1)], "source string, lang string, place int")
    q = spark.createDataFrame([(1, "butter", ["butter"], "bls", ["de", "en"], 10), (2, "gurke", ["gurke"], "bls", ["de", "en"], 10), (3, "acme", ["acme"], "bls", ["de"], 10), (4, "nothing", ["nothing"], "bls", ["de"], 10)], "query_id long, q string, tokens array<string>, source string, languages array<string>, limit int")
    got = {}
    for r in search.search(q, foods, served).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.id, r.shelf, r.tier))
    assert got == {1: [(1, 0, 0), (8, 0, 0), (2, 0, 1), (4, 0, 3), (3, 0, 4), (6, 2, 1)], 2: [(9, 1, 0)], 3: [(6, 2, 2)]}
    name = foods.limit(1).select(search.display_name(F.lit("Butter"), F.lit("de"), F.expr("array(named_struct('lang','fr','name','beurre'),named_struct('lang','en','name','butter'))"), F.array(F.lit("en"), F.lit("de"))).alias("n"))
    assert name.first().n == "butter"


def test_maintenance(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, created int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "k long, v string, created int")
    assert rows(maintain.upsert_by_key(base, new, ["k"], ["created"])) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    assert rows(maintain.insert_ignore(base, new, ["k"])) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    assert rows(maintain.insert_replace(base, new, "k")) == [(1, "a", 10), (2, "B", 99), (3, "c", 30)]
    kept, gone = maintain.delete_by(base, new, ["k"])
    assert (rows(kept), rows(gone)) == ([(1, "a", 10)], [(2, "b", 20)])
    with pytest.raises(tables.ContractError):
        maintain.restore_all(base, new, "k")
    goals = spark.createDataFrame([(1, 1, D(2024, 1, 1), 100.0), (2, 1, D(2024, 2, 1), 200.0)], "id long, user_id long, effective_from date, kcal double")
    edits = spark.createDataFrame([(1, (100.0,), (150.0,), D(2024, 2, 1)), (2, (999.0,), (1.0,), None), (7, (1.0,), (2.0,), None)], "id long, expected struct<kcal:double>, replacement struct<kcal:double>, expected_next date")
    after, errors = maintain.guarded_update(goals, edits, "id", ["kcal"], by="user_id", start="effective_from")
    assert rows(after, "id", "kcal") == [(1, 150.0), (2, 200.0)] and rows(errors) == [(2, "changed meanwhile"), (7, "missing")]
    events = spark.createDataFrame([(1, "x", 1, "bundled"), (1, "y", 2, "bundled"), (2, "z", 1, "bundled"), (3, "q", 1, "quick")], "k long, v string, at int, kind string")
    favourites = spark.createDataFrame([(2, "old", 0), (5, "old", 0)], "k long, v string, at int")
    assert rows(maintain.toggle(favourites, events, ["k"], "at"), "k", "v") == [(5, "old")]


def test_log_entries(spark):
    foods = spark.createDataFrame([("bundled", 1, "Milk", None, "ml", 1.03, 60.0, 3.0, 3.0, 5.0)], "kind string, id long, name string, brand string, basis string, density double, kcal double, protein double, fat double, carbs double")
    asks = spark.createDataFrame([(1, D(2024, 1, 1), "lunch", "bundled", 1, None, 200.0, "ml", None, None, None, None, None), (1, D(2024, 1, 1), "lunch", "quick", None, "Snack", 1.0, "g", None, 90.0, 1.0, 1.0, 1.0), (1, D(2024, 1, 1), "lunch", "bundled", 9, None, 1.0, "g", None, None, None, None, None)], "user_id long, log_date date, meal string, kind string, ref_id long, name string, amount double, unit string, portion_grams double, kcal double, protein double, fat double, carbs double")
    assert rows(diary.log_entries(asks, foods), "name", "kcal", "basis_amount", "reject_reason") == [("Milk", 120.0, 200.0, None), ("Snack", 90.0, 1.0, None), (None, None, 1.0, "unknown food")]


def seeded(spark):
    foods = spark.createDataFrame([(1, "Milk", None, "bls", "de", 60.0, 3.0, 3.0, 5.0, 0.0, 4.0, 1.0, 0.1, "available", 1, 0, "milk", "lait", None)], "id long, name string, brand string, source string, lang string, kcal double, protein double, fat double, carbs double, fibre double, sugar double, saturated double, sodium double, carbs_convention string, basic_rank int, source_rank int, name_folded string, alias_names string, barcode string")
    aliases = spark.createDataFrame([(1, 0, "fr", "Lait")], "food_id long, ord int, lang string, name string")
    return {"foods": foods, "aliases": aliases, "barcodes": spark.createDataFrame([("96385074", 1)], "barcode string, food_id long"), "servings": spark.createDataFrame([(1, 0, "cup", 240.0)], "food_id long, sort_order int, label string, grams double")}


def test_audit_finds_each_defect(spark):
    clean = seeded(spark)
    assert [r.check for r in audit.audit(**clean).collect() if not r.passed] == []
    defects = {
        "sodium above 45": {"foods": clean["foods"].withColumn("sodium", F.lit(50.0))},
        "unknown source": {"foods": clean["foods"].withColumn("source", F.lit("zz"))},
        "serving label is a unit": {"servings": clean["servings"].withColumn("label", F.lit("oz"))},
        "alias without food": {"aliases": clean["aliases"].union(spark.createDataFrame([(9, 0, "fr", "x")], clean["aliases"].schema))},
        "bag isn't the aliases in order": {"foods": clean["foods"].withColumn("alias_names", F.lit("other"))},
        "wrong check digit": {"barcodes": clean["barcodes"].withColumn("barcode", F.lit("96385075"))},
    }
    for check, change in defects.items():
        assert check in [r.check for r in audit.audit(**{**clean, **change}).collect() if not r.passed]
    errors = audit.reconcile_figures(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, value double"), spark.createDataFrame([(1, 1.0 + 1e-16), (3, 3.0)], "k long, value double"), ["k"])
    assert rows(errors, "k", "error") == [(2, "missing"), (3, "unexpected")]


def test_catalogue_round_trip(spark, tmp_path):
    figures = {"popularity": 1, "nova": None}
    foods = spark.createDataFrame([(i, f"Food {i}", None, None, "bls", "de", None, *[1.0] * 8, "available", "g", None, figures["nova"], 1, [("en", "F")], [("cup", 100.0), ("slice", 20.0)], i) for i in (1, 2)], ", ".join(f for f in common.FOOD_SCHEMA.split(", ") if f not in ("key string", "reject_reason string")))
    members = foods.select("id", F.lit(True).alias("preferred"))
    folder = catalogue.write_catalogue(foods, members, f"file://{tmp_path}/cat", "v1")
    back = catalogue.read_catalogue(spark, f"file://{tmp_path}/cat")
    assert folder and back["foods"].count() == 2 and rows(back["servings"], "food_id", "label", "is_default") == [(1, "cup", True), (1, "slice", False), (2, "cup", True), (2, "slice", False)]
    assert back["meta"].first().sources == "bls:2"
    with pytest.raises(tables.ContractError):
        catalogue.write_catalogue(foods.union(foods), members, f"file://{tmp_path}/cat", "v2")
    assert catalogue.read_catalogue(spark, f"file://{tmp_path}/cat")["meta"].first().version == "v1"


def write(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_text(text, encoding=encoding)
    return f"file://{tmp_path}/{name}"


def test_relational_sources(spark, tmp_path):
    write(tmp_path, "food.csv", "fdc_id,data_type,description\n1,foundation_food,\"Apples, raw\"\n2,sub_sample,Skip\n3,sr_legacy_food,No figures\n")
    write(tmp_path, "food_nutrient.csv", "id,fdc_id,nutrient_id,amount\n1,1,1008,52\n2,1,1003,0.3\n3,1,1004,0.2\n4,1,1005,13\n5,1,1093,1000\n6,1,1005,14\n")
    write(tmp_path, "measure_unit.csv", "id,name\n9,cup\n8,undetermined\n")
    write(tmp_path, "food_portion.csv", "id,fdc_id,gram_weight,portion_description,measure_unit_id,modifier\n1,1,110,,9,sliced\n2,1,180,,8,medium\n3,1,28,,8,oz\n")
    got = {r.key: r for r in national.load_usda(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"1", "3"} and got["3"].reject_reason == "no energy" and got["1"].reject_reason is None
    assert (got["1"].id, got["1"].carbs, got["1"].sodium, got["1"].carbs_convention) == (200_000_001, 14.0, 1.0, "by_difference")
    assert [(s.label, s.grams) for s in got["1"].servings] == [("medium", 180.0), ("cup sliced", 110.0)]
    write(tmp_path, "Food_Name.csv", "﻿Food_Code,Food_Description_EN,Food_Description_FR\n2,Bread,Pain\n")
    write(tmp_path, "Nutrient_Amount.csv", "Food_Code,Nutrient_Code,Nutrient_Amount\n2,208,250\n2,203,9\n2,204,3\n2,205,48\n")
    bread = national.load_cnf(spark, f"file://{tmp_path}").first()
    assert bread.reject_reason is None and [(a.lang, a.name) for a in bread.aliases] == [("fr", "Pain")]


def test_xml_and_json_sources(spark, tmp_path):
    names = write(tmp_path, "alim.xml", "<T><ALIM><alim_code> 5 </alim_code><alim_nom_fr>Beurre</alim_nom_fr><alim_nom_eng>Butter</alim_nom_eng></ALIM></T>")
    cells = {"328": "0", "333": "740", "25000": "0,7", "40000": "82", "31000": "< 1"}
    values = write(tmp_path, "compo.xml", "<T>" + "".join(f"<COMPO><alim_code>5</alim_code><const_code>{c}</const_code><teneur>{v.replace('<', '&lt;')}</teneur></COMPO>" for c, v in cells.items()) + "</T>")
    butter = national.load_ciqual(spark, names, values).first()
    assert (butter.kcal, butter.carbs, butter.reject_reason, butter.id) == (740.0, 0.5, None, 100_000_005)
    food = {"foodId": "01.001 ", "foodName": "Milk", "calories": {"quantity": 63}, "constituents": [{"nutrientId": n, "quantity": q, "unit": u} for n, q, u in (("Protein", 3.4, "g"), ("Fett", 3.5, "g"), ("Karbo", 4.6, "g"), ("Na", 40, "mg"))]}
    en, nb = (write(tmp_path, f"{x}.json", json.dumps({"foods": [{**food, "foodName": n}]})) for x, n in (("en", "Milk"), ("nb", "Melk")))
    milk = national.load_matvaretabellen(spark, en, nb).first()
    assert (milk.id, milk.kcal, milk.sodium, milk.aliases[0].name) == (120_000_001_001, 63.0, 0.04, "Melk")
    other = write(tmp_path, "other.json", json.dumps({"foods": [{**food, "foodId": "02.001"}]}))
    with pytest.raises(tables.ContractError):
        national.load_matvaretabellen(spark, en, other)


def test_wide_sources(spark, tmp_path):
    path = write(tmp_path, "cofid.csv", "Food Code,Food Name,PROT,FAT,CHO,KCALS,TOTSUG,AOACFIB,SATFOD,NA\n11-1,Oats,11,9,66,380,Tr,N,(1.5),10\n11-2,Twice,1,1,1,17,,,,\n11-2,Again,1,1,1,17,,,,\n")
    got = {r.name: r for r in national.load_wide(spark, path, national.COFID).collect()}
    assert (got["Oats"].sugar, got["Oats"].fibre, got["Oats"].saturated, got["Oats"].sodium, got["Oats"].reject_reason) == (0.0, None, 1.5, 0.01, None)
    assert got["Twice"].reject_reason == got["Again"].reject_reason == "ambiguous code"
    cells = "f_id,f_eng_name,f_ori_name," + ",".join(f"{c},{c}_unit" for c in national.BEDCA)
    wide = write(tmp_path, "bedca.csv", cells + "\n7,Cheese,Queso,1674,kJ,25,g,33,g,1300,mg,0,g,1,g,20,g,8000,mg\n")
    basis = write(tmp_path, "basis.csv", "f_id,eur_name,moex\n" + "".join(f"7,{c},{'WKG' if c == 'NA' else 'W'}\n" for c in national.BEDCA if c != "FASAT"))
    cheese = national.load_bedca(spark, wide, basis).first()
    assert (round(cheese.kcal, 1), cheese.carbs, cheese.saturated, cheese.sodium) == (400.1, 1.3, None, 0.8)


def test_finnish_source(spark, tmp_path):
    files = {"food": "FOODID\n1\n", "foodname_EN": "FOODID;FOODNAME\n1;MILK, VITAMIN D\n", "foodname_FI": "FOODID;FOODNAME\n1;MAITO Ä\n", "foodname_SV": "FOODID;FOODNAME\n1;MJÖLK\n", "component": "EUFDNAME;COMPUNIT\n" + "".join(f"{k};{v}\n" for k, v in national.FINELI_UNITS.items()), "component_value": "FOODID;EUFDNAME;BESTLOC\n1;ENERC;251,04\n1;PROT;3\n1;FAT;3,5\n1;CHOAVL;4,5\n"}
    for n, t in files.items():
        write(tmp_path, f"{n}.csv", t, "cp1252")
    milk = national.load_fineli(spark, f"file://{tmp_path}").first()
    assert (milk.name, round(milk.kcal, 6), [a.name for a in milk.aliases], milk.reject_reason) == ("Milk, vitamin D", 60.0, ["Maito ä", "Mjölk"], None)


def test_branded_and_text_formats(spark, tmp_path):
    head = "\t".join(strict.OFF_COLUMNS)

    def product(code, name, flags="", brand="Acme", kcal="60"):
        return "\t".join([code, name, brand, kcal, "3", "3,5", "4.5", "", "", "", "", "30 g", "", "12", "1", flags, "en:france"])

    lines = [head, product("96385074", "Milk"), product("96385075", "Milk"), product("12", "Milk"), product("96385074", "123"), product("96385074", "Milk", "en:energy-value-x"), product("96385074", "Acme"), "short"]
    path = write(tmp_path, "off.tsv", "\n".join(lines) + "\n")
    codes = F.create_map(F.lit("france"), F.lit("FR"))
    got = sorted(strict.load_branded(spark, path, codes).collect(), key=lambda r: r.ord)
    assert [r.reject_reason for r in got] == [None, "wrong check digit", "malformed code", "unusable name", "flagged upstream", None, "short row"]
    assert (got[0].id, got[0].brand, got[0].country, got[0].servings[0].grams, got[5].brand) == (1_000_096_385_074, "Acme", "FR", 30.0, None)
    words = spark.createDataFrame([("bls", "de", "milch"), ("bls", "de", "brot")], "source string, lang string, word string")
    strict.write_lexicon(words, f"file://{tmp_path}/lex")
    assert strict.verify_lexicon(words, strict.read_lexicon(spark, f"file://{tmp_path}/lex")).count() == 0
    judged = strict.read_judged(spark, write(tmp_path, "j.tsv", "# comment\nmilk\tUS\ten\t^milk\tshake\nxyz\tUS\ten\t-\n"))
    assert rows(judged, "query", "acceptable", "unacceptable") == [("milk", "^milk", "shake"), ("xyz", None, None)]


def test_strict_tables(spark):
    portions = spark.createDataFrame([("1", "cup", 240.0), ("1", "cup", 250.0), ("2", "cup", 1.0)], "key string, label string, grams double")
    none = spark.createDataFrame([], "key string, label string, grams double, all array<double>")
    with pytest.raises(tables.ContractError):
        strict.resolve_portions(portions, none)
    pinned = spark.createDataFrame([("1", "cup", 240.0, [240.0, 250.0])], none.schema)
    assert rows(strict.resolve_portions(portions, pinned)) == [("1", "cup", 240.0), ("2", "cup", 1.0)]
    a = spark.createDataFrame([("x", "N", 1, 5), ("x", "N", 2, 6)], "code string, name string, o int, p int")
    assert strict.join_sheets(a, a.drop("p").withColumn("q", F.lit(1)), "code", "name", "o").count() == 2
    with pytest.raises(tables.ContractError):
        strict.join_sheets(a, a.limit(1), "code", "name", "o")


def test_streams_equal_batches(spark, tmp_path):
    schema = "old struct<user_id:bigint,log_date:date,kcal:double>, new struct<user_id:bigint,log_date:date,kcal:double>"
    day = D(2024, 1, 1)
    changes = [(None, (1, day, 5.0)), (None, (1, day, 7.0)), ((1, day, 5.0), (1, day, 6.0)), ((1, day, 7.0), None), (None, (2, day, 1.0))]
    df = spark.createDataFrame(changes, schema)
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    want = [(1, day, 1, 6.0), (2, day, 1, 1.0)]
    assert rows(live.live_day_totals(df, ["kcal"], ["user_id", "log_date"])) == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    live.live_day_totals(stream, ["kcal"], ["user_id", "log_date"]).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("totals")) == want
    products = "barcode string, kcal double, protein double, fat double, carbs double, errors string, quality int, popularity int, ord long"
    for k, data in enumerate([[("96385074", 60.0, 3.0, 3.0, 5.0, "", 50, 1, 0), ("96385075", 60.0, 3.0, 3.0, 5.0, "", 99, 1, 1)], [("96385074", 60.0, 3.0, 3.0, 5.0, "", 50, 1, 2), ("96385074", 60.0, 3.0, 3.0, 5.0, "", 60, 0, 3)]]):
        spark.createDataFrame(data, products).coalesce(1).write.parquet(f"file://{tmp_path}/p/{k}")
    stream = spark.readStream.schema(products).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/p")
    live.keep_current(stream, f"file://{tmp_path}/best", f"file://{tmp_path}/c2", live.ingest_products(), ["barcode"]).awaitTermination()
    assert rows(live.read_current(spark, f"file://{tmp_path}/best"), "barcode", "quality", "ord") == [("96385074", 60, 3)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    tables.assert_columns(df, ["a"], {1: "b"})
    with pytest.raises(tables.ContractError):
        tables.assert_columns(df, ["c"])
    with pytest.raises(tables.ContractError):
        tables.assert_columns(df, ["a"], {0: "b"})
    assert tables.content_digest(df.union(df)).first().n == 2
    with pytest.raises(tables.ContractError):
        common.union_sources({"bls": spark.createDataFrame([], "source string")})
