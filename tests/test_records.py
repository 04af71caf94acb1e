"""Old snapshots brought up to date, the diary export, and small rules: results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from platewise.functions import foods, numbers
from platewise.operators import catalogue, diary, maintain

D = datetime.date
LOGS = "id long, log_date date, meal_type int, food_source string, food_id long, food_name string, amount double, amount_unit string, calories double, protein double, fat double, carbs double, created_at long"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_entries_of_version_1(spark):
    cases = [
        (1, 0, "db", 5, "g", (4, "bundled", 5, "g")),
        (2, 1, "bundled", 6, "cup", (1, "bundled", 6, "cup")),
        (3, 2, "custom", 7, "", (2, "custom", 7, "g")),
        (4, 3, "quick", 8, None, (3, "quick", None, "g")),
        (5, 4, "manual", 9, "ml", (4, "quick", 9, "ml")),
        (6, 4, None, 9, "oz", (4, "quick", 9, "oz")),
    ]
    old = spark.createDataFrame([(i, D(2024, 1, i), meal, source, food, "x", 2.0, unit, 10.0, 1.0, 1.0, 1.0, None) for i, meal, source, food, unit, _ in cases], LOGS)
    new = maintain.upgrade_entries(old, 1)
    assert rows(new, "id", "meal_type", "food_ref_kind", "food_ref_id", "unit_label") == [(c[0], *c[5]) for c in cases]
    assert {tuple(r) for r in new.select("quantity", "grams", "basis_amount", "nutrition_basis", "nutrition_metadata", "created_at", "updated_at").collect()} == {(2.0, 2.0, 2.0, "g", None, 0, 0)}
    middle = spark.createDataFrame([(1, None)], "id long, grams double")
    assert rows(maintain.upgrade_entries(middle, 6), "id", "basis_amount") == [(1, None)]


def test_snapshot_of_version_2(spark):
    logs = spark.createDataFrame([(1, D(2024, 3, 2), 1, "quick", None, "x", 1.0, "g", 1.0, 1.0, 1.0, 1.0, 9), (2, D(2024, 2, 1), 1, "quick", None, "x", 1.0, "g", 1.0, 1.0, 1.0, 1.0, 9)], LOGS)
    goals = spark.createDataFrame([(1800.0, None, 60.0, None)], "calories_target double, protein_target double, fat_target double, carbs_target double")
    fav = spark.createDataFrame([(1, "bundled", 5, "A", 2, 7), (2, "bundled", 5, "B", 1, 8), (3, "db", 6, "C", None, None), (4, "else", 6, "D", 0, 1), (5, "custom", None, "E", 0, 1)], "id long, food_source string, food_id long, food_name string, sort_order int, created_at long")
    custom = spark.createDataFrame([(1, "Crème", None, "96385074", 1.0, 1.0, 1.0, 1.0, 30.0, "", None), (2, "Tea", "Œuf", None, 1.0, 1.0, 1.0, 1.0, 0.0, "cup", 5), (3, "Bun", None, None, 1.0, 1.0, 1.0, 1.0, 40.0, "bun", 5)], "id long, description string, brand_owner string, gtin_upc string, calories_100g double, protein_100g double, fat_100g double, carbs_100g double, serving_size double, serving_unit string, created_at long")
    out = maintain.upgrade_snapshot({"daily_logs": logs, "goals": goals, "favorites": fav, "custom_foods": custom}, 2)
    assert rows(out["goals"]) == [(D(2024, 2, 1), 1800.0, 150.0, 60.0, 250.0, "manual", 0)]
    assert rows(out["favorites"], "food_ref_kind", "food_ref_id", "food_name", "sort_order", "created_at") == [("bundled", 5, "A", 2, 7), ("bundled", 6, "C", 0, 0), ("custom", 6, "D", 0, 1)]
    assert rows(out["custom_food_servings"]) == [(1, "serving", 30.0, True, 0), (3, "bun", 40.0, True, 0)]
    assert rows(out["custom_foods"], "id", "name_folded", "brand_folded", "source", "nutrition_basis", "updated_at") == [(1, "creme", None, None, "g", 0), (2, "tea", "oeuf", None, "g", 5), (3, "bun", None, None, "g", 5)]
    none = maintain.upgrade_snapshot({"daily_logs": logs.limit(0), "goals": goals, "favorites": fav, "custom_foods": custom}, 1)
    assert none["goals"].first().effective_from == D(1970, 1, 1)


def test_export(spark, tmp_path):
    entries = spark.createDataFrame([(D(2024, 1, 2), "BREAKFAST", "=cmd", None, 1.5, "g", None, 10.0, 1.0, 2.0, 3.0, "g", 1.5, None, "", 5), (D(2024, 1, 1), "snack", 'a "b", c', "Acme", 1.0, "cup", 240.0, 10.0, 1.0, 2.0, 3.0, "ml", 1.0, "{}", "Credit", 1), (D(2024, 1, 1), "dinner", "x", None, 1.0, "g", 1.0, 10.0, 1.0, 2.0, 3.0, "g", 1.0, None, None, 9)], "date date, meal string, food_name string, brand string, quantity double, unit string, grams double, calories double, protein_g double, fat_g double, carbs_g double, nutrition_basis string, basis_amount double, nutrition_metadata string, source_credit string, created_at long")
    diary.write_export(entries, f"file://{tmp_path}/out")
    got = [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    want = [
        "date,meal,food_name,brand,quantity,unit,grams,calories,protein_g,fat_g,carbs_g,nutrition_basis,basis_amount,nutrition_metadata,source_credit",
        '2024-01-01,dinner,"x",,1.0,"g",1.0,10.0,1.0,2.0,3.0,"g",1.0,,',
        '2024-01-01,snack,"a ""b"", c","Acme",1.0,"cup",240.0,10.0,1.0,2.0,3.0,"ml",1.0,"{}","Credit"',
        '2024-01-02,breakfast,"\'=cmd",,1.5,"g",,10.0,1.0,2.0,3.0,"g",1.5,,',
    ]
    assert sorted(got) == sorted(want)
    first = sorted(p.name for p in (tmp_path / "out").glob("part-*"))[0]
    assert (tmp_path / "out" / first).read_text().splitlines()[0] == want[0]


def test_orders_and_small_rules(spark):
    weights = spark.createDataFrame([(1, D(2024, 1, 1)), (1, D(2024, 1, 3))], "user_id long, measured_on date")
    assert rows(maintain.ordered(weights, "weights"), "measured_on", "place") == [(D(2024, 1, 1), 2), (D(2024, 1, 3), 1)]
    fav = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 9, "b"), (1, 1, 99, "c")], "user_id long, sort_order int, created_at long, n string")
    assert rows(maintain.ordered(fav, "favourites"), "n", "place") == [("a", 2), ("b", 1), ("c", 3)]
    df = spark.createDataFrame([("GB", "6000"), ("NL", "700"), ("BR", "x"), (None, "")], "c string, t string")
    typed = numbers.parse_number(F.col("t"))
    got = [tuple(r) for r in df.select(foods.national_source(F.col("c")), numbers.is_implausible(typed, 5000.0), numbers.is_below(typed, 800.0)).collect()]
    assert got == [("cofid", True, False), ("nevo", False, True), ("", False, False), ("", False, False)]
    offer = spark.createDataFrame([(True, True, "96385074", True), (True, False, "96385074", True), (True, True, "1", True), (True, None, None, True)], "a boolean, m boolean, b string, c boolean")
    assert [r[0] for r in offer.select(maintain.offerable_custom(F.col("a"), F.col("m"), F.col("b"), F.col("c"))).collect()] == [True, False, False, False]
    assert catalogue.source_versions({"usda": "/x/FoodData.zip", "off": "off.tsv.gz", "bls": "d/bls.csv/", "nevo": None}) == "off:off.tsv.gz,bls:bls.csv,usda:FoodData.zip"
    with pytest.raises(KeyError):
        maintain.ordered(fav, "other")
