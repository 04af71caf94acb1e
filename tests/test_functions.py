"""Golden rows of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from platewise.functions import foods, nutrition, numbers, text


def values(spark, expr, rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_to_float(spark):
    rows = {"1,5": 1.5, " 2.0 ": 2.0, "": None, "-": None, None: None, "traces": 0.0, "Trace": 0.0, "< 0,5": 0.25, "<1": 0.5, "1,234.5": None, "NaN": None, "1.0f": None, "1_0": None, "Infinity": None, "1e3": 1000.0, "-3": -3.0, ".5": 0.5}
    assert values(spark, numbers.to_float(F.col("x")), rows) == list(rows.values())


@pytest.mark.parametrize(("dialect", "rows"), [("german", {"TR": 0.0, "-": None, "<LOD": None, "1,2": 1.2}), ("uk", {"Tr": 0.0, "N": None, "(3.5)": 3.5, "2": 2.0}), ("swiss", {"tr.": 0.0, "n.d.": None, "< 2": 1.0})])
def test_parse_cell(spark, dialect, rows):
    assert values(spark, numbers.parse_cell(F.col("x"), dialect), rows) == list(rows.values())


def test_strict_figures(spark):
    rows = [("<0,5", "mg", "SODIUM", None), ("tr", "g", "FAT", None), ("12", "kcal", "CALORIES", "AVERAGE"), (">=3", "g", "FAT", None), ("1.2.3", "g", "FAT", None), ("1", "kJ", "CALORIES", None), (None, "g", "FAT", None), ("1", "g", "FAT", "LOGICAL_ZERO"), ("0", "g", "FAT", "LOGICAL_ZERO")]
    df = spark.createDataFrame(rows, "r string, u string, n string, k string").select(numbers.parse_nutrient(F.col("r"), F.col("u"), F.col("n"), F.col("k")).alias("v"))
    got = [r.v for r in df.collect()]
    assert (got[0].value, got[0].upper, got[0].upper_inclusive, got[0].qualifiers) == (0.0005, 0.0005, False, ["BOUNDED"])
    assert (got[1].value, got[1].qualifiers, got[2].qualifiers, got[3].lower, got[3].lower_inclusive) == (None, ["TRACE"], ["AVERAGE"], 3.0, True)
    assert [g.error for g in got[4:]] == ["malformed figure", "wrong unit", None, "logical zero isn't zero", None]
    bad = df.select(numbers.nutrient_violations(F.col("v")).alias("x")).collect()
    assert bad[0].x == [] and bad[8].x == []


def test_nutrient_json_round_trip(spark):
    df = spark.range(1).select(F.create_map(F.lit("FAT"), F.struct(F.lit(1.5).alias("value"), F.array(F.lit("TRACE")).alias("qualifiers"))).cast("map<string,struct<value:double,qualifiers:array<string>>>").alias("m"))
    out = df.select(numbers.decode_nutrients(numbers.encode_nutrients(F.col("m"))).alias("d")).first().d
    assert out.nutrients["FAT"].value == 1.5 and out.error is None
    got = values(spark, numbers.decode_nutrients(F.col("x"))["error"], ['{"version":2,"nutrients":{}}', '{"nutrients":{}}', None, "{"])
    assert got == ["unknown version", None, None, "malformed"]


def test_parse_number(spark):
    got = values(spark, numbers.parse_number(F.col("x")), ["1,5", "", None, "1.2.3", "-1", "7"])
    assert [(g.value, g.status) for g in got] == [(1.5, "ok"), (None, "empty"), (None, "empty"), (None, "unusable"), (None, "unusable"), (7.0, "ok")]


def test_fold_and_clean(spark):
    rows = {"Crème Brûlée": "creme brulee", "Œuf, cru": "oeuf, cru", "Rødgrød": "rodgrod", "STRAẞE": "strasse", "ayam™": "ayamtm", "Łosoś": "losos", "Молоко": "молоко", None: None}
    assert values(spark, text.fold_name(F.col("x")), rows) == list(rows.values())
    latin = [k for k in rows if k and k not in ("ayam™", "Молоко")]
    assert values(spark, text.fold_latin(F.col("x")), latin) == [rows[k] for k in latin]
    rows = {"CÃ´te de boeuf": "Côte de boeuf", "a&amp;b  c": "a b c", "x": None, "www.shop.com": None, "123": None, " Milk\x07 ": "Milk", "y" * 121: None, None: None}
    assert values(spark, text.clean_name(F.col("x")), rows) == list(rows.values())


def test_names(spark):
    rows = {"Zucchini, raw": "Courgette, raw", "Beef, ground, 70% lean": "Beef, minced, 70% lean", "Onions, spring or scallions": None, "Milk": None, "Beets, raw": "Beetroots, raw", "Spices, nutmeg, ground": None, "skim milk yogurt": "skimmed milk yoghurt"}
    assert values(spark, text.british_name(F.col("x")), rows) == list(rows.values())
    rows = {"3.5 % MILK, VITAMIN C": "3.5 % Milk, vitamin C", "FRENCH BREAD": "French bread", "Mixed Case": "Mixed Case", "JANSSON'S TEMPTATION": "Jansson's temptation"}
    assert values(spark, text.sentence_case(F.col("x")), rows) == list(rows.values())
    assert values(spark, text.slug(F.col("x")), ["Côte d'Ivoire", " A--b "]) == ["cote-d-ivoire", "a-b"]
    assert values(spark, text.query_tokens(F.col("x")), ["chick'br 50€", "...", "a b c d e f g h i j"]) == [["chick", "br", "50"], None, list("abcdefgh")]
    assert values(spark, text.csv_escape(F.col("x")), [None, "=1+1", 'a"b', "x,y", "plain"]) == ["", '"\'=1+1"', '"a""b"', '"x,y"', '"plain"']
    assert values(spark, text.escape_like(F.col("x")), ["50%_\\"]) == ["50\\%\\_\\\\"] and values(spark, text.strip_like(F.col("x")), ["5%_0"]) == ["50"]
    codes = F.create_map(F.lit("france"), F.lit("FR"), F.lit("world"), F.lit("world"))
    assert values(spark, text.first_country(F.col("x"), codes), ["en:france,en:xx", "France", "en:world,en:france", None, "zz"]) == ["FR", "FR", None, None, None]


def test_british_name_works_each_term_out_once(spark):
    """What reads the replaced name several times must not repeat the chain of replacements for each reading."""
    plan = spark.createDataFrame([("x",)], "x string").select(text.british_name(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("courgette") == 3  # whether it is known (twice: for both cases of the first letter), and the word itself


def test_gate_and_ranks(spark):
    rows = [(None, 1.0, 1.0, 1.0), (950.0, 1.0, 1.0, 1.0), (100.0, None, 1.0, 1.0), (100.0, 101.0, 1.0, 1.0), (400.0, 50.0, 30.0, 40.0), (0.0, 2.0, 0.0, 0.0), (300.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 8.0), (52.0, 0.3, 0.2, 14.0)]
    got = values(spark, foods.reject_reason(*[F.col(c) for c in "kpfc"]), rows, "k double, p double, f double, c double")
    assert got == ["no energy", "energy range", "incomplete macros", "macro range", "macro sum", "zero energy", "Atwater", None, None]
    rows = [("Apples, raw", "usda", None), ("Apple juice", "usda", None), ("Biscuits, plain", "usda", None), ("Biscuits, plain", "bls", None), ("Soup, prepared with whole milk", "usda", None), ("Milk, whole", "usda", None), ("Bread, wholemeal", "bls", None), ("boiled egg", "off", 1), ("bar", "off", 4), ("Cheesecake", "bls", None), ("oilseed", "bls", None)]
    assert values(spark, foods.basic_rank(F.col("n"), F.col("s"), F.col("v")), rows, "n string, s string, v int") == [0, 2, 1, 2, 1, 0, 1, 0, 2, 2, 1]
    assert values(spark, foods.gtin_ok(F.col("x")), ["4006381333931", "4006381333932", "96385074", "036000291452", "abc", "", None, "1234567"]) == [True, False, True, True, False, False, False, False]


def test_servings(spark):
    assert values(spark, foods.serving_label(F.col("x")), ["cup, mashed", "NLEA serving", "Medium (7 in)", "a rather long portion of something", "fillet", "(x)"]) == ["cup", "serving", "medium", None, "fillet", None]
    assert values(spark, foods.is_named_serving(F.col("x")), ["oz", "Fl. oz.", "slice"]) == [False, False, True]
    assert values(spark, foods.serving_grams(F.col("t"), F.col("q")), [("30 g", None), ("1 cup (250 ml)", 250.0), ("", 40.0), ("1 bar", 9.0), ("2 oz", None), (None, None)], "t string, q double") == [30.0, None, 40.0, None, 56.69904625, None]
    rows = [([("cup", 240.0), ("medium", 118.0), ("Cup", 100.0), ("whole", 5717.0), ("slice", 20.0)],)]
    got = values(spark, foods.clean_servings(F.col("s")), rows, "s array<struct<label:string,grams:double>>")[0]
    assert [(r.label, r.grams) for r in got] == [("medium", 118.0), ("slice", 20.0), ("cup", 240.0)]
    rows = [("usda", "123"), ("bls", "C133000"), ("cofid", "11-442"), ("foodfiles", "A12"), ("off", "4006381333931"), ("usda", "x y"), ("other", "1")]
    assert values(spark, foods.stable_id(F.col("s"), F.col("k")), rows, "s string, k string") == [200_000_123, 300_000_000 + int("C133000", 36), 110_000_110_442, 210_000_000_012, 5_006_381_333_931, None, None]


def test_quantities_and_targets(spark):
    rows = [(2.0, "oz", "g", None, None), (100.0, "ml", "g", 1.5, None), (100.0, "ml", "g", None, None), (100.0, "ml", "ml", None, None), (2.0, "portion", "ml", 2.0, 30.0), (1.0, "portion", "g", None, 0.0), (float("nan"), "g", "g", None, None)]
    got = values(spark, nutrition.resolve_quantity(*[F.col(c) for c in "aubdp"]), rows, "a double, u string, b string, d double, p double")
    assert [(g.grams, g.basis_amount) for g in got] == [(56.69904625, 56.69904625), (150.0, 150.0), (None, None), (None, 100.0), (60.0, 30.0), (None, None), (None, None)]
    ages = values(spark, nutrition.age_on(F.col("b"), F.lit(datetime.date(2001, 2, 28))), [(datetime.date(2000, 2, 29),), (datetime.date(2000, 2, 28),), (datetime.date(2002, 1, 1),)], "b date")
    assert ages == [0, 1, None]
    b = values(spark, nutrition.bmr(*[F.col(c) for c in "swhaf"]), [("male", 80.0, 180.0, 30, None), ("unspecified", 80.0, 180.0, 30, None), (None, 80.0, None, None, 20.0), ("male", 5.0, 180.0, 30, None), ("male", 80.0, 300.0, 30, None)], "s string, w double, h double, a int, f double")
    assert b == [1780.0, 1697.0, 370 + 21.6 * 64, None, None]
    t = values(spark, nutrition.calorie_target(*[F.col(c) for c in "bfwsdr"]), [(1780.0, 1.2, 80.0, "male", "lose", 9.0), (1780.0, 1.2, 80.0, "male", None, None), (1000.0, 1.2, 50.0, "female", "lose", 0.5), (None, 1.2, 50.0, "male", None, None)], "b double, f double, w double, s string, d string, r double")
    assert t == [1780.0, 2136.0, 1200.0, None]
    m = values(spark, nutrition.split_macros(F.col("k"), F.col("w"), F.col("d")), [(2136.0, 80.0, "maintain")], "k double, w double, d string")[0]
    assert (m.protein, m.fat, m.carbs) == (128.0, 66.0, 258.0)
    s = values(spark, nutrition.kg_to_stone(F.col("k")), [(63.5,), (63.49,), (60.0,)], "k double")
    assert [(x.stone, round(x.pounds, 1)) for x in s] == [(10, 0.0), (10, 0.0), (9, 6.3)]
    d = values(spark, nutrition.display_carbs(F.col("c"), F.col("f"), F.col("v")), [(10.0, 12.0, "by_difference"), (10.0, None, "by_difference"), (10.0, 1.0, "available_monosaccharide"), (10.0, 1.0, "available")], "c double, f double, v string")
    assert [(x.value, x.label) for x in d] == [(0.0, None), (10.0, "INCLUDES_FIBRE"), (10.0, "MONOSACCHARIDE_EQUIVALENT"), (10.0, None)]
    assert values(spark, nutrition.meal_for_hour(F.col("h")), [(10,), (11,), (15,), (20,), (21,)], "h int") == ["breakfast", "lunch", "snack", "dinner", "snack"]
    u = values(spark, nutrition.unit_from_entry(F.col("l"), F.col("a"), F.col("g")), [("oz", 1.0, 28.0), ("slice", 2.0, 60.0), ("slice", 0.0, 60.0)], "l string, a double, g double")
    assert [(x.unit, x.grams) for x in u] == [("oz", None), ("portion", 30.0), ("g", None)]


def test_folding_of_every_latin_letter(spark):
    import unicodedata

    letters = [chr(c) for c in range(0x20, 0x250)] + ["ẞ", "Ñandú", "Œuf à l'ØRE", "ŁÓDŹ", "e\u0301", "ﬁn", "½", "Ωμέγα", ""]
    for got, x in zip(values(spark, text.fold_name(F.col("x")), letters), letters, strict=True):
        bare = "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").lower()
        assert got == "".join(text.WHOLE_LETTERS.get(c, c) for c in bare), x
