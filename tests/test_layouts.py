"""Loaders of wide tables on files with the publishers' headers, results worked out by hand."""

import pytest

from platewise.operators.tables import ContractError
from platewise.sources import national


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/{name}"


def load(spark, path, spec):
    return {r.key: r for r in national.load_wide(spark, path, spec).collect()}


def names(food):
    return [(a.lang, a.name) for a in food.aliases]


GERMAN = '"BLS Code","Lebensmittelbezeichnung","Food name","ENERCJ Energie (Kilojoule) [kJ/100g]","ENERCC Energie (Kilokalorien) [kcal/100g]","PROT625 Protein [g/100g]","FAT Fett [g/100g]","CHO Kohlenhydrate [g/100g]","FIBT Ballaststoffe [g/100g]","SUGAR Zucker [g/100g]","FASAT Fettsaeuren [g/100g]","NA Natrium [mg/100g]"'


def test_german(spark, tmp_path):
    rows = [
        'C131000,Hafer,Oats,1500,"360,5",13,7,58,TR,<LOD,-,8',
        f"C131001,Weizen,{'long ' * 30},1500,350,12,2,68,<LOQ,1,1,10",
        "C131002,Nichts,Nothing,0,-,1,1,1,1,1,1,1",
        "C13-1,Strich,Dash,1500,350,12,2,68,1,1,1,1",
    ]
    got = load(spark, write(tmp_path, "bls.csv", "\n".join([GERMAN, *rows]) + "\n"), national.BLS)
    oats, wheat = got["C131000"], got["C131001"]
    assert (oats.id, oats.name, oats.kcal, oats.protein, oats.fibre, oats.sugar, oats.saturated, oats.sodium) == (300_000_000 + int("C131000", 36), "Oats", 360.5, 13.0, 0.0, None, None, 0.008)
    assert names(oats) == [("de", "Hafer")] and oats.reject_reason is None and oats.carbs_convention == "available"
    assert (wheat.name, names(wheat), wheat.fibre) == ("Weizen", [], None)  # no usable English name: the German one, and no alias of it
    assert got["C131002"].reject_reason == "no energy"
    with pytest.raises(ContractError):
        load(spark, write(tmp_path, "none.csv", "BLS Code,Food name\n1,2\n"), national.BLS)


def test_danish(spark, tmp_path):
    path = write(tmp_path, "frida.csv", "FoodID,FoodName,FodevareNavn,KCAL,PROTEIN,FAT,SAT_FAT,CARBS,FIBRE,SUGAR,SODIUM\n7,Milk,Mælk,46,3.5,1.5,1,4.8,0,4.8,43\nx,Odd,Sær,46,3.5,1.5,1,4.8,0,4.8,43\n8,,Tom,46,3.5,1.5,1,4.8,0,4.8,43\n")
    got = load(spark, path, national.FRIDA)
    assert (got["7"].id, got["7"].sodium, got["7"].saturated, names(got["7"])) == (150_000_000_007, 0.043, 1.0, [("da", "Mælk")])
    assert (got["x"].reject_reason, got["8"].reject_reason) == ("non-standard key", "unusable name")


def test_swiss(spark, tmp_path):
    path = write(tmp_path, "swiss.csv", "ID,NAME,NAME_DE,NAME_FR,NAME_IT,KCAL,FAT,SAT_FAT,CARBS,SUGAR,FIBER,PROTEIN,SODIUM\n1,Polenta,Polenta,Polenta fr,,350,tr.,0,75,<1.0,n.d.,8,2\n")
    polenta = load(spark, path, national.SWISS)["1"]
    assert (polenta.id, polenta.fat, polenta.sugar, polenta.fibre, polenta.sodium, names(polenta)) == (160_000_000_001, 0.0, 0.5, None, 0.002, [("fr", "Polenta fr")])


def test_portuguese(spark, tmp_path):
    path = write(tmp_path, "tca.csv", "COD,NOME,NIVEL1,KCAL,FAT,SAT_FAT,CARBS,SUGAR,FIBER,PROTEIN,SODIUM\n5,Maçã,Frutos,64,0.5,0.1,13.4,13.4,2.1,0.2,6\n6,Vinho,Bebidas alcoólicas,70,0,0,1,1,0,0.1,5\n")
    got = load(spark, path, national.TCA)
    assert (got["5"].id, got["5"].lang, names(got["5"]), got["5"].reject_reason) == (170_000_000_005, "pt", [], None)
    assert got["6"].reject_reason == "food group not per 100 g"


def test_australian(spark, tmp_path):
    path = write(tmp_path, "afcd.csv", "Public Food Key,Food Name,E_KJ,PROTEIN,FAT,AVAIL_CHO,FIBRE,SUGAR,SATFAT,SODIUM\nF000001,Rice,418.4,2,0,22,,,,1\nX1,Bad,418.4,2,0,22,,,,1\n")
    got = load(spark, path, national.AFCD)
    assert got["F000001"].kcal == pytest.approx(100) and (got["F000001"].id, got["F000001"].sodium) == (190_000_000_001, 0.001) and got["X1"].reject_reason == "non-standard key"


def test_norwegian_sugar(spark, tmp_path):
    import json

    parts = [{"nutrientId": n, "quantity": q, "unit": u} for n, q, u in (("Protein", 3.4, "g"), ("Fett", 3.5, "g"), ("Karbo", 4.6, "g"), ("Sukker", 0.5, "g"), ("Mono+Di", 4.6, "g"), ("Na", 40, "mg"))]
    food = {"foodId": "01.001", "calories": {"quantity": 63}, "constituents": parts}
    en, nb = (write(tmp_path, f"{x}.json", json.dumps({"foods": [{**food, "foodName": n}]})) for x, n in (("en", "Milk"), ("nb", "Melk")))
    assert national.load_matvaretabellen(spark, en, nb).first().sugar == 0.5
