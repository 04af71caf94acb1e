"""The Dutch and New Zealand sets: files in, records out; each defect refuses the source; stored rows are held against the files."""

import pytest
from pyspark.sql import functions as F

from platewise.operators.catalogue import children
from platewise.operators.tables import ContractError
from platewise.sources import common, reviewed

HEAD = [reviewed.RELEASE, reviewed.KEY, reviewed.NL, reviewed.EN, reviewed.SYNONYM, reviewed.BASIS, reviewed.TRACE, reviewed.FORTIFIED, *[f"{c} ({u})" for c, (_, u, _) in reviewed.DUTCH.items()]]
FIGURES = ["60", "3,4", "3.5", "4,6", "", "4.5", "2.3", "40"]


def dutch_files(tmp_path, *, row=None, second=None, details=None, units=None, version=reviewed.DUTCH_VERSION):
    wide = [version, "5", "Melk", "Milk", "Koemelk/melk", "per 100ml", "FASAT", "NA", *FIGURES]
    for k, v in (row or {}).items():
        wide[HEAD.index(k)] = v
    rows = [wide, *([second] if second else [])]
    units = units or {**{c: u for c, (_, u, _) in reviewed.DUTCH.items()}, "VITC": "mg"}
    lines = []
    for r in rows:
        for c, (_, u, _) in reviewed.DUTCH.items():
            raw = r[HEAD.index(f"{c} ({u})")]
            flag = "TR" if c in r[HEAD.index(reviewed.TRACE)] else "+" if c in r[HEAD.index(reviewed.FORTIFIED)] else ""
            if raw:
                lines += [[r[0], r[1], r[2], r[3], r[5], c, raw, u, flag, s, f"ref {s}"] for s in ("b", "a")]
    lines = details(lines) if details else lines
    head = [reviewed.RELEASE, reviewed.KEY, reviewed.NL, reviewed.EN, reviewed.BASIS, reviewed.CODE, reviewed.VALUE, reviewed.UNIT, reviewed.FLAG, reviewed.SOURCE_CODE, reviewed.REFERENCE]
    for name, table in (("wide", [HEAD, *rows]), ("definitions", [[reviewed.CODE, reviewed.UNIT], *units.items()]), ("details", [head, *lines])):
        (tmp_path / name).write_text("﻿" + "\n".join("|".join(f'"{c}"' if "|" in c else c for c in r) for r in table) + "\n", encoding="utf-8")
    return [f"file://{tmp_path}/{n}" for n in ("wide", "definitions", "details")]


def test_dutch_records(spark, tmp_path):
    tables = reviewed.dutch_tables(spark, *dutch_files(tmp_path))
    out = reviewed.load_dutch(tables)
    f = out["foods"].first()
    assert (f.id, f.name, f.lang, f.country, f.basis, f.density, f.sodium, f.fibre, f.protein) == (200_000_000_005, "Melk", "nl", "NL", "ml", None, 0.04, None, 3.4)
    assert [(a.lang, a.name) for a in f.aliases] == [("en", "Milk"), ("nl", "Koemelk/melk")] and f.servings == []
    assert [c.split()[0] for c in common.FOOD_SCHEMA.split(", ")] == out["foods"].columns
    by = {r.code: r for r in out["figures"].collect()}
    assert by["FASAT"].figure.qualifiers == ["TRACE"] and by["NA"].figure.qualifiers == [] and by["PROT"].figure.source_value == "3,4"
    assert [(r.code, r.reference) for r in by["FAT"].origin.references] == [("a", "ref a"), ("b", "ref b")] and by["FIBT"].origin.references == []
    stored = {**children(out["foods"]), "foods": out["foods"], "figures": out["figures"]}
    assert reviewed.reconcile_dutch(tables, stored).count() == 0
    broken = {**stored, "foods": out["foods"].withColumn("kcal", F.lit(61.0)).withColumn("density", F.lit(1.0)), "aliases": stored["aliases"].filter("lang <> 'nl'")}
    assert sorted(r.reason for r in reviewed.reconcile_dutch(tables, broken).collect()) == ["alias: missing", "column: value", "food: density"]
    figures = out["figures"].withColumn("figure", F.col("figure").withField("source_value", F.lit("1"))).filter("code <> 'FAT'")
    assert sorted({r.reason for r in reviewed.reconcile_dutch(tables, {**stored, "figures": figures}).collect()}) == ["figure: missing", "figure: notation"]


REFUSED = {
    "release": {"version": "NEVO-Online 2023 8.0"},
    "basis": {"row": {reviewed.BASIS: "per stuk"}},
    "id": {"row": {reviewed.KEY: "05"}},
    "name": {"row": {reviewed.EN: " "}},
    "overlap": {"row": {reviewed.FORTIFIED: "FASAT"}},
    "annotation": {"row": {reviewed.TRACE: "NOPE"}},
    "grammar": {"row": {"PROT (g)": "1.2.3"}},
    "range": {"row": {"FAT (g)": "101"}},
    "part": {"row": {"SUGAR (g)": "7"}},
    "primary": {"row": {"CHO (g)": ""}},
    "unit": {"units": {**{c: u for c, (_, u, _) in reviewed.DUTCH.items()}, "NA": "g"}},
    "repeat": {"second": [reviewed.DUTCH_VERSION, "5", "Melk", "Milk", "", "per 100g", "", "", *FIGURES]},
    "details differ": {"details": lambda d: [*d[:3], [*d[3][:6], "9", *d[3][7:]], *d[4:]]},
    "details missing": {"details": lambda d: [x for x in d if x[5] != "FAT"]},
    "unknown food": {"details": lambda d: [*d, ["", "77", *d[0][2:]]]},
    "unknown nutrient": {"details": lambda d: [*d, [*d[0][:5], "ZZ", *d[0][6:]]]},
    "cells": {"details": lambda d: [*d, ["x", "y"]]},
}


@pytest.mark.parametrize("why", sorted(REFUSED))
def test_dutch_defects_refuse_the_source(spark, tmp_path, why):
    with pytest.raises(ContractError):
        reviewed.load_dutch(reviewed.dutch_tables(spark, *dutch_files(tmp_path, **REFUSED[why])))


LICENCE = "© Copyright The Institute, 2024."
DATA = {"ENERC_FSANZ2_KCAL": ("60", ""), "PROT": ("3.4", "AV"), "FAT": ("3.5", ""), "CHOAVL_FSANZ": ("4.6", ""), "SUGAR": ("4.5", ""), "FASAT": ("2.3", "BE"), "NA": ("40", "")}


def zealand_files(tmp_path, *, names=None, portions=None, data=None, codes=None, licence=LICENCE):
    names = names or [["A5", "Milk, whole", "Milk", "Full milk"], ["M1144", "Extra", "Extra", "", "more"], ["M1148", "Cheese", "Milk", ""]]
    portions = [["A5", "Milk, whole", "1 cup", "258", "1.03"], ["A5", "Milk, whole", "1 tbsp", "15.5", "1.03"], ["M1148", "Cheese", "1 cup (250 mL) diced ", "200", "0.8"], ["M1148", "Cheese", "1 cup (250 mL) diced ", "215", "0.86"]] if portions is None else portions
    rows = [[n[0], c, v, reviewed.ZEALAND[c][1], "W", t, "s", "a", "m", "i"] for n in names for c, (v, t) in DATA.items()]
    rows = data(rows) if data else rows
    codes = codes or [[c, u, "W"] for c, (_, u, _) in reviewed.ZEALAND.items()]
    heads = {"Names": ["FoodID", "Food Name", "Short Food Name", "AlternativeNames"], "Csm": ["FoodID", "Food Name", "CSM", "Measure", "Density (g/cm3)"], "StandardCodes": ["Code", "Unit Code", "Matrix Unit Code"], "Data": ["FoodID", "Component Identifier", "Value", "Unit Code", "Matrix Unit Code", "Value Type Code", *reviewed.PROVENANCE]}
    for name, table in (("Names", names), ("Csm", portions), ("StandardCodes", codes), ("Data", rows)):
        (tmp_path / name).write_text("\n".join([licence, *("~".join(r) for r in [heads[name], *table])]) + "\n", encoding="utf-8")
    return f"file://{tmp_path}"


def test_zealand_records(spark, tmp_path):
    tables = reviewed.zealand_tables(spark, zealand_files(tmp_path), "Data")
    out = reviewed.load_zealand(tables)
    by = {r.key: r for r in out["foods"].collect()}
    milk, cheese = by["A5"], by["M1148"]
    assert (milk.id, milk.density, milk.fibre, milk.sodium, cheese.id, cheese.density) == (210_000_000_005, 1.03, None, 0.04, 210_000_000_000 + 12 * 100_000_000 + 1148, None)
    assert [(a.lang, a.name) for a in milk.aliases] == [("en", "Milk\nFull milk")] and [(s.label, s.grams) for s in milk.servings] == [("1 cup", 258.0), ("1 tbsp", 15.5)]
    assert [(s.label, s.grams) for s in cheese.servings] == [("1 cup (250 mL) diced ", 215.0)] and [r.grams for r in out["omitted"].collect()] == [200.0]
    stored = {**children(out["foods"]), "foods": out["foods"], "figures": out["figures"]}
    assert reviewed.reconcile_zealand(tables, stored).count() == 0
    broken = {**stored, "servings": stored["servings"].filter("label <> '1 cup'"), "foods": out["foods"].filter("key <> 'M1144'")}
    assert {r.reason for r in reviewed.reconcile_zealand(tables, broken).collect()} == {"portion: missing", "food: missing", "column: missing"}


def test_zealand_reviewed_foods(spark, tmp_path):
    names = [["A5", "Milk", "", ""], ["C59", "Sweet", "", ""], ["P24", "Spice", "", ""]]

    def data(rows):
        return [[*r[:2], "101", *r[3:]] if r[0] == "C59" and r[1] in ("CHOAVL_FSANZ", "SUGAR") else r for r in rows]

    portions = [["P24", "Spice", "1 teaspoon (5 mL)", "0.6", ""]]
    out = reviewed.load_zealand(reviewed.zealand_tables(spark, zealand_files(tmp_path, names=names, data=data, portions=portions), "Data"))
    assert sorted(r.key for r in out["foods"].collect()) == ["A5", "P24"] and [r.key for r in out["quarantined"].collect()] == ["C59"]
    assert [(r.key, r.why) for r in out["omitted"].collect()] == [("P24", "tiny portion hidden")]
    with pytest.raises(ContractError):  # its figures are not those that were reviewed
        reviewed.load_zealand(reviewed.zealand_tables(spark, zealand_files(tmp_path, names=names, portions=[]), "Data"))


WRONG = {
    "licence": {"licence": "© Copyright The Institute, 2023."},
    "id": {"names": [["a5", "Milk", "", ""]], "portions": []},
    "cells": {"names": [["A5", "Milk", "", "", "x"]], "portions": []},
    "unit": {"codes": [[c, u, "L" if c == "NA" else "W"] for c, (_, u, _) in reviewed.ZEALAND.items()]},
    "repeat": {"data": lambda r: [*r, r[0]]},
    "missing": {"data": lambda r: [x for x in r if x[1] != "FASAT"]},
    "kind": {"data": lambda r: [[*r[0][:5], "??", *r[0][6:]], *r[1:]]},
    "logical zero": {"data": lambda r: [[*r[0][:5], "LZ", *r[0][6:]], *r[1:]]},
    "other food": {"portions": [["A5", "Melk", "1 cup", "258", ""]]},
    "weight": {"portions": [["A5", "Milk, whole", "1 cup", "-1", ""]]},
    "ambiguous": {"portions": [["A5", "Milk, whole", "1 cup", "258", ""], ["A5", "Milk, whole", "1 cup", "250", ""]]},
    "range": {"portions": [["A5", "Milk, whole", "1 drop", "0.1", ""]]},
}


@pytest.mark.parametrize("why", sorted(WRONG))
def test_zealand_defects_refuse_the_source(spark, tmp_path, why):
    with pytest.raises(ContractError):
        reviewed.load_zealand(reviewed.zealand_tables(spark, zealand_files(tmp_path, **WRONG[why]), "Data"))
