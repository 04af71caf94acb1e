"""Figures as sources print them: tolerant numbers, missing and trace marks, units, and the strict nutrient grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are read; anything else (``1.0f``, ``NaN``, ``1_0``) is no number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Marks of each source for a trace, and for a missing figure.
DIALECTS = {
    "plain": ((), ()),
    "german": (("TR",), ("-", "<LOD", "<LOQ")),
    "uk": (("Tr",), ("N",)),
    "swiss": (("tr.",), ("n.d.",)),
}
KJ_PER_KCAL = 4.184


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def plain_number(c: Column) -> Column:
    """A decimal with comma or dot, else null; infinite values are null."""
    dotted = F.replace(c, F.lit(","), F.lit("."))
    v = F.when(dotted.rlike(NUMBER), dotted).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def to_float(c: Column) -> Column:
    """Blank and ``-`` are null, trace words 0, ``< x`` half of x, decimal commas accepted."""
    s = trimmed(c)
    limit = F.regexp_extract(s, r"^<\s*([0-9.,]+)$", 1)
    return F.when((s == "") | (s == "-"), F.lit(None).cast("double")).when(F.lower(s).isin("traces", "trace"), 0.0).when(limit != "", plain_number(limit) / 2).otherwise(plain_number(s))


def parse_cell(c: Column, dialect: str = "plain") -> Column:
    """:func:`to_float` after the source's own marks; in the UK form a figure in parentheses is an estimate and counts."""
    trace, missing = DIALECTS[dialect]
    s = trimmed(c)
    if dialect == "uk":
        s = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    return F.when(s.isin(*trace), 0.0).when(s.isin(*missing), F.lit(None).cast("double")).otherwise(to_float(s)) if trace or missing else to_float(s)


def to_canonical_unit(value: Column, unit: Column, basis: Column, code: Column) -> Column:
    """Per 100 g in kcal or g: basis W is per 100 g; WKG (per kg) only for sodium, in mg; other bases have no value."""
    sodium = F.when(basis == "WKG", value / 10000).when(basis == "W", value / 1000)
    energy = F.when(unit == "kJ", value / KJ_PER_KCAL).otherwise(value)
    other = F.when(unit == "mg", value / 1000).otherwise(value)
    return F.when(code == "NA", sodium).when(basis == "W", F.when(code == "ENERC", energy).otherwise(other))


def parse_number(c: Column) -> Column:
    """What a person typed: ``struct(value, status)``, status empty, ok or unusable.

    One comma or dot may stand in it; negative numbers, several separators and letters are unusable.
    """
    s = trimmed(c)
    v = F.when(s.rlike(r"^([0-9]+[.,]?[0-9]*|[.,][0-9]+)$"), plain_number(s))
    status = F.when(s.isNull() | (s == ""), "empty").when(v.isNull(), "unusable").otherwise("ok")
    return F.struct(v.alias("value"), status.alias("status"))


def is_implausible(typed: Column, most: float) -> Column:
    """Whether a typed figure (of :func:`parse_number`) is above what is taken without a question; false if it is no number."""
    return F.coalesce(typed["value"] > most, F.lit(False))


def is_below(typed: Column, least: float) -> Column:
    """Whether a typed figure is below a bound; false if it is no number."""
    return F.coalesce(typed["value"] < least, F.lit(False))


#: Type letters of a figure and what they say.
VALUE_KINDS = ("TRACE", "BELOW_DETECTION", "BELOW_QUANTIFICATION", "BELOW_DETECTION_OR_QUANTIFICATION", "LOGICAL_ZERO", "UNDECIDABLE", "UNSPECIFIED", "BOUNDED", "BEST_ESTIMATE", "AVERAGE", "WEIGHTED")


def parse_nutrient(raw: Column, unit: Column, nutrient: Column, kind: Column) -> Column:
    """The strict grammar: a number, maybe after ``<``, ``>``, ``<=`` or ``>=``, or ``tr``/``trace``, or nothing.

    ``struct(value, lower, upper, lower_inclusive, upper_inclusive, qualifiers, source_value, source_unit, error)``: energy
    in kcal, others in g or mg (scaled to g). ``kind`` is a qualifier or null. A bound given stays a bound, never an
    estimate of half. ``error`` names what is wrong, and the rest is then null.
    """
    text = trimmed(F.coalesce(raw, F.lit("")))
    trace = F.lower(text).isin("tr", "trace")
    mark = F.regexp_extract(text, r"^([<>]=?)", 1)
    digits = trimmed(F.regexp_extract(text, r"(?s)^(?:[<>]=?)?(.*)$", 1))
    good = digits.rlike(r"^([0-9]+([.,][0-9]+)?|[.,][0-9]+)$")
    scale = F.when((nutrient == "CALORIES") & (unit == "kcal"), 1.0).when((nutrient != "CALORIES") & (unit == "g"), 1.0).when((nutrient != "CALORIES") & (unit == "mg"), 0.001)
    value = F.when(~trace & good, plain_number(digits) * scale)
    error = F.when(scale.isNull(), "wrong unit").when((text != "") & ~trace & ~good, "malformed figure").when(~F.coalesce(kind, F.lit("TRACE")).isin(*VALUE_KINDS), "unknown kind").when((kind == "LOGICAL_ZERO") & ~F.coalesce(value == 0, F.lit(False)), "logical zero isn't zero")
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.array(kind, F.when(trace, "TRACE"), F.when((mark != "") & good, "BOUNDED")))))
    ok = error.isNull()
    return F.struct(
        F.when(ok, value).alias("value"), F.when(ok & mark.startswith(">"), value).alias("lower"), F.when(ok & mark.startswith("<"), value).alias("upper"),
        F.when(ok, mark != ">").alias("lower_inclusive"), F.when(ok, mark != "<").alias("upper_inclusive"), F.when(ok, kinds).alias("qualifiers"),
        raw.alias("source_value"), unit.alias("source_unit"), error.alias("error"),
    )


def nutrient_violations(v: Column) -> Column:
    """Reasons why a nutrient struct (as :func:`parse_nutrient` makes) is not valid; empty if it is."""

    def bad(x: Column) -> Column:
        return x.isNotNull() & ((x < 0) | F.isnan(x) | (F.abs(x) == float("inf")))

    checks = [
        (bad(v["value"]) | bad(v["lower"]) | bad(v["upper"]), "negative or not finite"),
        (F.exists(v["qualifiers"], lambda q: ~q.isin(*VALUE_KINDS)), "unknown qualifier"),
        (F.size(F.array_distinct(v["qualifiers"])) < F.size(v["qualifiers"]), "repeated qualifier"),
        (v["lower"] > v["upper"], "bounds cross"),
        (~v["lower_inclusive"] & v["lower"].isNull(), "open lower end without a bound"),
        (~v["upper_inclusive"] & v["upper"].isNull(), "open upper end without a bound"),
        (F.array_contains(v["qualifiers"], "LOGICAL_ZERO") & ~F.coalesce(v["value"] == 0, F.lit(False)), "logical zero isn't zero"),
    ]
    return F.array_compact(F.array(*[F.when(c, r) for c, r in checks]))


NUTRIENT_MAP = "map<string,struct<value:double,qualifiers:array<string>,incomplete:boolean,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean,dataset:string>>"


def encode_nutrients(m: Column) -> Column:
    """A nutrient map as versioned JSON; null for an empty map."""
    return F.when(F.size(m) > 0, F.to_json(F.struct(F.lit(1).alias("version"), m.alias("nutrients"))))


def decode_nutrients(text: Column) -> Column:
    """``struct(nutrients, error)``: an absent version is 1, another is an error; null text is an empty map."""
    read = F.from_json(text, f"struct<version:int,nutrients:{NUTRIENT_MAP}>")
    fine = F.coalesce(read["version"], F.lit(1)) == 1
    empty = F.create_map().cast(NUTRIENT_MAP)
    return F.struct(F.when(text.isNull(), empty).when(fine, read["nutrients"]).alias("nutrients"), F.when(text.isNotNull() & (read["nutrients"].isNull() & fine), "malformed").when(~fine, "unknown version").alias("error"))
