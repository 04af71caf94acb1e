"""Columns of the diary and of targets: quantities, scaling, energy needs, body units, meals, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .foods import atwater_ok, atwater_predicted

GRAMS_PER_OUNCE = 28.349523125
KG_PER_POUND, CM_PER_INCH, KJ_PER_KCAL = 0.45359237, 2.54, 4.184
#: Activity factors.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "very_active": 1.9}


def finite(c: Column) -> Column:
    """Whether a number is usable: finite and not negative."""
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves up."""
    return F.floor(c + 0.5).cast("double")


def tenth(c: Column) -> Column:
    """Rounded to a tenth, halves up."""
    return F.floor(c * 10 + 0.5) / 10


def display_carbs(carbs: Column, fibre: Column, convention: Column) -> Column:
    """``struct(value, label)`` of available carbohydrate by the source's convention."""
    difference = convention == "by_difference"
    value = F.when(difference & fibre.isNotNull(), F.greatest(carbs - fibre, F.lit(0.0))).otherwise(carbs)
    label = F.when(difference & fibre.isNull(), "INCLUDES_FIBRE").when(convention == "available_monosaccharide", "MONOSACCHARIDE_EQUIVALENT")
    return F.struct(value.alias("value"), label.alias("label"))


def resolve_quantity(amount: Column, unit: Column, basis: Column, density: Column, portion_grams: Column) -> Column:
    """``struct(grams, basis_amount)`` of an amount in g, oz, ml or portions; both null where it can't be known.

    Water's density is never assumed. Millilitres of a food stated by volume need none, and may have no grams.
    """
    dense = F.when((density > 0) & (density < float("inf")), density)
    each = F.when((portion_grams > 0) & (portion_grams < float("inf")), portion_grams)
    grams = F.when(unit == "g", amount).when(unit == "oz", amount * GRAMS_PER_OUNCE).when(unit == "ml", amount * dense).when(unit == "portion", amount * each)
    grams = F.when(finite(amount) & finite(grams), grams)
    by = F.when(basis == "ml", F.when(unit == "ml", amount).otherwise(grams / dense)).otherwise(grams)
    by = F.when(finite(amount) & finite(by), by)
    return F.struct(F.when(by.isNotNull(), grams).alias("grams"), by.alias("basis_amount"))


def scale_figure(per_100: Column, amount: Column) -> Column:
    """A figure per 100 for an amount of the same basis; null for an unusable amount."""
    return F.when(finite(amount), per_100 * amount / 100)


def scale_nutrients(nutrients: Column, amount: Column) -> Column:
    """All figures and bounds of a nutrient map for an amount; an amount of 0 closes the bounds."""
    k = amount / 100

    def scaled(_: Column, v: Column) -> Column:
        out = v
        for f in ("value", "lower", "upper"):
            out = out.withField(f, v[f] * k)
        return out.withField("lower_inclusive", v["lower_inclusive"] | (k == 0)).withField("upper_inclusive", v["upper_inclusive"] | (k == 0))

    return F.when(finite(amount), F.transform_values(nutrients, scaled))


def rescale(value: Column, old: Column, new: Column) -> Column:
    """A stored figure after its amount was corrected; null where either amount is unusable or was 0."""
    return F.when(finite(new) & finite(old) & (old > 0), value * new / old)


def reported(v: Column) -> Column:
    """The figure that counts: an undecidable one has no value unless it is a sum with gaps."""
    return F.when(~(F.array_contains(v["qualifiers"], "UNDECIDABLE") & ~v["incomplete"]), v["value"])


def is_incomplete(v: Column) -> Column:
    """Whether something is missing from a figure."""
    return v["incomplete"] | reported(v).isNull()


def is_qualified(v: Column) -> Column:
    """Whether a figure has a qualifier besides a logical zero."""
    return F.exists(v["qualifiers"], lambda q: q != "LOGICAL_ZERO")


def is_trace(v: Column) -> Column:
    """Whether a figure of 0 stands for a trace."""
    marks = F.array(*[F.lit(x) for x in ("TRACE", "BELOW_DETECTION", "BELOW_QUANTIFICATION", "BELOW_DETECTION_OR_QUANTIFICATION")])
    return F.coalesce(F.arrays_overlap(v["qualifiers"], marks) & (reported(v) == 0), F.lit(False))


def age_on(birth: Column, day: Column) -> Column:
    """Whole years by the calendar, null outside 0 to 130."""
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    years = F.year(day) - F.year(birth) - F.when(before, 1).otherwise(0)
    return F.when(years.between(0, 130), years)


def bmr(sex: Column, weight: Column, height: Column, age: Column, body_fat: Column) -> Column:
    """Resting energy: by lean mass where body fat is known, else by sex, weight, height and age; null outside the limits."""
    fat = F.when(finite(body_fat) & body_fat.between(3, 70), 370 + 21.6 * (weight * (1 - body_fat / 100)))
    shift = F.when(sex == "male", 5.0).when(sex == "female", -161.0).when(sex == "unspecified", -78.0)
    plain = F.when(finite(height) & height.between(50, 280), 10 * weight + 6.25 * height - 5 * age + shift)
    return F.when(finite(weight) & weight.between(10, 650), F.when(body_fat.isNotNull(), fat).otherwise(plain))


def activity_factor(level: Column) -> Column:
    """The factor of an activity level, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIVITY.items() for x in kv]), level)


def calorie_target(resting: Column, factor: Column, weight: Column, sex: Column, direction: Column, rate: Column) -> Column:
    """Daily energy for a wanted change of weight, never below resting energy or the floor of 1200 (women) or 1500 kcal."""
    wanted = F.coalesce(rate, F.lit(0.0))
    change = F.least(F.greatest(wanted, F.lit(0.0)), F.least(F.lit(1.0), weight * 0.01)) * 7700 / 7
    tdee = resting * factor
    target = F.when(direction == "lose", tdee - change).when(direction == "gain", tdee + change).otherwise(tdee)
    return F.when(finite(wanted) & resting.isNotNull() & factor.isNotNull(), half_up(F.greatest(target, resting, F.when(sex == "female", 1200.0).otherwise(1500.0))))


def split_macros(kcal: Column, weight: Column, direction: Column) -> Column:
    """``struct(protein, fat, carbs)``: fat 28 % of energy, protein by weight as far as 50 g of carbohydrate allow, the rest carbohydrate."""
    each = F.when(direction == "lose", 2.0).when(direction == "gain", 1.8).otherwise(1.6)
    fat = half_up(kcal * 0.28 / 9)
    room = F.floor(F.greatest((kcal - fat * 9 - 200) / 4, F.lit(0.0))).cast("double")
    protein = F.least(half_up(weight * each), room)
    carbs = half_up(F.greatest((kcal - protein * 4 - fat * 9) / 4, F.lit(0.0)))
    return F.struct(protein.alias("protein"), fat.alias("fat"), carbs.alias("carbs"))


def warn_floor(resting: Column, sex: Column) -> Column:
    """Below this a target is warned of: resting energy, or 1500 for men and 1200 for others where it is unknown."""
    return half_up(F.coalesce(resting, F.when(sex == "male", 1500.0).otherwise(1200.0)))


def kg_to_lb(kg: Column) -> Column:
    """Pounds to a tenth."""
    return tenth(kg / KG_PER_POUND)


def kg_to_stone(kg: Column) -> Column:
    """``struct(stone, pounds)``: pounds are rounded first, and 14 carry."""
    pounds = kg / KG_PER_POUND
    stone = F.floor(pounds / 14)
    rest = tenth(pounds - stone * 14)
    return F.struct((stone + F.when(rest >= 14, 1).otherwise(0)).cast("int").alias("stone"), F.when(rest >= 14, rest - 14).otherwise(rest).alias("pounds"))


def cm_to_feet(cm: Column) -> Column:
    """``struct(feet, inches)``: inches are rounded to a tenth first, and 12 carry."""
    inches = cm / CM_PER_INCH
    feet = F.floor(inches / 12)
    rest = tenth(inches - feet * 12)
    return F.struct((feet + F.when(rest >= 12, 1).otherwise(0)).cast("int").alias("feet"), F.when(rest >= 12, rest - 12).otherwise(rest).alias("inches"))


def kcal_to_kj(kcal: Column) -> Column:
    """Kilojoules."""
    return kcal * KJ_PER_KCAL


def meal_for_hour(hour: Column) -> Column:
    """The meal at an hour of the day."""
    return F.when(hour < 11, "breakfast").when(hour < 15, "lunch").when(hour < 17, "snack").when(hour < 21, "dinner").otherwise("snack")


def meal_from_code(code: Column) -> Column:
    """The meal of a stored code; unknown codes are snacks."""
    return F.when(code == 1, "breakfast").when(code == 2, "lunch").when(code == 3, "dinner").otherwise("snack")


def remaining(target: Column, consumed: Column) -> Column:
    """What is left of a target, below 0 if over, rounded half up at the end."""
    return half_up(target - consumed)


def progress(target: Column, consumed: Column) -> Column:
    """Share of a target from 0 to 1; 0 without a target above 0."""
    return F.when(target > 0, F.least(F.greatest(consumed / target, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def entry_flags(kcal: Column, protein: Column, fat: Column, carbs: Column) -> Column:
    """``struct(flags, suggested_kcal)``: implausible amounts, and energy that the macros don't give."""
    over = (kcal > 5000) | (protein > 1000) | (fat > 1000) | (carbs > 1000)
    some = (protein > 0) | (fat > 0) | (carbs > 0)
    odd = (kcal > 0) & some & ~atwater_ok(kcal, protein, fat, carbs)
    return F.struct(F.array_compact(F.array(F.when(over, "implausible"), F.when(odd, "inconsistent"))).alias("flags"), F.when(odd, F.floor(atwater_predicted(protein, fat, carbs))).alias("suggested_kcal"))


def resolve_target(typed: Column, inherited: Column) -> Column:
    """A typed target: blank keeps the inherited one, unusable text gives null. ``typed`` is what :func:`parse_number` gives."""
    return F.when(typed["status"] == "empty", inherited).otherwise(typed["value"])


def food_ref(kind: Column, id_: Column) -> Column:
    """``struct(kind, id)`` of a reference: unknown kinds and missing ids are quick entries."""
    known = kind.isin("bundled", "custom") & id_.isNotNull()
    return F.struct(F.when(known, kind).otherwise("quick").alias("kind"), F.when(known, id_).alias("id"))


def languages(stored: Column, app: Column, served: Column) -> Column:
    """A reader's languages in order: the stored list and English; else the app's if the table has it, then the table's, English."""
    own = F.when(F.array_contains(served, app), F.array(app)).otherwise(F.array().cast("array<string>"))
    chosen = F.when(F.size(stored) > 0, stored).when(F.size(served) > 0, F.concat(own, served)).otherwise(F.array(app))
    return F.array_distinct(F.concat(chosen, F.array(F.lit("en"))))


def unit_from_label(label: Column, servings: Column) -> Column:
    """``struct(unit, grams)`` of a stored unit label: a known unit, else a serving of that label, else grams."""
    low = F.lower(F.trim(label))
    hit = F.get(F.filter(servings, lambda s: F.lower(F.trim(s["label"])) == low), F.lit(0))
    return F.struct(F.when(low.isin("g", "oz", "ml"), low).when(hit.isNotNull(), "portion").otherwise("g").alias("unit"), F.when(~low.isin("g", "oz", "ml"), hit["grams"]).alias("grams"))


def unit_from_entry(label: Column, amount: Column, grams: Column) -> Column:
    """``struct(unit, grams)`` of an entry whose food is gone: a portion weighs its grams by its amount."""
    low = F.lower(F.trim(label))
    each = F.when((amount > 0) & finite(grams), grams / amount)
    return F.struct(F.when(low.isin("g", "oz", "ml"), low).when(each > 0, "portion").otherwise("g").alias("unit"), F.when(~low.isin("g", "oz", "ml") & (each > 0), each).alias("grams"))


def available_units(basis: Column, density: Column, servings: Column) -> Column:
    """Labels offered for a food: its servings, the first of each label, then grams and ounces, millilitres where known."""
    low = F.transform(servings, lambda s: F.lower(F.trim(s["label"])))
    volume = F.when((basis == "ml") | (density > 0), F.array(F.lit("ml"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(low, F.array(F.lit("g"), F.lit("oz")), volume))
