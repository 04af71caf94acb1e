"""Diary analytics for many users at once: totals, goals as of a day, gap-filled histories, nutrient algebra, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nutrition as N
from ..functions.text import csv_escape

DEFAULT_GOAL = (2000.0, 150.0, 65.0, 250.0)


def asof_join(days: DataFrame, versions: DataFrame, *, by: str, on: str, start: str, value: str) -> DataFrame:
    """Add ``value`` of the version in force on each day: the latest that starts on or before it, null if none.

    Both tables meet in one union that is put in order within each key; the last version seen is carried forward. One
    shuffle, and no pair of day and version is ever made. Of versions that start together the greatest value counts.
    """
    v = versions.groupBy(by, F.col(start).alias("__at")).agg(F.max(F.col(value)).alias("__v")).select(by, "__at", F.lit(0).alias("__kind"), F.struct(F.col("__v").alias("v")).alias("__v"), F.lit(None).cast(days.select(F.struct(*days.columns)).schema[0].dataType).alias("__row"))
    d = days.select(by, F.col(on).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(v.schema["__v"].dataType).alias("__v"), F.struct(*days.columns).alias("__row"))
    w = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return v.union(d).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1").select("__row.*", F.col("__last.v").alias(value))


def calendar(bounds: DataFrame, *, by: str, first: str, last: str, day: str = "day") -> DataFrame:
    """Every day from first to last of each key."""
    return bounds.select(by, F.explode(F.sequence(F.col(first), F.col(last))).alias(day))


def day_totals(entries: DataFrame, by: list[str], sums: list[str], order: list[str] | None = None) -> DataFrame:
    """Number of entries and sums by key; sums of nothing but nulls stay null.

    With ``order``, each key's figures are added one after the other in that order: totals that are rounded afterwards are
    then the same however the rows were dealt over tasks.
    """
    if order is not None:
        w = Window.partitionBy(*by).orderBy(*order, *sums)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        running = entries.select(*by, F.row_number().over(w).alias("__n"), *[F.sum(c).over(so_far).alias(c) for c in sums])
        return running.groupBy(*by).agg(F.count("*").alias("entries"), *[F.max_by(c, "__n").alias(c) for c in sums])
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), *[F.sum(c).alias(c) for c in sums])


def history(entries: DataFrame, goals: DataFrame, sums: list[str], *, user: str = "user_id", date: str = "log_date", order: list[str] | None = None) -> DataFrame:
    """Every calendar day of each user from the first to the last entry, with totals (null on gap days) and the goal in force.

    ``order``: as for :func:`day_totals`.
    """
    totals = day_totals(entries, [user, date], sums, order)
    span = totals.groupBy(user).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    days = calendar(span, by=user, first="first", last="last", day=date).join(totals, [user, date], "left")
    return asof_join(days, goals, by=user, on=date, start="effective_from", value="calories_target")


def with_default_goal(days: DataFrame, target: str = "calories_target", default: float = DEFAULT_GOAL[0]) -> DataFrame:
    """The diary shows a default where no goal is in force; the history keeps null."""
    return days.withColumn(target, F.coalesce(target, F.lit(default)))


def window_days(users: DataFrame, days: int, *, user: str = "user_id", selected: str = "selected", today: str = "today") -> DataFrame:
    """The window of so many calendar days that ends on the earlier of a selected day and today, for each user."""
    end = F.least(selected, today)
    return users.select(user, F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))


def trailing(days: DataFrame, values: list[str], n: int, *, user: str = "user_id", date: str = "log_date") -> DataFrame:
    """Mean over the logged days of the n calendar days that end on each row, and their number. Works on days with gaps."""
    w = Window.partitionBy(user).orderBy(F.unix_date(date)).rangeBetween(-(n - 1), 0)
    return days.withColumns({f"{v}_mean_{n}": F.avg(v).over(w) for v in values} | {f"logged_{n}": F.count(values[0]).over(w)})


def history_summary(days: DataFrame, value: str, target: str, by: list[str]) -> DataFrame:
    """Logged and total days, mean of logged days, and the target if all logged days share one (null counts as one)."""
    logged = F.col(value).isNotNull()
    shared = F.collect_set(F.when(logged, F.struct(F.col(target).alias("t"))))
    return days.groupBy(*by).agg(F.count_if(logged).alias("logged_days"), F.count("*").alias("total_days"), F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean"), F.when(F.size(shared) == 1, F.get(shared, F.lit(0))["t"]).alias("target"))


def chart_bounds(days: DataFrame, value: str, target: str, by: list[str]) -> DataFrame:
    """Lower and upper end of a chart: 0 or beyond what is shown; 0 to 1 if all is flat."""
    low, high = F.least(F.lit(0.0), F.min(value), F.min(target)), F.greatest(F.lit(0.0), F.max(value), F.max(target))
    return days.groupBy(*by).agg(low.alias("low"), high.alias("high")).select(*by, F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.col("low")).alias("low"), F.when(F.col("low") == F.col("high"), 1.0).otherwise(F.col("high")).alias("high"))


def sum_nutrient(v: Column) -> Column:
    """Sum of nutrient structs as one aggregate; a single one passes as it is.

    The value is the sum of what was reported; what is missing anywhere makes it incomplete; a bound is the sum of all
    bounds, if each has one (a complete, unqualified figure is its own) and one at least was given.
    """
    clean = ~N.is_incomplete(v) & ~N.is_qualified(v)

    def bound(side: str) -> Column:
        usable = F.coalesce(v[side], F.when(clean, N.reported(v)))
        return F.when(F.bool_and(usable.isNotNull()) & F.bool_or(v[side].isNotNull()), F.sum(usable))

    low, high = bound("lower"), bound("upper")
    kinds = F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(v["qualifiers"]))), lambda q: q != "LOGICAL_ZERO"))
    total = F.struct(
        F.sum(N.reported(v)).alias("value"), kinds.alias("qualifiers"), F.bool_or(N.is_incomplete(v)).alias("incomplete"), low.alias("lower"), high.alias("upper"),
        (low.isNull() | F.bool_and(v["lower_inclusive"])).alias("lower_inclusive"), (high.isNull() | F.bool_and(v["upper_inclusive"])).alias("upper_inclusive"),
    )
    one = F.first(F.struct(*[v[c].alias(c) for c in ("value", "qualifiers", "incomplete", "lower", "upper", "lower_inclusive", "upper_inclusive")]))
    return F.when(F.count("*") == 1, one).otherwise(total)


def nutrient_totals(entries: DataFrame, by: list[str], nutrients: str = "nutrients") -> DataFrame:
    """Sums of all nutrients of each key. An entry that lacks a nutrient which others of the key have leaves it incomplete."""
    n = entries.groupBy(*by).agg(F.count("*").alias("__all"))
    each = entries.select(*by, F.explode(nutrients).alias("nutrient", "v")).groupBy(*by, "nutrient").agg(sum_nutrient(F.col("v")).alias("v"), F.count("*").alias("__some"))
    gap = F.col("__some") < F.col("__all")
    return each.join(n, by).select(*by, "nutrient", F.when(gap, F.col("v").withField("incomplete", F.lit(True)).withField("lower", F.lit(None).cast("double")).withField("upper", F.lit(None).cast("double"))).otherwise(F.col("v")).alias("v"))


def datasets_in(entries: DataFrame, by: list[str], nutrients: str = "nutrients") -> DataFrame:
    """The datasets that a key's figures come from, sorted."""
    return entries.select(*by, F.explode(F.map_values(nutrients)).alias("v")).groupBy(*by).agg(F.array_sort(F.collect_set("v.dataset")).alias("datasets"))


def export_credit(datasets: DataFrame, credits_: DataFrame, by: list[str]) -> DataFrame:
    """The credit lines of the datasets of each key, in their order, joined by spaces. ``credits_``: ``dataset, credit``."""
    lines = datasets.select(*by, F.posexplode("datasets").alias("at", "dataset")).join(credits_, "dataset")
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "credit"))), lambda x: x["credit"]), " ").alias("credit"))


def goal_periods(goals: DataFrame, by: str = "user_id") -> DataFrame:
    """Each goal with the day before the next one's start (``until``, null for the last)."""
    return goals.withColumn("until", F.date_sub(F.lead("effective_from").over(Window.partitionBy(by).orderBy("effective_from")), 1))


def history_goals(goals: DataFrame, first: Column, last: Column, by: str = "user_id") -> DataFrame:
    """The goal in force at the first day of a window and all changes inside it."""
    return goal_periods(goals, by).filter((F.col("effective_from") <= last) & (F.col("until").isNull() | (F.col("until") >= first)))


def recent_foods(entries: DataFrame, limit: int, *, user: str = "user_id") -> DataFrame:
    """The foods a user logged last, each once (newest entry by time, then id), newest first: ``place`` 1 to ``limit``."""
    newest = entries.groupBy(user, "ref_kind", "ref_id", "name").agg(F.max(F.struct("created_at", "id")).alias("m"))
    w = Window.partitionBy(user).orderBy(F.desc("m.created_at"), F.desc("m.id"))
    return newest.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select(user, "place", "ref_kind", "ref_id", "name", F.col("m.created_at").alias("created_at"), F.col("m.id").alias("id"))


def latest_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by one aggregation."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def logged_dates(entries: DataFrame, *, user: str = "user_id", date: str = "log_date") -> DataFrame:
    """The days that a user logged, each once, with ``place`` 1 for the newest; stored text that is no date is left out."""
    days = entries.select(user, F.col(date).cast("string").try_cast("date").alias(date)).filter(F.col(date).isNotNull()).distinct()
    return days.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(date))))


def copy_day(entries: DataFrame, by: int = 1) -> DataFrame:
    """A meal's entries as of the day after: amounts and frozen figures stay, ids are left for the writer."""
    return entries.withColumn("copied_from", F.col("id")).withColumn("log_date", F.date_add("log_date", by)).drop("id")


def log_entries(requests: DataFrame, foods: DataFrame) -> DataFrame:
    """Requests with their food's name and figures, frozen and scaled; ``reject_reason`` where the amount can't be resolved.

    ``foods``: ``kind, id, name, brand, basis, density, kcal, protein, fat, carbs``. Quick entries bring their own figures.
    """
    f = foods.select("kind", F.col("id").alias("ref_id"), *[F.col(c).alias(f"f_{c}") for c in ("name", "brand", "basis", "density", "kcal", "protein", "fat", "carbs")])
    r = requests.withColumn("kind", F.coalesce("kind", F.lit("quick"))).join(f, ["kind", "ref_id"], "left")
    q = N.resolve_quantity(F.col("amount"), F.col("unit"), F.coalesce("f_basis", F.lit("g")), F.col("f_density"), F.col("portion_grams"))
    r = r.withColumn("q", q)
    quick = F.col("kind") == "quick"
    reason = F.when(~quick & F.col("f_name").isNull(), "unknown food").when(~quick & ~F.coalesce(F.col("q.basis_amount") > 0, F.lit(False)), "no amount")
    figures = [F.when(quick, F.col(c)).otherwise(N.scale_figure(F.col(f"f_{c}"), F.col("q.basis_amount"))).alias(c) for c in ("kcal", "protein", "fat", "carbs")]
    return r.select("user_id", "log_date", "meal", "kind", "ref_id", F.coalesce("f_name", "name").alias("name"), F.col("f_brand").alias("brand"), "amount", "unit", F.col("q.grams").alias("grams"), F.col("q.basis_amount").alias("basis_amount"), *figures, reason.alias("reject_reason"))


def targets(profiles: DataFrame, weights: DataFrame, day: Column) -> DataFrame:
    """Daily targets of a population: profiles with their latest weight, through resting energy, target and macros."""
    latest = latest_by(weights.select("user_id", "measured_on", "kg"), ["user_id"], ["measured_on", "kg"]).select("user_id", "kg")
    p = profiles.join(latest, "user_id", "left")
    p = p.withColumn("bmr", N.bmr(F.col("sex"), F.col("kg"), F.col("height_cm"), N.age_on(F.col("birth_date"), day), F.col("body_fat")))
    p = p.withColumn("kcal", N.calorie_target(F.col("bmr"), N.activity_factor(F.col("activity")), F.col("kg"), F.col("sex"), F.col("direction"), F.col("rate")))
    p = p.withColumn("m", N.split_macros(F.col("kcal"), F.col("kg"), F.col("direction")))
    return p.select("user_id", "kg", "bmr", "kcal", F.col("m.protein").alias("protein"), F.col("m.fat").alias("fat"), F.col("m.carbs").alias("carbs"), N.warn_floor(F.col("bmr"), F.col("sex")).alias("warn_floor"))


#: The export's columns.
EXPORT_HEADER = ("date", "meal", "food_name", "brand", "quantity", "unit", "grams", "calories", "protein_g", "fat_g", "carbs_g", "nutrition_basis", "basis_amount", "nutrition_metadata", "source_credit")
#: The export's cells of text; the others are numbers, a date and the meal's name.
_EXPORT_TEXT = {"food_name", "brand", "unit", "nutrition_basis", "nutrition_metadata", "source_credit"}
MEAL_CODES = {"breakfast": 1, "lunch": 2, "dinner": 3, "snack": 4}


def export_lines(entries: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines (``value``) of the CSV export of entries that have the columns of ``EXPORT_HEADER`` and ``created_at``.

    In the order of day, meal (breakfast, lunch, dinner, snack) and time. Text is escaped and quoted, numbers have a dot,
    null is empty; an absent column is empty. ``keep`` adds columns of the entries.
    """
    none = F.lit(None).cast("string")

    def cell(name: str) -> Column:
        c = F.col(name) if name in entries.columns else none
        return csv_escape(F.nullif(c.cast("string"), F.lit(""))) if name in _EXPORT_TEXT else F.coalesce(F.lower(c.cast("string")) if name == "meal" else c.cast("string"), F.lit(""))

    code = F.create_map(*[F.lit(x) for kv in MEAL_CODES.items() for x in kv])
    ordered = entries.withColumn("__meal", F.try_element_at(code, F.lower("meal")))
    by = ["date", "__meal", "created_at"]
    return ordered.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep, F.array_join(F.array(*map(cell, EXPORT_HEADER)), ",").alias("value"))


def write_export(entries: DataFrame, path: str) -> None:
    """The export as text in parts that are in order: the header is the first part."""
    header = entries.sparkSession.createDataFrame([(",".join(EXPORT_HEADER),)], "value string").coalesce(1)
    header.union(export_lines(entries)).write.mode("overwrite").text(path)
