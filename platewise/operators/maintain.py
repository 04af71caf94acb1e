"""Changes to stored tables, as new snapshots: upsert, insert, delete, guarded update, toggle, and upgrades of old records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.foods import gtin_ok
from ..functions.text import fold_name
from .tables import ContractError


def upsert_by_key(base: DataFrame, changes: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """Changes replace rows of their key; ``keep`` columns (such as the id and time of creation) stay as stored."""
    old = base.select(*[F.col(k).alias(f"__{k}") for k in key], F.struct(*base.columns).alias("__old"))
    new = changes.select(*[F.col(k) for k in key], F.struct(*[F.col(c) for c in base.columns]).alias("__new"))
    on = [F.col(k) == F.col(f"__{k}") for k in key]
    both = new.join(old, on, "full_outer")
    kept = set(keep or [])
    return both.select(*[(F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in kept else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))).alias(c) for c in base.columns])


def insert_ignore(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't there yet; of new rows that share a key one stays."""
    return base.unionByName(new.dropDuplicates(key).join(base.select(*key), key, "left_anti").select(*base.columns))


def insert_replace(base: DataFrame, restored: DataFrame, id_col: str = "id") -> DataFrame:
    """Restored rows come back with their id, in place of what has it."""
    return base.join(restored.select(id_col), id_col, "left_anti").select(*base.columns).unionByName(restored.select(*base.columns))


def restore_all(base: DataFrame, restored: DataFrame, id_col: str = "id") -> DataFrame:
    """Restored rows come back, or nothing does if one of their ids is in use."""
    if restored.join(base, id_col, "left_semi").limit(1).count():
        raise ContractError("an id is in use")
    return base.unionByName(restored.select(*base.columns))


def delete_by(base: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays and what was removed."""
    return base.join(keys.select(*key).distinct(), key, "left_anti"), base.join(keys.select(*key).distinct(), key, "left_semi")


def delete_with_children(base: DataFrame, children: DataFrame, keys: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Rows and the children that belong to them go."""
    gone = keys.select(F.col(key).alias(parent)).distinct()
    return base.join(keys.select(key).distinct(), key, "left_anti"), children.join(gone, parent, "left_anti")


def guarded_update(base: DataFrame, edits: DataFrame, key: str, values: list[str], *, by: str, start: str) -> tuple[DataFrame, DataFrame]:
    """Edits apply where the stored values and the start of the next row are still what the editor saw; others are errors.

    ``edits``: the key, ``expected`` and ``replacement`` (structs of ``values``) and ``expected_next``.
    """
    w = Window.partitionBy(by).orderBy(start)
    seen = base.withColumn("__next", F.lead(start).over(w)).join(edits, key, "left")
    same = F.struct(*values).eqNullSafe(F.col("expected")) & F.col("__next").eqNullSafe(F.col("expected_next"))
    hit = F.col("expected").isNotNull()
    after = seen.select(*[F.when(hit & same, F.col(f"replacement.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])
    stale = seen.filter(hit & ~same).select(key, F.lit("changed meanwhile").alias("error"))
    return after, stale.union(edits.join(base, key, "left_anti").select(key, F.lit("missing").alias("error")))


def toggle(base: DataFrame, events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each event adds its key or takes it away: what counts is whether their number is odd; the last event's values are kept."""
    last = events.filter("kind <> 'quick'").groupBy(*key).agg(F.count("*").alias("__n"), F.max_by(F.struct(*[c for c in base.columns if c not in key]), order).alias("__v"))
    both = base.withColumn("__b", F.struct(*[c for c in base.columns if c not in key])).select(*key, "__b").join(last, key, "full_outer")
    there = (F.when(F.col("__b").isNotNull(), 1).otherwise(0) + F.coalesce("__n", F.lit(0))) % 2 == 1
    return both.filter(there).select(*key, F.coalesce("__v", "__b").alias("__r")).select(*key, "__r.*").select(*base.columns)


def missing_ids(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates of rows that aren't there: errors."""
    return updates.join(base, key, "left_anti")


def _entries_2(e: DataFrame) -> DataFrame:
    return e.withColumn("food_source", F.when(F.col("food_source") == "db", "bundled").otherwise(F.col("food_source")))


def _entries_3(e: DataFrame) -> DataFrame:
    known = F.col("food_source").isin("bundled", "custom", "quick")
    made = F.coalesce("created_at", F.lit(0)).cast("long")
    return e.select(
        "id", "log_date", F.when(F.col("meal_type") == 0, 4).otherwise(F.col("meal_type")).alias("meal_type"), F.when(known, F.col("food_source")).when(F.col("food_source") == "db", "bundled").otherwise("quick").alias("food_ref_kind"),
        F.when(~F.col("food_source").eqNullSafe("quick"), F.col("food_id")).alias("food_ref_id"), "food_name", F.lit(None).cast("string").alias("brand"), F.col("amount").alias("quantity"),
        F.coalesce(F.nullif("amount_unit", F.lit("")), F.lit("g")).alias("unit_label"), F.col("amount").alias("grams"), "calories", F.col("protein").alias("protein_g"), F.col("fat").alias("fat_g"), F.col("carbs").alias("carbs_g"),
        made.alias("created_at"), made.alias("updated_at"),
    )


def _entries_7(e: DataFrame) -> DataFrame:
    return e.withColumn("nutrition_basis", F.lit("g")).withColumn("basis_amount", F.col("grams")).withColumn("nutrition_metadata", F.lit(None).cast("string"))


def _goals_3(g: DataFrame, entries: DataFrame, by: str | None) -> DataFrame:
    first = entries.groupBy(*([by] if by else [])).agg(F.min("log_date").alias("first_day"))
    dated = g.join(F.broadcast(first)) if by is None else g.join(first, by, "left")
    return dated.select(
        *([by] if by else []), F.coalesce("first_day", F.lit("1970-01-01").cast("date")).alias("effective_from"), F.coalesce("calories_target", F.lit(2000.0)).alias("calories_target"), F.coalesce("protein_target", F.lit(150.0)).alias("protein_target_g"),
        F.coalesce("fat_target", F.lit(65.0)).alias("fat_target_g"), F.coalesce("carbs_target", F.lit(250.0)).alias("carbs_target_g"), F.lit("manual").alias("source"), F.lit(0).cast("long").alias("created_at"),
    )


def _favourites_3(f: DataFrame, by: list[str]) -> DataFrame:
    kind = F.when(F.col("food_source").isin("bundled", "custom"), F.col("food_source")).when(F.col("food_source") == "db", "bundled").otherwise("custom")
    rows = f.filter("food_id is not null").select(*by, kind.alias("food_ref_kind"), F.col("food_id").alias("food_ref_id"), "id", "food_name", F.lit(None).cast("string").alias("brand"), F.coalesce("sort_order", F.lit(0)).alias("sort_order"), F.coalesce("created_at", F.lit(0)).cast("long").alias("created_at"))
    key = [*by, "food_ref_kind", "food_ref_id"]
    return rows.groupBy(*key).agg(F.min_by(F.struct("food_name", "brand", "sort_order", "created_at"), "id").alias("r")).select(*key, "r.*")  # the first of a key stays


def _custom_3(c: DataFrame) -> DataFrame:
    made = F.coalesce("created_at", F.lit(0)).cast("long")
    return c.select(
        "id", F.col("description").alias("name"), F.col("brand_owner").alias("brand"), F.col("gtin_upc").alias("barcode"), F.col("calories_100g").alias("kcal_100g"), "protein_100g", "fat_100g", "carbs_100g", F.lit(None).cast("double").alias("density_g_per_ml"),
        made.alias("created_at"), made.alias("updated_at"),
    )


def _servings_3(c: DataFrame) -> DataFrame:
    return c.filter("serving_size > 0").select(F.col("id").alias("food_id"), F.coalesce(F.nullif("serving_unit", F.lit("")), F.lit("serving")).alias("label"), F.col("serving_size").alias("grams"), F.lit(True).alias("is_default"), F.lit(0).alias("sort_order"))


def upgrade_entries(entries: DataFrame, version: int) -> DataFrame:
    """Diary entries of an old version (1 to 6) as the newest.

    2 renames a source; 3 makes references, quantity and grams out of source, id and amount, whatever the unit was (a
    blank unit is g), and code 0 of a meal becomes 4; 7 adds the basis, in grams.
    """
    for to, step in ((2, _entries_2), (3, _entries_3), (7, _entries_7)):
        if to > version:
            entries = step(entries)
    return entries


def upgrade_snapshot(tables: dict[str, DataFrame], version: int, *, user: str | None = None) -> dict[str, DataFrame]:
    """All tables of an old snapshot as the newest: ``daily_logs, goals, favorites, custom_foods`` (and ``custom_food_servings``).

    Goals that had no date begin with the first logged day, or else in 1970; favourites without a food go, and of equal
    ones the first stays; a custom food's one serving becomes a row; names are folded. ``user``: a column that tells
    several people's snapshots apart; without one there is a single goal row.
    """
    out = dict(tables)
    if version < 3:
        out["goals"] = _goals_3(tables["goals"], tables["daily_logs"], user)
        out["favorites"] = _favourites_3(tables["favorites"], [user] if user else [])
        out["custom_food_servings"] = _servings_3(tables["custom_foods"])
        out["custom_foods"] = _custom_3(tables["custom_foods"])
    none = F.lit(None).cast("string")
    for to, columns in ((5, {"source": none}), (6, {"name_folded": fold_name(F.col("name")), "brand_folded": fold_name(F.col("brand"))}), (7, {"nutrition_basis": F.lit("g"), "nutrition_metadata": none})):
        if version < to:
            out["custom_foods"] = out["custom_foods"].withColumns(columns)
    if version < 4 and "profile" in out:
        out["profile"] = out["profile"].withColumn("body_fat_percent", F.lit(None).cast("double"))
    out["daily_logs"] = upgrade_entries(tables["daily_logs"], version)
    return out


def ordered(table: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """Stored rows with ``place`` in the order in which they are shown, for each key ``by`` (default: the owner of such rows).

    ``servings`` by sort order, ``favourites`` by sort order and newest first, ``entries`` by meal and time, ``weights`` by
    day, newest first.
    """
    key, order = {
        "servings": (["food_id"], [F.col("sort_order")]),
        "favourites": (["user_id"], [F.col("sort_order"), F.desc("created_at")]),
        "entries": (["user_id", "log_date"], [F.col("meal_type"), F.col("created_at")]),
        "weights": (["user_id"], [F.desc("measured_on")]),
    }[kind]
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*(key if by is None else by)).orderBy(*order)))


def resolve_barcode(scans: DataFrame, barcodes: DataFrame, custom: DataFrame) -> DataFrame:
    """Each scan's food: the user's own food of that code first, then the catalogue's; ``kind`` and ``id`` null if unknown.

    ``scans``: ``user_id, barcode``; ``custom``: ``user_id, barcode, id``.
    """
    own = custom.groupBy("user_id", "barcode").agg(F.max("id").alias("own_id"))
    table = barcodes.groupBy("barcode").agg(F.min("food_id").alias("food_id"))
    out = scans.join(own, ["user_id", "barcode"], "left").join(table, "barcode", "left")
    return out.withColumn("kind", F.when(F.col("own_id").isNotNull(), "custom").when(F.col("food_id").isNotNull(), "bundled")).withColumn("id", F.coalesce("own_id", "food_id")).drop("own_id", "food_id")


def resolve_refs(refs: DataFrame, bundled: DataFrame, custom: DataFrame) -> DataFrame:
    """References (``kind, id``) with what their table has now; a favourite only points, so its figures are current."""
    foods = bundled.withColumn("kind", F.lit("bundled")).unionByName(custom.withColumn("kind", F.lit("custom")), allowMissingColumns=True)
    return refs.join(foods, ["kind", "id"], "left")


def custom_search(foods: DataFrame, queries: DataFrame, folded: Column | None = None) -> DataFrame:
    """Custom foods of a user whose folded name or brand contains the folded query as it stands."""
    f = foods.withColumn("__text", F.concat_ws("\n", folded if folded is not None else F.col("name_folded"), F.lower("brand")))
    return queries.join(f, "user_id").filter(F.contains("__text", F.col("q"))).drop("__text")


def offerable_custom(acceptable: Column, confirmed_missing: Column, barcode: Column, contributable: Column) -> Column:
    """Whether a saved food may be offered upstream: a lookup has confirmed that it is missing there, its code is valid, its text and figures may go out."""
    return F.coalesce(acceptable & confirmed_missing & gtin_ok(barcode) & contributable, F.lit(False))


def acceptable_custom(name: Column, kcal: Column, usable: Column) -> Column:
    """Whether a user's food may be saved: a name of 2 to 120 characters, usable figures, stated energy."""
    return F.coalesce(F.length(F.trim(name)).between(2, 120) & usable & kcal.isNotNull(), F.lit(False))
