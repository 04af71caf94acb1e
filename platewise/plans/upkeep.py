"""Registered queries of maintenance, upgrades, orders, screens, references and the audit."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nutrition
from ..operators import audit, diary, maintain, stored, tables
from ..operators import catalogue as cat
from ..operators.staging import work_dir
from ..sources import national, strict
from ..sources.common import driver_table
from ..streaming import live, stateful
from . import views as v
from .queries import HISTORY_SQL
from .registry import register, with_views


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stored rows, and customers of orders as new ones, every seventh with an id that isn't stored."""
    base = driver_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = driver_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return base, new.withColumn("k", F.when(F.col("k") % 7 == 0, -F.col("k") - 1).otherwise(F.col("k")))


_SIDES = "base as (select c_custkey as k, c_acctbal as v from customer), new as (select case when o_custkey % 7 = 0 then -o_custkey - 1 else o_custkey end as k, max(o_totalprice) as v from orders group by o_custkey)"


@register(f"with {_SIDES} select k, v from base union all select k, v from new where k not in (select k from base)")
def inserted_rows(spark, d):
    """New rows whose key isn't there yet are added."""
    return maintain.insert_ignore(*_sides(spark, d), ["k"])


@register(f"with {_SIDES} select k, v from base where k not in (select k from new) union all select k, v from new")
def replaced_rows(spark, d):
    """Restored rows take the place of what has their id."""
    return maintain.insert_replace(*_sides(spark, d), "k")


@register(f"with {_SIDES} select k, v from base union all select k, v from new where k < 0")
def restored_rows(spark, d):
    """Rows that come back as a whole: none of their ids is in use."""
    base, new = _sides(spark, d)
    return maintain.restore_all(base, new.filter("k < 0"), "k")


@register(f"with {_SIDES} select k, v from new where k not in (select k from base)")
def updates_of_nothing(spark, d):
    """Updates of rows that aren't there."""
    return maintain.missing_ids(*_sides(spark, d), "k")


@register(
    with_views(
        "select user_id, effective_from, case when guess and seen then calories_target + 100 else calories_target end as calories_target, case when guess and not seen then 'changed meanwhile' end as error from n",
        n="select *, row_number() over (partition by user_id order by effective_from) % 2 = 1 as guess, day(effective_from) % 3 <> 0 as seen from goals",
    )
)
def guarded_goals(spark, d):
    """Every other goal of a user edited, a third of these as of an older state: what is stored, and which edits failed."""
    from pyspark.sql import Window

    g = v.goals(spark, d).withColumn("id", F.concat_ws("-", "user_id", "effective_from"))
    w = Window.partitionBy("user_id").orderBy("effective_from")
    seen = F.dayofmonth("effective_from") % 3 != 0
    edits = g.withColumn("n", F.row_number().over(w)).withColumn("expected_next", F.lead("effective_from").over(w)).filter("n % 2 = 1")
    edits = edits.select("id", F.struct(F.when(seen, F.col("calories_target")).otherwise(F.col("calories_target") - 1).alias("calories_target")).alias("expected"), F.struct((F.col("calories_target") + 100).alias("calories_target")).alias("replacement"), "expected_next")
    after, errors = maintain.guarded_update(g, edits, "id", ["calories_target"], by="user_id", start="effective_from")
    return after.join(errors, "id", "left").select("user_id", "effective_from", "calories_target", "error")


_OLD = (
    "select id, user_id, log_date, cast(h % 5 as int) as meal_type, case h % 6 when 0 then 'db' when 1 then 'bundled' when 2 then 'custom' when 3 then 'quick' when 4 then 'manual' else null end as food_source, ref_id as food_id, name as food_name, calories as amount, "
    "case h % 4 when 0 then 'g' when 1 then '' when 2 then null else 'cup' end as amount_unit, calories, h * 1.0 as protein, 1.0 as fat, 2.0 as carbs, cast(null as bigint) as created_at from diary"
)


def _old_entries(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_OLD.replace("from diary", "from {t}"), t=v.diary(spark, d))


@register(
    with_views(
        "select id, log_date, case when meal_type = 0 then 4 else meal_type end as meal_type, case when food_source in ('bundled', 'custom', 'quick') then food_source when food_source = 'db' then 'bundled' else 'quick' end as food_ref_kind, "
        "case when food_source is distinct from 'quick' then food_id end as food_ref_id, amount as quantity, coalesce(nullif(amount_unit, ''), 'g') as unit_label, amount as grams, amount as basis_amount, 'g' as nutrition_basis, 0::bigint as updated_at from old",
        old=_OLD,
    )
)
def upgraded_entries(spark, d):
    """Diary entries of the first version as the newest."""
    new = maintain.upgrade_entries(_old_entries(spark, d), 1)
    return new.select("id", "log_date", "meal_type", "food_ref_kind", "food_ref_id", "quantity", "unit_label", "grams", "basis_amount", "nutrition_basis", "updated_at")


@register(with_views("select c.user_id, coalesce(min(o.log_date), date '1970-01-01') as effective_from, any_value(c.t) as calories_target, 150.0::double as protein_target_g from (select c_custkey as user_id, case when c_custkey % 3 = 0 then 2000.0 else c_acctbal end as t from customer) c left join old o on o.user_id = c.user_id group by c.user_id", old=_OLD))
def upgraded_goals(spark, d):
    """Undated goals of old snapshots, from each user's first logged day on."""
    c = driver_table(spark, d, "customer")
    none = F.lit(None).cast("double")
    goals = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("calories_target"), none.alias("protein_target"), none.alias("fat_target"), none.alias("carbs_target"))
    empty = spark.createDataFrame([], "user_id long, id long, food_source string, food_id long, food_name string, sort_order int, created_at long")
    custom = spark.createDataFrame([], "id long, description string, brand_owner string, gtin_upc string, calories_100g double, protein_100g double, fat_100g double, carbs_100g double, serving_size double, serving_unit string, created_at long")
    out = maintain.upgrade_snapshot({"daily_logs": _old_entries(spark, d), "goals": goals, "favorites": empty, "custom_foods": custom}, 1, user="user_id")
    return out["goals"].select("user_id", "effective_from", "calories_target", "protein_target_g")


@register(with_views("select user_id, log_date, id, row_number() over (partition by user_id, log_date order by meal, created_at, id) as place from (select *, case when h < 11 then 1 when h < 15 then 2 when h < 17 then 4 when h < 21 then 3 else 4 end as meal from diary)"))
def day_order(spark, d):
    """Entries of a day in the order in which they are shown."""
    e = v.diary(spark, d)
    meal = F.try_element_at(F.create_map(*[F.lit(x) for kv in diary.MEAL_CODES.items() for x in kv]), nutrition.meal_for_hour(F.col("h")))
    return maintain.ordered(e.withColumn("meal_type", meal).withColumn("created_at", F.struct("created_at", "id")), "entries").select("user_id", "log_date", "id", "place")


@register(with_views("select user_id, measured_on, kg, row_number() over (partition by user_id order by measured_on desc) as place from weights"))
def weight_order(spark, d):
    """Weights, newest first."""
    return maintain.ordered(v.weights(spark, d), "weights").select("user_id", "measured_on", "kg", "place")


@register(with_views("select f.id as food_id, s.n as sort_order, case s.n when 0 then 'cup' else 'slice' end as label, f.protein + s.n as grams, s.n = 0 as is_default from foods f, (values (0), (1)) s(n) where f.id % 3 = 0"))
def serving_rows(spark, d):
    """A catalogue's portions as rows of their own, the first as default."""
    f = v.catalogue(spark, d)
    two = F.array(F.struct(F.lit("cup").alias("label"), F.col("protein").alias("grams")), F.struct(F.lit("slice").alias("label"), (F.col("protein") + 1).alias("grams")))
    f = f.withColumn("servings", F.when(F.col("id") % 3 == 0, two)).withColumn("aliases", F.array().cast(cat.ALIASES))
    return cat.children(f)["servings"].select("food_id", "sort_order", "label", "grams", "is_default")


@register(with_views("select e.id, e.kind, case e.kind when 'bundled' then f.kcal when 'custom' then c.c_acctbal end as kcal from (select id, ref_id, case h % 3 when 0 then 'bundled' when 1 then 'custom' else 'quick' end as kind from diary) e left join foods f on e.kind = 'bundled' and f.id = e.ref_id left join customer c on e.kind = 'custom' and c.c_custkey = e.ref_id"))
def resolved_references(spark, d):
    """What each reference's table has now."""
    kind = F.when(F.col("h") % 3 == 0, "bundled").when(F.col("h") % 3 == 1, "custom").otherwise("quick")
    refs = v.diary(spark, d).select(F.col("id").alias("entry"), F.col("ref_id").alias("id"), kind.alias("kind"))
    custom = driver_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("kcal"))
    return maintain.resolve_refs(refs, v.catalogue(spark, d).select("id", "kcal"), custom).select(F.col("entry").alias("id"), "kind", "kcal")


@register("with f as (select c_custkey % 25 as user_id, c_custkey as id, lower(c_mktsegment) as n, 'Brand ' || (c_custkey % 9) as b from customer), q as (select distinct user_id % 25 as user_id, case user_id % 4 when 0 then 'mach' when 1 then 'tur' when 2 then 'brand 3' else 'zzz' end as q from events) select q.user_id, q.q, f.id from q join f using (user_id) where contains(f.n, q.q) or contains(lower(f.b), q.q)")
def custom_food_search(spark, d):
    """Users' own foods whose name or brand contains a query."""
    c = driver_table(spark, d, "customer")
    foods = c.select((F.col("c_custkey") % 25).alias("user_id"), F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name_folded"), F.concat(F.lit("Brand "), (F.col("c_custkey") % 9).cast("string")).alias("brand"))
    u = F.col("user_id")
    q = driver_table(spark, d, "events").select((u % 25).alias("user_id"), F.when(u % 4 == 0, "mach").when(u % 4 == 1, "tur").when(u % 4 == 2, "brand 3").otherwise("zzz").alias("q")).distinct()
    return maintain.custom_search(foods, q).select("user_id", "q", "id")


@register(with_views("select lang, count(*) filter (where n <> name) as attached, count(*) filter (where n = name) as loanword, count(*) filter (where n is null) as unusable from (select name, 'de' as lang, case when id % 3 = 0 then name when id % 3 = 1 then 'de ' || name end as n from foods union all select name, 'fr', case when id % 4 = 0 then 'fr ' || name end from foods) group by lang"))
def alias_counts(spark, d):
    """Names in other languages that were attached, equal or unusable."""
    f = v.catalogue(spark, d).withColumnRenamed("id", "key")
    raw = f.select("key", F.when(F.col("key") % 3 == 0, F.col("name")).when(F.col("key") % 3 == 1, F.concat(F.lit("de "), "name")).otherwise("1").alias("a"), F.when(F.col("key") % 4 == 0, F.concat(F.lit("fr "), "name")).alias("b"))
    return national.alias_report(f, raw, {"de": "a", "fr": "b"})


@register("select l_orderkey as key, l_linenumber as label, min(l_quantity) as grams from lineitem group by all having count(distinct l_quantity) = 1")
def agreed_portions(spark, d):
    """Portions of one weight."""
    p = driver_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("grams"))
    agreed = p.groupBy("key", "label").agg(F.count_distinct("grams").alias("n")).filter("n = 1")
    none = spark.createDataFrame([], "key long, label int, grams double, all array<double>")
    return strict.resolve_portions(p.join(agreed, ["key", "label"], "left_semi"), none)


@register("with a as (select l_orderkey as k, l_linenumber as f, max(l_quantity) as v from lineitem group by all), b as (select l_orderkey as k, l_linenumber as f, min(l_quantity) as v from lineitem where l_returnflag <> 'R' group by all) select coalesce(a.k, b.k) as k, coalesce(a.f, b.f) as f, a.v as wide_value, b.v as detail_value from a full join b on a.k = b.k and a.f = b.f where a.v is distinct from b.v")
def wide_against_details(spark, d):
    """Cells of a wide table that their details don't repeat."""
    lines = driver_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("f"), F.col("l_quantity").alias("v"), "l_returnflag")
    wide, detail = lines.groupBy("k", "f").agg(F.max("v").alias("v")), lines.filter("l_returnflag <> 'R'").groupBy("k", "f").agg(F.min("v").alias("v"))
    return tables.reconcile(wide, detail, ["k", "f"], "v")


@register(with_views("select id, name, case when l.id is not null then true else false end as preferred from (select id, name, row_number() over (partition by lower(trim(name)), lower(trim(coalesce(brand, ''))), floor(kcal / 50) order by popularity desc, quality desc, ord) = 1 as best from f) x left join (select id from f where 1 = 0) l using (id) where best", f="select *, case when source = 'off' then 1 else 2 end as quality from foods where kcal is not null"))
def preferred_foods(spark, d):
    """The established choice among equal foods of all sources."""
    f = v.catalogue(spark, d).filter("kcal is not null").withColumn("quality", F.when(F.col("source") == "off", 1).otherwise(2)).withColumn("aliases", F.array().cast(cat.ALIASES))
    return cat.preferred_ids(f).join(f.select("id", "name"), "id").select("id", "name", F.lit(False).alias("preferred"))


@register(with_views("select id, name from (select *, row_number() over (partition by source, lower(trim(name)), lower(trim(coalesce(brand, ''))), floor(kcal / 50) order by popularity desc, quality desc, ord) as n from f) where n = 1", f="select *, case when source = 'off' then 1 else 2 end as quality from foods where kcal is not null"))
def source_representatives(spark, d):
    """The food that stands for each display group inside its source."""
    f = v.catalogue(spark, d).filter("kcal is not null").withColumn("quality", F.when(F.col("source") == "off", 1).otherwise(2)).withColumn("aliases", F.array().cast(cat.ALIASES))
    return cat.representatives(f).select("id", "name")


@register(with_views("select user_id, try_cast(t as date) as log_date, row_number() over (partition by user_id order by try_cast(t as date) desc) as place from (select distinct user_id, case when h = 5 then 'not a day' else cast(log_date as varchar) end as t from diary) where try_cast(t as date) is not null"))
def days_newest_first(spark, d):
    """Each user's logged days, newest first; text that is no date is left out."""
    e = v.diary(spark, d).select("user_id", F.when(F.col("h") == 5, "not a day").otherwise(F.col("log_date").cast("string")).alias("log_date"))
    return diary.logged_dates(e)


_SCREEN = (
    ", shown as (select user_id, unnest([max(log_date), cast(max(log_date) + interval 1 day as date)]) as log_date, max(log_date) as today from diary group by user_id), t as (select user_id, log_date, count(*) as entries, sum(calories) as calories from diary group by all), "
    "l as (select user_id, string_agg(cast(log_date as varchar), ',' order by log_date desc) as logged from t group by user_id) "
    "select s.user_id, s.log_date, s.log_date = s.today as is_today, coalesce(a.entries, 0) as entries, a.calories, coalesce(b.entries, 0) as previous_entries, b.calories as previous_calories, g.calories_target, l.logged from shown s left join t a on a.user_id = s.user_id and a.log_date = s.log_date "
    "left join t b on b.user_id = s.user_id and b.log_date = s.log_date - interval 1 day asof left join goals g on g.user_id = s.user_id and s.log_date >= g.effective_from left join l on l.user_id = s.user_id"
)


def _shown(entries: DataFrame) -> DataFrame:
    last = entries.groupBy("user_id").agg(F.max("log_date").alias("today"))
    return last.select("user_id", F.explode(F.array("today", F.date_add("today", 1))).alias("log_date"), "today")


def _text_dates(screens: DataFrame) -> DataFrame:
    return screens.withColumn("logged", F.array_join(F.transform("logged_dates", lambda x: x.cast("string")), ",")).drop("logged_dates")


@register(f"with diary as ({v.DIARY_SQL}), goals as ({v.GOALS_SQL}){_SCREEN}")
def diary_screens(spark, d):
    """What the diary shows of each user's last day and of the day after it."""
    e = v.diary(spark, d)
    return _text_dates(live.diary_screen(e, v.goals(spark, d), _shown(e), ["calories"]))


@register(f"with diary as ({v.DIARY_SQL}), goals as ({v.GOALS_SQL}){_SCREEN}")
def live_screens(spark, d):
    """The same screens from a stream of changes over the events, run until it has seen all of them."""
    out = f"{work_dir(spark)}/screens-{uuid.uuid4().hex}"
    table = driver_table(spark, d, "events")
    single = table.inputFiles()[0].endswith("/events.parquet")  # a file, or a folder of files
    reader = spark.readStream.schema(table.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    entry = F.struct("user_id", F.col("event_id").alias("id"), F.to_date("ts").alias("log_date"), F.col("value").alias("calories"))
    changes = stream.filter("event_type not in ('signup', 'error')").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit(None).cast("struct<user_id:bigint,id:bigint,log_date:date,calories:double>").alias("old"), entry.alias("new"))
    live.live_screens(changes, out, f"{out}/checkpoint", lambda: v.goals(spark, d), _shown, ["calories"]).awaitTermination()
    newest = spark.read.parquet(f"{out}/screens/*")
    last = newest.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return _text_dates(newest.join(last, ["user_id", "batch"], "left_semi").drop("batch"))


@register(f"with diary as ({v.DIARY_SQL}), goals as ({v.GOALS_SQL}){HISTORY_SQL} select user_id, log_date, calories, calories_target, avg(calories) over w as calories_mean_28, count(calories) over w as logged_28 from history window w as (partition by user_id order by log_date range between interval 27 days preceding and current row)")
def history_windows(spark, d):
    """Each user's days with the goal in force and the mean of the last four weeks, derived anew for the users of a batch."""
    e = v.diary(spark, d)
    goals = v.goals(spark, d)
    out = live.recompute_touched(e.select("user_id"), "user_id", lambda: e, lambda some: diary.trailing(diary.history(some, goals, ["calories"]), ["calories"], 28))
    return out.select("user_id", "log_date", "calories", "calories_target", "calories_mean_28", "logged_28")


@register(with_views("select d.user_id, d.log_date, g.calories_target from (select distinct user_id, log_date from diary) d asof left join goals g on g.user_id = d.user_id and d.log_date >= g.effective_from"))
def goals_in_force(spark, d):
    """The goal in force on each logged day."""
    return live.goal_in_force(v.diary(spark, d).select("user_id", "log_date").distinct(), v.goals(spark, d))


@register(with_views("select user_id, effective_from, calories_target, cast(lead(effective_from) over (partition by user_id order by effective_from) - interval 1 day as date) as until from goals where user_id in (select user_id from diary where h = 3)"))
def goal_histories(spark, d):
    """Goals with their last day, of the users that a batch touches."""
    return live.goal_history(v.diary(spark, d).filter("h = 3"), lambda: v.goals(spark, d))


# The audit on rows of which each kind of defect has some.
_F = (
    "select p_partkey as id, case when p_partkey % 101 = 0 then concat(p_name, ' &amp; www.x.org') when p_partkey % 103 = 0 then '12345' when p_partkey % 107 = 0 then p_brand when p_partkey % 149 = 0 then concat('Ã', p_name) else concat(p_name, ', ', lower(p_type)) end as name, p_brand as brand, "
    "case when p_partkey % 151 = 0 then 'zz' when p_partkey % 4 = 0 then 'usda' when p_partkey % 4 = 1 then 'bls' when p_partkey % 4 = 2 then 'off' else 'frida' end as source, case when p_partkey % 137 = 0 then null when p_partkey % 4 = 0 then 'en' when p_partkey % 4 = 1 then 'de' when p_partkey % 139 = 0 then 'en' when p_partkey % 4 = 2 then null else 'da' end as lang, "
    "case when p_partkey % 19 = 0 then cast(0 as double) else p_retailprice - cast(600 as double) end as kcal, cast(p_size as double) / cast(2 as double) as protein, cast(p_size % 10 as double) as fat, cast(p_size as double) as carbs, cast(null as double) as fibre, "
    "cast(p_size % 12 as double) * 2 as sugar, cast(p_size % 13 as double) as saturated, cast(p_partkey % 50 as double) as sodium, case when p_partkey % 4 = 0 then 'by_difference' when p_partkey % 31 = 0 then 'odd' else 'available' end as carbs_convention, cast(p_partkey % 5 as int) as basic_rank, "
    "cast(case when p_partkey % 131 = 0 then 7 when p_partkey % 127 = 0 then 1 when p_partkey % 4 = 2 then 1 else 0 end as int) as source_rank, case when p_partkey % 113 = 0 then '' when p_partkey % 109 = 0 then upper(p_name) else lower(p_name) end as name_folded, "
    "case when p_partkey % 69 = 0 then null when p_partkey % 51 = 0 then 'other' when p_partkey % 3 = 0 then lower(concat('fr ', p_name)) when p_partkey % 49 = 1 then 'bag only' else null end as alias_names, case when p_partkey % 5 = 0 then lpad(cast(p_partkey as varchar(20)), 8, '0') else null end as barcode from part"
)
_A = (
    "select case when p_partkey % 67 = 0 then p_partkey + 100000000 else p_partkey end as food_id, 0 as ord, case when p_partkey % 57 = 0 then 'Fr1' else 'fr' end as lang, concat('fr ', p_name) as name from part where p_partkey % 3 = 0 "
    "union all select p_partkey, 1, 'fr', concat('fr ', p_name) from part where p_partkey % 33 = 0 union all select p_partkey, 2, 'en', concat(p_name, ', ', lower(p_type)) from part where p_partkey % 61 = 0"
)
_B = "select case when p_partkey % 35 = 0 then '1234' else lpad(cast(p_partkey as varchar(20)), 8, '0') end as barcode, case when p_partkey % 55 = 0 then p_partkey + 100000000 when p_partkey % 65 = 0 then p_partkey + 1 else p_partkey end as food_id from part where p_partkey % 5 = 0"
_S = (
    "select case when p_partkey % 97 = 0 then p_partkey + 100000000 else p_partkey end as food_id, 0 as sort_order, case when p_partkey % 11 = 0 then 'Oz.' else 'cup' end as label, cast(p_size * 60 - 60 as double) as grams from part union all select p_partkey, 1, ' CUP', cast(10 as double) from part where p_partkey % 29 = 0"
)
_UNIT = ", ".join(f"'{u}'" for u in audit.UNIT_LABELS)
_ROWS = {
    "html entity in name": ("regexp_matches(name, '&(amp|quot|apos|lt|gt|nbsp|#[0-9]+);')", 50),
    "address in name": ("regexp_matches(name, '(?i)https?://|www\\.')", 0),
    "name equals brand": ("lower(trim(name)) = lower(trim(brand))", 0),
    "zero energy with macros": ("kcal = 0 and (protein > 0.5 or fat > 0.5)", 200),
    "sodium above 45": ("sodium > 45", 0),
    "sugar above carbs": ("sugar > carbs + 1", 0),
    "saturated above fat": ("saturated > fat + 1", 0),
    "energy out of range": ("kcal not between 0 and 900", 0),
    "unknown source": ("source = 'zz'", 0),
    "basic rank not 0 to 2": ("basic_rank > 2", 0),
    "unknown convention": ("carbs_convention = 'odd'", 0),
    "convention not the source's": ("carbs_convention <> case when source = 'usda' then 'by_difference' else 'available' end", 0),
    "source rank not 0 or 1": ("source_rank > 1", 0),
    "source rank not the source's": ("source_rank <> case when source in ('usda', 'bls', 'frida') then 0 else 1 end", 0),
    "national food without language": ("source in ('usda', 'bls', 'frida') and lang is null", 0),
    "branded food with language": ("source = 'off' and lang is not null", 0),
    "empty folded name": ("name_folded = ''", 0),
    "capital in folded name": ("regexp_matches(name_folded, '[A-Z]')", 0),
    "doubly encoded name": ("contains(name, 'Ã')", 0),
    "no letter in name": ("not regexp_matches(name, '\\p{L}')", 0),
    "control character in name": ("regexp_matches(name, '\\p{Cc}')", 0),
    "missing required figure": ("kcal is null or protein is null or fat is null or carbs is null", 0),
}
_CHECKS = [(n, b, f"select count(*) from f where {c}") for n, (c, b) in _ROWS.items()] + [
    ("serving without weight", 0, "select count(*) from s where grams <= 0"),
    ("serving out of range", 0, "select count(*) from s where grams not between 1 and 2000"),
    ("serving label is a unit", 0, f"select count(*) from s where regexp_replace(lower(trim(label)), '\\.+$', '') in ({_UNIT})"),
    ("malformed alias language", 0, "select count(*) from a where lang = 'Fr1'"),
    ("malformed barcode", 0, "select count(*) from b where barcode = '1234'"),
    ("wrong check digit", 0, "select count(*) from (select barcode, list_transform(str_split(barcode, ''), lambda x: cast(x as int)) as x from b) where length(barcode) <> 8 or (10 - (3 * (x[7] + x[5] + x[3] + x[1]) + x[6] + x[4] + x[2]) % 10) % 10 <> x[8]"),
    ("repeated serving label", 0, "select count(*) from (select 1 from s group by food_id, lower(trim(label)) having count(*) > 1)"),
    ("repeated search row", 0, "select count(*) from (select 1 from f group by source, lower(trim(name)), lower(coalesce(brand, '')), floor(kcal / 50) having count(*) > 1)"),
    ("column empty for a source", 0, "select count(*) from (select 1 from f group by source having count(fibre) = 0)"),
    ("serving without food", 0, "select count(*) from s where food_id not in (select id from f)"),
    ("alias without food", 0, "select count(*) from a where food_id not in (select id from f)"),
    ("barcode without food", 0, "select count(*) from b where food_id not in (select id from f)"),
    ("aliases but no bag", 0, "select count(distinct food_id) from a where food_id not in (select id from f where alias_names <> '')"),
    ("bag but no aliases", 0, "select count(*) from f where alias_names <> '' and id not in (select food_id from a)"),
    ("alias equals name", 0, "select count(*) from a join f on f.id = a.food_id where a.name = f.name"),
    ("repeated alias", 0, "select count(*) from (select 1 from a group by food_id, lang, name having count(*) > 1)"),
    ("own barcode can't be scanned", 0, "select count(*) from f where barcode is not null and not exists (from b where b.food_id = f.id and b.barcode = f.barcode)"),
    ("barcode gives another food", 0, "select count(*) from f join b using (barcode) where f.id <> b.food_id"),
    ("bag isn't the aliases in order", 0, "select count(*) from (select food_id, string_agg(lower(name), chr(10) order by ord, lower(name)) as built from a group by food_id) x join f on f.id = x.food_id where f.alias_names <> '' and built <> alias_names"),
]
AUDIT_SQL = f"with f as ({_F}), a as ({_A}), b as ({_B}), s as ({_S}) " + " union all ".join("select '{}' as \"check\", ({}) as n, {} as budget, ({}) <= {} as passed".format(n.replace("'", "''"), q, b, q, b) for n, b, q in _CHECKS)


@register(AUDIT_SQL)
def audit_report(spark, d):
    """All checks of a catalogue in which each kind of defect has been put."""
    part = driver_table(spark, d, "part")
    f, a, b, s = (spark.sql(q.replace("from part", "from {t}"), t=part) for q in (_F, _A, _B, _S))
    return audit.audit(f, a, b, s)


_DIGITS = {k: f"floor((1000000 + l_suppkey) / {10**k}) % 10" for k in range(7)}
_CODE = f"(10 - cast(3 * ({_DIGITS[0]} + {_DIGITS[2]} + {_DIGITS[4]} + {_DIGITS[6]}) + {_DIGITS[1]} + {_DIGITS[3]} + {_DIGITS[5]} as int) % 10) % 10"
PRODUCTS_SQL = (
    f"select concat(cast(1000000 + l_suppkey as varchar(20)), cast(case when l_orderkey % 11 = 0 then ({_CODE} + 1) % 10 else {_CODE} end as varchar(20))) as barcode, concat('item ', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as name, "
    "case when l_linenumber = 5 then null else cast(8 * l_quantity + 9 * l_linenumber as double) end as kcal, cast(l_quantity as double) as protein, cast(l_linenumber as double) as fat, cast(l_quantity as double) as carbs, "
    "case when l_returnflag = 'R' then 'en:value-over-105' else null end as errors, cast(round(l_discount * 100) as int) as quality, cast(round(l_tax * 100) as int) as popularity, l_orderkey * 8 + l_linenumber as ord from lineitem"
)


def _in_batches(rows: DataFrame, batches: int, *spread: str) -> DataFrame:
    """A table as a stream of so many micro-batches, each a mix of all of it, in no order."""
    spark = rows.sparkSession
    path = f"{work_dir(spark)}/batches-{uuid.uuid4().hex}"
    rows.withColumn("__batch", F.pmod(F.xxhash64(*spread), F.lit(batches))).repartition(batches, "__batch").drop("__batch").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register(
    f"with products as ({PRODUCTS_SQL}), good as (select * from products where kcal is not null and protein + fat + carbs <= 105 and errors is null and cast(substr(barcode, 8) as bigint) = (10 - (select sum(cast(substr(barcode, i, 1) as bigint) * case when i % 2 = 1 then 3 else 1 end) from range(1, 8) r(i)) % 10) % 10) "
    "select barcode, name, kcal, quality, popularity, ord, seen from (select *, count(*) over (partition by barcode) as seen, row_number() over (partition by barcode order by quality desc, popularity desc, ord) as n from good) where n = 1"
)
def ingested_products(spark, d):
    """The best record of each barcode from a stream of products in four micro-batches, and how many were accepted."""
    out = f"{work_dir(spark)}/products-{uuid.uuid4().hex}"
    products = spark.sql(PRODUCTS_SQL.replace("from lineitem", "from {t}"), t=driver_table(spark, d, "lineitem"))
    stateful.keep_best_products(_in_batches(products, 4, "ord"), out, f"{out}/checkpoint").awaitTermination()
    return live.read_current(spark, out).select("barcode", "name", "kcal", "quality", "popularity", "ord", "seen")


@register(
    "select user_id, strftime(log_date, '%Y-%m-%d') as log_date, count(*) as entries, round(sum(round(value, 3)), 2) as kcal from (select user_id, value, cast(ts as date) + case when event_id % 7 = 0 then 1 else 0 end as log_date from events where event_id % 5 <> 0) group by user_id, log_date"
)
def late_day_totals(spark, d):
    """Totals of users' days from changes in no order: every fifth entry is deleted later, every seventh moved to the next day."""
    out = f"{work_dir(spark)}/totals-{uuid.uuid4().hex}"
    e = driver_table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.to_date("ts").alias("day"), F.round("value", 3).alias("value"))

    def change(rows: DataFrame, later: int, new) -> DataFrame:
        return rows.select("user_id", "id", (F.col("at") + later).alias("at"), new.cast("struct<log_date:date,kcal:double>").alias("new"))

    first = change(e, 0, F.struct(F.col("day"), F.col("value")))
    moved = change(e.filter("id % 7 = 0"), 1, F.struct(F.date_add("day", 1), F.col("value")))
    gone = change(e.filter("id % 5 = 0"), 2, F.lit(None))
    stream = _in_batches(first.unionByName(moved).unionByName(gone), 3, "id", "at")
    stateful.keep_day_totals(stream, out, f"{out}/checkpoint", ["kcal"]).awaitTermination()
    return live.read_current(spark, out).select("user_id", F.date_format("log_date", "yyyy-MM-dd").alias("log_date"), "entries", F.round("kcal", 2).alias("kcal"))


@register(f"with foods as ({v.CATALOGUE_SQL}), asked as (select event_id, lpad(cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 5 + event_id % 3 as varchar(20)), 8, '0') as barcode from events) select a.event_id, a.barcode, f.name, f.kcal from asked a left join foods f using (barcode)")
def stored_lookups(spark, d):
    """Foods of scanned barcodes, from tables stored by barcode and by id."""
    mark = uuid.uuid4().hex
    foods = v.catalogue(spark, d)
    path = f"{work_dir(spark)}/stored-{mark}"
    codes = stored.store_by_key(foods.filter("barcode is not null").select("barcode", F.col("id").alias("food_id")), f"codes_{mark}", f"{path}/codes", ["barcode"], buckets=8)
    kept = stored.store_by_key(foods.select("id", "name", "kcal"), f"foods_{mark}", f"{path}/foods", ["id"], buckets=8)
    e = driver_table(spark, d, "events")
    code = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") * 5 + F.col("event_id") % 3
    asked = e.select("event_id", F.lpad(code.cast("string"), 8, "0").alias("barcode"))
    return stored.resolve_codes(asked, codes, kept).select("event_id", "barcode", "name", "kcal")


@register(f"with diary as ({v.DIARY_SQL}) select user_id, count(*) as entries, round(sum(calories), 2) as calories from diary where log_date between (select min(log_date) + 5 from diary) and (select min(log_date) + 20 from diary) group by user_id")
def stored_window(spark, d):
    """Totals of a window of sixteen days, from entries stored by month and user."""
    mark = uuid.uuid4().hex
    e = v.diary(spark, d).select("user_id", "log_date", "id", "calories")
    table = stored.store_diary(e, f"diary_{mark}", f"{work_dir(spark)}/diary-{mark}", buckets=8)
    first = e.agg(F.min("log_date")).first()[0]
    window = stored.days_between(table, first + datetime.timedelta(days=5), first + datetime.timedelta(days=20))
    return window.groupBy("user_id").agg(F.count("*").alias("entries"), F.round(F.sum("calories"), 2).alias("calories"))
