"""Registered queries of the catalogue and diary operators, each with SQL that says the same to DuckDB where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import foods as food
from ..functions import numbers, nutrition, text
from ..operators import audit, diary, hot, maintain, search, tables
from ..operators import catalogue as cat
from ..operators.staging import work_dir
from ..sources.common import driver_table
from ..streaming import live
from . import views as v
from .registry import MACROS, register, with_views

REASON_SQL = (
    "case when kcal is null then 'no energy' when kcal < 0 or kcal > 900 then 'energy range' when protein is null or fat is null or carbs is null then 'incomplete macros' "
    "when protein < 0 or protein > 100 or fat < 0 or fat > 100 or carbs < 0 or carbs > 100 then 'macro range' when protein + fat + carbs > 105 then 'macro sum' "
    "when kcal = 0 and (protein > 0.5 or fat > 0.5) then 'zero energy' when abs(kcal - (protein * 4 + fat * 9 + carbs * 4)) > greatest(35.0, kcal * 0.3) then 'Atwater' end"
)
HISTORY_SQL = """, totals as (select user_id, log_date, count(*) as entries, sum(calories) as calories from diary group by user_id, log_date),
span as (select user_id, min(log_date) as a, max(log_date) as b from totals group by user_id),
days as (select user_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as log_date from span),
history as (select d.user_id, d.log_date, t.entries, t.calories, g.calories_target from days d left join totals t using (user_id, log_date) asof left join goals g on d.user_id = g.user_id and d.log_date >= g.effective_from)
"""


def _history_sql(select: str) -> str:
    return f"with diary as ({v.DIARY_SQL}), goals as ({v.GOALS_SQL}){HISTORY_SQL} {select}"


def _history(spark: SparkSession, d: str, order: list[str] | None = None) -> DataFrame:
    return diary.history(v.diary(spark, d), v.goals(spark, d), ["calories"], order=order)


@register(_history_sql("select user_id, log_date, entries, calories, calories_target from history"))
def daily_intake_vs_goal(spark, d):
    """Every user's calendar days with intake and the goal in force."""
    return _history(spark, d).select("user_id", "log_date", "entries", "calories", "calories_target")


@register(_history_sql("select user_id, log_date, coalesce(calories_target, 2000.0::double) as calories_target, floor(coalesce(calories_target, 2000.0) - coalesce(calories, 0) + 0.5) as remaining, case when coalesce(calories_target, 2000.0) > 0 then least(greatest(coalesce(calories, 0) / coalesce(calories_target, 2000.0), 0.0), 1.0) else 0.0 end as progress from history"))
def remaining_and_progress(spark, d):
    """What is left of each day's target (a default where none is in force), and the share reached. Sums are taken in the order
    of the table: what is left is rounded, so another order could give another whole number."""
    h = diary.with_default_goal(_history(spark, d, ["id"]))
    eaten = F.coalesce("calories", F.lit(0.0))
    return h.select("user_id", "log_date", "calories_target", nutrition.remaining(F.col("calories_target"), eaten).alias("remaining"), nutrition.progress(F.col("calories_target"), eaten).alias("progress"))


@register(_history_sql("select user_id, log_date, avg(calories) over w as calories_mean_7, count(calories) over w as logged_7 from history window w as (partition by user_id order by log_date range between interval 6 days preceding and current row)"))
def trailing_week(spark, d):
    """Mean intake of the logged days of the week that ends on each day."""
    return diary.trailing(_history(spark, d), ["calories"], 7).select("user_id", "log_date", "calories_mean_7", "logged_7")


@register(_history_sql("select user_id, count(calories) as logged_days, count(*) as total_days, avg(calories) as mean, case when count(distinct case when calories is not null then coalesce(calories_target, -1) end) = 1 then max(case when calories is not null then calories_target end) end as target from history group by user_id"))
def history_summary(spark, d):
    """Logged days, mean and common target of each user."""
    return diary.history_summary(_history(spark, d), "calories", "calories_target", ["user_id"])


@register(_history_sql(", b as (select user_id, least(0.0, min(calories), min(calories_target)) as low, greatest(0.0, max(calories), max(calories_target)) as high from history group by user_id) select user_id, cast(case when low = high then 0 else low end as double) as low, cast(case when low = high then 1 else high end as double) as high from b"))
def chart_bounds(spark, d):
    """Ends of each user's chart."""
    return diary.chart_bounds(_history(spark, d), "calories", "calories_target", ["user_id"])


@register(with_views("select user_id, log_date, case when h < 11 then 'breakfast' when h < 15 then 'lunch' when h < 17 then 'snack' when h < 21 then 'dinner' else 'snack' end as meal, count(*) as entries, sum(calories) as calories from diary group by all"))
def meal_subtotals(spark, d):
    """Sums by user, day and meal."""
    entries = v.diary(spark, d).withColumn("meal", nutrition.meal_for_hour(F.col("h")))
    return diary.day_totals(entries, ["user_id", "log_date", "meal"], ["calories"])


@register(with_views("select user_id, effective_from, calories_target, cast(lead(effective_from) over (partition by user_id order by effective_from) - interval 1 day as date) as until from goals"))
def goal_periods(spark, d):
    """How long each goal was in force."""
    return diary.goal_periods(v.goals(spark, d))


@register(with_views("select user_id, effective_from, calories_target from p where effective_from <= date '2024-01-20' and (until is null or until >= date '2024-01-10')", p="select *, lead(effective_from) over (partition by user_id order by effective_from) - interval 1 day as until from goals"))
def goals_of_window(spark, d):
    """The goal at the start of a window and those that begin in it."""
    first, last = F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")
    return diary.history_goals(v.goals(spark, d), first, last).select("user_id", "effective_from", "calories_target")


@register(with_views("select user_id, place, ref_kind, ref_id, name, created_at, id from (select *, row_number() over (partition by user_id order by created_at desc, id desc) as place from (select *, row_number() over (partition by user_id, ref_kind, ref_id, name order by created_at desc, id desc) as n from diary) where n = 1) where place <= 20"))
def recent_foods(spark, d):
    """The twenty foods that each user logged last."""
    return diary.recent_foods(v.diary(spark, d), 20)


@register(with_views("select distinct user_id, log_date from diary where h % 5 <> 0"))
def logged_dates(spark, d):
    """Days on which a user has entries left, from changes: entries of every fifth hour are deleted again."""
    return live.live_logged_dates(_changes(driver_table(spark, d, "events"))).select("user_id", "log_date")


@register(with_views("select id as copied_from, user_id, cast(log_date + interval 1 day as date) as log_date, h, calories, name from diary where h < 11"))
def copied_breakfasts(spark, d):
    """Each day's breakfast as entries of the next day."""
    return diary.copy_day(v.diary(spark, d).filter("h < 11")).select("copied_from", "user_id", "log_date", "h", "calories", "name")


TARGETS_SQL = """, latest as (select user_id, max_by(kg, measured_on) as kg from weights group by user_id),
p as (select *, extract(year from date '2024-06-30') - extract(year from birth_date) - case when (extract(month from date '2024-06-30'), extract(day from date '2024-06-30')) < (extract(month from birth_date), extract(day from birth_date)) then 1 else 0 end as age from profiles left join latest using (user_id)),
b as (select *, case when kg between 10 and 650 then case when body_fat is not null then 370 + 21.6::double * (kg * (1 - body_fat / 100)) else 10 * kg + 6.25::double * height_cm - 5 * age + case sex when 'male' then 5 when 'female' then -161 else -78 end end end as bmr, case activity when 'sedentary' then 1.2::double when 'light' then 1.375 when 'moderate' then 1.55 when 'active' then 1.725 else 1.9 end as factor from p),
t as (select *, floor(greatest(bmr * factor + case direction when 'lose' then -1 when 'gain' then 1 else 0 end * least(rate, 1.0, kg * 0.01::double) * 7700 / 7, bmr, case when sex = 'female' then 1200.0 else 1500.0 end) + 0.5) as k from b),
u as (select *, case when bmr is not null then k end as kcal from t),
f as (select *, floor(kcal * 0.28::double / 9 + 0.5) as fat from u),
m as (select *, least(floor(kg * case direction when 'lose' then 2.0::double when 'gain' then 1.8 else 1.6 end + 0.5), floor(greatest((kcal - fat * 9 - 200) / 4, 0.0))) as protein from f where kcal is not null)
select user_id, bmr, kcal, protein, fat, floor(greatest((kcal - protein * 4 - fat * 9) / 4, 0.0) + 0.5) as carbs from m
"""


@register(f"with profiles as ({v.PROFILES_SQL}), weights as ({v.WEIGHTS_SQL}){TARGETS_SQL}")
def population_targets(spark, d):
    """Daily targets of all profiles that have a weight."""
    out = diary.targets(v.profiles(spark, d), v.weights(spark, d), F.lit("2024-06-30").cast("date"))
    return out.filter("kcal is not null").select("user_id", "bmr", "kcal", "protein", "fat", "carbs")


_TENTH_LB = "floor(kg / 0.45359237::double * 10 + 0.5) / 10"


@register(f"select user_id, measured_on, kg, {_TENTH_LB} as lb from weights".replace("weights", f"({v.WEIGHTS_SQL}) w"))
def body_units(spark, d):
    """Weights in pounds."""
    return v.weights(spark, d).select("user_id", "measured_on", "kg", nutrition.kg_to_lb(F.col("kg")).alias("lb"))


@register(with_views("select id, kcal * 4.184::double as kj from foods"))
def energies_in_kj(spark, d):
    """Energies in kilojoules."""
    return v.catalogue(spark, d).select("id", nutrition.kcal_to_kj(F.col("kcal")).alias("kj"))


@register(with_views(f"select reason, count(*) as n from (select coalesce({REASON_SQL}, 'kept') as reason from foods) group by reason"))
def quality_gate_report(spark, d):
    """Foods by the first reason to reject them."""
    f = v.catalogue(spark, d).withColumn("reject_reason", food.reject_reason(*[F.col(c) for c in MACROS]))
    return tables.reject_report(f)


@register("select food" + "".join(f", max_by(value, (l_shipdate, l_partkey, l_suppkey, value, l_extendedprice)) filter (where field = {i}) as \"{i}\"" for i in range(1, 8)) + f" from ({v.LONG_SQL}) x group by food")
def pivot_last_values(spark, d):
    """Long figures as one row a food, the last of each field."""
    return tables.pivot_values(v.long_values(spark, d), "food", "field", "value", v.LONG_ORDER, list(range(1, 8)))


CODE_SQL = "case field when 1 then 'ENERC' when 2 then 'NA' else 'PROT' end"


@register(f"select food, field, l_partkey, l_suppkey, l_shipdate, case when code = 'NA' then case basis when 'WKG' then value / 10000 when 'W' then value / 1000 end when basis = 'W' then case when code = 'ENERC' then case when unit = 'kJ' then value / 4.184::double else value end when unit = 'mg' then value / 1000 else value end end as figure from (select *, {CODE_SQL} as code from ({v.LONG_SQL}))")
def figures_by_basis(spark, d):
    """Figures per 100 g by unit and basis; off-basis figures have no value."""
    code = F.when(F.col("field") == 1, "ENERC").when(F.col("field") == 2, "NA").otherwise("PROT")
    return v.long_values(spark, d).select("food", "field", "l_partkey", "l_suppkey", "l_shipdate", numbers.to_canonical_unit(F.col("value"), F.col("unit"), F.col("basis"), code).alias("figure"))


@register("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def repeated_codes(spark, d):
    """Codes that occur more than once."""
    return tables.duplicates_by(driver_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("select l_orderkey, count(*) filter (where n = 1) as kept, count(*) filter (where n > 1) as rejected from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) group by l_orderkey")
def ambiguous_codes(spark, d):
    """Rows kept and rejected where all rows of a repeated code are."""
    rows = driver_table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("code"))
    return tables.reject_ambiguous(rows, "code").groupBy("l_orderkey").agg(F.count_if(F.col("reject_reason").isNull()).alias("kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


PAIR = "row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)"


@register(f"select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.n, b.n) as n, a.l_partkey as left_part, b.l_partkey as right_part from (select l_orderkey, {PAIR} as n, l_partkey from lineitem where l_linestatus = 'F') a full join (select l_orderkey, {PAIR} as n, l_partkey from lineitem where l_linestatus = 'O') b on a.l_orderkey = b.l_orderkey and a.n = b.n")
def pair_by_occurrence(spark, d):
    """The n-th row of a code on one side with the n-th on the other."""
    rows = driver_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("o"))
    both = tables.pair_by_occurrence(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), "l_orderkey", "o")
    return both.select("l_orderkey", "n", F.col("l.l_partkey").alias("left_part"), F.col("r.l_partkey").alias("right_part"))


@register("with a as (select distinct c_custkey as k from customer where c_acctbal > 0), b as (select distinct o_custkey as k from orders where o_orderstatus = 'P') select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)")
def key_sets_differ(spark, d):
    """Keys of only one of two sets: customers in credit, and customers with an order in progress."""
    a = driver_table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return tables.set_difference(a, driver_table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


QUALITY_SQL = "least(100, 40 + case when length(brand) > 0 then 10 else 0 end + case when length(barcode) > 0 then 5 else 0 end + case when source <> 'off' then 20 else 0 end + 5 + case when length(name) >= 8 then 5 else 0 end)"
DERIVED = "(^|[^a-z])(" + "|".join(w if w == "meal" else f"{w}s?" for w in food.DERIVATIVES + food.COMPOUND_DERIVATIVES) + ")($|[^a-z])"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    f = v.catalogue(spark, d).filter("kcal is not null")
    return f.withColumn("quality", food.quality_score(F.col("brand"), F.lit(False), F.col("barcode"), F.col("source"), F.lit(True), F.col("name")))


@register(with_views(f"select id, {QUALITY_SQL} as quality, case when source = 'off' then 1 else 0 end as source_rank, case when regexp_matches(lower(name), '{DERIVED}') then 2 when regexp_matches(lower(name), '(^|[^a-z])(raw|fresh|whole|unprocessed|plain|cru|crua|crus|cruas)($|[^a-z])') then 0 when source = 'off' and nova = 1 then 0 when source = 'off' and nova = 4 then 2 else 1 end as basic_rank from foods where kcal is not null"))
def food_ranks(spark, d):
    """Quality and ranks of foods."""
    f = _ranked(spark, d)
    return f.select("id", "quality", food.source_rank(F.col("source")).alias("source_rank"), food.basic_rank(F.col("name"), F.col("source"), F.col("nova")).alias("basic_rank"))


@register(with_views("select id, case when fibre between 0 and 100 and fibre <= carbs + 100 then fibre end as fibre, case when sugar between 0 and 100 and sugar <= carbs + 1 then sugar end as sugar, case when saturated between 0 and 100 and saturated <= fat + 1 then saturated end as saturated, case when sodium between 0 and 45 then sodium end as sodium, case when fibre is null then carbs else greatest(carbs - fibre, 0.0) end as net_carbs from foods"))
def minor_figures(spark, d):
    """Minor figures without implausible ones, and carbohydrate less fibre where it is known."""
    f = v.catalogue(spark, d)
    m = food.clean_micros(*[F.col(c) for c in ("fat", "carbs", "fibre", "sugar", "saturated", "sodium")])
    carbs = nutrition.display_carbs(F.col("carbs"), F.col("fibre"), F.lit("by_difference"))
    return f.select("id", m.alias("m"), carbs.alias("c")).select("id", "m.fibre", "m.sugar", "m.saturated", "m.sodium", F.col("c.value").alias("net_carbs"))


@register(with_views("select id, barcode, length(barcode) = 8 and regexp_full_match(barcode, '[0-9]{8}') and (10 - (3 * (b[7] + b[5] + b[3] + b[1]) + b[6] + b[4] + b[2]) % 10) % 10 = b[8] as ok from (select id, barcode, list_transform(str_split(barcode, ''), lambda x: cast(x as int)) as b from foods where barcode is not null)"))
def barcode_checks(spark, d):
    """Codes and whether their check digit is right."""
    return v.catalogue(spark, d).filter("barcode is not null").select("id", "barcode", food.gtin_ok(F.col("barcode")).alias("ok"))


@register("select s_suppkey, source, case source when 'usda' then 200000000 when 'cofid' then 110000000000 when 'cnf' then 180000000000 else 1000000000000 end + case when source = 'cofid' then s_suppkey * 10000 + s_nationkey else s_suppkey end as id from (select *, case s_suppkey % 4 when 0 then 'usda' when 1 then 'cofid' when 2 then 'cnf' else 'off' end as source from supplier)")
def stable_ids(spark, d):
    """Ids from publishers' keys."""
    s = driver_table(spark, d, "supplier")
    source = F.when(F.col("s_suppkey") % 4 == 0, "usda").when(F.col("s_suppkey") % 4 == 1, "cofid").when(F.col("s_suppkey") % 4 == 2, "cnf").otherwise("off")
    key = F.when(source == "cofid", F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", source.alias("source"), food.stable_id(source, key).alias("id"))


KEY_SQL = "lower(trim(name)), lower(trim(coalesce(brand, ''))), floor(kcal / 50)"
RANKED_SQL = f"select *, {QUALITY_SQL} as quality from foods where kcal is not null"


@register(with_views(f"select id, first_value(id) over (partition by {KEY_SQL} order by popularity desc, quality desc, ord) as winner_id from ranked", ranked=RANKED_SQL))
def display_groups(spark, d):
    """The food that stands for each display group."""
    return cat.display_groups(_ranked(spark, d)).select("id", "winner_id")


@register(with_views("select id, name, popularity, quality from (select *, row_number() over (partition by name, brand order by quality desc, popularity desc, ord) as n from ranked) where n = 1", ranked=RANKED_SQL))
def best_records(spark, d):
    """The best record of each name and brand."""
    return tables.keep_best(_ranked(spark, d), ["name", "brand"], [F.col("quality"), F.col("popularity")], "ord").select("id", "name", "popularity", "quality")


@register(with_views("select source, count(*) as records, count(*) filter (where search) as rows from (select source, id = w as search from g where source <> 'off' union all select o.source, o.id = o.w and k.x is null from o join (select w from o where id = w and popularity >= 5 order by popularity desc, quality desc, ord limit 50) t on o.w = t.w left join (select distinct " + KEY_SQL.replace("floor(kcal / 50)", "floor(kcal / 50) as c, 1 as x").replace("lower(trim(name))", "lower(trim(name)) as a").replace("lower(trim(coalesce(brand, '')))", "lower(trim(coalesce(brand, ''))) as b") + " from g where source <> 'off' and id = w) k on k.a = lower(trim(o.name)) and k.b = lower(trim(coalesce(o.brand, ''))) and k.c = floor(o.kcal / 50)) group by source", ranked=RANKED_SQL, g=f"select *, first_value(id) over (partition by {KEY_SQL} order by popularity desc, quality desc, ord) as w from ranked where source <> 'off'", o=f"select *, first_value(id) over (partition by {KEY_SQL} order by popularity desc, quality desc, ord) as w from ranked where source = 'off'"))
def selected_catalogue(spark, d):
    """Records and search rows by source, for the fifty most popular branded groups whose winner has five scans or more."""
    f = _ranked(spark, d)
    generic = cat.display_groups(f.filter("source <> 'off'")).withColumn("shown", F.col("id") == F.col("winner_id"))
    return cat.search_counts(cat.select_catalogue(generic, f.filter("source = 'off'"), 5, 50))


FOLD_SQL = "lower(replace(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'))"
TOKENS_SQL = f"select doc_id, lang, source, unnest(regexp_extract_all({FOLD_SQL}, '[0-9a-z]+')) as word from documents"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return driver_table(spark, d, "documents").select("doc_id", "lang", "source", text.fold_latin(F.col("text")).alias("folded"))


@register(f"select source, lang, word, count(*) as n from ({TOKENS_SQL}) where length(word) between 3 and 12 group by all having count(*) >= 2")
def word_lexicon(spark, d):
    """Words that occur twice or more in a source's language."""
    return cat.lexicon(_names(spark, d), ["source", "lang"])


HEADS_SQL = f"""
with tok as ({TOKENS_SQL.replace("from documents", "from documents where lang in ('da', 'nb', 'sv', 'de', 'fi')")}),
lex as (select lang, word from tok where length(word) between 3 and 12 group by all having count(*) >= 2),
used as (select distinct lang, word as token from tok where length(word) >= 7),
cut as (select lang, token, unnest(range(1, length(token) - 3)) as c from used),
h as (select lang, token, substr(token, c + 1) as head, substr(token, 1, c) as rest from cut),
s as (select h.lang, token, head, substr(rest, 1, length(rest) - length(link)) as stem from h, (values (''), ('s'), ('es'), ('n'), ('en'), ('e'), ('er')) l(link) where link = '' or ends_with(rest, link)),
found as (select distinct s.lang, token, head from s join lex a on a.lang = s.lang and a.word = s.head join lex b on b.lang = s.lang and b.word = s.stem where length(stem) >= 3)
select doc_id, string_agg(head, ' ' order by head) as search_extra from (select distinct doc_id, head from tok join found on tok.lang = found.lang and tok.word = found.token) group by doc_id
"""


@register(HEADS_SQL)
def compound_heads(spark, d):
    """Heads of the compounds in each text."""
    return cat.compound_heads(_names(spark, d), "doc_id").select("doc_id", "search_extra")


@register("with f as (select doc_id as id, source, lang from documents), a as (select conv_id as food_id, substr(role, 1, 2) as lang from conversations), t as (select source, lang, 2 as own, count(*) as covered from f where source <> 'off' and lang is not null and lang <> '' group by source, lang union all select f.source, a.lang, 1, count(distinct food_id) from a join f on f.id = a.food_id group by f.source, a.lang) select source, lang, max(own) as own, max(covered) as covered from t where covered * 100 >= 5 * (select count(*) from f g where g.source = t.source) group by source, lang")
def languages_by_source(spark, d):
    """Languages that cover five percent of a source or more."""
    foods_ = driver_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    aliases = driver_table(spark, d, "conversations").select(F.col("conv_id").alias("food_id"), F.substring("role", 1, 2).alias("lang"))
    return cat.languages_by_source(foods_, aliases, 5)


TITLE_SQL = "regexp_extract(html, '<title>(.*?)</title>', 1)"
CLEAN_SQL = f"trim(regexp_replace(regexp_replace({TITLE_SQL}, '&(?:amp|quot|apos|lt|gt|nbsp|#[0-9]+|#x[0-9a-fA-F]+);', ' ', 'g'), '\\s+', ' ', 'g'))"


@register(f"select page_id, case when length(n) between 2 and 120 and not regexp_matches(n, '(?i)https?://|www\\.') and regexp_matches(n, '\\p{{L}}') then n end as name from (select page_id, {CLEAN_SQL} as n from pages)")
def clean_names(spark, d):
    """Titles of pages as display names."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return driver_table(spark, d, "pages").select("page_id", text.clean_name(title).alias("name"))


@register("select quantile_cont(l_extendedprice, 0.25) as lower, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.999) as most from lineitem")
def price_quantiles(spark, d):
    """Exact quantiles of one group that holds every row, by refinement."""
    return hot.exact_quantiles(driver_table(spark, d, "lineitem"), [], "l_extendedprice", {"lower": 0.25, "median": 0.5, "most": 0.999}, few=64)


@register("select e.event_id, g.kcal from events e asof left join (select cast(ts as timestamp) as at, max(value) as kcal from events where event_type = 'signup' group by 1) g on cast(e.ts as timestamp) >= g.at where e.event_type <> 'signup'")
def asof_of_one_key(spark, d):
    """The last value set before each event, all events being one key's."""
    e = driver_table(spark, d, "events").withColumn("one", F.lit(1)).withColumn("at", F.col("ts").cast("timestamp"))
    sets = e.filter("event_type = 'signup'").select("one", F.col("at").alias("start"), F.col("value").alias("kcal"))
    rows = e.filter("event_type <> 'signup'").select("one", "at", "event_id")
    return hot.asof_over_ranges(rows, sets, by="one", on="at", start="start", value="kcal").select("event_id", "kcal")


@register("select event_type, hour(ts) as h, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.95) as p95 from events group by all")
def latency_summary(spark, d):
    """Median and 95th percentile of timings by batch: values of events stand for milliseconds."""
    e = driver_table(spark, d, "events").select("event_type", F.hour("ts").alias("h"), F.col("value").alias("ms"))
    return search.latency_summary(e, ["event_type", "h"])


NUTRIENT_SQL = "select user_id, log_date, case when ref_id % 7 <> 0 then calories end as value, ref_id % 5 = 0 as trace, ref_id % 11 = 0 as bounded from diary"


@register(with_views("select user_id, log_date, sum(value) as value, bool_or(value is null) as incomplete, bool_or(trace) as trace, case when bool_and(bounded or (value is not null and not trace)) and bool_or(bounded) then sum(case when bounded then coalesce(value, 0) + 1 else value end) end as upper from nn group by user_id, log_date", nn=NUTRIENT_SQL))
def nutrient_sums(spark, d):
    """Sums of a figure with gaps, traces and bounds by day."""
    e = v.diary(spark, d)
    value = F.when(F.col("ref_id") % 7 != 0, F.col("calories"))
    none = F.lit(None).cast("double")
    kinds = F.when(F.col("ref_id") % 5 == 0, F.array(F.lit("TRACE"))).otherwise(F.array().cast("array<string>"))
    fig = F.struct(value.alias("value"), kinds.alias("qualifiers"), F.lit(False).alias("incomplete"), none.alias("lower"), F.when(F.col("ref_id") % 11 == 0, F.coalesce(value, F.lit(0.0)) + 1).alias("upper"), F.lit(True).alias("lower_inclusive"), F.lit(True).alias("upper_inclusive"), F.lit("set").alias("dataset"))
    out = diary.nutrient_totals(e.select("user_id", "log_date", F.create_map(F.lit("PROTEIN"), fig).alias("nutrients")), ["user_id", "log_date"])
    return out.select("user_id", "log_date", "v.value", F.coalesce("v.incomplete", F.lit(False)).alias("i"), F.array_contains("v.qualifiers", "TRACE").alias("trace"), "v.upper").select("user_id", "log_date", "value", (F.col("i") | F.col("value").isNull()).alias("incomplete"), "trace", "upper")


@register(with_views("select id, user_id, log_date, calories, case when unit = 'g' then amount when unit = 'oz' then amount * 28.349523125::double when unit = 'ml' then amount * density else amount * 30 end as grams, case when unit = 'ml' and basis = 'ml' then amount when basis = 'ml' then case when unit = 'g' then amount when unit = 'oz' then amount * 28.349523125::double else amount * 30 end / density when unit = 'g' then amount when unit = 'oz' then amount * 28.349523125::double when unit = 'ml' then amount * density else amount * 30 end as basis_amount from u", u="select *, calories as amount, case ref_id % 4 when 0 then 'g' when 1 then 'oz' when 2 then 'ml' else 'portion' end as unit, case when ref_id % 3 = 0 then 'ml' else 'g' end as basis, 1.25::double as density from diary"))
def resolved_quantities(spark, d):
    """Amounts in grams and in the food's basis."""
    e = v.diary(spark, d)
    unit = F.when(F.col("ref_id") % 4 == 0, "g").when(F.col("ref_id") % 4 == 1, "oz").when(F.col("ref_id") % 4 == 2, "ml").otherwise("portion")
    q = nutrition.resolve_quantity(F.col("calories"), unit, F.when(F.col("ref_id") % 3 == 0, "ml").otherwise("g"), F.lit(1.25), F.lit(30.0))
    return e.select("id", "user_id", "log_date", "calories", q.alias("q")).select("id", "user_id", "log_date", "calories", "q.grams", "q.basis_amount")


@register("select c_custkey, coalesce(o.n, 0) as orders, coalesce(o.total, c_acctbal) as balance from customer left join (select o_custkey, count(*) as n, max(o_totalprice) as total from orders group by o_custkey) o on c_custkey = o_custkey union all select o_custkey, count(*), max(o_totalprice) from orders where o_custkey not in (select c_custkey from customer) group by o_custkey")
def upserted_rows(spark, d):
    """A table with the changes of another put in by key."""
    base = driver_table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("orders"), F.col("c_acctbal").alias("balance"))
    changes = driver_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("balance"))
    return maintain.upsert_by_key(base, changes, ["c_custkey"])


@register(with_views("select user_id, ref_id, max_by(created_at, created_at) as created_at from diary where ref_kind <> 'quick' group by user_id, ref_id having count(*) % 2 = 1"))
def toggled_favourites(spark, d):
    """Favourites after all events that set or clear them."""
    events = v.diary(spark, d).select("user_id", "ref_id", "created_at", F.col("ref_kind").alias("kind"))
    base = events.drop("kind").limit(0)
    return maintain.toggle(base, events, ["user_id", "ref_id"], "created_at")


@register("select l_orderkey, l_linenumber, count(*) as n from (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')) group by all")
def rows_after_delete(spark, d):
    """What stays when the rows of some keys are deleted."""
    lines = driver_table(spark, d, "lineitem")
    gone = driver_table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintain.delete_by(lines, gone, ["l_orderkey"])[0].groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@register(with_views("select c as \"check\", n, budget, n <= budget as passed from (select 'address in name' as c, count(*) filter (where regexp_matches(name, '(?i)https?://|www\\.')) as n, 0 as budget from foods union all select 'zero energy with macros', count(*) filter (where kcal = 0 and (protein > 0.5 or fat > 0.5)), 200 from foods union all select 'sodium above 45', count(*) filter (where sodium > 45), 0 from foods union all select 'sugar above carbs', count(*) filter (where sugar > carbs + 1), 0 from foods union all select 'energy out of range', count(*) filter (where kcal not between 0 and 900), 0 from foods union all select 'missing required figure', count(*) filter (where kcal is null or protein is null or fat is null or carbs is null), 0 from foods)"))
def audit_rows(spark, d):
    """Row checks of foods with their budgets."""
    checks = {k: c for k, c in audit.food_checks().items() if k in ("address in name", "zero energy with macros", "sodium above 45", "sugar above carbs", "energy out of range", "missing required figure")}
    return audit.row_checks(v.catalogue(spark, d), checks).withColumn("passed", F.col("n") <= F.col("budget"))


@register("with a as (select l_orderkey as k, l_linenumber as f, max(l_quantity) as v from lineitem where l_linestatus = 'F' group by all), b as (select l_orderkey as k, l_linenumber as f, max(l_quantity) as v from lineitem where l_linestatus = 'O' group by all) select coalesce(a.k, b.k) as k, coalesce(a.f, b.f) as f, a.v as expected, b.v as actual, case when b.k is null then 'missing' when a.k is null then 'unexpected' else 'differs' end as error from a full join b on a.k = b.k and a.f = b.f where a.k is null or b.k is null or abs(a.v - b.v) > 1e-14 * greatest(abs(a.v), abs(b.v))")
def reconciled_figures(spark, d):
    """Figures derived anew against those stored."""
    lines = driver_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("f"), "l_quantity", "l_linestatus")
    a, b = (lines.filter(F.col("l_linestatus") == s).groupBy("k", "f").agg(F.max("l_quantity").alias("value")) for s in ("F", "O"))
    return audit.reconcile_figures(a, b, ["k", "f"])


@register("select n_name, r_name, side from (select *, 'left' as side from (select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0 except all select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 0) union all select *, 'right' from (select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 0 except all select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0))")
def catalogue_diff(spark, d):
    """Rows of only one of two versions."""
    n = driver_table(spark, d, "nation").join(driver_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = (n.filter(F.col("n_nationkey") % k == 0).select("n_name", "r_name") for k in (2, 3))
    return tables.table_diff(a, b)


@register(with_views("select f.id, f.name, c.barcodes from foods f left join (select id, string_agg(distinct barcode, ';' order by barcode) as barcodes from foods where barcode is not null group by id) c on c.id = f.id where f.source = 'usda'"))
def licensed_export(spark, d):
    """One source's foods with their codes in one cell."""
    f = v.catalogue(spark, d)
    sub = cat.export_subset(f.select("id", "name", "source"), {"barcodes": f.filter("barcode is not null").select(F.col("id").alias("food_id"), "barcode")}, "usda")
    return cat.flat_export(sub["foods"], sub["barcodes"]).select("id", "name", "barcodes")


_CELL = "case when {0} is null then '' else '\"' || replace(case when regexp_matches({0}, '^[=+@\\t\\r-]') then concat('''', {0}) else {0} end, '\"', '\"\"') || '\"' end"


@register(
    with_views(
        "select id, concat_ws(',', cast(log_date as varchar), meal, " + _CELL.format("food") + ", " + _CELL.format("brand") + ", amount, '\"g\"', amount, cast(calories as varchar), '1.0', '2.0', '3.0', '\"g\"', amount, '', " + _CELL.format("credit") + ") as value from e",
        e="select *, case when h < 11 then 'breakfast' when h < 15 then 'lunch' when h < 17 then 'snack' when h < 21 then 'dinner' else 'snack' end as meal, case h % 4 when 0 then '=' || name when 1 then 'a \"b\", ' || name when 2 then '-' || name else name end as food, case when h % 3 = 0 then 'Acme' end as brand, cast(h as varchar) || '.5' as amount, case when h % 2 = 0 then 'credit, of it' end as credit from diary",
    )
)
def export_lines(spark, d):
    """Diary entries as lines of the CSV export."""
    e = v.diary(spark, d)
    n = F.col("h")
    food_name = F.when(n % 4 == 0, F.concat(F.lit("="), "name")).when(n % 4 == 1, F.concat(F.lit('a "b", '), "name")).when(n % 4 == 2, F.concat(F.lit("-"), "name")).otherwise(F.col("name"))
    amount = n + F.lit(0.5)
    rows = e.select(
        "id", F.col("log_date").alias("date"), F.upper(nutrition.meal_for_hour(n)).alias("meal"), food_name.alias("food_name"), F.when(n % 3 == 0, "Acme").alias("brand"), amount.alias("quantity"), F.lit("g").alias("unit"), amount.alias("grams"), "calories",
        F.lit(1.0).alias("protein_g"), F.lit(2.0).alias("fat_g"), F.lit(3.0).alias("carbs_g"), F.lit("g").alias("nutrition_basis"), amount.alias("basis_amount"), F.when(n % 2 == 0, "credit, of it").alias("source_credit"), "created_at",
    )
    return diary.export_lines(rows, keep=("id",))


CHANGES_SQL = "select user_id, log_date, count(*) filter (where h % 5 <> 0) as entries, sum(case when h % 5 <> 0 then case when h % 3 = 0 then calories * 2 else calories end else 0 end) as calories from diary group by user_id, log_date"


def _changes(events: DataFrame) -> DataFrame:
    """Entries logged, a third of them edited (doubled), a fifth deleted, as changes."""
    e = events.filter("event_type not in ('signup', 'error')").selectExpr("user_id", "cast(ts as date) as log_date", "hour(ts) as h", "value as calories")
    now = F.struct("user_id", "log_date", "calories")
    twice = F.struct("user_id", "log_date", (F.col("calories") * 2).alias("calories"))
    none = F.lit(None).cast("struct<user_id:bigint,log_date:date,calories:double>")
    steps = F.array_compact(F.array(F.struct(none.alias("old"), now.alias("new")), F.when(F.col("h") % 3 == 0, F.struct(now.alias("old"), twice.alias("new"))), F.when(F.col("h") % 5 == 0, F.struct(F.when(F.col("h") % 3 == 0, twice).otherwise(now).alias("old"), none.alias("new")))))
    return e.select(F.explode(steps).alias("c")).select("c.old", "c.new")


TOTALS_SQL = with_views(f"select user_id, log_date, entries, round(calories, 6) as calories from ({CHANGES_SQL})")


@register(TOTALS_SQL)
def totals_from_changes(spark, d):
    """Day totals from signed changes, as a batch."""
    out = live.live_day_totals(_changes(driver_table(spark, d, "events")), ["calories"], ["user_id", "log_date"])
    return out.select("user_id", "log_date", "entries", F.round("calories", 6).alias("calories"))


@register(TOTALS_SQL)
def live_totals(spark, d):
    """The same totals from a stream over the events, run until it has seen all of them."""
    out = f"{work_dir(spark)}/live-{uuid.uuid4().hex}"
    table = driver_table(spark, d, "events")
    single = table.inputFiles()[0].endswith("/events.parquet")  # a file, or a folder of files
    reader = spark.readStream.schema(table.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    totals = live.live_day_totals(_changes(stream), ["calories"], ["user_id", "log_date"])

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    run = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{out}/table").select("user_id", "log_date", "entries", F.round("calories", 6).alias("calories"))


@register(with_views("select id, case when (kcal > 5000 or protein > 1000 or fat > 1000 or carbs > 1000) then 1 else 0 end as over, case when kcal > 0 and (protein > 0 or fat > 0 or carbs > 0) and abs(kcal - (protein * 4 + fat * 9 + carbs * 4)) > greatest(35.0, kcal * 0.3) then floor(protein * 4 + fat * 9 + carbs * 4) end as suggested from foods"))
def entry_flags(spark, d):
    """Entries whose energy their macros don't give, with a suggestion."""
    f = v.catalogue(spark, d).select("id", nutrition.entry_flags(*[F.col(c) for c in MACROS]).alias("x"))
    return f.select("id", F.when(F.array_contains("x.flags", "implausible"), 1).otherwise(0).alias("over"), F.col("x.suggested_kcal").cast("double").alias("suggested"))


@register(with_views("select s.user_id, s.barcode, case when f.id is not null then 'bundled' end as kind, f.id from (select event_id, user_id, lpad(cast(event_id as varchar), 8, '0') as barcode from events) s left join (select barcode, min(id) as id from foods where barcode is not null group by barcode) f on f.barcode = s.barcode"))
def scanned_barcodes(spark, d):
    """The food of each scanned code."""
    scans = driver_table(spark, d, "events").select("user_id", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("barcode"))
    codes = v.catalogue(spark, d).filter("barcode is not null").select("barcode", F.col("id").alias("food_id"))
    custom = spark.createDataFrame([], "user_id long, barcode string, id long")
    return maintain.resolve_barcode(scans, codes, custom).select("user_id", "barcode", "kind", "id")


@register(
    with_views(
        "select w.id, string_agg(p.lang || ':' || p.alias, '|' order by p.late, p.pos) as aliases from win w join pick p using (k) group by w.id",
        ranked=RANKED_SQL,
        rows_="select *, lower(trim(name)) || '|' || lower(trim(coalesce(brand, ''))) || '|' || cast(floor(kcal / 50) as varchar) as k, popularity * 1000 + quality as pq, 'l' || cast(id % 5 as varchar) as al, name || ' ' || cast(id % 3 as varchar) as alias from ranked",
        rec="select *, pq > coalesce(max(pq) over (partition by k order by ord rows between unbounded preceding and 1 preceding), -1) as record from rows_",
        pick="select * from (select *, row_number() over (partition by k, lang order by late, pos) as n from (select k, al as lang, alias, case when record then 0 else 1 end as late, case when record then -ord else ord end as pos from rec)) where n = 1",
        win="select k, max_by(id, ord) as id from rec where record group by k",
    )
)
def merged_aliases(spark, d):
    """Foods with the names that their display group gathers: its best rows' own, the latest first, then the others' as they came."""
    alias = F.array(F.struct(F.concat(F.lit("l"), (F.col("id") % 5).cast("string")).alias("lang"), F.concat("name", F.lit(" "), (F.col("id") % 3).cast("string")).alias("name")))
    out = cat.merge_aliases(_ranked(spark, d).withColumn("aliases", alias))
    return out.select("id", F.array_join(F.transform("aliases", lambda a: F.concat(a["lang"], F.lit(":"), a["name"])), "|").alias("aliases"))


@register(with_views("select source, 'brand' as \"column\" from foods group by source having count(brand) = 0 union all select source, 'lang' from foods group by source having count(lang) = 0"))
def empty_columns(spark, d):
    """Columns without any value in a source."""
    return audit.empty_columns(v.catalogue(spark, d), ["brand", "lang"])
