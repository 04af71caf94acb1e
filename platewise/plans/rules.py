"""Registered queries of the column functions, on cells, names and figures that the driver tables hold or stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import foods as food
from ..functions import numbers, nutrition, text
from ..operators import audit, diary, tables
from ..operators import catalogue as cat
from ..sources.common import driver_table
from . import views as v
from .registry import MACROS, register, with_views

#: Line items as printed cells: limits, trace and missing marks, estimates in brackets, decimal commas.
_WHOLE = "cast(cast(l_quantity as int) as varchar(20))"
CELLS_SQL = (
    f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_suppkey % 9 when 0 then concat('<', {_WHOLE}) when 1 then 'TR' when 2 then '-' when 3 then concat(' ', {_WHOLE}, ',5 ') when 4 then 'n.d.' when 5 then '<LOQ' "
    f"when 6 then concat('(', {_WHOLE}, ')') when 7 then concat({_WHOLE}, '.2.1') else {_WHOLE} end as cell from lineitem"
)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """``lineitem`` as cells of text."""
    return spark.sql(CELLS_SQL.replace("from lineitem", "from {t}"), t=driver_table(spark, d, "lineitem"))


def _number(s: str) -> str:
    return f"case when regexp_matches({s}, '^[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(replace({s}, ',', '.') as double) end"


def _float(s: str) -> str:
    return f"case when {s} in ('', '-') then null when lower({s}) in ('trace', 'traces') then 0.0 when regexp_matches({s}, '^<\\s*[0-9.,]+$') then {_number(f'trim(substr({s}, 2))')} / 2 else {_number(s)} end"


@register(
    f"select l_orderkey, l_linenumber, {_float('s')} as plain, case when s = 'TR' then 0.0 when s in ('-', '<LOD', '<LOQ') then null else {_float('s')} end as german, case when s = 'tr.' then 0.0 when s = 'n.d.' then null else {_float('s')} end as swiss, "
    f"case when b = 'Tr' then 0.0 when b = 'N' then null else {_float('b')} end as uk from (select *, trim(cell) as s, regexp_replace(trim(cell), '^\\((.*)\\)$', '\\1') as b from ({CELLS_SQL}))"
)
def printed_figures(spark, d):
    """Cells as figures, plain and by the marks of three publishers."""
    c = F.col("cell")
    return cells(spark, d).select("l_orderkey", "l_linenumber", numbers.to_float(c).alias("plain"), *[numbers.parse_cell(c, k).alias(k) for k in ("german", "swiss", "uk")])


@register(
    "select l_orderkey, l_linenumber, v as value, case when s = '' then 'empty' when v is null then 'unusable' else 'ok' end as status, coalesce(v > 40, false) as implausible, coalesce(v < 8, false) as below "
    f"from (select *, case when regexp_matches(s, '^([0-9]+[.,]?[0-9]*|[.,][0-9]+)$') then try_cast(replace(s, ',', '.') as double) end as v from (select *, trim(cell) as s from ({CELLS_SQL})))"
)
def typed_numbers(spark, d):
    """Cells as typed numbers, with those that are questioned."""
    typed = numbers.parse_number(F.col("cell"))
    return cells(spark, d).select("l_orderkey", "l_linenumber", typed["value"].alias("value"), typed["status"].alias("status"), numbers.is_implausible(typed, 40).alias("implausible"), numbers.is_below(typed, 8).alias("below"))


_STRICT = "regexp_matches(digits, '^([0-9]+([.,][0-9]+)?|[.,][0-9]+)$')"


@register(
    "with p as (select l_orderkey, l_linenumber, trim(cell) as t, case when l_linenumber % 3 = 0 then 'mg' when l_linenumber % 3 = 1 then 'g' else 'kcal' end as unit from (" + CELLS_SQL + ")), "
    "q as (select *, regexp_extract(t, '^([<>]=?)', 1) as mark, trim(regexp_replace(t, '^[<>]=?', '')) as digits, lower(t) in ('tr', 'trace') as trace, case unit when 'g' then 1.0::double when 'mg' then 0.001::double end as scale from p), "
    f"r as (select *, case when scale is null then 'wrong unit' when t <> '' and not trace and not {_STRICT} then 'malformed figure' end as error, case when not trace and {_STRICT} then try_cast(replace(digits, ',', '.') as double) * scale end as v from q) "
    "select l_orderkey, l_linenumber, case when error is null then v end as value, case when error is null and mark = '<' then v end as upper, case when error is null then mark <> '<' end as upper_inclusive, "
    f"case when error is null then array_to_string(list_sort(list_filter(['AVERAGE', case when trace then 'TRACE' end, case when mark <> '' and {_STRICT} then 'BOUNDED' end], lambda x: x is not null)), ' ') end as qualifiers, error from r"
)
def strict_figures(spark, d):
    """Cells by the strict grammar: value, bound, qualifiers, or what is wrong."""
    n = F.col("l_linenumber") % 3
    unit = F.when(n == 0, "mg").when(n == 1, "g").otherwise("kcal")
    x = numbers.parse_nutrient(F.col("cell"), unit, F.lit("PROTEIN"), F.lit("AVERAGE"))
    return cells(spark, d).select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.value", "x.upper", "x.upper_inclusive", F.array_join("x.qualifiers", " ").alias("qualifiers"), "x.error")


def _figure(e: DataFrame) -> Column:
    value = F.when(F.col("ref_id") % 7 != 0, F.when(F.col("ref_id") % 5 == 0, 0.0).otherwise(F.col("calories")))
    kinds = F.when(F.col("ref_id") % 5 == 0, F.array(F.lit("TRACE"))).when(F.col("ref_id") % 11 == 0, F.array(F.lit("UNDECIDABLE"))).otherwise(F.array().cast("array<string>"))
    return F.struct(value.alias("value"), kinds.alias("qualifiers"), F.lit(False).alias("incomplete"), F.lit(0.0).alias("lower"), (value + 1).alias("upper"), F.lit(True).alias("lower_inclusive"), F.lit(False).alias("upper_inclusive"), F.lit("set").alias("dataset"))


_FIGURE = "select *, case when ref_id % 7 <> 0 then case when ref_id % 5 = 0 then 0.0 else calories end end as value, case when ref_id % 5 = 0 then 'TRACE' when ref_id % 11 = 0 then 'UNDECIDABLE' end as kind from diary"


@register(with_views("select id, case when kind is distinct from 'UNDECIDABLE' then value end as reported, kind is not distinct from 'UNDECIDABLE' or value is null as incomplete, kind is not null as qualified, kind is not distinct from 'TRACE' and value is not null and value = 0 as trace from fig", fig=_FIGURE))
def qualified_figures(spark, d):
    """What counts of a figure: its value, whether it is incomplete, qualified, or a trace."""
    e = v.diary(spark, d)
    x = e.select("id", _figure(e).alias("x"))
    return x.select("id", nutrition.reported(F.col("x")).alias("reported"), nutrition.is_incomplete(F.col("x")).alias("incomplete"), nutrition.is_qualified(F.col("x")).alias("qualified"), nutrition.is_trace(F.col("x")).alias("trace"))


@register(with_views("select id, value * (h * 10 / 100.0::double) as value, (value + 1) * (h * 10 / 100.0::double) as upper, h = 0 as closed from fig", fig=_FIGURE))
def scaled_figures(spark, d):
    """Figures and bounds per 100 for an amount, through the stored form and back."""
    e = v.diary(spark, d)
    m = F.create_map(F.lit("PROTEIN"), _figure(e))
    back = numbers.decode_nutrients(numbers.encode_nutrients(m))["nutrients"]
    scaled = nutrition.scale_nutrients(back, (F.col("h") * 10).cast("double"))
    return e.select("id", F.try_element_at(scaled, F.lit("PROTEIN")).alias("x")).select("id", "x.value", "x.upper", F.col("x.upper_inclusive").alias("closed"))


@register(with_views("select id, case when calories > 0 then 250.0::double * (h * 10) / calories end as corrected, case when t in ('bundled', 'custom') then t else 'quick' end as kind, case when t in ('bundled', 'custom') then ref_id end as ref from (select *, case h % 4 when 0 then 'bundled' when 1 then 'custom' when 2 then 'quick' else 'old' end as t from diary)"))
def corrected_entries(spark, d):
    """Stored figures after their amount was corrected, and what an entry refers to."""
    e = v.diary(spark, d)
    kind = F.when(F.col("h") % 4 == 0, "bundled").when(F.col("h") % 4 == 1, "custom").when(F.col("h") % 4 == 2, "quick").otherwise("old")
    ref = nutrition.food_ref(kind, F.col("ref_id"))
    return e.select("id", nutrition.rescale(F.lit(250.0), F.col("calories"), (F.col("h") * 10).cast("double")).alias("corrected"), ref["kind"].alias("kind"), ref["id"].alias("ref"))


_FOLD = "lower(replace(replace(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'))"


@register(f"select doc_id, md5({_FOLD}) as folded, md5(trim(regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')) as slug from documents where text is not null")
def folded_texts(spark, d):
    """Whole texts without case and marks, and as slugs."""
    docs = driver_table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(text.fold_name(F.col("text")).cast("binary")).alias("folded"), F.md5(text.slug(F.col("text")).cast("binary")).alias("slug"))


_AMERICAN = "concat(p_name, case p_partkey % 7 when 0 then ', eggplant' when 1 then ', skim milk' when 2 then ', Zucchini raw' when 3 then ' with shrimp' when 4 then ', ground beef' when 5 then ', aubergine eggplant' else '' end)"


@register(
    "select p_partkey, case when b <> n then b end as british from (select *, "
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(case when contains(lower(n), 'aubergine') then n else regexp_replace(n, '\\beggplant\\b', 'aubergine', 'g') end, '\\bground beef\\b', 'minced beef', 'g'), '\\bshrimp\\b', 'prawn', 'g'), '\\bskim\\b', 'skimmed', 'g'), '\\bZucchini\\b', 'Courgette', 'g') as b "
    f"from (select p_partkey, {_AMERICAN} as n from part))"
)
def british_names(spark, d):
    """American names in their British form."""
    p = spark.sql(f"select p_partkey, {_AMERICAN} as n from {{t}}", t=driver_table(spark, d, "part"))
    return p.select("p_partkey", text.british_name(F.col("n")).alias("british"))


@register("select p_partkey, case when p_partkey % 2 = 0 then concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) else p_name end as name from part")
def sentence_cased(spark, d):
    """Names in capitals in sentence case; others stay."""
    p = driver_table(spark, d, "part").withColumn("n", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return p.select("p_partkey", text.sentence_case(F.col("n")).alias("name"))


_TAGS = "concat(case when c_nationkey % 3 = 0 then 'en:france, ' else '' end, case c_nationkey % 5 when 0 then 'United Kingdom' when 1 then 'en:world' when 2 then 'nowhere' when 3 then 'Germany,en:united-kingdom' else '' end)"
_CODES = {"france": "FR", "germany": "DE", "united-kingdom": "UK", "world": "world"}


@register(
    "with t as (select c_custkey, list_filter(list_transform(str_split(tags, ','), lambda x: trim(x)), lambda x: x <> '') as parts from (select c_custkey, " + _TAGS + " as tags from customer)), "
    "s as (select c_custkey, parts, list_transform(parts, lambda x: map {'france': 'FR', 'germany': 'DE', 'united-kingdom': 'UK', 'world': 'world'}[case when starts_with(x, 'en:') then substr(x, 4) else regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g') end]) as codes from t) "
    "select c_custkey, array_to_string(list_filter(codes, lambda x: x is not null), ' ') as codes, array_to_string(list_filter(parts, lambda x, i: codes[i] is null), ' ') as unresolved, nullif(list_filter(codes, lambda x: x is not null)[1], 'world') as first from s"
)
def tagged_countries(spark, d):
    """Countries of a tag list, tags that are none, and the first country."""
    c = spark.sql(f"select c_custkey, {_TAGS} as tags from {{t}}", t=driver_table(spark, d, "customer"))
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    x = text.country_codes(F.col("tags"), codes)
    return c.select("c_custkey", F.array_join(x["codes"], " ").alias("codes"), F.array_join(x["unresolved"], " ").alias("unresolved"), text.first_country(F.col("tags"), codes).alias("first"))


_TABLE = "case " + " ".join(f"when '{code}' then '{s}'" for s, code in food.COUNTRY_OF_SOURCE.items()) + " else '' end"


@register(f"select n_nationkey, case case when code = 'GB' then 'UK' else code end {_TABLE.removeprefix('case ')} as source from (select n_nationkey, case n_nationkey % 6 when 0 then 'GB' when 1 then 'UK' when 2 then 'NL' when 3 then 'NZ' when 4 then 'BR' end as code from nation)")
def national_tables(spark, d):
    """The national table of a country."""
    code = F.get(F.array(*[F.lit(x) for x in ("GB", "UK", "NL", "NZ", "BR")]), (F.col("n_nationkey") % 6).cast("int"))
    return driver_table(spark, d, "nation").select("n_nationkey", food.national_source(code).alias("source"))


_SERVING = (
    "case p_partkey % 11 when 0 then '2 Tbsp' when 1 then 'Cups (240 ml)' when 2 then 'slice, thin' when 3 then '100 g' when 4 then '1,5 oz' when 5 then '250 ml' when 6 then 'Jar' when 7 then 'a very long description of it' when 8 then '' when 9 then 'g.' "
    "else 'portion' end"
)
_WORDS = {x: word for word, all_ in food.PORTIONS.items() for x in all_}
_WORD = "map {" + ", ".join(f"'{x}': '{w}'" for x, w in _WORDS.items()) + "}"
_PLACES = {**{w: i for i, w in enumerate(food.OFFERED_FIRST)}, **{w: 200 + i for i, w in enumerate(food.OFFERED_LAST)}}
_PLACE = "map {" + ", ".join(f"'{w}': {i}" for w, i in _PLACES.items()) + "}"
_UNITS = ", ".join(f"'{u}'" for u in food.UNIT_LABELS)


@register(
    f"select p_partkey, coalesce({_WORD}[lower(c)], {_WORD}[trim(str_split(lower(c), ',')[1])], case when length(c) between 1 and 24 then c end) as label, regexp_replace(lower(trim(s)), '\\.+$', '') not in ({_UNITS}) as named, coalesce({_PLACE}[lower(trim(s))], 100) as place, "
    "case when regexp_matches(s, '(?i)[0-9.,]+\\s*(ml|cl|dl|l|litres?|liters?)\\b') then null when trim(s) = '' then p_size::double when s = '100 g' then 100.0::double when s = '1,5 oz' then 1.5::double * 28.349523125::double end as grams "
    f"from (select p_partkey, p_size, {_SERVING} as s, trim(trim(regexp_replace({_SERVING}, '\\s*\\([^)]*\\)', '', 'g')), ',') as c from part)"
)
def serving_rules(spark, d):
    """Portions by one of the known words, whether they name a portion, their place and their grams."""
    p = spark.sql(f"select p_partkey, p_size, {_SERVING} as s from {{t}}", t=driver_table(spark, d, "part"))
    s = F.col("s")
    return p.select("p_partkey", food.serving_label(s).alias("label"), food.is_named_serving(s).alias("named"), food.serving_order(s).alias("place"), food.serving_grams(s, F.col("p_size").cast("double")).alias("grams"))


_LABELS = ("cup", "Medium", "slice", "jar", "serving", "tablespoon", "medium")


@register(
    "with l as (select distinct l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem), "
    f"s as (select l_orderkey, [{', '.join(map(repr, _LABELS))}][1 + l_partkey % 7] as label, l_quantity * 30 as grams, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as pos from l), "
    f"k as (select *, coalesce({_PLACE}[lower(label)], 100) as place from s where grams between 1 and 2000), f as (select *, row_number() over (partition by l_orderkey, lower(label) order by pos) as n from k), "
    "o as (select *, row_number() over (partition by l_orderkey order by place, pos) as offered from f where n = 1) select l_orderkey, offered, label, grams from o where offered <= 8"
)
def offered_servings(spark, d):
    """Portions of each order's items: the first of each label, in the order offered."""
    lines = driver_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % 7).cast("int"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", label.alias("label")))).alias("s"))
    servings = F.transform("s", lambda x: F.struct(x["label"].alias("label"), (x["l_quantity"] * 30).alias("grams")))
    out = rows.select("l_orderkey", F.posexplode(food.clean_servings(servings)).alias("at", "x"))
    return out.select("l_orderkey", (F.col("at") + 1).alias("offered"), "x.label", "x.grams")


_SPLIT = "[ \\t\\n\\r,;./\\\\|\\-_()\\[\\]{}:*+^\"''`!?&%#]"
_TITLE = "replace(replace(lower(strip_accents(regexp_extract(html, '<title>(.*?)</title>', 1))), 'ß', 'ss'), 'œ', 'oe')"


@register(f"select page_id, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array({_TITLE}, '{_SPLIT}'), lambda x: substr(regexp_replace(x, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), 1, 64)), lambda x: x <> '')[1:8], ' '), '') as tokens from pages")
def search_tokens(spark, d):
    """Titles of pages as search words."""
    title = text.fold_latin(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return driver_table(spark, d, "pages").select("page_id", F.array_join(text.query_tokens(title), " ").alias("tokens"))


@register("select event_id, replace(replace(replace(p, '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped, replace(replace(p, '%', ''), '_', '') as stripped from (select event_id, concat(event_type, '_', cast(user_id % 100 as varchar), '%\\') as p from events)")
def like_patterns(spark, d):
    """Text for LIKE patterns: escaped, and without wild cards."""
    e = driver_table(spark, d, "events").withColumn("p", F.concat("event_type", F.lit("_"), (F.col("user_id") % 100).cast("string"), F.lit("%\\")))
    return e.select("event_id", text.escape_like(F.col("p")).alias("escaped"), text.strip_like(F.col("p")).alias("stripped"))


@register(
    "select c_custkey, array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(list_concat(chosen, ['en']), lambda x: [x])), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end), ' ') as languages from (select c_custkey, "
    "case when c_custkey % 3 = 0 then ['nl', 'de'] when c_custkey % 3 = 1 then list_concat(case when app in ('de', 'fr') then [app] else [] end, ['de', 'fr']) else [app] end as chosen from (select c_custkey, case c_custkey % 4 when 0 then 'fr' when 1 then 'pt' when 2 then 'en' else 'de' end as app from customer))"
)
def reader_languages(spark, d):
    """Each reader's languages in order: what they chose, or else the app's and the table's, and English."""
    n = F.col("c_custkey")
    none = F.array().cast("array<string>")
    stored = F.when(n % 3 == 0, F.array(F.lit("nl"), F.lit("de"))).otherwise(none)
    app = F.when(n % 4 == 0, "fr").when(n % 4 == 1, "pt").when(n % 4 == 2, "en").otherwise("de")
    served = F.when(n % 3 == 1, F.array(F.lit("de"), F.lit("fr"))).otherwise(none)
    return driver_table(spark, d, "customer").select("c_custkey", F.array_join(nutrition.languages(stored, app, served), " ").alias("languages"))


@register(
    with_views(
        "select id, case when low in ('g', 'oz', 'ml') then low when low = 'cup' then 'portion' else 'g' end as unit, case when low = 'cup' then 240.0::double end as grams, case when low in ('g', 'oz', 'ml') then low when calories > 0 then 'portion' else 'g' end as lost_unit, "
        "case when low not in ('g', 'oz', 'ml') and calories > 0 then 500.0::double / calories end as lost_grams from (select *, lower(trim(case h % 5 when 0 then ' G' when 1 then 'oz' when 2 then 'ML' when 3 then 'Cup ' else 'bowl' end)) as low from diary)"
    )
)
def stored_units(spark, d):
    """Units of stored labels, of foods that are there and of foods that are gone."""
    e = v.diary(spark, d)
    n = F.col("h") % 5
    label = F.when(n == 0, " G").when(n == 1, "oz").when(n == 2, "ML").when(n == 3, "Cup ").otherwise("bowl")
    servings = F.array(F.struct(F.lit("cup").alias("label"), F.lit(240.0).alias("grams")))
    here, gone = nutrition.unit_from_label(label, servings), nutrition.unit_from_entry(label, F.col("calories"), F.lit(500.0))
    return e.select("id", here["unit"].alias("unit"), here["grams"].alias("grams"), gone["unit"].alias("lost_unit"), gone["grams"].alias("lost_grams"))


_FITS = "coalesce(kcal between 0 and 900 and protein between 0 and 100 and fat between 0 and 100 and carbs between 0 and 100 and protein + fat + carbs <= 105 and abs(kcal - (protein * 4 + fat * 9 + carbs * 4)) <= greatest(35.0, kcal * 0.3), false)"


@register(
    with_views(
        f"select id, {_FITS} as plausible, {_FITS} and kcal >= 1 and length(trim(name)) between 2 and 120 and (brand is null or length(trim(brand)) between 1 and 120) as offered, contains(tags, 'energy-value') or contains(tags, 'greater-than') as flagged, "
        "coalesce(kcal * 10 between 800 and 20000 and protein between 0 and 5000 and fat between 0 and 5000 and carbs between 0 and 5000, false) as goal, length(trim(name)) between 2 and 120 and kcal is not null and protein is not null as saved from f",
        f="select *, case id % 3 when 0 then 'en:energy-value-in-kcal' when 1 then 'en:protein-greater-than-1' else '' end as tags from foods",
    )
)
def acceptance_rules(spark, d):
    """What may be stored, offered upstream, set as a goal or saved."""
    f = v.catalogue(spark, d)
    m = [F.col(c) for c in MACROS]
    tags = F.when(F.col("id") % 3 == 0, "en:energy-value-in-kcal").when(F.col("id") % 3 == 1, "en:protein-greater-than-1").otherwise("")
    from ..operators.maintain import acceptable_custom

    return f.select(
        "id", food.plausible(*m).alias("plausible"), food.contributable(*m, F.col("name"), F.col("brand")).alias("offered"), food.upstream_error(tags).alias("flagged"), food.goal_allowed(m[0] * 10, *m[1:]).alias("goal"),
        acceptable_custom(F.col("name"), F.col("kcal"), F.col("protein").isNotNull()).alias("saved"),
    )


@register(with_views("select user_id, array_to_string(list_sort(list_distinct(list(s))), ' ') as datasets, array_to_string(list_transform(list_filter(list_sort(list_distinct(list(s))), lambda x: x <> 'own'), lambda x: 'credit of ' || x), ' ') as credit from (select user_id, case ref_id % 3 when 0 then 'nevo' when 1 then 'foodfiles' else 'own' end as s from diary) group by user_id having count(*) filter (where s <> 'own') > 0"))
def export_credits(spark, d):
    """Datasets of each user's figures and the credits that travel with them."""
    e = v.diary(spark, d)
    n = F.col("ref_id") % 3
    figure = _figure(e).withField("dataset", F.when(n == 0, "nevo").when(n == 1, "foodfiles").otherwise("own"))
    sets = diary.datasets_in(e.select("user_id", F.create_map(F.lit("PROTEIN"), figure).alias("nutrients")), ["user_id"])
    credits_ = spark.createDataFrame([("nevo", "credit of nevo"), ("foodfiles", "credit of foodfiles")], "dataset string, credit string")
    return sets.join(diary.export_credit(sets, credits_, ["user_id"]), "user_id").select("user_id", F.array_join("datasets", " ").alias("datasets"), "credit")


@register("select l_orderkey, case when count(distinct l_suppkey % 2) = 1 then max(l_suppkey % 2) end as density from lineitem group by l_orderkey")
def unique_densities(spark, d):
    """A key's value where all its rows agree."""
    rows = driver_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("density"))
    return tables.unique_or_null(rows, "l_orderkey", "density")


@register(
    with_views(
        "select id, case when promoted then concat('de ', name) else name end as name, case when promoted or source in ('bls', 'frida') then case source when 'bls' then 'de' when 'frida' then 'da' end else lang end as lang, case when promoted then concat('en:', name, case when id % 4 = 1 and id % 3 = 0 then concat('|fr:fr ', name) else '' end) else al end as aliases, "
        "case when promoted then 'promoted' when source in ('bls', 'frida') then 'already native' end as promotion from (select *, source = 'bls' and id % 2 = 1 as promoted, concat_ws('|', case when source = 'bls' and id % 2 = 1 then concat('de:de ', name) end, case when id % 3 = 0 then concat('fr:fr ', name) end) as al from foods)"
    )
)
def promoted_names(spark, d):
    """National rows with their own language's name first."""
    f = v.catalogue(spark, d)
    native = F.when((F.col("source") == "bls") & (F.col("id") % 2 == 1), F.struct(F.lit("de").alias("lang"), F.concat(F.lit("de "), "name").alias("name")))
    french = F.when(F.col("id") % 3 == 0, F.struct(F.lit("fr").alias("lang"), F.concat(F.lit("fr "), "name").alias("name")))
    out = cat.promote_native_names(f.withColumn("aliases", F.array_compact(F.array(native, french))))
    return out.select("id", "name", "lang", F.array_join(F.transform("aliases", lambda a: F.concat(a["lang"], F.lit(":"), a["name"])), "|").alias("aliases"), "promotion")


@register(with_views("select source, count(*) filter (where source = 'bls' and id % 2 = 1) as promoted, count(*) filter (where not (source = 'bls' and id % 2 = 1)) as already from foods where source in ('bls', 'frida') group by source"))
def promotion_counts(spark, d):
    """How many names of each national table were promoted."""
    f = v.catalogue(spark, d)
    native = F.when((F.col("source") == "bls") & (F.col("id") % 2 == 1), F.struct(F.lit("de").alias("lang"), F.concat(F.lit("de "), "name").alias("name")))
    return cat.promotion_report(cat.promote_native_names(f.withColumn("aliases", F.array_compact(F.array(native)))))


@register(with_views("select id, concat(name, ', ', case when id % 2 = 0 then 'eggplant' else 'egg' end) as name, case when id % 2 = 0 and source <> 'off' then concat(name, ', aubergine') end as british from foods"))
def british_aliases(spark, d):
    """British forms as last aliases of national rows."""
    f = v.catalogue(spark, d).withColumn("name", F.concat("name", F.lit(", "), F.when(F.col("id") % 2 == 0, "eggplant").otherwise("egg"))).withColumn("aliases", F.array().cast(cat.ALIASES))
    return cat.add_british_aliases(f).select("id", "name", F.get("aliases", F.lit(0))["name"].alias("british"))


@register(
    with_views(
        "select id, case source when 'usda' then 'US' when 'bls' then 'DE' when 'frida' then 'DK' end as country, case when source = 'off' then 1 else 0 end as source_rank, sodium, least(100, 40 + case when length(brand) > 0 then 10 else 0 end + case when id % 2 = 0 then 15 else 0 end + case when length(barcode) > 0 then 5 else 0 end + "
        "case when source <> 'off' then 20 else 0 end + case when coalesce(f, s, a, sodium) is not null then 5 else 0 end + case when length(name) >= 8 then 5 else 0 end) as quality from (select * replace (case when sodium between 0 and 45 then sodium end as sodium), case when fibre between 0 and 100 and fibre <= carbs + 100 then fibre end as f, "
        "case when sugar between 0 and 100 and sugar <= carbs + 1 then sugar end as s, case when saturated between 0 and 100 and saturated <= fat + 1 then saturated end as a from foods)"
    )
)
def assigned_foods(spark, d):
    """Foods with country, rank, quality and plausible minor figures."""
    f = v.catalogue(spark, d).withColumn("country", F.lit(None).cast("string")).withColumn("aliases", F.array().cast(cat.ALIASES))
    f = f.withColumn("servings", F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("cup").alias("label"), F.lit(1.0).alias("grams")))).otherwise(F.array().cast("array<struct<label:string,grams:double>>")))
    return cat.assign(f).select("id", "country", "source_rank", "sodium", "quality")


@register(with_views("select id, coalesce(protein, 0) * 4 + coalesce(fat, 0) * 9 + coalesce(carbs, 0) * 4 + coalesce(fibre, 0) * 2 + coalesce(sodium, 0) * 7 + coalesce(saturated, 0) * 3 - coalesce(sugar, 0) * 1.6::double as energy from foods"))
def explained_energies(spark, d):
    """Energy with fibre, alcohol, acids and polyols; other minor figures stand for the last three."""
    f = v.catalogue(spark, d)
    return f.select("id", audit.explained_energy(*[F.col(c) for c in ("protein", "fat", "carbs", "fibre", "sodium", "sugar", "saturated")]).alias("energy"))
