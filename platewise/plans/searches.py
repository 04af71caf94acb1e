"""Registered search queries: a batch of single and several-word queries over foods with aliases and compound heads.

The SQL says the whole search again: postings, BM25, the ladder of ten terms, rescue, borrowing, branded filler, merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, search
from ..operators import catalogue as cat
from ..sources.common import driver_table
from . import views as v
from .registry import register

FOODS_SQL = (
    "select p_partkey as id, case when p_partkey % 5 = 4 then concat(split_part(p_name, ' ', 2), 's, ', split_part(p_name, ' ', 1), ' ', lower(p_type)) when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then concat(p_name, ', ', lower(p_type)) else concat(lower(p_type), ' ', p_name) end as name, "
    "case when p_partkey % 4 = 0 then concat(split_part(p_name, ' ', 2), ', klein') when p_partkey % 4 = 1 then concat(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) else null end as a_de, case when p_partkey % 6 = 0 then concat('petit ', split_part(p_name, ' ', 2)) else null end as a_fr, "
    "case when p_partkey % 7 = 0 then split_part(p_name, ' ', 2) else null end as search_extra, p_brand as brand, case p_partkey % 5 when 0 then 'usda' when 1 then 'bls' when 2 then 'off' when 3 then 'frida' else 'nevo' end as source, "
    "case p_partkey % 5 when 0 then 'en' when 1 then 'de' when 2 then null when 3 then 'da' else 'nl' end as lang, cast(p_partkey % 3 as int) as basic_rank, p_size as quality, p_partkey % 2 = 0 as preferred from part"
)
#: Words of names, alone, cut short, in the plural, several, and written together.
WORDS_SQL = (
    "select distinct q from (select p_name as q from part union all select split_part(p_name, ' ', 2) from part union all select substr(split_part(p_name, ' ', 2), 1, 3) from part union all select concat(split_part(p_name, ' ', 2), 's') from part "
    "union all select concat(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) from part union all select concat(split_part(p_name, ' ', 2), ' ', lower(p_type)) from part) x"
)
READERS = {"bls": ["de", "en"], "nevo": ["nl", "de"], "": ["fr", "en"], "frida": ["da", "de"]}
SERVED = [("usda", "en", 1), ("bls", "de", 1), ("bls", "en", 2), ("frida", "da", 1), ("frida", "de", 2), ("nevo", "nl", 1)]
LIMIT = 12


def search_foods(spark: SparkSession, d: str) -> DataFrame:
    """``part`` as foods that a search reads."""
    return _as_foods(spark.sql(FOODS_SQL.replace("from part", "from {t}"), t=driver_table(spark, d, "part")))


def _as_foods(f: DataFrame) -> DataFrame:
    alias = [F.when(F.col(f"a_{x}").isNotNull(), F.struct(F.lit(x).alias("lang"), F.col(f"a_{x}").alias("name"))) for x in ("de", "fr")]
    bag = F.nullif(F.concat_ws("\n", "a_de", "a_fr"), F.lit(""))
    return f.withColumn("name_folded", F.lower("name")).withColumn("aliases", F.array_compact(F.array(*alias))).withColumn("alias_names", F.lower(bag)).select(*search.FOOD)


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every wording by readers of four tables."""
    words = spark.sql(WORDS_SQL.replace("from part", "from {t}"), t=driver_table(spark, d, "part"))
    readers = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.array(*map(F.lit, langs)).alias("languages")) for s, langs in READERS.items()]))
    asked = words.select("q", readers.alias("r")).select("q", "r.*")
    return asked.select(F.concat("source", F.lit(":"), "q").alias("query_id"), "q", F.split("q", " ").alias("tokens"), "source", "languages", F.lit(LIMIT).alias("limit"))


def served(spark: SparkSession) -> DataFrame:
    """Languages that tables serve, in order."""
    return spark.createDataFrame(SERVED, "source string, lang string, place int")


_FLAT = "concat(' ', regexp_replace(regexp_replace({c}, '{p}', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def _ladder(c: str, spaced: int) -> str:
    flat = _FLAT.format(c=c, p="[,-]")
    return (
        f"case when {c} = q or {c} = q || 's' then 0 when starts_with({c}, q || ',') or starts_with({c}, q || 's,') then 1 when starts_with({c}, q || ' ') or starts_with({c}, q || 's ') then {spaced} "
        f"when contains({flat}, ' ' || q || ' ') then 3 when contains({flat}, ' ' || q) then 4 else 5 end"
    )


_READERS = ", ".join(f"('{s}', {langs!r})" for s, langs in READERS.items())
BASE = f"""with foods as ({FOODS_SQL}),
food as (select *, lower(name) as n, lower(nullif(concat_ws(chr(10), a_de, a_fr), '')) as al from foods),
words as ({WORDS_SQL}),
base as (select r.s || ':' || q as query_id, q, str_split(q, ' ') as tokens, r.s as source, r.l as langs, {LIMIT} as lim, '' as head, case when r.s = 'nevo' then 'nevo' else '' end as lead from words, (values {_READERS}) r(s, l)),
post as (select id, col, word, count(*) as tf, any_value(dl) as dl from (
  select id, 'name' as col, unnest(t) as word, length(t) as dl from (select id, regexp_extract_all(n, '[a-z0-9]+') as t from food)
  union all select id, 'brand', unnest(t), length(t) from (select id, regexp_extract_all(lower(brand), '[a-z0-9]+') as t from food)
  union all select id, 'aliases', unnest(t), length(t) from (select id, regexp_extract_all(al, '[a-z0-9]+') as t from food where al is not null)
  union all select id, 'extra', unnest(t), length(t) from (select id, regexp_extract_all(search_extra, '[a-z0-9]+') as t from food where search_extra is not null)) group by id, col, word),
len as (select id, sum(dl) as len from (select distinct id, col, dl from post) group by id), stats as (select count(*) as rows, avg(len) as avg_len from len),
lex as (select source, lang, word from (select source, lang, unnest(regexp_extract_all(n, '[0-9a-z]+')) as word from food where source <> 'off') where length(word) between 3 and 12 group by all having count(*) >= 2)"""


def _match(name: str, queries: str) -> str:
    """CTEs: the bm25 of each query's matches, ``name(query_id, id, bm25)``."""
    return f""",
{name}_t as (select query_id, unnest(tokens) as token, length(tokens) as n from {queries}),
{name}_h as (select t.token, p.id, p.col, sum(p.tf) as tf from (select distinct token from {name}_t) t join post p on starts_with(p.word, t.token) group by all),
{name}_w as (select token, id, sum(tf * case col when 'name' then 5.0::double when 'brand' then 1.0 when 'aliases' then 3.0 else 0.0 end) as wtf from {name}_h group by all),
{name}_p as (select w.token, w.id, greatest(0.000001::double, ln((s.rows - d.df + 0.5) / (d.df + 0.5))) * w.wtf * 2.2 / (w.wtf + 1.2 * (0.25 + 0.75 * l.len / s.avg_len)) as part
  from {name}_w w join (select token, count(*) as df from {name}_w group by token) d on d.token = w.token join len l on l.id = w.id, stats s),
{name} as (select t.query_id, p.id, sum(part) as bm25 from {name}_t t join {name}_p p on p.token = t.token group by t.query_id, p.id, t.n having count(*) = t.n)"""


def _typed(w: str) -> str:
    return f"contains(' ' || q || ' ', ' ' || {w} || ' ')"


_HEAD = "str_split(replace(n, ',', ' '), ' ')[1]"
_LEAD = (
    f"(lead <> '' and f_source = lead and contains(q, ' ') and ({_typed(_HEAD)} or (ends_with({_HEAD}, 's') and {_typed(f'substr({_HEAD}, 1, length({_HEAD}) - 1)')}) or (ends_with({_HEAD}, 'en') and {_typed(f'substr({_HEAD}, 1, length({_HEAD}) - 2)')})))"
)
_ALIAS = "case when a_de is not null and list_contains(langs, 'de') and not (a_fr is not null and list_contains(langs, 'fr') and list_position(langs, 'fr') < list_position(langs, 'de')) then a_de when a_fr is not null and list_contains(langs, 'fr') then a_fr end"
_TIER = (
    f"least({_ladder('n', 2)}, {_ladder('al', 3)}, case when contains(' ' || search_extra || ' ', ' ' || q || ' ') then 3 else 5 end, case when alias = q or alias = q || 's' then 0 when starts_with(lower(alias), q || ',') or starts_with(lower(alias), q || 's,') then 1 else 5 end, "
    f"case when is_lead then 3 else 5 end)"
)


def _shelf(name: str, queries: str, scope: str, match: str) -> str:
    """CTEs: each query's best foods in scope, ``name(query_id, id, tier, place)``."""
    phrase = f"contains({_FLAT.format(c='n', p='[,()-]')}, ' ' || q || ' ')"
    return f""",
{name}_j as (select m.query_id, m.id, m.bm25, q.q, q.langs, q.lim, q.head, q.lead, f.n, f.al, f.a_de, f.a_fr, f.search_extra, f.source as f_source, f.lang, f.basic_rank, f.quality, f.preferred, f.name from {match} m join {queries} q using (query_id) join food f using (id) where {scope}),
{name}_k as (select *, {_ALIAS} as alias, coalesce({_LEAD}, false) as is_lead from {name}_j),
{name}_o as (select query_id, id, lim, {_TIER} as tier, case when list_contains(langs, lang) and lang <> 'en' and least({_ladder('n', 2)}, {_ladder('al', 2)}) <= 2 then 0 else 1 end as o1, case when is_lead and {phrase} then 0 when is_lead then 1 else 2 end as o3,
  case when preferred then 0 else 1 end as o4, case when head = '' or contains(' ' || regexp_replace(n, '[,-]', ' ', 'g') || ' ', ' ' || head || ' ') then 0 else 1 end as o5, basic_rank as o6, length(name) - length(replace(name, ' ', '')) as o7, length(name) as o8, round(bm25, 9) as o9, quality as o10 from {name}_k),
{name} as (select query_id, id, tier, place from (select *, row_number() over (partition by query_id order by o1, tier, o3, o4, o5, o6, o7, o8, o9 desc, o10 desc, id) as place from {name}_o) where place <= lim)"""


_MINE = "f.source <> 'off' and (q.source = '' or f.source = q.source)"
FIRST = _match("bm", "base") + _shelf("first", "base", _MINE, "bm")
_LINKS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(cat.LINKS))
_PLURALS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(cat.PLURALS))
_COMPOUND = ", ".join(f"'{x}'" for x in cat.COMPOUND_LANGS)
RESCUE = f""",
missed as (select query_id, source, q as token from base where query_id not in (select query_id from first where tier <= 2) and regexp_full_match(q, '[a-z0-9]+')),
tok as (select distinct source, token from missed),
cuts as (select source, token, c, substr(token, c + 1) as h, substr(token, 1, c) as rest from (select *, unnest(range(1, length(token) - 3)) as c from tok where length(token) >= 5)),
stems as (select source, token, c, l.i, h, substr(rest, 1, length(rest) - length(l.x)) as stem from cuts, (values {_LINKS}) l(i, x) where l.x = '' or ends_with(rest, l.x)),
split as (select source, token, stem, h from (select *, row_number() over (partition by source, token order by c, i) as k from stems s where length(stem) >= 3
  and exists (from lex x where x.source = s.source and x.word = s.h and x.lang in ({_COMPOUND})) and exists (from lex x where x.source = s.source and x.word = s.stem and x.lang in ({_COMPOUND}))) where k = 1),
ends as (select source, token, i, substr(token, 1, length(token) - length(e.x)) as stem from tok t, (values {_PLURALS}) e(i, x) where ends_with(token, e.x) and not exists (from lex x where x.source = t.source and x.word = t.token)),
single as (select source, token, stem from (select *, row_number() over (partition by source, token order by i) as k from ends s where length(stem) >= 3 and exists (from lex x where x.source = s.source and x.word = s.stem)) where k = 1),
other as (select m.query_id, coalesce(s.stem, p.stem) as q, coalesce(s.h, '') as head from missed m left join split s using (source, token) left join single p using (source, token) where coalesce(s.stem, p.stem) is not null)"""
_LENT = "select a.source, b.source as lender from (values {0}) a(source, lang, place) join (values {0}) b(source, lang, place) on a.lang = b.lang and a.place = 1 and a.source <> b.source".format(", ".join(map(str, SERVED)))
MERGE = (
    """,
again as (select b.query_id, o.q, [o.q] as tokens, b.source, b.langs, b.lim, o.head, b.lead from base b join other o using (query_id))"""
    + _match("bm2", "again")
    + _shelf("second", "again", _MINE, "bm2")
    + """,
now as (select * from base where query_id not in (select query_id from other) union all by name select * from again),
prime as (select * from first where query_id not in (select query_id from other) union all select * from second),
empty as (select * replace ('' as lead) from now where source <> '' and query_id not in (select query_id from prime)),
lent as ("""
    + _LENT
    + """)"""
    + _match("bm3", "now")
    + _shelf("borrowed", "empty", "exists (from lent where lent.source = q.source and lent.lender = f.source)", "bm3")
    + """,
filler as (select query_id, id, tier, place from (select *, row_number() over (partition by query_id order by tier, round(bm25, 9) desc, quality desc, id) as place from (select m.query_id, m.id, m.bm25, f.quality, q.lim, case when f.n = q.q then 0 when starts_with(f.n, q.q) then 1 else 2 end as tier from bm3 m join now q using (query_id) join food f using (id) where f.source = 'off')) where place <= lim),
merged as (select *, 0 as shelf from prime union all select *, 1 from borrowed union all select *, 2 from filler),
ranked as (select *, row_number() over (partition by query_id order by case when shelf = 2 then 2 when tier <= 2 then 0 else 1 end, shelf, case when shelf = 2 then 0 else tier end, place) as rank from merged)"""
)


@register(BASE + _match("bm", "base") + " select query_id, id, round(bm25, 6) as bm25 from bm")
def prefix_search(spark, d):
    """Foods that match every word of each query, with their BM25."""
    return search.prefix_matches(search_queries(spark, d), search.build_postings(search_foods(spark, d))).withColumn("bm25", F.round("bm25", 6))


@register(BASE + _match("bm", "base") + f", j as (select m.query_id, m.id, b.q, b.langs, b.lead, f.n, f.al, f.a_de, f.a_fr, f.search_extra, f.source as f_source from bm m join base b using (query_id) join food f using (id)), k as (select *, {_ALIAS} as alias, coalesce({_LEAD}, false) as is_lead from j) select query_id, id, {_TIER} as tier from k")
def match_tiers(spark, d):
    """How well each match fits its query, by the best of five arms."""
    q, f = search_queries(spark, d), search_foods(spark, d)
    hits = search.prefix_matches(q, search.build_postings(f)).select("query_id", "id")
    rows = hits.join(q.withColumnRenamed("source", "own"), "query_id").join(f.hint(search.NEVER_SENT), "id")
    lead = F.when(F.col("own").isin(*search.HEAD_FIRST), F.col("own")).otherwise("")
    return rows.select("query_id", "id", search.match_tier(F.col("q"), {c: F.col(c) for c in search.FOOD}, F.col("languages"), lead).alias("tier"))


def _first(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("source").isin(*search.HEAD_FIRST), F.col("source")).otherwise("")
    q = search_queries(spark, d).withColumn("head", F.lit("")).withColumn("lead_source", lead)
    f = search_foods(spark, d)
    return search.shelf(q, search.build_postings(f), f, search.one_source(F.col("source")))


@register(BASE + FIRST + " select query_id, id, tier, place from first")
def ranked_shelf(spark, d):
    """The reader's own table for each query, in the order of ten terms."""
    return _first(spark, d).select("query_id", "id", "tier", "place")


@register(BASE + _match("bm3", "base") + " select query_id, id, tier, place from (select *, row_number() over (partition by query_id order by tier, round(bm25, 9) desc, quality desc, id) as place from (select m.query_id, m.id, m.bm25, f.quality, q.lim, case when f.n = q.q then 0 when starts_with(f.n, q.q) then 1 else 2 end as tier from bm3 m join base q using (query_id) join food f using (id) where f.source = 'off')) where place <= lim")
def branded_results(spark, d):
    """Branded foods for each query."""
    f = search_foods(spark, d)
    return search.branded_shelf(search_queries(spark, d), search.build_postings(f), f)


@register(BASE + FIRST + RESCUE + " select query_id, q, head from other")
def rescued_queries(spark, d):
    """Other wording of queries that no name begins with: split compounds and singulars."""
    f = search_foods(spark, d)
    words = cat.lexicon(f.filter("source <> 'off'").select("source", "lang", F.col("name_folded").alias("folded")), ["source", "lang"])
    return search.rescue(search_queries(spark, d), _first(spark, d), words)


@register(
    f"with foods as ({FOODS_SQL}), alias as (select id, source, unnest([case when a_de is not null then 'de' end, case when a_fr is not null then 'fr' end]) as lang from foods where source <> 'off'), total as (select source, count(*) as total from foods group by source), "
    "covered as (select source, lang, 2 as own, count(*) as covered from foods where source <> 'off' and lang is not null group by source, lang union all select source, lang, 1, count(distinct id) from alias where lang is not null group by source, lang), "
    "fits as (select c.source, c.lang, max(c.own) as own, max(c.covered) as covered from covered c join total t using (source) where c.covered * 100 >= 5 * t.total group by c.source, c.lang), "
    "s as (select source, lang, row_number() over (partition by source order by own desc, covered desc, lang) as place from fits) select distinct a.source, b.source as lender from s a join s b on a.lang = b.lang and a.place = 1 and a.source <> b.source"
)
def table_lenders(spark, d):
    """Tables that lend to each other: those that serve the first language of a table's readers, as the foods and their aliases say."""
    foods = search_foods(spark, d)
    aliases = foods.select(F.col("id").alias("food_id"), F.explode("aliases").alias("a")).select("food_id", "a.lang")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("own"), F.desc("covered"), "lang"))
    return search.lenders(cat.languages_by_source(foods, aliases, 5).withColumn("place", place))


@register(BASE + FIRST + RESCUE + MERGE + f" select query_id, rank as place, id, shelf, tier from ranked where rank <= {LIMIT}")
def ranked_search(spark, d):
    """The whole search for a batch: own table, rescue, borrowed tables, branded filler."""
    return search.search(search_queries(spark, d), search_foods(spark, d), served(spark))


@register(
    BASE.replace(f"{LIMIT} as lim", f"case when length(q) > 7 then {LIMIT - 1} else {LIMIT} end as lim") + FIRST + RESCUE + MERGE
    + ", own as (select query_id, e.id from base join (select event_id % 50 as n, min(event_id) as id from events group by 1) e on e.n = length(q) where e.n > 7) "
    f"select query_id, 1 as place, id, -1 as shelf from own union all select r.query_id, r.rank + case when o.id is not null then 1 else 0 end, r.id, r.shelf from ranked r left join own o using (query_id) where r.rank <= {LIMIT} - case when o.id is not null then 1 else 0 end"
)
def search_with_custom_foods(spark, d):
    """The same search with each user's own foods in front; the tables fill what is left of the limit."""
    e = driver_table(spark, d, "events").groupBy((F.col("event_id") % 50).alias("n")).agg(F.min("event_id").alias("id"))
    q = search_queries(spark, d)
    own = q.join(F.broadcast(e), F.length("q") == F.col("n")).filter("n > 7").select("query_id", "id", F.lit(1).alias("place"))
    return search.search(q, search_foods(spark, d), served(spark), own).select("query_id", "place", "id", "shelf")


@register(
    BASE + FIRST + RESCUE + MERGE + f", judged as (select query_id, '^' || q as good, 'klein|anvils' as bad, case when source = 'frida' and length(q) > 9 then 1 else 0 end as none from base), "
    f"top as (select j.query_id, j.none, f.name, j.good, j.bad from judged j left join (select * from ranked where rank <= 5) r using (query_id) left join food f using (id)) "
    "select query_id, case when max(none) = 1 then 'no row expected' when bool_or(coalesce(regexp_matches(name, good), false)) and not bool_or(coalesce(regexp_matches(name, bad), false)) then 'pass' else 'fail' end as verdict from top group by query_id"
)
def relevance_report(spark, d):
    """Judged queries over the search's first five results."""
    q, f = search_queries(spark, d), search_foods(spark, d)
    found = search.search(q, f, served(spark)).join(f.select("id", "name").hint(search.NEVER_SENT), "id")
    good = F.when(~((F.col("source") == "frida") & (F.length("q") > 9)), F.concat(F.lit("^"), "q"))
    return search.evaluate(found.select("query_id", "place", "name"), q.select("query_id", good.alias("acceptable"), F.lit("klein|anvils").alias("unacceptable")), 5)


@register(BASE + ", r as (select *, case id % 3 when 0 then ['de', 'fr'] when 1 then ['fr'] else ['en', 'de'] end as langs from food) select id, coalesce(case when a_de is not null and list_contains(langs, 'de') and (lang is null or not list_contains(langs, lang) or list_position(langs, 'de') < list_position(langs, lang)) then a_de when a_fr is not null and list_contains(langs, 'fr') and (lang is null or not list_contains(langs, lang) or list_position(langs, 'fr') < list_position(langs, lang)) then a_fr end, name) as shown from r")
def reader_names(spark, d):
    """Names of foods as three kinds of readers see them."""
    langs = F.when(F.col("id") % 3 == 0, F.array(F.lit("de"), F.lit("fr"))).when(F.col("id") % 3 == 1, F.array(F.lit("fr"))).otherwise(F.array(F.lit("en"), F.lit("de")))
    return search_foods(spark, d).select("id", search.display_name(F.col("name"), F.col("lang"), F.col("aliases"), langs).alias("shown"))


@register(
    f"with diary as ({v.DIARY_SQL}), r as (select user_id, h as query_id, ref_id as id, min(id) as place from diary group by all), f as (select distinct user_id, ref_id as id from diary where h < 3), c as (select distinct user_id, ref_id as id from diary where h > 20) "
    "select user_id, query_id, id, row_number() over (partition by user_id, query_id order by case when f.id is not null then 0 when c.id is not null then 1 else 2 end, place) as place from r left join f using (user_id, id) left join c using (user_id, id)"
)
def known_foods_first(spark, d):
    """Results with a user's favourites in front, then recent foods."""
    e = v.diary(spark, d)
    results = e.groupBy("user_id", F.col("h").alias("query_id"), F.col("ref_id").alias("id")).agg(F.min("id").alias("place"))
    own = e.select("user_id", F.col("ref_id").alias("id"), "h")
    return search.boost(results, own.filter("h < 3"), own.filter("h > 20")).select("user_id", "query_id", "id", "place")


@register(
    BASE + _match("bm", "base") + _shelf("top", "base", "f.source <> 'off' and q.source = ''", "bm") + " select t.query_id, contains(f.n, str_split(b.q, ' ')[1]) or coalesce(contains(f.al, str_split(b.q, ' ')[1]), false) as named, f.basic_rank < 2 as plain from top t join base b using (query_id) join food f using (id) where t.place = 1"
)
def rank_probes(spark, d):
    """Whether the first result of each wording bears its first word, and is no derivative."""
    f = search_foods(spark, d)
    q = search_queries(spark, d).filter("source = ''").withColumn("head", F.lit("")).withColumn("lead_source", F.lit(""))
    top = search.shelf(q, search.build_postings(f), f, search.national()).filter("place = 1")
    best = top.select("query_id", "id").join(f.hint(search.NEVER_SENT), "id").join(q.select("query_id", "q"), "query_id")
    head = F.get(F.split("q", " "), F.lit(0))
    return best.select("query_id", audit.bears_word(F.col("name_folded"), F.col("alias_names"), head).alias("named"), (F.col("basic_rank") < 2).alias("plain"))


PINNED = (*audit.WHOLE_FOODS, *audit.MADE_FOODS)
_WORD = "case p_partkey % 17 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(PINNED)) + " end"
PINNED_FOODS_SQL = (
    f"select p_partkey as id, case when p_partkey % 2 = 0 then concat({_WORD}, ', ', lower(p_type)) when p_partkey % 3 = 0 then concat({_WORD}, ' ', lower(p_type)) else concat(lower(p_type), ' ', {_WORD}) end as name, cast(null as varchar(20)) as a_de, "
    f"case when p_partkey % 4 = 0 then concat({_WORD}, ' fr') else null end as a_fr, cast(null as varchar(20)) as search_extra, p_brand as brand, case when p_partkey % 5 = 2 then 'off' else 'usda' end as source, 'en' as lang, cast(p_size % 3 as int) as basic_rank, p_size as quality, p_partkey % 2 = 0 as preferred from part"
)


@register(
    BASE.replace(FOODS_SQL, PINNED_FOODS_SQL).replace(WORDS_SQL, "select unnest([" + ", ".join(f"'{w}'" for w in PINNED) + "]) as q").replace(_READERS, "('', [])").replace("as langs", "::varchar[] as langs") + _match("bm", "base") + _shelf("top", "base", "f.source <> 'off'", "bm")
    + " select b.q as query_id, t.id, coalesce((contains(f.n, str_split(b.q, ' ')[1]) or coalesce(contains(f.al, str_split(b.q, ' ')[1]), false)) and (f.basic_rank < 2 or b.q in (" + ", ".join(f"'{w}'" for w in audit.MADE_FOODS) + ")), false) as passed from base b left join (select * from top where place = 1) t using (query_id) left join food f using (id)"
)
def pinned_probes(spark, d):
    """The seventeen pinned words over foods of these names: whether the first result is the food that is asked for."""
    f = spark.sql(PINNED_FOODS_SQL.replace("from part", "from {t}"), t=driver_table(spark, d, "part"))
    foods = _as_foods(f)
    return audit.rank_probes(foods, search.build_postings(foods))
