"""The catalogue: display groups, merged names, lexicon, compound heads, promotion, selection, writing, export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.foods import COUNTRY_OF_SOURCE, basic_rank, clean_micros, display_key, quality_score, rank_name, source_rank
from ..functions.text import british_name, fold_name
from .tables import ContractError, assert_empty, assert_unique, content_digest

ALIASES = "array<struct<lang:string,name:string>>"
#: The language of a national table's own names; languages that write compounds; links inside compounds.
NATIVE_LANG = {"ciqual": "fr", "bls": "de", "bedca": "es", "matvaretabellen": "nb", "livsmedel": "sv", "fineli": "fi", "frida": "da", "swiss": "de"}
COMPOUND_LANGS = ("da", "nb", "sv", "de", "fi")
LINKS = ("", "s", "es", "n", "en", "e", "er")
PLURALS = ("s", "es", "t", "er", "en", "ter", "n")
#: Sources whose display choice is derived apart from the others.
APART = ("foodfiles",)


def display_groups(foods: DataFrame, keys: list[Column] | None = None) -> DataFrame:
    """Add ``winner_id``: of each display key the food of most popularity, then quality, the earliest (``ord``) of equals.

    All members stay. ``foods``: ``id, name, brand, kcal, popularity, quality, ord``. The winner comes from an aggregate,
    joined back; adaptive execution splits a hot key.
    """
    keyed = foods.withColumn("__key", F.struct(*(keys or []), display_key(F.col("name"), F.col("brand"), F.col("kcal"))))
    best = keyed.groupBy("__key").agg(F.max_by("id", F.struct("popularity", "quality", -F.col("ord"))).alias("winner_id"))
    return keyed.join(best, "__key").drop("__key")


def _fold(rows: Column) -> Column:
    """Names that a group's winner ends up with, as a sequential fold over ``rows`` in order of arrival.

    The incumbent keeps its aliases and takes the loser's: one for each language, none equal to the winner's name. A
    newcomer that outranks the incumbent takes over and gets the incumbent's aliases in turn.
    """

    def take(winner: Column, loser: Column) -> Column:
        return F.aggregate(loser["aliases"], winner["aliases"], lambda have, a: F.when((a["name"] == winner["name"]) | F.exists(have, lambda h: h["lang"] == a["lang"]), have).otherwise(F.concat(have, F.array(a))))

    def step(now: Column, new: Column) -> Column:
        better = F.struct(new["popularity"], new["quality"]) > F.struct(now["popularity"], now["quality"])
        return F.when(better, new.withField("aliases", take(new, now))).otherwise(now.withField("aliases", take(now, new)))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), step)


#: Rows of a display group, by their order of arrival, whose best is found together.
STRIDE = 4096


def _incumbents(rows: DataFrame) -> DataFrame:
    """Add ``now``: of each row's group the best (popularity, quality, the earliest of equals) up to and with it, in order of arrival.

    A group is cut into strides of ``ord``; the best before a stride comes from one row a stride, the rest from the stride
    itself. So a group of very many rows is never in one task.
    """
    me = F.struct("popularity", "quality", (-F.col("ord")).alias("back"), "name")
    cut = rows.withColumn("__me", me).withColumn("__stride", F.floor(F.col("ord") / STRIDE))
    best = cut.groupBy("k", "__stride").agg(F.max("__me").alias("m"))
    before = Window.partitionBy("k").orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("k", "__stride").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    met = cut.join(best.select("k", "__stride", F.max("m").over(before).alias("__before")), ["k", "__stride"])
    return met.withColumn("__inside", F.max("__me").over(inside)).withColumn("now", F.greatest("__before", "__inside")).drop("__me", "__stride", "__before", "__inside")


def merge_aliases(foods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One winner for each display key (within ``by``, such as ``source``) with the aliases its group gathers.

    The fold depends on the order of arrival (``ord``, unique). Only what can matter is gathered: the rows that beat all
    before them, and between two of these the first usable name of each language. Popularity and quality are not null.
    """
    key = F.struct(*(by or []), display_key(F.col("name"), F.col("brand"), F.col("kcal")))
    rows = foods.select(key.alias("k"), F.col("ord").cast("long").alias("ord"), F.col("id").cast("long").alias("id"), "name", F.col("popularity").cast("int").alias("popularity"), F.col("quality").cast("int").alias("quality"), F.coalesce("aliases", F.array().cast(ALIASES)).alias("aliases"))
    now = _incumbents(rows)
    mine = -F.col("now.back")
    best = now.filter(F.col("ord") == mine).select("k", "ord", "id", "name", "popularity", "quality", "aliases")
    given = now.filter(F.col("ord") != mine).select("k", mine.alias("reign"), "now", "ord", F.posexplode("aliases").alias("at", "a")).filter(F.col("a.name") != F.col("now.name"))
    first = given.groupBy("k", "reign", F.col("a.lang").alias("lang")).agg(F.min(F.struct("ord", "at", "a")).alias("f"))
    losers = first.select("k", F.col("f.ord").alias("ord"), F.col("f.at").alias("at"), F.lit(None).cast("long").alias("id"), F.lit("").alias("name"), F.lit(-1).alias("popularity"), F.lit(-1).alias("quality"), F.array("f.a").cast(ALIASES).alias("aliases"))
    both = best.withColumn("at", F.lit(-1)).unionByName(losers)
    row = F.struct("ord", "at", "id", "name", "popularity", "quality", "aliases")
    merged = both.groupBy("k").agg(_fold(F.array_sort(F.collect_list(row))).alias("w")).select(F.col("w.id").alias("id"), F.col("w.aliases").alias("merged"))
    return foods.join(merged, "id").withColumn("aliases", F.col("merged")).drop("merged")


def promote_native_names(foods: DataFrame) -> DataFrame:
    """Each national table's own language becomes the name's: the native alias swaps with the name, which becomes the first
    English alias. Adds ``promotion``: promoted, already native, or null for other sources."""
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in NATIVE_LANG.items() for x in kv]), F.col("source"))
    native = F.get(F.filter("aliases", lambda a: a["lang"] == target), F.lit(0))["name"]
    rest = F.filter("aliases", lambda a: ~a["lang"].isin("en") & (a["lang"] != target))
    english = F.when((F.col("name") != native) & (F.col("name") != ""), F.array(F.struct(F.lit("en").alias("lang"), F.col("name").alias("name")))).otherwise(F.array().cast(ALIASES))
    staged = foods.withColumn("__t", target).withColumn("__n", native).withColumn("__a", F.filter(F.concat(english, rest), lambda a: a["name"] != native))
    out = staged.withColumn("aliases", F.when(F.col("__n").isNotNull(), F.col("__a")).otherwise(F.col("aliases"))).withColumn("name", F.coalesce("__n", "name")).withColumn("lang", F.coalesce("__t", "lang"))
    return out.withColumn("promotion", F.when(F.col("__n").isNotNull(), "promoted").when(F.col("__t").isNotNull(), "already native")).drop("__t", "__n", "__a")


def promotion_report(promoted: DataFrame) -> DataFrame:
    """Promoted and already native names by source."""
    return promoted.filter("promotion is not null").groupBy("source").agg(F.count_if(F.col("promotion") == "promoted").alias("promoted"), F.count_if(F.col("promotion") == "already native").alias("already"))


def representatives(foods: DataFrame) -> DataFrame:
    """Display representatives of each national table, native names promoted: merged within the source before and after."""
    return merge_aliases(promote_native_names(merge_aliases(foods, ["source"])).drop("promotion"), ["source"])


def preferred_ids(foods: DataFrame) -> DataFrame:
    """Ids of the established choice among equal matches of all sources, some sources apart."""
    apart = F.when(F.col("source").isin(*APART), F.col("source")).otherwise("")
    named = foods.withColumn("__family", apart)
    return merge_aliases(promote_native_names(merge_aliases(named, ["__family"])).drop("promotion"), ["__family"]).select("id").distinct()


def add_british_aliases(foods: DataFrame, skip: tuple[str, ...] = ("off", "cofid", "tca")) -> DataFrame:
    """National rows get their British form as a last alias ``en-GB``, where there is one."""
    extra = F.array(F.struct(F.lit("en-GB").alias("lang"), F.col("__gb").alias("name")))
    staged = foods.withColumn("__gb", F.when(~F.col("source").isin(*skip), british_name(F.col("name"))))
    return staged.withColumn("aliases", F.when(F.col("__gb").isNotNull(), F.concat("aliases", extra)).otherwise(F.col("aliases"))).drop("__gb")


def assign(foods: DataFrame) -> DataFrame:
    """Add country, ranks and quality, and drop implausible minor figures. A source that isn't known fails."""
    unknown = foods.filter(~F.col("source").isin(*COUNTRY_OF_SOURCE, "off")).select("source").distinct().limit(3).collect()
    if unknown:
        raise ContractError(f"unknown sources {[r[0] for r in unknown]}")
    country = F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTRY_OF_SOURCE.items() for x in kv]), F.col("source"))
    micros = clean_micros(*[F.col(c) for c in ("fat", "carbs", "fibre", "sugar", "saturated", "sodium")])
    out = foods.withColumn("__m", micros).withColumns({c: F.col(f"__m.{c}") for c in ("fibre", "sugar", "saturated", "sodium")}).drop("__m")
    some = F.coalesce("fibre", "sugar", "saturated", "sodium").isNotNull()
    return out.withColumns({
        "country": F.coalesce(country, "country"), "source_rank": source_rank(F.col("source")),
        "basic_rank": basic_rank(rank_name(F.col("source"), F.col("name"), F.col("aliases")), F.col("source"), F.col("nova")),
        "quality": quality_score(F.col("brand"), F.size("servings") > 0, F.col("barcode"), F.col("source"), some, F.col("name")),
    })


def tokens_of(folded: Column) -> Column:
    """Runs of plain letters and digits."""
    return F.regexp_extract_all(folded, F.lit("([0-9a-z]+)"), F.lit(1))


def lexicon(names: DataFrame, by: list[str], folded: str = "folded") -> DataFrame:
    """Words (3 to 12 letters) that occur at least twice in the folded names of each group."""
    words = names.select(*by, F.explode(tokens_of(F.col(folded))).alias("word")).filter(F.length("word").between(3, 12))
    return words.groupBy(*by, "word").agg(F.count("*").alias("n")).filter("n >= 2")


def _cuts(tokens: DataFrame, token: str) -> DataFrame:
    """All ways to see a token as stem, link and head: ``cut, link_at, head, stem``."""
    cut = F.explode(F.sequence(F.lit(1), F.length(token) - 4))
    heads = tokens.filter(F.length(token) >= 5).withColumn("cut", cut).withColumn("head", F.expr(f"substring({token}, cut + 1)")).withColumn("rest", F.expr(f"substring({token}, 1, cut)"))
    stems = F.array(*[F.when(F.lit(link == "") | F.endswith("rest", F.lit(link)), F.struct(F.lit(i).alias("link_at"), F.expr(f"substring(rest, 1, length(rest) - {len(link)})").alias("stem"))) for i, link in enumerate(LINKS)])
    found = heads.withColumn("s", F.explode(F.filter(stems, lambda s: s.isNotNull()))).select("*", "s.link_at", "s.stem").drop("s", "rest")
    return found.filter(F.length("stem") >= 3)


def compound_heads(names: DataFrame, id_col: str = "id", folded: str = "folded") -> DataFrame:
    """``id, search_extra``: the heads of all compounds in a food's name, by the words of its language.

    ``names``: ``id, lang, folded``. Each distinct token is split once, not once for each food; words join on both halves.
    """
    known = lexicon(names.filter(F.col("lang").isin(*COMPOUND_LANGS)), ["lang"], folded).select("lang", "word")
    used = names.filter(F.col("lang").isin(*COMPOUND_LANGS)).select(id_col, "lang", F.explode(F.array_distinct(tokens_of(F.col(folded)))).alias("token")).filter(F.length("token") >= 7)
    split = _cuts(used.select("lang", "token").distinct(), "token")
    heads = split.join(known.withColumnRenamed("word", "head"), ["lang", "head"], "left_semi").join(known.withColumnRenamed("word", "stem"), ["lang", "stem"], "left_semi").select("lang", "token", "head").distinct()
    return used.join(heads, ["lang", "token"]).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("head")), " ").alias("search_extra"))


def split_compounds(tokens: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """``stem, head`` for each query token: the longest head, then the first link, both halves among the group's words."""
    found = _cuts(tokens.select(*by, "token").distinct(), "token").join(words.withColumnRenamed("word", "head"), [*by, "head"], "left_semi").join(words.withColumnRenamed("word", "stem"), [*by, "stem"], "left_semi")
    return found.groupBy(*by, "token").agg(F.min_by(F.struct("stem", "head"), F.struct("cut", "link_at")).alias("s")).select(*by, "token", "s.stem", "s.head")


def depluralize(tokens: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """``stem`` for each query token that isn't a word itself: the first ending whose stem (3 letters or more) is one."""
    new = tokens.select(*by, "token").distinct().join(words.withColumnRenamed("word", "token"), [*by, "token"], "left_anti")
    stems = F.array(*[F.when(F.endswith("token", F.lit(e)), F.struct(F.lit(i).alias("at"), F.expr(f"substring(token, 1, length(token) - {len(e)})").alias("stem"))) for i, e in enumerate(PLURALS)])
    tried = new.withColumn("s", F.explode(F.filter(stems, lambda s: s.isNotNull()))).select(*by, "token", "s.at", "s.stem").filter(F.length("stem") >= 3)
    return tried.join(words.withColumnRenamed("word", "stem"), [*by, "stem"], "left_semi").groupBy(*by, "token").agg(F.min_by("stem", "at").alias("stem"))


def languages_by_source(foods: DataFrame, aliases: DataFrame, min_percent: float) -> DataFrame:
    """``source, lang, own, covered`` of languages that cover enough of a source: its own (2) or by aliases (1)."""
    national = foods.filter("source <> 'off'")
    own = national.filter("lang is not null and lang <> ''").groupBy("source", "lang").agg(F.lit(2).alias("own"), F.count("*").alias("covered"))
    other = aliases.filter(F.locate("-", "lang") == 0).withColumnRenamed("lang", "alias_lang").join(national.select(F.col("id").alias("food_id"), "source"), "food_id").groupBy("source", F.col("alias_lang").alias("lang")).agg(F.lit(1).alias("own"), F.count_distinct("food_id").alias("covered"))
    total = foods.groupBy("source").agg(F.count("*").alias("total"))
    fits = own.unionByName(other).join(total, "source").filter(F.col("covered") * 100 >= min_percent * F.col("total"))
    return fits.groupBy("source", "lang").agg(F.max("own").alias("own"), F.max("covered").alias("covered"))


def select_catalogue(generic: DataFrame, branded: DataFrame, min_scans: int, limit: int) -> DataFrame:
    """``id, source, search``: national rows and all members of the most popular branded groups whose winner reaches the floor.

    ``generic`` has ``shown`` (a display representative). ``limit`` counts groups: the feature itself, applied to winners.
    """
    grouped = display_groups(branded)
    key = display_key(F.col("name"), F.col("brand"), F.col("kcal"))
    taken = generic.filter("shown").select(key.alias("__k")).distinct()
    winners = grouped.filter((F.col("id") == F.col("winner_id")) & (F.col("popularity") >= min_scans)).orderBy(F.desc("popularity"), F.desc("quality"), "ord").limit(limit)
    shown = winners.withColumn("__k", key).join(taken.withColumn("__t", F.lit(True)), "__k", "left").select("winner_id", F.col("__t").isNull().alias("free"))
    members = grouped.join(shown, "winner_id").select("id", "source", ((F.col("id") == F.col("winner_id")) & F.col("free")).alias("search"))
    return generic.select("id", "source", F.col("shown").alias("search")).union(members)


def search_counts(selected: DataFrame) -> DataFrame:
    """Source records and search rows, by source."""
    return selected.groupBy("source").agg(F.count("*").alias("records"), F.count_if("search").alias("rows"))


def children(foods: DataFrame) -> dict[str, DataFrame]:
    """The catalogue's child tables from nested foods: aliases in order, barcodes, servings with the first as default."""
    return {
        "aliases": foods.select(F.col("id").alias("food_id"), F.posexplode("aliases").alias("ord", "a")).select("food_id", "ord", "a.lang", "a.name"),
        "barcodes": foods.filter("barcode is not null").select("barcode", F.col("id").alias("food_id")),
        "servings": foods.select(F.col("id").alias("food_id"), F.posexplode("servings").alias("sort_order", "s")).select("food_id", "sort_order", "s.label", "s.grams", (F.col("sort_order") == 0).alias("is_default")),
    }


def write_catalogue(foods: DataFrame, members: DataFrame, path: str, version: str) -> str:
    """Check the ids, write all tables into a folder of their own under ``path``, then name it as current; returns the folder.

    Nothing that readers use is touched before everything is written: the pointer table is the last to change.
    """
    assert_unique(foods, "id")
    spark = foods.sparkSession
    out = f"{path}/v-{uuid.uuid4().hex}"
    folded = foods.withColumn("name_folded", fold_name(F.col("name"))).withColumn("alias_names", fold_name(F.array_join(F.transform("aliases", lambda a: a["name"]), "\n")))
    folded.drop("aliases", "servings").write.partitionBy("source").parquet(f"{out}/foods")
    for name, df in children(foods).items():
        df.write.parquet(f"{out}/{name}")
    members.write.parquet(f"{out}/members")
    manifest(foods, version).write.json(f"{out}/meta")
    spark.createDataFrame([(out,)], "folder string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return out


def read_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The current tables of a written catalogue."""
    out = spark.read.text(f"{path}/current").first()[0]
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("foods", "aliases", "barcodes", "servings", "members")} | {"meta": spark.read.json(f"{out}/meta")}


def source_versions(files: dict[str, str]) -> str:
    """``label:name`` of the files of a build, in the order of the national tables; the last part of a path is its name."""
    order = [*(s for s in ("off", *COUNTRY_OF_SOURCE) if s != "usda"), "usda"]
    return ",".join(f"{s}:{files[s].rstrip('/').rsplit('/', 1)[-1]}" for s in order if files.get(s))


def manifest(foods: DataFrame, version: str, files: dict[str, str] | None = None) -> DataFrame:
    """One row: version, files of the sources, sources with their counts in order, number of foods, digest and size (characters as JSON) of the content."""
    by = foods.groupBy("source").count()
    sources = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "count"))), lambda s: F.concat(s["source"], F.lit(":"), s["count"].cast("string"))), ", ").alias("sources"))
    size = foods.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*foods.columns)))), F.lit(0)).alias("size"))
    return content_digest(foods.drop("aliases", "servings")).crossJoin(sources).crossJoin(size).select(F.lit(version).alias("version"), F.lit(source_versions(files or {})).alias("source_versions"), "sources", "n", "xor", "sum", "size")


def export_subset(foods: DataFrame, child_tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The foods of one source and the children that belong to them, none of other sources."""
    kept = foods.filter(F.col("source") == source)
    out = {n: df.join(kept.select(F.col("id").alias("food_id")), "food_id", "left_semi") for n, df in child_tables.items()}
    return {"foods": kept, **out}


def verify_subset(subset: dict[str, DataFrame], flat: DataFrame, source: str) -> dict[str, int]:
    """Rows of each table of a subset, or an error: a food of another source, a child of a food that isn't in it, or a flat export of another length."""
    foods = subset["foods"]
    assert_empty(foods.filter(~F.col("source").eqNullSafe(F.lit(source))).select("id", "source"), "other sources")
    ids = foods.select(F.col("id").alias("food_id"))
    for name, df in subset.items():
        if name != "foods":
            assert_empty(df.join(ids, "food_id", "left_anti"), f"{name} of other foods")
    counts = {name: df.count() for name, df in subset.items()} | {"flat": flat.count()}
    if counts["flat"] != counts["foods"]:
        raise ContractError(f"counts differ: {counts}")
    return counts


def write_flat(flat: DataFrame, path: str) -> None:
    """A flat export as compressed CSV parts with a header."""
    flat.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def flat_export(foods: DataFrame, barcodes: DataFrame) -> DataFrame:
    """One row for each food with its codes joined by semicolons."""
    codes = barcodes.groupBy("food_id").agg(F.array_join(F.array_sort(F.collect_set("barcode")), ";").alias("barcodes"))
    return foods.join(codes.withColumnRenamed("food_id", "id"), "id", "left")
