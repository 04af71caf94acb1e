"""Ranked prefix search for batches of queries over the catalogue: postings, tiers, shelves, rescue, borrowing, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import COMPOUND_LANGS, depluralize, lexicon, split_compounds
from .hot import exact_quantiles
from .staging import Scratch, staged
from .topk import greatest, top_rows

#: Weights of the indexed columns, and the two constants of BM25.
WEIGHTS = {"name": 5.0, "brand": 1.0, "aliases": 3.0, "extra": 0.0}
K1, B = 1.2, 0.75
#: Sources that name the food first and stack what qualifies it.
HEAD_FIRST = ("nevo", "foodfiles")
#: Letters of a word that a token can be a beginning of.
LONGEST = 64
#: Joins with tables that grow with the catalogue or the batch sort and merge. Spark would send such a table to the driver
#: and to every task as long as its files are small, but files of foods are packed: 8 MB of them are 1,200,000 foods.
NEVER_SENT = "merge"


def build_postings(foods: DataFrame) -> DataFrame:
    """``word, id, col, tf, dl``: words of the searchable columns of each food (``dl``: words of the column).

    ``foods``: ``id, name_folded, brand, alias_names, search_extra``; the brand is lower-cased here.
    """
    cols = {"name": F.col("name_folded"), "brand": F.lower("brand"), "aliases": F.col("alias_names"), "extra": F.col("search_extra")}
    words = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w")) for c, x in cols.items()]))
    one = foods.select("id", words.alias("x")).select("id", "x.col", F.size("x.w").alias("dl"), F.explode("x.w").alias("word"))
    return one.groupBy("word", "id", "col").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def token_scores(tokens: DataFrame, postings: DataFrame, work: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``token, id, part``: what each food adds to bm25 by a token that some word of it begins with; and ``token, df``.

    ``tokens``: ``token``, each once. A token meets the beginnings of each different word, as equal strings; only the words
    found meet their postings, so work follows what matches, and a word in very many foods is split by adaptive
    execution. Every column of every word counts as one row. With ``work``, what is read more than once is staged.
    """
    beginnings = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    begun = postings.select("word").distinct().select("word", F.explode(beginnings).alias("token"))
    hit = tokens.join(begun.hint(NEVER_SENT), "token").join(postings.hint(NEVER_SENT), "word").select("token", "id", "col", "tf")
    weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("col"))
    per_food = hit.groupBy("token", "id").agg(F.sum(weight * F.col("tf")).alias("wtf"))
    if work is not None:
        per_food = work.table(per_food, "tokens")
    lengths = postings.select("id", "col", "dl").distinct().groupBy("id").agg(F.sum("dl").alias("len"))
    stats = lengths.agg(F.count("*").alias("rows"), F.avg("len").alias("avg_len"))
    df = per_food.groupBy("token").agg(F.count("*").alias("df"))
    if work is not None:
        df = work.table(df, "frequencies")
    scored = per_food.join(df, "token").join(lengths.hint(NEVER_SENT), "id").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = scored.select("token", "id", part.alias("part"))
    return (scored if work is None else work.table(scored, "scored")), df


def rarest_first(queries: DataFrame, scored: DataFrame, df: DataFrame) -> DataFrame:
    """``query_id, id, bm25``: foods that have all tokens of a query.

    A query starts from the foods of its rarest token, and the other tokens only look those up: rows between the joins
    follow the rarest token, however common the others are. A query one of whose tokens nothing has is dropped before.
    """
    asked = queries.select("query_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    known = asked.hint(NEVER_SENT).join(df, "token")
    rare = known.groupBy("query_id").agg(F.first("n").alias("n"), F.count("*").alias("known"), F.min_by(F.struct("token", "at"), F.struct("df", "at")).alias("rare")).filter("known = n")
    rare = rare.select("query_id", "n", F.col("rare.token").alias("token"), F.col("rare.at").alias("rare_at"))
    first = rare.join(scored, "token").select("query_id", "n", "id", "part")
    rest = asked.select("query_id", "at", "token").hint(NEVER_SENT).join(rare.filter("n > 1").select("query_id", "rare_at"), "query_id").filter("at <> rare_at").select("query_id", "token")
    probed = first.filter("n > 1").withColumnRenamed("part", "rare_part").join(rest, "query_id").join(scored, ["token", "id"])
    several = probed.groupBy("query_id", "id").agg(F.count("*").alias("found"), F.first("n").alias("n"), (F.first("rare_part") + F.sum("part")).alias("bm25")).filter("found = n - 1")
    return first.filter("n = 1").select("query_id", "id", F.col("part").alias("bm25")).unionByName(several.select("query_id", "id", "bm25"))


def prefix_matches(queries: DataFrame, postings: DataFrame, work: Scratch | None = None) -> DataFrame:
    """``query_id, id, bm25``: foods of which some word begins with each token of a query; the best bm25 is the greatest.

    ``queries``: ``query_id, tokens``. A query without tokens matches nothing; a token asked twice counts twice.
    """
    tokens = queries.select(F.explode("tokens").alias("token")).distinct()
    return rarest_first(queries, *token_scores(tokens, postings, work))


def _flat(c: Column, separators: str = "[,-]") -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(c, separators, " "), " +", " "), F.lit(" "))


def _ladder(c: Column, q: Column, spaced: int) -> Column:
    """0 exact (or with a plural s), 1 before a comma, ``spaced`` before a space, 3 whole words, 4 words begun, 5 none."""
    s = F.concat(q, F.lit("s"))

    def begins(end: str) -> Column:
        return F.startswith(c, F.concat(q, F.lit(end))) | F.startswith(c, F.concat(s, F.lit(end)))

    flat = _flat(c)
    return F.coalesce(F.when((c == q) | (c == s), 0).when(begins(","), 1).when(begins(" "), spaced).when(F.contains(flat, F.concat(F.lit(" "), q, F.lit(" "))), 3).when(F.contains(flat, F.concat(F.lit(" "), q)), 4).otherwise(5), F.lit(5))


def reader_alias(aliases: Column, languages: Column) -> Column:
    """The alias in the first of a reader's languages that has one."""
    ranked = F.transform(F.filter(aliases, lambda a: F.array_contains(languages, a["lang"])), lambda a, i: F.struct(F.array_position(languages, a["lang"]).alias("p"), i.alias("i"), a["name"].alias("name")))
    return F.array_min(ranked)["name"]


def display_name(name: Column, lang: Column, aliases: Column, languages: Column) -> Column:
    """A food's name for a reader: an alias only where its language stands before the row's own in the reader's list."""
    own = F.array_position(languages, lang)
    ahead = F.filter(aliases, lambda a: F.array_contains(languages, a["lang"]) & (lang.isNull() | (own == 0) | (F.array_position(languages, a["lang"]) < own)))
    return F.coalesce(reader_alias(ahead, languages), name)


def lead_word(q: Column, name: Column, source: Column, lead_source: Column) -> Column:
    """Whether the name's first word (or less a final s or en) is one of several typed words, in the one source this is asked of."""
    head = F.split(F.replace(name, F.lit(","), F.lit(" ")), " ")[0]
    words = F.concat(F.lit(" "), q, F.lit(" "))

    def typed(w: Column) -> Column:
        return F.contains(words, F.concat(F.lit(" "), w, F.lit(" ")))

    minus = [F.when(F.endswith(head, F.lit(e)), F.substring(head, F.lit(1), F.length(head) - len(e))) for e in ("s", "en")]
    return F.coalesce((lead_source != "") & (source == lead_source) & F.contains(q, F.lit(" ")) & (typed(head) | F.coalesce(typed(minus[0]), F.lit(False)) | F.coalesce(typed(minus[1]), F.lit(False))), F.lit(False))


def match_tier(q: Column, f: dict[str, Column], languages: Column, lead_source: Column) -> Column:
    """The least of five arms: name, aliases, compound heads (3), the reader's alias (0 or 1), the leading word (3)."""
    s = F.concat(q, F.lit("s"))
    extra = F.when(F.contains(F.concat(F.lit(" "), f["search_extra"], F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" "))), 3).otherwise(5)
    alias = reader_alias(f["aliases"], languages)
    reader = F.when((alias == q) | (alias == s), 0).when(F.startswith(F.lower(alias), F.concat(q, F.lit(","))) | F.startswith(F.lower(alias), F.concat(s, F.lit(","))), 1).otherwise(5)
    lead = F.when(lead_word(q, f["name_folded"], f["source"], lead_source), 3).otherwise(5)
    return F.least(_ladder(f["name_folded"], q, 2), _ladder(f["alias_names"], q, 3), extra, F.coalesce(reader, F.lit(5)), lead)


def native_head(q: Column, f: dict[str, Column], languages: Column) -> Column:
    """0 where the food's own language is one of the reader's other than English and its name or aliases begin with the query."""
    head = F.least(_ladder(f["name_folded"], q, 2), _ladder(f["alias_names"], q, 2)) <= 2
    return F.when(F.coalesce(F.array_contains(languages, f["lang"]) & (f["lang"] != "en") & head, F.lit(False)), 0).otherwise(1)


FOOD = ("id", "name", "name_folded", "alias_names", "aliases", "search_extra", "brand", "source", "lang", "basic_rank", "quality", "preferred")


def one_source(source: Column) -> Column:
    """Scope of a shelf: foods of a query's own table, or of every national table where it has none."""
    return national() & ((source == "") | (F.col("f_source") == source))


def national() -> Column:
    """Scope of a shelf: every national table."""
    return F.col("f_source") != "off"


def listed(sources: Column) -> Column:
    """Scope of a shelf: national tables of a list."""
    return national() & F.array_contains(sources, F.col("f_source"))


def top_limit(queries: DataFrame) -> int:
    """The greatest limit that a batch of queries has."""
    return greatest(queries.select("limit"))


def with_preference(foods: DataFrame, members: DataFrame) -> DataFrame:
    """Foods with ``preferred`` as the members' table says (``id, preferred``), false for foods it doesn't have."""
    return foods.drop("preferred").join(members.select("id", "preferred"), "id", "left").withColumn("preferred", F.coalesce("preferred", F.lit(False)))


def shelf(queries: DataFrame, postings: DataFrame, foods: DataFrame, scope: Column, *, hits: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Each query's best foods in scope: ``query_id, id, tier, place`` with place 1 to the query's ``limit``.

    ``queries``: ``query_id, q, tokens, languages, source, head, lead_source, limit`` and what ``scope`` reads (food
    columns are prefixed ``f_``). The order has ten terms, and the id for what they leave equal. ``hits`` are the queries'
    matches where they have been found already, ``most`` the greatest limit. Tasks choose among what they hold before
    rows move, so no task sorts all matches of a query.
    """
    most = top_limit(queries) if most is None else most
    f = foods.select(*[F.col(c).alias(f"f_{c}") for c in FOOD])
    hits = prefix_matches(queries.select("query_id", "tokens"), postings) if hits is None else hits.select("query_id", "id", "bm25")
    found = hits.join(queries, "query_id").join(f.hint(NEVER_SENT), F.col("id") == F.col("f_id")).filter(scope)
    c = {n: F.col(f"f_{n}") for n in FOOD}
    q, langs, lead = F.col("q"), F.col("languages"), F.col("lead_source")
    is_lead = lead_word(q, c["name_folded"], c["source"], lead)
    phrase = F.contains(_flat(c["name_folded"], "[,()-]"), F.concat(F.lit(" "), q, F.lit(" ")))
    head = F.when((F.col("head") == "") | F.contains(F.concat(F.lit(" "), F.regexp_replace(c["name_folded"], "[,-]", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("head"), F.lit(" "))), 0).otherwise(1)
    ranked = found.select(
        "query_id", "id", "limit", match_tier(q, c, langs, lead).alias("tier"), native_head(q, c, langs).alias("o1"), F.when(is_lead & phrase, 0).when(is_lead, 1).otherwise(2).alias("o3"),
        F.coalesce(1 - c["preferred"].cast("int"), F.lit(0)).alias("o4"), head.alias("o5"), c["basic_rank"].alias("o6"), (F.length(c["name"]) - F.length(F.replace(c["name"], F.lit(" "), F.lit("")))).alias("o7"),
        F.length(c["name"]).alias("o8"), F.round("bm25", 9).alias("o9"), c["quality"].alias("o10"),
    )
    order = ["o1", "tier", "o3", "o4", "o5", "o6", "o7", "o8", F.desc("o9"), F.desc("o10"), "id"]
    return top_rows(ranked, ["query_id"], order, F.col("limit"), most).select("query_id", "id", "tier", "place")


def branded_shelf(queries: DataFrame, postings: DataFrame, foods: DataFrame, *, hits: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Branded foods for each query: exact names, then begun ones, then others; by bm25 and quality. ``hits``, ``most``: as for :func:`shelf`."""
    most = top_limit(queries) if most is None else most
    hits = prefix_matches(queries.select("query_id", "tokens"), postings) if hits is None else hits.select("query_id", "id", "bm25")
    found = hits.join(queries.select("query_id", "q", "limit"), "query_id").join(foods.filter("source = 'off'").select("id", "name_folded", "quality").hint(NEVER_SENT), "id")
    tier = F.when(F.col("name_folded") == F.col("q"), 0).when(F.startswith("name_folded", F.col("q")), 1).otherwise(2)
    ranked = found.select("query_id", "id", "limit", tier.alias("tier"), F.round("bm25", 9).alias("b"), "quality")
    return top_rows(ranked, ["query_id"], ["tier", F.desc("b"), F.desc("quality"), "id"], F.col("limit"), most).select("query_id", "id", "tier", "place")


def rescue(queries: DataFrame, answered: DataFrame, words: DataFrame) -> DataFrame:
    """Other wording for queries without a head match (tier 2 or less): ``query_id, q, head``.

    ``words``: ``source, lang, word``. Single words only, by the reader's own table: split as a compound where the language
    writes them, else without a plural ending.
    """
    missed = queries.join(answered.filter("tier <= 2").select("query_id").distinct(), "query_id", "left_anti").filter(F.col("q").rlike(r"^[\p{L}\p{N}]+$"))
    asked = missed.select("query_id", "source", F.col("q").alias("token"))
    split = split_compounds(asked, words.filter(F.col("lang").isin(*COMPOUND_LANGS)).select("source", "word"), ["source"]).select("source", "token", F.col("stem").alias("a"), F.col("head").alias("h"))
    single = depluralize(asked, words.select("source", "word").distinct(), ["source"]).select("source", "token", F.col("stem").alias("b"))
    out = asked.join(split, ["source", "token"], "left").join(single, ["source", "token"], "left")
    return out.select("query_id", F.coalesce("a", "b").alias("q"), F.coalesce("h", F.lit("")).alias("head")).filter("q is not null")


def lenders(served: DataFrame) -> DataFrame:
    """``source, lender``: other tables that serve the first language of a source's readers. ``served``: ``source, lang, place``."""
    first = served.filter("place = 1").select("source", "lang")
    return first.join(served.select(F.col("source").alias("lender"), "lang"), "lang").filter("lender <> source").select("source", "lender").distinct()


def search(queries: DataFrame, foods: DataFrame, served: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """``query_id, place, id, shelf, tier`` for a batch of queries, a staged table: own foods, own table, rescue, borrowed tables, branded filler.

    Passes over all queries at once, each staged. Foods are matched once for the wordings as typed and once for those that
    rescue has found; every shelf reads these matches by its scope. Rescue and borrowing only run for the queries that need
    them, and branded foods are ranked only for queries that the other shelves leave room. ``served`` lists each source's
    languages in order. ``custom`` (``query_id, id, place``) are the asker's own foods: they come first (shelf -1, no
    tier), outside the ranking, and the tables fill what they leave of the limit. The merge puts names that begin with
    the query (tier 2 or less) first, then the shelves, the better tiers, and each shelf's order; branded filler comes last.
    """
    with Scratch(foods.sparkSession, "search") as work:
        foods, queries = work.table(foods, "foods"), work.table(queries, "queries")
        limits = queries.select("query_id", "limit")
        none = F.lit(None).cast("int")
        mine_first = None
        if custom is not None:
            mine_first = work.table(custom.join(limits, "query_id").filter(F.col("place") <= F.col("limit")).select("query_id", F.col("place").cast("int").alias("place"), "id", F.lit(-1).alias("shelf"), none.alias("tier")), "custom")
            used = mine_first.groupBy("query_id").agg(F.count("*").cast("int").alias("used"))
            queries = queries.join(used, "query_id", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("limit", F.col("limit") - F.col("used")).filter(F.col("limit") > 0)
            queries = work.table(queries, "queries")
        most = top_limit(queries)
        postings = work.table(build_postings(foods), "postings")

        def matched(asked: DataFrame) -> DataFrame:
            return work.table(prefix_matches(asked.select("query_id", "tokens"), postings, work).join(foods.select("id", "source").hint(NEVER_SENT), "id"), "hits")

        mine = one_source(F.col("source"))
        base = queries.withColumn("head", F.lit("")).withColumn("lead_source", F.when(F.col("source").isin(*HEAD_FIRST), F.col("source")).otherwise(""))
        hits = matched(base)
        national_hits = F.col("source") != "off"
        first = work.table(shelf(base, postings, foods, mine, hits=hits.filter(national_hits), most=most), "first")
        words = lexicon(foods.filter("source <> 'off'").select("source", "lang", F.col("name_folded").alias("folded")), ["source", "lang"])
        other = work.table(rescue(base, first, words), "rescue")
        again = work.table(base.drop("q", "head", "tokens").join(other, "query_id").withColumn("tokens", F.array("q")), "again")
        hits_again = matched(again)
        second = shelf(again, postings, foods, mine, hits=hits_again.filter(national_hits), most=most)
        changed = other.select("query_id")
        now = base.join(changed, "query_id", "left_anti").unionByName(again)
        hits = hits.join(changed, "query_id", "left_anti").unionByName(hits_again)
        primary = work.table(first.join(changed, "query_id", "left_anti").unionByName(second), "primary")
        empty = now.filter("source <> ''").join(primary.select("query_id").distinct(), "query_id", "left_anti")
        lent = lenders(served).groupBy("source").agg(F.collect_set("lender").alias("from"))
        asking = work.table(empty.join(lent, "source").withColumn("lead_source", F.lit("")), "asking")
        borrowed = shelf(asking, postings, foods, listed(F.col("from")), hits=hits.filter(national_hits), most=most)
        generic = primary.withColumn("shelf", F.lit(0)).unionByName(borrowed.withColumn("shelf", F.lit(1)))
        generic = generic.withColumn("order", F.struct(F.when(F.col("tier") <= 2, 0).otherwise(1).alias("a"), F.col("shelf").alias("b"), F.col("tier").alias("c"), "place"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("order"))  # of at most a limit's rows
        generic = work.table(generic.select("query_id", rank.alias("rank"), "id", "shelf", "tier"), "generic")
        taken = generic.groupBy("query_id").agg(F.count("*").cast("int").alias("taken"))
        room = now.join(taken, "query_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).filter(F.col("taken") < F.col("limit"))
        room = work.table(room.withColumn("limit", F.col("limit") - F.col("taken")), "room")
        filler = branded_shelf(room, postings, foods, hits=hits.filter("source = 'off'"), most=most).join(room.select("query_id", "taken"), "query_id")
        ranked = generic.unionByName(filler.select("query_id", (F.col("place") + F.col("taken")).alias("rank"), "id", F.lit(2).alias("shelf"), "tier"))
        if custom is not None:
            ranked = ranked.join(queries.select("query_id", "used"), "query_id").withColumn("rank", F.col("rank") + F.col("used"))
        out = ranked.select("query_id", F.col("rank").alias("place"), "id", "shelf", "tier")
        return staged(out if mine_first is None else mine_first.unionByName(out), "search")


def boost(results: DataFrame, favourites: DataFrame, recents: DataFrame) -> DataFrame:
    """A reader's favourites first, then recent foods, then the rest, each group in its order. All tables have ``user_id, id``."""
    f, r = favourites.select("user_id", "id").distinct().withColumn("fav", F.lit(0)), recents.select("user_id", "id").distinct().withColumn("rec", F.lit(1))
    joined = results.join(f, ["user_id", "id"], "left").join(r, ["user_id", "id"], "left").withColumn("group", F.coalesce("fav", "rec", F.lit(2))).drop("fav", "rec")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "query_id").orderBy("group", "place")))


def evaluate(results: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``query_id, verdict`` of judged queries: pass where some name in the top k is acceptable and none unacceptable.

    ``judged``: ``query_id, acceptable, unacceptable`` (patterns; null acceptable: no row is expected in that table).
    """
    top = judged.join(results.filter(F.col("place") <= k), "query_id", "left")
    good, bad = F.bool_or(F.coalesce(F.expr("name rlike acceptable"), F.lit(False))), F.bool_or(F.coalesce(F.expr("name rlike unacceptable"), F.lit(False)))
    return top.groupBy("query_id").agg(F.when(F.bool_and(F.col("acceptable").isNull()), "no row expected").when(good & ~bad, "pass").otherwise("fail").alias("verdict"))


def latency_summary(timings: DataFrame, by: list[str]) -> DataFrame:
    """Median and 95th percentile of ``ms`` by key, exact however many timings a key has."""
    return exact_quantiles(timings, by, "ms", {"median": 0.5, "p95": 0.95})
