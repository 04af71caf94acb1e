"""Bounded selection and several-word matching: against plain Python, and by their plans."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from platewise.operators import search, topk
from platewise.operators.staging import staged
from platewise.plans import searches

FOODS = "id long, name string, name_folded string, alias_names string, aliases array<struct<lang:string,name:string>>, search_extra string, brand string, source string, lang string, basic_rank int, quality int, preferred boolean"
QUERIES = "query_id string, q string, tokens array<string>, languages array<string>, source string, head string, lead_source string, limit int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [1000, 3])
def test_top_rows_against_sorting(spark, threshold):
    rnd = random.Random(threshold)
    data = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randint(0, 9), i) for i in range(2000)]
    limits = {"hot": 7, "a": 3, "b": 0, None: 5}
    rows = spark.createDataFrame([(k, v, i, limits[k]) for k, v, i in data], "k string, v int, id int, limit int").repartition(5)
    spark.conf.set(topk.THRESHOLD, str(threshold))
    try:
        got = defaultdict(list)
        for r in topk.top_rows(rows, ["k"], [F.desc("v"), "id"], F.col("limit"), 7, shards=4).orderBy("place").collect():
            got[r.k].append((r.id, r.place))
    finally:
        spark.conf.unset(topk.THRESHOLD)
    for k, n in limits.items():
        want = sorted((-v, i) for x, v, i in data if x == k)[:n]
        assert got[k] == [(i, p) for p, (_, i) in enumerate(want, 1)]


def foods(spark, n):
    some = spark.range(n).select(
        F.col("id"), F.concat(F.lit("milk "), F.when(F.col("id") % 100 == 0, "rare ").otherwise("whole "), F.col("id").cast("string")).alias("name"), F.lit("bls").alias("source"), F.lit("de").alias("lang"), (F.col("id") % 3).cast("int").alias("basic_rank"), F.lit(1).alias("quality"), F.lit(False).alias("preferred"),
    )
    none = F.lit(None).cast("string")
    return some.select("id", "name", F.col("name").alias("name_folded"), none.alias("alias_names"), F.array().cast("array<struct<lang:string,name:string>>").alias("aliases"), none.alias("search_extra"), none.alias("brand"), "source", "lang", "basic_rank", "quality", "preferred")


def queries(spark, *wordings, limit=4):
    return spark.createDataFrame([(q, q, q.split(" "), ["de"], "", "", "", limit) for q in wordings], QUERIES)


def test_tasks_choose_before_rows_move(spark):
    """Limits come from a stored table; still each task keeps no more than the greatest of them."""
    asked = staged(queries(spark, "milk", limit=4), "asked")
    table = staged(foods(spark, 3000), "foods")
    hits = staged(search.prefix_matches(asked, search.build_postings(table)), "hits")
    for df in (search.shelf(asked, None, table, search.national(), hits=hits), search.branded_shelf(asked, None, table.withColumn("source", F.lit("off")), hits=hits)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2, text  # the final one, an exchange below it, and the partial one
        final, partial = (i for i, line in enumerate(text.splitlines()) if "WindowGroupLimit" in line)
        assert any("Exchange hashpartitioning(query_id" in line for line in text.splitlines()[final:partial])
        assert [r.place for r in df.orderBy("place").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("name", ["prefix_search", "rank_probes", "pinned_probes", "branded_results", "ranked_shelf", "match_tiers"])
def test_foods_are_never_sent_whole(spark, name):
    """Files of foods are small for what they hold; plans must not take that for a table that fits a driver."""
    text = plan(getattr(searches, name)(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in text and not re.search(r"Broadcast\w+Join \[(id|f_id|word)#", text), text


def test_rarest_word_leads(spark):
    table = foods(spark, 1000)
    postings = search.build_postings(table)
    asked = queries(spark, "milk rare", "rare milk", "milk", "milk milk", "milk nothing", "rare rare milk", "wh mi 77")
    tokens = asked.select(F.explode("tokens").alias("token")).distinct()
    scored, df = search.token_scores(tokens, postings)
    assert {r.token: r.df for r in df.collect()} == {"milk": 1000, "rare": 10, "wh": 990, "mi": 1000, "77": 11}
    got = search.rarest_first(asked, scored, df).collect()
    have = defaultdict(dict)
    for r in got:
        have[r.query_id][r.id] = round(r.bm25, 9)
    assert {q: len(x) for q, x in have.items()} == {"milk rare": 10, "rare milk": 10, "milk": 1000, "milk milk": 1000, "rare rare milk": 10, "wh mi 77": 11}
    assert have["milk rare"] == have["rare milk"]
    one = {r.id: r.part for r in scored.filter("token = 'milk'").collect()}
    rare = {r.id: r.part for r in scored.filter("token = 'rare'").collect()}
    assert have["milk milk"] == {i: round(2 * p, 9) for i, p in one.items()}
    assert have["rare rare milk"] == {i: round(2 * p + one[i], 9) for i, p in rare.items()}


def test_filler_only_fills_room(spark):
    own = foods(spark, 6)
    branded = foods(spark, 20).withColumn("id", F.col("id") + 100).withColumn("source", F.lit("off")).withColumn("lang", F.lit(None).cast("string"))
    asked = queries(spark, "milk", "milk 3", "milk 103x", limit=8).drop("head", "lead_source")
    served = spark.createDataFrame([("bls", "de", 1)], "source string, lang string, place int")
    got = defaultdict(list)
    for r in search.search(asked, own.unionByName(branded), served).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.place, r.id, r.shelf))
    assert [x[0] for x in got["milk"]] == list(range(1, 9)) and [x[2] for x in got["milk"]] == [0] * 6 + [2] * 2
    assert [x[1:] for x in got["milk 3"]] == [(3, 0), (103, 2)] and "milk 103x" not in got
