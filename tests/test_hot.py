"""Exact quantiles and as-of joins of very large keys, against plain ones."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import diary, hot, tables

D = datetime.date


@pytest.mark.parametrize(("classes", "few"), [(1024, 4096), (4, 3), (16, 1)])
def test_quantiles_of_any_size(spark, classes, few):
    rnd = random.Random(classes)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [3.25] * 400, "hot": [rnd.lognormvariate(0, 6) for _ in range(900)] + [7.0] * 300, "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 2.0], None: [rnd.randint(0, 9) * 1.0 for _ in range(200)]}
    rows = [(g, v, i) for g, vs in groups.items() for i, v in enumerate(vs)] + [("one", None, 0), ("one", float("nan"), 1), ("none", None, 2)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(4)
    shares = {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: [r[q] for q in shares] for r in hot.exact_quantiles(df, ["g"], "v", shares, classes=classes, few=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.quantile(np.array(vs), list(shares.values()))
        assert got[g] == pytest.approx(list(want), rel=1e-12), g
    assert hot.exact_quantiles(df, [], "v", {"m": 0.5}, classes=classes, few=few).count() == 1
    assert hot.exact_quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_one_very_long_key_is_many_tasks_work(spark, monkeypatch):
    """Forty thousand entries, four thousand days and 134 goals of one user, beside users with few and with none."""
    first = D(2014, 1, 1)
    days = spark.range(40_000).select(F.lit(1).cast("long").alias("user_id"), F.date_add(F.lit(first), (F.col("id") % 4000).cast("int")).alias("log_date"), F.col("id").alias("n"))
    goals = spark.range(134).select(F.lit(1).cast("long").alias("user_id"), F.date_add(F.lit(first), (F.col("id") * 30 + 7).cast("int")).alias("effective_from"), (F.col("id") * 1.0).alias("calories_target"))
    more = spark.createDataFrame([(2, D(2015, 1, 1), -1), (2, D(2013, 1, 1), -2), (None, D(2015, 1, 1), -3), (3, None, -4), (3, D(2020, 1, 1), -5)], "user_id long, log_date date, n long")
    less = spark.createDataFrame([(2, D(2014, 6, 1), 5.0), (2, D(2014, 6, 1), 6.0), (3, None, 7.0), (3, D(2021, 1, 1), 8.0), (1, D(2024, 1, 1), None)], "user_id long, effective_from date, calories_target double")
    days, goals = days.unionByName(more), goals.unionByName(less)
    how = {"by": "user_id", "on": "log_date", "start": "effective_from", "value": "calories_target"}
    most = []

    class Watched(hot.Scratch):
        def table(self, df, name):
            out = super().table(df, name)
            most.append(max(r["count"] for r in out.groupBy("part", "key").count().collect()))  # rows that one window holds
            return out

    monkeypatch.setattr(hot, "Scratch", Watched)
    got = hot.asof_over_ranges(days, goals, **how, parts=16)
    want = diary.asof_join(days, goals, **how)
    one, two = ({r.n: r.calories_target for r in x.filter("user_id is not null").collect()} for x in (got, want))
    assert one == two and got.count() == days.count() and got.columns == want.columns
    assert len(most) == 1 and most[0] < 6000


def test_asof_of_nothing(spark):
    days = spark.createDataFrame([], "u long, d date")
    goals = spark.createDataFrame([], "u long, s date, v double")
    assert hot.asof_over_ranges(days, goals, by="u", on="d", start="s", value="v").count() == 0


def test_tables_are_compared_by_digest(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"]), i // 2) for i in range(3000)]
    a = spark.createDataFrame(rows, "x int, y string, n int").repartition(3)
    changed = rows[5:] + [rows[10], (1, None, -1), (None, "1", -1)] + [(rows[7][0], "changed", rows[7][2])]
    b = spark.createDataFrame(changed, "u int, v string, w int").repartition(2)
    plain = a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
    for buckets in (1, 16, 4096):
        got = tables.table_diff(a, b, buckets=buckets)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() >= 8
    assert tables.differing_buckets(a, a.orderBy("n")).count() == 0 and 1 <= tables.differing_buckets(a, b).count() <= 9
    one, two = (spark.createDataFrame([r], "x int, y int") for r in ((None, 1), (1, None)))
    assert tables.differing_buckets(one, two, 1).count() == 1 and tables.table_diff(one, two).count() == 2
    assert tables.table_diff(a, a).count() == 0 and tables.table_diff(a.limit(0), a.limit(0)).count() == 0
    maps = spark.sql("select 1 as k, array(map('a', 1)) as m")
    assert tables.differing_buckets(a.limit(0), a).count() > 100 and "map<" in dict(maps.dtypes)["m"]
