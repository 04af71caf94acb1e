"""Stored layouts: what a plan moves and which files a window opens."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from platewise.operators import stored

D = datetime.date


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_move_only_what_asks(spark, tmp_path, no_broadcast):
    foods = spark.range(500).select("id", F.concat(F.lit("food "), F.col("id").cast("string")).alias("name"))
    codes = foods.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("barcode"), F.col("id").alias("food_id"))
    kept = stored.store_by_key(foods, "t_foods", f"file://{tmp_path}/foods", ["id"], buckets=8)
    by_code = stored.store_by_key(codes, "t_codes", f"file://{tmp_path}/codes", ["barcode"], buckets=8)
    asked = spark.createDataFrame([("c7", 1), ("c499", 2), ("none", 3), (None, 4), ("c7", 5)], "barcode string, n int")
    found = stored.resolve_codes(asked, by_code, kept)
    text = plan(found)  # as planned, before it runs
    assert {r.n: r.name for r in found.collect()} == {1: "food 7", 2: "food 499", 3: None, 4: None, 5: "food 7"}
    assert text.count("SortMergeJoin") == 2 and len(re.findall(r"Exchange hashpartitioning", text)) == 2, text  # what asks, twice
    lines = text.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for at, line in enumerate(lines):
        if "FileScan parquet" in line:  # no exchange stands between a stored table and its join
            over = [k for k in range(at) if depth[k] < min(depth[k + 1 : at + 1])]
            above = next(lines[k] for k in reversed(over) if "Join" in lines[k] or "Exchange" in lines[k])
            assert "Join" in above and "Bucketed: true" in line, text
    assert len(list((tmp_path / "foods").glob("part-*"))) == 8
    stored.forget(spark, "t_foods", "t_codes")


def test_a_window_opens_its_months(spark, tmp_path, no_broadcast):
    first = D(2023, 1, 1)
    entries = spark.range(20_000).select((F.col("id") % 50).alias("user_id"), F.date_add(F.lit(first), (F.col("id") % 700).cast("int")).alias("log_date"), F.col("id"))
    entries = entries.unionByName(spark.createDataFrame([(1, None, -1)], "user_id long, log_date date, id long"))
    table = stored.store_diary(entries, "t_diary", f"file://{tmp_path}/diary", buckets=4)
    window = stored.days_between(table, D(2023, 11, 20), D(2024, 1, 5))
    text, sums = plan(window), plan(window.groupBy("user_id").agg(F.count("*").alias("n")))
    want = entries.filter(F.col("log_date").between(F.lit(D(2023, 11, 20)), F.lit(D(2024, 1, 5))))
    assert sorted(map(tuple, window.collect())) == sorted(map(tuple, want.collect())) and window.columns == entries.columns
    assert re.search(r"PartitionFilters: \[isnotnull\(month#\d+\), \(month#\d+ >= 2023-11-01\), \(month#\d+ <= 2024-01-01\)\]", text), text
    assert "PushedFilters: [IsNotNull(log_date), GreaterThanOrEqual(log_date,2023-11-20), LessThanOrEqual(log_date,2024-01-05)]" in text
    opened = {r.f.split("month=")[1][:7] for r in window.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened == {"2023-11", "2023-12", "2024-01"} and table.count() == 20_001
    assert "Exchange hashpartitioning" not in sums  # buckets are by user
    stored.forget(spark, "t_diary")
