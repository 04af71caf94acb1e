"""Tables and screens kept current over two batches, against plain Python."""

import datetime

from pyspark.sql import functions as F

from platewise.operators import diary
from platewise.streaming import live

D = datetime.date
ENTRY = "struct<user_id:bigint,id:bigint,log_date:date,calories:double>"
BATCHES = [
    [(1, 1, None, (1, 1, D(2024, 1, 1), 5.0), 1), (1, 2, None, (1, 2, D(2024, 1, 2), 7.0), 2), (2, 3, None, (2, 3, D(2024, 1, 1), 9.0), 3), (3, 4, None, (3, 4, D(2024, 1, 1), 1.0), 4)],
    [(1, 1, (1, 1, D(2024, 1, 1), 5.0), (1, 1, D(2024, 1, 1), 6.0), 5), (1, 1, (1, 1, D(2024, 1, 1), 6.0), (1, 1, D(2024, 1, 3), 8.0), 6), (3, 4, (3, 4, D(2024, 1, 1), 1.0), None, 7), (2, 5, None, (2, 5, D(2024, 1, 2), 2.0), 8)],
    [(3, 9, None, (3, 9, D(2024, 2, 1), 3.0), 9)],
]


def stream(spark, tmp_path):
    schema = f"user_id long, id long, old {ENTRY}, new {ENTRY}, at long"
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")


def test_entries_and_screens(spark, tmp_path):
    goals = spark.createDataFrame([(1, D(2024, 1, 2), 2000.0), (2, D(2024, 1, 5), 1.0)], "user_id long, effective_from date, calories_target double")

    def shown(entries):
        return entries.groupBy("user_id").agg(F.max("log_date").alias("log_date")).withColumn("today", F.lit(D(2024, 1, 3)))

    out = f"file://{tmp_path}/out"
    live.live_screens(stream(spark, tmp_path), out, f"file://{tmp_path}/check", lambda: goals, shown, ["calories"]).awaitTermination()
    entries = live.read_current(spark, f"{out}/entries")
    assert sorted(map(tuple, entries.select("user_id", "id", "log_date", "calories").collect())) == [(1, 1, D(2024, 1, 3), 8.0), (1, 2, D(2024, 1, 2), 7.0), (2, 3, D(2024, 1, 1), 9.0), (2, 5, D(2024, 1, 2), 2.0), (3, 9, D(2024, 2, 1), 3.0)]
    screens = {(r.batch, r.user_id): r for r in spark.read.parquet(f"{out}/screens/*").collect()}
    one = screens[1, 1]
    assert (one.log_date, one.is_today, one.entries, one.calories, one.previous_entries, one.previous_calories, one.calories_target, one.logged_dates) == (D(2024, 1, 3), True, 1, 8.0, 1, 7.0, 2000.0, [D(2024, 1, 3), D(2024, 1, 2)])
    assert (screens[1, 2].previous_calories, screens[1, 2].calories_target, screens[1, 2].is_today) == (9.0, None, False)
    assert set(screens) == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 3)}


def test_windows(spark, tmp_path):
    goals = spark.createDataFrame([(1, D(2024, 1, 2), 2000.0)], "user_id long, effective_from date, calories_target double")
    out = f"file://{tmp_path}/out"
    live.live_windows(stream(spark, tmp_path), out, f"file://{tmp_path}/check", lambda: goals, ["calories"], 7).awaitTermination()
    got = sorted((r.log_date, r.calories, r.calories_mean_7, r.logged_7, r.calories_target) for r in spark.read.parquet(f"{out}/windows/1").filter("user_id = 1").collect())
    assert got == [(D(2024, 1, 2), 7.0, 7.0, 1, 2000.0), (D(2024, 1, 3), 8.0, 7.5, 2, 2000.0)]
    want = diary.trailing(diary.history(live.read_current(spark, f"{out}/entries").filter("user_id = 2"), goals, ["calories"]), ["calories"], 7)
    assert sorted(map(str, want.collect())) == sorted(map(str, spark.read.parquet(f"{out}/windows/1").filter("user_id = 2").drop("batch").collect()))
    assert live.goal_history(spark.createDataFrame([(1,), (9,)], "user_id long"), lambda: goals).count() == 1


def test_what_a_batch_reads_follows_the_buckets_it_touches(spark, tmp_path):
    schema = "user_id long, at long, v long"
    for k in range(9):  # a large batch, then single users
        users = range(200) if k == 0 else [k]
        spark.createDataFrame([(u, 10 * k, k) for u in users], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    read = {}

    def then(batch, number, rows):
        read[number] = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}, rows.filter(rows.user_id == number).count() if number else None

    out = f"file://{tmp_path}/out"
    live.keep_current(stream, out, f"file://{tmp_path}/check", live.live_upsert(["user_id"], "at"), ["user_id"], buckets=16, then=then).awaitTermination()
    assert len(read[0][0]) == 16 and all(len(b) == 1 and n == 1 for k, (b, n) in read.items() if k)
    assert sorted(p.name for p in (tmp_path / "out" / "pointers").iterdir()) == ["6", "7", "8"]
    kept = {int(p.name) for p in (tmp_path / "out" / "data").iterdir()}
    table = live.read_current(spark, out)
    assert {(r.user_id, r.v) for r in table.collect()} == {(u, u if 1 <= u <= 8 else 0) for u in range(200)} and len(kept) <= 10
