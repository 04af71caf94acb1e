"""Keyed state over several micro-batches, with late, repeated and shuffled rows, against the batch operators."""

import datetime
import random

from pyspark.sql import functions as F

from platewise.operators import tables
from platewise.streaming import live, stateful

PRODUCT = "barcode string, name string, kcal double, protein double, fat double, carbs double, errors string, quality int, popularity int, ord long, at timestamp"
ENTRY = "struct<log_date:date,kcal:double,protein:double>"
CHANGE = f"user_id long, id long, at long, new {ENTRY}"


def stream(spark, tmp_path, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")


def check_digit(n):
    s = f"{n:07d}"
    return s + str(-sum(int(c) * (3, 1)[i % 2] for i, c in enumerate(s)) % 10)


def test_best_records_equal_the_batch_query(spark, tmp_path):
    rnd = random.Random(4)
    codes = [check_digit(1_000_001 + 7 * i) for i in range(12)] + ["123", None]
    when = datetime.datetime(2024, 1, 1, 12, 0, 0, 123456)
    rows = [
        (rnd.choice(codes), f"name {i}", rnd.choice([100.0, 100.0, None, 5000.0]), 5.0, 1.0, 18.0, rnd.choice([None, "", "en:nutrition-value-total-over-105"]), rnd.choice([None, 1, 2, 3]), rnd.choice([1, 1, 2, None]), i, when)
        for i in range(300)
    ]
    rnd.shuffle(rows)
    batches = [rows[:100], rows[100:150] + rows[:30], rows[150:]]  # some come twice
    out = f"file://{tmp_path}/out"
    stateful.keep_best_products(stream(spark, tmp_path, PRODUCT, batches), out, f"file://{tmp_path}/check").awaitTermination()
    got = live.read_current(spark, out)
    accepted = stateful.accepted_products(spark.createDataFrame(rows, PRODUCT))
    want = tables.keep_best(accepted, ["barcode"], [F.col("quality"), F.col("popularity")], "ord")
    assert 5 < want.count() and sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    twice = stateful.accepted_products(spark.createDataFrame(rows[:30], PRODUCT)).count()
    assert got.agg(F.sum("seen")).first()[0] == accepted.count() + twice  # kept and rejected make up what was seen


def test_totals_follow_the_newest_change_in_any_order(spark, tmp_path):
    rnd = random.Random(5)
    changes, state = [], {}
    for at in range(400):
        user, id_ = rnd.randint(1, 4), rnd.randint(1, 20)
        new = None if rnd.random() < 0.2 else (datetime.date(2024, 1, rnd.randint(1, 9)), rnd.choice([0.1, 0.2, 5.3, None]), round(rnd.random() * 50, 3))
        changes.append((user, id_, at, new))
        state[user, id_] = new
    rnd.shuffle(changes)
    batches = [changes[:120], changes[120:200] + changes[:50], changes[200:399], changes[399:] + changes[100:110]]
    out = f"file://{tmp_path}/out"
    stateful.keep_day_totals(stream(spark, tmp_path, CHANGE, batches), out, f"file://{tmp_path}/check", ["kcal", "protein"]).awaitTermination()
    want = {}
    for (user, _), new in state.items():
        if new is not None:
            n, kcal, protein = want.get((user, new[0]), (0, 0, 0))
            want[user, new[0]] = (n + 1, kcal + round(1e6 * (new[1] or 0)), protein + round(1e6 * new[2]))
    got = {(r.user_id, r.log_date): (r.entries, round(1e6 * r.kcal), round(1e6 * r.protein)) for r in live.read_current(spark, out).collect()}
    assert got == want and len(want) > 20
