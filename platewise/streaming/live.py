"""Live queries as Structured Streaming: totals from signed changes, tables kept current batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.foods import gtin_ok, reject_reason, upstream_error
from ..operators.diary import asof_join, day_totals, goal_periods, history, trailing
from ..operators.maintain import toggle, upsert_by_key
from ..operators.staging import remove
from ..operators.tables import keep_best


def signed(changes: DataFrame, sums: list[str]) -> DataFrame:
    """Changes (``old`` and ``new`` structs, either null) as signed rows: an edit takes the old entry away and adds the new.

    An undo is the change back, so totals follow inserts, edits, deletes and undos alike.
    """
    part = F.array_compact(F.array(F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("e"))), F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias("sign"), F.col("new").alias("e")))))
    one = changes.select(F.explode(part).alias("x")).select("x.sign", "x.e.*")
    return one.withColumns({c: F.col(c) * F.col("sign") for c in sums})


def live_day_totals(changes: DataFrame, sums: list[str], by: list[str]) -> DataFrame:
    """Running totals by key over a stream (or table) of changes; use update or complete mode. State: one row for each key."""
    return signed(changes, sums).groupBy(*by).agg(F.sum("sign").alias("entries"), *[F.sum(c).alias(c) for c in sums])


def recompute_touched(batch: DataFrame, by: str, read: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For ``foreachBatch``: what is derived anew for the users that a batch touches, from the tables as they are now (or those parts that hold these users)."""
    touched = batch.select(by).distinct()
    return derive(read().join(touched, by, "left_semi"))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The batch that last wrote each bucket, as of a batch; nothing before the first."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/pointers/{number}").filter("bucket >= 0").collect()} if number >= 0 else {}


def _read_buckets(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    found = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*found) if found else None


def keep_current(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], key: list[str], *, buckets: int = 64, then: Callable[[DataFrame, int, DataFrame], None] | None = None) -> StreamingQuery:
    """A table kept current batch by batch: rows are dealt over buckets by key, and only buckets that a batch touches are written anew.

    Each batch merges its rows into theirs and then says, in a small table of its own, which batch wrote each bucket last (bucket -1: its own number);
    :func:`read_current` reads by the newest of these. A batch that runs again starts from the one before, so it has the
    same result. Versions that only older batches need are removed, and so are their small tables, but for the last three:
    what a batch reads and lists follows the buckets that it touches, not how many batches there have been. ``then`` gets
    each batch when the table has it, with the rows of the touched buckets as they are now.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("__bucket", _bucket(key, buckets)).persist()
        before = _versions(spark, path, number - 1)
        touched = [r[0] for r in batch.select("__bucket").distinct().collect()]  # not more than there are buckets
        old = _read_buckets(spark, path, {b: before[b] for b in touched if b in before})
        merged = merge(old, batch.drop("__bucket")).withColumn("bucket", _bucket(key, buckets))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
        there = {r[0] for r in spark.read.parquet(f"{path}/data/{number}").select("bucket").distinct().collect()} if touched else set()
        now = {b: v for b, v in before.items() if b not in touched} | {b: number for b in there}
        spark.createDataFrame([(-1, number), *sorted(now.items())], "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/{number}")
        for gone in set(_versions(spark, path, number - 2).values()) - set(before.values()) - set(now.values()) if number > 1 else ():
            remove(spark, f"{path}/data/{gone}")
        if number > 2:
            remove(spark, f"{path}/pointers/{number - 3}")
        if then is not None:
            then(batch.drop("__bucket"), number, _read_buckets(spark, path, {b: number for b in there}))
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest finished batch left it; nothing before the first, or where it is empty."""
    newest = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/pointers").filter("bucket = -1").agg(F.max("version")).first()[0]
    return None if newest is None else _read_buckets(spark, path, _versions(spark, path, newest))


def merge_changes(key: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for :func:`keep_current` of changes (``old``, ``new``, ``at``, and the key): each entry is what its last change made of it."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        last = batch.groupBy(*key).agg(F.max_by("new", "at").alias("new"))
        now = last.filter("new is not null").select("new.*")
        return now if before is None else before.drop("bucket").join(last.select(*key), key, "left_anti").unionByName(now)

    return merge


def diary_screen(entries: DataFrame, goals: DataFrame, shown: DataFrame, sums: list[str]) -> DataFrame:
    """What the diary shows of a day: its totals, the goal in force, the day before, the days logged (newest first), and whether it is today.

    ``shown``: ``user_id, log_date, today``. A day without entries has 0 entries; a goal that isn't there is null.
    """
    totals = day_totals(entries, ["user_id", "log_date"], sums)
    before = totals.select("user_id", F.date_add("log_date", 1).alias("log_date"), *[F.col(c).alias(f"previous_{c}") for c in ("entries", *sums)])
    dates = totals.groupBy("user_id").agg(F.sort_array(F.collect_list("log_date"), asc=False).alias("logged_dates"))
    days = shown.select("user_id", "log_date", (F.col("log_date") == F.col("today")).alias("is_today"))
    met = days.join(totals, ["user_id", "log_date"], "left").join(before, ["user_id", "log_date"], "left")
    met = met.withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn("previous_entries", F.coalesce("previous_entries", F.lit(0)))
    return asof_join(met, goals, by="user_id", on="log_date", start="effective_from", value="calories_target").join(dates, "user_id", "left")


def live_screens(changes: DataFrame, path: str, checkpoint: str, goals: Callable[[], DataFrame], shown: Callable[[DataFrame], DataFrame], sums: list[str]) -> StreamingQuery:
    """Diary screens kept current: a stream of changes (``user_id, id, old, new, at``) keeps the entries of each user under
    ``path/entries``, and each batch writes anew the screens of the users it touches, as ``path/screens/<batch>``.

    ``goals`` gives the goals as they are now, ``shown`` the days to show of some users' entries.
    """

    def then(batch: DataFrame, number: int, entries: DataFrame | None) -> None:
        def screens(entries: DataFrame) -> DataFrame:
            users = entries.select("user_id").distinct()
            return diary_screen(entries, goals().join(users, "user_id", "left_semi"), shown(entries), sums)

        if entries is not None:
            recompute_touched(batch, "user_id", lambda: entries, screens).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/screens/{number}")

    return keep_current(changes, f"{path}/entries", checkpoint, merge_changes(["user_id", "id"]), ["user_id"], then=then)


def live_windows(changes: DataFrame, path: str, checkpoint: str, goals: Callable[[], DataFrame], sums: list[str], days: int = 28) -> StreamingQuery:
    """Histories kept current: like :func:`live_screens`, with means over the last so many days and the goal in force of each day,
    for the users that a batch touches, as ``path/windows/<batch>``."""

    def then(batch: DataFrame, number: int, entries: DataFrame | None) -> None:
        def windows(some: DataFrame) -> DataFrame:
            return trailing(history(some, goals().join(some.select("user_id").distinct(), "user_id", "left_semi"), sums), sums, days)

        if entries is not None:
            recompute_touched(batch, "user_id", lambda: entries, windows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/windows/{number}")

    return keep_current(changes, f"{path}/entries", checkpoint, merge_changes(["user_id", "id"]), ["user_id"], then=then)


def live_upsert(key: list[str], order: str, keep: list[str] | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for :func:`keep_current`: the last change of a key in a batch replaces its row (profiles, weights, goals)."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        return last if before is None else upsert_by_key(before.select(*batch.columns), last, key, keep)

    return merge


def live_favourites(key: list[str], order: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for :func:`keep_current`: each event sets or clears a favourite."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        base = batch.limit(0) if before is None else before.select(*[c for c in before.columns if c != "bucket"])
        return toggle(base, batch, key, order)

    return merge


def live_logged_dates(changes: DataFrame, user: str = "user_id", date: str = "log_date") -> DataFrame:
    """Days with entries, from running totals: those whose number of entries isn't 0."""
    return live_day_totals(changes, [], [user, date]).filter("entries > 0")


def ingest_products(order: str = "ord") -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge for :func:`keep_current`: accepted products, for each barcode the best so far, the earliest of equals."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        good = batch.filter(gtin_ok(F.col("barcode")) & reject_reason(*[F.col(c) for c in ("kcal", "protein", "fat", "carbs")]).isNull() & ~upstream_error(F.col("errors")))
        both = good if before is None else before.select(*good.columns).unionByName(good)
        return keep_best(both, ["barcode"], [F.col("quality"), F.col("popularity")], order)

    return merge


def goal_in_force(days: DataFrame, goals: DataFrame, by: str = "user_id") -> DataFrame:
    """A batch of days with the goal in force on each: greatest start on or before the day, null where there is none yet."""
    return asof_join(days, goals, by=by, on="log_date", start="effective_from", value="calories_target")


def goal_history(batch: DataFrame, goals: Callable[[], DataFrame], by: str = "user_id") -> DataFrame:
    """For ``foreachBatch``: the goals of the users that a batch touches, each with the last day it was in force."""
    return recompute_touched(batch, by, goals, lambda g: goal_periods(g, by))
