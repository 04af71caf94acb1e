"""Tables stored for the lookups that are asked of them: bucketed and sorted by key, the diary also by month.

A join on the key moves only the rows that ask; a window of days opens only the files of its months. Tables are in the
session's catalogue, their files in a folder that the caller names.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a stored table: as many tasks look things up in it.
BUCKETS = 64


def store_by_key(rows: DataFrame, table: str, path: str, key: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """Store a table by key and give it back: one file for each bucket, sorted, so that joins on ``key`` find it in place.

    Rows are dealt over the buckets before they are written, by the hash that buckets go by, so that each has one file.
    """
    dealt = rows.repartition(buckets, *key)
    dealt.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def store_diary(entries: DataFrame, table: str, path: str, *, user: str = "user_id", date: str = "log_date", buckets: int = BUCKETS) -> DataFrame:
    """Store entries by month, and in each month bucketed by user and sorted by user and day: ``month`` (the first of it) is added.

    An entry without a day is of no month: it is kept apart, and in no window.
    """
    dealt = entries.withColumn("month", F.trunc(date, "MM")).repartition(buckets, user)
    dealt.write.mode("overwrite").partitionBy("month").bucketBy(buckets, user).sortBy(user, date).option("path", path).saveAsTable(table)
    return entries.sparkSession.table(table)


def days_between(stored: DataFrame, first: datetime.date, last: datetime.date, *, date: str = "log_date") -> DataFrame:
    """Entries of a window of days, both ends included; other months aren't opened."""
    month: Column = F.col("month").between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))
    return stored.filter(month & F.col(date).between(F.lit(first), F.lit(last))).drop("month")


def resolve_codes(asked: DataFrame, codes: DataFrame, foods: DataFrame, *, code: str = "barcode", food: str = "food_id") -> DataFrame:
    """Rows that ask with what ``codes`` and then ``foods`` (stored by code, and by ``id``) say; null where there is nothing.

    The rows that ask move once to the codes and once to the foods; the stored tables stay where they are.
    """
    met = asked.join(codes.select(code, food), code, "left")
    return met.join(foods.withColumnRenamed("id", food), food, "left")


def forget(spark: SparkSession, *tables: str) -> None:
    """Take tables out of the catalogue; their files stay with whoever named the folder."""
    for t in tables:
        spark.sql(f"drop table if exists `{t}`")
