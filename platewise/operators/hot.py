"""Operators for keys that hold too many rows for one task: exact quantiles by refinement, as-of joins over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import Scratch, staged

#: Classes that a range of values is cut into at once, and values that are few enough to be put in order in one row.
CLASSES, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], *, classes: int = CLASSES, few: int = FEW) -> DataFrame:
    """``<by>`` and one column for each of ``quantiles`` (name: share from 0 to 1) of ``value``, a staged table; null values and NaN don't count.

    Between two values that a share falls between, it is in proportion. Exact for a group of any size: values are counted by
    class, in partial aggregation, and only the class that holds a wanted rank is looked at again, until it holds few
    values. A task never holds a group's values, only classes; a round reads the table once. Values must be finite. A
    group without values has no row.
    """
    key = F.struct(*by).alias("key") if by else F.struct(F.lit(0).alias("all")).alias("key")
    with Scratch(rows.sparkSession, "quantiles") as work:
        values = rows.select(key, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
        stats = work.table(values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "stats")
        wanted = stats.select("key", "n", "low", "high", F.explode(F.array(*[F.struct(F.lit(q).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for q, p in quantiles.items()])).alias("q"))
        wanted = work.table(wanted.select("key", F.col("q.name").alias("name"), F.col("q.at").alias("at"), "n", "low", "high"), "wanted")
        ranks = wanted.select("key", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("c")).distinct()
        open_ = work.table(ranks, "ranks")
        while (open_.filter(F.col("low") < F.col("high")).agg(F.max("c")).first()[0] or 0) > few:
            # Halves first, so that a range as wide as all numbers stays finite.
            share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
            wide = open_.filter((F.col("low") < F.col("high")) & (F.col("c") > few))
            met = values.join(wide, "key").filter("v between low and high").withColumn("class", F.least(F.floor(share * classes), F.lit(classes - 1)))
            counted = met.groupBy("key", "rank", "class").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("below").alias("below"))
            before = F.sum("c").over(Window.partitionBy("key", "rank").orderBy("class").rowsBetween(Window.unboundedPreceding, -1))  # of at most so many classes
            cut = counted.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0))).filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c")))
            kept = open_.join(wide.select("key", "rank"), ["key", "rank"], "left_anti")
            open_ = work.table(kept.unionByName(cut.select(*open_.columns)), "ranks")
        narrow = open_.filter(F.col("low") < F.col("high"))
        sorted_ = values.join(narrow, "key").filter("v between low and high").groupBy("key", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("below").alias("below"))
        found = open_.filter(F.col("low") == F.col("high")).select("key", "rank", F.col("low").alias("v")).unionByName(sorted_.select("key", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
        found = work.table(found, "found")
        lower, upper = found.select("key", F.col("rank").alias("r0"), F.col("v").alias("v0")), found.select("key", F.col("rank").alias("r1"), F.col("v").alias("v1"))
        both = wanted.withColumn("r0", F.floor("at")).withColumn("r1", F.ceil("at")).join(lower, ["key", "r0"]).join(upper, ["key", "r1"])
        one = both.select("key", "name", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("r0"))).alias("v"))
        out = one.groupBy("key").agg(*[F.max(F.when(F.col("name") == q, F.col("v"))).alias(q) for q in quantiles])
        return staged(out.select(*[F.col(f"key.{c}") for c in by], *quantiles), "quantiles")


def asof_over_ranges(days: DataFrame, versions: DataFrame, *, by: str, on: str, start: str, value: str, parts: int | None = None) -> DataFrame:
    """What :func:`platewise.operators.diary.asof_join` gives, for keys of any length: a staged table.

    Days and versions are put in one order by range, so that one key's rows may lie in many ranges, each a task's work. A
    day takes the last version of its key within its range, or else the last one of the ranges before, of which there is
    one row for each key and range.
    """
    spark = days.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = days.select(F.struct(*[F.col(f"`{c}`") for c in days.columns]).alias("row")).schema[0].dataType
    held = versions.groupBy(F.col(by).alias("key"), F.col(start).alias("at")).agg(F.max(F.col(value)).alias("v")).select("key", "at", F.lit(0).alias("kind"), F.struct("v").alias("version"), F.lit(None).cast(whole).alias("row"))
    asked = days.select(F.col(by).alias("key"), F.col(on).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(held.schema["version"].dataType).alias("version"), F.struct(*[F.col(f"`{c}`") for c in days.columns]).alias("row"))
    with Scratch(spark, "asof") as work:
        spread = F.xxhash64("row")  # rows of one key and day may be more than a range holds
        ranged = held.unionByName(asked).withColumn("spread", F.when(F.col("kind") == 1, spread).otherwise(F.lit(-(1 << 63))))
        ranged = work.table(ranged.repartitionByRange(parts, "key", "at", "kind", "spread").withColumn("part", F.spark_partition_id()), "ranges")
        w = Window.partitionBy("part", "key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        inside = ranged.withColumn("last", F.last("version", ignorenulls=True).over(w)).filter("kind = 1")
        ends = ranged.groupBy("part", "key").agg(F.max_by("version", F.when(F.col("kind") == 0, F.col("at"))).alias("tail"))
        carry = F.last("tail", ignorenulls=True).over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.withColumn("carried", carry).filter("carried is not null").select(F.col("part").alias("p"), F.col("key").alias("k"), "carried")
        met = inside.join(carried, (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")), "left")
        return staged(met.select("row.*", F.coalesce("last", "carried")["v"].alias(value)), "asof")
