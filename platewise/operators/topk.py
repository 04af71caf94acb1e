"""Bounded selection: each key's best rows, chosen where the rows are before any of them move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark selects within tasks only up to this limit (``spark.sql.optimizer.windowGroupLimitThreshold``).
THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Shards of a key for greater limits.
SHARDS = 64


def top_rows(rows: DataFrame, by: list[str], order: list[Column | str], limit: Column, most: int, *, name: str = "place", shards: int = SHARDS) -> DataFrame:
    """The first ``limit`` rows of each key in an order, with ``name``: their place from 1.

    ``limit`` may be a column, as long as no value is above ``most``; null or 0 and less select nothing. ``most`` goes into
    the plan as a number: each task then keeps no more than ``most`` rows of a key as it reads them, only those are
    shuffled, and the final choice is among ``most`` rows a task, so a key that holds all rows is never sorted in one
    task. Beyond Spark's threshold for that, a key's rows are dealt over ``shards`` by their content and chosen twice.
    ``order`` must leave no ties for a result that reruns alike.
    """
    place = F.col(f"`{name}`")
    bounded = (place <= F.lit(int(most))) & (place <= limit)
    if most > int(rows.sparkSession.conf.get(THRESHOLD)):
        shard = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if not dict(rows.dtypes)[c].startswith("map")]), F.lit(shards))
        rows = rows.withColumn("__shard", shard)
        first = F.row_number().over(Window.partitionBy(*by, "__shard").orderBy(*order))
        rows = rows.withColumn(name, first).filter(bounded).drop(name, "__shard")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(bounded)


def greatest(limits: DataFrame, column: str = "limit") -> int:
    """The greatest limit of a batch: one number for the driver."""
    return int(limits.agg(F.max(column)).first()[0] or 0)
