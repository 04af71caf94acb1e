"""Operators on whole tables that loaders and catalogue share: pivots, reports, contracts, set checks, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what was agreed; nothing has been written."""


def assert_columns(df: DataFrame, required: list[str], pinned: dict[int, str] | None = None) -> None:
    """Raise if a required column is missing, a name repeats, or a column isn't at its pinned position."""
    names = df.columns
    missing = [c for c in required if c not in names]
    repeated = sorted({c for c in names if names.count(c) > 1})
    moved = [f"{i}: {names[i] if i < len(names) else None} for {c}" for i, c in (pinned or {}).items() if i >= len(names) or names[i] != c]
    if missing or repeated or moved:
        raise ContractError(f"missing {missing}, repeated {repeated}, moved {moved}")


def assert_empty(df: DataFrame, what: str) -> None:
    """Raise with the first rows of a table of violations."""
    if rows := df.limit(5).collect():
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def pivot_values(values: DataFrame, key: str, field: str, value: str, order: list[str], fields: list) -> DataFrame:
    """Long values to one row per key: of each (key, field) the last by ``order`` counts. One shuffle, no window."""
    last = [F.max(F.when(F.col(field) == f, F.struct(*order, F.col(value).alias("__v"))))["__v"].alias(str(f)) for f in fields]
    return values.filter(F.col(field).isin(*fields)).groupBy(key).agg(*last)


def reject_report(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Rows by reason, most first; those kept are listed as ``kept``."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one of two tables, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def duplicates_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise if an id repeats, before anything is written."""
    assert_empty(duplicates_by(df, [key]), f"repeated {key}")


def reject_ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Add ``reject_reason``: all rows of a key that occurs twice are rejected, whichever came first."""
    again = duplicates_by(df, [key]).select(key, F.lit("ambiguous code").alias("reject_reason"))
    return df.join(again, key, "left")


def unique_or_null(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key where there is only one, else null."""
    return df.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def reconcile(wide: DataFrame, detail: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Violations between a wide table (made long) and its details: values that differ, or a detail missing for a value."""
    a, b = wide.select(*keys, F.col(value).alias("wide_value")), detail.select(*keys, F.col(value).alias("detail_value"), F.lit(True).alias("there"))
    both = a.join(b, keys, "full_outer")
    return both.filter(~F.col("wide_value").eqNullSafe(F.col("detail_value")) | (F.col("there").isNull() & F.col("wide_value").isNotNull())).drop("there")


def pair_by_occurrence(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Full outer join in which the n-th row of a key on one side meets the n-th on the other (``n``, ``l`` and ``r`` structs)."""
    w = Window.partitionBy(key).orderBy(order)
    a = left.select(key, F.row_number().over(w).alias("n"), F.struct(*left.columns).alias("l"))
    b = right.select(key, F.row_number().over(w).alias("n"), F.struct(*right.columns).alias("r"))
    return a.join(b, [key, "n"], "full_outer")


def dedupe_best(df: DataFrame, key: list[str], best: list[Column], order: str) -> DataFrame:
    """Add ``place`` in each key's ranking: 1 for the best by ``best`` (largest first), the earliest of equals."""
    w = Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in best], F.col(order).asc())
    return df.withColumn("place", F.row_number().over(w))


def keep_best(df: DataFrame, key: list[str], best: list[Column], order: str) -> DataFrame:
    """The best row of each key only, by one aggregation: rows are combined before they move, so a hot key is no hot task."""
    rank = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(best)], (-F.col(order)).alias("o"))
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), rank).alias("__r")).select("__r.*")


def content_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and a digest that doesn't depend on their order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


#: Parts that two tables are compared by: as many digests a side are all that meets where the tables are equal.
DIGESTS = 4096


def bucket_digests(df: DataFrame, buckets: int = DIGESTS) -> DataFrame:
    """``bucket, n, sum, xor`` of the rows of each bucket (rows are dealt by their content): digests that don't depend on order.

    Nulls are marked, so that (null, 1) isn't (1, null).
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    marks = [c.isNull() for c in cols]
    h = df.select(F.xxhash64(*cols, *marks).alias("h"), F.xxhash64(F.lit(1), *cols, *marks).alias("x"))
    bucket = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")
    return h.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("x").alias("xor"))


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = DIGESTS) -> DataFrame:
    """``bucket`` of which two tables hold different rows: at most ``buckets`` rows."""
    one, two = bucket_digests(a, buckets), bucket_digests(b, buckets)
    both = one.join(two.toDF("bucket", "n2", "sum2", "xor2"), "bucket", "full_outer")
    return both.filter(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("sum").eqNullSafe(F.col("sum2")) & F.col("xor").eqNullSafe(F.col("xor2")))).select("bucket")


def table_diff(a: DataFrame, b: DataFrame, *, buckets: int = DIGESTS) -> DataFrame:
    """Rows of only one of two tables, with repeats, and the side that has them. Columns are matched by position, as in ``exceptAll``.

    The tables are first held against each other by digests of buckets, one aggregation a side; only rows of buckets that
    differ are compared, so equal tables, or nearly equal ones, are never joined as a whole. Tables with maps, which
    have no hash, are.
    """
    if not any("map<" in t for _, t in a.dtypes + b.dtypes) and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]:
        b = b.toDF(*a.columns)
        odd = F.broadcast(differing_buckets(a, b, buckets))

        def some(df: DataFrame) -> DataFrame:
            cols = [F.col(f"`{c}`") for c in df.columns]
            marked = df.withColumn("__bucket", F.pmod(F.xxhash64(*cols, *[c.isNull() for c in cols]), F.lit(buckets)).cast("int"))
            return marked.join(odd.withColumnRenamed("bucket", "__bucket"), "__bucket", "left_semi").drop("__bucket")

        a, b = some(a), some(b)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
