"""Helpers shared by the corpus operators: the shared work folder, staged tables, ordered prefix sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import Scratch, staged, work_dir, written  # noqa: F401

#: One word of a text: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to a Python worker at once: texts may be long, and workers share the executor's memory.
TEXT_ROWS = 1_000
#: Whole-table jobs aim at this many rows of narrow data in one task.
ROWS_PER_TASK = 250_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, although ``body`` uses it inside other functions."""
    return F.transform(F.array(value), body)[0]


def constant(values: list[int], kind: str) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its exact name, even among others that differ by case or contain dots, or null if absent."""
    if name in df.columns:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name`` (long): a number of each row's own, the same however often the rows are read.

    A table read straight from Parquet gives a row's file and place in it: the place takes the low bits that the longest file
    needs, a hash of the file's name the others, with a seed under which no two files meet. Nothing is written then. Any
    other frame is staged with numbers.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        straight = docs._jdf.queryExecution().analyzed().children().isEmpty()
    except AnalysisException:
        straight = False
    if straight:
        files = placed.groupBy("__file").agg(F.max("__at").alias("most"))
        n, most = files.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(0))).first()
        low = max(1, int(most).bit_length())
        for seed in range(16):
            tag = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__file"), low + 1)
            if files.select(tag).distinct().count() == n:
                return placed.withColumn(name, F.shiftleft(tag, low).bitwiseOR(F.col("__at"))).drop("__file", "__at")
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def flagged(ids: Column, name: str) -> list[Column]:
    """Ids (long) on their way to pandas: 0 for null, and a column that says so. With a null in it, a batch would come as doubles."""
    return [F.coalesce(ids, F.lit(0)).alias(name), ids.isNull().alias("nameless")]


def exact_ids(frame: pd.DataFrame, name: str) -> pd.Series:
    """The ids that ``flagged`` sent, null where they were."""
    return frame[name].astype("Int64").mask(frame["nameless"])


def running_total(df: DataFrame, order: list[str], value: str, out: str, work: Scratch, parts: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long) over all rows before this one in the order of ``order``.

    One range shuffle, never one task for all rows: rows are sorted by range and staged with their range's number,
    a sum per range (one row for each) gives each range its base, and a pass over each range adds up inside it.
    Nulls in ``value`` count as 0; the result has no rows for an empty input.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())

    schema = T.StructType([*ranged.schema.fields, T.StructField("__inside", T.LongType())])

    def inside(batches):
        total = 0
        for batch in batches:  # Arrow, so that long columns with nulls stay exact
            v = batch.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = v.cumsum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total + c - v, pa.int64())], names=[*batch.schema.names, "__inside"])
            total += int(c[-1]) if len(c) else 0

    table = work.table(ranged.mapInArrow(inside, schema), out)
    sums = {r["__part"]: r["s"] or 0 for r in table.groupBy("__part").agg(F.sum(value).alias("s")).collect()}  # one row a range
    base, at = [], 0
    for part in range(max(sums, default=-1) + 1):
        base.append((part, at))
        at += sums.get(part, 0)
    bases = spark.createDataFrame(base, "__part int, __base long")
    return table.join(F.broadcast(bases), "__part").withColumn(out, F.col("__base") + F.col("__inside")).drop("__part", "__base", "__inside")
