"""Operator 1: mixing sources to target weights by weighted fair queueing.

Every document is one packet of its source's queue, in an order shuffled by a hash. Its virtual finish time is the
queue's words up to and with it, divided by the source's target; all packets are then put into one order by finish
time, by a range sort, and the order is cut where the budget of words is used up. A source whose target is above its
size goes through its queue again, at most ``max_repeats`` times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_PER_TASK, WORD, Scratch, column, running_total, staged


#: Sources are counted on the driver, one row for each; beyond this number it refuses.
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], budget: float, max_repeats: int) -> list[float]:
    """Share ``budget`` by weight; a share stops at ``max_repeats`` times its size and the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0]
    left = float(budget)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def mix(
    docs: DataFrame,
    weights: Callable[[list[str | None]], list[float]],
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    text_col: str = "text",
    key_col: str | None = None,
    budget: float | None = None,
    max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per document, a staged table: ``row_key, <id>, <source>, size, source_size, target, repeats, taken``.

    ``weights`` gets the sources in code point order, null last, and returns a weight for each. ``budget`` (words;
    default: all) is shared by weight under the cap of ``max_repeats`` times a source's size. ``repeats`` is how often
    the document is in the mix, ``taken`` is ``repeats * size``. Sources are counted on the driver: one row for each
    source, the only thing gathered. Documents without words, and those of null id, are kept with what they have:
    size 0 is taken 0 times. ``row_key`` tells rows apart: the column ``key_col`` (long, another for each row), or a number
    made here. Rows without an id are shuffled by their texts. Ties in the shuffled order (rows with one id, size and
    text) are alike, so reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.select(
        column(docs, id_col, "long").alias("doc_id"),
        column(docs, source_col, "string").alias("source"),
        (word_count(column(docs, text_col, "string")) if size is None else size.cast("long")).alias("size"),
        F.xxhash64(column(docs, text_col, "string")).alias("mark"),
        *([] if key_col is None else [column(docs, key_col, "long").alias("tie")]),
    )
    with Scratch(spark, "mixing") as work:
        rows = work.table(rows, "sizes")
        found = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        totals = sorted(((r["source"], r["s"] or 0, r["n"]) for r in found), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
        names, sizes = [r[0] for r in totals], [int(r[1]) for r in totals]
        n_rows = sum(r[2] for r in totals)
        total = float(sum(sizes) if budget is None else budget)
        targets = capped_targets(sizes, weights(names), total, max_repeats)
        table = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(zip(names, sizes, targets, strict=True))], "rank int, source string, source_size long, target double")
        parts = max(1, n_rows // ROWS_PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions")))
        queue = (
            rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["source"]), "left").drop(table["source"])
            .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("mark"))))
        )
        if key_col is None:
            queue = queue.withColumn("tie", F.monotonically_increasing_id())
        # One running total over all sources in a row; what stands before a source's first document is the sum of the sources before it.
        queue = running_total(queue, ["rank", "h", "doc_id", "mark", "tie"], "size", "before", work, parts)
        first, at = [], 0
        for i, n in enumerate(sizes):
            first.append((i, at))
            at += n
        firsts = spark.createDataFrame(first, "rank int, first long")
        queue = queue.join(F.broadcast(firsts), "rank").withColumn("before", F.col("before") - F.col("first"))
        # One copy for each round of the source that can come into the mix; words beyond target + one document never do.
        rounds = F.least(F.lit(max_repeats - 1), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int"))
        copies = (
            queue.filter((F.col("size") > 0) & (F.col("target") > 0))
            .withColumn("round", F.explode(F.sequence(F.lit(0), rounds)))
            .withColumn("finish", (F.col("round") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"))
            .select("tie", "round", "size", "finish", "rank", "h", "mark")
        )
        ordered = running_total(copies, ["finish", "rank", "h", "mark", "tie", "round"], "size", "sent", work, parts)
        repeats = ordered.filter(F.col("sent") + F.col("size") <= F.lit(total)).groupBy("tie").agg(F.count("*").cast("int").alias("repeats"))
        out = (
            queue.join(repeats, "tie", "left")
            .withColumn("repeats", F.coalesce("repeats", F.lit(0)))
            .select(F.col("tie").alias("row_key"), F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))
        )
        return staged(out, "mix")


def cycle_weights(sources: list[str | None]) -> list[float]:
    """The weights 5, 2, 1, again and again, for sources in order."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by the weights 5, 2, 1; one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, cycle_weights).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")
