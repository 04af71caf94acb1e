"""A training-corpus pipeline of four operators: language ID, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes all that its predecessor kept. The first three return the columns of ``documents``; the last returns the
packed pieces. A document that the mix repeats is packed as often, so its rows repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import row_keys, staged
from platewise.llm.jaccard import jaccard_classes
from platewise.llm.language import UNKNOWN, identify, learned
from platewise.llm.mixing import cycle_weights, mix
from platewise.llm.packing import pack_documents


#: A number of each row's own, while a stage works.
ROW = "__row"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or any letter go. Learned from the labelled documents of the input."""
    return identify(docs, learned(docs)).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def chosen(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Rows that a narrow staged table ``some`` names by ``ROW``, with its columns.

    Whole texts move once, unsorted, to meet a hash table of the few numbers of their partition: one plan at any size.
    """
    return rows.join(some.hint("shuffle_hash"), ROW)


def distinct_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect: the one of smallest id, nulls last, whatever ids the rows share.

    Rows of equal id, or all without one, are in the order of a hash of the text. Rows without words are kept as they are.
    """
    rows = row_keys(docs, ROW)
    # The operator's id is the row's own number here, so that a component names the class of a row.
    classes = jaccard_classes(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("__class"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col(ROW).alias("row"))
    least = rows.select(ROW, order.alias("__order")).join(classes, ROW).groupBy("__class").agg(F.min("__order").alias("__order"))
    kept = staged(least.select(F.col("__order.row").alias(ROW)), "distinct")
    return chosen(rows, kept).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by the weights 5, 2, 1 over the sources: each row comes as often as it is taken, or goes, whatever its id."""
    rows = row_keys(docs, ROW)
    taken = mix(rows, cycle_weights, key_col=ROW).filter("repeats > 0").select(F.col("row_key").alias(ROW), F.col("repeats").alias("__repeats"))
    return chosen(rows, taken).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack_documents(docs)


STAGES = [("language ID", language_stage), ("n-gram Jaccard join", distinct_stage), ("mixing sources to target weights", mixing_stage), ("best-fit packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
