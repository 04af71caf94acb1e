"""Staged tables: long plans are cut at tables in the shared folder, which outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once while a table is written: texts may be long, and workers share the executor's memory.
PYTHON_ROWS = 1_000


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (``local``, as in tests) may leave that setting out: a temporary folder is made for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for a dot) that hold for the actions inside only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, path: str, **options: str) -> None:
    """Write Parquet. Whole texts go to Python workers in small batches meanwhile; shuffle files go when the table is there."""
    with setting(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(PYTHON_ROWS), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**options).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files that outlive executors."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that an operator stages for itself, in a folder of their own in the shared one; they go when the work is done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`staged`."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        written(df, path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for table, path in self.paths:
            if any(table is x for x in tables):
                remove(self.spark, path)

    def clear(self) -> None:
        """Remove all tables: nothing reads them any more."""
        remove(self.spark, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()
