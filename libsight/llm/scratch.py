"""Intermediate tables in the shared checkpoint folder, removed when they are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from libsight.session import checkpoint_dir


class Scratch:
    """``with Scratch(spark) as keep:`` — ``keep(df)`` writes ``df`` and reads it back.

    The tables live in ``spark.checkpoint.dir``, which all executors share, so a lost executor
    loses nothing.  Results must not read them lazily after the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.number = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.base}/{self.number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
