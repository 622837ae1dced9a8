"""Small state tables of ``foreachBatch`` jobs, one version per micro-batch.

A batch reads the version before it and writes its own, so running a batch again after a
failure gives the same result.  Versions carry the streaming query's id: a new query (a new
checkpoint) over an existing state folder goes on from the newest version there.  Versions
older than the last two are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

BatchFn = Callable[[DataFrame, int], None]
KEPT = 2


def _query(spark: SparkSession) -> str:
    """Id of the streaming query that runs this batch; it outlives restarts."""
    return (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch").replace("-", "")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """Committed versions ``(number, query, batch)``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        place = status.getPath()
        name = place.getName()
        if name.startswith("v=") and files.exists(
                spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
            number, query, batch = name[2:].split("-")
            found.append((int(number), query, int(batch)))
    return sorted(found)


def _before(spark: SparkSession, path: str, batch_id: int) -> list[tuple[int, str, int]]:
    """Versions that this batch builds on: not its own, nor of later batches of its query."""
    query = _query(spark)
    return [v for v in _versions(spark, path) if v[1] != query or v[2] < batch_id]


def _name(path: str, version: tuple[int, str, int]) -> str:
    return f"{path}/v={version[0]:010d}-{version[1]}-{version[2]}"


def read(spark: SparkSession, path: str, batch_id: int, schema: StructType | str) -> DataFrame:
    """State before a batch; empty where there is none."""
    earlier = _before(spark, path, batch_id)
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_name(path, earlier[-1]))


def write(df: DataFrame, path: str, batch_id: int) -> None:
    spark = df.sparkSession
    earlier = _before(spark, path, batch_id)
    number = earlier[-1][0] + 1 if earlier else 0
    df.write.mode("overwrite").parquet(_name(path, (number, _query(spark), batch_id)))
    for version in earlier[:-KEPT]:
        old = spark._jvm.org.apache.hadoop.fs.Path(_name(path, version))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def emit(df: DataFrame, path: str, batch_id: int) -> None:
    """Output of a batch, replaced as a whole when the batch runs again."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={_query(df.sparkSession)}-{batch_id}")


def read_parts(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What other batches have emitted to ``path``; a batch that runs again does not see itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    own = f"{_query(spark)}-{batch_id}"
    return (spark.read.schema(f"{schema}, batch_id string").parquet(path)
            .where(F.col("batch_id") != own).drop("batch_id"))


def writer(stream: DataFrame, fn: BatchFn, checkpoint: str) -> DataStreamWriter:
    """A writer that takes what has arrived and stops; set another trigger to keep it running."""
    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True))
