"""Incremental processing with Structured Streaming: new files in, each key once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema, key: str, target: str, checkpoint: str, transform=lambda df: df, files_per_trigger: int = 25) -> None:
    """Take the files that came since the last call, in micro-batches, and append keys that ``target`` doesn't have.

    The checkpoint remembers the files; a batch that is run again after a
    failure adds nothing twice, because it leaves out the keys that are there.
    """

    def append(batch: DataFrame, _: int) -> None:
        rows = transform(batch).dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local master without it uses one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or '/tmp/checkpoints'}/stream-{uuid.uuid4().hex}"


def once(spark: SparkSession, source: str, transform, key: str) -> DataFrame:
    """``source`` processed as a stream until nothing is new, twice; the keys that came of it."""
    folder = shared_folder(spark)
    schema = spark.read.parquet(source).schema
    # A stream lists folders, so the file or folder is named by a pattern.
    for _ in range(2):
        process_new(spark, source + "*", schema, key, f"{folder}/out", f"{folder}/state", transform)
    return spark.read.parquet(f"{folder}/out")
