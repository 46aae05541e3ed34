"""Shared plumbing: scratch tables in the cluster's shared folder, and text helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a folder set on the
    context is used; a local master (tests) gets one of its own. Any other
    master without the setting is an error: a machine-local folder would lose
    files on a cluster.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        if not context.getCheckpointDir():
            context.setCheckpointDir(root)
        return root.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Written tables under the shared folder, removed by ``drop``.

    They cut lineage: a lost executor re-reads files instead of repeating the
    steps before them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/routeloom-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        path = f"{self.path}/{name}"
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Write ``df`` once, hash-partitioned by ``column``; grouping by it later needs no shuffle."""
        table = f"routeloom_{name}_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, column)
            .write.option("compression", "zstd")
            .option("path", f"{self.path}/{name}")
            .bucketBy(buckets, column)
            .saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def remove(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Result rows in the shared checkpoint folder, free of the scratch tables that made them."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs without the bytes 0x20 and 0x09 to 0x0D."""
    return text.split()


def as_bytes(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
