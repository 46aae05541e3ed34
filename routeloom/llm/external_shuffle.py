"""Sharding by a two-pass external shuffle.

Pass 1 scatters records into memory-sized buckets by a seeded hash; the
exchange on disk is the external scatter. Pass 2 puts each bucket in a fixed
order, shuffles it with Fisher-Yates under a generator seeded by (seed,
bucket), and writes it. A record's place in the whole order is its bucket's
offset plus its place in the bucket; shard s takes places floor(s*N/S) up to
floor((s+1)*N/S), so shard sizes differ by at most one record (law ``rows``).

The hash covers the seed, id, text and input partition: one hot id, or a third
of all rows being equal, still spreads over buckets, and a retried task puts
its rows where they were.

Defined results: null text counts as empty in sizes and stays null in the
written record; repeated rows are separate records; an empty table writes
nothing. Records are kept as one struct, so no column name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import Scratch, settle

BUCKET_BYTES = 8 << 20


def fisher_yates(seed: int):
    import numpy as np
    import pyarrow as pa

    def shuffle(key, table):
        import pyarrow.compute as pc

        bucket = key[0].as_py()
        table = table.take(pc.array_sort_indices(table["spread"].combine_chunks()))  # the exchange delivers in any order
        drawn = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(table.num_rows)
        table = table.take(pa.array(drawn))
        return table.append_column("place", pa.array(np.arange(table.num_rows, dtype=np.int64)))

    return shuffle


def bucket_offsets(scratch: Scratch, counts: DataFrame, group: int = 4096) -> tuple[DataFrame, int]:
    """bucket and before (records of all buckets before it), and the number of records; ``counts``: bucket, count.

    Running sums within groups of buckets, then over the groups, so that no
    task and no driver holds a row for every bucket.
    """
    counts = scratch.write(counts.withColumn("part", F.expr(f"bucket div {group}L")), "counts")
    sums = scratch.write(counts.groupBy("part").agg(F.sum("count").alias("n")), "sums")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each ``group`` buckets.
    starts = sums.select("part", F.coalesce(F.sum("n").over(earlier().orderBy("part")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("count").over(earlier("part").orderBy("bucket")), F.lit(0))
    offsets = counts.withColumn("within", within).join(starts, "part").select("bucket", (F.col("start") + F.col("within")).alias("before"))
    return scratch.write(offsets, "offsets"), sums.agg(F.sum("n")).first()[0] or 0


def shuffle_into_shards(records: DataFrame, path: str, shards: int = 24, seed: int = 20260904, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all records, shuffled, under ``path`` in folders shard=0 to shard=``shards``-1; return what was written.

    Returns record (struct of all columns), slot (place within the shard, from 0), shard.
    """
    spark = records.sparkSession
    with Scratch(spark) as scratch:
        size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8
        total = records.agg(F.sum(size.cast("long"))).first()[0] or 0
        buckets = max(1, -(-total // bucket_bytes))
        packed = records.select(F.struct("*").alias("record"), F.xxhash64(F.lit(seed), F.spark_partition_id(), F.col(id_col), F.col(text_col)).alias("spread"))
        packed = packed.withColumn("bucket", F.expr(f"pmod(spread, {buckets}L)"))
        schema = StructType([*packed.schema.fields, StructField("place", LongType())])
        shuffled = packed.groupBy("bucket").applyInArrow(fisher_yates(seed), schema)
        staged = scratch.write(shuffled.drop("spread"), "staged")
        offsets, n = bucket_offsets(scratch, staged.groupBy("bucket").count())
        # A written table of known size: sent whole while it is small, shuffled beyond that.
        placed = staged.join(offsets, "bucket").withColumn("at", F.col("before") + F.col("place"))
        shard = F.expr(f"(({shards}L * (at + 1)) - 1) div {max(n, 1)}L")
        placed = placed.withColumn("shard", shard.cast("int"))
        placed = placed.withColumn("slot", F.col("at") - F.expr(f"(shard * {n}L) div {shards}L"))
        placed = placed.select("record", "slot", "shard")
        placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with Scratch(spark) as scratch:
        written = shuffle_into_shards(docs, f"{scratch.path}/shards")
        text = F.coalesce(F.col("record.text"), F.lit(""))
        return settle(
            written.select(
                F.col("record.doc_id").alias("doc_id"),
                (F.octet_length(text) + 8).cast("long").alias("size"),
                F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
                F.lit("rows").alias("law"),
                F.col("shard").cast("int").alias("shard"),
                F.col("slot").cast("long").alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"),
            )
        )
