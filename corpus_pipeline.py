"""A training corpus from raw documents, in stages over the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a frame whose rows are
written as Parquet and read again as the next stage's docs. A stage may read
tables that it wrote itself; they go when the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm._common import Scratch, settle
from routeloom.llm.best_fit_packing import pack_documents, tokenizer_file
from routeloom.llm.decontamination import without_contamination
from routeloom.llm.ngram_join import jaccard_components
from routeloom.llm.suffix_dedup import remove_repeats
from routeloom.llm.toxicity import score_toxicity

_held: list[Scratch] = []


def _begin() -> None:
    while _held:
        _held.pop().drop()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    _begin()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, carry=docs.columns)
    return scored.where("predicted = 0").select("record.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Of rows that repeat that doc_id within the group one stays. Documents
    without words and rows without a doc_id stay.
    """
    _begin()
    with Scratch(spark) as scratch:
        rows = jaccard_components(scratch, docs.select("doc_id", "text")).where("n_shingles > 0 and doc_id is not null")
        rows = settle(rows.select("doc_id", "component_id"))
    leave = rows.where("doc_id != component_id").select("doc_id").distinct()
    twice = rows.groupBy("doc_id", "component_id").count().where("count > 1 and doc_id = component_id").select("doc_id", F.lit(True).alias("_twice"))
    records = docs.select("doc_id", "text", F.struct("*").alias("record"))
    kept = records.join(settle(leave), "doc_id", "left_anti").join(settle(twice), "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = kept.where("_twice").withColumn("_row", first).where("_row = 1").drop("_row")
    return kept.where("_twice is null").unionByName(once).select("record.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents with a smaller doc_id hold too are cut out; n_chars follows, null text comes out empty."""
    _begin()
    scratch = Scratch(spark)
    _held.append(scratch)
    rest = [c for c in docs.columns if c != "text"]
    out = remove_repeats(scratch, docs, rest=rest)
    text = F.col("kept").cast("string")
    values = {c: F.col(f"rest.{c}") for c in rest} | {"text": text}
    if "n_chars" in values:
        values["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _begin()
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: a row for each piece."""
    _begin()
    out = pack_documents(docs, tokenizer_file())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The models, the suffix merge and the tokenizer can't be put into SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        return settle(STAGES[-1][1](spark, docs, sf_dir))
