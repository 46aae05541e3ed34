"""Resume, retry and discovery bookkeeping as anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def pending(seeds: DataFrame, done: DataFrame, key: str = "repo_id") -> DataFrame:
    """Seeds that aren't processed yet."""
    return seeds.join(done.select(key), key, "left_anti")


def pruned(rows: DataFrame, errors: DataFrame, key: str = "repo_id") -> DataFrame:
    """Rows without those of repositories that are to be tried again."""
    return rows.join(errors.where("retryable").select(key), key, "left_anti")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    at = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def search_queries(spark: SparkSession, terms: list[str], languages: list[str], stars: int, since: str = "2024-01-01", max_kb: int = R.MAX_REPOSITORY_KB) -> DataFrame:
    """ord, query: every term with every language, then every term alone with five times the stars."""
    t = spark.createDataFrame(list(enumerate(terms)), "i long, term string")
    g = spark.createDataFrame(list(enumerate(languages)), "j long, language string")
    rest = f" pushed:>={since} size:<{max_kb} archived:false fork:false"
    # Two configured lists, not data: the product is what is asked for.
    both = t.crossJoin(F.broadcast(g)).select((F.col("i") * len(languages) + F.col("j")).alias("ord"), F.concat("term", F.lit(" language:"), "language", F.lit(f" stars:>={stars}{rest}")).alias("query"))
    alone = t.select((F.col("i") + len(terms) * len(languages)).alias("ord"), F.concat("term", F.lit(f" stars:>={5 * stars}{rest}")).alias("query"))
    return both.unionByName(alone)


def framework_of(haystack, language):
    return T.first_marker(F.lower(haystack), R.FRAMEWORK_MARKERS, language)
