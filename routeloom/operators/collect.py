"""Seeds, repository rows and the outputs of a collecting run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .discovery import REPOSITORY_URL

EXTRACTOR_VERSION = "0.1.0"
LAST = 10**12
#: Keys that say that a seed has been looked up already.
CARRIED = ["stars", "forks", "license", "last_activity", "default_branch"]
SEED = "repository_url string, url string, owner string, name string, language string, framework string, stars long, forks long, license string, last_activity string, default_branch string, project_category string, fork_parent string, probable_template string, probable_origin string, vendor string, commit_hash string, local_path string"


def seeds(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Seeds of JSON documents (value): a list, or an object with ``repositories``; items are addresses or objects.

    ordinal counts from 1 in each document; carried says that the item has
    looked-up values. An item without an address is an error, as is an
    address that names no repository where owner and name are missing.
    """
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.repositories"), "array<string>"), F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")))
    items = documents.select("*", F.posexplode(listed).alias("at_", "item_"))
    if limit is not None:
        items = items.where(F.col("at_") < limit)
    is_object = F.ltrim("item_").startswith("{")
    items = items.withColumn("seed_", F.when(is_object, F.from_json("item_", SEED)))
    given = lambda c: F.nullif(F.col(f"seed_.{c}"), F.lit(""))
    url = F.when(is_object, F.coalesce(given("repository_url"), given("url"))).otherwise(F.col("item_"))
    url = F.coalesce(url, F.raise_error(F.concat(F.lit("seed item without repository_url: "), "item_")))
    items = items.withColumn("url_", url)
    named = F.col("url_").rlike(REPOSITORY_URL)
    part = lambda i: F.when(named, F.regexp_extract(F.trim("url_"), REPOSITORY_URL, i)).otherwise(F.raise_error(F.concat(F.lit("not a repository address: "), "url_")))
    both = given("owner").isNotNull() & given("name").isNotNull()
    carried = F.when(is_object, F.arrays_overlap(F.json_object_keys("item_"), F.array(*[F.lit(c) for c in CARRIED]))).otherwise(F.lit(False))
    rest = [c.split()[0] for c in SEED.split(", ") if c.split()[0] not in ("repository_url", "url", "owner", "name")]
    return items.select(
        *[c for c in documents.columns if c != "value"],
        (F.col("at_") + 1).cast("long").alias("ordinal"),
        F.col("url_").alias("repository_url"),
        F.when(both, given("owner")).otherwise(part(1)).alias("owner"),
        F.when(both, given("name")).otherwise(part(2)).alias("name"),
        *[F.col(f"seed_.{c}").alias(c) for c in rest],
        carried.alias("carried"),
    )


def some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def repositories(items: DataFrame, found: DataFrame) -> DataFrame:
    """Repository rows from seeds and what a look-up ``found`` (repo_id, language, stargazers_count, forks_count, license struct, pushed_at, default_branch, parent).

    The seed's value counts before the looked-up one; stars and forks also if they are 0.
    """
    own = items.withColumn("repo_id", F.concat("owner", F.lit("/"), "name"))
    f = found.select("repo_id", F.struct(*[c for c in found.columns if c != "repo_id"]).alias("f"))
    rows = own.join(f, "repo_id", "left")
    parent = F.coalesce("f.parent", "fork_parent")
    return rows.select(
        "repo_id", "repository_url", "owner", "name",
        some(F.col("language"), F.col("f.language")).alias("language"),
        "framework",
        F.coalesce("stars", "f.stargazers_count").alias("stars"),
        F.coalesce("forks", "f.forks_count").alias("forks"),
        some(F.col("license"), F.col("f.license.spdx_id"), F.col("f.license.key")).alias("license"),
        some(F.col("last_activity"), F.col("f.pushed_at")).alias("last_activity"),
        some(F.col("default_branch"), F.col("f.default_branch")).alias("default_branch"),
        "commit_hash", "project_category",
        parent.alias("fork_parent"),
        some(F.col("probable_template"), T.template_of(F.col("owner"), F.col("name"))).alias("probable_template"),
        some(F.col("probable_origin"), parent).alias("probable_origin"),
        some(F.col("vendor"), F.col("owner")).alias("vendor"),
        "local_path",
    )


def evidence_records(rows: DataFrame) -> DataFrame:
    """Evidence rows in their stored form: upper-case method, sorted distinct codes, line_end, rounded confidence, version."""
    line_end = F.col("line_end") if "line_end" in rows.columns else F.lit(None)
    return rows.withColumns({
        "method": F.upper("method"),
        "codes": F.array_sort(F.array_distinct(F.coalesce("codes", F.expr("cast(array() as array<int>)")))),
        "line_end": F.coalesce(F.nullif(line_end.cast("int"), F.lit(0)), F.col("line").cast("int")),
        "confidence": F.round(F.coalesce("confidence", F.lit(0.5)).cast("double"), 4),
        "extractor_version": F.lit(EXTRACTOR_VERSION),
    })


def error_records(rows: DataFrame, stage: str) -> DataFrame:
    """Error rows (repo, error_type, error, retryable) with their stage and the time."""
    return rows.select("repo", F.lit(stage).alias("stage"), "error_type", "error", F.coalesce("retryable", F.lit(False)).alias("retryable"), T.utc_now().alias("timestamp"))


def in_seed_order(rows: DataFrame, seeds: DataFrame, repo: str, then: list[str]) -> DataFrame:
    """``rows`` with seed_order (unknown repositories last), sorted by it and ``then``."""
    order = seeds.select(F.concat("owner", F.lit("/"), "name").alias(repo), "ordinal").groupBy(repo).agg(F.min("ordinal").alias("seed_order"))
    out = rows.join(order, repo, "left").withColumn("seed_order", F.coalesce("seed_order", F.lit(LAST)))
    return out.orderBy("seed_order", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "line" else F.coalesce(c, F.lit(0)) for c in then])


def stream_outputs(repositories: DataFrame, evidence: DataFrame, errors: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three outputs of a run in the order in which they are written."""
    return (
        in_seed_order(repositories, seeds, "repo_id", []),
        in_seed_order(evidence, seeds, "repository", ["file", "line", "method", "path", "concept"]),
        in_seed_order(errors, seeds, "repo", ["stage", "error_type", "error"]),
    )


def without_retryable(repositories: DataFrame, evidence: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the repositories that are to be tried again."""
    again = errors.where("retryable and repo is not null").select(F.col("repo").alias("again_")).distinct()
    out = [df.join(again, F.col(key) == F.col("again_"), "left_anti") for df, key in ((repositories, "repo_id"), (evidence, "repository"), (errors, "repo"))]
    return out[0], out[1], out[2]


def discovered(found: DataFrame, known: DataFrame, completed: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """New seeds up to ``target`` in all, and the log of the queries that were run for them.

    ``found``: query, query_order, item_order, repository_url and more (what
    the search gave, filtered); ``known``: repository_url; ``completed``:
    query. An address counts once, whatever slashes end it, for the first
    query that gave it. Queries after the one that reaches the target don't run.
    """
    plain = F.regexp_replace("repository_url", "/+$", "")
    pending = found.join(completed.select("query"), "query", "left_anti").withColumn("plain_", plain)
    seen = known.select(plain.alias("plain_")).distinct()
    first = Window.partitionBy("plain_").orderBy("query_order", "item_order")
    fresh = pending.join(seen, "plain_", "left_anti").withColumn("at_", F.row_number().over(first)).where("at_ = 1").drop("at_", "plain_")
    need = max(0, target - known.count())
    # The limit is the feature: the first that are needed, in the order of the search.
    new = fresh.orderBy("query_order", "item_order").limit(need)
    last = new.agg(F.max("query_order").alias("last"), F.count("*").alias("taken"))
    queries = pending.select("query", "query_order").distinct()
    # One row: queries run until the target is reached, all of them if it isn't.
    ran = queries.crossJoin(F.broadcast(last)).where((F.lit(need) > 0) & ((F.col("taken") < need) | (F.col("query_order") <= F.col("last"))))
    counts = new.groupBy("query").agg(F.count("*").alias("new"))
    log = ran.join(counts, "query", "left").select("query", "query_order", F.lit(True).alias("completed"), F.coalesce("new", F.lit(0)).alias("new_repositories"))
    return new, log
