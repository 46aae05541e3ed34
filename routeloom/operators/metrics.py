"""Clusters, linkage, standards and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def pattern_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("concept", "pattern").agg(F.countDistinct("family_id").alias("families"), F.countDistinct("repository").alias("repositories"), F.count("*").alias("evidence"))


def concept_metrics(rows: DataFrame, digits: int | None = 4) -> DataFrame:
    """Families, repositories, evidence, entropy over pattern families (rounded to ``digits``), dominant and long-tail ratios, capped counts."""
    entropy = T.entropy(F.array_sort("n"), F.col("patterns"))
    by_pattern = pattern_metrics(rows).groupBy("concept").agg(F.collect_list(F.col("families").cast("double")).alias("n"), F.count("*").alias("patterns"), F.max("families").alias("most"), F.sum("families").alias("memberships"), F.count_if(F.col("families") == 1).alias("single"))
    by_repo = rows.groupBy("concept", "repository").agg(F.count("*").alias("n")).groupBy("concept").agg(F.sum(F.least("n", F.lit(50))).alias("capped"), F.max("n").alias("top"), F.sum("n").alias("evidence"), F.count("*").alias("repositories"))
    total = rows.groupBy("concept").agg(F.countDistinct("family_id").alias("families"))
    out = by_pattern.join(by_repo, "concept").join(total, "concept")
    return out.select(
        "concept", "families", "repositories", "patterns", "evidence", "capped",
        (entropy if digits is None else F.round(entropy, digits)).alias("entropy"),
        F.round(F.col("most") / F.col("memberships"), 4).alias("dominant_ratio"),
        F.round(F.col("single") / F.col("patterns"), 4).alias("long_tail_ratio"),
        F.round(F.col("top") / F.col("evidence"), 4).alias("top_repository_share"),
    )


def first_examples(rows: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("concept", "pattern").orderBy("ord")
    return rows.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= n).select("concept", "pattern", "nth", "repository", "file", "line", "method", "path", "normalized_path", "confidence", F.col("source_kind").alias("extractor"))


def top_repositories(rows: DataFrame, n: int = 10) -> DataFrame:
    counts = rows.groupBy("concept", "repository").agg(F.count("*").alias("evidence"), F.min("ord").alias("first"))
    whole = Window.partitionBy("concept")
    order = whole.orderBy(F.desc("evidence"), "first")
    out = counts.withColumn("nth", F.row_number().over(order).cast("long")).withColumn("share", F.round(F.col("evidence") / F.sum("evidence").over(whole), 4))
    return out.where(F.col("nth") <= n).select("concept", "nth", "repository", "evidence", "share")


def strict_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of each concept over its strict patterns, entropy unrounded; concepts of the rules without such rows have zeros."""
    own = concept_metrics(rows.where(F.col("pattern").isin(*R.STRICT_PATTERNS)), None)
    known = rows.sparkSession.createDataFrame([(c,) for c in R.CONCEPTS], "concept string")
    return known.join(own.select("concept", "families", "repositories", "patterns", "evidence", "entropy"), "concept", "full").na.fill(0)


def distributions(rows: DataFrame, repos: DataFrame, fields: list[str]) -> DataFrame:
    """concept, field, value, repositories: how the concept's repositories spread over each field; null and empty are unknown."""
    own = rows.select("concept", F.col("repository").alias("repo_id")).distinct().join(repos.select("repo_id", *fields), "repo_id")
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in fields]))
    return own.select("concept", each.alias("x")).groupBy("concept", "x.field", "x.value").agg(F.count("*").alias("repositories"))


def resource_rows(rows: DataFrame) -> DataFrame:
    """Async rows with each target_path that they stand for: their path, the one above a status, the one that a POST makes."""
    a = rows.where(F.col("concept") == R.ASYNC)
    own = T.canonical_path(F.col("normalized_path"))
    parts = T.segments(own)
    status = T.has_any(T.tokens(F.element_at(parts, -1)), R.STATUS_WORDS)
    noun = T.has_any(T.tokens(own), R.ASYNC_NOUNS)
    under = F.when((F.col("method") == "POST") & noun & ~own.endswith("/{var}"), F.concat(own, F.lit("/{var}")))
    paths = F.array_distinct(F.array_compact(F.array(own, F.when((F.size(parts) > 0) & status, T.joined(F.slice(parts, 1, F.size(parts) - 1))), under)))
    return a.withColumn("target_path", F.explode(paths))


def resource_paths(rows: DataFrame) -> DataFrame:
    return resource_rows(rows).select("repository", "target_path")


def adjacent(linked: DataFrame, rows: DataFrame) -> DataFrame:
    """Cancellation rows with the number of async rows on their target."""
    near = resource_paths(rows).groupBy("repository", "target_path").agg(F.count("*").alias("adjacent"))
    return linked.join(near, ["repository", "target_path"], "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(0)))


def linkage(rows: DataFrame) -> DataFrame:
    """Cancellation rows with target_path, linked, operation_target, strict, risk, bucket."""
    known = resource_paths(rows).distinct().withColumn("linked", F.lit(True))
    c = rows.where(F.col("concept") == R.CANCELLATION).withColumn("target_path", T.cancel_target_path(F.col("normalized_path")))
    c = c.join(known, ["repository", "target_path"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    c = c.withColumn("operation_target", T.has_any(T.tokens(F.col("target_path")), R.ASYNC_NOUNS)).withColumn("strict", F.col("pattern").isin(*R.STRICT_PATTERNS))
    c = c.withColumn("risk", F.col("strict") & ~(F.col("linked") | F.col("operation_target")))
    bucket = F.when(F.col("linked"), "same-resource-linked").when(F.col("operation_target"), "operation-like-target").when(F.col("risk"), "domain-transition-risk").otherwise("other")
    return c.withColumn("bucket", bucket)


def linkage_totals(linked: DataFrame) -> DataFrame:
    """Evidence, repositories and families of each pattern, of strict patterns and of all, by kind of link."""
    tests = {"all": F.lit(True), "linked": F.col("linked"), "target": F.col("operation_target"), "risk": F.col("risk")}
    # Rows of one pattern, repository and family become one; what is distinct is counted over those.
    few = linked.groupBy("pattern", "repository", "family_id", "strict").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    scopes = F.array_compact(F.array(F.col("pattern"), F.lit("(all)"), F.when(F.col("strict"), F.lit("(strict)"))))
    few = few.withColumn("pattern", F.explode(scopes))
    out = few.groupBy("pattern").agg(*[F.sum(k).alias(f"{k}_evidence") for k in tests])
    for key, name in (("repository", "repositories"), ("family_id", "families")):
        each = few.groupBy("pattern", key).agg(*[F.max(F.col(k) > 0).alias(k) for k in tests])
        out = out.join(each.groupBy("pattern").agg(*[F.count_if(k).alias(f"{k}_{name}") for k in tests]), "pattern")
    return out


def envelope(linked: DataFrame) -> DataFrame:
    """Families linked by strict patterns, by DELETE resources, by both and by either."""
    flags = linked.where("linked").groupBy("family_id").agg(F.bool_or("strict").alias("s"), F.bool_or(F.col("pattern") == "delete-operation-resource").alias("d"))
    return flags.agg(F.count_if("s").alias("strict"), F.count_if("d").alias("deletes"), F.count_if(F.col("s") & F.col("d")).alias("overlap"), F.count_if(F.col("s") | F.col("d")).alias("either"))


def compare_standards(concepts: DataFrame, standards: DataFrame) -> DataFrame:
    """Best coverage of each concept over the standards (id, ord, concept, coverage, conflict); unknown without any."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in R.COVERAGE_ORDER]), F.col("coverage")) - 1, F.lit(0))
    rows = concepts.select("concept").join(standards, "concept", "left").withColumn("rank", F.greatest(rank, F.lit(0)))
    conflict = ~F.lower(F.coalesce("conflict", F.lit(""))).isin("", "none", "unknown")
    best = rows.groupBy("concept").agg(F.max_by("coverage", F.struct("rank", -F.coalesce("ord", F.lit(0)))).alias("coverage"), F.bool_or(conflict).alias("conflict"), F.count("id").alias("standards"))
    return best.withColumn("coverage", F.coalesce("coverage", F.lit("unknown")))


def standards_rows(concepts: DataFrame, standards: DataFrame) -> DataFrame:
    """A row for each concept and standard that names it (id, ord, title, url, coverage, gap, conflict, evidence, confidence), or one default row.

    ``standards``: id, ord, title, url, concepts, confidence, default_coverage,
    gap, concept_coverage (map to coverage, gap, conflict, evidence, confidence).
    """
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    own = standards.withColumn("concept", F.explode("concepts")).withColumn("e", F.element_at("concept_coverage", F.col("concept")))
    none = F.expr("cast(array() as array<string>)")
    own = own.select(
        "concept", "id", "ord", "title", "url",
        F.coalesce(some(F.col("e.coverage"), F.col("default_coverage")), F.lit("unknown")).alias("coverage"),
        F.coalesce(some(F.col("e.gap"), F.col("gap")), F.lit("")).alias("gap"),
        F.coalesce(some(F.col("e.conflict")), F.lit("none")).alias("conflict"),
        F.coalesce("e.evidence", none).alias("evidence"),
        F.coalesce("e.confidence", "confidence", F.lit(0.7)).alias("confidence"),
    )
    rows = concepts.select("concept").join(own, "concept", "left")
    missing = F.col("id").isNull()
    return rows.withColumns({
        "coverage": F.when(missing, "unknown").otherwise(F.col("coverage")),
        "gap": F.when(missing, R.NO_STANDARD).otherwise(F.col("gap")),
        "conflict": F.when(missing, "unknown").otherwise(F.col("conflict")),
        "evidence": F.coalesce("evidence", none),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def both_scores(concepts: DataFrame, strict: DataFrame, compared: DataFrame, total: Column) -> DataFrame:
    """``scores`` of each concept, and its score over strict patterns alone with their counts; ``total`` is a column of both."""
    own = scores(concepts, compared, total)
    alone = scores(strict, compared, total).select("concept", F.col("score").alias("strict_score"))
    counts = strict.select("concept", *[F.col(c).alias(f"strict_{c}") for c in ("families", "repositories", "evidence", "patterns")])
    return own.join(alone, "concept", "left").join(counts, "concept", "left")


def scores(concepts: DataFrame, compared: DataFrame, total_families: int | float | F.Column) -> DataFrame:
    """Opportunity score: prevalence, independence, divergence, interoperability, gap, correctness, tractability."""
    x = concepts.join(compared, "concept", "left")
    total = total_families if isinstance(total_families, F.Column) else F.lit(float(total_families))
    f = F.col("families").cast("double")
    gap = F.when(F.col("coverage") == "full", 1).when(F.col("coverage") == "partial", 8).when(F.col("coverage") == "adjacent", 12).when(F.col("coverage") == "none", 15).otherwise(10)
    is_async, is_cancel = F.col("concept") == R.ASYNC, F.col("concept") == R.CANCELLATION
    x = x.select(
        "concept",
        F.when(total > 0, F.bround(F.least(F.lit(1.0), f / total) * 20, 0)).otherwise(F.lit(0.0)).cast("int").alias("prevalence"),
        F.bround(F.least(F.lit(1.0), f / 20) * 20, 0).cast("int").alias("independence"),
        F.bround(F.col("entropy") * 20, 0).cast("int").alias("divergence"),
        F.when(is_async, 13).when(is_cancel, 12).otherwise(10).alias("interoperability"),
        gap.alias("gap"),
        F.when(F.coalesce("conflict", F.lit(False)), 2).otherwise(4).alias("correctness"),
        F.when(is_async, 4).when(is_cancel, 5).otherwise(3).alias("tractability"),
    )
    parts = ["prevalence", "independence", "divergence", "interoperability", "gap", "correctness", "tractability"]
    return x.withColumn("score", sum((F.col(p) for p in parts), F.lit(0)))


def vendors(rows: DataFrame) -> DataFrame:
    """concept and the number of owners of its repositories."""
    return rows.groupBy("concept").agg(F.countDistinct(F.substring_index("repository", "/", 1)).alias("vendors"))
