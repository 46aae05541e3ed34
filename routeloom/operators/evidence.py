"""Classified evidence, its deduplication, and families of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.classify import assign_pattern, classify_route


def classified(routes: DataFrame) -> DataFrame:
    """One row per route and concept, with normalized path and pattern."""
    concepts = classify_route(F.col("method"), F.col("path"), F.col("codes"), F.col("symbol"), F.col("symbol"))
    rows = routes.withColumn("c", F.explode(concepts)).select("*", "c.concept", "c.confidence", "c.reason").drop("c")
    rows = rows.withColumn("normalized_path", T.normalize_path(F.col("path")))
    return rows.withColumn("pattern", pattern_of(F.col("codes")))


def pattern_of(codes):
    return assign_pattern(F.col("concept"), F.col("method"), F.col("normalized_path"), F.col("path"), F.col("symbol"), codes)


def extracted(found: DataFrame) -> DataFrame:
    """Evidence of routes that ``sources.extract`` found, with ``repository``, as ``classified`` gives it.

    A source route's codes come from its text and its confidence is 0.08 lower;
    of one route that several rules find in a line the first rule's row stays.
    """
    is_source = F.col("extractor") == "source-routes"
    rows = found.where("extractor <> 'error'").withColumn("codes", F.when(is_source, T.response_codes(F.col("text"))).otherwise(F.col("codes")))
    concepts = classify_route(F.col("method"), F.col("path"), F.col("codes"), F.coalesce("text", F.lit("")), F.col("symbol"))
    rows = rows.withColumn("c", F.explode(concepts)).select("*", "c.concept", "c.confidence", "c.reason").drop("c")
    lower = F.round(F.greatest(F.lit(0.1), F.col("confidence") - 0.08), 4)
    rows = rows.withColumn("confidence", F.when(is_source, lower).otherwise(F.col("confidence")))
    same = Window.partitionBy("repository", "rel_path", "extractor", "line", "method", "path", "concept").orderBy("nth")
    rows = rows.withColumn("_at", F.row_number().over(same)).where(~is_source | (F.col("_at") == 1)).drop("_at")
    rows = rows.withColumn("normalized_path", T.normalize_path(F.col("path"))).withColumn("source_kind", F.when(is_source, "source").otherwise("openapi"))
    said = F.concat_ws(" ", "symbol", "value_text")
    return rows.withColumn("pattern", assign_pattern(F.col("concept"), F.col("method"), F.col("normalized_path"), F.col("path"), said, F.col("codes")))


KEY = ["repository", "concept", "method", "normalized_path", "source_kind"]


def deduplicated(evidence: DataFrame) -> DataFrame:
    """Evidence merged by KEY in order of ``ord``.

    A fold, not an argmax: codes are united at each step and the union counts
    in the next comparison; a later row wins only if it is strictly better.
    """
    more = [c for c in ("summary", "description") if c in evidence.columns]
    kept = ["confidence", "symbol", "line", "file", "path", *more]
    row = F.struct("ord", "codes", *kept)
    rows = evidence.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def quality(x):
        return F.struct(
            F.array_contains(x["codes"], 202).cast("int").alias("a"),
            F.size(x["codes"]).alias("b"),
            x["confidence"].alias("c"),
            (F.coalesce(x["symbol"], F.lit("")) != "").cast("int").alias("d"),
            (-F.coalesce(x["line"], F.lit(1_000_000))).alias("e"),
        )

    def step(a, x):
        codes = F.array_sort(F.array_union(a["codes"], x["codes"]))
        best = F.when(quality(x) > quality(a), x).otherwise(a)
        return F.struct(best["ord"].alias("ord"), codes.alias("codes"), *[best[c].alias(c) for c in kept])

    folded = F.aggregate(F.slice("rows", 2, F.size("rows")), F.get("rows", F.lit(0)), step)
    out = rows.select(*KEY, F.size("rows").cast("long").alias("n_rows"), folded.alias("w")).select(*KEY, "n_rows", "w.*")
    return out.withColumn("pattern", pattern_of(F.col("codes")))


def signatures(evidence: DataFrame) -> DataFrame:
    """repository and the signature of its API."""
    item = F.concat_ws("|", "concept", "pattern", "method", "normalized_path")
    return evidence.groupBy("repository").agg(T.signature(F.collect_set(item)).alias("signature"))


def families(repos: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id, family_id, basis, excluded, reason. Fork parent, then origin, then a shared signature, then itself."""
    own = signatures(evidence)
    shared = own.where("signature <> ''").groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature", F.lit(True).alias("shared"))
    r = repos.join(own, repos.repo_id == own.repository, "left").join(shared, "signature", "left")
    family = (
        F.when(F.col("fork_parent").isNotNull(), F.concat(F.lit("github:"), "fork_parent"))
        .when(F.col("probable_origin").isNotNull(), F.concat(F.lit("origin:"), "probable_origin"))
        .when(F.col("shared"), F.concat(F.lit("api-signature:"), "signature"))
        .otherwise(F.col("repo_id"))
    )
    basis = F.when(F.col("fork_parent").isNotNull(), "exact").when(F.col("probable_origin").isNotNull() | F.col("shared"), "probable").otherwise("unknown")
    template = T.template_of(F.col("owner"), F.col("name"))
    named = F.lower("name")
    demo = (template == "name-indicator") & (named.contains("demo") | named.contains("sample") | named.contains("starter"))
    reason = (
        F.when(F.col("category").contains("generated-sdk") | F.coalesce(template, F.lit("")).contains("generated-sdk"), "generated-sdk")
        .when(F.col("category").isin("tutorial", "toy", "demo", "sample"), F.col("category"))
        .when(demo, "template-or-demo")
    )
    return r.select("repo_id", "language", family.alias("family_id"), basis.alias("basis"), reason.isNotNull().alias("excluded"), reason.alias("reason"))


def independent(evidence: DataFrame, family: DataFrame) -> DataFrame:
    """Evidence of repositories that aren't excluded, with family_id (its own name where there is none)."""
    f = family.select(F.col("repo_id").alias("repository"), "family_id", "excluded")
    rows = evidence.join(f, "repository", "left").where(~F.coalesce("excluded", F.lit(False)))
    return rows.drop("excluded").withColumn("family_id", F.coalesce("family_id", "repository"))
