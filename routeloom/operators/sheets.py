"""Review sheets: ids, texts and weights of sampled routes, the blind split, summaries and estimates."""

from __future__ import annotations

import hashlib
import os
import platform
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import sheet_columns as C
from ..functions import text as T
from . import metrics as M
from . import sampling as S

def quality() -> list:
    """The order of routes within a group; rows without a line come last."""
    return ["repository", "pattern", "method", "normalized_path", "path", "source_kind", F.coalesce("line", F.lit(1_000_000)), "file", "evidence_id"]


def filled(column: Column) -> Column:
    """As text; null and zero become empty."""
    text = column.cast("string")
    return F.when(text == "0", "").otherwise(F.coalesce(text, F.lit("")))


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` with route_id and evidence_id; commit is optional."""
    commit = F.col("commit") if "commit" in rows.columns else F.lit(None).cast("string")
    path = F.when(F.coalesce("normalized_path", F.lit("")) == "", F.col("path")).otherwise(F.col("normalized_path"))
    out = rows.withColumn("commit", commit).withColumn("route_id", T.digest(F.col("repository"), F.col("method"), path))
    parts = [filled(F.col(c)) for c in ("commit", "pattern", "source_kind", "path", "file", "line", "symbol")]
    return out.withColumn("evidence_id", T.digest(F.col("route_id"), *parts))


def population(pattern: Column) -> Column:
    return F.when(pattern == R.DELETE_PATTERN, "delete-operation-resource-audit").otherwise("strict-cancellation")


def top_text(rows: DataFrame, key: list[str], order: list, text: Column, n: int, name: str) -> DataFrame:
    """key and the first n texts of each group; only those n meet."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = rows.select(*key, text.alias("text_"), nth.alias("nth_")).where(F.col("nth_") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth_", "text_"))), lambda x: x["text_"]), " | ")
    return first.groupBy(*key).agg(joined.alias(name))


def evidence_text(*middle: str) -> Column:
    return F.concat_ws(" ", "method", "normalized_path", *middle, F.concat("file", F.lit(":"), filled(F.col("line"))))


def sheet_rows(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """The frame's routes with ids and texts: adjacent async evidence (three), status evidence (three) and response codes."""
    near = M.resource_rows(rows)
    key, order = ["repository", "target_path"], ["pattern", "file", F.coalesce("line", F.lit(1_000_000)), "method", "normalized_path", "source_kind"]
    said = evidence_text("pattern")
    every = top_text(near, key, order, said, 3, "adjacent_text")
    status = top_text(near.where("pattern = 'get-status-resource'"), key, order, said, 3, "terminal_text")
    out = identified(frame).join(every, key, "left").join(status, key, "left")
    codes = F.array_join(F.col("codes").cast("array<string>"), ",")
    return out.withColumns({
        "adjacent_text": F.coalesce("adjacent_text", F.lit("")),
        "terminal_text": F.coalesce("terminal_text", F.lit("")),
        "codes_text": codes,
        "response_text": F.when(codes == "", "").otherwise(F.concat(F.lit("cancel response codes: "), codes)),
        "population": population(F.col("pattern")),
    })


def bucket_of_route() -> Column:
    return F.when(F.col("linked"), "same-resource-linked").when(F.col("operation_target"), "operation-like-target").when(F.col("risk"), "domain-transition-risk").otherwise("other")


def cell_evidence(frame: DataFrame, key: list[str], n: int) -> DataFrame:
    """Flags of each group of routes, and its first n routes as text with how many more there are."""
    rows = identified(frame).withColumn("route_bucket", bucket_of_route())
    first = top_text(rows, key, quality(), evidence_text("route_bucket"), n, "said_")
    flags = rows.groupBy(*key).agg(F.count("*").alias("n_routes"), F.bool_or("linked").alias("any_linked"), F.bool_or("operation_target").alias("any_target"), F.bool_or("risk").alias("any_risk"))
    more = F.when(F.col("n_routes") > n, F.concat(F.lit(" | ... +"), F.col("n_routes") - n, F.lit(" more"))).otherwise(F.lit(""))
    return flags.join(first, key).withColumn("cell_text", F.concat("said_", more)).drop("said_")


def memberships(frame: DataFrame) -> DataFrame:
    """family_id and its strict patterns, in order, as one text."""
    order = [p for p in R.PRIMARY_ORDER if p != R.DELETE_PATTERN]
    found = frame.where(F.col("pattern").isin(*order)).groupBy("family_id").agg(F.collect_set("pattern").alias("found"))
    ordered = F.filter(F.array(*[F.lit(p) for p in order]), lambda p: F.array_contains(F.col("found"), p))
    return found.select("family_id", F.array_join(ordered, ",").alias("memberships"))


def design_weights(cells: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """pattern, population_size, sample_size, fraction and weight N/n as texts; ``cells``: pattern, family_id."""
    limits = F.create_map(*[x for p, n in sizes.items() for x in (F.lit(p), F.lit(n).cast("long"))])
    counts = cells.where(F.col("pattern").isin(*sizes)).groupBy("pattern").agg(F.count("*").alias("population_size"))
    counts = counts.withColumn("sample_size", F.least("population_size", F.element_at(limits, F.col("pattern"))))
    size, taken = F.col("population_size"), F.col("sample_size")
    return counts.withColumn("fraction", T.ratio_text(taken, size)).withColumn("weight", T.ratio_text(size, taken))


def inclusion(cells: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """family_id, probability over its strict patterns and its inverse, as texts."""
    weights = design_weights(cells, sizes).select("pattern", (F.col("sample_size") / F.col("population_size")).alias("fraction"))
    own = S.family_inclusion(cells.where(F.col("pattern") != R.DELETE_PATTERN), weights)
    p = F.col("probability")
    return own.select("family_id", T.float_text(p).alias("probability"), T.float_text(F.when(p > 0, 1 / p).otherwise(F.lit(0.0))).alias("weight"))


def operation_context(evidence: DataFrame) -> DataFrame:
    """evidence_id, operationSummary, operationDescription; of rows that repeat an id the last (by ord) counts."""
    rows = identified(evidence)
    last = rows.groupBy("evidence_id").agg(F.max_by(F.struct("summary", "description"), "ord").alias("x"))
    return last.select("evidence_id", F.coalesce("x.summary", F.lit("")).alias("operationSummary"), F.coalesce("x.description", F.lit("")).alias("operationDescription"))


#: Columns of a sheet that are a column of the frame under another name.
NAMES = {
    "httpMethod": "method", "normalizedPath": "normalized_path", "sourceKind": "source_kind", "lineStart": "line", "responseCodes": "codes_text",
    "cancelTargetPath": "target_path", "routeLevelOperationLinked": "linked", "operationTarget": "operation_target", "domainTransitionRisk": "risk",
    "adjacentOperationEvidence": "adjacent_text", "terminalStateEvidence": "terminal_text", "responseSemanticsEvidence": "response_text",
    "estimationPopulation": "population", "linkageBucket": "bucket", "deleteOperationResourceBucket": "delete_bucket", "cellRouteCount": "n_routes",
    "familyPatternHasSameResourceLinked": "any_linked", "familyPatternHasOperationTarget": "any_target", "familyPatternHasDomainTransitionRisk": "any_risk",
    "familyPatternCancellationEvidence": "cell_text", "strictFamilyPatternMemberships": "memberships", "populationFamilyMemberships": "population_size",
    "patternSampleSize": "sample_size", "patternSamplingFraction": "fraction", "analysisWeight": "weight",
    "strictFamilyApproxInclusionProbability": "probability", "strictFamilyApproxAnalysisWeight": "family_weight",
    "routeStratum": "stratum", "routeFramePopulationRecords": "stratum_size", "routeStratumSampleSize": "sample_size", "routeStratumSamplingFraction": "fraction", "routeStratumAnalysisWeight": "weight",
    "populationStrictFamilies": "stratum_size", "strictFamilySampleSize": "sample_size", "strictFamilySamplingFraction": "fraction", "strictFamilyAnalysisWeight": "weight",
    "strictFamilyHasSameResourceLinked": "any_linked", "strictFamilyHasOperationTarget": "any_target", "strictFamilyHasDomainTransitionRisk": "any_risk", "strictFamilyCancellationEvidence": "cell_text",
}


def sheet(rows: DataFrame, columns: list[str], unit: str) -> DataFrame:
    """``rows`` as a sheet of text columns in order; what they don't have is empty."""

    def of(name: str) -> Column:
        own = NAMES.get(name, name)
        if name == "samplingUnit":
            return F.lit(unit)
        return F.coalesce(F.col(own).cast("string"), F.lit("")) if own in rows.columns else F.lit("")

    return rows.select(*[of(c).alias(c) for c in columns])


def label_taxonomy(pattern: Column) -> Column:
    return F.when(pattern == R.DELETE_PATTERN, C.DELETE_TAXONOMY).otherwise(C.OTHER_TAXONOMY)


def allowed_labels(pattern: Column) -> Column:
    return F.when(pattern == R.DELETE_PATTERN, C.DELETE_LABELS).otherwise(C.OTHER_LABELS)


def blind_split(rows: DataFrame, context: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The labelling view (an allow-list of columns, then blank workflow columns) and the machine view (ids and all the rest)."""
    names = rows.columns
    if context is not None:
        rows = rows.drop("operationSummary", "operationDescription").join(context, "evidence_id", "left")
    for c in ("operationSummary", "operationDescription"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")) if c in rows.columns else F.lit(""))
    shown = [c for c in C.IDS + C.CONTEXT if c in rows.columns]
    blank = {"label_taxonomy": label_taxonomy(F.col("pattern")), "allowed_final_labels": allowed_labels(F.col("pattern"))}
    labelling = rows.select(*shown, *[blank.get(c, F.lit("")).alias(c) for c in C.WORKFLOW])
    hidden = [c for c in C.IDS if c in names] + [c for c in names if c not in C.IDS and c not in shown + C.WORKFLOW]
    return labelling, rows.select(*hidden)


def pilot_sheet(labelling: DataFrame, machine: DataFrame, seed: int = R.PILOT_SEED) -> DataFrame:
    """The pilot's rows of a labelling view; their patterns come from the machine view (unmatched rows are left out)."""
    pattern = machine.groupBy("evidence_id").agg(F.max("pattern").alias("pattern"))
    own = S.pilot(labelling.drop("pattern").join(pattern, "evidence_id"), seed)
    return own.select(*[c for c in C.PILOT if c in own.columns])


def counted(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    key = F.concat_ws("/", *keys)
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "key", "n")


def summary(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """counter, key, n: routes by pattern, bucket, population, source kind and stratum; cells by size, and the labels that a census of them adds."""
    c = F.col
    parts = [
        counted(rows, "byPattern", c("pattern")),
        counted(rows, "byLinkageBucket", bucket_of_route()),
        counted(rows, "byEstimationPopulation", population(c("pattern"))),
        counted(rows, "bySourceKind", c("source_kind")),
        counted(rows, "bySourceKindByPattern", c("source_kind"), c("pattern")),
        counted(rows, "byTaxonomy", label_taxonomy(c("pattern"))),
        counted(rows, "byStratum", S.route_stratum()),
        counted(rows, "byLinked", F.when(c("linked"), "linked").otherwise("unlinked")),
        counted(cells, "cellSizes", c("size").cast("string")),
        counted(memberships(rows), "byMembershipCount", F.size(F.split("memberships", ",")).cast("string")),
    ]
    totals = cells.agg(F.count("*").alias("selectedCells"), F.coalesce(F.sum("size"), F.lit(0)).alias("selectedRouteRecords"))
    totals = totals.withColumn("extraRouteLabelsIfClusterCensus", c("selectedRouteRecords") - c("selectedCells"))
    parts.append(totals.unpivot([], totals.columns, "key", "n").select(F.lit("cellRouteCounts").alias("counter"), "key", "n"))
    return reduce(DataFrame.unionByName, parts)


def agreement(rows: DataFrame, a: str = "labelerA_label", b: str = "labelerB_label") -> DataFrame:
    """n, agreed and Cohen's kappa of two label columns; rows without both don't count."""
    own = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a).cast("string") != "") & (F.col(b).cast("string") != ""))
    pairs = own.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"))
    left, right = (pairs.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(c)) for c in ("a", "b"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("products"))
    joined = total.crossJoin(F.broadcast(chance))  # one row each
    observed, expected = F.col("agreed") / F.col("n"), F.col("products") / (F.col("n").cast("double") * F.col("n"))
    return joined.where("n > 0").select("n", "agreed", F.round(F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(F.lit(1.0)), 6).alias("kappa"))


def stratified_bounds(labelled: DataFrame, strata: DataFrame, yes: str, ambiguous: str = "ambiguous") -> DataFrame:
    """Share of ``yes``, with ambiguous labels counted as no and as yes, over strata weighted by their sizes.

    ``labelled``: stratum, label. ``strata``: stratum, size. Strata without labels don't count.
    """
    own = labelled.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("label") == yes).alias("yes"), F.count_if(F.col("label") == ambiguous).alias("open"))
    own = own.join(strata, "stratum")
    low, high = (F.sum(F.col("size") * x / F.col("n")) / F.sum("size") for x in (F.col("yes"), F.col("yes") + F.col("open")))
    return own.agg(F.sum("n").alias("labelled"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def frame_hash(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over names and bytes of the files, in order, as one snapshot."""
    digest = hashlib.sha256()
    for path in paths:
        digest.update(path.rstrip("/").rsplit("/", 1)[-1].encode() + b"\0")
        for row in spark.read.format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator():
            digest.update(bytes(row["content"]))
        digest.update(b"\0")
    return digest.hexdigest()


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file; empty if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return ""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def provenance(spark: SparkSession, seed: int, paths: list[str]) -> dict[str, str | int]:
    return {"seed": seed, "samplingCodeCommit": os.environ.get("ROUTELOOM_CODE_COMMIT", "unknown"), "pythonVersion": platform.python_version(), "frameSnapshotHash": frame_hash(spark, paths)}
