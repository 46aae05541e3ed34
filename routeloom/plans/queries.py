"""Queries over the driver's tables, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import sheet_columns as C
from ..functions import text as T
from ..operators import collect as K
from ..operators import discovery as D
from ..operators import evidence as E
from ..operators import incremental as I
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import sheets as H
from ..sources import adapter as A
from ..sources.extract import extract, links
from ..streaming.dedupe import once
from . import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIZES = R.SAMPLE_SIZES["full"]
TARGET = 400


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.deduplicated(E.classified(A.routes(spark, sf_dir)))


def settled(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, so that a plan that uses them several times makes them once."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "/tmp/checkpoints")
    return df.checkpoint()


def evidence_and_families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = settled(evidence(spark, sf_dir))
    return ev, E.families(A.repositories(spark, sf_dir), ev)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated evidence of independent families."""
    return E.independent(*evidence_and_families(spark, sf_dir))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellation routes of independent families with their links, each with its primary pattern only."""
    return S.primary_pattern(M.linkage(rows(spark, sf_dir)))


def standards(spark: SparkSession, concepts: DataFrame) -> DataFrame:
    return M.standards_rows(concepts, A.standards(spark)).where("id is not null")


@query
def concept_metrics(spark, sf_dir):
    return M.concept_metrics(rows(spark, sf_dir))


@query
def normalize_path(spark, sf_dir):
    return A.routes(spark, sf_dir).select("ord", T.normalize_path(F.col("path")).alias("normalized_path"))


@query
def tokenize(spark, sf_dir):
    return A.routes(spark, sf_dir).select("ord", F.array_join(F.array_sort(T.tokens(F.concat_ws(" ", "path", "symbol"))), " ").alias("tokens"))


@query
def classify_route(spark, sf_dir):
    return E.classified(A.routes(spark, sf_dir)).select("ord", "concept", "confidence", "reason")


@query
def assign_pattern(spark, sf_dir):
    return E.classified(A.routes(spark, sf_dir)).select("ord", "concept", "pattern")


@query
def response_codes(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.array_join(T.response_codes(F.col("html")).cast("array<string>"), ",").alias("codes"))


@query
def canonical_segments(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.canonical_path(path).alias("path"))
    return pages.select("page_id", "path", F.size(T.segments(F.col("path"))).cast("long").alias("n_segments"))


@query
def cancel_target_path(spark, sf_dir):
    return A.routes(spark, sf_dir).select("ord", T.cancel_target_path(T.normalize_path(F.col("path"))).alias("target_path"))


@query
def api_signature(spark, sf_dir):
    return E.signatures(evidence(spark, sf_dir))


@query
def stable_ids(spark, sf_dir):
    ev = E.classified(A.routes(spark, sf_dir))
    return ev.select("ord", "concept", T.digest(F.col("repository"), F.col("method"), F.col("normalized_path")).alias("route_id"))


@query
def dedupe_fold(spark, sf_dir):
    return evidence(spark, sf_dir).select(*E.KEY, "n_rows", "ord", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), "confidence", "line", "pattern")


@query
def family_mapping(spark, sf_dir):
    return E.families(A.repositories(spark, sf_dir), evidence(spark, sf_dir)).select("repo_id", "family_id", "basis", "excluded", "reason")


@query
def duplicate_signatures(spark, sf_dir):
    own = E.signatures(evidence(spark, sf_dir))
    return own.groupBy("signature").agg(F.count("*").alias("repositories")).where("repositories > 1")


@query
def pattern_metrics(spark, sf_dir):
    return M.pattern_metrics(rows(spark, sf_dir))


@query
def pattern_examples_top5(spark, sf_dir):
    return M.first_examples(rows(spark, sf_dir))


@query
def top_evidence_repositories(spark, sf_dir):
    return M.top_repositories(rows(spark, sf_dir))


@query
def distribution_language(spark, sf_dir):
    own = rows(spark, sf_dir).select("concept", "repository").distinct()
    repos = A.repositories(spark, sf_dir).select(F.col("repo_id").alias("repository"), "language")
    language = F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language"))
    return own.join(repos, "repository").groupBy("concept", language.alias("language")).agg(F.count("*").alias("repositories"))


@query
def linkage_records(spark, sf_dir):
    return M.linkage(rows(spark, sf_dir)).select("repository", "family_id", "method", "normalized_path", "source_kind", "target_path", "linked", "strict", "risk", "bucket")


@query
def linkage_totals(spark, sf_dir):
    return M.linkage_totals(M.linkage(rows(spark, sf_dir)))


@query
def linkage_envelope(spark, sf_dir):
    return M.envelope(M.linkage(rows(spark, sf_dir)))


@query
def strict_metrics(spark, sf_dir):
    return M.strict_metrics(rows(spark, sf_dir))


@query
def standards_rows(spark, sf_dir):
    concepts = spark.createDataFrame([(c,) for c in [*R.CONCEPTS, "http-other"]], "concept string")
    out = M.standards_rows(concepts, A.standards(spark))
    return out.select("concept", F.coalesce("id", F.lit("")).alias("id"), "coverage", "gap", "conflict", F.array_join("evidence", ";").alias("evidence"), "confidence")


@query
def standards_comparison(spark, sf_dir):
    concepts = M.concept_metrics(rows(spark, sf_dir))
    return M.compare_standards(concepts, standards(spark, concepts))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, concepts, their comparison with standards, and their scores."""
    ev, families = evidence_and_families(spark, sf_dir)
    own = E.independent(ev, families)
    total = families.where("not excluded").agg(F.countDistinct("family_id").cast("double").alias("total_families"))
    concepts = settled(M.concept_metrics(own))
    compared = M.compare_standards(concepts, standards(spark, concepts))
    with_total = lambda df: df.crossJoin(F.broadcast(total))  # noqa: E731  one row
    return own, concepts, compared, M.both_scores(with_total(concepts), with_total(M.strict_metrics(own)), compared, F.col("total_families"))


@query
def opportunity_scores(spark, sf_dir):
    return scored(spark, sf_dir)[3]


@query
def primary_pattern(spark, sf_dir):
    return frame(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("rows"), F.countDistinct("family_id").alias("families"))


@query
def family_pattern_cells(spark, sf_dir):
    return S.cells(frame(spark, sf_dir)).select("pattern", "family_id", "size", "bucket")


@query
def family_inclusion_probability(spark, sf_dir):
    return H.inclusion(S.cells(frame(spark, sf_dir)), SIZES)


@query
def seeded_family_sample(spark, sf_dir):
    cells = S.cells(frame(spark, sf_dir))
    out = S.drawn(S.shuffled(cells, F.concat_ws(":", "pattern", "bucket"), ["family_id"], "20260904"), 10)
    return out.select("stratum", "position", "family_id", "stratum_size", F.round("weight", 9).alias("weight"))


@query
def resume_antijoin(spark, sf_dir):
    repos = A.repositories(spark, sf_dir)
    return I.pending(repos, repos.where("user_id % 3 = 0")).select("repo_id")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every fifth repository, half of them to be tried again."""
    repos = A.repositories(spark, sf_dir).where("user_id % 5 = 0")
    return repos.select(F.col("repo_id").alias("repo"), F.lit("collect").alias("stage"), F.lit("git_clone_failed").alias("error_type"), F.concat(F.lit("exit code "), F.col("user_id") % 4).alias("error"), (F.col("user_id") % 2 == 0).alias("retryable"))


@query
def retry_prune(spark, sf_dir):
    left = K.without_retryable(A.repositories(spark, sf_dir), A.routes(spark, sf_dir), failures(spark, sf_dir))
    keys = (("repositories", "repo_id"), ("evidence", "repository"), ("errors", "repo"))
    parts = [df.groupBy(F.lit(name).alias("table"), F.col(key).alias("repo_id")).agg(F.count("*").alias("rows")) for df, (name, key) in zip(left, keys)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def first_seen(spark, sf_dir):
    return I.first_seen(A.routes(spark, sf_dir).select("repository", "ord", "path"), "repository", "ord")


@query
def discovery_queries(spark, sf_dir):
    return I.search_queries(spark, R.SEARCH_TERMS, R.SEARCH_LANGUAGES, 20)


@query
def framework_inference(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", I.framework_of(F.concat_ws(" ", "url", "html"), F.lit("none")).alias("framework"))


@query
def href_links(spark, sf_dir):
    return links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def route_weights(spark, sf_dir):
    """Each stratum of the frame with its sample size, fraction and weight."""
    limits = F.create_map(*[x for k, n in R.ROUTE_SAMPLE_SIZES["full"].items() for x in (F.lit(k), F.lit(n).cast("long"))])
    size = frame(spark, sf_dir).groupBy(S.route_stratum().alias("stratum")).agg(F.count("*").alias("stratum_size"))
    taken = F.least(F.col("stratum_size"), F.coalesce(F.element_at(limits, F.col("stratum")), F.col("stratum_size")))
    return size.select("stratum", "stratum_size", taken.alias("sampled"), T.ratio_text(taken, F.col("stratum_size")).alias("fraction"), T.ratio_text(F.col("stratum_size"), taken).alias("weight"))


@query
def stream_dedupe(spark, sf_dir):
    """The events taken as a stream of files, each repository once, and once more to no effect."""
    return once(spark, f"{sf_dir}/events.parquet", lambda df: df.select(F.concat(F.lit("org"), F.col("user_id") % 7, F.lit("/svc"), F.col("user_id")).alias("repository")), "repository")


@query
def report_ratios(spark, sf_dir):
    own = M.linkage(rows(spark, sf_dir)).groupBy("pattern")
    share = lambda c: F.format_string("%.4f", F.count_if(c) / F.count("*"))
    return own.agg(share(F.col("linked")).alias("linked_ratio"), share(F.col("risk")).alias("risk_ratio"))


@query
def manual_review_top100(spark, sf_dir):
    return report.review_lines(evidence(spark, sf_dir), failures(spark, sf_dir))


@query
def adjacent_evidence(spark, sf_dir):
    own = rows(spark, sf_dir)
    return M.adjacent(M.linkage(own), own).select("repository", "method", "normalized_path", "source_kind", "adjacent")


def sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labelling view and the machine view of every route of the frame."""
    ev, families = evidence_and_families(spark, sf_dir)
    own = E.independent(ev, families)
    full = H.sheet(H.sheet_rows(S.primary_pattern(M.linkage(own)), own), C.REPRESENTATIVE_SHEET, "family-pattern-representative")
    return H.blind_split(full, H.operation_context(ev))


@query
def blind_view(spark, sf_dir):
    return sheet(spark, sf_dir)[0].select("evidence_id", "httpMethod", "path", "lineStart", "responseCodes", "operationSummary", "operationDescription", "responseSemanticsEvidence", "label_taxonomy", "allowed_final_labels", "final_label")


@query
def machine_view(spark, sf_dir):
    return sheet(spark, sf_dir)[1].select("evidence_id", "route_id", "family_id", "pattern", "linkageBucket", "estimationPopulation", "cancelTargetPath", "routeLevelOperationLinked", "operationTarget", "domainTransitionRisk", "adjacentOperationEvidence", "terminalStateEvidence", "confidence", "primaryLabel")


@query
def evidence_ids(spark, sf_dir):
    return H.identified(evidence(spark, sf_dir)).select(*E.KEY, "route_id", "evidence_id")


@query
def cell_evidence(spark, sf_dir):
    return H.cell_evidence(frame(spark, sf_dir), ["pattern", "family_id"], 5)


@query
def design_weights(spark, sf_dir):
    return H.design_weights(S.cells(frame(spark, sf_dir)), SIZES)


@query
def strict_memberships(spark, sf_dir):
    return H.memberships(frame(spark, sf_dir))


@query
def sheet_summary(spark, sf_dir):
    own = settled(frame(spark, sf_dir))
    return H.summary(own, S.cells(own))


@query
def label_agreement(spark, sf_dir):
    """The two columns of ``labels`` taken as two labellers."""
    return H.agreement(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic")


LABELS = ["operation-cancellation", "domain-state-transition", "ambiguous"]


@query
def stratified_bounds(spark, sf_dir):
    """Bounds of the share of operation cancellations, with labels that follow from the line."""
    own = settled(frame(spark, sf_dir).withColumn("stratum", S.route_stratum()))
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("line") % 3)
    strata = own.groupBy("stratum").agg(F.count("*").alias("size"))
    return H.stratified_bounds(own.where("line % 2 = 0").select("stratum", label.alias("label")), strata, LABELS[0])


@query
def distributions(spark, sf_dir):
    return M.distributions(rows(spark, sf_dir), A.repositories(spark, sf_dir), ["language", "framework", "vendor"])


@query
def linkage_ratios(spark, sf_dir):
    own = settled(rows(spark, sf_dir))
    linked = settled(M.linkage(own))
    return report.linkage_ratios(M.linkage_totals(linked), M.envelope(linked), M.concept_metrics(own))


@query
def seed_rows(spark, sf_dir):
    return K.seeds(A.seed_documents(spark, sf_dir)).select("doc", "ordinal", "repository_url", "owner", "name", "language", "stars", "carried")


@query
def repository_rows(spark, sf_dir):
    out = K.repositories(K.seeds(A.seed_documents(spark, sf_dir)), A.looked_up(spark, sf_dir))
    return out.select("repo_id", "repository_url", "language", "stars", "forks", "license", "last_activity", "default_branch", "fork_parent", "probable_origin", "vendor")


def discovery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run over the items as if 36 queries had found them; the first two have run and what they found is known."""
    items = A.items(spark, sf_dir).withColumn("query_order", F.col("event_id") % 36).withColumn("item_order", F.expr("event_id div 36"))
    found = D.seeds(items, ["query_order", "item_order"]).withColumn("query", F.concat(F.lit("q"), "query_order"))
    completed = spark.createDataFrame([("q0",), ("q1",)], "query string")
    known = found.join(completed, "query").select(F.concat("repository_url", F.lit("/")).alias("repository_url")).distinct()
    return K.discovered(found, known, completed, TARGET)


@query
def discovery_run(spark, sf_dir):
    return discovery(spark, sf_dir)[0].select("query", "query_order", "item_order", "repository_url")


@query
def discovery_log(spark, sf_dir):
    return discovery(spark, sf_dir)[1]


@query
def ordered_outputs(spark, sf_dir):
    """Evidence in the order of its seeds; every third repository has none."""
    repos = A.repositories(spark, sf_dir).where("user_id % 3 > 0").select("owner", F.substring_index("repo_id", "/", -1).alias("name"), F.col("user_id").alias("ordinal"))
    _, ev, _ = K.stream_outputs(A.repositories(spark, sf_dir), E.classified(A.routes(spark, sf_dir)), failures(spark, sf_dir), repos)
    return ev.select("seed_order", "repository", "file", "line", "method", "path", "concept", "ord")


@query
def safe_casts(spark, sf_dir):
    text = F.regexp_extract("props", r"(\d+)", 1)
    text = F.when(F.col("event_id") % 5 == 0, F.concat(text, F.lit(".5"))).when(F.col("event_id") % 7 == 0, "x").otherwise(text)
    codes = T.clean_codes(F.array(F.lit("202"), text, F.lit("x"), F.lit("202")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", T.safe_int(text).alias("as_int"), T.safe_float(text).alias("as_float"), F.array_join(codes.cast("array<string>"), ",").alias("codes"), T.ratio_text(T.safe_float(text), F.col("event_id") % 4).alias("ratio"), T.source_kind(F.get(F.array(F.lit("OpenAPI-yaml"), F.lit("source-routes"), F.lit("Other"), F.lit(None)), (F.col("event_id") % 4).cast("int"))).alias("kind"))


@query
def evidence_records(spark, sf_dir):
    made = A.routes(spark, sf_dir).withColumn("method", F.lower("method")).withColumn("codes", F.array(F.col("codes")[0], F.lit(404), F.lit(202))).withColumn("confidence", F.col("ord") % 97 / 97)
    out = K.evidence_records(made)
    return out.select("ord", "method", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), "line_end", "confidence", "extractor_version")


@query
def excluded_repositories(spark, sf_dir):
    fam = E.families(A.repositories(spark, sf_dir), evidence(spark, sf_dir))
    return fam.where("excluded").groupBy("reason").agg(F.count("*").alias("repositories"))


SEED = "20260904"


@query
def extracted_evidence(spark, sf_dir):
    files = A.sources(spark, sf_dir)
    found = extract(files).withColumn("repository", F.array_join(F.slice(F.split("rel_path", "/"), 1, 2), "/"))
    codes = F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes")
    return E.extracted(found).select("repository", "rel_path", "line", "method", "path", "concept", "reason", "pattern", "confidence", codes)


@query
def discovery_seeds(spark, sf_dir):
    seeds = D.seeds(A.items(spark, sf_dir))
    return seeds.select("repository_url", "owner", "name", "language", "framework", "stars", "project_category", "probable_template", "vendor", "size_kb")


@query
def delete_buckets(spark, sf_dir):
    return S.delete_buckets(frame(spark, sf_dir))


@query
def cell_representatives(spark, sf_dir):
    return S.representatives(frame(spark, sf_dir), SEED).select("pattern", "family_id", "repository", "method", "normalized_path", "source_kind", "cell_routes")


def selected(linked: DataFrame, profile: str) -> DataFrame:
    return S.select_cells(S.cell_queue(linked, SEED), S.profile_of(R.SAMPLE_SIZES, profile))


@query
def cell_sample(spark, sf_dir):
    return selected(settled(frame(spark, sf_dir)), "full")


@query
def cell_routes(spark, sf_dir):
    own = settled(frame(spark, sf_dir))
    return S.expand_cells(selected(own, "minimum"), own).select("route_sample_id", "pattern", "family_id", "bucket", "repository", "method", "normalized_path", "source_kind")


@query
def route_sample(spark, sf_dir):
    return S.route_sample(frame(spark, sf_dir), SEED).select("stratum", "position", "repository", "method", "normalized_path", "source_kind", "stratum_size", "weight")


@query
def strict_family_sample(spark, sf_dir):
    return S.family_sample(frame(spark, sf_dir), SEED).select("family_id", "memberships", "position", "stratum_size", "weight")


@query
def concept_report(spark, sf_dir):
    own, concepts, compared, scores = scored(spark, sf_dir)
    said = concepts.join(scores.select("concept", "score"), "concept").join(compared.select("concept", "coverage", "conflict"), "concept")
    return report.concept_lines(said.join(M.vendors(own), "concept"))


@query
def linkage_report(spark, sf_dir):
    return report.linkage_lines(M.linkage_totals(M.linkage(rows(spark, sf_dir))))
