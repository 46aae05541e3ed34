"""Command line: the stages over a data folder, each a table that the next one reads.

    python -m routeloom discover --data D [--items found.jsonl] [--target N]
    python -m routeloom collect --data D --seeds seeds.json [--limit N] [--metadata found.jsonl]
    python -m routeloom analyze --data D --files ROOT --repositories repos.jsonl
    python -m routeloom normalize|dedupe|cluster|compare-standards|score|report --data D
    python -m routeloom sample-cells|sample-cell-routes|sample-routes|sample-families --data D
    python -m routeloom split-labels --data D --sample sample-cells
    python -m routeloom pilot --data D
    python -m routeloom run --data D --files ROOT --repositories repos.jsonl

Repositories: JSON lines with repo_id, owner, name, language, fork_parent,
probable_origin, project_category; without them the collected ones are taken.
ROOT holds a folder owner/name for each. ROUTELOOM_DATA and ROUTELOOM_FILES
give --data and --files, ROUTELOOM_CODE_COMMIT what provenance says of the
code, GITHUB_TOKEN the search's credentials.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import sheet_columns as C
from .operators import collect as K
from .operators import discovery as D
from .operators import evidence as E
from .operators import incremental as I
from .operators import metrics as M
from .operators import sampling as S
from .operators import sheets as H
from .plans import report
from .sources import extract, files, remote

REPOSITORY = "repo_id string, owner string, name string, language string, fork_parent string, probable_origin string, project_category string"
COVERED = "map<string, struct<coverage:string, gap:string, conflict:string, evidence:array<string>, confidence:double>>"
STANDARDS = f"standards array<struct<id:string, title:string, url:string, concepts:array<string>, confidence:double, defaultCoverage:string, gap:string, conceptCoverage:{COVERED}>>"
ITEM = (
    "html_url string, name string, full_name string, description string, language string, default_branch string, pushed_at string, stargazers_count long, forks_count long, "
    "size long, topics array<string>, owner struct<login:string>, license struct<spdx_id:string>, archived boolean, fork boolean, private boolean"
)
FOUND = "repo_id string, language string, stargazers_count long, forks_count long, license struct<spdx_id:string, key:string>, pushed_at string, default_branch string, parent string"
STAGES = ["analyze", "normalize", "dedupe", "cluster", "compare-standards", "score", "report"]
SAMPLES = {"sample-cells": C.REPRESENTATIVE_SHEET, "sample-cell-routes": C.CELL_ROUTE_SHEET, "sample-routes": C.ROUTE_SHEET, "sample-families": C.FAMILY_SHEET}
UNITS = {"sample-cells": "family-pattern-representative", "sample-cell-routes": "family-pattern-route", "sample-routes": "route-record", "sample-families": "strict-family-representative"}
OTHERS = ["discover", "collect", "split-labels", "pilot", "run"]


class Job:
    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args = spark, args

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.args.data}/{name}")

    def write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.args.data}/{name}")

    def there(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.args.data}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Write tables that may be read to make them: all of them aside first, then in their places."""
        for name, rows in tables.items():
            self.write(rows, f"{name}.new")
        for name in tables:
            self.write(self.read(f"{name}.new"), name)

    def discover(self) -> None:
        """Seeds from a search (or from items that were found before), resumed after the queries that have run."""
        if self.args.items:
            found = files.read_jsonl(self.spark, self.args.items, f"query string, ord long, item_order long, {ITEM}").withColumnRenamed("ord", "query_order")
        else:
            raw = remote.searched(I.search_queries(self.spark, R.SEARCH_TERMS, R.SEARCH_LANGUAGES, 20), 200)
            found = raw.select("query", F.col("ord").alias("query_order"), "item_order", F.from_json("item", ITEM).alias("i")).select("query", "query_order", "item_order", "i.*")
        found = D.seeds(found, ["query", "query_order", "item_order"])
        known = self.read("discovered") if self.there("discovered") else None
        log = self.read("queries") if self.there("queries") else None
        new, ran = K.discovered(found, known if known is not None else self.spark.createDataFrame([], "repository_url string"), log if log is not None else self.spark.createDataFrame([], "query string"), self.args.target)
        self.replace({"discovered": new if known is None else known.unionByName(new, allowMissingColumns=True), "queries": ran if log is None else log.unionByName(ran)})

    def collect(self) -> None:
        documents = self.spark.read.text(self.args.seeds, wholetext=True)
        items = K.seeds(documents, self.args.limit)
        found = files.read_jsonl(self.spark, self.args.metadata, FOUND) if self.args.metadata else self.spark.createDataFrame([], FOUND)
        self.write(items.select("ordinal", "owner", "name", "repository_url"), "seeds")
        self.write(K.repositories(items, found), "repositories")

    def analyze(self) -> None:
        if self.args.repositories:
            self.write(files.read_jsonl(self.spark, self.args.repositories, REPOSITORY), "repositories")
        repos = self.read("repositories")
        tree = files.tree(self.spark, self.args.files)
        found = extract.extract(files.source_files(tree).unionByName(files.description_files(tree)))
        found = found.withColumn("repository", F.substring_index("rel_path", "/", 2))
        self.write(found, "routes")
        unread = self.read("routes").where("extractor = 'error'").select("repository", F.lit("unreadable").alias("error"), "rel_path", F.lit(False).alias("retryable"))
        here = tree.select(F.substring_index("rel_path", "/", 2).alias("repo_id")).distinct()
        missing = repos.join(here, "repo_id", "left_anti").select(F.col("repo_id").alias("repository"), F.lit("missing_checkout").alias("error"), F.lit(None).cast("string").alias("rel_path"), F.lit(True).alias("retryable"))
        self.write(unread.unionByName(missing), "errors")

    def normalize(self) -> None:
        raw = E.extracted(self.read("routes")).withColumnRenamed("rel_path", "file").withColumn("summary", F.col("symbol")).withColumn("description", F.col("value_text"))
        order = F.struct("repository", "file", "line", "method", "path", "concept", F.col("extractor") == "openapi")
        # The order within a group is all that the fold needs, so the order column is the key itself.
        self.write(E.deduplicated(raw.withColumn("ord", order)), "evidence")

    def dedupe(self) -> None:
        repos = self.read("repositories").withColumn("category", F.coalesce("project_category", F.lit("")))
        self.write(E.families(repos, self.read("evidence")), "families")

    def rows(self) -> DataFrame:
        return E.independent(self.read("evidence"), self.read("families"))

    def cluster(self) -> None:
        rows = self.rows()
        self.write(M.concept_metrics(rows), "concepts")
        self.write(M.pattern_metrics(rows), "patterns")
        self.write(M.linkage(rows), "linkage")
        self.write(M.linkage_totals(self.read("linkage")), "linkage_totals")

    def compare_standards(self) -> None:
        known = files.read_json(self.spark, self.args.standards or f"{self.args.data}/standards.json", STANDARDS)
        known = known.select(F.posexplode("standards").alias("ord", "s")).select("ord", "s.*").withColumnsRenamed({"defaultCoverage": "default_coverage", "conceptCoverage": "concept_coverage"})
        rows = M.standards_rows(self.read("concepts"), known)
        self.write(rows, "standards_rows")
        self.write(M.compare_standards(self.read("concepts"), self.read("standards_rows").where("id is not null")), "standards")

    def score(self) -> None:
        total = float(self.read("families").where("not excluded").select("family_id").distinct().count())
        concepts, strict = (df.withColumn("total", F.lit(total)) for df in (self.read("concepts"), M.strict_metrics(self.rows())))
        self.write(M.both_scores(concepts, strict, self.read("standards"), F.col("total")), "scores")

    def report(self) -> None:
        score, compared = self.read("scores").select("concept", "score"), self.read("standards").select("concept", "coverage", "conflict")
        scored = self.read("concepts").join(score, "concept").join(compared, "concept").join(M.vendors(self.rows()), "concept")
        ratios = report.linkage_ratios(self.read("linkage_totals"), M.envelope(self.read("linkage")), self.read("concepts"))
        report.write_report(self.spark, f"{self.args.data}/report", scored, self.read("linkage_totals"), ratios, f"{self.args.data}/candidates")
        errors = self.read("errors").select(F.col("repository").alias("repo"), F.lit("analyze").alias("stage"), F.col("error").alias("error_type"), F.col("rel_path").alias("error"), "retryable")
        self.write(report.review_lines(self.read("evidence"), errors), "review")

    def sample(self, kind: str) -> None:
        own = S.primary_pattern(self.read("linkage"))
        seed, profile = str(self.args.seed), self.args.profile
        cells, sizes = S.cells(own), S.profile_of(R.SAMPLE_SIZES, profile)
        if kind == "sample-routes":
            out = S.route_sample(own, seed, profile).withColumn("sample_size", F.least("stratum_size", F.round(F.col("stratum_size") / F.col("weight")).cast("long")))
        elif kind == "sample-families":
            out = S.family_sample(own, seed, profile)
        else:
            out = S.select_cells(S.cell_queue(own, seed), sizes)
            out = S.expand_cells(out, own) if kind == "sample-cell-routes" else out
        self.write(out, kind)
        self.sheet(kind, own, cells, sizes)

    def sheet(self, kind: str, own: DataFrame, cells: DataFrame, sizes: dict[str, int]) -> None:
        """The sample as a sheet for people, with a summary beside it."""
        picked = self.read(kind)
        rows = H.sheet_rows(own, self.rows())
        if kind == "sample-routes":
            key = [*S.ROUTE, "source_kind", "pattern"]
            numbered = picked.select(*key, "stratum", "position", "stratum_size", "sample_size", "fraction", "weight")
            out = rows.join(numbered, key).withColumn("sample_id", F.concat_ws("-", F.lit("cancel-route"), F.regexp_replace("stratum", ":", "-"), F.format_string("%04d", F.col("position") + 1)))
        else:
            if kind == "sample-families":
                first = S.representatives(own.where(F.col("pattern") != R.DELETE_PATTERN).withColumn("cell_", F.col("pattern")).withColumn("pattern", F.lit("strict")), str(self.args.seed))
                chosen = first.select("family_id", F.col("cell_").alias("pattern"), *S.ROUTE, "source_kind").join(picked, "family_id").withColumn("sample_id", F.format_string("cancel-family-%04d", F.col("position") + 1))
            elif kind == "sample-cell-routes":
                chosen = picked.select("sample_id", "route_sample_id", F.col("route_nth").alias("cellRouteOrdinal"), "pattern", "family_id", F.col("bucket").alias("linkageBucket"), *S.ROUTE, "source_kind")
                chosen = chosen.withColumnsRenamed({"sample_id": "cell_sample_id", "route_sample_id": "sample_id"})
            else:
                first = S.representatives(own, str(self.args.seed)).select("pattern", "family_id", *S.ROUTE, "source_kind")
                chosen = picked.select("sample_id", "pattern", "family_id", F.col("bucket").alias("linkageBucket")).join(first, ["pattern", "family_id"])
            out = rows.join(chosen.drop("family_id"), [*S.ROUTE, "source_kind", "pattern"])
            cell = H.cell_evidence(own, ["pattern", "family_id"], 5)
            out = out.join(cell, ["pattern", "family_id"]).join(S.delete_buckets(own).withColumnRenamed("bucket", "delete_bucket").withColumn("pattern", F.lit(R.DELETE_PATTERN)), ["pattern", "family_id"], "left")
            if kind != "sample-families":
                out = out.join(H.design_weights(cells, sizes), "pattern").join(H.memberships(own), "family_id", "left")
                out = out.join(H.inclusion(cells, sizes).withColumnRenamed("weight", "family_weight"), "family_id", "left")
        self.write(out, f"{kind}-rows")
        out = self.read(f"{kind}-rows")
        files.write_csv(H.sheet(out, SAMPLES[kind], UNITS[kind]).orderBy("sample_id"), f"{self.args.data}/{kind}.csv", SAMPLES[kind])
        counts: dict = {}
        for r in H.summary(out, cells).collect():  # one row for each pattern, bucket and cell size
            counts.setdefault(r["counter"], {})[r["key"]] = r["n"]
        provenance = H.provenance(self.spark, self.args.seed, [f"{self.args.data}/evidence", f"{self.args.data}/families"])
        files.write_json(self.spark, {"samplingUnit": UNITS[kind], "sampleCount": out.count(), **counts, "selectionProvenance": provenance}, f"{self.args.data}/{kind}.summary.json")

    def split_labels(self) -> None:
        rows = files.read_csv(self.spark, f"{self.args.data}/{self.args.sample}.csv")
        labelling, machine = H.blind_split(rows, H.operation_context(self.read("evidence").withColumn("ord", F.monotonically_increasing_id())))
        files.write_csv(labelling, f"{self.args.data}/labelling.csv")
        files.write_csv(machine, f"{self.args.data}/machine.csv")
        files.write_json(self.spark, {"rows": rows.count(), "labellingColumns": labelling.columns, "machineColumns": machine.columns}, f"{self.args.data}/labelling.summary.json")

    def pilot(self) -> None:
        labelling, machine = (files.read_csv(self.spark, f"{self.args.data}/{name}.csv") for name in ("labelling", "machine"))
        out = H.pilot_sheet(labelling, machine).orderBy("sample_id")
        files.write_csv(out, f"{self.args.data}/pilot.csv", C.PILOT)
        ids = [r["sample_id"] for r in out.select("sample_id").collect()]
        files.write_json(self.spark, {"pilotSeed": R.PILOT_SEED, "pilotRowCount": len(ids), "sampleIds": ids, "excludedFromFinalEstimates": True}, f"{self.args.data}/pilot.summary.json")

    def do(self, command: str) -> None:
        if command in SAMPLES:
            self.sample(command)
        else:
            for stage in STAGES if command == "run" else [command]:
                getattr(self, stage.replace("-", "_"))()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="routeloom")
    parser.add_argument("command", choices=[*STAGES, *SAMPLES, *OTHERS])
    parser.add_argument("--data", default=os.environ.get("ROUTELOOM_DATA"))
    parser.add_argument("--files", default=os.environ.get("ROUTELOOM_FILES"))
    parser.add_argument("--repositories")
    parser.add_argument("--seeds")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--metadata")
    parser.add_argument("--items")
    parser.add_argument("--target", type=int, default=5000)
    parser.add_argument("--standards")
    parser.add_argument("--sample", choices=list(SAMPLES), default="sample-cells")
    parser.add_argument("--profile", choices=sorted(R.SAMPLE_SIZES), default="full")
    parser.add_argument("--seed", type=int, default=20260904)
    args = parser.parse_args(argv)
    if not args.data:
        parser.error("--data is needed")
    if args.command in ("analyze", "run") and not args.files:
        parser.error(f"{args.command} needs --files")
    if args.command == "collect" and not args.seeds:
        parser.error("collect needs --seeds")
    Job(SparkSession.builder.getOrCreate(), args).do(args.command)


if __name__ == "__main__":
    main()
