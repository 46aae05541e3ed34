"""Route evidence and repositories derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOUNS = ["jobs", "tasks", "runs", "orders", "subscriptions", "exports", "invoices", "builds"]
PARAMS = ["/:id", "/{id}", "/<int:id>", "/{id:path}"]
SUFFIXES = ["", "/status", "/cancel", "/stop", "?page=2", "/search", "/list"]
SYMBOLS = ["handler", "createItem", "cancelJob", "getStatus"]


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, repository, method, path, codes, source_kind, file, line, symbol."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")

    def pick(values, step):
        return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast((event_id div {step}) % {len(values)} as int)"))

    method = F.when(F.col("event_type") == "signup", "POST").when(F.col("event_type") == "purchase", "PUT").when(F.col("event_type") == "error", "DELETE").otherwise("GET")
    return e.select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("org"), F.col("user_id") % 7, F.lit("/svc"), F.col("user_id")).alias("repository"),
        method.alias("method"),
        F.concat(F.lit("/"), pick(NOUNS, 1), pick(PARAMS, 8), pick(SUFFIXES, 32)).alias("path"),
        F.array(F.when(F.col("value") > 120, 202).otherwise(200)).alias("codes"),
        F.when(F.col("event_id") % 3 == 0, "openapi").otherwise("source").alias("source_kind"),
        F.concat(F.lit("src/f"), F.col("event_id") % 13, F.lit(".py")).alias("file"),
        (F.col("event_id") % 400 + 1).cast("int").alias("line"),
        pick(SYMBOLS, 5).alias("symbol"),
        F.when(F.col("event_id") % 3 == 0, pick(SYMBOLS, 5)).alias("summary"),
        F.when(F.col("event_id") % 6 == 0, F.lit("described")).alias("description"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, user_id, owner, name, language, fork_parent, probable_origin, category."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    owner, name = F.concat(F.lit("org"), F.col("user_id") % 7), F.concat(F.lit("svc"), F.col("user_id"))
    return u.select(
        F.concat(owner, F.lit("/"), name).alias("repo_id"),
        "user_id",
        owner.alias("owner"),
        F.concat(name, F.when(F.col("user_id") % 11 == 3, F.lit("-demo")).otherwise(F.lit(""))).alias("name"),
        F.get(F.array(*[F.lit(x) for x in ("python", "go", "java", "")]), (F.col("user_id") % 4).cast("int")).alias("language"),
        F.when(F.col("user_id") % 9 == 1, F.concat(F.lit("up/r"), F.col("user_id") % 3)).alias("fork_parent"),
        F.when(F.col("user_id") % 10 == 2, F.concat(F.lit("orig"), F.col("user_id") % 4)).alias("probable_origin"),
        F.when(F.col("user_id") % 13 == 5, F.lit("tutorial")).otherwise(F.lit("service")).alias("category"),
        F.get(F.array(*[F.lit(x) for x in ("express", "flask", "", None, "gin")]), (F.col("user_id") % 5).cast("int")).alias("framework"),
        owner.alias("vendor"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repository, rel_path, content: the routes of ``routes`` as source files of up to 500 events."""
    r = routes(spark, sf_dir).withColumn("part", F.expr("ord div 500"))
    handler = F.concat(F.lit("app."), F.lower("method"), F.lit("('"), "path", F.lit("', (q, r) => {\nr.sendStatus("), F.col("codes")[0].cast("string"), F.lit(") })"))
    files = r.groupBy("repository", "part").agg(F.array_sort(F.collect_list(F.struct("ord", handler.alias("text")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: x["text"]), "\n")
    return files.select("repository", F.concat("repository", F.lit("/src/part"), "part", F.lit(".ts")).alias("rel_path"), F.encode(text, "UTF-8").alias("content"))


ITEM_NAMES = ["queue", "svc-cli", "runner", "client-sdk", "demo-app", "api", "setup-x", "store"]
ITEM_TEXTS = ["REST API server with Flask", "A workflow engine", "Command line tools", "Chrome extension", "Job queue on Kubernetes", "Notes", None]
ITEM_TOPICS = ["scheduler", "starter", "gin", "webhook", "openapi"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search items, one per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    i = F.col("event_id")
    at = lambda values, step: F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast((event_id div {step}) % {len(values)} as int)"))
    name = F.concat(at(ITEM_NAMES, 1), F.lit("-"), i)
    return e.select(
        "event_id",
        F.when(i % 17 == 0, F.concat(F.lit("https://example.org/"), i)).otherwise(F.concat(F.lit("https://github.com/org/"), name)).alias("html_url"),
        F.when(i % 3 == 0, at(ITEM_NAMES, 1)).otherwise(name).alias("name"),
        F.concat(F.lit("org/"), name).alias("full_name"),
        at(ITEM_TEXTS, 8).alias("description"),
        F.when(i % 4 > 0, "Go").alias("language"),
        F.lit("main").alias("default_branch"),
        F.lit("2025-01-01").alias("pushed_at"),
        (i % 900).alias("stargazers_count"),
        (i % 90).alias("forks_count"),
        (i % 260_000).alias("size"),
        F.array(at(ITEM_TOPICS, 56)).alias("topics"),
        F.struct(F.when(i % 2 == 0, "vendor").alias("login")).alias("owner"),
        F.struct(F.lit("MIT").alias("spdx_id")).alias("license"),
        (i % 19 == 0).alias("archived"),
        (i % 23 == 0).alias("fork"),
        F.lit(None).cast("boolean").alias("private"),
    )


def seed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, value: seed documents of up to 50 items, every other one a bare list; items are addresses or objects."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    i = F.col("event_id")
    url = F.concat(F.lit("https://github.com/o"), i % 5, F.lit("/n"), i)
    item = (
        F.when(i % 3 == 0, F.concat(F.lit('"'), url, F.lit('"')))
        .when(i % 3 == 1, F.concat(F.lit('{"repository_url":"'), url, F.lit('.git","stars":'), F.when(i % 2 == 0, F.lit("null")).otherwise((i % 9).cast("string")), F.lit(',"language":"Go"}')))
        .otherwise(F.concat(F.lit('{"url":"'), url, F.lit('/","owner":"x","name":"y'), i, F.lit('"}')))
    )
    docs = e.select(F.expr("event_id div 50").alias("doc"), F.struct("event_id", item.alias("item")).alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["item"]), ","), F.lit("]"))
    return docs.select("doc", F.when(F.col("doc") % 2 == 0, text).otherwise(F.concat(F.lit('{"repositories":'), text, F.lit("}"))).alias("value"))


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up says of the repositories of every fourth event."""
    i = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").where(i % 4 == 0)
    return e.select(
        F.when(i % 3 == 2, F.concat(F.lit("x/y"), i)).otherwise(F.concat(F.lit("o"), i % 5, F.lit("/n"), i)).alias("repo_id"),
        F.lit("Rust").alias("language"),
        (i % 7).alias("stargazers_count"),
        (i % 11).alias("forks_count"),
        F.struct(F.when(i % 8 == 0, "MIT").alias("spdx_id"), F.lit("apache").alias("key")).alias("license"),
        F.lit("2025-02-03").alias("pushed_at"),
        F.lit("trunk").alias("default_branch"),
        F.when(i % 12 == 0, "up/stream").alias("parent"),
    )


#: A standards map in its stored shape: id, concepts, confidence, default coverage, gap, and coverage by concept.
STANDARDS = [
    ("rfc9110", ["http-async-operation", "http-cancellation"], 0.9, "adjacent", "general semantics only", {"http-async-operation": ("partial", "202 without a status resource", "none", ["section 15.3.3"], 0.95)}),
    ("rfc7240", ["http-async-operation"], 0.8, None, None, {"http-async-operation": ("partial", "", "", ["respond-async"], None)}),
    ("rfc9457", ["http-async-operation", "http-cancellation"], 0.7, None, "errors only", {"http-cancellation": ("none", None, "none", None, 0.5)}),
    ("openapi", ["http-async-operation", "http-cancellation"], None, "adjacent", None, {}),
    ("odata", ["http-async-operation"], 0.6, "partial", "own status monitor", {"http-async-operation": (None, None, "status monitor differs", [], 0.6)}),
    ("cloudevents", ["http-events"], 0.4, "full", None, {}),
    ("lro-guide", ["http-cancellation"], 0.5, None, None, {"http-cancellation": ("adjacent", "guideline", None, ["cancel method"], None)}),
]
STANDARD = "ord int, id string, title string, url string, concepts array<string>, confidence double, default_coverage string, gap string, concept_coverage map<string, struct<coverage:string, gap:string, conflict:string, evidence:array<string>, confidence:double>>"


def standards(spark: SparkSession) -> DataFrame:
    rows = [(k, i, i.upper(), f"https://example.org/{i}", *rest) for k, (i, *rest) in enumerate(STANDARDS)]
    return spark.createDataFrame(rows, STANDARD)
