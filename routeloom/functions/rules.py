"""Word lists and orders of the HTTP route rules. Results depend on them as they are."""

ASYNC_NOUNS = [
    "allocation", "allocations", "backfill", "backfills", "backup", "backups", "job", "jobs", "operation",
    "operations", "task", "tasks", "run", "runs", "execution", "executions", "workflow", "workflows", "build",
    "builds", "deployment", "deployments", "pipeline", "pipelines", "dagrun", "dagruns", "export", "exports",
    "import", "imports", "index", "indexes", "indexing", "indices", "migration", "migrations", "provision",
    "provisioning", "provisions", "query", "queries", "render", "renders", "report", "reports", "restore", "restores",
    "scan", "scans", "snapshot", "snapshots", "sync", "syncs", "training", "trainings", "transcode", "transcodes",
    "transcoding",
]
CANCELABLE = [
    "allocation", "allocations", "backfill", "backfills", "backup", "backups", "build", "builds", "deployment",
    "deployments", "execution", "executions", "job", "jobs", "operation", "operations", "provision", "provisioning",
    "provisions", "restore", "restores", "run", "runs", "scan", "scans", "snapshot", "snapshots", "sync", "syncs",
    "task", "tasks", "training", "trainings", "transcode", "transcodes", "transcoding",
]
CANCEL_WORDS = ["cancel", "cancellation", "abort", "stop", "terminate", "kill"]
STATUS_WORDS = ["status", "state", "progress", "result", "results"]
QUERY_ACTIONS = ["count", "filter", "list", "paginate", "search", "history"]
CANCELLATION, ASYNC = "http-cancellation", "http-async-operation"
CONCEPTS = [CANCELLATION, ASYNC]
STRICT_PATTERNS = [
    "post-subresource-cancel",
    "put-action-cancel",
    "get-cancel-link",
    "post-action-cancel",
    "delete-action-cancel",
    "patch-state-cancelled",
    "post-202-accepted",
    "get-status-resource",
    "mutation-202-accepted",
]
FRAMEWORK_MARKERS = ["fastapi", "django", "flask", "express", "nestjs", "spring", "rails", "gin", "chi", "actix", "axum", "laravel", "phoenix"]
NO_STANDARD = "No seeded standards comparison exists for this concept."
COVERAGE_ORDER = ["unknown", "none", "adjacent", "partial", "full"]

#: Discovery. Substrings of lower-cased names, descriptions and topics.
SERVER_MARKERS = [
    "api server", "backend", "cloud native", "controller", "developer platform", "distributed", "gateway", "job",
    "job queue", "kubernetes", "operator", "orchestration", "pipeline", "rest api", "scheduler", "server", "service",
    "webhook", "workflow engine",
]
DOMAIN_MARKERS = ["async operation", "idempotency", "long running", "task runner", "workflow"]
SDK_MARKERS = [
    "api client", "api-client", "client library", "client sdk", "client-sdk", "codegen", "generated client",
    "generated sdk", "http client", "kiota", "openapi generator", "openapi-generator", "sdk", "swagger codegen",
    "swagger-codegen",
]
TOY_MARKERS = ["awesome", "demo", "demos", "example", "examples", "sample", "samples", "starter", "template", "templates", "tutorial"]
NAME_MARKERS = [
    "alfred", "awesome", "cheatsheet", "font-awesome", "github-action", "github-actions", "notebook", "obsidian",
    "paper", "prompt", "prompts", "roadmap", "sample", "samples", "starter", "template", "templates", "tutorial",
    "wallpaper", "workflow-template", "workflow-templates", "workflow_template", "workflow_templates",
]
CONTENT_MARKERS = [
    "alfred workflow", "browser extension", "chrome extension", "comfyui", "desktop app", "figma", "jetbrains",
    "obsidian", "paper reading", "prompt", "prompts", "vscode", "wallpaper",
]
ACTION_MARKERS = ["github action", "github actions"]
LIBRARY_ENDINGS = ["-sdk", "-client", "_sdk", "_client"]
TEMPLATE_MARKERS = ["template", "starter", "scaffold", "sample", "demo", "example"]
CATEGORY_MARKERS = {
    "workflow": "workflow-engine",
    "orchestration": "orchestration-engine",
    "scheduler": "job-scheduler",
    "pipeline": "ci-orchestration",
    "kubernetes": "cloud-native",
    "webhook": "developer-platform",
    "openapi": "api-server",
    "swagger": "api-server",
    "api gateway": "api-gateway",
}
MAX_REPOSITORY_KB = 250_000
SEARCH_LANGUAGES = ["Go", "TypeScript", "Python", "Java", "JavaScript", "Rust", "Ruby", "PHP", "C#", "Kotlin", "Scala", "Elixir"]
SEARCH_TERMS = [
    "workflow", "scheduler", "orchestration", "job queue", "pipeline", "webhook", "kubernetes",
    '"developer platform"', '"cloud native"', "automation", '"long running"', "idempotency", '"async operation"',
    "task runner", "api server", '"rest api"', "openapi server", "swagger server",
]

#: Sampling. Patterns and buckets in order, sizes of the two profiles (None: all).
SAMPLE_SIZES = {
    "full": {
        "post-subresource-cancel": 80, "post-action-cancel": 35, "delete-action-cancel": 31, "put-action-cancel": 27,
        "get-cancel-link": 18, "patch-state-cancelled": 5, "delete-operation-resource": 124,
    },
    "minimum": {
        "post-subresource-cancel": 50, "post-action-cancel": 30, "delete-action-cancel": 20, "put-action-cancel": 15,
        "get-cancel-link": 10, "patch-state-cancelled": 5, "delete-operation-resource": 10,
    },
}
#: Which pattern a route counts for if it fits several, first ones first.
PRIMARY_ORDER = [
    "post-subresource-cancel",
    "post-action-cancel",
    "delete-action-cancel",
    "put-action-cancel",
    "get-cancel-link",
    "patch-state-cancelled",
    "delete-operation-resource",
]
ROUTE_SAMPLE_SIZES = {
    "full": {
        "delete-operation-resource:any": 100, "post-subresource-cancel:linked": 30, "post-subresource-cancel:unlinked": 70,
        "post-action-cancel:any": 50, "delete-action-cancel:any": None, "put-action-cancel:any": None,
        "get-cancel-link:any": None, "patch-state-cancelled:any": None,
    },
    "minimum": {
        "delete-operation-resource:any": 25, "post-subresource-cancel:linked": 15, "post-subresource-cancel:unlinked": 35,
        "post-action-cancel:any": 30, "delete-action-cancel:any": 20, "put-action-cancel:any": 15,
        "get-cancel-link:any": 10, "patch-state-cancelled:any": None,
    },
}
FAMILY_SAMPLE_SIZES = {"full": 140, "minimum": 80}
PILOT_SIZES, PILOT_SEED = {"delete-operation-resource": 20, "post-subresource-cancel": 20}, 2026090501
BUCKETS = ["mixed-same-resource-and-risk", "same-resource-linked", "mixed-operation-target-and-risk", "operation-like-target", "domain-transition-risk", "other"]
DELETE_PATTERN = "delete-operation-resource"
DELETE_BUCKET_SIZES = {
    124: {"delete-only-linked": 55, "delete-and-strict-different-resource": 30, "delete-and-strict-same-resource": 15, "delete-unlinked": 24},
    10: {"delete-only-linked": 7, "delete-and-strict-different-resource": 2, "delete-and-strict-same-resource": 1},
}
PER_PATTERN_CAP, TOTAL_CAP = 2, 5

#: Report. Sentences for and against a concept.
FOR_FAMILIES = "Observed across multiple independent implementation families."
FOR_PATTERNS = "Multiple interaction patterns indicate real implementation divergence."
FOR_GAP = "Existing seeded standards do not fully cover the observed concept."
FOR_CONCEPT = {
    CANCELLATION: "Cancellation affects client interoperability and safe operation lifecycle handling.",
    ASYNC: "Asynchronous operations shape polling, progress, result, and retry behavior.",
}
FOR_NOTHING = "Score is driven by the current corpus metrics."
LOW_FAMILIES = "Stage corpus has limited independent-family evidence."
LOW_PATTERNS = "Low observed divergence may not justify a new standard."
LOW_COVERED = "Seeded standards already cover part of the concept."
LOW_CONFLICT = "Some observed practice may conflict with existing standards."
AGAINST_ALWAYS = ["Stage-1 extraction may undercount dynamic framework routes.", "OpenAPI-documented APIs may not represent internal server practice."]
AGAINST_PARTIAL = "An implementation guide or profile may be more appropriate than a new RFC."
AGAINST_VENDORS = "Vendor concentration may inflate apparent prevalence."
AGAINST_CANCELLATION = "Cancellation semantics may depend on domain-specific safety guarantees."

#: Claims of the linkage section with their denominators, and parts of its envelope.
RATIO_CLAIMS = [
    ("Same-resource linkage within strict cancellation", "linked", "strict cancellation families", "Operation-cancellation precision check"),
    ("Operation-like target within strict cancellation", "target", "strict cancellation families", "Broader operation-cancellation recall check"),
    ("Same-resource cancellation among async families", "linked", "async-operation families", "Conservative async-affordance claim"),
    ("Operation-like cancellation among async families", "target", "async-operation families", "Broad async-affordance claim after review"),
    ("Domain-transition-risk review queue", "risk", "strict cancellation families", "Precision risk requiring manual labels"),
]
ENVELOPE_PARTS = [
    ("Strict explicit-cancel routes with same-resource linkage", "strict", "Conservative lower structural subset"),
    ("`delete-operation-resource` routes with same-resource linkage", "deletes", "Promotion-audit swing factor"),
    ("Overlap between the two linked sets", "overlap", "Prevents double counting"),
    ("Union of strict-linked and delete-linked sets", "either", "Pre-label upper structural envelope"),
]
