"""Sheets, seeds, remote sources and connectors against hand-made cases."""

import hashlib
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from routeloom.functions import sheet_columns as C
from routeloom.operators import collect, evidence, metrics, sampling, sheets
from routeloom.plans import report
from routeloom.sources import files, remote

EVIDENCE = "repository string, concept string, method string, path string, normalized_path string, source_kind string, pattern string, file string, line int, codes array<int>, symbol string, confidence double, family_id string, ord long"


def test_evidence_id_depends_on_every_part(spark):
    row = ("r", "http-cancellation", "POST", "/jobs/:id/cancel", "/jobs/{var}/cancel", "source", "post-subresource-cancel", "a.ts", 3, [202], "stop", 0.9, "f", 1)
    got = sheets.identified(spark.createDataFrame([row], EVIDENCE)).first()
    route = hashlib.sha256("r\x1fPOST\x1f/jobs/{var}/cancel".encode()).hexdigest()
    own = "\x1f".join([route, "", "post-subresource-cancel", "source", "/jobs/:id/cancel", "a.ts", "3", "stop"])
    assert (got.route_id, got.evidence_id) == (route, hashlib.sha256(own.encode()).hexdigest())


def test_a_route_counts_for_one_pattern(spark):
    base = ("r", "http-cancellation", "DELETE", "/jobs/{id}", "/jobs/{var}")
    rows = [(*base, kind, pattern, "a", 1, [], "", 0.5, "f", i) for i, (kind, pattern) in enumerate([("source", "delete-operation-resource"), ("openapi", "delete-action-cancel"), ("other", "other-cancellation-route")])]
    assert [r.pattern for r in sampling.primary_pattern(spark.createDataFrame(rows, EVIDENCE)).collect()] == ["delete-action-cancel"]


def test_rows_without_a_line_come_last(spark):
    base = ("r", "http-cancellation", "POST", "/a", "/a", "source", "put-action-cancel", "f")
    rows = [(*base, line, [], "", 0.5, "fam", i) for i, line in enumerate([None, 7, 900])]
    lines = [r.line for r in spark.createDataFrame(rows, EVIDENCE).orderBy(*sampling.quality()).collect()]
    assert lines == [7, 900, None]


def test_shared_signatures_make_a_family(spark):
    rows = [(repo, "http-cancellation", "POST", "/jobs/{var}/cancel", "source", "post-subresource-cancel") for repo in ("o/a", "o/b")] + [("o/c", "http-cancellation", "PUT", "/x", "source", "put-action-cancel")]
    ev = spark.createDataFrame(rows, "repository string, concept string, method string, normalized_path string, source_kind string, pattern string")
    repos = spark.createDataFrame([("o/a", "o", "a"), ("o/b", "o", "b"), ("o/c", "o", "c"), ("o/d", "o", "d"), ("o/e", "o", "e")], "repo_id string, owner string, name string")
    repos = repos.withColumns({"language": F.lit(""), "fork_parent": F.lit(None).cast("string"), "probable_origin": F.lit(None).cast("string"), "category": F.lit("service")})
    got = {r.repo_id: (r.family_id, r.basis) for r in evidence.families(repos, ev).collect()}
    assert got["o/a"] == got["o/b"] and got["o/a"][0].startswith("api-signature:") and got["o/a"][1] == "probable"
    # Repositories without evidence have no signature to share.
    assert got["o/d"] == ("o/d", "unknown") and got["o/e"] == ("o/e", "unknown")


def test_cell_text_says_how_many_more(spark):
    base = ("r", "http-cancellation", "POST", "/a", "/a", "source", "put-action-cancel", "f")
    linked = spark.createDataFrame([(*base, i, [], "", 0.5, "fam", i) for i in range(1, 8)], EVIDENCE).withColumns({"linked": F.lit(False), "operation_target": F.lit(False), "risk": F.lit(True)})
    got = sheets.cell_evidence(linked, ["pattern", "family_id"], 5).first()
    assert got.n_routes == 7 and got.cell_text.startswith("POST /a domain-transition-risk f:1 | ") and got.cell_text.endswith("f:5 | ... +2 more")


def test_blind_split_shows_an_allow_list(spark):
    rows = spark.createDataFrame([("s1", "e1", "delete-operation-resource", "x", "r", "secret")], "sample_id string, evidence_id string, pattern string, linkageBucket string, repository string, more string")
    context = spark.createDataFrame([("e1", "Stop", "Stops it")], "evidence_id string, operationSummary string, operationDescription string")
    labelling, machine = sheets.blind_split(rows, context)
    assert labelling.columns == ["sample_id", "evidence_id", "repository", "operationSummary", "operationDescription", *C.WORKFLOW]
    assert machine.columns == ["sample_id", "evidence_id", "pattern", "linkageBucket", "more"]
    first = labelling.first()
    assert (first.operationSummary, first.allowed_final_labels, first.labelerA_label) == ("Stop", "cancellation;deletion-or-archival;ambiguous", "")


def test_agreement_and_bounds(spark):
    pairs = [("x", "x")] * 6 + [("x", "y"), ("y", "y"), ("y", "x"), (None, "x"), ("", "x")]
    got = sheets.agreement(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert (got.n, got.agreed) == (9, 7) and got.kappa == pytest.approx((7 / 9 - 53 / 81) / (1 - 53 / 81), abs=1e-6)
    labelled = spark.createDataFrame([("s", "yes"), ("s", "ambiguous"), ("t", "no"), ("t", "yes")], "stratum string, label string")
    strata = spark.createDataFrame([("s", 30), ("t", 10), ("none", 99)], "stratum string, size long")
    got = sheets.stratified_bounds(labelled, strata, "yes").first()
    assert (got.low, got.high) == (0.5, 0.875)


def test_strict_metrics_have_zero_rows(spark):
    row = ("r", "http-cancellation", "POST", "/a", "/a", "source", "put-action-cancel", "f", 1, [], "", 0.5, "fam", 1)
    got = {r.concept: (r.families, r.evidence) for r in metrics.strict_metrics(spark.createDataFrame([row], EVIDENCE)).collect()}
    assert got == {"http-cancellation": (1, 1), "http-async-operation": (0, 0)}


def test_review_lines(spark):
    rows = spark.createDataFrame([("r", "http-cancellation", "POST", "/a", "/a", "source", "p", "f", i, [], "", 0.5, "fam", i) for i in range(150)], EVIDENCE)
    errors = spark.createDataFrame([("o/x", "collect", "git_clone_failed", "boom", True)], "repo string, stage string, error_type string, error string, retryable boolean")
    got = report.review_lines(rows, errors).orderBy("section", "nth").collect()
    assert len(got) == 101 and got[0].line == "- [ ] Review — `o/x` `collect` `git_clone_failed` retryable=True: boom"
    assert got[1].line == "- [ ] TP  [ ] FP  [ ] Unclassified — `http-cancellation` `p` `r` `POST /a` `f:0` confidence=0.5"


def test_outputs_in_seed_order(spark):
    seeds = spark.createDataFrame([("o", "b", 1), ("o", "a", 2)], "owner string, name string, ordinal long")
    repos = spark.createDataFrame([("o/a",), ("o/zz",), ("o/b",)], "repo_id string")
    ev = spark.createDataFrame([("o/a", "f", 2, "GET", "/", "c"), ("o/b", "g", 1, "GET", "/", "c"), ("o/b", "f", 9, "GET", "/", "c"), ("o/b", "f", 1, "GET", "/", "c")], "repository string, file string, line int, method string, path string, concept string")
    errors = spark.createDataFrame([("o/a", "s", "t", "e", True), ("o/b", "s", "t", "e", False)], "repo string, stage string, error_type string, error string, retryable boolean")
    first, second, third = collect.stream_outputs(repos, ev, errors, seeds)
    assert [r.repo_id for r in first.collect()] == ["o/b", "o/a", "o/zz"]
    assert [(r.repository, r.file, r.line) for r in second.collect()] == [("o/b", "f", 1), ("o/b", "f", 9), ("o/b", "g", 1), ("o/a", "f", 2)]
    assert [r.repo for r in third.collect()] == ["o/b", "o/a"]
    left = collect.without_retryable(repos, ev, errors)
    assert [sorted({r[0] for r in df.collect()}) for df in left] == [["o/b", "o/zz"], ["o/b"], ["o/b"]]


def test_error_records(spark):
    rows = spark.createDataFrame([("o/a", "x", "boom", None)], "repo string, error_type string, error string, retryable boolean")
    got = collect.error_records(rows, "collect").first()
    assert (got.stage, got.retryable) == ("collect", False) and len(got.timestamp) == 25 and got.timestamp.endswith("+00:00")


def test_documents_and_sheets(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    files.write_json(spark, {"b": 1, "a": ["é"]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == json.dumps({"a": ["é"], "b": 1}, indent=2, ensure_ascii=False) + "\n"
    assert files.read_json(spark, str(tmp_path / "x.json"), "a array<string>, b int").first().b == 1
    assert sheets.file_hash(spark, str(tmp_path / "x.json")) == hashlib.sha256((tmp_path / "x.json").read_bytes()).hexdigest()
    assert sheets.file_hash(spark, str(tmp_path / "none")) == ""
    files.write_csv(spark.createDataFrame([("1", 'say "x",\nthen', "z")], "b string, a string, extra string"), str(tmp_path / "s.csv"), ["a", "b", "c"])
    got = files.read_csv(spark, str(tmp_path / "s.csv"))
    assert got.columns == ["a", "b", "c"] and tuple(got.first()) == ('say "x",\nthen', "1", "")
    for _ in range(2):
        files.append_jsonl(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), "a int").count() == 2


def test_tree_under_a_folder_named_twice(spark, tmp_path):
    root = tmp_path / "work" / "repos" / "work"
    (root / "work").mkdir(parents=True)
    (root / "work" / "a.ts").write_text("x")
    assert [r.rel_path for r in files.tree(spark, str(root)).collect()] == ["work/a.ts"]


def test_search_pages_and_waits():
    asked = []

    def get(url):
        asked.append(url)
        page = int(url.rsplit("page=", 1)[1])
        return {"items": [{"id": i} for i in range(100 if page < 3 else 40)] + ["odd"] * (page == 3)}

    assert len(list(remote.search("q", 1000, get))) == 240 and len(asked) == 3
    assert len(list(remote.search("q", 150, lambda url: {"items": [{}] * int(url.split("per_page=")[1].split("&")[0])}))) == 150
    assert list(remote.search("q", 10, lambda url: {})) == []
    slept, answers = [], [(403, {"x-ratelimit-reset": "130"}, b""), (200, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "90"}, b'{"a": 1}')]
    assert remote.get_json("u", lambda url, headers: answers.pop(0), slept.append, lambda: 100.0) == {"a": 1} and slept == [32, 1]
    with pytest.raises(OSError):
        remote.get_json("u", lambda url, headers: (500, {}, b""))

    def broken(url):
        raise OSError("down")

    assert remote.metadata("o", "n", broken) == {} and remote.metadata("o", "n", lambda url: {"stars": 1}) == {"stars": 1}


def test_search_over_queries(spark):
    find = lambda query, limit: iter([{"name": f"{query}{i}"} for i in range(2)])
    got = remote.searched(spark.createDataFrame([(0, "a"), (1, "b")], "ord long, query string"), 5, find).orderBy("ord", "item_order").collect()
    assert [(r.query, r.item_order, json.loads(r["item"])["name"]) for r in got] == [("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("b", 1, "b1")]


def test_token_only_from_the_environment(monkeypatch):
    monkeypatch.delenv("GITHUB_TOKEN", raising=False)
    assert remote.auth_header() == {}
    monkeypatch.setenv("GITHUB_TOKEN", "t")
    assert remote.auth_header() == {"Authorization": "Bearer t"}


def test_checkouts_stay_in_their_root(tmp_path):
    calls = []

    def run(command, folder=None):
        calls.append(command[0])
        return "abc"

    (tmp_path / "root" / "a" / ".git").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    assert remote.checkout("u", str(tmp_path / "root" / "a"), run) == "abc" and calls == ["fetch", "checkout", "rev-parse"]
    calls.clear()
    remote.checkout("u", str(tmp_path / "root" / "new"), run)
    assert calls == ["clone", "rev-parse"]
    assert not remote.clean_up(str(tmp_path / "out"), str(tmp_path / "root")) and (tmp_path / "out").exists()
    assert remote.clean_up(str(tmp_path / "root" / "a"), str(tmp_path / "root")) and not (tmp_path / "root" / "a").exists()
    error = subprocess.CalledProcessError(3, ["git", "clone"], output="", stderr=" no ")
    assert remote.failure_message(error) == "git clone: no"
    assert remote.failure_message(subprocess.CalledProcessError(3, ["git"])) == "git: exit code 3"
