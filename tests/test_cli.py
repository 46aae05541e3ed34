import json

import pytest

from routeloom.__main__ import main
from routeloom.sources import files


def test_run_and_sample(spark, tmp_path):
    root, data = tmp_path / "files", str(tmp_path / "data")
    repos = []
    for i in range(3):
        folder = root / "org" / f"svc{i}"
        folder.mkdir(parents=True)
        (folder / "routes.ts").write_text(f"router.post('/jobs{i}', (q, r) => {{\n  r.status(202)\n}})\nrouter.post('/jobs/:id/cancel', (q, r) => {{\n  r.end()\n}})\nrouter.get('/jobs/:id/status', s)\n")
        repos.append({"repo_id": f"org/svc{i}", "owner": "org", "name": f"svc{i}"})
    (root / "org" / "svc0" / "openapi.json").write_text("{")
    repos.append({"repo_id": "org/none", "owner": "org", "name": "none"})
    listed = tmp_path / "repos.jsonl"
    listed.write_text("\n".join(map(json.dumps, repos)))
    main(["run", "--data", data, "--files", str(root), "--repositories", str(listed)])
    read = lambda name: spark.read.parquet(f"{data}/{name}")
    assert sorted((r["repository"], r["error"]) for r in read("errors").collect()) == [("org/none", "missing_checkout"), ("org/svc0", "unreadable")]
    assert {(r["concept"], r["families"]) for r in read("concepts").collect()} == {("http-cancellation", 3), ("http-async-operation", 3)}
    assert read("linkage").where("linked and pattern = 'post-subresource-cancel'").count() == 3
    text = "\n".join(r["value"] for r in spark.read.text(f"{data}/report").collect())
    assert "## http-cancellation" in text and "| post-subresource-cancel | 3 | 3 (100.0%)" in text
    for command, n in (("sample-cells", 3), ("sample-cell-routes", 3), ("sample-routes", 3), ("sample-families", 3)):
        main([command, "--data", data, "--profile", "minimum"])
        assert read(command).count() == n


    listing = next((tmp_path / "data" / "sample-cells.csv").glob("*.csv")).read_text().splitlines()
    assert listing[0].split(",")[:3] == ["sample_id", "route_id", "evidence_id"] and len(listing) == 4
    summary = json.loads((tmp_path / "data" / "sample-cells.summary.json").read_text())
    assert summary["sampleCount"] == 3 and len(summary["selectionProvenance"]["frameSnapshotHash"]) == 64
    main(["split-labels", "--data", data])
    labelling, machine = (files.read_csv(spark, f"{data}/{name}.csv") for name in ("labelling", "machine"))
    assert "pattern" not in labelling.columns and "linkageBucket" not in labelling.columns and "pattern" in machine.columns
    assert {r["label_taxonomy"] for r in labelling.collect()} == {"operation-vs-domain"} and labelling.count() == machine.count() == 3
    with pytest.raises(Exception, match="too few rows"):
        main(["pilot", "--data", data])
    assert read("review").where("section = 'evidence'").count() == 12 and read("review").where("section = 'error'").count() == 2
    assert len(list((tmp_path / "data" / "candidates").iterdir())) == 2


def test_discover_resumes_and_collect(spark, tmp_path):
    data, found = str(tmp_path / "data"), tmp_path / "found.jsonl"
    item = lambda name, **more: {"html_url": f"https://github.com/o/{name}", "name": name, "full_name": f"o/{name}", "description": "job queue server", "size": 5, "owner": {"login": "o"}, **more}
    rows = [("a", 0, 0, item("one")), ("a", 0, 1, item("two", fork=True)), ("b", 1, 0, item("one")), ("b", 1, 1, item("three")), ("c", 2, 0, item("four"))]
    found.write_text("\n".join(json.dumps({"query": q, "ord": o, "item_order": i, **x}) for q, o, i, x in rows))
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{data}/{name}").collect()]
    main(["discover", "--data", data, "--items", str(found), "--target", "2"])
    assert sorted(r["name"] for r in read("discovered")) == ["one", "three"]
    assert sorted((r["query"], r["new_repositories"]) for r in read("queries")) == [("a", 1), ("b", 1)]
    main(["discover", "--data", data, "--items", str(found), "--target", "9"])
    assert sorted(r["name"] for r in read("discovered")) == ["four", "one", "three"] and len(read("queries")) == 3
    seeds = tmp_path / "seeds.json"
    seeds.write_text(json.dumps({"repositories": ["https://github.com/o/one", {"url": "https://github.com/o/two.git", "stars": 0}, {"repository_url": "https://x.org/y", "owner": "p", "name": "q"}, "https://github.com/o/late"]}))
    known = tmp_path / "known.jsonl"
    known.write_text(json.dumps({"repo_id": "o/two", "stargazers_count": 7, "forks_count": 3, "license": {"key": "mit"}, "parent": "up/two"}))
    main(["collect", "--data", data, "--seeds", str(seeds), "--limit", "3", "--metadata", str(known)])
    got = {r["repo_id"]: r for r in read("repositories")}
    assert sorted(got) == ["o/one", "o/two", "p/q"]
    assert (got["o/two"]["stars"], got["o/two"]["forks"], got["o/two"]["license"], got["o/two"]["fork_parent"], got["o/two"]["probable_origin"]) == (0, 3, "mit", "up/two", "up/two")
    for bad in ('[{"name": "x"}]', '["https://example.org/a/b"]'):
        seeds.write_text(bad)
        with pytest.raises(Exception, match="seed item|repository address"):
            main(["collect", "--data", data, "--seeds", str(seeds)])


def test_missing_arguments(monkeypatch):
    for argv in (["run", "--data", "x"], ["run"], ["collect", "--data", "x"]):
        with pytest.raises(SystemExit):
            main(argv)
