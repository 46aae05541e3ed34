import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from routeloom.operators import evidence, incremental, sampling
from routeloom.plans.oracle import ORACLE_SQL
from routeloom.plans.queries import QUERIES
from routeloom.sources import extract, files
from routeloom.streaming.dedupe import process_new

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in os.listdir(DATA):
        own.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return own


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple("" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_dedupe_is_a_fold(spark):
    # The union of codes raises the bar, so the row of most codes doesn't win.
    base = ("r", "http-cancellation", "POST", "/a", "openapi", "/a", "s", 1, "f")
    made = [(1, [200, 201], 0.5), (2, [202], 0.5), (3, [200, 202], 0.9)]
    df = spark.createDataFrame([(*base, *m) for m in made], "repository string, concept string, method string, normalized_path string, source_kind string, path string, symbol string, line int, file string, ord int, codes array<int>, confidence double")
    out = evidence.deduplicated(df).first()
    assert (out["ord"], out["codes"], out["n_rows"]) == (2, [200, 201, 202], 3)


def test_shuffle_repeats_pythons(spark):
    import random

    frame = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(4)], "s string, k int")
    got = {(r["stratum"], r["k"]): r["position"] for r in sampling.shuffled(frame, F.col("s"), ["k"], "7").collect()}
    for name, n in (("a", 9), ("b", 4)):
        order = list(range(n))
        random.Random(f"7:{name}").shuffle(order)
        assert [got[name, k] for k in order] == list(range(n))


def test_quotas():
    assert sampling.quotas(7, ["x", "y", "z"]) == {"x": 3, "y": 2, "z": 2}


def test_pending(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "repo_id string")
    assert [r["repo_id"] for r in incremental.pending(seeds, seeds.where("repo_id = 'a'")).collect()] == ["b"]


def test_stream_is_idempotent(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    counts = []
    for batch in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)], None):
        if batch:
            spark.createDataFrame(batch, "k string, v int").write.mode("append").parquet(source)
        process_new(spark, source, "k string, v int", "k", out, state)
        counts.append(spark.read.parquet(out).count())
    assert counts == [2, 3, 3]


def test_extract(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.ts").write_text("x\nrouter.post('/jobs', h)\napp.get(\"/jobs/:id\", h)\n")
    (root / "b.py").write_text("@app.delete('tasks/{id}')\ndef f(): pass\n")
    (root / "api.json").write_text(json.dumps({"paths": {"/ops": {"post": {"operationId": "make", "responses": {"202": {}, "default": {}}}}}}))
    (root / "bad.json").write_text("{")
    (root / "node_modules" / "c.ts").write_text("app.get('/no', h)")
    tree = files.tree(spark, str(root))
    found = extract.extract(files.source_files(tree).unionByName(files.description_files(tree))).where("extractor <> 'error'").collect()
    assert sorted((r["rel_path"], r["method"], r["path"], r["line"]) for r in found) == [("a.ts", "GET", "/jobs/:id", 3), ("a.ts", "POST", "/jobs", 2), ("api.json", "POST", "/ops", 1), ("b.py", "DELETE", "/tasks/{id}", 1)]
    assert next(r["codes"] for r in found if r["rel_path"] == "api.json") == [202]


def test_jsonl(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    files.write_jsonl(spark.createDataFrame([(1,), (2,)], "a int"), str(tmp_path / "x"))
    assert files.read_jsonl(spark, str(tmp_path / "x"), "a int").count() == 2


def linked_rows(spark, n):
    """n families, each with a linked POST route, a risky one and a DELETE route; one repository each."""
    rows = []
    for i in range(n):
        for pattern, linked, risk, target in (("post-subresource-cancel", i % 2 == 0, i % 2 == 1, "/a"), ("delete-operation-resource", i % 3 > 0, False, "/a" if i % 2 else "/b"), ("put-action-cancel", False, True, "/a")):
            rows.append((f"f{i:03}", f"r{i:03}", pattern, "POST", f"/{pattern}/{i}", "source", target, "x", i, "f", linked, False, pattern != "delete-operation-resource", risk, "b"))
    return spark.createDataFrame(rows, "family_id string, repository string, pattern string, method string, normalized_path string, source_kind string, target_path string, path string, line int, file string, linked boolean, operation_target boolean, strict boolean, risk boolean, bucket string")


def test_greedy_selection_keeps_caps_and_seeded_order(spark):
    import random

    from routeloom.functions import rules as R

    # Families share few repositories here, so that the total cap refuses rows.
    linked = linked_rows(spark, 60).withColumn("repository", F.concat(F.lit("r"), (F.substring("family_id", 2, 3).cast("int") % 30).cast("string")))
    queue = sampling.cell_queue(linked, "5").withColumn("repository", F.when(F.col("repository") < "r2", "hot").otherwise(F.col("repository")))
    sizes = {"post-subresource-cancel": 9, "put-action-cancel": 4, "delete-operation-resource": 10}
    queues, rows = {}, queue.collect()
    for r in sorted(rows, key=lambda r: r["position"]):
        queues.setdefault((r["pattern"], r["bucket"]), []).append((r["family_id"], r["repository"]))
    families = {k: sorted(f for f, _ in v) for k, v in queues.items()}
    for (pattern, bucket), order in families.items():
        random.Random(f"5:{pattern}:{bucket}").shuffle(order)
        assert order == [f for f, _ in queues[pattern, bucket]]
    got = sampling.select_cells(queue, sizes).orderBy("nth").collect()
    per_repository, per_pattern = {}, {}
    for r in got:
        per_repository[r["repository"]] = per_repository.get(r["repository"], 0) + 1
        per_pattern[r["pattern"], r["repository"]] = per_pattern.get((r["pattern"], r["repository"]), 0) + 1
    assert max(per_repository.values()) <= R.TOTAL_CAP and max(per_pattern.values()) <= R.PER_PATTERN_CAP
    assert [r["sample_id"] for r in got] == [f"cancel-{i:04d}" for i in range(1, len(got) + 1)]
    deletes = [r["bucket"] for r in got if r["pattern"] == R.DELETE_PATTERN]
    assert deletes.count("delete-only-linked") <= 7 and "delete-unlinked" not in deletes


def test_expansion_numbers_every_route(spark):
    linked = linked_rows(spark, 6)
    twice = linked.unionByName(linked.withColumn("normalized_path", F.concat("normalized_path", F.lit("/x"))))
    picked = sampling.select_cells(sampling.cell_queue(twice, "1"), {"put-action-cancel": 2})
    ids = sorted(r["route_sample_id"] for r in sampling.expand_cells(picked, twice).collect())
    assert ids == [f"cancel-000{i}-route-00{j}" for i in (1, 2) for j in (1, 2)]


def test_pilot_needs_enough_rows(spark):
    rows = spark.createDataFrame([(f"s{i:03}", p) for p in ("delete-operation-resource", "post-subresource-cancel") for i in range(25)], "sample_id string, pattern string")
    assert sampling.pilot(rows).groupBy("pattern").count().where("count = 20").count() == 2
    with pytest.raises(Exception, match="too few rows"):
        sampling.pilot(rows.where("sample_id < 's010'")).collect()


def test_unknown_profile():
    with pytest.raises(ValueError, match="unknown profile"):
        sampling.profile_of({"full": 1}, "huge")


def test_empty_queue_selects_nothing(spark):
    assert sampling.select_cells(sampling.cell_queue(linked_rows(spark, 1).where("false"), "1"), {"put-action-cancel": 2}).count() == 0


def plain_selection(queues, sizes):
    """The greedy pass over whole queues, without the bound on what it looks at."""
    from collections import Counter, deque

    from routeloom.functions import rules as R

    waiting = {k: deque(v) for k, v in queues.items()}
    here, overall, out = Counter(), Counter(), []

    def pull(pattern, bucket):
        line = waiting.get((pattern, bucket), deque())
        while line:
            family, repository = line.popleft()
            if here[pattern, repository] < R.PER_PATTERN_CAP and overall[repository] < R.TOTAL_CAP:
                here[pattern, repository] += 1
                overall[repository] += 1
                return [(pattern, bucket, family, repository)]
        return []

    for pattern, size in sizes.items():
        if pattern == R.DELETE_PATTERN:
            for bucket, n in R.DELETE_BUCKET_SIZES[size].items():
                for _ in range(n):
                    out += pull(pattern, bucket)
            continue
        present = [b for b in R.BUCKETS if (pattern, b) in waiting]
        mine = []
        for b, n in sampling.quotas(size, present).items():
            for _ in range(n):
                mine += pull(pattern, b)
        while len(mine) < size:
            got = []
            for b in present:
                got += pull(pattern, b) if len(mine) + len(got) < size else []
            if not got:
                break
            mine += got
        out += mine
    return out


def test_selection_and_draws_equal_plain_python(spark):
    import random

    linked = linked_rows(spark, 60)
    queue = sampling.cell_queue(linked, "5")
    queues = {}
    for r in sorted(queue.collect(), key=lambda r: r["position"]):
        queues.setdefault((r["pattern"], r["bucket"]), []).append((r["family_id"], r["repository"]))
    for sizes in ({"post-subresource-cancel": 9, "put-action-cancel": 4, "delete-operation-resource": 10}, {"post-subresource-cancel": 70, "put-action-cancel": 3}):
        got = sampling.select_cells(queue, sizes).orderBy("nth").collect()
        assert [(r["pattern"], r["bucket"], r["family_id"], r["repository"]) for r in got] == plain_selection(queues, sizes)

    twice = linked.unionByName(linked.withColumn("normalized_path", F.concat("normalized_path", F.lit("/x"))))
    for r in sampling.representatives(twice, "5").collect():
        at = random.Random(f"5:cell-route:{r['pattern']}:{r['family_id']}").randrange(2)
        assert r["normalized_path"].endswith("/x") == (at == 1) and r["cell_routes"] == 2

    order = [f"f{i:03}" for i in range(60)]
    random.Random("5:strict-cancellation-family").shuffle(order)
    got = sampling.family_sample(linked, "5", "minimum").orderBy("position").collect()
    assert [r["family_id"] for r in got] == order and got[0]["weight"] == 1.0
    assert got[0]["memberships"] == "post-subresource-cancel,put-action-cancel"

    paths = [f"r{i:03}" for i in range(60)]
    random.Random("5:route-record:put-action-cancel:any").shuffle(paths)
    got = sampling.route_sample(linked, "5", "minimum").where("stratum = 'put-action-cancel:any'").orderBy("position").collect()
    assert [r["repository"] for r in got] == paths[:15] and got[0]["weight"] == 4.0
