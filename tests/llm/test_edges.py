"""Empty tables, nulls and clashing columns; the pipeline over a small fixture."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeloom.llm.queries import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert run(spark, empty).count() == (1 if name.startswith("op1_") else 0)


@pytest.fixture(scope="module")
def odd(spark, corpus, tmp_path_factory):
    """Null values everywhere, and columns whose names operators use themselves."""
    folder = tmp_path_factory.mktemp("odd")
    docs = [(d, t, None if i % 5 == 0 else "en", None, None) for i, (d, t) in enumerate(corpus[::6] + corpus[400:416])]
    clash = {c: F.lit("mine") for c in ("run", "node", "rest", "score", "kept", "bucket", "salt", "_text", "predicted", "hash_", "evidence")}
    spark.createDataFrame(docs, TABLES["documents"]).withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, None, None), (6, None, 1), (1, 1, None)], TABLES["labels"]).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None, None), (1, "u", None)], TABLES["pages"]).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, corpus[6][1][:120])], TABLES["benchmark"]).write.parquet(f"{folder}/benchmark.parquet")
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "assistant", None), (1, 0, "assistant", None)]
    spark.createDataFrame(rows, TABLES["conversations"]).write.parquet(f"{folder}/conversations.parquet")
    return str(folder), len(docs)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_tables(spark, odd, name):
    folder, n = odd
    rows = QUERIES[name](spark, folder).collect()
    if name.startswith(("op2_", "op3_", "op4_", "op5_", "op9_", "op10_")):
        assert len(rows) == n
    if name.startswith("op7_"):
        assert 6 * 6 in [r.doc_id for r in rows] or any(r.item_id == 2 for r in rows)
    if name.startswith("op1_"):
        assert sorted((str(r.conv_id), r.n_turns) for r in rows) == [("-1", 2), ("1", 2), ("None", 2)]


def test_stages_keep_columns(spark, odd):
    folder, _ = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        assert out.count() <= docs.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_near_duplicates_leave_one_of_each_group(spark, corpus, documents):
    from test_dedup import jaccard

    groups = {}
    for (doc, _), (_, n, component) in zip(corpus, jaccard(corpus)):
        if n and doc is not None:
            groups.setdefault(component, set()).add(doc)
    out = corpus_pipeline.near_duplicates(spark, documents, "")
    kept = [r.doc_id for r in out.collect() if r.doc_id is not None and (r.text or "").split()]
    assert sorted(kept) == sorted(groups)
