import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as T
from routeloom.functions.classify import classify_route


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, expected",
    [("/op/{id}:cancel", "/op/{var}{var}"), ("/jobs/${id}", "/jobs/${var}"), ("//", "/"), ("", "/"), ("/a/<int:id>/?q=1", "/a/{var}"), ("/a/(.+)/b/", "/a/{var}/b")],
)
def test_normalize_path(spark, path, expected):
    assert one(spark, T.normalize_path(F.col("p")), p=path) == expected


def test_tokens_split_camel_case(spark):
    assert sorted(one(spark, T.tokens(F.col("p")), p="cancelJob /Jobs/2x")) == ["2x", "cancel", "job", "jobs"]


def test_cancel_target(spark):
    assert one(spark, T.cancel_target_path(F.col("p")), p="/jobs/{var}/cancel") == "/jobs/{var}"
    assert one(spark, T.cancel_target_path(F.col("p")), p="/jobs/{var}") == "/jobs/{var}"


def test_response_codes(spark):
    assert one(spark, T.response_codes(F.col("p")), p="return StatusAccepted; status(418) or 404, 999") == [202, 404, 418]


def test_signature_of_nothing(spark):
    assert one(spark, T.signature(F.expr("cast(array() as array<string>)")), p=1) == ""


def test_classify_reasons(spark):
    rows = [("POST", "/jobs/{id}/cancel", [200], ""), ("DELETE", "/tasks/{id}", [200], ""), ("GET", "/jobs/1/status", [200], ""), ("GET", "/health", [200], "")]
    df = spark.createDataFrame(rows, "m string, p string, c array<int>, t string")
    got = [sorted(x["reason"] for x in r["r"]) for r in df.select(classify_route(F.col("m"), F.col("p"), F.col("c"), F.col("t"), F.col("t")).alias("r")).collect()]
    assert got == [["cancel-word-with-async-resource", "post-async-resource"], ["delete-async-resource"], ["status-resource"], []]
