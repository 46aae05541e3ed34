"""Concepts of a route and the interaction pattern of an evidence row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import has_any, tokens


def classify_route(method: Column, path: Column, codes: Column, text: Column, name: Column) -> Column:
    """Array of structs (concept, confidence, reason): at most one cancellation and one async row, first rule first."""
    lower = F.lower(path)
    every, in_path, in_name = tokens(F.concat(lower, F.lit(" "), F.lower(text))), tokens(lower), tokens(name)
    writes = method.isin("POST", "PUT", "PATCH", "DELETE")
    known = writes | (method == "GET")
    a, c = lambda x: has_any(x, R.ASYNC_NOUNS), lambda x: has_any(x, R.CANCEL_WORDS)
    status = has_any(every, R.STATUS_WORDS) | has_any(in_path, R.STATUS_WORDS)
    accepted = F.array_contains(codes, 202)

    def row(concept, confidence, reason):
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(concept).alias("concept"), confidence.alias("confidence"), F.lit(reason).alias("reason"))

    strong = F.when(method.isin("POST", "DELETE", "PATCH"), F.lit(0.96)).otherwise(F.lit(0.82))
    cancel = (
        F.when(c(in_path) & a(every) & known, row(R.CANCELLATION, strong, "cancel-word-with-async-resource"))
        .when(c(in_path) & known, row(R.CANCELLATION, 0.78, "cancel-word"))
        .when(c(in_name) & a(in_path) & writes, row(R.CANCELLATION, 0.70, "operation-name-cancel-on-async-resource"))
        .when((method == "DELETE") & has_any(in_path, R.CANCELABLE), row(R.CANCELLATION, 0.64, "delete-async-resource"))
    )
    makes = a(every) & (method == "POST") & ~has_any(in_path, R.QUERY_ACTIONS) & (a(in_path) | a(in_name) | accepted)
    asynchronous = (
        F.when(accepted & writes, row(R.ASYNC, 0.92, "accepted-response"))
        .when(makes, row(R.ASYNC, 0.78, "post-async-resource"))
        .when((method == "GET") & a(in_path) & status, row(R.ASYNC, 0.86, "status-resource"))
        .when((method == "GET") & a(in_path), row(R.ASYNC, 0.68, "get-async-resource"))
    )
    return F.array_compact(F.array(cancel, asynchronous))


def assign_pattern(concept: Column, method: Column, normalized: Column, path: Column, text: Column, codes: Column) -> Column:
    combined = tokens(F.concat_ws(" ", normalized, path, text))
    cancels, runs, status = has_any(combined, R.CANCEL_WORDS), has_any(combined, R.ASYNC_NOUNS), has_any(combined, R.STATUS_WORDS)
    in_path = has_any(tokens(F.concat_ws(" ", normalized, path)), R.CANCEL_WORDS)
    accepted = F.array_contains(codes, 202)
    is_cancel, is_async = concept == R.CANCELLATION, concept == R.ASYNC
    return (
        F.when(is_cancel & (method == "POST") & F.lower(normalized).rlike("/(cancel|abort|stop|terminate|kill)$"), F.lit("post-subresource-cancel"))
        .when(is_cancel & (method == "PUT") & cancels, F.lit("put-action-cancel"))
        .when(is_cancel & (method == "GET") & in_path, F.lit("get-cancel-link"))
        .when(is_cancel & (method == "POST") & cancels, F.lit("post-action-cancel"))
        .when(is_cancel & (method == "DELETE") & cancels, F.lit("delete-action-cancel"))
        .when(is_cancel & (method == "DELETE") & runs, F.lit("delete-operation-resource"))
        .when(is_cancel & (method == "PATCH") & cancels, F.lit("patch-state-cancelled"))
        .when(is_cancel, F.lit("other-cancellation-route"))
        .when(is_async & (method == "POST") & accepted, F.lit("post-202-accepted"))
        .when(is_async & (method == "POST") & runs, F.lit("post-job-resource"))
        .when(is_async & (method == "GET") & status, F.lit("get-status-resource"))
        .when(is_async & (method == "GET") & runs, F.lit("get-operation-resource"))
        .when(is_async & method.isin("PUT", "PATCH", "DELETE") & accepted, F.lit("mutation-202-accepted"))
        .when(is_async, F.lit("other-async-route"))
        .otherwise(F.lit("unclassified"))
    )
