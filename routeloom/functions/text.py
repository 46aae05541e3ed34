"""Scalar functions over paths, names and codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(value: Column) -> Column:
    """Distinct lower-case tokens; camelCase is split."""
    spaced = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != ""))


def has_any(found: Column, words: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))


def normalize_path(path: Column) -> Column:
    """Path with every parameter as {var}, without query and trailing slash."""
    p = F.trim(F.substring_index(path, "?", 1))
    p = F.when(p == "", F.lit("/")).otherwise(p)
    for pattern in (r"<(?:[^:<>]+:)?[^<>]+>", r"\{[^}/]+\}", r":([A-Za-z_][A-Za-z0-9_]*)", r"\([^/]+\)"):
        p = F.regexp_replace(p, pattern, "{var}")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def joined(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def canonical_path(path: Column) -> Column:
    p = F.regexp_replace(F.trim(path), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def cancel_target_path(path: Column) -> Column:
    """The path without a last segment that names a cancelling action."""
    own = segments(canonical_path(path))
    last = tokens(F.element_at(own, -1))
    acts = F.exists(last, lambda t: t.rlike("^(cancel|abort|stop|terminate|kill)"))
    return F.when((F.size(own) > 0) & acts, joined(F.slice(own, 1, F.size(own) - 1))).otherwise(canonical_path(path))


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, null as empty, with unit separators."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x1f"), 256)


def signature(values: Column) -> Column:
    """First 16 hex digits over sorted distinct values; empty for none."""
    text = F.array_join(F.array_sort(F.array_distinct(values)), "\n")
    return F.when(F.size(values) > 0, F.substring(F.sha2(text, 256), 1, 16)).otherwise(F.lit(""))


def entropy(counts: Column, kinds: Column) -> Column:
    """Normalised entropy of an array of counts: 0 for fewer than two kinds."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(F.lit(0.0)))
    return F.when((kinds > 1) & (total > 0), h / F.log(kinds.cast("double"))).otherwise(F.lit(0.0))


def first_marker(text: Column, markers: list[str], default: Column) -> Column:
    """The first marker, in order, that the text contains."""
    out = None
    for m in markers:
        out = F.when(text.contains(m), F.lit(m)) if out is None else out.when(text.contains(m), F.lit(m))
    return out.otherwise(default)


def template_of(owner: Column, name: Column) -> Column:
    full = F.lower(F.concat(owner, F.lit("/"), name))
    named = F.lit(False)
    for word in ("template", "starter", "scaffold", "example", "demo", "sample"):
        named = named | full.contains(word)
    return F.when(named, F.lit("name-indicator")).when(full.endswith("-sdk") | full.contains("/sdk-"), F.lit("generated-sdk-suspect"))


def response_codes(text: Column) -> Column:
    """Sorted distinct response codes that a source text names."""
    accepted = text.rlike(r"\b(?:HTTP_)?202(?:_ACCEPTED)?\b|Status202Accepted|StatusAccepted|http\.StatusAccepted")
    named = F.regexp_extract_all(text, F.lit(r"\b(?:status|code|writeHead|sendStatus)\s*\(?\s*([1-5][0-9]{2})\b"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"\b([1-5][0-9]{2})\b"), F.lit(1))
    listed = F.filter(bare, lambda c: c.isin("200", "201", "202", "204", "400", "404", "409", "422", "429", "500", "503"))
    found = F.concat(F.when(accepted, F.array(F.lit("202"))).otherwise(F.expr("cast(array() as array<string>)")), named, listed)
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: c.cast("int"))))


def float_text(x: Column) -> Column:
    return F.format_string("%.6f", x)


def ratio_text(n: Column, d: Column) -> Column:
    """Six decimals; empty without a denominator."""
    return F.when(d > 0, float_text(n / d)).otherwise(F.lit(""))


def safe_int(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("int"), F.lit(1_000_000))


def safe_float(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))


def clean_codes(codes: Column) -> Column:
    """Sorted distinct integers of an array of texts; what is none is left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.trim(c).try_cast("int")))))


def source_kind(extractor: Column) -> Column:
    name = F.lower(F.coalesce(extractor, F.lit("")))
    return F.when(name.startswith("openapi"), "openapi").when(name == "source-routes", "source").otherwise(name)


def utc_now() -> Column:
    return F.expr("date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")")
