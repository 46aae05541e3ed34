"""Report texts: one line per row, so a report of any number of concepts stays a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R



def percentage(n: Column, d: Column) -> Column:
    """Share of two counts as x.x%, exact ties to even, or n/a without a denominator."""
    whole, rest = F.floor(n * 1000 / d), (n * 1000) % d
    tenths = whole + F.when((rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1)), 1).otherwise(0)
    return F.when(d > 0, F.format_string("%d.%d%%", F.floor(tenths / 10), tenths % 10)).otherwise(F.lit("n/a"))


def sentences(*pairs: tuple[Column, str]) -> Column:
    """The sentences whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in pairs]))


def why_high() -> Column:
    said = sentences(
        (F.col("families") >= 5, R.FOR_FAMILIES),
        (F.col("patterns") >= 3, R.FOR_PATTERNS),
        (F.col("coverage").isin("none", "adjacent", "unknown"), R.FOR_GAP),
        *[(F.col("concept") == c, text) for c, text in R.FOR_CONCEPT.items()],
    )
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(R.FOR_NOTHING)))


def why_low() -> Column:
    return sentences(
        (F.col("families") < 5, R.LOW_FAMILIES),
        (F.col("patterns") <= 1, R.LOW_PATTERNS),
        (F.col("coverage").isin("full", "partial"), R.LOW_COVERED),
        (F.col("conflict"), R.LOW_CONFLICT),
    )


def counterarguments() -> Column:
    return sentences(
        *[(F.lit(True), text) for text in R.AGAINST_ALWAYS],
        (F.col("coverage") == "partial", R.AGAINST_PARTIAL),
        (F.col("vendors").between(1, 2), R.AGAINST_VENDORS),
        (F.col("concept") == R.CANCELLATION, R.AGAINST_CANCELLATION),
    )


def labelled(name: str, said: Column) -> Column:
    return F.transform(said, lambda x: F.concat(F.lit(f"- {name}: "), x))


def concept_lines(scored: DataFrame) -> DataFrame:
    """concept, nth, line of a report on concepts with metrics, vendors, coverage, conflict and score."""
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    ratio = lambda label, c: F.format_string(f"- {label}: %.4f", F.col(c))
    head = F.array(
        F.concat(F.lit("## "), F.col("concept")),
        count("Score", "score"),
        count("Families", "families"),
        count("Repositories", "repositories"),
        count("Patterns", "patterns"),
        count("Evidence", "evidence"),
        count("Evidence with at most 50 a repository", "capped"),
        ratio("Entropy", "entropy"),
        ratio("Dominant pattern", "dominant_ratio"),
        ratio("Patterns of one family", "long_tail_ratio"),
        ratio("Share of the largest repository", "top_repository_share"),
        F.concat(F.lit("- Coverage by standards: "), F.col("coverage")),
    )
    parts = [("For", why_high()), ("Low", why_low()), ("Against", counterarguments())]
    lines = F.concat(head, *[labelled(n, p) for n, p in parts])
    return scored.select("concept", F.posexplode(lines).alias("nth", "line")).withColumn("nth", F.col("nth").cast("long"))


def linkage_lines(totals: DataFrame) -> DataFrame:
    """pattern, line: a table row of ``linkage_totals`` with shares of families."""
    cells = [F.concat(F.col(f"{k}_families").cast("string"), F.lit(" ("), percentage(F.col(f"{k}_families"), F.col("all_families")), F.lit(")")) for k in ("linked", "target", "risk")]
    return totals.select("pattern", F.concat(F.lit("| "), F.array_join(F.array(F.col("pattern"), F.col("all_families").cast("string"), *cells), " | "), F.lit(" |")).alias("line"))


def linkage_ratios(totals: DataFrame, envelope: DataFrame, concepts: DataFrame) -> DataFrame:
    """nth, claim, numerator, population, denominator, share, use: shares of families that name their denominators, and the envelope's parts."""
    strict = totals.where("pattern = '(strict)'").agg(*[F.coalesce(F.first(f"{k}_families"), F.lit(0)).alias(k) for k in ("all", "linked", "target", "risk")])
    near = concepts.where(F.col("concept") == R.ASYNC).agg(F.coalesce(F.first("families"), F.lit(0)).alias("near"))
    one = strict.crossJoin(near).crossJoin(envelope)  # one row each

    def row(nth: int, claim: str, n: str, of: str, use: str) -> Column:
        d = F.col("near" if of.startswith("async") else "all")
        return F.struct(F.lit(nth).cast("long").alias("nth"), F.lit(claim).alias("claim"), F.col(n).alias("numerator"), F.lit(of).alias("population"), d.alias("denominator"), percentage(F.col(n), d).alias("share"), F.lit(use).alias("use"))

    rows = [row(i, *r) for i, r in enumerate(R.RATIO_CLAIMS)]
    rows += [row(len(rows) + i, claim, n, "async-operation families", use) for i, (claim, n, use) in enumerate(R.ENVELOPE_PARTS)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def review_lines(evidence: DataFrame, errors: DataFrame, n: int = 100) -> DataFrame:
    """section, nth, line: the first n evidence rows and the first n errors, to be ticked off; the limit is the feature."""
    code = lambda *cs: F.concat(F.lit("`"), *[c if isinstance(c, Column) else F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cs], F.lit("`"))
    space, colon = F.lit(" "), F.lit(":")
    said = F.concat(F.lit("- [ ] TP  [ ] FP  [ ] Unclassified — "), F.concat_ws(" ", code("concept"), code("pattern"), code("repository"), code("method", space, "path"), code("file", colon, "line")), F.lit(" confidence="), F.col("confidence").cast("string"))
    order = ["concept", "repository", "file", F.coalesce("line", F.lit(0)), "method", "normalized_path", "source_kind"]
    failed = F.concat(F.lit("- [ ] Review — "), F.concat_ws(" ", code("repo"), code("stage"), code("error_type")), F.lit(" retryable="), F.initcap(F.col("retryable").cast("string")), F.lit(": "), F.coalesce("error", F.lit("None")))
    parts = []
    for section, rows, line, by in (("evidence", evidence, said, order), ("error", errors, failed, ["repo", "stage", "error_type", "error"])):
        first = rows.orderBy(*by).limit(n).withColumn("nth", F.row_number().over(Window.orderBy(*by)).cast("long"))
        parts.append(first.select(F.lit(section).alias("section"), "nth", line.alias("line")))
    return parts[0].unionByName(parts[1])


def write_report(spark: SparkSession, path: str, scored: DataFrame, totals: DataFrame, ratios: DataFrame | None = None, candidates: str | None = None) -> None:
    """The report as one text file, and one file for each concept in ``candidates``. What is collected is a few lines a concept and one a pattern of the rules."""
    order = [r["concept"] for r in scored.orderBy(F.desc("score"), "concept").select("concept").collect()]
    found = {(r["concept"], r["nth"]): r["line"] for r in concept_lines(scored).collect()}
    text = ["# Concepts"] + [found[key] for concept in order for key in sorted(k for k in found if k[0] == concept)]
    text += ["## Linkage", "| Pattern | Families | Linked | Operation target | Risk |", "|-|-|-|-|-|"]
    text += [r["line"] for r in linkage_lines(totals).orderBy("pattern").collect()]
    if ratios is not None:
        text += ["### Denominator-Safe Ratios", "| Claim | Numerator | Denominator population | Denominator | Share | Safe use |", "|-|-|-|-|-|-|"]
        text += [f"| {r['claim']} | {r['numerator']} | {r['population']} | {r['denominator']} | {r['share']} | {r['use']} |" for r in ratios.orderBy("nth").collect()]
    for concept in order if candidates else []:
        own = "\n".join(found[key] for key in sorted(k for k in found if k[0] == concept))
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(f"{candidates}/{concept}")
    rows = spark.createDataFrame([("\n".join(text),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


