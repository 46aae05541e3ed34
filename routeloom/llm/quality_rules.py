"""Quality rules with risk-controlled thresholds, with DataFrame operations only.

Base counts come from array functions over each whole text. A rule rejects
documents with a signal above its cutoff. PATH fixes joint settings of all
cutoffs beforehand, from the loosest to the strictest; each rejects whatever
the one before it rejects. They are chosen per stratum (language) on labelled
good documents that pass the base rules: the settings are tested in order,
each against the hypothesis that it rejects more than ``max_rejection`` of
good documents, with the exact binomial tail, and testing stops at the first
that is not significant. Within a stratum this fixed sequence needs no
correction and the bound holds for all signals together; across strata the
level is divided by their number (Bonferroni). The path is fixed beforehand,
so all labelled rows are a holdout; equal texts count as one trial. With
probability 1 - ``risk`` the settings reject at most ``max_rejection`` of the
good documents of every stratum that is tested alone.

A stratum with too few labels to pass even if nothing is rejected (fewer than
log(level) / log(1 - max_rejection)) is tested together with the others of
this kind, as one pooled stratum at the same level; the bound then holds for
their union. Where the pool is too small as well, and in strata without any
label, only the base rules reject.

Defined results: null or empty text has no words; a null language is a stratum
of its own; a doc_id that is labelled more than once counts by its lowest
quality; repeated rows are judged alike; values equal to a cutoff are kept; a
very long text is one row of arrays with an entry for each word, so it needs
memory of a few times its size; an empty table gives an empty result; other
columns are ignored. Three-word windows are compared by 64-bit hashes within
one document.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, settle

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MAX_REJECTION = 0.02
RISK = 0.05

#: Cutoffs of each signal, loosest first.
CUTOFFS: dict[str, list[float]] = {
    "symbols_per_word": [4.0, 2.0, 1.0, 0.5, 0.3, 0.2],
    "chars_per_word": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5],
}


#: Joint settings, from no cutoff at all: each adds one signal's next cutoff, in turn.
PATH: list[dict[str, float]] = []
for _step in range(max(map(len, CUTOFFS.values()))):
    for _name, _cutoffs in CUTOFFS.items():
        if _step < len(_cutoffs):
            PATH.append({**(PATH[-1] if PATH else {}), _name: _cutoffs[_step]})


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = docs.withColumn("_words", F.filter(F.split(t, WHITE), lambda w: w != ""))
    cut = cut.withColumn("_n", F.size("_words"))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_WHITE))
    windows = F.when(
        F.col("_n") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.col("_n") - 3),
            lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
        ),
    )
    cut = cut.select("*", F.array_sort(windows).alias("_windows"), lines.alias("_lines"))
    # Equal windows are neighbours after the sort.
    again = F.transform(
        F.filter("_windows", lambda w, k: (w["h"] == F.get("_windows", k - 1)["h"]) | (w["h"] == F.get("_windows", k + 1)["h"])),
        lambda w: w["i"],
    )
    cut = cut.withColumn("_starts", F.array_sort(again))
    # A window covers 3 words, or as many as come before the next window.
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return cut.select(
        *[F.col(c) for c in docs.columns],
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def signal(name: str) -> Column:
    over, under = {"symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed in logarithms, term by term."""
    first = n * math.log1p(-rate)
    odds = math.log(rate) - math.log1p(-rate)
    walk = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)")),
        F.struct(first.cast("double").alias("term"), first.cast("double").alias("total")),
        lambda a, i: _added(a["total"], a["term"] + F.log(((n - i + 1) / i).cast("double")) + odds),
        lambda a: F.exp(a["total"]),
    )
    return F.least(F.lit(1.0), walk)


def _added(total: Column, term: Column) -> Column:
    high, low = F.greatest(total, term), F.least(total, term)
    return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))


def risk_controlled_settings(good: DataFrame, stratum: str, max_rejection: float = MAX_REJECTION, risk: float = RISK) -> DataFrame:
    """Settings from labelled good documents: stratum, pooled, setting (number in PATH, -1: none), n_good, n_rejected (of the stratum or pool).

    ``good`` has a column for each signal of CUTOFFS.
    """
    names = [f"r{t}" for t in range(len(PATH))]
    over = [reduce(or_, [F.col(name) > cutoff for name, cutoff in setting.items()]) for setting in PATH]
    table = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n_good"), *[F.count_if(x).alias(n) for n, x in zip(names, over)])
    # One row for each stratum; their number fixes the level.
    strata = table.crossJoin(F.broadcast(table.agg((F.lit(risk) / F.count("*")).alias("level"))))
    strata = strata.withColumn("pooled", F.col("n_good") * math.log1p(-max_rejection) > F.log("level"))
    alone = F.when(~F.col("pooled"), F.col("stratum"))
    groups = strata.groupBy("pooled", alone.alias("alone")).agg(F.sum("n_good").alias("n_good"), F.first("level").alias("level"), *[F.sum(n).alias(n) for n in names])
    # More rejections than the allowed mean can't be significant; their tail needn't be summed.
    few = [F.when(F.col(n) <= F.col("n_good") * max_rejection, binomial_tail(F.col(n), F.col("n_good"), max_rejection)).otherwise(F.lit(1.0)) for n in names]
    failed = F.array_position(F.array(*[x > F.col("level") for x in few]), True)
    setting = F.when(failed > 0, failed - 2).otherwise(len(PATH) - 1).cast("int")
    rejected = F.when(F.col("setting") >= 0, F.get(F.array(*names), F.col("setting"))).otherwise(0)
    groups = groups.withColumn("setting", setting).select("pooled", "alone", "setting", "n_good", rejected.alias("n_rejected"))
    s, g = strata.select("stratum", "pooled", alone.alias("alone")).alias("s"), groups.alias("g")
    same = (F.col("s.pooled") == F.col("g.pooled")) & F.col("s.alone").eqNullSafe(F.col("g.alone"))
    return s.join(g, same).select("s.stratum", "s.pooled", "g.setting", "g.n_good", "g.n_rejected")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", max_rejection: float = MAX_REJECTION, risk: float = RISK) -> DataFrame:
    """``docs`` columns ``id_col`` and ``stratum`` with the base counts, base_failed and kept."""
    with Scratch(docs.sparkSession) as scratch:
        counted = base_counts(docs.select(id_col, stratum, "text"))
        counted = counted.withColumn("_same", F.xxhash64("text")).drop("text").withColumn("base_failed", base_failed())
        counted = scratch.write(counted.select("*", *[signal(name).alias(name) for name in CUTOFFS]), "counts")
        good = labels.groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)
        held = counted.where(~F.col("base_failed")).join(good, id_col).dropDuplicates([stratum, "_same"])
        chosen = risk_controlled_settings(held, stratum, max_rejection, risk)
        limits = F.array(*[F.struct(*[F.lit(setting.get(name, math.inf)).alias(name) for name in CUTOFFS]) for setting in PATH])
        # One row for each stratum; languages are few, and the join falls back to a shuffle if they aren't.
        limits = chosen.where("setting >= 0").select(F.col("stratum").alias("_stratum"), F.get(limits, F.col("setting")).alias("_limit"))
        judged = counted.join(limits, counted[stratum].eqNullSafe(F.col("_stratum")), "left")
        rejected = reduce(or_, [F.coalesce(F.col(name) > F.col("_limit")[name], F.lit(False)) for name in CUTOFFS], F.col("base_failed"))
        return settle(judged.withColumn("kept", ~rejected).drop("_stratum", "_limit", "_same"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = apply_quality_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
