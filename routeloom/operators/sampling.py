"""Frames, quotas, seeded draws and design weights for manual validation."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


ROUTE = ["repository", "method", "normalized_path"]


def primary_pattern(rows: DataFrame, order: list[str] = R.PRIMARY_ORDER, route: list[str] = ROUTE) -> DataFrame:
    """All rows of the first pattern, in ``order``, of each route; rows of other patterns go."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("pattern"))
    best = F.min("rank").over(Window.partitionBy(*route))
    return rows.where(F.col("pattern").isin(*order)).withColumn("rank", rank).withColumn("best", best).where("rank = best").drop("rank", "best")


def cells(linked: DataFrame) -> DataFrame:
    """Pattern x family cells with the bucket of each."""
    flags = linked.groupBy("pattern", "family_id").agg(F.count("*").alias("size"), F.bool_or("linked").alias("linked"), F.bool_or("operation_target").alias("target"), F.bool_or("risk").alias("risk"))
    return flags.withColumn("bucket", bucket_of(F.col("linked"), F.col("target"), F.col("risk")))


def bucket_of(linked: Column, target: Column, risk: Column) -> Column:
    return F.when(linked & risk, "mixed-same-resource-and-risk").when(linked, "same-resource-linked").when(target & risk, "mixed-operation-target-and-risk").when(target, "operation-like-target").when(risk, "domain-transition-risk").otherwise("other")


def shuffled(frame: DataFrame, stratum: Column, key: list[str], seed: str) -> DataFrame:
    """``frame`` with stratum, position (0-based, seeded order within the stratum) and stratum_size.

    Rows are sorted by ``key`` and shuffled by Python's generator seeded with
    the seed and the stratum, so a draw can be repeated anywhere. One stratum
    is shuffled in one task: only keys and ranks go there, not the rows.
    """
    ranked = frame.withColumn("stratum", stratum)
    ranked = ranked.withColumn("rank_", F.row_number().over(Window.partitionBy("stratum").orderBy(*key)) - 1)
    sizes = ranked.groupBy("stratum").agg(F.count("*").alias("stratum_size"))

    def draw(name: str | None, size: int) -> list[int]:
        order = list(range(size))
        random.Random(f"{seed}:{name}").shuffle(order)
        return order

    order = F.udf(draw, "array<int>")
    drawn = sizes.select("stratum", "stratum_size", F.posexplode(order("stratum", "stratum_size")).alias("position", "rank_"))
    drawn = drawn.select(F.col("stratum").alias("s_"), F.col("rank_").alias("r_"), "stratum_size", F.col("position").cast("long").alias("position"))
    return ranked.join(drawn, F.col("stratum").eqNullSafe(F.col("s_")) & (F.col("rank_") == F.col("r_"))).drop("s_", "r_", "rank_")


def drawn(frame: DataFrame, n: int | None) -> DataFrame:
    """The first n of each stratum (all without n) with inclusion fraction and weight N/n."""
    out = frame if n is None else frame.where(F.col("position") < n)
    taken = F.least(F.col("stratum_size"), F.lit(n)) if n is not None else F.col("stratum_size")
    return out.withColumn("fraction", taken / F.col("stratum_size")).withColumn("weight", F.col("stratum_size") / taken)


def family_inclusion(members: DataFrame, fractions: DataFrame) -> DataFrame:
    """Inclusion probability of each family over its patterns: 1 - prod(1 - f)."""
    rows = members.select("family_id", "pattern").distinct().join(fractions, "pattern")
    return rows.groupBy("family_id").agg((1 - F.product(1 - F.col("fraction"))).alias("probability"))


def quotas(total: int, buckets: list[str]) -> dict[str, int]:
    """Equal shares; the remainder goes to the first buckets."""
    base, extra = divmod(total, len(buckets))
    return {b: base + (i < extra) for i, b in enumerate(buckets)}


def quality() -> list:
    """The order of a cell's rows; rows without a line come last."""
    return ["repository", "method", "normalized_path", "path", "source_kind", F.coalesce("line", F.lit(1_000_000)), "file"]


def representatives(linked: DataFrame, seed: str) -> DataFrame:
    """One row of each pattern x family cell, drawn by Python's generator seeded with the cell's name.

    Rows are numbered in the order of ``quality``; ``linked`` may carry other columns.
    """
    cell = Window.partitionBy("pattern", "family_id")
    numbered = linked.withColumn("at_", F.row_number().over(cell.orderBy(*quality())) - 1).withColumn("cell_routes", F.count("*").over(cell))

    def pick(pattern: str, family: str, n: int) -> int:
        return random.Random(f"{seed}:cell-route:{pattern}:{family}").randrange(n)

    chosen = F.udf(pick, "int")("pattern", "family_id", "cell_routes")
    # Drawn once for each cell, not for each row.
    drawn = numbered.where("at_ = 0").select("pattern", "family_id", chosen.alias("at_"))
    return numbered.join(drawn, ["pattern", "family_id", "at_"]).drop("at_")


def delete_buckets(linked: DataFrame) -> DataFrame:
    """family_id, bucket of each family with DELETE resources: whether they are linked, and strict patterns link the family or the same target too."""
    strict = linked.where(F.col("strict") & F.col("linked"))
    own = linked.where(F.col("pattern") == R.DELETE_PATTERN).select("family_id", "target_path", "linked")
    targets = strict.select("family_id", "target_path").distinct().withColumn("same", F.lit(True))
    known = strict.select("family_id").distinct().withColumn("family", F.lit(True))
    rows = own.join(targets, ["family_id", "target_path"], "left").join(known, "family_id", "left")
    flags = rows.groupBy("family_id").agg(
        F.bool_or("linked").alias("linked"),
        F.bool_or(F.col("linked") & F.coalesce("same", F.lit(False))).alias("same"),
        F.bool_or(F.coalesce("family", F.lit(False))).alias("family"),
    )
    bucket = (
        F.when(~F.col("linked"), "delete-unlinked")
        .when(~F.col("family"), "delete-only-linked")
        .when(F.col("same"), "delete-and-strict-same-resource")
        .otherwise("delete-and-strict-different-resource")
    )
    return flags.select("family_id", bucket.alias("bucket"))


def cell_queue(linked: DataFrame, seed: str) -> DataFrame:
    """pattern, bucket, family_id, repository, position: the representatives in the seeded order of each pattern and bucket."""
    own = representatives(linked, seed).select("pattern", "family_id", "repository", "normalized_path", "method", "cell_routes")
    buckets = cells(linked).select("pattern", "family_id", F.col("bucket").alias("plain"))
    deletes = delete_buckets(linked).withColumn("pattern", F.lit(R.DELETE_PATTERN))
    rows = own.join(buckets, ["pattern", "family_id"]).join(deletes, ["pattern", "family_id"], "left")
    rows = rows.withColumn("bucket", F.coalesce("bucket", "plain")).drop("plain")
    return shuffled(rows, F.concat_ws(":", "pattern", "bucket"), ["family_id"], seed)


def plan_of(pattern: str, size: int, buckets: set[str]) -> tuple[list[tuple[str, int]], bool]:
    """Buckets with their quotas in order, and whether a shortfall is filled from the others."""
    if pattern == R.DELETE_PATTERN and size in R.DELETE_BUCKET_SIZES:
        return list(R.DELETE_BUCKET_SIZES[size].items()), False
    present = [b for b in R.BUCKETS if b in buckets]
    return (list(quotas(size, present).items()) if present else []), True


def select_cells(queue: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The cells that a greedy pass over the patterns takes, as nth (1-based), sample_id, pattern, bucket, family_id, repository.

    Each bucket fills its quota; then the buckets take turns until the size is
    reached. A repository gives at most PER_PATTERN_CAP rows to a pattern and
    TOTAL_CAP to all; a queue's entry that may not be taken is gone.

    The pass is sequential, so it runs in one task, on a bounded number of
    rows. A pattern has one row a family and a repository has one family, so
    only the total cap can refuse a row, each refusing repository has
    TOTAL_CAP of the rows taken, and it is refused once a pattern: of a queue
    no more than the size plus total / TOTAL_CAP entries are ever looked at.
    """
    total = sum(sizes.values())
    reach = F.lit(0)
    for pattern, size in sizes.items():
        reach = F.when(F.col("pattern") == pattern, F.lit(size + total // R.TOTAL_CAP + 1)).otherwise(reach)
    near = queue.where(F.col("position") < reach).select("pattern", "bucket", "family_id", "repository", "position")

    def take(rows):
        import pandas as pd

        in_pattern, in_all, taken = {}, {}, []
        for pattern, size in sizes.items():
            own = rows[rows["pattern"] == pattern].sort_values("position")
            queues = {b: iter(list(zip(g["family_id"], g["repository"]))) for b, g in own.groupby("bucket")}

            def following(bucket):
                for family, repository in queues.get(bucket, iter(())):
                    used, everywhere = in_pattern.get((pattern, repository), 0), in_all.get(repository, 0)
                    if used < R.PER_PATTERN_CAP and everywhere < R.TOTAL_CAP:
                        in_pattern[pattern, repository], in_all[repository] = used + 1, everywhere + 1
                        taken.append((pattern, bucket, family, repository))
                        return True
                return False

            plan, fills = plan_of(pattern, size, set(queues))
            before = len(taken)
            for bucket, quota in plan:
                while quota and following(bucket):
                    quota -= 1
            moved = fills
            while moved and len(taken) - before < size:
                moved = False
                for bucket, _ in plan:
                    if len(taken) - before < size and following(bucket):
                        moved = True
        out = pd.DataFrame(taken, columns=["pattern", "bucket", "family_id", "repository"])
        out.insert(0, "nth", range(1, len(out) + 1))
        return out

    picked = near.groupBy().applyInPandas(take, "nth long, pattern string, bucket string, family_id string, repository string")
    return picked.withColumn("sample_id", F.format_string("cancel-%04d", "nth"))


def expand_cells(selected: DataFrame, linked: DataFrame) -> DataFrame:
    """Every route of the selected cells, numbered within its cell."""
    rows = selected.select("sample_id", "pattern", "family_id", "bucket").join(linked.drop("bucket"), ["pattern", "family_id"])
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy(*quality()))
    return rows.withColumn("route_nth", nth).withColumn("route_sample_id", F.concat("sample_id", F.format_string("-route-%03d", nth)))


def route_stratum() -> Column:
    side = F.when(F.col("linked"), "linked").otherwise("unlinked")
    return F.concat("pattern", F.lit(":"), F.when(F.col("pattern") == "post-subresource-cancel", side).otherwise(F.lit("any")))


def route_sample(linked: DataFrame, seed: str, profile: str = "full") -> DataFrame:
    """Routes drawn by stratum with fraction and weight N/n; strata without a size are taken whole."""
    sizes = profile_of(R.ROUTE_SAMPLE_SIZES, profile)
    frame = shuffled(linked, route_stratum(), ["repository", "pattern", "normalized_path", "file", F.coalesce("line", F.lit(1_000_000)), "method", "source_kind"], f"{seed}:route-record")
    limits = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n).cast("long"))])
    frame = frame.where(F.col("stratum").isin(*sizes)).withColumn("taken", F.least("stratum_size", F.coalesce(F.element_at(limits, F.col("stratum")), F.col("stratum_size"))))
    frame = frame.where("position < taken").withColumn("fraction", F.col("taken") / F.col("stratum_size"))
    return frame.withColumn("weight", F.col("stratum_size") / F.col("taken")).drop("taken")


def family_sample(linked: DataFrame, seed: str, profile: str = "full") -> DataFrame:
    """Strict families drawn with equal chances; memberships are their strict patterns in order, weight N/n."""
    order = [p for p in R.SAMPLE_SIZES["full"] if p != R.DELETE_PATTERN]
    strict = linked.where(F.col("pattern").isin(*order)).groupBy("family_id").agg(F.collect_set("pattern").alias("found"))
    ordered = F.filter(F.array(*[F.lit(p) for p in order]), lambda p: F.array_contains(F.col("found"), p))
    strict = strict.select("family_id", F.array_join(ordered, ",").alias("memberships"))
    return drawn(shuffled(strict, F.lit("strict-cancellation-family"), ["family_id"], seed), profile_of(R.FAMILY_SAMPLE_SIZES, profile))


def pilot(selected: DataFrame, seed: int = R.PILOT_SEED) -> DataFrame:
    """The pilot's rows of each pattern; too few of one are an error."""
    sizes = F.create_map(*[x for p, n in R.PILOT_SIZES.items() for x in (F.lit(p), F.lit(n))])
    rows = shuffled(selected.where(F.col("pattern").isin(*R.PILOT_SIZES)), F.col("pattern"), ["sample_id"], f"{seed}:pilot")
    rows = rows.withColumn("need", F.element_at(sizes, F.col("pattern")))
    enough = F.when(F.col("stratum_size") < F.col("need"), F.raise_error(F.concat(F.lit("too few rows of "), "pattern")).cast("long")).otherwise(F.col("position"))
    return rows.where(enough < F.col("need")).drop("need", "stratum")


def profile_of(profiles: dict, name: str):
    if name not in profiles:
        raise ValueError(f"unknown profile {name!r}; one of {', '.join(profiles)}")
    return profiles[name]
