"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two interpolated models with modified Kneser-Ney discounts (one each for
grams counted once, twice, and more often), one of toxic and one of ordinary
text, give each word (lower-cased, with boundaries) a log-likelihood ratio.
The highest order is counted per class; both classes back off to the same
lower orders, so expressions that neither class has seen often cancel out. The
lower orders are continuation counts (how many letters precede a gram) over
the distinct grams of all documents, made in distributed tables; below the
lowest, letters are alike. Class counts are counts of documents, so one text
that repeats an expression counts once. Toxic text is ordinary text with a
share ``mix`` of toxic expressions: a word's ratio r becomes
log(1 - mix + mix * exp(r)). A document's evidence is the mean of that over
its distinct words, with ``prior`` neutral words added; a logistic curve over
its logarithm, fitted on other labelled rows, turns it into the score.

Rows with crc32(doc_id) mod 3 = 0 train the class counts; on those with 2
``mix`` and ``prior`` are chosen from CHOICES by two-fold cross-validation, and
the curve is fitted; those with 1 are held out, and their labels are never
read. Each class of each fit uses at most ``max_docs`` documents, those with
the smallest hash of their id (weighed by how common the class is). Where
neither class has seen a letter's context in the highest order, both classes
give it the same probability and the ratio is 0; so the model that is
broadcast needs the lower orders of the sample's contexts only, with their
counts over all documents: its size is bounded by the sample's.

Letters are those of the training sample, whatever their script, the most
frequent LETTERS of them; all others are one further letter.

Defined results: null or empty text has no evidence and gets the score of
evidence 0; a doc_id labelled more than once counts as toxic if any label says
so; without labels of both classes every score is 0; repeated rows are scored
alike, ties need no order; a very long text is scored whole, by one task; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._common import Scratch, as_bytes, settle

LOW, HIGH = 3, 6
#: 6 letters of so many codes are exact in 63 bits: 1 is the boundary, 2 any letter that the sample hasn't.
CODES = 1448
BOUNDARY, OTHER = 1, 2
LETTERS = CODES - 3
#: (mix, prior) to choose from.
CHOICES = [(mix, prior) for mix in (0.02, 0.005, 0.001) for prior in (5.0, 20.0, 50.0)]
#: Added to the evidence above its least value before its logarithm is taken.
TINY = 1e-7
MAX_DOCS = 4096
THRESHOLD = 0.7
CACHE = 300_000
#: Words whose grams are made at a time, and documents whose words are looked up together.
SLICE, BLOCK = 50_000, 1024
#: Kinds of rows: distinct n-grams of order HIGH of all documents, by bucket; 0 and 1 are the classes.
EVERY = 2


def letter_table(letters: list[str]) -> np.ndarray:
    """The code of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.int16)
    for code, letter in enumerate(letters[:LETTERS], OTHER + 1):
        out[ord(letter)] = code
    out[ord(" ")] = BOUNDARY
    return out


def grams(words: list[str], order: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each letter of each word (and its end), and the word of each.

    The first letters of a word have 1 to order-1 boundary marks before them.
    """
    pad = " " * (order - 1)
    points = np.frombuffer("".join([f"{pad}{w} " for w in words]).encode("utf-32-le"), dtype=np.uint32)
    codes = table[points].astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + order
    n = len(codes) - order + 1
    key = np.zeros(max(n, 0), dtype=np.int64)
    for i in range(order):
        key = key * CODES + codes[i : i + n]
    word = np.repeat(np.arange(len(words)), sizes)
    # The gram that ends at letter j starts at j - order + 1; those that start in the last order-1 places run into the next word.
    within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = (within <= np.repeat(sizes, sizes) - order)[: max(n, 0)]
    return key[keep], word[: max(n, 0)][keep]


@dataclass
class Model:
    """Sorted n-gram keys with what their order adds, for each class, and the weight of backing off."""

    table: np.ndarray
    keys: dict[int, np.ndarray]
    discounted: dict[int, np.ndarray]  # (2, n), or (1, n) for both classes: share of the context, after the discount
    contexts: dict[int, np.ndarray]
    backoff: dict[int, np.ndarray]  # (2, n) or (1, n): weight of the next lower order

    def ratios(self, words: list[str]) -> np.ndarray:
        """log p(toxic) - log p(ordinary) of each word, summed over its letters."""
        if not words or not len(self.keys[HIGH]):
            return np.zeros(len(words))
        top, word = grams(words, HIGH, self.table)
        # Each order's distinct grams, and where the next higher order's are among them: look-ups go in order.
        levels = [np.unique(top, return_inverse=True)]
        for order in range(HIGH - 1, LOW - 1, -1):
            levels.append(np.unique(levels[-1][0] % CODES**order, return_inverse=True))
        p = np.full((2, 1), 1.0 / CODES)
        for order in range(LOW, HIGH + 1):
            key = levels[HIGH - order][0]
            below = levels[HIGH - order + 1][1] if order > LOW else np.zeros(len(key), dtype=np.int64)
            at, found = lookup(self.contexts[order], key // CODES)
            weight = np.where(found, self.backoff[order][:, at], 1.0) if len(self.contexts[order]) else 1.0
            own, there = lookup(self.keys[order], key)
            added = np.where(there, self.discounted[order][:, own], 0.0) if len(self.keys[order]) else 0.0
            p = added + weight * p[:, below]
        per_gram = np.log(p[1]) - np.log(p[0])
        return np.bincount(word, weights=per_gram[levels[0][1]], minlength=len(words))


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from grams counted 0, 1, 2 and 3 or more times, from how many are counted 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, y, y, y])
    own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip([0.0, *own], 0.0, [0.0, 1.0, 2.0, 3.0])


def kneser_ney(table: np.ndarray, top: tuple[np.ndarray, np.ndarray], middle: dict[int, tuple[np.ndarray, np.ndarray, tuple[int, ...]]]) -> Model:
    """Model from the highest order (keys, (2, n) class counts) and those below (keys, continuation counts, how many are counted 1 to 4 times)."""
    model = Model(table, {}, {}, {}, {})
    for order in range(HIGH, LOW - 1, -1):
        if order == HIGH:
            keys, own = top
            often = [tuple(int((row == k).sum()) for k in (1, 2, 3, 4)) for row in own]
        else:
            keys, n, counted = middle[order]
            own, often = n[None, :], [counted]
        contexts, inverse = np.unique(keys // CODES, return_inverse=True)
        discounted, backoff = np.zeros(own.shape), np.ones((len(own), len(contexts)))
        for c, counted in enumerate(often):
            taken = discounts(*counted)[np.minimum(own[c], 3)]
            size = np.bincount(inverse, weights=own[c], minlength=len(contexts))
            seen, there = size > 0, own[c] > 0
            discounted[c][there] = np.maximum(own[c][there] - taken[there], 0.0) / size[inverse][there]
            backoff[c][seen] = 1 - np.bincount(inverse, weights=discounted[c], minlength=len(contexts))[seen]
        model.keys[order], model.discounted[order] = keys, discounted
        model.contexts[order], model.backoff[order] = contexts, backoff
    return model


def words_of(text: bytes) -> list[str]:
    return text.decode("utf-8").lower().split()


def fold() -> "F.Column":
    """crc32 of the id's decimal text, mod 3: 0 trains, 2 calibrates, 1 is held out."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3


def bounded_labels(labels: DataFrame, remainder: int, max_docs: int) -> tuple[dict[int, int], np.ndarray]:
    """doc_id to label for at most ``max_docs`` documents a class, and how many labelled documents each stands for."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() == remainder))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    sizes = [min(max_docs, there.get(label, 0)) for label in (0, 1)]
    out: dict[int, int] = {}
    for label in (0, 1):
        first = own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sizes[label])
        out |= {r["doc_id"]: label for r in first.select("doc_id").collect()}
    return out, np.array([there.get(label, 0) / max(1, sizes[label]) for label in (0, 1)])


def of_sample(docs: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of a bounded number of documents; only their texts are looked at further."""
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id", "left_semi")  # at most 2 * max_docs ids


def sample_letters(docs: DataFrame, chosen: dict[int, int]) -> list[str]:
    """The letters of the sample's texts, those in most documents first."""
    letters = of_sample(docs, list(chosen)).select(F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), ""))).alias("letter"))
    counts = letters.where("letter not in ('', ' ')").groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(LETTERS)
    return [r["letter"] for r in counts.collect() if len(r["letter"]) == 1]


def gram_rows(docs: DataFrame, chosen: dict[int, int], table: np.ndarray, buckets: int) -> DataFrame:
    """Counts of order HIGH of each class of the chosen documents (kinds 0 and 1); distinct grams of order HIGH of all by bucket (kind EVERY)."""
    held_table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        codes = held_table.value
        seen: set[str] = set()
        by_class: tuple[Counter, Counter] = (Counter(), Counter())
        tables: dict[int, list] = {}

        def flush(counter, kind):
            if counter:
                words, n = list(counter), np.fromiter(counter.values(), dtype=np.int64, count=len(counter))
                key, word = grams(words, HIGH, codes)
                tables.setdefault(kind, []).append(totals(key, n[word]))
                counter.clear()

        def distinct(words):
            key = np.unique(np.concatenate([np.unique(grams(words[i : i + SLICE], HIGH, codes)[0]) for i in range(0, len(words), SLICE)]))
            # Grams with the same last LOW+1 letters meet, so that both higher continuation counts can be made there.
            mixed = (key % CODES ** (LOW + 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, bucket = key[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for i in np.flatnonzero(ends[1:] > ends[:-1]):
                yield rows(EVERY, [int(i)], [0], [0], [key[ends[i] : ends[i + 1]].tobytes()])

        def rows(kind, size, gram, n, held):
            columns = [pa.array([kind] * len(size), pa.int32()), pa.array(size, pa.int32()), pa.array(gram, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["kind", "size", "gram", "n", "held"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                own = set(words_of(text))
                seen |= own
                if doc in chosen:
                    by_class[chosen[doc]].update(own)
                if len(seen) > CACHE:
                    yield from distinct(list(seen))
                    seen.clear()
                for label in (0, 1):
                    if len(by_class[label]) > CACHE:
                        flush(by_class[label], label)
        if seen:
            yield from distinct(list(seen))
        flush(by_class[0], 0)
        flush(by_class[1], 1)
        for kind, parts in tables.items():
            key, n = totals(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for i in range(0, len(key), 100_000):
                k = key[i : i + 100_000]
                yield rows(kind, np.full(len(k), HIGH), k, n[i : i + 100_000], [None] * len(k))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "kind int, size int, gram long, n long, held binary")


def continuations(scratch: Scratch, rows: DataFrame, contexts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """For each order below HIGH: grams, continuation counts, and how many grams of the whole corpus are counted 1 to 4 times.

    Only grams whose context ends one of ``contexts`` (of order HIGH) are
    returned, with all the letters that follow there; the counts are over the
    distinct grams of all documents.
    """
    needed = {order: np.unique(contexts % CODES ** (order - 1)) for order in range(LOW, HIGH)}
    held = rows.sparkSession.sparkContext.broadcast(needed)
    schema = "size int, gram long, n long"

    def batch_of(order, gram, n):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([order] * len(gram), pa.int32()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["size", "gram", "n"])

    def run(batches):
        def count(parts):
            key = np.unique(np.concatenate(parts))
            for order in range(HIGH - 1, LOW, -1):
                key, n = np.unique(key % CODES**order, return_counts=True)
                _, there = lookup(held.value[order], key // CODES)
                # Rows with negative grams say how many grams are counted 1 to 4 times.
                yield batch_of(order, np.concatenate([key[there], [-1, -2, -3, -4]]), np.concatenate([n[there], [(n == k).sum() for k in (1, 2, 3, 4)]]))
            # Of the lowest order each bucket has a part of the count.
            yield batch_of(LOW, *np.unique(key % CODES**LOW, return_counts=True))

        bucket, parts = None, []
        for batch in batches:
            for b, grams_there in zip(batch.column("size").to_pylist(), batch.column("held").to_pylist()):
                if b != bucket:
                    if parts:
                        yield from count(parts)
                    bucket, parts = b, []
                parts.append(np.frombuffer(grams_there, dtype=np.int64))
        if parts:
            yield from count(parts)

    def in_context(batches):
        for batch in batches:
            gram, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            _, there = lookup(held.value[LOW], gram // CODES)
            yield batch_of(LOW, gram[there], n[there])

    every = rows.where(F.col("kind") == EVERY).select("size", "held").repartition("size").sortWithinPartitions("size")
    counted = scratch.write(every.mapInArrow(run, schema), "continuations")
    lowest = counted.where(F.col("size") == LOW).groupBy("size", "gram").agg(F.sum("n").alias("n"))
    often = lowest.where("n <= 4").groupBy("size", (-F.col("n")).alias("gram")).agg(F.count("*").alias("n"))
    # What comes to the driver is bounded by the sample: its contexts with the letters that follow there.
    kept = counted.where(F.col("size") > LOW).unionByName(lowest.mapInArrow(in_context, schema)).unionByName(often)
    rows_here = kept.groupBy("size", "gram").agg(F.sum("n").alias("n")).toArrow()
    size, gram, n = (rows_here[c].to_numpy() for c in ("size", "gram", "n"))
    out = {}
    for order in needed:
        keys, counts = gram[(size == order) & (gram >= 0)], n[(size == order) & (gram >= 0)]
        at = np.argsort(keys)
        out[order] = (keys[at], counts[at], tuple(int(n[(size == order) & (gram == -k)].sum()) for k in (1, 2, 3, 4)))
    return out


def gram_counts(docs: DataFrame, chosen: dict[int, int], table: np.ndarray) -> tuple[tuple, dict]:
    """Class counts of order HIGH from the chosen documents; continuation counts of the orders below over all documents."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.write(gram_rows(docs, chosen, table, int(spark.conf.get("spark.sql.shuffle.partitions"))), "grams")
        # N-grams of a bounded sample.
        own_rows = rows.where(F.col("kind") != EVERY).groupBy("kind", "gram").agg(F.sum("n").alias("n")).toArrow()
        kind, gram, n = (own_rows[c].to_numpy() for c in ("kind", "gram", "n"))
        sides = []
        for k in (0, 1):
            at = np.argsort(gram[kind == k])
            sides.append((gram[kind == k][at], n[kind == k][at]))
        keys = np.union1d(sides[0][0], sides[1][0])
        own = np.zeros((2, len(keys)), dtype=np.int64)
        for c, (g, m) in enumerate(sides):
            own[c, np.searchsorted(keys, g)] = m
        return (keys, own), continuations(scratch, rows, np.unique(keys // CODES))


def totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.argsort(key, kind="stable")
    key, n = key[at], n[at]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def evidence(docs: DataFrame, model, choices: list[tuple[float, float]], carry: list[str] | None = None) -> DataFrame:
    """record (struct of ``carry``, doc_id by default) and evidence (the length-normalised ratio, one for each (mix, prior) of ``choices``) of every document."""
    carry = carry or ["doc_id"]

    def run(batches):
        import pyarrow as pa

        model_here, known = Model(**model.value), {}
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            out = []
            for i in range(0, len(texts), BLOCK):
                part = [set(words_of(t)) for t in texts[i : i + BLOCK]]
                if len(known) > CACHE:
                    known.clear()
                new = [w for w in set().union(*part) if w not in known]
                for j in range(0, len(new), SLICE):
                    known.update(zip(new[j : j + SLICE], model_here.ratios(new[j : j + SLICE]).tolist()))
                for words in part:
                    # In order, so that sums don't depend on how a set is laid out.
                    ratio = np.sort(np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words)))
                    odds = np.expm1(np.minimum(ratio, 50.0))
                    out.append([float(np.log1p(mix * odds).sum()) / (len(words) + prior) for mix, prior in choices])
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(out, pa.list_(pa.float64()))], ["record", "evidence"])

    source = docs.select(F.struct(*carry).alias("record"), F.col("text").cast("string").alias("text"))
    schema = StructType([source.schema["record"], StructField("evidence", ArrayType(DoubleType()))])
    return source.mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over weighted rows, by Newton's method with a little shrinkage."""
    middle, spread = x.mean(), x.std() or 1.0
    a = np.stack([(x - middle) / spread, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    shrink = np.array([1e-2, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + shrink * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(shrink), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def log_evidence(x: np.ndarray, mix: float) -> np.ndarray:
    return np.log(np.maximum(x - np.log1p(-mix), 0.0) + TINY)


def chosen_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[int, float, float]:
    """The choice with the least log loss on the other fold, and its curve over both; ``x``: rows by choices."""
    losses = []
    for c, (mix, _) in enumerate(CHOICES):
        z, loss = log_evidence(x[:, c], mix), 0.0
        for f in (0, 1):
            fit, rest = fold != f, fold == f
            if not 0 < y[fit].sum() < fit.sum():
                continue
            slope, intercept = logistic(z[fit], y[fit], weight[fit])
            p = np.clip(1 / (1 + np.exp(-np.clip(slope * z[rest] + intercept, -30, 30))), 1e-9, 1 - 1e-9)
            loss -= float((weight[rest] * (y[rest] * np.log(p) + (1 - y[rest]) * np.log(1 - p))).sum())
        losses.append(loss)
    best = int(np.argmin(losses))
    return best, *logistic(log_evidence(x[:, best], CHOICES[best][0]), y, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """record (struct of ``carry``, doc_id by default), score (0 to 1) and predicted (score >= ``threshold``) of every row of ``docs``."""
    spark = docs.sparkSession
    train, _ = bounded_labels(labels, 0, max_docs)
    tune, stands_for = bounded_labels(labels, 2, max_docs)
    table = letter_table(sample_letters(docs, train))
    model = spark.sparkContext.broadcast(vars(kneser_ney(table, *gram_counts(docs, train, table))))
    rows = evidence(of_sample(docs.select("doc_id", "text"), list(tune)), model, CHOICES).select("record.doc_id", "evidence").toArrow()
    ids = rows["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    x = np.array(rows["evidence"].to_pylist(), dtype=float).reshape(len(ids), len(CHOICES))[order]
    y = np.array([tune[ids[i]] for i in order], dtype=float)
    best, slope, intercept = 0, 0.0, -30.0
    if 0 < y.sum() < len(y):
        fold = np.array([ids[i] * 0x9E3779B97F4A7C15 >> 40 & 1 for i in order])
        best, slope, intercept = chosen_curve(x, y, stands_for[y.astype(int)], fold)
    mix = CHOICES[best][0]
    z = F.log(F.greatest(F.col("evidence")[0] - float(np.log1p(-mix)), F.lit(0.0)) + TINY)
    out = evidence(docs, model, [CHOICES[best]], carry=carry).withColumn("score", 1 / (1 + F.exp(-(z * slope + intercept))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("evidence")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels)
    return settle(scored.select("record.doc_id", "score", "predicted").select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted"))
