"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = floor(m * error_rate) edits.
Split into k+1 pieces, at least one piece occurs unchanged; an Aho-Corasick
automaton finds all piece hits in one pass over a text, and each hit is
verified with Myers' bit-parallel distance on the window that the item would
fill. Items and texts are compared with A-Z lower-cased and white space runs
as one space.

The items are a stated query set: they are taken in blocks of at most
``block_bytes`` and each block is broadcast and run against all documents.

Defined results: null or empty texts and items match nothing; an item too
short to allow an edit (the budget is 0 below 1 / error_rate characters) says
little about a text that merely holds it, so it matches only a text that is
the item as a whole, and a warning tells how many such items there are; items
that repeat are reported each; a document is reported once per item, with its
closest place (the first of equals); repeated rows are reported each; a very
long text is searched whole, in one task; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, settle

ERROR_RATE = 0.08
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, distance int, match_start int, match_end int"


def normalise(text: bytes) -> str:
    return b" ".join(text.lower().split()).decode("utf-8")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 near-equal parts with their places."""
    n = budget + 1
    edges = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and where that part ends.

    ``pattern`` has, for each character, the bits of its places.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, char in enumerate(text, 1):
        eq = pattern.get(char, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up) & full, up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | ~(xv | plus) & full, plus & xv
        if score < best:
            best, end = score, at
    return best, end


def place_bits(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, char in enumerate(item):
        out[char] = out.get(char, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = []
        #: Items without a budget, by their text.
        self.short: dict[str, list[int]] = {}
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = int(len(text) * error_rate)
            if not budget:
                if text:
                    self.short.setdefault(text, []).append(item_id)
                continue
            for place, piece in pieces(text, budget):
                hits.setdefault(piece, []).append((len(self.items), place))
            self.items.append((item_id, text, budget, place_bits(text), place_bits(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the items that occur in ``text``, each at its closest place."""
        for item_id in self.short.get(text, ()):
            yield item_id, 0, 0, len(text)
        if not self.items:
            return
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for item, place in places:
                start = last + 1 - size - place
                if (item, start) in tried or best.get(item, (1,))[0] == 0:
                    continue
                tried.add((item, start))
                _, pattern, budget, bits, back = self.items[item]
                m = len(pattern)
                if start >= 0 and text.startswith(pattern, start):
                    best[item] = (0, start, start + m)
                    continue
                low = max(0, start - budget)
                distance, end = myers(bits, m, text[low : start + m + budget])
                if distance > budget:
                    continue
                end += low
                # The same distance backwards from the end gives the start.
                _, width = myers(back, m, text[max(0, end - m - budget) : end][::-1])
                best[item] = min(best.get(item, (m + 1, 0, 0)), (distance, end - width, end))
        for item, (distance, start, end) in sorted(best.items()):
            yield self.items[item][0], distance, start, end


def item_blocks(items: DataFrame, error_rate: float, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in lists of at most ``block_bytes`` (or one item)."""
    block, size, short = [], 0, 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = normalise((row["text"] or "").encode("utf-8"))
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
        short += 0 < len(text) and not int(len(text) * error_rate)
    if short:
        warnings.warn(f"{short} benchmark items are too short for an edit and match only texts equal to them", stacklevel=2)
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, match_start, match_end.

    ``docs``: doc_id, text. ``items``: item_id, text. Places count characters of the normalised text.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for block in item_blocks(items, error_rate, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                rows = [
                    (doc, *match) for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))) for match in matcher.matches(normalise(text))
                ]
                columns = list(zip(*rows)) if rows else [()] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "distance", "match_start", "match_end"])

        part = source.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def without_contamination(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for block in item_blocks(items, error_rate, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                clean = [next(matcher.matches(normalise(text)), None) is None for text in as_bytes(batch.column("text"))]
                yield batch.select(["record"]).filter(pa.array(clean, pa.bool_()))

        source = docs.select(F.struct("*").alias("record"), F.col("text").cast("string").alias("text"))
        docs = source.mapInArrow(run, source.select("record").schema).select("record.*")
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return settle(find_contamination(docs, items))
