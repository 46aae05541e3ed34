"""N-gram Jaccard join with size-banded tiles and bitmap signatures.

Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of
distinct 5-word shingles. Documents with equal sets are one node.

A link needs an overlap of at least 3/4 of the larger set, so of any quarter
of a set (and one more) one shingle is in the other set. The quarter is taken
in an order that all documents share: shingles of few runs of documents first
(see ``runs``), then by hash. Shingles that no other document has can't link,
so most documents have nothing left in their quarter and go no further.

A tile holds the nodes that share such a shingle, in order of size; only
nodes within the size band of one another are compared. First every node is
compared with the smallest node of its band (a star, so a tile of m nodes
gives fewer than m pairs), and the links make components; where a tile holds
several, once more, with the node before it too. Then pairs of different
components of a tile are compared by bitmap signatures: the bits
that differ bound the overlap from above. What is left is decided by exact
intersection of the sorted arrays. Pairs inside a component need no check to
name it, and no candidate is dropped. Tiles of more than BLOCK nodes are dealt
out as pairs of blocks.

Every link lies inside a component, so the links are then counted there: all
pairs of different nodes of a component within the size band are intersected
exactly, by pairs of blocks. Each document gets the number of rows it links
with; the pairs themselves, which grow with the square of a group, aren't rows.

Shingles are 64-bit hashes of their words' 64-bit hashes.

Defined results: null text and text without words have an empty set, linked
with nothing; a text of fewer than 5 words has its whole sequence as its one
shingle; a null doc_id takes part but never names a component unless all of
it is null; repeated rows are linked; sets of equal size are ordered by node;
a very long text is one set, held by one task; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as R
from ._common import Scratch, settle, words
from .substring_dedup import WordHashes, stretch_hashes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BITS = 2048
BLOCK = 1024
#: A block of a component holds about this many shingles at most.
LOAD = 1 << 20
#: Nodes and shingles that are intersected at a time.
SIDE, WIDTH = 256, 4096
SPREAD = 0
NODES = "doc_id long, n_shingles long, node long, prefix array<long>, shingles binary, bitmap binary"


def shingle_set(units: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if not len(units):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(stretch_hashes(units, min(SHINGLE, len(units))))


def sets_of(docs: R.Documents) -> list[np.ndarray]:
    hashes = WordHashes()
    return [shingle_set(hashes.of(words(t.lower()))) for t in docs.texts]


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=bool)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def in_runs(_: np.ndarray, bodies: R.Bodies) -> pa.BinaryArray:
    """Replies: for each shingle the logarithm of how many runs have it."""
    return R.packed(bodies.sizes(np.uint32), np.log2(R.runs_with(bodies.joined(np.uint32))).astype(np.uint8))


def quarter(size: int) -> int:
    """How many shingles, in any shared order, must hold one of every partner."""
    return size - -(-PERCENT * size // 100) + 1


def nodes(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """One row per document; prefix, shingles and bitmap only where a partner is possible."""
    staged = R.Runs(scratch, docs)
    parts = staged.parts

    def keys(own: R.Documents, _: dict, __: int):
        sets = sets_of(own)
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
        return R.sent(every, R.short_key(every), parts)

    def describe(_: int, table: pa.Table, heard: dict) -> pa.Table:
        own = R.Documents(table)
        sets = sets_of(own)
        # Rows with equal sets count once for how common a shingle is here.
        distinct = {s.tobytes(): s for s in sets if len(s)}
        every, counts = np.unique(np.concatenate(list(distinct.values())) if distinct else np.zeros(0, dtype=np.uint64), return_counts=True)
        spread = heard[SPREAD].joined(np.uint8) if SPREAD in heard else np.zeros(len(every), dtype=np.uint8)
        alone = (spread == 0) & (counts == 1)
        prefixes, arrays, bitmaps = [], [], []
        for s in sets:
            at = np.searchsorted(every, s)
            p = quarter(len(s)) if len(s) else 0
            # Shingles of this document alone come first in the order; spread 0 of two documents here does too, for both.
            order = np.lexsort([s, spread[at]])[:p]
            left = order[~alone[at[order]]]
            prefixes.append(s[left].view(np.int64) if len(left) else None)
            arrays.append(s.tobytes() if len(left) else None)
            bitmaps.append(bitmap(s) if len(left) else None)
        names = [node_of(s) for s in sets]
        columns = [
            pa.array(own.ids, pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(names, pa.int64()),
            pa.array(prefixes, pa.list_(pa.int64())),
            pa.array(arrays, pa.binary()),
            pa.array(bitmaps, pa.binary()),
        ]
        return pa.table(columns, ["doc_id", "n_shingles", "node", "prefix", "shingles", "bitmap"])

    replies = staged.ask("shingles", keys, in_runs, SPREAD)
    return scratch.write(staged.visit(describe, NODES, replies), "nodes")


def enough(small: int, large: int) -> bool:
    """Whether sets of these sizes can link."""
    return 100 * small >= PERCENT * large


def linked(overlap, a, b):
    """Whether sets of sizes a and b with this overlap link."""
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def stars(tiles: DataFrame, chain: bool = False) -> DataFrame:
    """Pairs (a, b) of each node with the first of its size band in each tile, if their components differ.

    ``chain``: with the node before it too. ``tiles``: token, node, n, component.
    """

    def run(batches):
        tile = None
        first = last = (0, 0, 0)
        for batch in batches:
            out = set()
            for token, *row in zip(*[batch.column(c).to_pylist() for c in ("token", "node", "n", "component")]):
                if token != tile:
                    tile, first = token, row
                else:
                    if not enough(first[1], row[1]):
                        first = row
                    for other in (first, last) if chain else (first,):
                        if other[2] != row[2] and enough(other[1], row[1]):
                            out.add((min(other[0], row[0]), max(other[0], row[0])))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    ordered = tiles.repartition("token").sortWithinPartitions("token", "n", "node")
    return ordered.mapInArrow(run, "a long, b long").dropDuplicates(["a", "b"])


def crossing(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in a tile whose bitmaps allow a link.

    ``tiles``: token, anchor (its least node), low, high (blocks), block,
    node, n, component, bitmap. Tiles of one group of documents mostly have
    the same least node, so they come one after another and a pair that was
    found in one isn't given again for the next.
    """

    def compare(rows: list[tuple]) -> set[tuple[int, int]]:
        block, node, n, component = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        bits = np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.uint64).reshape(len(rows), -1)
        out = set()
        same_block = rows[0][5]
        for i in range(len(rows) - 1):
            end = np.searchsorted(n, 100 * n[i] // PERCENT, side="right")
            if end <= i + 1:
                continue
            others = slice(i + 1, int(end))
            free = component[others] != component[i]
            if not same_block:
                free &= block[others] != block[i]
            at = np.flatnonzero(free) + i + 1
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1).astype(np.int64)
            for j in at[linked((n[at] + n[i] - differ) // 2, n[at], n[i])]:
                out.add((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return out

    def run(batches):
        tile, rows = None, []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            found: set[tuple[int, int]] = set()
            columns = [batch.column(c).to_pylist() for c in ("anchor", "low", "high", "token", "block", "node", "n", "component", "bitmap")]
            for anchor, low, high, token, block, node, n, component, bits in zip(*columns):
                if (anchor, low, high, token) != tile:
                    if len(rows) > 1:
                        found |= compare(rows) - seen
                    if tile and tile[:3] != (anchor, low, high):
                        seen.clear()
                    else:
                        seen |= found
                    tile, rows = (anchor, low, high, token), []
                rows.append((block, node, n, component, bits, low == high))
            yield pairs(found)
        if len(rows) > 1:
            yield pairs(compare(rows) - seen)

    def pairs(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    ordered = tiles.repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high", "token", "n", "node")
    return ordered.mapInArrow(run, "a long, b long").dropDuplicates(["a", "b"])


def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link: those whose bitmaps allow it, by exact intersection. ``sets``: node, shingles, bitmap."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sides = [[np.frombuffer(s, dtype=np.uint64) for s in batch.column(c).to_pylist()] for c in ("x", "y")]
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(len(a), BITS // 64) for c in ("bits_x", "bits_y")]
            n = [np.array([len(s) for s in side], dtype=np.int64) for side in sides]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)
            keep = []
            for i in np.flatnonzero(linked((n[0] + n[1] - differ) // 2, *n)):
                u, v = sides[0][i], sides[1][i]
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                if linked(int((v[at] == u).sum()), len(u), len(v)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("bitmap").alias("bits_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("bitmap").alias("bits_y"))
    pairs = candidates.join(right, "b").join(left, "a").select("a", "b", "x", "y", "bits_x", "bits_y")
    return pairs.mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)))
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    sides = []
    for sets, every in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, every), max(len(both) - 1, 0))
        there = both[at] == every if len(both) else np.zeros(len(every), dtype=bool)
        order = np.argsort(at[there], kind="stable")
        sides.append((row[there][order], at[there][order]))
    for start in range(0, len(both), WIDTH):
        dense = []
        for sets, (row, at) in zip((left, right), sides):
            low, high = np.searchsorted(at, (start, start + WIDTH))
            own = np.zeros((len(sets), min(WIDTH, len(both) - start)), dtype=np.float32)
            own[row[low:high], at[low:high] - start] = 1
            dense.append(own)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def link_counts(members: DataFrame) -> DataFrame:
    """node and n_links: the rows of other nodes of its component that it links with, all pairs intersected.

    ``members``: component, low, high (blocks), block, node, n, n_rows, shingles.
    """

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        block, node, n, n_rows = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
        total = np.zeros(len(rows), dtype=np.int64)
        same_block = rows[0][5]
        for i in range(0, len(rows), SIDE):
            one = np.arange(i, min(i + SIDE, len(rows)))
            for j in range(i, len(rows), SIDE):
                # Rows come in order of size.
                if not enough(n[one[-1]], n[j]):
                    break
                two = np.arange(j, min(j + SIDE, len(rows)))
                link = linked(overlaps([sets[k] for k in one], [sets[k] for k in two]), n[one][:, None], n[two][None, :])
                link &= one[:, None] < two[None, :]
                if not same_block:
                    link &= block[one][:, None] != block[two][None, :]
                total[one] += link @ n_rows[two]
                total[two] += n_rows[one] @ link
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "n_links"])

    def run(batches):
        group, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "low", "high", "block", "node", "n", "n_rows", "shingles")]
            for component, low, high, block, node, n, n_rows, shingles in zip(*columns):
                if (component, low, high) != group:
                    if len(rows) > 1:
                        yield compare(rows)
                    group, rows = (component, low, high), []
                rows.append((block, node, n, n_rows, shingles, low == high))
        if len(rows) > 1:
            yield compare(rows)

    ordered = members.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "n", "node")
    return ordered.mapInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def in_blocks(scratch: Scratch, sets: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """The members of each component, dealt as pairs of blocks, for ``link_counts``."""
    placed = label.join(sets.select("node", "n"), "node").join(classes.select("node", "n_rows"), "node")
    placed = scratch.write(placed, "members")
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / LOAD)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "component").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.join(sets.select("node", "shingles"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "n_rows", "shingles")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """node and component (the least node reachable) of every node of ``links`` (a, b).

    Each round takes the least label among the neighbours, then the label of
    that label, so paths shorten by more than half.
    """
    both = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}_links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{name}_0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        low = low.join(above, "component", "left").select("node", "old", F.coalesce(F.least("component", "above"), "component").alias("component"))
        low = scratch.write(low, f"{name}_{step}")
        labels = low.select("node", "component")
        if low.where("old != component").isEmpty():
            return labels


def merged(scratch: Scratch, label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``label`` (node, component) with the components that ``links`` join put together."""
    if links.isEmpty():
        return label
    ends = links
    for end in ("a", "b"):
        own = label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).drop(f"{end}_in")
    joined = components(scratch, ends.where("a != b").distinct(), name)
    above = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    inner = label.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return scratch.write(inner.unionByName(joined.join(label, "node", "left_anti")), f"{name}_label")


def unsettled(scratch: Scratch, tiles: DataFrame, label: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The tiles' rows with their components, and the tiles that hold several (token, anchor, m)."""
    placed = tiles.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.write(placed, f"{name}_placed")
    ends = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("anchor"), F.count("*").alias("m"))
    several = scratch.write(ends.where("low != high").select("token", "anchor", "m"), f"{name}_several")
    return placed.join(several, "token"), several


def jaccard_components(scratch: Scratch, docs: DataFrame, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, node and component_id of every row of ``docs`` (doc_id, text).

    ``count_links``: and n_links, the number of other rows that the row links with.
    The frame reads tables of ``scratch``: settle or write it before they go.
    """
    rows = nodes(scratch, docs)
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    classes = scratch.write(classes, "classes")
    # Prefixes of equal sets are alike but for shingles that only equal rows of one run share; any will do.
    sets = rows.where(F.col("prefix").isNotNull()).groupBy("node").agg(F.first("n_shingles").alias("n"), F.max_by("prefix", F.size("prefix")).alias("prefix"), F.first("shingles").alias("shingles"), F.first("bitmap").alias("bitmap"))
    sets = scratch.write(sets, "sets")
    arrays = sets.select("node", "shingles", "bitmap")
    tiles = sets.select(F.explode("prefix").alias("token"), "node", "n")
    tried = scratch.write(stars(tiles.withColumn("component", F.col("node"))), "stars")
    label = components(scratch, scratch.write(verified(tried, arrays), "links"), "first")
    # Once more where a tile holds several components, so that few pairs are left to compare.
    placed, _ = unsettled(scratch, tiles, label, "second")
    again = scratch.write(stars(placed, chain=True).join(tried, ["a", "b"], "left_anti"), "stars_again")
    tried = tried.unionByName(again)
    label = merged(scratch, label, scratch.write(verified(again, arrays), "links_again"), "second")
    placed, _ = unsettled(scratch, tiles, label, "third")
    dealt = placed.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", "anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "component")
    more = crossing(dealt.join(sets.select("node", "bitmap"), "node")).join(tried, ["a", "b"], "left_anti")
    label = merged(scratch, label, scratch.write(verified(scratch.write(more, "crossing"), arrays), "links_across"), "third")
    # The least doc_id of each component, for classes that aren't a single row.
    grouped = classes.join(label, "node", "left").where(F.col("component").isNotNull() | (F.col("n_rows") > 1))
    grouped = grouped.select("node", "first_id", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = scratch.write(grouped.join(names, "component").select("node", "component_id"), "named")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    if not count_links:
        return out.select("doc_id", "n_shingles", "node", component_id)
    others = scratch.write(link_counts(in_blocks(scratch, sets, classes, label)), "link_counts")
    # Rows with the same set are linked as well; rows without shingles with nothing.
    own = classes.join(others, "node", "left").select("node", (F.coalesce("n_links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"))
    own = scratch.write(own.where("n_links > 0"), "n_links")
    out = out.join(own, "node", "left")
    n_links = F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")
    return out.select("doc_id", "n_shingles", "node", component_id, n_links)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        out = jaccard_components(scratch, docs.select("doc_id", "text"), count_links=True)
        return settle(out.select("doc_id", "n_shingles", "component_id", "n_links"))
