"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Removes each byte that is covered by a ``window``-byte string that also starts
in a document with a smaller doc_id; strings are judged on the input.

Only sampled suffixes are sorted (see ``runs``): a window that occurs twice
holds the same sampled place in both. First each run asks which of its sampled
k-grams another run has too. Around the places that are left, each run sorts
its suffixes (the ``window`` bytes from the place, then the bytes before it,
backwards), keeps equal ones once with their least doc_id, and sends them
front-coded: the length shared with the one before and the rest. Each part
merges the sorted runs with a loser tree that compares bytes only behind the
prefix that is already known to be common. The common prefixes of neighbours
then say, for every place that a window can start at, which suffixes agree on
it, and the least doc_id among them.

The suffixes of one k-gram go to one part. A k-gram of HOT_RUNS runs or more is
split: of a window that starts shortly before the place the bytes up to
RIGHT behind the place are known, of one that starts further ahead the LEFT
bytes before it. So its suffixes go once by the hash of the former and once by
that of the latter, each answering for its window starts only. What one part
gets of one k-gram is thus bounded by the text of HOT_RUNS runs, unless that
many runs share a longer string, RIGHT bytes or LEFT and a k-gram, in as many
contexts.

Defined results: null text is empty; a null doc_id comes after all others and
nulls are equal among themselves; documents of one doc_id don't count against
each other; matches never cross documents; a very long text is held whole by
one task and looked at in segments; an empty table gives an empty result;
other columns travel along if asked for, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as R
from ._common import Scratch, settle

WINDOW = 50
GRAM = 16
KINDS, SUFFIXES = 0, 1
#: From how many runs on the suffixes of a k-gram are split.
HOT_RUNS = 8
#: Windows that start at most NEAR bytes before the place, and what is known of these and of the others.
NEAR = 17
RIGHT, LEFT = WINDOW - NEAR, NEAR + 1


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place; never 0."""
    two = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    return np.maximum(R.mixed(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + R.mixed(eight[8:])), np.uint64(1))


def sampled(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and k-gram hash of the sampled places."""
    docs, places, hashes = [], [], []
    for segments in R.segments([len(t) for t in texts], window):
        b = np.frombuffer(b"".join([texts[d][s:e] for d, s, e in segments]), dtype=np.uint8)
        doc, start, end = (np.array(x, dtype=np.int64) for x in zip(*segments))
        lengths = end - start
        h = gram_hashes(b)
        _, chosen = R.window_minima(h, lengths, window, GRAM)
        at = np.flatnonzero(chosen)
        first = np.cumsum(lengths) - lengths
        own = np.searchsorted(first, at, side="right") - 1
        docs.append(doc[own])
        places.append(at - first[own] + start[own])
        hashes.append(R.mixed(h[at] + R.SPREAD))  # least hashes are small; mixed again they fill all parts
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


def spread(_: np.ndarray, bodies: R.Bodies) -> pa.BinaryArray:
    """Replies: for each k-gram how many runs have it, 255 at most."""
    return R.packed(bodies.sizes(np.uint32), np.minimum(R.runs_with(bodies.joined(np.uint32)), 255).astype(np.uint8))


def repeated(docs: R.Documents, heard: dict, hot_runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sampled places whose k-gram another run has, or another document of this one, and whether ``hot_runs`` runs have it."""
    doc, place, h = sampled(docs.texts)
    keys, inverse = np.unique(h, return_inverse=True)
    runs = heard[KINDS].joined(np.uint8) if KINDS in heard else np.ones(len(keys), dtype=np.uint8)
    again = runs > 1
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, docs.rank[doc])
    np.maximum.at(high, inverse, docs.rank[doc])
    keep = (again | (low != high))[inverse]
    return doc[keep], place[keep], h[keep], (runs >= hot_runs)[inverse][keep]


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), dtype=np.uint64)
    for word in padded.view(np.uint64).T:
        out = R.mixed(out * np.uint64(0x9E3779B97F4A7C15) + word + R.SPREAD)
    return out


class Suffixes:
    """The distinct suffixes of a run, by part and in order, with their least doc_id.

    A key has the window's bytes from the place on, then the bytes before it
    backwards, then how many of either are inside the document (plus 1).
    Parts from ``parts`` on hold split k-grams, first by the bytes behind.
    """

    WIDTH = WINDOW + (WINDOW - GRAM) + 2

    def __init__(self, docs: R.Documents, heard: dict, parts: int, hot_runs: int = HOT_RUNS):
        doc, place, h, hot = repeated(docs, heard, hot_runs)
        # A place of a split k-gram comes twice.
        twice = np.flatnonzero(hot)
        row = np.concatenate([np.arange(len(doc)), twice])
        self.doc, self.place = doc[row], place[row]
        near, every = (1 << NEAR + 1) - 1, (1 << WINDOW - GRAM + 1) - 1
        #: A bit for each window start that the row answers for.
        self.answers = np.concatenate([np.where(hot, near, every), np.full(len(twice), every - near)])
        before = WINDOW - GRAM
        sizes = np.array([len(t) for t in docs.texts], dtype=np.int64)
        gap = bytes(before), bytes(WINDOW)
        buffer = np.frombuffer(b"".join([gap[0] + t + gap[1] for t in docs.texts]), dtype=np.uint8)
        first = np.cumsum(sizes + before + WINDOW) - sizes - WINDOW
        at = first[self.doc] + self.place if len(self.doc) else np.zeros(0, np.int64)
        right = np.minimum(WINDOW, sizes[self.doc] - self.place)
        left = np.minimum(before, self.place)
        keys = np.empty((len(at), self.WIDTH), dtype=np.uint8)
        for i in range(WINDOW):
            keys[:, i] = buffer[at + i]
        for i in range(before):
            keys[:, WINDOW + i] = buffer[at - 1 - i]
        keys[:, -2], keys[:, -1] = right + 1, left + 1
        part = R.part_of(h, parts)
        part[twice] = parts + R.part_of(row_hashes(keys[twice, :RIGHT]), parts)
        far = keys[len(doc) :]
        far = R.part_of(row_hashes(np.concatenate([far[:, :GRAM], far[:, WINDOW : WINDOW + LEFT]], axis=1)), parts)
        part = np.concatenate([part, 2 * parts + far])
        joined = np.ascontiguousarray(keys).view(f"S{self.WIDTH}").ravel()
        order = np.lexsort([joined, part]) if len(at) else np.zeros(0, np.int64)
        joined, part = joined[order], part[order]
        new = np.r_[True, (joined[1:] != joined[:-1]) | (part[1:] != part[:-1])][: len(joined)]
        #: The suffix of each sampled place.
        self.suffix = np.empty(len(at), dtype=np.int64)
        self.suffix[order] = np.cumsum(new) - 1
        self.keys, self.part = keys[order][new], part[new]
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.suffix, docs.rank[self.doc])

    def slices(self) -> tuple[np.ndarray, list[slice]]:
        """The parts that have suffixes, and where those are."""
        first = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1]][: len(self.part)])
        ends = np.r_[first[1:], len(self.part)]
        return self.part[first], [slice(int(a), int(b)) for a, b in zip(first, ends)]


def common(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it."""
    same = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        same[1:] = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return same


def front_coded(keys: np.ndarray, least: np.ndarray) -> bytes:
    import zstandard

    shared = common(keys)
    rest = keys[np.arange(keys.shape[1]) >= shared[:, None]]
    body = np.uint32(len(keys)).tobytes() + shared.tobytes() + least.tobytes() + rest.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def front_decoded(body: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, shared prefix lengths and least doc_ids."""
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(body, dtype=np.uint32, count=1)[0])
    shared = np.frombuffer(body, dtype=np.uint8, count=n, offset=4)
    least = np.frombuffer(body, dtype=np.int64, count=n, offset=4 + n)
    rest = np.frombuffer(body, dtype=np.uint8, offset=4 + 9 * n)
    keys = np.zeros((n, width), dtype=np.uint8)
    own = np.arange(width) >= shared[:, None]
    keys[own] = rest
    # A byte that isn't there is that of the last row that has it.
    last = np.where(own, np.arange(n, dtype=np.int32)[:, None], 0)
    last = np.maximum.accumulate(last, axis=0)
    return keys[last, np.arange(width)], shared, least


def merge(sequences: list[list[bytes]], shared: list[list[int]], width: int) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted sequences: which sequence each key of the result is from, and what it shares with the one before.

    ``common_with[s]``: what the next key of s shares with the key last put
    out. Of two such keys the one that shares more is smaller; only equals are
    compared, from there on, and the loser keeps what it shares with the winner.
    """
    n = len(sequences)
    size = 1 << max(0, (n - 1).bit_length())
    at = [0] * size
    common_with = [0] * size
    head: list[bytes | None] = [s[0] if s else None for s in sequences] + [None] * (size - n)
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length is brought up to date."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = common_with[a], common_with[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        u, v = x[p:], y[p:]
        if u == v:
            common_with[b] = width
            return a, b
        differ = int.from_bytes(u, "big") ^ int.from_bytes(v, "big")
        p = width - (differ.bit_length() + 7) // 8
        if u < v:
            common_with[b] = p
            return a, b
        common_with[a] = p
        return b, a

    winners = list(range(size))
    for node in range(size - 1, 0, -1):
        left, right = 2 * node, 2 * node + 1
        a = winners[left - size] if left >= size else losers[left] >> 32
        b = winners[right - size] if right >= size else losers[right] >> 32
        won, lost = play(a, b)
        losers[node] = won << 32 | lost
    top = losers[1] >> 32 if size > 1 else 0
    losers = [x & 0xFFFFFFFF if x >= 0 else x for x in losers]
    source, prefix = [], []
    while head[top] is not None:
        source.append(top)
        prefix.append(common_with[top])
        at[top] += 1
        own = sequences[top]
        if at[top] < len(own):
            head[top] = own[at[top]]
            common_with[top] = shared[top][at[top]]
        else:
            head[top] = None
        node = top + size >> 1
        while node:
            won, lost = play(top, losers[node])
            losers[node], top = lost, won
            node >>= 1
    return source, prefix


def classes(shared: np.ndarray, length: int) -> np.ndarray:
    """Number of the group of sorted rows that agree on their first ``length`` bytes."""
    return np.cumsum(shared < length)


def least_by_window(keys: np.ndarray, shared: np.ndarray, least: np.ndarray):
    """For each number of bytes before the place that a window can start at: the least doc_id among the rows that agree on that window.

    ``keys`` are sorted and distinct; where the window isn't inside the document: the largest id.
    """
    before = WINDOW - GRAM
    n = len(keys)
    right, left = keys[:, -2].astype(np.int64) - 1, keys[:, -1].astype(np.int64) - 1
    backwards = np.ascontiguousarray(np.concatenate([keys[:, WINDOW : WINDOW + before], np.ones((n, 1), np.uint8)], axis=1))
    order = np.argsort(backwards.view(f"S{before + 1}").ravel(), kind="stable")
    shared_left = common(backwards[order])
    for start in range(before + 1):
        out = np.full(n, np.iinfo(np.int64).max)
        inside = np.flatnonzero((left >= start) & (right >= WINDOW - start))
        if len(inside):
            a = classes(shared, WINDOW - start)
            b = np.empty(n, dtype=np.int64)
            b[order] = classes(shared_left, start) if start else 1
            key = a[inside] * (n + 1) + b[inside]
            by = np.argsort(key, kind="stable")
            ranked = key[by]
            first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            group = np.minimum.reduceat(least[inside][by], first)
            out[inside[by]] = np.repeat(group, np.diff(np.r_[first, len(by)]))
        yield start, out


def answer_suffixes(_: np.ndarray, bodies: R.Bodies) -> pa.Array:
    """For each suffix of each run, a bit for each window start: does a smaller doc_id than the run's least have that window?"""
    import zstandard

    width = Suffixes.WIDTH
    decoded = [front_decoded(b, width) for b in bodies.values()]
    sequences = [np.ascontiguousarray(k).view(f"V{width}").ravel().tolist() for k, _, _ in decoded]
    source, prefix = merge(sequences, [s.tolist() for _, s, _ in decoded], width)
    del sequences
    source, prefix = np.array(source, dtype=np.int64), np.array(prefix, dtype=np.int64)
    offsets = np.cumsum([0] + [len(k) for k, _, _ in decoded])
    # The merge takes each run's suffixes in their order.
    row = np.empty(len(source), dtype=np.int64)
    by_run = np.argsort(source, kind="stable")
    row[by_run] = np.arange(len(source))
    least = np.concatenate([d[2] for d in decoded])
    new = prefix < width
    if len(new):
        new[0] = True
    distinct = np.cumsum(new) - 1
    keys = np.concatenate([d[0] for d in decoded])[row[new]]
    lowest = np.minimum.reduceat(least[row], np.flatnonzero(new))
    bits = np.zeros(len(row), dtype=np.int64)
    for start, lowest_there in least_by_window(keys, prefix[new], lowest):
        bits |= (lowest_there[distinct] < least[row]).astype(np.int64) << start
    in_order = np.empty(len(row), dtype=np.int64)
    in_order[row] = bits
    pack = zstandard.ZstdCompressor(level=1)
    return pa.array([pack.compress(in_order[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.binary())


def removed_bytes(docs: R.Documents, heard: dict, parts: int, hot_runs: int = HOT_RUNS) -> np.ndarray:
    """Which bytes of the run's texts, joined, go."""
    import zstandard

    sizes = np.array([len(t) for t in docs.texts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    starts = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    own = Suffixes(docs, heard, parts, hot_runs)
    if len(own.doc):
        bits = np.empty(len(own.keys), dtype=np.int64)
        for where, body in zip(own.slices()[1], heard[SUFFIXES].values()):
            bits[where] = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.int64)
        own_bits = bits[own.suffix] & own.answers
        # An equal suffix in a smaller doc_id of this run: every window counts.
        later = docs.rank[own.doc] > own.least[own.suffix]
        for start in range(WINDOW - GRAM + 1):
            inside = (own.place >= start) & (own.place - start + WINDOW <= sizes[own.doc])
            go = inside & (later | ((own_bits >> start) & 1).astype(bool))
            starts[first[own.doc[go]] + own.place[go] - start] = 1
    open_windows = np.cumsum(starts[:-1], dtype=np.int32)
    covered = open_windows.copy()
    covered[WINDOW:] -= open_windows[:-WINDOW]
    return covered > 0


OUT = "doc_id long, n_bytes long, spans array<struct<start:int,length:int>>, kept binary"


def emit(docs: R.Documents, gone: np.ndarray, table: pa.Table, with_rest: bool) -> pa.Table:
    spans, kept, at = [], [], 0
    for text in docs.texts:
        own = gone[at : at + len(text)]
        at += len(text)
        if not own.any():
            spans.append([])
            kept.append(text)
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2)
        spans.append([{"start": int(a), "length": int(b - a)} for a, b in edges])
        kept.append(np.frombuffer(text, dtype=np.uint8)[~own].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    columns = [pa.array(docs.ids, pa.int64()), pa.array([len(t) for t in docs.texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
    names = ["doc_id", "n_bytes", "spans", "kept"]
    if with_rest:
        # As text again: a character that was cut goes whole.
        columns[3] = pa.array([k.decode("utf-8", "ignore").encode("utf-8") for k in kept], pa.binary())
        columns.append(table["rest"].take(pa.array(docs.order)))
        names.append("rest")
    return pa.table(columns, names)


def remove_repeats(scratch: Scratch, docs: DataFrame, rest: list[str] | None = None, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes), kept (the remaining bytes), [rest] of every document.

    With ``rest`` (columns that travel along as one struct) what is left of a
    character that was cut goes too, so that ``kept`` is text.
    ``hot_runs``: from how many runs on a k-gram's suffixes are split.
    The frame reads tables of ``scratch``: settle or write it before they go.
    """
    staged = R.Runs(scratch, docs, rest=rest)
    parts = staged.parts

    def ask_grams(own: R.Documents, _: dict, __: int):
        keys = np.unique(sampled(own.texts)[2])
        return R.sent(keys, R.short_key(keys), parts)

    def send(own: R.Documents, heard: dict, _: int):
        found = Suffixes(own, heard, parts, hot_runs)
        numbers, places = found.slices()
        return numbers, pa.array([front_coded(found.keys[where], found.least[where]) for where in places], pa.binary())

    grams = staged.ask("grams", ask_grams, spread, KINDS)
    suffixes = staged.ask("suffixes", send, answer_suffixes, SUFFIXES, grams)
    schema = OUT
    if rest:
        schema += f", rest {staged.table.schema['rest'].dataType.simpleString()}"

    def finish(_: int, table: pa.Table, heard: dict) -> pa.Table:
        own = R.Documents(table)
        return emit(own, removed_bytes(own, heard, parts, hot_runs), table, bool(rest))

    return staged.visit(finish, schema, grams.unionByName(suffixes))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        out = remove_repeats(scratch, docs.select("doc_id", "text"))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
        return settle(
            out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
        )
