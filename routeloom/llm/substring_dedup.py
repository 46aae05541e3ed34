"""Substring dedup by relative Lempel-Ziv parsing over words.

Every run of documents is a reference block with an index: the sampled
phrases of its windows (``window`` words each; see ``runs``) and, for phrases
that occur again, the hash and first place of each window around them. The
index is asked by key range, so all blocks are consulted at once and no text
is sent: each window learns the first other place, in any block, that has it.

A document is then parsed greedily from left to right. A factor starts at the
first window that has a place elsewhere and is as long as the places that its
windows have follow one another there; it is a copy of so many words from that
place of that block. Where a factor ends, the windows across its end have been
looked up as well, so the next factor may begin inside it, at the first of
them that is somewhere else. All factors have at least ``window`` words, and
their words are the duplicate spans, which go.

Factors are verified: the block that a factor copies from compares the SHA-256
of its own words there. Only if a factor fails, which takes two different
windows of one 64-bit hash, are all windows asked again by 128 bits of their
words' SHA-256, and the texts parsed anew.

Defined results: null text has no words; windows never cross documents;
repeated rows are documents of their own; documents with fewer words than a
window keep all; of several places the first (by block, then within it) is
named; a very long text is held whole by one task and looked at in segments;
an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as R
from ._common import Scratch, settle, words

#: Bits of a window's hash; fewer would only make the second asking likelier.
HASH_BITS = 64
WINDOW = 35
PHRASE = 8
STEP = np.uint64(0x9E3779B97F4A7C15)
PHRASES, WINDOWS = 0, 1


class WordHashes:
    """64-bit hashes of words; frequent words are remembered."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, own: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, own), dtype=np.uint64, count=len(own))
        except KeyError:
            for w in own:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, own), dtype=np.uint64, count=len(own))


def stretch_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` units from each place; never 0."""
    out = units[: len(units) - size + 1].copy()
    for i in range(1, size):
        out *= STEP
        out += units[i : len(units) - size + 1 + i]
    return np.maximum(R.mixed(out), np.uint64(1))


class Windows:
    """The windows of a run: document, start, hash and least phrase of each."""

    def __init__(self, units: list[np.ndarray], window: int = WINDOW):
        docs, starts, hashes, phrases, places = [], [], [], [], []
        for segments in R.segments([len(u) for u in units], window):
            joined = np.concatenate([units[d][s:e] for d, s, e in segments])
            doc, start, end = (np.array(x, dtype=np.int64) for x in zip(*segments))
            lengths = end - start
            own_phrases = stretch_hashes(joined, PHRASE)
            least, chosen = R.window_minima(own_phrases, lengths, window, PHRASE)
            places.append(R.mixed(own_phrases[chosen] + R.SPREAD))  # least hashes are small; mixed again they fill all parts
            at = np.flatnonzero(least)
            first = np.cumsum(lengths) - lengths
            own = np.searchsorted(first, at, side="right") - 1
            docs.append(doc[own])
            starts.append(at - first[own] + start[own])
            hashes.append(stretch_hashes(joined, window)[at] >> np.uint64(64 - HASH_BITS) << np.uint64(64 - HASH_BITS))
            phrases.append(R.mixed(least[at] + R.SPREAD))
        empty = np.zeros(0, np.int64)
        self.doc = np.concatenate(docs) if docs else empty
        self.start = np.concatenate(starts) if docs else empty
        self.hash = np.concatenate(hashes) if docs else empty.astype(np.uint64)
        self.phrase = np.concatenate(phrases) if docs else empty.astype(np.uint64)
        #: The sampled phrases, and at how many places each is.
        self.keys, self.places = np.unique(np.concatenate(places) if docs else self.phrase, return_counts=True)

    def asked(self, heard: dict) -> np.ndarray:
        """Which windows have a phrase that is at another place too."""
        again = R.heard_flags(self.keys, heard, PHRASES) | (self.places > 1)
        return np.flatnonzero(again[np.searchsorted(self.keys, self.phrase)]) if len(self.keys) else np.zeros(0, dtype=np.int64)


#: A window's key and its first place in the run, counted in words; with a strong digest, two keys.
PLACE = np.dtype([("key", "<u8"), ("at", "<u4")])
STRONG = np.dtype([("key", "<u8"), ("more", "<u8"), ("at", "<u4")])
#: Where else a window is; run -1: nowhere.
ELSEWHERE = np.dtype([("run", "<i4"), ("at", "<u4")])


class Asked:
    """The windows of a run that are asked about: their places, and the distinct ones with their first two places."""

    def __init__(self, texts: list[list[bytes]], units: list[np.ndarray], heard: dict, strong: bool):
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        #: The word that each document starts at.
        self.first = np.cumsum(sizes) - sizes
        found = Windows(units)
        ask = found.asked(heard)
        self.at = self.first[found.doc[ask]] + found.start[ask]
        key, more = found.hash[ask], np.zeros(len(ask), dtype=np.uint64)
        if strong:
            digests = [hashlib.sha256(b" ".join(texts[d][s : s + WINDOW])).digest()[:16] for d, s in zip(found.doc[ask].tolist(), found.start[ask].tolist())]
            both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
            key, more = both[:, 0], both[:, 1]
        order = np.lexsort([self.at, more, key])
        key, more, at = key[order], more[order], self.at[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])][: len(key)]
        heads = np.flatnonzero(new)
        #: The number of each window among the distinct ones.
        self.distinct = np.empty(len(key), dtype=np.int64)
        self.distinct[order] = np.cumsum(new) - 1
        several = np.diff(np.r_[heads, len(key)]) > 1
        self.second = np.full(len(heads), -1, dtype=np.int64)
        self.second[several] = at[heads[several] + 1]
        self.sent = np.zeros(len(heads), dtype=STRONG if strong else PLACE)
        self.sent["key"], self.sent["at"] = key[heads], at[heads]
        if strong:
            self.sent["more"] = more[heads]

    def elsewhere(self, run: int, heard: dict) -> tuple[np.ndarray, np.ndarray]:
        """Run and place that each window is a copy of; run -1: it is nowhere else."""
        reply = heard[WINDOWS].joined(ELSEWHERE) if WINDOWS in heard else np.zeros(0, ELSEWHERE)
        first = self.sent["at"].astype(np.int64)[self.distinct]
        source, place = reply["run"].astype(np.int64)[self.distinct], reply["at"].astype(np.int64)[self.distinct]
        # Without an earlier run this run has the first place of all; that one looks further, the others look there.
        here = (source < 0) | (source > run)
        later = here & (self.at != first)
        source[later], place[later] = run, first[later]
        second = self.second[self.distinct]
        alone = here & (self.at == first) & (source < 0) & (second >= 0)
        source[alone], place[alone] = run, second[alone]
        return source, place


def other_places(strong: bool):
    dtype = STRONG if strong else PLACE

    def answer(runs: np.ndarray, bodies: R.Bodies) -> pa.BinaryArray:
        """For each window of each run: the first place in all runs, or for the one that is there, the next."""
        rows, sizes = bodies.joined(dtype), bodies.sizes(dtype)
        run = np.repeat(runs, sizes)
        order = np.lexsort([run, rows["more"], rows["key"]] if strong else [run, rows["key"]])
        key = rows["key"][order]
        same = key[1:] == key[:-1]
        if strong:
            same &= rows["more"][order][1:] == rows["more"][order][:-1]
        new = np.r_[True, ~same][: len(key)]
        heads = np.flatnonzero(new)
        count = np.diff(np.r_[heads, len(key)])
        pointed = np.repeat(heads, count)
        pointed[heads] = np.where(count > 1, heads + 1, -1)
        out = np.zeros(len(rows), dtype=ELSEWHERE)
        there = pointed >= 0
        out["run"][order] = np.where(there, run[order][pointed], -1)
        out["at"][order] = np.where(there, rows["at"][order][pointed], 0)
        return R.packed(sizes, out)

    return answer


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Greedy factors as rows (start, length, source run, source place), in words; windows in order of ``at``."""
    copied = source >= 0
    at, source, place = at[copied], source[copied], place[copied]
    if not len(at):
        return np.zeros((0, 4), dtype=np.int64)
    follows = (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    heads = np.flatnonzero(np.r_[True, ~follows])
    length = np.diff(np.r_[heads, len(at)]) + WINDOW - 1
    return np.stack([at[heads], length, source[heads], place[heads]], axis=1)


FACTOR = "struct<start:int,length:int,source_run:int,source_word:long,digest:binary>"
OUT = f"doc_id long, n_words long, spans array<struct<start:int,length:int>>, factors array<{FACTOR}>, kept binary"
CHECKED = "source_run int, source_word long, length int, source_id long, source_start int, equal boolean"


def spans_of(own: np.ndarray) -> list[dict]:
    """Maximal runs of words under factors (start, length) that come in order."""
    if not len(own):
        return []
    ends = np.maximum.accumulate(own[:, 0] + own[:, 1])
    heads = np.flatnonzero(np.r_[True, own[1:, 0] > ends[:-1]])
    return [{"start": int(a), "length": int(b - a)} for a, b in zip(own[heads, 0], ends[np.r_[heads[1:] - 1, len(own) - 1]])]


def parse(staged: R.Runs, strong: bool) -> DataFrame:
    """The documents with their factors, spans and what is left."""
    parts = staged.parts

    def units_of(own: R.Documents) -> tuple[list[list[bytes]], list[np.ndarray]]:
        hashes = WordHashes()
        texts = [words(t) for t in own.texts]
        return texts, [hashes.of(t) for t in texts]

    def phrases(own: R.Documents, _: dict, __: int):
        keys = Windows(units_of(own)[1]).keys
        return R.sent(keys, R.short_key(keys), parts)

    def windows(own: R.Documents, heard: dict, _: int):
        asked = Asked(*units_of(own), heard, strong)
        return R.sent(asked.sent["key"], asked.sent, parts)

    def finish(run: int, table: pa.Table, heard: dict) -> pa.Table:
        own = R.Documents(table)
        texts, units = units_of(own)
        asked = Asked(texts, units, heard, strong)
        found = factors(asked.at, *asked.elsewhere(run, heard))
        edges = np.searchsorted(found[:, 0], np.append(asked.first, np.iinfo(np.int64).max))
        rows = []
        for doc, (these, first) in enumerate(zip(texts, asked.first.tolist())):
            mine = found[edges[doc] : edges[doc + 1]] - [first, 0, 0, 0]
            listed = [
                {"start": a, "length": n, "source_run": r, "source_word": w, "digest": hashlib.sha256(b" ".join(these[a : a + n])).digest()} for a, n, r, w in mine.tolist()
            ]
            spans = spans_of(mine)
            kept, done = [], 0
            for span in spans:
                kept += these[done : span["start"]]
                done = span["start"] + span["length"]
            rows.append((len(these), spans, listed, b" ".join(kept + these[done:])))
        span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
        factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_run", pa.int32()), ("source_word", pa.int64()), ("digest", pa.binary())])
        n, spans, listed, kept = zip(*rows) if rows else ((),) * 4
        columns = [pa.array(own.ids, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(listed, pa.list_(factor)), pa.array(kept, pa.binary())]
        return pa.table(columns, ["doc_id", "n_words", "spans", "factors", "kept"])

    name = "strong_" if strong else ""
    first = staged.ask(f"{name}phrases", phrases, R.shared, PHRASES)
    second = staged.ask(f"{name}windows", windows, other_places(strong), WINDOWS, first)
    return staged.scratch.write(staged.visit(finish, OUT, first.unionByName(second)), f"{name}parsed")


def checked(staged: R.Runs, parsed: DataFrame, name: str) -> DataFrame:
    """The distinct factors against the blocks that they copy from: where they are there, and whether the words are the same."""
    each = parsed.select(F.explode("factors").alias("f")).select("f.*")
    distinct = each.groupBy("source_run", "source_word", "length", "digest").agg(F.lit(0).alias("_"))

    def compare(key, table, asked):
        R.release()
        run = key[0].as_py()
        own = R.Documents(table if asked.num_rows else table.slice(0, 0))
        cut: dict[int, list[bytes]] = {}
        sizes = np.array([len(words(t)) for t in own.texts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        rows = []
        for at, n, digest in zip(*[asked[c].to_pylist() for c in ("source_word", "length", "digest")]):
            # Documents without words start where the next one does.
            doc = int(np.searchsorted(first, at, side="right")) - 1
            if doc not in cut:
                if len(cut) > 64:
                    cut.clear()
                cut[doc] = words(own.texts[doc])
            start = at - int(first[doc])
            same = start + n <= len(cut[doc]) and hashlib.sha256(b" ".join(cut[doc][start : start + n])).digest() == digest
            rows.append((run, at, n, own.ids[doc], start, same))
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["source_run", "source_word", "length", "source_id", "source_start", "equal"])

    asked = distinct.select(F.col("source_run").alias("run"), "source_word", "length", "digest")
    out = staged.table.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(compare, CHECKED)
    return staged.scratch.write(out, f"{name}checked")


def remove_substrings(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (removed runs of words), factors, kept (the remaining words, joined by one space) of every document.

    The frame reads tables of ``scratch``: settle or write it before they go.
    """
    staged = R.Runs(scratch, docs)
    parsed = parse(staged, False)
    if not checked(staged, parsed, "").where("not equal").isEmpty():
        parsed = parse(staged, True)
        checked(staged, parsed, "strong_")
    return parsed


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        out = remove_substrings(scratch, docs.select("doc_id", "text"))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
        return settle(out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")))
