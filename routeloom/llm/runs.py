"""Runs of documents, and questions between runs.

Texts are written once into memory-sized runs, hash-partitioned by run, so
that later passes over a run need no shuffle of text. A pass over the runs
sends, for each run, its sorted distinct keys, cut by key range into parts; a
part gathers one range from all runs and replies to each run about its own
keys, in the order sent. A key goes once per run however often it occurs
there, so no key's occurrences ever meet in one task.

A run sends a message to a part only if it has a key there: no more messages
than parts and no more than keys. So the messages of an exchange are at most
the keys sent, which grow with the text; the product of runs and parts bounds
them only while it is smaller than that. Messages are cut, counted and joined
as whole arrays, so a message of few keys costs about what its row costs.

Sampling: a window of given length holds at least one sampled key (the least
k-gram hash in it, every one of equals), and equal windows hold the same ones
at the same places. So a window can occur twice only if its sampled key does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Text of a run; executors with more memory can take longer ones.
RUN_BYTES = 4 << 20
#: Window starts that are sampled at a time.
SEGMENT = 1 << 16
SPREAD = np.uint64(0x632BE59BD9B4E019)
#: Spark refuses tables of more buckets than spark.sql.sources.bucketing.maxBuckets; several runs share a bucket beyond this.
MAX_BUCKETS = 50_000
QUESTIONS = "part int, run int, body binary"
REPLIES = "run int, kind int, part int, body binary"


class Runs:
    """Documents staged in runs. ``rest`` columns travel along as one struct."""

    def __init__(self, scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None, run_bytes: int = RUN_BYTES):
        text = F.col(text_col).cast("string")
        total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        self.scratch = scratch
        self.count = max(1, -(-total // run_bytes))
        self.parts = max(1, -(-self.count // 2))
        columns = [F.col(id_col).cast("long").alias("doc_id"), text.alias("text")]
        if rest:
            columns.append(F.struct(*rest).alias("rest"))
        # The partition spreads equal rows; a retried task still sends each row where it was.
        run = F.expr(f"cast(pmod(hash_, {self.count}) as int)")
        staged = docs.select(*columns, F.xxhash64(id_col, text_col, F.spark_partition_id()).alias("hash_")).withColumn("run", run).drop("hash_")
        allowed = int(scratch.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        self.table = scratch.bucketed(staged, "runs", "run", max(1, min(-(-self.count // 3), MAX_BUCKETS, allowed)))

    def ask(self, name: str, keys: Callable, answer: Callable, kind: int, replies: DataFrame | None = None) -> DataFrame:
        """One exchange: ``keys(docs, replies, run)`` gives the parts and bodies of a run's messages; ``answer(runs, bodies)`` replies to each body of a part, in order."""

        def send(run: int, table: pa.Table, heard: dict) -> pa.Table:
            parts, bodies = keys(Documents(table), heard, run)
            return pa.table([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), run), pa.int32()), bodies], ["part", "run", "body"])

        def reply(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            runs = table["run"].to_numpy()
            order = np.argsort(runs, kind="stable")
            replies = answer(runs[order], Bodies.of(table["body"], order))
            part = table["part"].take(pa.array(order)).cast(pa.int32())
            release()
            return pa.table([pa.array(runs[order], pa.int32()), pa.array(np.full(len(order), kind), pa.int32()), part, replies], ["run", "kind", "part", "body"])

        questions = self.visit(send, QUESTIONS, replies)
        return self.scratch.write(questions.groupBy("part").applyInArrow(reply, REPLIES), name)

    def visit(self, function: Callable, schema: str, replies: DataFrame | None = None) -> DataFrame:
        """``function(run, table, replies)`` for each run; replies: kind -> Bodies in order of their parts."""
        if replies is None:

            def alone(key, table):
                release()
                return function(key[0].as_py(), table, {})

            return self.table.groupBy("run").applyInArrow(alone, schema)

        def together(key, table, heard):
            release()
            heard = heard.combine_chunks()
            kinds, parts = heard["kind"].to_numpy(), heard["part"].to_numpy()
            by_kind = {}
            for kind in np.unique(kinds).tolist():
                own = np.flatnonzero(kinds == kind)
                by_kind[kind] = Bodies.of(heard["body"], own[np.argsort(parts[own], kind="stable")])
            return function(key[0].as_py(), table, by_kind)

        return self.table.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(together, schema)


class Bodies:
    """Binary values, one after another in one buffer."""

    def __init__(self, array: pa.BinaryArray):
        self.array = array
        buffers = array.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
        self.offsets = offsets.astype(np.int64) - int(offsets[0])
        self.data = np.frombuffer(buffers[2], dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])] if len(array) and buffers[2] is not None else np.zeros(0, np.uint8)

    @classmethod
    def of(cls, column: pa.ChunkedArray, order: np.ndarray) -> "Bodies":
        return cls(pa.concat_arrays(column.chunks or [pa.array([], pa.binary())]).take(pa.array(order)))

    def joined(self, dtype) -> np.ndarray:
        return self.data.view(dtype) if len(self.data) else np.zeros(0, dtype)

    def sizes(self, dtype) -> np.ndarray:
        return np.diff(self.offsets) // np.dtype(dtype).itemsize

    def values(self) -> list[bytes]:
        return self.array.to_pylist()


def packed(sizes: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """``values`` cut into binary values of ``sizes`` items."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def release() -> None:
    """Give unused Arrow memory back, so that one worker's peaks don't add up."""
    pa.default_memory_pool().release_unused()


class Documents:
    """The rows of a run in an order that every pass sees alike."""

    def __init__(self, table: pa.Table):
        ids, texts = table["doc_id"].to_pylist(), [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.order = np.array(order, dtype=np.int64)
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        #: Null ids come after all others.
        self.rank = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], dtype=np.int64)


def slide(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (minimum or maximum) over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = choose(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = choose(values[: size - width], values[width - size :])
    return values


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, start, end) that hold every window once, about SEGMENT starts a list."""
    out, filled = [], 0
    for doc, n in enumerate(sizes):
        for start in range(0, n - window + 1, SEGMENT):
            end = min(n, start + SEGMENT + window - 1)
            out.append((doc, start, end))
            filled += end - start
            if filled >= SEGMENT:
                yield out
                out, filled = [], 0
    if out:
        yield out


def window_minima(hashes: np.ndarray, lengths: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For joined segments: the least k-gram hash of each window start (0 where none starts), and which k-grams are least in some window.

    ``hashes``: of the k-gram at each place (len(units) - k + 1 of them).
    """
    width = window - k + 1
    least = slide(hashes, width, np.minimum)
    starts = np.cumsum(lengths) - lengths
    ends = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(ends, np.minimum(starts, len(least)), 1)
    np.add.at(ends, np.minimum(starts + lengths - window + 1, len(least)), -1)
    least = np.where(np.cumsum(ends[:-1]) > 0, least, np.uint64(0))
    gap = np.zeros(width - 1, dtype=np.uint64)
    reach = slide(np.concatenate([gap, least, gap]), width, np.maximum)
    return least, (reach == hashes) & (hashes > 0)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of a 64-bit key among ``parts``; sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted ``keys`` fall into, and how many of them each has."""
    own = part_of(keys, parts)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    return own[first], np.diff(np.r_[first, len(own)])


def sent(keys: np.ndarray, values: np.ndarray, parts: int) -> tuple[np.ndarray, pa.BinaryArray]:
    """Messages that carry a value for each of the sorted ``keys``."""
    own, sizes = by_part(keys, parts)
    return own, packed(sizes, values)


def short_key(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key that, within its part, tell keys apart but for one in some thousands."""
    return (mixed(keys) >> np.uint64(32)).astype(np.uint32)


def runs_with(keys: np.ndarray) -> np.ndarray:
    """For each of the keys of several runs (distinct within a run): how many runs have it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
    sizes = np.diff(np.r_[first, len(ranked)])
    counts = np.empty(len(keys), dtype=np.int64)
    counts[order] = np.repeat(sizes, sizes)
    return counts


def shared(_: np.ndarray, bodies: Bodies) -> pa.BinaryArray:
    """Replies to 32-bit keys: a byte for each, 1 if another run has it too."""
    return packed(bodies.sizes(np.uint32), (runs_with(bodies.joined(np.uint32)) > 1).astype(np.uint8))


def heard_flags(keys: np.ndarray, heard: dict, kind: int) -> np.ndarray:
    """The flags for sorted distinct ``keys``, from the replies."""
    return heard[kind].joined(np.uint8).astype(bool) if kind in heard else np.zeros(len(keys), dtype=bool)
