"""Best-fit packing of token pieces by minimum bin slack.

Documents are tokenized, ended with an end id, and cut only where longer than
a sequence (the first piece takes the remainder). Pieces are then packed on
the histogram of their lengths, which has at most ``capacity`` entries however
many documents there are. For each bin a subset-sum dynamic program over
bitsets finds the fullest combination of available lengths that holds the
longest one left; the combination is taken as many times as the counts allow,
which is what taking it bin by bin comes to. Ranks within a length then say
which piece goes to which bin.

Ranks come from counts by (length, salt): no length, however common, is
numbered in one task.

Defined results: null text is empty, so it is one piece with just the end id;
repeated rows are separate documents (each has its pieces; they may not be
told apart by doc_id); pieces of equal length are interchangeable, ties go by
doc_id, piece and ids; a very long text is tokenized whole in one task and
gives as many pieces as it needs; special tokens written in a text get their
own id, as the library does by default; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, as_bytes, settle

CAPACITY = 1024
END_ID = 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
#: How the byte-level pre-tokenizer cuts texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_of_letter() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable Latin-1, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, next_free = {}, 256
    for byte in range(256):
        out[chr(byte if byte in printable else next_free)] = byte
        next_free += byte not in printable
    return out


class TextTokenizer:
    """Ids that ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives, as little-endian 32-bit bytes.

    The vocabulary, merges and special tokens are those of the tokenizers file.
    Where it is a byte-level BPE whose ids are in merge order, tiktoken does
    the merging, at a quarter of the library's cost and with nothing
    remembered between texts; any other file goes through the library itself.
    """

    def __init__(self, path: str):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self.merging(spec)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    @staticmethod
    def merging(spec: dict):
        import tiktoken

        model, cut, byte = spec["model"], spec.get("pre_tokenizer") or {}, byte_of_letter()
        options = [cut.get("type") == "ByteLevel", not cut.get("add_prefix_space"), cut.get("use_regex", True), spec.get("normalizer") is None, model.get("type", "BPE") == "BPE"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        vocab = model["vocab"]
        if not all(options) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        if len(vocab) != 256 + len(merges) or [vocab[a + b] for a, b in merges] != list(range(256, len(vocab))):
            return None
        plain = [t for t in spec.get("added_tokens", []) if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        if len(plain) < len(spec.get("added_tokens", [])):
            return None
        ranks = {bytes([byte[c] for c in token]): i for token, i in vocab.items()}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in plain})

    def ids(self, text: str) -> bytes:
        import numpy as np

        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, salts: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; with_ids adds their ids as bytes (little-endian 32-bit)."""

    def run(batches):
        import os
        import zlib
        from itertools import islice

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = TextTokenizer(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = (x.decode("utf-8") for x in as_bytes(batch.column("text")))
            spread = batch.column("spread").to_pylist()
            rows = zip(batch.column("doc_id").to_pylist(), spread, texts)
            while block := list(islice(rows, 512)):
                out = []
                for doc, salt, text in block:
                    ids = tokenizer.ids(text) + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        out.append((doc, piece, start, length, zlib.crc32(own), (salt + piece) % salts, own))
                columns = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
                keep = len(names) if with_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    spread = F.expr(f"cast(pmod(xxhash64(doc_id, octet_length(text), spark_partition_id()), {salts}) as int)")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), spread.alias("spread")).mapInArrow(run, schema)


def fullest(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Multiset of available (length, count) with the largest sum up to ``room``; bit s of a bitset: sum s is reached.

    Longer lengths are tried first, so sums are made of few long pieces where they can be.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in lengths:
        if length > room:
            continue
        left, power = min(count, room // length), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(power, left)
            wider = (reach | reach << (length * take)) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            power *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins for a histogram of lengths: (combination, how many bins of it)."""
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left, reverse=True)
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest([(x, left[x]) for x in order if left.get(x, 0) > 0], capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins.append((combination, times))
    return bins


def deal(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where ranks go: (length, first rank, first sequence, how many per sequence, offset), in order."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for combination, times in bins:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            out.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return sorted(out)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with length and salt) plus sequence_id and offset; ``salt`` goes."""
    by_salt = pieces.groupBy("length", "salt").count()
    # At most ``capacity`` rows come to the driver; the table below is bounded by combinations of lengths alone.
    counts = {r["length"]: r["count"] for r in by_salt.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    places = deal(minimum_bin_slack(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    names = ranked.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(places, dtype=np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 2] + nth // row[:, 3]
            offset = row[:, 4] + nth % row[:, 3] * length
            columns = [batch.column(n) for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*[n for n in names if n != "rank"], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, ids (bytes, in order), n_tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        pieces = scratch.write(token_pieces(docs, tokenizer_path, salts, capacity, with_ids), "pieces")
        return settle(pack(pieces, capacity))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack_documents(docs, tokenizer_file())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
