"""The three dedup operators against brute force."""

import collections
import hashlib

import pytest

from routeloom.llm import ngram_join, substring_dedup, suffix_dedup
from routeloom.llm import runs as runs_module
from routeloom.llm._common import Scratch

LAST = 2**63 - 1


def rank(doc):
    return LAST if doc is None else doc


@pytest.mark.parametrize("hot_runs", [2, 8])
def test_suffix_dedup(spark, corpus, documents, run_bytes, hot_runs):
    window, least = 50, {}
    for doc, text in corpus:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            least[b[i : i + window]] = min(least.get(b[i : i + window], LAST), rank(doc))
    want = []
    for doc, text in corpus:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < rank(doc):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((doc, len(b), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest()))
    with Scratch(spark) as scratch:
        rows = suffix_dedup.remove_repeats(scratch, documents, hot_runs=hot_runs).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [64, 7])
def test_substring_dedup(spark, corpus, documents, run_bytes, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HASH_BITS", bits)
    window, count = 35, collections.Counter()
    words = [(text or "").encode().split() for _, text in corpus]
    for w in words:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for (doc, _), w in zip(corpus, words):
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [1] * window
        want.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    with Scratch(spark) as scratch:
        rows = substring_dedup.remove_substrings(scratch, documents).collect()
        name = "strong_" if bits < 64 else ""
        found = spark.read.parquet(f"{scratch.path}/{name}checked").collect()
    got = [(r.doc_id, r.n_words, sum(s.length for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Every factor is a copy: its words stand at its source, and it isn't its own source.
    assert all(r.equal for r in found)
    texts, sources = collections.defaultdict(list), {(r.source_run, r.source_word, r.length): r for r in found}
    for (doc, _), w in zip(corpus, words):
        texts[doc].append(w)
    n = 0
    for r in rows:
        for f in r.factors:
            source = sources[f.source_run, f.source_word, f.length]
            own = {tuple(w[f.start : f.start + f.length]) for w in texts[r.doc_id]}
            assert f.length >= window and own & {tuple(w[source.source_start : source.source_start + f.length]) for w in texts[source.source_id]}
            assert (source.source_id, source.source_start) != (r.doc_id, f.start) or len(texts[r.doc_id]) > 1
            n += 1
    assert n > 100


def test_messages_grow_with_keys():
    """Twice the runs and parts, with the same keys in all: no more messages than keys, and the same values heard."""
    import numpy as np

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    for runs in (10, 100, 1000, 100_000):
        parts, bodies = runs_module.sent(keys, runs_module.short_key(keys), runs // 2)
        assert len(parts) <= min(runs // 2, len(keys)) and (np.diff(parts) > 0).all()
        body = runs_module.Bodies(bodies)
        assert (body.joined(np.uint32) == runs_module.short_key(keys)).all() and body.sizes(np.uint32).sum() == len(keys)


def test_many_runs_need_no_more_buckets(spark, corpus, documents, monkeypatch):
    monkeypatch.setattr(runs_module, "MAX_BUCKETS", 5)
    whole, many = [], []
    for run_bytes, out in ((4 << 20, whole), (2 << 10, many)):
        defaults = runs_module.Runs.__init__.__defaults__
        monkeypatch.setattr(runs_module.Runs.__init__, "__defaults__", (*defaults[:-1], run_bytes))
        with Scratch(spark) as scratch:
            staged = runs_module.Runs(scratch, documents)
            assert run_bytes > 1 << 20 or staged.count > 100
            out += [(r.doc_id, r.n_words, bytes(r.kept)) for r in substring_dedup.remove_substrings(scratch_of(spark, scratch), documents).collect()]
    assert sorted(whole, key=str) == sorted(many, key=str)


def scratch_of(spark, scratch):
    """Another scratch folder that goes with ``scratch``."""
    other = Scratch(spark)
    other.path = f"{scratch.path}/other"
    return other


def jaccard(corpus):
    sets = []
    for _, text in corpus:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    having = collections.defaultdict(list)
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        overlap = collections.Counter(j for x in own for j in having[x])
        for j, n in overlap.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in own:
            having[x].append(i)
    first = {}
    for i, (doc, _) in enumerate(corpus):
        if doc is not None:
            first[find(i)] = min(first.get(find(i), doc), doc)
    return [(doc, len(sets[i]), first.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(corpus)]


def test_ngram_join(spark, corpus, documents, run_bytes, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16 if run_bytes < 1 << 20 else 1024)
    with Scratch(spark) as scratch:
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(scratch, documents).collect()]
    assert sorted(got, key=str) == sorted(jaccard(corpus), key=str)


def test_ngram_join_counts_every_link(spark, corpus, documents, run_bytes, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16 if run_bytes < 1 << 20 else 1024)
    monkeypatch.setattr(ngram_join, "SIDE", 8 if run_bytes < 1 << 20 else 256)
    monkeypatch.setattr(ngram_join, "WIDTH", 64 if run_bytes < 1 << 20 else 4096)
    sets = []
    for _, text in corpus:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n_links = [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                n_links[i] += 1
                n_links[j] += 1
    with Scratch(spark) as scratch:
        rows = ngram_join.jaccard_components(scratch, documents, count_links=True).collect()
    want = [(*row, n) for row, n in zip(jaccard(corpus), n_links)]
    assert max(n_links) > 20
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows], key=str) == sorted(want, key=str)


def test_suffixes_of_one_gram_go_to_many_parts():
    """Every document holds the same line of 30 characters, each in a context of its own."""
    import random

    import numpy as np
    import pyarrow as pa

    random.seed(3)
    parts, runs = 20, []
    for run in range(10):
        around = ["".join(random.choices("abcdefghij", k=80)) for _ in range(400)]
        texts = [a[:40] + "one line that all texts hold." + a[40:] for a in around]
        runs.append(runs_module.Documents(pa.table({"doc_id": pa.array(range(run, 4000, 10)), "text": texts})))
    keys = [np.unique(suffix_dedup.sampled(docs.texts)[2]) for docs in runs]
    n_runs = collections.Counter(k for own in keys for k in own.tolist())
    largest = {}
    for hot_runs in (8, 999):
        sizes = np.zeros(3 * parts, dtype=np.int64)
        for docs, own in zip(runs, keys):
            heard = runs_module.packed(np.array([len(own)]), np.array([n_runs[k] for k in own.tolist()], dtype=np.uint8))
            found = suffix_dedup.Suffixes(docs, {suffix_dedup.KINDS: runs_module.Bodies(heard)}, parts, hot_runs)
            sizes += np.bincount(found.part, minlength=3 * parts)
        largest[hot_runs] = sizes.max() / (sizes.sum() / (sizes > 0).sum())
    assert largest[8] < 2 < 5 < largest[999]


def test_loser_tree():
    import random

    random.seed(1)
    for n in (1, 2, 3, 7):
        runs = [sorted({bytes(random.choices(b"ab", k=6)) for _ in range(random.randrange(12))}) for _ in range(n)]

        def shares(a, b):
            return next((i for i in range(6) if a[i] != b[i]), 6)

        source, prefix = suffix_dedup.merge(runs, [[0, *map(shares, r, r[1:])][: len(r)] for r in runs], 6)
        at, out = [0] * n, []
        for s in source:
            out.append(runs[s][at[s]])
            at[s] += 1
        assert out == sorted(x for r in runs for x in r)
        assert prefix[1:] == list(map(shares, out, out[1:]))
