"""The whole pipeline, row by row, against plain Python; the toxicity scores alone are taken as given."""

import collections
import random
import zlib

import numpy as np
from test_dedup import LAST, jaccard, rank

import corpus_pipeline
from routeloom.llm import best_fit_packing as packing
from routeloom.llm import decontamination, toxicity

WINDOW = 50


def one_of_each_group(rows):
    """Of each group of links the rows that no smaller doc_id stands for, rows of one id once."""
    out, seen = [], set()
    for (doc, text), (_, n, component) in zip(rows, jaccard(rows)):
        if n and doc is not None and (doc != component or doc in seen):
            continue
        if n:
            seen.add(doc)
        out.append((doc, text))
    return out


def without_passages(rows):
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - WINDOW + 1):
            least[b[i : i + WINDOW]] = min(least.get(b[i : i + WINDOW], LAST), rank(doc))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - WINDOW + 1):
            if least[b[i : i + WINDOW]] < rank(doc):
                gone[i : i + WINDOW] = b"\1" * WINDOW
        out.append((doc, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def holds(text, pattern):
    """Whether a part of the text is within the item's budget of edits, looked for at every place."""
    budget = int(len(pattern) * decontamination.ERROR_RATE)
    if not budget or not text:
        return bool(pattern) and pattern == text
    return decontamination.myers(decontamination.place_bits(pattern), len(pattern), text)[0] <= budget


def pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_file())
    out = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]
    return out


def test_run_equals_plain_python(spark, corpus, tmp_path):
    random.seed(11)
    insults = "you vile grubface snotling wretch"
    rows = corpus + [(9000 + k, " ".join([*random.sample(corpus[k][1].split(), min(20, len(corpus[k][1].split()))), *random.sample(insults.split(), 4)])) for k in range(90)]
    passage = corpus[100][1][20:140]
    items = [(1, passage[:60] + "~" + passage[60:]), (2, corpus[150][1][:90].upper()), (3, "found nowhere at all in these texts"), (4, None), (5, "")]
    rows.append((9200, f"Question: {passage} and what follows it"))
    labels = [(9000 + k, 0, 1) for k in range(90)] + [(doc, 1, 0) for doc, _ in corpus[:300]]
    docs = spark.createDataFrame([(doc, text, "en", "s", len(text or "")) for doc, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, marks, carry=["doc_id", "text"])
    rejected = {(r.record.doc_id, r.record.text) for r in scored.where("predicted = 1").collect()}
    kept = [[r for r in rows if r not in rejected]]
    kept.append(one_of_each_group(kept[-1]))
    kept.append(without_passages(kept[-1]))
    clean = lambda t: decontamination.normalise((t or "").encode())
    patterns = [clean(p) for _, p in items]
    kept.append([(doc, text) for doc, text in kept[-1] if not any(holds(clean(text), p) for p in patterns)])
    sizes = [len(rows), len(kept[0]), len(kept[1]), len(kept[3])]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    assert sum(len(t or "") for _, t in kept[2]) < sum(len(t or "") for _, t in kept[1])

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == collections.Counter(pieces(kept[-1]))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= packing.CAPACITY
    assert len(bins) <= -(-sum(r.length for r in got) // packing.CAPACITY) * 1.02 + 2
