"""Round trips, brute force and defined results of the other operators."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import best_fit_packing as packing
from routeloom.llm import chat_format, decontamination, external_shuffle, quality_rules, toxicity, warc_archive
from routeloom.llm._common import Scratch

TREE = "tree_id long, message_id long, parent_id long, role string, text string, score double"


def test_chat_tree_paths(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "<|im_end|>a<\\|", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "a\n%0A", None, None), (2, 7, 99, None, None, 0.0), (3, 8, 9, "u", "x", 0.0), (3, 9, 8, "u", "y", 0.0)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, TREE))
    got = {(r.tree_id, r.leaf_id): r for r in out.collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 7)}  # a cycle has no path
    assert got[1, 3].branch_rank == 1 and got[1, 4].branch_rank == 2 and got[1, 4].root_id == 1
    turns = chat_format.read_turns(out).where("leaf_id = 4").orderBy("turn").collect()
    assert [(t.role, t.text) for t in turns] == [("user", "q"), ("assistant", "<|im_end|>a<\\|"), ("a\n%0A", "")]
    assert {r.leaf_id: r.loss_text for r in chat_format.masked_text(out, chat_format.read_turns(out)).collect()} == {3: "b", 4: "<|im_end|>a<\\|"}
    assert chat_format.format_conversations(spark.createDataFrame([], TREE)).count() == 0


@pytest.mark.parametrize("branches", [None, 1, 2])
def test_chat_forests_equal_plain_python(spark, branches):
    random.seed(11)
    rows = []
    for tree in (1, 2, None):
        for k in range(40):
            parent = random.choice([None, 77, *range(k)]) if k else None
            rows.append((tree, k, parent, random.choice(["user", "assistant", None]), random.choice(["", "a", None, "<|im_end|>é", "x\n" * 50]), random.choice([None, 0.0, 1.0, 2.0])))
    want = []
    for tree in (1, 2, None):
        nodes = {r[1]: r for r in rows if r[0] == tree}
        leaves = [k for k in nodes if not any(r[2] == k for r in nodes.values())]
        paths = []
        for leaf in leaves:
            path = [leaf]
            while nodes[path[0]][2] in nodes:
                path.insert(0, nodes[path[0]][2])
            paths.append((path[0], sum(nodes[k][5] or 0.0 for k in path) / len(path), leaf, path))
        for root in {p[0] for p in paths}:
            own = sorted((p for p in paths if p[0] == root), key=lambda p: (-p[1], p[2]))
            for rank, (_, score, leaf, path) in enumerate(own[:branches], 1):
                masked = [nodes[k][4] or "" for k in path if nodes[k][3] == "assistant"]
                want.append((str(tree), leaf, root, rank, round(score, 9), [(nodes[k][3] or "", nodes[k][4] or "") for k in path], masked))
    out = chat_format.format_conversations(spark.createDataFrame(rows, TREE).repartition(4), branches=branches)
    turns = {}
    for r in chat_format.read_turns(out).orderBy("turn").collect():
        turns.setdefault((str(r.tree_id), r.leaf_id), []).append((r.role, r.text))
    import re

    got = []
    for r in out.collect():
        masked = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        got.append((str(r.tree_id), r.leaf_id, r.root_id, r.branch_rank, round(r.branch_score, 9), turns[(str(r.tree_id), r.leaf_id)], masked))
    assert sorted(got) == sorted(want) and len(got) > 6


def test_chat_deep_chain(spark):
    rows = [(1, i, i - 1 or None, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(1, 71)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, TREE))
    assert [t.text for t in chat_format.read_turns(out).orderBy("turn").collect()] == [f"t{i}" for i in range(1, 71)]


def test_chat_query(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    rows += [{"conv_id": -1, "turn": i, "role": r, "text": chat_format.SPECIMEN} for i, r in enumerate(("user", "assistant"))]
    want = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r.conv_id: r for r in chat_format.op1_chat_formatting(spark, sf).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality_counts(spark, corpus, documents):
    import re

    def want(doc, text):
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        return doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    got = quality_rules.base_counts(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted((want(*r) for r in corpus), key=str)


def test_quality_bound_is_exact(spark):
    from math import comb

    rows = [(k, n) for n in (50, 400) for k in (0, 1, 3)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)


def tail(k, n, rate):
    from math import comb

    return sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def plain_settings(good, max_rejection=quality_rules.MAX_REJECTION, risk=quality_rules.RISK):
    """The strictest joint setting for each stratum, in plain Python; ``good``: stratum and signals."""
    rows = {}
    for stratum, *signals in good:
        rows.setdefault(stratum, []).append(dict(zip(quality_rules.CUTOFFS, signals)))
    level = risk / max(1, len(rows))
    small = {s for s, own in rows.items() if (1 - max_rejection) ** len(own) > level}
    out = {}
    for stratum in rows:
        own = [x for s in (small if stratum in small else {stratum}) for x in rows[s]]
        out[stratum] = -1
        for t, setting in enumerate(quality_rules.PATH):
            if tail(sum(any(x[k] > c for k, c in setting.items()) for x in own), len(own), max_rejection) > level:
                break
            out[stratum] = t
    return out


def test_quality_settings_equal_plain_python(spark):
    random.seed(2)
    draw = lambda share: 0.25 if random.random() < share else 0.0
    good = [("en", draw(0.03), 5.0, 0.0) for _ in range(1500)] + [("de", draw(0.001), 8.5 if random.random() < 0.02 else 5.0, 0.0) for _ in range(900)]
    good += [(s, draw(0.0), 5.0, 0.0) for s in ("xx", None, "yy") for _ in range(100)]
    for rows in (good, good[-100:], good[:1500]):
        df = spark.createDataFrame(rows, f"lang string, {', '.join(f'{c} double' for c in quality_rules.CUTOFFS)}")
        got = {r.stratum: r.setting for r in quality_rules.risk_controlled_settings(df, "lang").collect()}
        assert got == plain_settings(rows)
    assert got["en"] >= 0 and plain_settings(good)["xx"] == len(quality_rules.PATH) - 1 and plain_settings(good[-100:])["yy"] == -1


def test_quality_guarantee_by_simulation():
    """A setting that truly rejects more than the bound is chosen at most as often as the risk allows."""
    rng = np.random.default_rng(5)
    n, rate, risk = 1200, quality_rules.MAX_REJECTION, quality_rules.RISK
    wrong = sum(tail(int(k), n, rate) <= risk for k in rng.binomial(n, rate * 1.001, 2000))
    assert wrong / 2000 <= risk * 1.2


def test_quality_verdicts_equal_plain_python(spark):
    """Whole query at two sizes: kept follows the settings, and the method rejects beyond the base rules."""
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        out = quality_rules.apply_quality_rules(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
        rows = [r.asDict() for r in out.collect()]
        quality, texts = {}, {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
        for r in spark.read.parquet(f"{path}/labels.parquet").collect():
            quality[r.doc_id] = min(quality.get(r.doc_id, 1), r.quality)
        good = {texts[r["doc_id"]]: (r["lang"], *[r[c] for c in quality_rules.CUTOFFS]) for r in rows if quality.get(r["doc_id"]) == 1 and not r["base_failed"]}
        chosen = plain_settings(list(good.values()))
        for r in rows:
            setting = quality_rules.PATH[chosen[r["lang"]]] if chosen.get(r["lang"], -1) >= 0 else {}
            assert r["kept"] == (not r["base_failed"] and not any(r[k] > c for k, c in setting.items()))
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 10


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ordinary, toxic = rows[rows.toxic == 0], rows[rows.toxic == 1]
    print("held out:", len(toxic), toxic.predicted.sum(), len(ordinary), ordinary.predicted.sum())
    assert ordinary.predicted.mean() <= 0.01
    # About 0.64 of the toxic rows of the calibration fold hold an insult at all.
    assert toxic.predicted.mean() >= 0.5
    assert rows.score.rank()[rows.toxic == 1].mean() > rows.score.rank()[rows.toxic == 0].mean() + 0.4 * len(rows)


def test_shuffle_keeps_every_row(spark, corpus, documents):
    docs = documents.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1)).withColumn("bucket", F.lit(2))
    with Scratch(spark) as scratch:
        rows = external_shuffle.shuffle_into_shards(docs, f"{scratch.path}/out", shards=7, bucket_bytes=64 << 10).collect()
    assert sorted(((r.record.doc_id, r.record.text) for r in rows), key=str) == sorted(corpus, key=str)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_warc(spark, tmp_path):
    pages = [(3, "u\r\nX: y", "<p>é"), (1, "v", "<p>é"), (1, "v", "<p>é"), (None, "w", "<p>é"), (7, "n", None), (8, "e", ""), (9, None, "z"), (None, "q", "only")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc_archive.op6_warc_archive(spark, str(tmp_path)).collect()
    b32 = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(
        [("1", 5, b32("<p>é"), "response", None), ("1", 5, b32("<p>é"), "revisit", 1), ("3", 5, b32("<p>é"), "revisit", 1), ("None", 5, b32("<p>é"), "revisit", 1)]
        + [("7", 0, b32(""), "response", None), ("8", 0, b32(""), "revisit", 7), ("9", 1, b32("z"), "response", None), ("None", 4, b32("only"), "response", None)],
        key=str,
    )


def test_warc_headers_are_valid_and_ids_unique(spark, tmp_path):
    pages = [(k % 7, f"http://h/{k}", f"<p>{k % 4}") for k in range(60)] + [(None, "u", "<p>1"), (-3, "v", "<p>2"), (-3, "v", "<p>2")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    warc_archive.write_archive(frame, str(tmp_path / "a"), date="2020-02-03T04:05:06Z")
    rows = warc_archive.read_records(spark, str(tmp_path / "a")).collect()
    assert len(rows) == len(pages) and spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    records = {}
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Date"] == "2020-02-03T04:05:06Z"
        assert rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
        records[fields["WARC-Record-ID"]] = fields
    assert len(records) == len(pages)
    for fields in records.values():
        if fields["WARC-Type"] == "revisit":
            assert records[fields["WARC-Refers-To"]]["WARC-Type"] == "response"
            assert records[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
    assert sum(f["WARC-Type"] == "response" for f in records.values()) == 4


def least_distance(p, t):
    """Edit distance of p to the closest part of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for x in t:
        new = [0]
        for j, y in enumerate(p, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    random.seed(8)
    letters = "abcd  e"
    word = lambda n: "".join(random.choices(letters, k=n))
    items = [(k, word(random.choice([1, 2, 8, 12, 13, 20, 30, 60]))) for k in range(40)] + [(90, None), (91, ""), (92, "  "), (3, "again and again, the same id")]
    docs = []
    for k in range(80):
        text = list(word(40) + (random.choice(items[:40])[1]) + word(30))
        for _ in range(random.randrange(5)):
            at = random.randrange(40, len(text) - 20)
            text[at : at + random.randrange(2)] = random.choice(["", "x", "ab"])
        docs.append((k, "".join(text)))
    docs += [(200 + k, items[k][1]) for k in range(6)] + [(300, None), (301, ""), (302, "very long " * 3000 + "ab")]
    want = []
    clean = lambda t: decontamination.normalise((t or "").encode())
    for doc, text in docs:
        for item, pattern in items:
            t, p = clean(text), clean(pattern)
            budget = int(len(p) * decontamination.ERROR_RATE)
            if not budget:
                if p and p == t:
                    want.append((doc, item, 0))
            elif len(t) < 5000 and (d := least_distance(p, t)) <= budget:
                want.append((doc, item, d))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    with pytest.warns(UserWarning, match="too short"):
        rows = decontamination.find_contamination(d, i).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == sorted(want)
    texts = {doc: clean(text) for doc, text in docs}
    patterns = {item: clean(t) for item, t in items[:40] if item != 3}
    for r in rows:
        if r.item_id in patterns:
            assert least_distance(patterns[r.item_id], texts[r.doc_id][r.match_start : r.match_end]) == r.distance
    assert sum(r.distance > 0 for r in rows) > 5


def test_shuffle_query(spark):
    """Sizes, checksums and the law of the whole query, and a slot for every row."""
    path = "/root/testdata/sf0.01"
    rows = external_shuffle.op4_external_shuffle(spark, path).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_bucket_offsets(spark):
    counts = {b: (b * 7) % 5 + 1 for b in range(0, 90, 3)}
    with Scratch(spark) as scratch:
        offsets, n = external_shuffle.bucket_offsets(scratch, spark.createDataFrame(list(counts.items()), "bucket long, count long"), group=8)
        got = {r.bucket: r.before for r in offsets.collect()}
    assert n == sum(counts.values()) and got == {b: sum(c for o, c in counts.items() if o < b) for b in counts}


def test_edit_matching(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards box with daft zombies tonight"
    edited = item.replace("quick", "quikc").replace("zombies", "zombis")
    docs = [(1, f"a b {item.upper()} c"), (2, f"x {edited} y"), (3, "nothing here"), (4, None), (5, ""), (2, f"x {edited} y")]
    items = [(10, item), (11, ""), (12, None), (13, item)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination.find_contamination(d, i, block_bytes=64).collect()))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 10, 0), (1, 13, 0)] + [(2, 10, 3), (2, 10, 3), (2, 13, 3), (2, 13, 3)]
    assert sorted(r.doc_id for r in decontamination.without_contamination(d, i).collect()) == [3, 4, 5]
    assert decontamination.find_contamination(d.limit(0), i).count() == 0


def test_myers_is_edit_distance():
    random.seed(3)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            row = [i] + row
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return min(row)

    for _ in range(300):
        p, t = ("".join(random.choices("abc", k=random.randrange(1, 12))) for _ in range(2))
        assert decontamination.myers(decontamination.place_bits(p), len(p), t)[0] == plain(p, t)


def test_packing(spark, corpus, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_file())
    more = [(9100, "a <|endoftext|> b<|endoftext|>"), (9101, "very long " * 200_000), (9102, "x" * 300_000)]
    corpus, documents = corpus + more, documents.unionByName(spark.createDataFrame(more, documents.schema))
    want = {}
    for doc, text in corpus:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        for piece, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.setdefault((str(doc), piece), []).append((s, n, zlib.crc32(ids[s : s + n].tobytes())))
    rows = packing.pack_documents(documents, packing.tokenizer_file(), with_ids=True)
    got = {}
    for r in rows.collect():
        got.setdefault((str(r.doc_id), r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    bins = {}
    for r in rows.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = 0
        for at, n in sorted(places):
            assert at == ends
            ends += n
        assert ends <= 1024
    total = sum(r.length for r in rows.collect())
    assert len(bins) <= -(-total // 1024) * 1.02 + 2
    assert packing.packed_sequences(rows).agg(F.sum("n_tokens")).first()[0] == total


@pytest.mark.parametrize("fast", [True, False])
def test_ids_are_the_librarys(tmp_path, fast):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(packing.tokenizer_file(), encoding="utf-8").read())
    if not fast:  # ids out of merge order
        vocab = spec["model"]["vocab"]
        a, b = list(vocab)[-2:]
        vocab[a], vocab[b] = vocab[b], vocab[a]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    library, ours = Tokenizer.from_file(str(tmp_path / "t.json")), packing.TextTokenizer(str(tmp_path / "t.json"))
    assert (ours.fast is not None) == fast
    random.seed(3)
    parts = [*"abéßзЖ中ي \n\t  '.,#12½²\x01 　’\x85\x1c\x0b\xa0😀", "<|endoftext|>", "<|endof", "'s", "'ll", " a", "…", "   ", "\u0301", " the", "ing"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randrange(14)))
        assert np.frombuffer(ours.ids(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_fullest_is_optimal():
    from itertools import product

    random.seed(4)
    for _ in range(200):
        lengths = sorted({random.randrange(1, 12): random.randrange(1, 4) for _ in range(4)}.items(), reverse=True)
        room = random.randrange(1, 30)
        best = max(s for s in (sum(n * length for n, (length, _) in zip(c, lengths)) for c in product(*[range(k + 1) for _, k in lengths])) if s <= room)
        chosen = packing.fullest(lengths, room)
        assert sum(k * v for k, v in chosen.items()) == best and all(v <= dict(lengths)[k] for k, v in chosen.items())


def test_toxicity_lower_orders_are_counted_over_all_documents(spark):
    texts = ["bramble brambly", "tremble trembling", "bumble crumble grumble", "Scramble ramble brambled", None, "gamble gambler bramble", "дом домой 漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    letters = toxicity.sample_letters(docs, {0: 0, 1: 1, 6: 0})
    assert set(letters) == set("bramley" + "tremblin" + "g" + "домой漢字")
    table, n_codes = toxicity.letter_table(letters), toxicity.CODES
    assert len({int(table[ord(x)]) for x in letters}) == len(letters) and table[ord("z")] == toxicity.OTHER
    (keys, own), middle = toxicity.gram_counts(docs, {0: 0, 1: 1, 6: 0}, table)
    of = lambda some, order: toxicity.grams(sorted({w for t in some if t for w in t.lower().split()}), order, table)[0]
    sample = [texts[0], texts[1], texts[6]]
    assert set(keys.tolist()) == set(of(sample, 6).tolist()) and own.sum() == sum(len(of([t], 6)) for t in sample)
    grams, contexts = set(of(texts, 6).tolist()), {k // n_codes for k in of(sample, 6).tolist()}
    for order in (5, 4, 3):
        count = {}
        for g in grams:
            count[g % n_codes**order] = count.get(g % n_codes**order, 0) + 1
        grams = set(count)
        needed = {c % n_codes ** (order - 1) for c in contexts}
        keys, n, once = middle[order]
        assert dict(zip(keys.tolist(), n.tolist())) == {g: m for g, m in count.items() if g // n_codes in needed}
        assert once == tuple(sum(m == k for m in count.values()) for k in (1, 2, 3, 4))


def test_toxicity_equals_plain_kneser_ney():
    """Ratios of words against a recursive definition, and probabilities that sum to one."""
    from collections import Counter

    random.seed(6)
    words = ["".join(random.choices("abcд", k=random.randrange(1, 7))) for _ in range(300)]
    sides, every = (words[:90], words[60:200]), words
    table = toxicity.letter_table(list("abcд"))
    n_codes, high, low = toxicity.CODES, toxicity.HIGH, toxicity.LOW
    coded = lambda w: [toxicity.BOUNDARY] * (high - 1) + [int(table[ord(x)]) for x in w] + [toxicity.BOUNDARY]
    tuples = lambda w: [tuple(coded(w)[i : i + high]) for i in range(len(w) + 1)]
    top = [Counter(g for w in side for g in tuples(w)) for side in sides]
    number = lambda g: sum(c * n_codes ** (len(g) - 1 - i) for i, c in enumerate(g))
    grams, counts = {g for w in every for g in tuples(w)}, {}
    for order in range(high - 1, low - 1, -1):
        counts[order] = Counter(g[1:] for g in grams)
        grams = set(counts[order])
    keys = np.array(sorted({number(g) for c in top for g in c}))
    own = np.array([[{number(g): n for g, n in c.items()}.get(k, 0) for k in keys.tolist()] for c in top])
    often = lambda c: tuple(sum(n == k for n in c.values()) for k in (1, 2, 3, 4))
    middle = {}
    for order, c in counts.items():
        listed = sorted((number(g), n) for g, n in c.items())
        middle[order] = (np.array([k for k, _ in listed]), np.array([n for _, n in listed]), often(c))
    model = toxicity.kneser_ney(table, (keys, own), middle)

    def p(side, g):
        if len(g) < low:
            return 1 / n_codes
        c = top[side] if len(g) == high else counts[len(g)]
        after = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not after:
            return p(side, g[1:])
        taken, size = toxicity.discounts(*often(c)), sum(after.values())
        kept = {x: max(n - taken[min(n, 3)], 0) / size for x, n in after.items()}
        return kept.get(g, 0.0) + (1 - sum(kept.values())) * p(side, g[1:])

    some = words[:20] + ["zz", "aбa", "d"]
    want = [sum(np.log(p(1, g)) - np.log(p(0, g)) for g in tuples(w)) for w in some]
    assert np.allclose(model.ratios(some), want)
    assert sum(p(0, (*tuples("abca")[3][:-1], x)) for x in range(n_codes)) == pytest.approx(1)


def test_toxicity_never_reads_held_out_labels(spark, tmp_path):
    """Scores stay the same whatever the held-out rows' labels say."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.record.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, other))
    assert one == two
