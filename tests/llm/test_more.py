"""The corpus operators' values at edges, and against brute force written without them."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import brute_measure, brute_spans, frame, texts_of, without_runs

import corpus_pipeline
from plenaria.llm import chat, decontaminate, licenses, line_dedup, packing, quality, secrets, shared, simhash_dedup, substring_dedup, toxicity
from plenaria.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LONG = "xy" * 500_000
EDGES = [None, "", " ", "\n\n", "a", "word " * 30_000, "same text here", "same text here", "ß é 😀 \x00 \u2028 end", "line\n" * 2000, LONG, LONG + " x", "\x01\x7f\x1c ctrl\x1b", "İ ǅ 'Ɓ-Ɔ!Ə", "x\ty\x0bz\r\nw"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def docs(spark):
    """The edges twice (repeated rows), one without an id, and columns whose names clash with inner ones."""
    rows = [(i, t, "en", "s", 0, i, "x", 1, "y", 2) for i, t in enumerate(EDGES)]
    rows += [(6, "same text here", "en", "s", 14, 0, "z", 3, "y", 2), (None, "no id", None, None, None, 0, "y", 2, "z", 1)]
    extra = ", kept_id int, runs string, fp int, parts string, length int"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).repartition(3)


def by_id(df, *columns):
    """doc_id -> columns of its rows, which must be alike."""
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).add(tuple(r[c] for c in columns))
    assert all(len(v) == 1 for v in out.values())
    return {k: next(iter(v)) for k, v in out.items()}


TEXTS = dict(enumerate(EDGES)) | {None: "no id"}


def test_edges_of_one_text_operators(spark, docs, model):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {k: v[0] for k, v in by_id(licenses.scan_licenses(docs).withColumn("n", F.size("licenses")), "n").items()} == dict.fromkeys(TEXTS, 0)
    assert {k: v[0] for k, v in by_id(secrets.find_secrets(docs).withColumn("n", F.size("parts")), "n").items()} == dict.fromkeys(TEXTS, 0)
    got = by_id(quality.judge(docs, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept")
    for i, t in TEXTS.items():
        words = len(re.findall(WORD, t or ""))
        if words < 5000:
            want = brute_measure(t or "")
            assert got[i] == (*want, want[0] >= 50 and 2 * want[4] <= want[0]), t
    assert got[5][0] == got[5][4] == 30_000 and not got[5][5] and got[9][3] == 1999
    score = by_id(toxicity.score(docs, toxicity.fit(docs, labels)), "score")
    assert {round(v[0], 9) for v in score.values()} == {round(1 / 3, 9)}
    rows = packing.pack(docs, model[0], with_ids=True).orderBy("doc_id", "piece").collect()
    ids = {}
    for r in rows:
        ids.setdefault((r["doc_id"], r["start"]), []).append(r["ids"])
    for i, t in TEXTS.items():
        want = model[1].encode(t or "", add_special_tokens=False).ids + [0]
        pieces = [want[a : a + 2048] for a in range(0, len(want), 2048)]
        assert [ids[i, 2048 * k] for k in range(len(pieces))] == [[p] * (2 if i == 6 else 1) for p in pieces]


def test_edges_of_dedup(spark, docs):
    few = docs.where("doc_id is null or doc_id not in (5, 10, 11)")
    order = sorted((i for i in TEXTS if i not in (5, 10, 11)), key=lambda i: (i is None, i or 0))
    got = by_id(substring_dedup.dedup_substrings(few).withColumn("s", F.to_json("spans")), "s")
    want = brute_spans([(TEXTS[i] or "").encode() for i in order])
    assert {i: got[i][0] for i in order} == {i: "[" + ",".join(f'{{"start":{a},"end":{b}}}' for a, b in spans) + "]" for i, spans in zip(order, want)}
    whole = by_id(substring_dedup.dedup_substrings(docs).withColumn("n", F.size("spans")).withColumn("k", F.octet_length("kept")), "n", "k")
    # A text of period 2 keeps its first two bytes, one of period 5 its first five, and LONG's repetition what was added to it.
    assert whole[10] == whole[11] == (1, 2) and whole[5] == (1, 5)
    got = by_id(line_dedup.dedup_lines(docs), "text")
    want = without_runs(["" if TEXTS[i] is None else TEXTS[i] for i in order if i != 9])
    assert {i: got[i][0] or "" for i in order if i != 9} == dict(zip([i for i in order if i != 9], want)) and got[0][0] is None
    assert got[10][0] == LONG
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3}.isdisjoint(left) and {0, 4, 5, 6, 10, None} <= left and 7 not in left and kept.count() == len(left)


def test_edges_of_the_pipeline(spark, docs, tmp_path):
    """All stages on the edges, and on empty tables."""
    for name, part in (("full", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "same text here and more words")] if name == "full" else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            made = function(spark, now, folder)
            made.write.parquet(f"{folder}/{stage}")
            now = spark.read.parquet(f"{folder}/{stage}")
            if stage != "packing":
                assert now.columns == docs.columns
        got = {(r["doc_id"], r["piece"]) for r in now.collect()}
        assert (got == set()) == (name == "none")
        if name == "full":
            assert {i for i, _ in got} == {0, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, None}


def test_session_settings_of_its_own_are_left_alone(spark):
    spark.conf.set(corpus_pipeline.BATCH, "10000")
    corpus_pipeline._whole_texts(spark)
    assert spark.conf.get(corpus_pipeline.BATCH) == "10000"
    spark.conf.unset(corpus_pipeline.BATCH)


# 1 -------------------------------------------------------------------------------------------------------------------


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_license_coverage_against_all_subsequences(spark):
    rng = random.Random(21)
    bare = lambda text: [w for w in (x.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in text.split()) if w]
    long = [n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 50]
    made, want = [], []
    for i in range(40):
        name = rng.choice(long)
        rate = rng.choice([0.0, 0.03, 0.08, 0.45])
        words, out = licenses.TEMPLATES[name].split(), []
        for w in words:
            x = rng.random()
            out += [] if x < rate / 3 else [f"q{rng.randrange(10**6)}"] if x < 2 * rate / 3 else [w, f"z{rng.randrange(10**6)}"] if x < rate else [w]
        text = " ".join([*(f"pre{i}x{k}" for k in range(rng.randint(0, 30))), *out, *(f"post{i}x{k}" for k in range(rng.randint(0, 30)))])
        made.append(text)
        matched, size = subsequence(bare(licenses.TEMPLATES[name]), bare(text)), len(bare(licenses.TEMPLATES[name]))
        want.append((name, matched, size) if matched >= 0.8 * size else None)
    got = {r["doc_id"]: [(x["template"], x["matched"], x["words"]) for x in r["licenses"] if x["template"] in long] for r in licenses.scan_licenses(frame(spark, made)).collect()}
    assert [got[i] for i in range(40)] == [[w] if w else [] for w in want] and any(w is None for w in want)
    with pytest.raises(ValueError):
        licenses.scan_licenses(frame(spark, made), {"short": "two words"})


# 2 -------------------------------------------------------------------------------------------------------------------


def test_endpoints_against_their_pattern():
    pattern = re.compile(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+""", re.I | re.A)
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choices(["a", "9", "+", ".", "://", ":", "/", " ", "\n", "'", "http", "K", "é", "x9"], k=rng.randint(1, 25)))
        assert [m.span() for m in pattern.finditer(text)] == [x[:2] for x in secrets.endpoints(text)]


def test_secrets_take_linear_time():
    for text in ("user: x " + "a1" * 500_000 + "://x", "user: a " + "A9" * 500_000, "user: a " + "://" * 300_000, "token" + " " * 1_000_000, "a:/" * 300_000 + "user: x", "\n \n" * 300_000, "AKIA" * 250_000):
        start = time.time()
        base = secrets.base_parts(text)
        secrets.linked(text, base, secrets.weak_parts(text, base), 200)
        assert time.time() - start < 5


def test_linked_spans_against_all_pairs(spark):
    rng = random.Random(31)
    bits = ["user: alice", "login=bob99", "Zx9Qw7Er5Ty3Ui1Op0As", "https://db.example.org/v1", "password=longenough1", "AKIA" + "ABCD" * 4, "deadbeef" * 4, "plain", "\n\n", "\n", "far " * 20, "some words"]
    made = [" ".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]
    roles = secrets.ROLE
    for r in secrets.find_secrets(frame(spark, made), reach=60).collect():
        text = made[r["doc_id"]]
        base = secrets.base_parts(text)
        everything = base + secrets.weak_parts(text, base)
        scope = lambda at: len([m for m in re.finditer(r"\n[ \t\r]*\n", text) if m.start() <= at])  # noqa: B023, E731
        want = set()
        for s, e, kind in everything:
            near = {roles[k] for a, b, k in everything if scope(a) == scope(s) and a <= e + 60 and b >= s - 60}
            if kind in secrets.NEEDS and set(secrets.NEEDS[kind]) <= near:
                want.add((s, e, kind))
        assert {(p["start"], p["end"], p["kind"]) for p in r["parts"] if p["linked"]} == want


# 3 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_model_against_counts_of_all_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = texts_of(spark)
    rows = [(texts[r["doc_id"]], int(r["toxic"])) for r in labels.collect() if r["doc_id"] in texts and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    counts, n = np.zeros((2, toxicity.LEVELS << toxicity.BITS)), [0, 0]
    for text, label in rows:
        counts[label, toxicity.features(toxicity.grams(text))] += 1
        n[label] += 1
    clean, toxic = counts
    share = clean / n[0], toxic / n[1]
    both = (clean + toxic) / sum(n)
    spread = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    z = np.abs(share[1] - share[0]) / np.where(spread > 0, spread, np.inf)
    ratio = np.log((toxic + 1) / (n[1] + 2)) - np.log((clean + 1) / (n[0] + 2))
    ids = np.sort(np.lexsort((np.arange(len(z)), -z))[: min(500, (z >= 3).sum())])
    made = toxicity.fit(docs, labels, kept=500)
    assert made.ids.tolist() == ids.tolist()
    held = [np.flatnonzero(np.isin(ids, toxicity.features(toxicity.grams(t)))) for t, _ in rows]
    weights, intercept = toxicity.regress(held, np.array([y for _, y in rows], float), {1: n[1], 0: n[0]}, ratio[ids], 1e-4, 300)
    assert np.allclose(made.weights, weights * ratio[ids], atol=1e-4) and abs(made.intercept - intercept) < 1e-4


def test_no_labelled_document_falls_through_the_sieve(spark):
    ids = [int(x) for x in np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 3000)]
    known = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    for most in (25, 11):
        bits, sieve = toxicity._sieve(known, len(ids), most)
        hold = lambda x: np.logical_and(*(sieve[m >> 3] >> (7 - (m & 7)) & 1 for m in toxicity._marks(np.array(x, np.int64), bits)))  # noqa: B023, E731
        assert hold(ids).all() and (most < 25 or hold(range(20_000)).mean() < 0.05)


# 4 -------------------------------------------------------------------------------------------------------------------


def test_suffix_ranks_order_bytes():
    rng = np.random.default_rng(5)
    for length in (1, 3, 8, 100, 130):
        data = rng.integers(97, 99, 700).astype(np.uint8)
        data[200:420] = data[10:230]
        rank = substring_dedup.ranks(data, length)
        padded = data.tobytes() + bytes(length)
        strings = [padded[i : i + length] for i in range(len(data))]
        order = {s: i for i, s in enumerate(sorted(set(strings) | {padded[len(data) : len(data) + length]}))}
        got = np.array([order[s] for s in strings])
        assert (np.argsort(rank, kind="stable") == np.argsort(got, kind="stable")).all() and ((rank[1:] == rank[:-1]) == (got[1:] == got[:-1])).all()


def test_substrings_of_a_common_passage_in_many_contexts(spark):
    rng = random.Random(17)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    texts = ["".join(rng.choices("abcdefghij", k=rng.randint(0, 150))) + passage + "".join(rng.choices("abcdefghij", k=rng.randint(0, 150))) for _ in range(80)]
    want = brute_spans([t.encode() for t in texts])
    for often in (1, 10**6):
        got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring_dedup.dedup_substrings(frame(spark, texts, partitions=4), often=often).collect()}
        assert [got[i] for i in range(80)] == want


def test_frequent_triggers_are_never_missed(spark):
    """A trigger of one occurrence a document, in many small partitions, is hot although each task has few."""
    rng = random.Random(3)
    common = "".join(rng.choices("abcdefgh", k=120))
    texts = ["".join(rng.choices("ijklmnop", k=150)) + common + "".join(rng.choices("ijklmnop", k=150)) for _ in range(200)]
    docs = substring_dedup._ordered(frame(spark, texts, partitions=20))
    found = {r["trigger"] for r in substring_dedup.hot_triggers(substring_dedup.parse(docs, 100, 24), 100).collect()}
    inside = [int(t) for _, trigger, _, _ in substring_dedup.triggers(common.encode(), 100, 24) for t in trigger.view(np.int64)]
    assert set(inside) <= found


@pytest.mark.parametrize("size", [95, 105, 150, 260])
def test_no_group_of_a_common_passage_is_large(spark, monkeypatch, size):
    """A passage in 2,000 documents with different surroundings: whatever is compared together has at most a twentieth of all pieces, and results stay."""
    rng = random.Random(size)
    passage = "".join(rng.choices("abcdefgh ", k=size))
    texts = ["".join(rng.choices("abcdefghij", k=120)) + passage + "".join(rng.choices("abcdefghij", k=120)) for _ in range(2000)]
    made, kind = [], type(spark.range(1))
    repartition = kind.repartition

    def noted(df, *keys):
        if keys == ("trigger", "salt"):
            made.append(df)
        return repartition(df, *keys)

    monkeypatch.setattr(kind, "repartition", noted)
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring_dedup.dedup_substrings(frame(spark, texts, partitions=4)).collect()}
    groups = [r["count"] for r in made[-1].where("n = 0").groupBy("trigger", "salt").count().collect()]
    assert max(groups) <= 0.05 * sum(groups)
    seen: set[bytes] = set()
    for i, text in enumerate(t.encode() for t in texts):
        mark = np.zeros(len(text) + 1, np.int64)
        for at in range(len(text) - 99):
            piece = text[at : at + 100]
            if piece in seen:
                mark[at], mark[at + 100] = mark[at] + 1, mark[at + 100] - 1
            seen.add(piece)
        edge = np.flatnonzero(np.diff((np.cumsum(mark[:-1]) > 0).astype(np.int8), prepend=0, append=0))
        assert found[i] == list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# 5 -------------------------------------------------------------------------------------------------------------------


def test_fingerprints_bit_by_bit(spark):
    texts = texts_of(spark) | {-1: "One two", -2: "", -3: "É A\x0bB c\x1cd e"}
    rows = simhash_dedup.fingerprints(frame(spark, list(texts.values()), list(texts))).collect()
    for r in rows[:150] + [x for x in rows if x["doc_id"] < 0]:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])
        words = re.findall(WORD, text)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert r["fp"] % 2**64 == want


def test_components_of_hubs_split_skewed_joins(spark):
    old = {}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        old[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        n = 300_000
        i = F.col("id")
        small_hub = spark.range(n).select((i + 10).alias("u"), F.when(i % 2 == 0, 1).otherwise(i - i % 7).cast("long").alias("v"))
        large_hub = spark.range(n).select(F.when(i % 2 == 0, 10**7).otherwise(i + 10).cast("long").alias("u"), (i - i % 7).alias("v"))
        for edges, large in ((small_hub, True), (large_hub, False)):
            rows = shared.star_step(edges, large).groupBy().count()
            rows.collect()
            assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
        pairs = small_hub.limit(3000).select(F.col("u").alias("a"), F.col("v").alias("b"))
        roots = {r["node"]: r["root"] for r in shared.components(pairs).collect()}
        parent = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for r in pairs.collect():
            a, b = sorted((find(r["a"]), find(r["b"])))
            parent[b] = a
        assert all(root == find(node) for node, root in roots.items())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_whole_groups_end_where_keys_change():
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 40, 5000))
    key[1000:3000] = key[1000]
    key = np.sort(key)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 37]), pa.array(np.arange(i, min(len(key), i + 37)))], ["k", "n"]) for i in range(0, len(key), 37)]
    tables = [t.to_pydict() for t in shared.whole_groups(iter(batches), ["k"], 100)]
    assert [n for t in tables for n in t["n"]] == list(range(5000)) and len(tables) > 10
    assert all(a["k"][-1] != b["k"][0] for a, b in zip(tables, tables[1:]))


# 8 -------------------------------------------------------------------------------------------------------------------


def test_binomial_tails_by_their_terms():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((10, 3, "1/2"), (50, 0, "1/200"), (400, 1, "1/200"), (400, 9, "1/50"), (60, 55, "3/10"), (60, 60, "1/7")):
        q = Fraction(p)
        want = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))
        assert quality.tail(k, n, float(q)) == pytest.approx(float(want), rel=1e-9)
    start = time.time()
    assert 0 < quality.tail(4_990_000, 10**9, 0.005) < 0.01 and time.time() - start < 1


def test_cutoffs_against_all_steps():
    rng = np.random.default_rng(12)
    for _ in range(60):
        good = np.bincount(rng.integers(0, rng.integers(20, 50), rng.integers(200, 5000)), minlength=50)
        bad = np.bincount(rng.integers(rng.integers(0, 30), 50, rng.integers(0, 600)), minlength=50)
        limit, level = rng.choice([0.005, 0.02, 0.1]), rng.choice([0.001, 0.05])
        passing = [s for s in range(50) if all(good[c:].sum() <= limit * good.sum() and quality.tail(int(good[c:].sum()), int(good.sum()), limit) <= level for c in range(s, 50))]
        most = max((int(bad[s:].sum()) for s in passing), default=0)
        want = max((s for s in passing if bad[s:].sum() == most), default=None) if most else None
        assert quality.choose(good, bad, limit, level) == want


# 9 -------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer_everywhere(model):
    encode = packing.encoder(model[0])
    contexts = ["{}", "a{}", "{}a", "'{}", "-{}", "!{}", "{}'s", "9{}9", "x {} y", "é{}", "{}\u0301", "<|{}"]
    texts = [c.format(chr(x)) for x in range(1, 0x250) for c in contexts]
    rng = random.Random(1)
    for i in range(20_000):
        text = "".join(chr(rng.randint(1, 0x24F)) if rng.random() < 0.6 else rng.choice(" '-!\n\x00aAsSREtTΣσ\u0301😀<|") for _ in range(rng.randint(1, 25)))
        texts.append(text + "<|endoftext|>" + text + "<|ENDOFTEXT|>" if i % 50 == 0 else text)
    texts.append("z" * 300_000)
    want = [np.array(x.ids, "<u4").tobytes() for x in model[1].encode_batch(texts, add_special_tokens=False)]
    got = [y for i in range(0, len(texts), 256) for y in encode([t.encode() for t in texts[i : i + 256]])]
    assert got == want


def test_the_program_carries_the_packing():
    rng = np.random.default_rng(3)
    lengths = np.clip(np.exp(rng.normal(5.4, 1.1, 40_000)).astype(int) + 1, 1, 2048)
    for many in (1, 50):
        histogram = {int(k): int(v) * many for k, v in zip(*np.unique(lengths, return_counts=True))}
        bound = -(-sum(k * v for k, v in histogram.items()) // 2048)
        made = sum(n for _, n in packing.configurations(histogram))
        plain = sum(n for _, n in packing.best_fit(histogram, 2048))
        assert bound <= made <= min(plain, bound * 1.0005 + 1)
    random_ = random.Random(1)
    for _ in range(40):
        histogram = {random_.randint(1, 100): random_.randint(1, 50) for _ in range(random_.randint(0, 12))}
        assert sum(n for _, n in packing.configurations(histogram, 100)) <= sum(n for _, n in packing.best_fit(histogram, 100))


# 10 ------------------------------------------------------------------------------------------------------------------


def all_tiles(item, doc, k):
    """Greedy string tiling by its definition, with its tiles in order."""
    fi, fd, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and fi[p + n] and fd[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < k:
            return out
        fi[p : p + n], fd[q : q + n] = [False] * n, [False] * n
        out.append((p, q, n))


def test_tiles_in_order():
    rng = np.random.default_rng(18)
    for _ in range(1500):
        words, k = int(rng.integers(2, 7)), int(rng.integers(3, 6))
        item = rng.integers(1, words, rng.integers(6, 36)).astype(np.uint64)
        doc = np.concatenate([rng.integers(1, words, 5).astype(np.uint64)] + [item[a : a + rng.integers(4, 14)] for a in rng.integers(0, len(item), rng.integers(1, 5))])
        starts = decontaminate.Seeds([item], k).candidates(doc).get(0)
        assert ([] if starts is None else decontaminate.tiles(item, doc, k, starts)) == all_tiles(item.tolist(), doc.tolist(), k)


def test_blocks_of_items_leave_the_same_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    twice = docs.union(docs.limit(20)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    whole, parts = (sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in decontaminate.drop_leaked(twice, bench, block=b).collect()) for b in (1_000_000, 300))
    assert whole == parts and len(whole) < twice.count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaked(docs, bench.limit(0)).count() == docs.count()


def test_chat_at_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, None, LONG), (3, None, "assistant", "</turn>" * 1000)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("assistant", ""), ("assistant", "")]
    assert got[2]["turns"][0]["text"] == LONG and got[3]["turns"][0]["text"] == "</turn>" * 1000


def test_digests_are_of_the_kept_bytes(spark):
    texts = texts_of(spark)
    order = sorted(texts)
    want = dict(zip(order, brute_spans([texts[i].encode() for i in order])))
    for r in QUERIES["op4_suffix_array_dedup"](spark, SF).collect():
        data = texts[r["doc_id"]].encode()
        keep, at = b"", 0
        for a, b in want[r["doc_id"]]:
            keep, at = keep + data[at:a], b
        keep += data[at:]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), len(data) - len(keep), len(want[r["doc_id"]]), hashlib.sha256(keep).hexdigest())
