"""Ranked search, language identification and whitening: against brute force written without them, and at edges."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.llm import language_id, ranked_search, whitening
from plenaria.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked = set(terms(text))
        found = []
        for doc, count, n in held:
            m = 50 + 50 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * count[t] // (1000 * count[t] + 20 * m)) for t in asked if t in count)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Documents of frequent and rare words with copies, ties, nulls and a very long one; items that ask for both."""
    some = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "ÉCOLE", "é", "x9"]
    text = lambda n: " ".join(some.choice(words[: some.choice([5, 20, 65])]) for _ in range(n))
    docs = [(i, text(some.randint(1, 40))) for i in range(400)]
    docs += [(400 + i, "W1 w2-W3, w64.É") for i in range(30)] + [(7, docs[7][1])] * 2 + [(None, docs[3][1]), (None, "w1"), (500, None), (501, ""), (502, "?! \x00"), (503, text(20_000)), (504, "only")]
    items = [(1, text(8)), (2, "É w1 w1 W1"), (3, None), (4, ""), (5, "nowhere"), (None, "w5 only"), (1, "w2 ß"), (2, "É w1 w1 W1"), (6, text(60)), (7, "ONLY x9 É")]
    return docs, items


@pytest.mark.parametrize(("k", "block", "segment"), [(50, 10**6, 10**6), (3, 10**6, 200), (1, 40, 50), (7, 20, 10**6), (5000, 10**6, 300)])
def test_ranks_equal_brute_force(spark, corpus, k, block, segment):
    docs, items = corpus
    frame = spark.createDataFrame([(t, i, i, 1.5) for i, t in docs], "text string, doc_id long, rank int, score double").repartition(3)
    asked = spark.createDataFrame([(t, i, "q") for i, t in items], "text string, item_id long, doc_id string")
    assert made(ranked_search.search(frame, asked, k, block, segment)) == brute_ranks(docs, items, k)


def test_search_stops_early_and_completes(monkeypatch):
    """Far fewer postings than there are, and yet the very best: the stop is proved, not guessed."""
    some = np.random.default_rng(2)
    n, vocabulary = 5_000, 40
    sizes = some.integers(5, 400, n)
    often = 1 / np.arange(1, vocabulary + 1) / (1 / np.arange(1, vocabulary + 1)).sum()
    numbers = [np.sort(some.choice(vocabulary, some.integers(1, 12), replace=False, p=often)).astype(np.int32) for _ in range(n)]
    counts = [some.integers(1, 9, len(x)).astype(np.int32) for x in numbers]
    weights = (1000 * np.log(40 / np.arange(40, 0, -1)) + 50).astype(np.int64)
    stats = ranked_search.Corpus(n, int(sizes.sum()), weights)
    index = ranked_search.Segment(sizes, [x.tobytes() for x in numbers], [x.tobytes() for x in counts], stats)
    m = 50 + 50 * sizes * n // stats.length
    completed, matching = [], 0
    whole = ranked_search.Segment.complete
    monkeypatch.setattr(ranked_search.Segment, "complete", lambda self, rows, asked: completed.append(len(rows)) or whole(self, rows, asked))
    for q in range(40):
        asked = np.sort(some.choice(vocabulary, 1 + q % 6, replace=False))
        exact = np.array([sum(int(weights[t]) * (10**9 * int(c) // (1000 * int(c) + 20 * int(m[d]))) for t, c in zip(numbers[d].tolist(), counts[d].tolist()) if t in asked) for d in range(n)])
        before = len(completed)
        rows, scores = index.search(asked, 10)
        matching += int((exact > 0).sum()) * (len(completed) - before)
        assert (exact[rows] == scores).all()
        kth = np.sort(exact)[-10]
        assert set(np.flatnonzero(exact > kth)) <= set(rows.tolist()) and set(np.flatnonzero(exact == kth)) <= set(rows.tolist())
    assert len(completed) > 10 and sum(completed) < 0.3 * matching


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, items).collect() == []
    assert ranked_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), items).collect() == []


def test_search_equals_sql(spark):
    from conftest import canonical, duck

    mine = QUERIES["op11_ranked_search"](spark, SF).toPandas()
    assert canonical(mine) == canonical(duck(SF).execute(ORACLE_SQL["op11_ranked_search"]).df())


def brute_bundle(text):
    spelled = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    spelled = " " + " ".join(spelled.split()) + " "
    out = np.zeros(language_id.DIMENSIONS, np.int64)
    if spelled.strip():
        for a, b, c in zip(spelled, spelled[1:], spelled[2:]):
            v = [language_id.vector(0 if x == " " else ord(x)).astype(np.int64) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


TEXTS = ["The cat, the hat.", None, "", "12 34 ?!", "a", "Ünïcode  ÉCOLE\n\nß", "ǅ İstanbul", "日本語のテキスト漢字仮名交じり文", "x" * 300, "mixed 日本 and λόγος 😀 end", "the the the"]


def test_bundles_equal_brute_force():
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    for texts in (TEXTS, TEXTS[:5], [], [None, "?"], [*TEXTS, wide, wide[::-1]]):
        spelled = [language_id.spelled(t or "") for t in texts]
        found = language_id.Trigrams(spelled).bundled(np.arange(len(texts)), len(texts))
        assert (found == np.array([brute_bundle(t) for t in texts]).reshape(len(texts), language_id.DIMENSIONS)).all()
    owner = np.arange(len(TEXTS)) % 3
    found = language_id.Trigrams([language_id.spelled(t or "") for t in TEXTS]).bundled(owner, 3)
    assert (found == [sum(brute_bundle(t) for t, o in zip(TEXTS, owner) if o == i) for i in range(3)]).all()


def test_languages_equal_brute_force(spark):
    """Prototypes of all taught texts, cosine, argmax; nulls, ties by name, clashing columns, repeated rows."""
    rows = [(i, t, lang, 0.5, "x") for i, (t, lang) in enumerate([*((t, "en") for t in TEXTS), ("das ist der Hut und die Katze", "de"), ("der die das", "de"), ("le chat est sur la table", "fr"), ("la table", None), (None, "fr")])]
    rows += [(3, "12 34 ?!", "zz", 0.5, "x"), (None, "der Hut", "de", 0.1, None), rows[-3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    langs, profiles = language_id.prototypes(docs)
    bundle = {x: sum(brute_bundle(t) for _, t, lang, *_ in rows if lang == x) for x in ("de", "en", "fr")}
    one = np.array([v / np.linalg.norm(v) for v in bundle.values()])
    one = one - one.mean(0)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    assert langs == ["de", "en", "fr"] and np.allclose(profiles, one)
    for r in language_id.identify(docs, langs, profiles).collect():
        texts = [t for i, t, *_ in rows if i == r.doc_id]
        v = brute_bundle(texts[0])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            cosine = one @ (v / np.linalg.norm(v))
            assert r.lang_pred == langs[int(cosine.argmax())] and abs(r.score - max(0, cosine.max())) < 1e-9
    none = language_id.identify(docs, *language_id.prototypes(docs.where("lang is null")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and none.count() == len(rows)
    assert language_id.identify(docs.limit(0), langs, profiles).collect() == []
    alone = language_id.identify(docs, *language_id.prototypes(docs.where("lang = 'de'")))
    assert {r.lang_pred for r in alone.collect()} == {"de", "und"}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r.doc_id: r.lang for r in docs}
    found = QUERIES["op12_language_id"](spark, SF).collect()
    assert len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 3, 2, 1] + [0.5] * 15, [9, 0, 0, 0], [3], [4, 4], [0, 0, 0], [10, 9, 8] + [0] * 40, list(np.linspace(1, 1.01, 50)), [1e-9, 1e-10, 0]])
def test_lanczos(values):
    """Repeated eigenvalues, also more often than the block is wide, low rank, none at all, and close ones."""
    some = np.random.default_rng(3)
    d = len(values)
    turn = np.linalg.qr(some.standard_normal((d, d)))[0]
    matrix = turn @ np.diag(values) @ turn.T
    for width in (1, 4, 8):
        found, vectors = whitening.lanczos(lambda q: matrix @ q, d, 4, width)
        want = np.sort(values)[::-1][:4]
        assert np.allclose(found, want, rtol=1e-12, atol=1e-13 * max(1e-300, max(values)))
        assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * found, rtol=0, atol=1e-12 * max(values) + 1e-300)


def test_lanczos_needs_few_passes():
    some = np.random.default_rng(4)
    values = np.r_[100, 70, 50, 30, some.random(296)]
    turn = np.linalg.qr(some.standard_normal((300, 300)))[0]
    passes = []
    found, _ = whitening.lanczos(lambda q: passes.append(q.shape[1]) or turn @ (values[:, None] * (turn.T @ q)), 300, 4)
    assert np.allclose(found, [100, 70, 50, 30]) and len(passes) < 15


def check_whitening(df, rows, k=4, tolerance=1e-9):
    """Against the covariance matrix, from rows (vec_id, vector) that all count."""
    found = {(r.vec_id, r.component): r for r in df.collect()}
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(0)
    mean = np.array([int(s) / n for s in sums])
    centred = fit.astype(float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert {c for _, c in found} == set(range(1, len(values) + 1)) and len(found) == len({i for i, _ in rows}) * len(values)
    for c in range(len(values)):
        mine = np.array([found[i, c + 1].whitened for i, _ in rows])
        want = (x.astype(float) - mean) @ vectors[:, c] / math.sqrt(values[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < tolerance
        one = found[rows[0][0], c + 1]
        assert abs(one.explained - values[c] / (centred**2).sum() * n) < 1e-9 and one.identity_error < tolerance and one.n == n
    for (i, _), v in zip(rows, x):
        assert int(found[i, 1].deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))


def test_whitening_equals_the_covariance(spark):
    some = np.random.default_rng(6)
    base = some.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, [400.0] * 12), (2001, [-3e5] + [0.0] * 11)]
    bad = [(None, [0.5] * 12, 1), (3000, None, 1), (3001, [None] + [0.0] * 11, 1), (3002, [float("nan")] + [0.0] * 11, 1), (3003, [float("-inf")] + [0.0] * 11, 1), (3004, [1.0] * 5, 1), (3005, [], 1)]
    frame = spark.createDataFrame([(i, v, 2) for i, v in rows] + bad[1:], "vec_id long, embedding array<float>, n int").repartition(5)
    check_whitening(whitening.whiten(frame), rows, tolerance=1e-7)
    nameless = whitening.whiten(frame.union(spark.createDataFrame(bad[:1], frame.schema)))
    assert nameless.where("vec_id is null").count() == 4
    huge = spark.createDataFrame([(i, [s * 1e30 for s in v]) for i, v in rows[:20]], "vec_id long, embedding array<float>")
    got = whitening.whiten(huge)
    assert got.count() == 80 and got.select(F.max("identity_error")).first()[0] < 1e-6


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], kind)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    check_whitening(whitening.whiten(spark.createDataFrame([(i, [i / 3]) for i in range(5)], kind)), [(i, [i / 3]) for i in range(5)])


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_embedding_whitening"](spark, SF), rows)
