"""The corpus operators against SQL, brute force and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import canonical, duck
from pyspark.sql import functions as F

import corpus_pipeline
from plenaria.llm import chat, decontaminate, licenses, line_dedup, packing, quality, secrets, simhash_dedup, substring_dedup, toxicity
from plenaria.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None, partitions=3):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in tables(spark)[0].select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck(SF).execute(ORACLE_SQL[name]).df())


EDGES = [None, "", " ", "\n\n", "a", "word " * 30_000, "same text here", "same text here", "ß é 😀 \x00 \u2028 end", "line\n" * 2000]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with inner ones."""
    rows = [(i, t, None if i % 2 else "en", None, None, i, "x", 1) for i, t in enumerate(EDGES)] + [(None, "no id", "en", "s", 5, 0, "y", 2), (6, "same text here", "en", "s", 14, 0, "z", 3), (6, "other text", "en", "s", 1, 0, "z", 4)]
    return spark.createDataFrame(rows, DOCS + ", kept_id int, runs string, fp int")


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def applied(spark, docs, labels):
    """Every operator on `docs`: name -> rows."""
    import public_tokenizers

    bench = spark.createDataFrame([(1, "same text here and more words"), (None, None)], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = toxicity.fit(docs, labels)
    return {
        "licenses": licenses.scan_licenses(docs), "secrets": secrets.find_secrets(docs), "toxicity": toxicity.score(docs, model),
        "not toxic": toxicity.drop_toxic(docs, model), "substrings": substring_dedup.dedup_substrings(docs), "simhash": simhash_dedup.near_duplicates(docs),
        "similar": simhash_dedup.similar(docs), "lines": line_dedup.dedup_lines(docs), "quality": quality.judge(docs, labels),
        "packing": packing.pack(docs, path), "leaks": decontaminate.leaks(docs, bench), "not leaked": decontaminate.drop_leaked(docs, bench),
        "kept": simhash_dedup.keep_one(docs),
    }


def test_edges(spark, edges, few_labels):
    n = edges.count()
    got = {name: df.count() for name, df in applied(spark, edges, few_labels).items()}
    whole = {"licenses", "secrets", "toxicity", "substrings", "simhash", "similar", "lines", "quality", "not leaked"}
    assert {k: got[k] for k in whole} == dict.fromkeys(whole, n)
    assert got["leaks"] == 0 and got["packing"] > n and 0 < got["kept"] < n


def test_empty_tables(spark, edges, few_labels):
    none = edges.limit(0)
    assert {name: df.count() for name, df in applied(spark, none, few_labels.limit(0)).items()} == dict.fromkeys(applied(spark, none, few_labels.limit(0)), 0)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_extra_columns_pass(spark, edges):
    assert line_dedup.dedup_lines(edges).columns[:8] == edges.columns
    assert simhash_dedup.keep_one(edges).columns == edges.columns


# 1 -------------------------------------------------------------------------------------------------------------------


def test_licenses_find_every_planted_line(spark):
    found = {r["doc_id"]: [x["template"] for x in r["licenses"]] for r in licenses.scan_licenses(tables(spark)[0]).collect()}
    lines = {name: text for name, text in licenses.TEMPLATES.items() if len(text) < 90}
    for doc, text in texts_of(spark).items():
        assert sorted(found[doc]) == sorted(name for name, line in lines.items() if line in text)


def test_license_with_changed_words_and_comment_marks(spark):
    words = licenses.TEMPLATES["mit"].split()
    words[10], words[30] = "OTHER", "CHANGED"
    del words[50]
    text = "int main()\n// " + "\n// ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\ncode"
    row = licenses.scan_licenses(frame(spark, [text, "plain words of no licence at all"])).orderBy("doc_id").collect()
    (hit,) = row[0]["licenses"]
    assert (hit["template"], hit["words"] - hit["matched"]) == ("mit", 3) and row[1]["licenses"] == []
    assert text[hit["start"] : hit["end"]].startswith("Permission is") and text[hit["start"] : hit["end"]].endswith("SOFTWARE.")


def test_license_lines_that_repeat(spark):
    text = "é " + "All rights reserved. " * 300 + "x " * 40 + "Released under the MIT License. All rights reserved."
    (row,) = licenses.scan_licenses(frame(spark, [text], partitions=1)).collect()
    names = [x["template"] for x in row["licenses"]]
    assert names == ["all-rights-reserved"] * 300 + ["mit-line", "all-rights-reserved"]
    assert {text[x["start"] : x["end"]] for x in row["licenses"]} == {"All rights reserved.", "Released under the MIT License."}


def test_license_with_a_paragraph_put_in_and_one_left_out(spark):
    words = licenses.TEMPLATES["mit"].split()
    half = len(words) // 2
    other = [f"own{i}" for i in range(15)] + "Released under the MIT License.".split() + [f"more{i}" for i in range(20)]
    less = words[:half] + words[half + 12 :]
    rows = licenses.scan_licenses(frame(spark, [" ".join(words[:half] + other + words[half:]), " ".join(less)])).orderBy("doc_id").collect()
    assert [(x["template"], x["words"] - x["matched"]) for x in rows[0]["licenses"]] == [("mit", 0), ("mit-line", 0)]
    assert [(x["template"], x["words"] - x["matched"]) for x in rows[1]["licenses"]] == [("mit", 12)]
    assert rows[0]["licenses"][0]["end"] == len(" ".join(words[:half] + other + words[half:]))


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        hashes = rng.integers(0, 50, 40).astype(np.uint64)
        chosen = set(licenses.winnow(hashes, 5).tolist())
        assert all(chosen & set(range(i, i + 5)) for i in range(36))


# 2 -------------------------------------------------------------------------------------------------------------------


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x[2] for x in sorted(out)]


def test_secrets_base_spans(spark):
    rng = random.Random(5)
    bits = ["password", "Token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef" * 4, "secret", "x", "\n", "é", "api_key", "short", "longenough1"]
    made = ["".join(rng.choices(bits, k=12)) for _ in range(400)]
    docs = frame(spark, made)
    for r in secrets.find_secrets(docs).collect():
        assert [f"{p['kind']}:{p['start']}:{p['end']}" for p in r["parts"] if not p["linked"]] == brute_base(made[r["doc_id"]])
    real = texts_of(spark)
    for r in QUERIES["op2_secret_scan"](spark, SF).collect():
        want = brute_base(real[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and r["n_assign"] == sum(x.startswith("assign") for x in want)


def test_weak_parts_only_with_their_complements(spark):
    opaque, url = "Zx9Qw7Er5Ty3Ui1Op0As", "https://db.example.org/v1"
    cases = [f"user: alice {opaque}", opaque, f"user: alice and nothing more {url}", f"user: alice {opaque} at {url}", f"user: alice {'far ' * 100}{opaque}", f"user: alice\n\n{opaque}"]
    got = [[p["kind"] for p in r["parts"]] for r in secrets.find_secrets(frame(spark, cases)).orderBy("doc_id").collect()]
    assert got == [["client", "opaque"], [], [], ["client", "opaque", "endpoint"], [], []]


# 3 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert (both.predicted == both.toxic).mean() > 0.93 and both.score[both.toxic == 1].mean() > both.score[both.toxic == 0].mean() + 0.4


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_spans(ordered, length=100):
    seen, out = set(), []
    for data in ordered:
        mark = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                mark[s : s + length] = 1
            seen.add(piece)
        edge = np.flatnonzero(np.diff(mark[: len(data)], prepend=0, append=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


@pytest.mark.parametrize("often, most", [(1000, 4096), (2, 4096), (1, 7)])
def test_substrings_against_brute_force(spark, often, most):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(50, 900))) for _ in range(12)]
    texts = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 3))] + ["".join(rng.choices("abc", k=rng.randint(0, 120)))]
        texts.append("".join(parts) if i % 9 else rng.choice(["", "a" * 500, "ab" * 300, base[0]]))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(frame(spark, texts, partitions=5), often=often, most=most).collect()}
    want = brute_spans([t.encode() for t in texts])
    assert [[tuple(s) for s in got[i]["spans"]] for i in range(60)] == want
    data = texts[13].encode()
    keep = np.ones(len(data), bool)
    for a, b in want[13]:
        keep[a:b] = False
    assert got[13]["kept"] == np.frombuffer(data, np.uint8)[keep].tobytes()


# 5 -------------------------------------------------------------------------------------------------------------------


def test_simhash_components_against_all_pairs(spark):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op5_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = np.array(sorted(texts))
    fps = np.array([simhash_dedup.fingerprint(texts[i]) for i in ids], np.uint64)
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    assert got == {int(ids[i]): (int(fps[i]), int(ids[find(i)])) for i in range(len(ids))}


def test_golay_keys_meet_for_any_three_errors():
    rng = np.random.default_rng(11)
    words = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    other = words.copy()
    for i in range(len(words)):
        for b in rng.choice(64, i % 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for w in (words, other):
        row, key = simhash_dedup.bucket_keys(w)
        sets = defaultdict(set)
        for r, k in zip(row.tolist(), key.tolist()):
            sets[r].add(k)
        keys.append(sets)
    assert all(keys[0][i] & keys[1][i] for i in range(len(words)))


def test_near_copies_of_shingles(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts, group = [], []
    for g in range(60):
        own = rng.choices(words, k=200)
        for c in range(3):
            copy = list(own)
            for _ in range(c * 2):
                copy[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(copy))
            group.append(3 * g)
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar(frame(spark, texts)).collect()}
    hits = sum(found[i] == group[i] for i in range(len(texts)))
    assert hits >= 0.97 * len(texts)
    assert all(group[i] == group[c] for i, c in found.items())


def jaccard_roots(texts, size=5, similarity=0.8):
    """The smallest index of each text's component over all pairs of exact similarity."""
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_inside_a_family_around_a_hub(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for _ in range(4):
        base = rng.choices(words, k=400)
        for _ in range(40):  # pairs about 0.7 like all others of the family, 0.85 like each other
            own = list(base)
            own[100:160] = rng.choices(words, k=60)
            other = list(own)
            at = rng.randrange(170, 370)
            other[at : at + 28] = rng.choices(words, k=28)
            texts += [" ".join(own), " ".join(other)]
    order = sorted(range(len(texts)), key=lambda i: rng.random())
    texts = [texts[i] for i in order]
    found = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar(frame(spark, texts)).collect()}
    want = jaccard_roots(texts)
    assert len(set(want)) > 60 and sum(found[i] == want[i] for i in range(len(texts))) >= 0.97 * len(texts)
    assert all(want[i] == want[c] for i, c in found.items())


def test_parities_never_refuse_a_near_copy():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400, 5000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for gone in (0, n // 9, n // 5, n // 2):
            sets = [base, np.concatenate([base[gone:], rng.integers(0, 2**64, gone // 3, dtype=np.uint64)])]
            both = len(np.intersect1d(*sets))
            odd = np.stack([np.frombuffer(simhash_dedup.parities(x), np.uint64) for x in sets])
            maybe = simhash_dedup.alike(odd, np.array([len(x) for x in sets]), 0, np.array([1]), 0.8)[0]
            assert maybe or both < 0.8 * (len(sets[0]) + len(sets[1]) - both)


def test_keep_one_row_of_each_group(spark):
    base = {c: " ".join(f"{c}{i}" for i in range(100)) for c in "abcd"}
    near = base["a"] + " end"
    rows = [(1, base["a"], 1), (1, base["a"], 2), (2, base["b"], 3), (2, near, 4), (None, near, 5), (None, base["c"], 6), (None, base["c"], 7), (None, base["d"], 8), (None, base["b"], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"][0], r["text"] == near) for r in simhash_dedup.keep_one(docs).collect())
    assert got == [(0, "c", False), (0, "d", False), (1, "a", False), (2, "b", False)]


# 6 -------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["", "</turn>", "<turn user>", "\\", "\\</turn>\\", "a\nb", "<\\turn", "\\/turn", "</turn", "<turn* x>y</turn>", "\\### Assistant: </turn> ok", "é😀</turn>"]
    roles = ["user", "assistant", "as>si<st\\ant", ""]
    rows = [(c, t, roles[(c + t) % 4], hard[(c * 5 + t) % len(hard)]) for c in range(30) for t in range(4)]
    rows += [(99, 0, None, None), (99, 0, None, None), (None, None, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in range(30):
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["formatted"].count("</turn>") == len(want)
        spans = [got[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[c]["loss_spans"]]
        said = [text for role, text in want if role == "assistant"]
        assert len(spans) == len(said) and all(a == b or "\\" in a for a, b in zip(spans, said))
    assert [tuple(t) for t in got[99]["turns"]] == [("", ""), ("", "")] and got[None]["turns"][0]["text"] == "x"


# 7 -------------------------------------------------------------------------------------------------------------------


def without_runs(texts, words=50):
    """Each text without the runs of lines of `words` words or more that stand at an earlier place, by the definition of a run."""
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for j in range(len(at)):
            n = 0
            for k in range(j, len(at)):
                n += len(re.findall(r"[^\x20\x09-\x0D]+", lines[at[k]]))
                key = tuple(lines[i] for i in at[j : k + 1])
                if n >= words and key in seen:
                    gone |= set(range(at[j], at[k] + 1))
                if n >= words:
                    seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_whole_runs_against_their_definition(spark):
    rng = random.Random(14)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 70))) for _ in range(20)] + ["", "  ", "\t"]
    long, short = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(30))
    twenty = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcde"]
    cases = [f"{long}\n{short}\none", f"{long}\n{short}\ntwo", "\n".join([*twenty, "v w x y z", "one"]), "\n".join(["0", *twenty, "v w x y z", "two"]), f"{long}\n \n{long}", f"0\n{long}\n\n{long}"]
    texts = cases + ["\n".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(80)] + ["\n".join(pool[:6])] * 3
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = without_runs(texts)
    assert [got[i] for i in range(len(texts))] == want and want[1] == "two" and want[3] == "0\ntwo"


def test_whole_runs_count_words_not_spaces(spark):
    indented = "\n".join(" " * 20 + c for c in "{};")
    parted = "\n".join("\t".join(f"{c}{i}" for i in range(30)) for c in "ab")
    texts = [f"{x}\n{n}" for x in (indented, parted) for n in ("one", "two")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == without_runs(texts) == [texts[0], texts[1], texts[2], "two"]


# 8 -------------------------------------------------------------------------------------------------------------------


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_measures(spark):
    rng = random.Random(6)
    made = ["".join(rng.choices(["a", "b", " ", "\n", "#", "é", "\x0b", "\x1c", "<", "aa bb cc "], k=60)) for _ in range(200)] + ["", "\n", "a a a a a a"]
    for text in made:
        assert quality.measure(text.encode())[:5] == brute_measure(text)
    texts = texts_of(spark)
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        words = len(texts[r["doc_id"]].split())
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and r["kept"] in (not r["base_failed"], False) and words


def test_thresholds_bound_false_rejection(spark):
    rng = np.random.default_rng(9)
    assert quality.tail(0, 10, 0.5) == pytest.approx(0.5**10) and quality.tail(10, 10, 0.3) == pytest.approx(1.0)
    wrong = 0
    for _ in range(200):
        good = np.bincount(rng.integers(0, 400, 3000), minlength=400)
        bad = np.bincount(np.minimum(399, rng.integers(300, 400, 500)), minlength=400)
        step = quality.choose(good, bad, 0.02, 0.05)
        wrong += step is not None and (400 - step) / 400 > 0.02
    assert wrong <= 20
    texts = [("w%d " % i) * 1 + " ".join(f"a{i}x{k}" for k in range(80)) for i in range(3000)] + ["## ** " * 20 + " ".join(f"b{i}x{k}" for k in range(60)) for i in range(200)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(len(texts))], "doc_id long, quality int")
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judge(docs, labels).collect()}
    assert all(kept[i][0] for i in range(3000)) and not any(kept[i][0] for i in range(3000, 3200))


# 9 -------------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, texts = Tokenizer.from_file(path), texts_of(spark)
    rows = packing.pack(tables(spark)[0], path, with_ids=True).toPandas().sort_values(["doc_id", "piece"])
    for doc, part in rows.groupby("doc_id"):
        ids = model.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert np.concatenate(part.ids.tolist()).tolist() == ids
        assert part.start.tolist() == list(range(0, len(ids), 2048)) and (part.length.iloc[:-1] == 2048).all()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows.itertuples())
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048
    least = -(-int(rows.length.sum()) // 2048)
    assert rows.sequence_id.nunique() <= least + max(2, 0.01 * least)


def test_configurations_cover_any_histogram():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(0, 12))}
        made: dict[int, int] = defaultdict(int)
        for config, n in packing.configurations(histogram, 100):
            assert sum(k * v for k, v in config.items()) <= 100
            for k, v in config.items():
                made[k] += n * v
        assert dict(made) == histogram


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "It's 3rd l'été", "<|endoftext|> x", "ИК 😀 mixed ABC-def_ghi", "a\x0bb\x85c", "İstanbul ½ 12²", "we've can't 'tis 's", "\u00a0x\u2003y", "don''t !!?? ...", "ǅ ȿ ﬁ"]
    model = Tokenizer.from_file(path)
    assert packing.encoder(path)(texts) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# 10 ------------------------------------------------------------------------------------------------------------------


def brute_tiles(item, doc, k):
    """Greedy string tiling by its definition: covered words."""
    fi, fd, covered = [True] * len(item), [True] * len(doc), 0
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
            return covered
        fi[p : p + n], fd[q : q + n] = [False] * n, [False] * n
        covered += n


def test_tiling_against_its_definition():
    rng = np.random.default_rng(8)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(6, 30)).astype(np.uint64)
        pieces = [rng.integers(1, 6, 5).astype(np.uint64)] + [item[a : a + rng.integers(4, 12)] for a in rng.integers(0, len(item), 3)]
        doc = np.concatenate(pieces)
        seeds = decontaminate.Seeds([item], 4)
        starts = seeds.candidates(doc).get(0)
        found = [] if starts is None else decontaminate.tiles(item, doc, 4, starts)
        assert sum(n for *_, n in found) == brute_tiles(item.tolist(), doc.tolist(), 4)
        assert all((item[p : p + n] == doc[q : q + n]).all() for p, q, n in found)


def test_leaks_whole_reordered_and_in_blocks(spark):
    docs, _, bench = tables(spark)
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = texts_of(spark)
    planted = {(d, i) for d, t in texts.items() for i, b in items.items() if " ".join(b.split()) in " ".join(t.split())}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert planted <= found and len(found) <= len(planted) + 3
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, block=200).collect()} == found
    words = next(t.split() for t in items.values() if len(t.split()) >= 30)
    half = len(words) // 2
    turned = frame(spark, ["x y z " + " ".join(words[half:] + words[:half]), " ".join(words[:8]), "clean text of other words"])
    assert [r["doc_id"] for r in decontaminate.leaks(turned, bench).collect()] == [0]
    assert {r["doc_id"] for r in decontaminate.drop_leaked(turned, bench, block=200).collect()} == {1, 2}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs, labels, bench = tables(spark)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        old = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) >= 0.7 * len(old), name
        if name == "toxicity":
            rows = toxicity.score(before, toxicity.fit(before, labels)).where("score < 0.5")
            assert ids == {r["doc_id"] for r in rows.collect()}
        if name == "decontamination":
            leaked = {r["doc_id"] for r in decontaminate.leaks(before, bench).collect()}
            assert ids == old - leaked
        if name == "line_dedup":
            assert ids == old and after.where(F.char_length("text") != F.col("n_chars")).count() == 0
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == ids


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "piece", "sequence_id", "offset", "length", "ids"} <= set(rows.columns)
