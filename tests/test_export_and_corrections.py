"""One ordered CSV file byte for byte; counts under corrections in any order; language profiles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenaria.functions import columns, language
from plenaria.registry import QUERIES
from plenaria.sources import export
from plenaria.streaming import corrections


def test_one_csv_byte_for_byte(spark, tmp_path):
    rows = [(3, 'a "quoted", value', 0.5, True, None), (1, "line\nbreak", 2.0, False, "é"), (2, None, None, None, "\r"), (4, "", 1e-7, True, " x "), (5, "plain;'", -3.0, None, "🙂")]
    df = spark.createDataFrame(rows, "`n,o` int, text string, x double, flag boolean, other string").repartition(3).orderBy(F.desc("n,o"))
    path = f"{tmp_path}/export.csv"
    export.write_one_csv(df, path)
    want = '﻿"n,o",text,x,flag,other\n5,plain;\',-3,,🙂\n4,,1.0E-7,1, x \n3,"a ""quoted"", value",0.5,1,\n2,,,,"\r"\n1,"line\nbreak",2,0,é\n'
    with open(path, "rb") as f:
        assert f.read() == want.encode()
    assert [p.name for p in tmp_path.iterdir()] == ["export.csv"]
    with pytest.raises(Exception, match="FileExistsError"):
        export.write_one_csv(df, path, overwrite=False)
    export.write_one_csv(df.limit(0), path)
    with open(path, "rb") as f:
        assert f.read() == '﻿"n,o",text,x,flag,other\n'.encode()


def test_many_parts_keep_their_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_one_csv(spark.range(20_000).repartition(5).orderBy(F.desc("id")), f"{tmp_path}/big.csv")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = (tmp_path / "big.csv").read_text(encoding="utf-8").splitlines()
    assert lines[0] == "﻿id" and list(map(int, lines[1:])) == list(range(19_999, -1, -1))


def test_an_aborted_export_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        export.write_one_csv(bad, f"{tmp_path}/x.csv")
    assert list(tmp_path.iterdir()) == []


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, corrections.VERSIONS).coalesce(1).write.parquet(f"{folder}/in/{name}")


@pytest.mark.parametrize("keep", [None, "4000 days"])
def test_corrections_in_any_order_equal_the_batch_result(spark, tmp_path, keep):
    some, start = random.Random(4), datetime(2024, 1, 1)
    versions = [(f"s{some.randrange(6)}", some.randrange(8), f"2020-0{some.randint(1, 3)}-01", some.choice(["Fish", "Tax", None]), start + timedelta(hours=some.randrange(300)), v) for v in range(160)]
    stream = spark.readStream.schema(corrections.VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for nth in range(2):
        for part in range(2):
            put(spark, tmp_path, f"{nth}{part}", versions[nth * 80 + part * 40 :][:40])
        got = corrections.run_corrections(spark, stream, str(tmp_path), keep)
        newest: dict = {}
        for s, order, day, topic, at, v in versions[: nth * 80 + 80]:
            newest[s, order] = max(newest.get((s, order), (datetime.min, 0, "", "")), (at, v, day, topic or ""))
        want: dict = {}
        for *_, day, topic in newest.values():
            if topic:
                want[day, topic] = want.get((day, topic), 0) + 1
        assert {(r["day"], r["topic"]): r["n"] for r in got.collect()} == want
    again = corrections.run_corrections(spark, stream, str(tmp_path), keep)
    assert {(r["day"], r["topic"]): r["n"] for r in again.collect()} == want


def test_sittings_are_forgotten_by_timers(spark, tmp_path):
    """After `keep` without a change a sitting is forgotten; its counts stay."""
    stream = spark.readStream.schema(corrections.VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    for name, row in enumerate([("s1", 1, "2020-01-01", "Fish", day(0), 1), ("s2", 1, "2020-01-02", "Tax", day(40), 2), ("s2", 1, "2020-01-02", "Fish", day(45), 3), ("s1", 1, "2020-01-01", "Tax", day(1), 4)]):
        put(spark, tmp_path, str(name), [row])
        got = corrections.run_corrections(spark, stream, str(tmp_path), "10 days")
    assert {(r["day"], r["topic"]): r["n"] for r in got.collect()} == {("2020-01-01", "Fish"): 1, ("2020-01-02", "Fish"): 1}
    assert isinstance(got.toPandas(), pd.DataFrame)


def brute_profile(texts, top, longest):
    found: dict = {}
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            for size in range(1, longest + 1):
                for i in range(len(word) + 3 - size):
                    gram = f" {word} "[i : i + size]
                    if gram != " ":
                        found[gram] = found.get(gram, 0) + 1
    return sorted(found, key=lambda g: (-found[g], g))[:top]


def test_profiles_equal_brute_force(spark):
    said = [("A", "abba aab ab, aab 12"), ("A", "Abba! baa"), ("B", "bcb cbc_bcd"), ("B", "bcd"), (None, "zzz"), ("C", None), ("D", "äö öä")]
    scorer = language.profiles(spark.createDataFrame(said, "language string, text string"), top=12, longest=3)
    known = {c: brute_profile([t for k, t in said if k == c], 12, 3) for c in "ABD"}
    texts = ["ab ab bcb", "bcd", "öö", "xyz", "", None, "aab " * 500, "bcb abba"]
    for text, code, confidence in zip(texts, *(scorer(pd.Series(texts))[c] for c in ("language", "confidence"))):
        own = brute_profile([text or ""], 12, 3)
        far = {c: sum(abs(i - p.index(g)) if g in p else 12 for i, g in enumerate(own)) for c, p in known.items()}
        if not any(g in p for g in own for p in known.values()):
            assert (code, confidence) == (None, 0.0)
        else:
            assert code == min(far, key=lambda c: (far[c], c)) and abs(confidence - (1 - far[code] / max(1, sorted(far.values())[1]))) < 1e-12
    assert language.profiles(spark.createDataFrame([], "language string, text string"))(pd.Series(["a"]))["language"].isna().all()


def test_profiles_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["lang_profiles"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(held) > 150 and sum(r.language == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_chunks_of_all_texts_are_scored_in_one_call(spark):
    calls = []
    scorer = lambda texts: calls.append(len(texts)) or language.frequent_words(texts)
    texts = ["the cat and the hat of that house " * 60, None, "", "le chat est dans la maison que " * 40, "x" * 3000]
    assert language.votes(texts, scorer) == [language.vote(t) for t in texts] and len(calls) == 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert language.decide(docs, "t")._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 2
    scripts = ["Καλημέρα σας κυρίες και κύριοι", "Καλημέρα", "short", "Добър ден на всички, приятели мои", "a" * 50 + "Добър" * 4, "a" * 46 + "Добър" * 4, "\u00a0" * 30, None, "Добър ден на Καλημέρα Καλημέρα"]
    rows = spark.createDataFrame([(t,) for t in scripts], "t string").select("t", columns.script_language("t").alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in rows] == [language.script_of(t) for t in scripts]
