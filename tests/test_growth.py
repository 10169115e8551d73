"""Work that grows no faster than the input: what is compared, carried and held in queries that grew too fast."""

from __future__ import annotations

import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from plenaria.functions import language, pages, transcripts
from plenaria.operators import relational as R
from plenaria.operators.containment import contained
from plenaria.plans import mart, stored
from plenaria.registry import QUERIES
from plenaria.settings import BATCH_BYTES
from plenaria.sources import export
from plenaria.streaming import corrections


def _compared(spark, monkeypatch):
    """An accumulator of the pairs of sets that are compared."""
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b):
        seen.add(1)
        return len({*a} & {*b}) / max(len({*a} | {*b}), 1)

    monkeypatch.setattr(R, "jaccard", F.udf(counted, "double"))
    return seen


def test_agenda_by_words_compares_few_pairs(spark, monkeypatch):
    seen = _compared(spark, monkeypatch)
    rows = spark.range(400).select("id", F.lit("1996-01-01").alias("activity_date"), F.lit(None).cast("string").alias("docIdentifier"), F.concat(F.lit("fishing water policy p"), "id").alias("label"))
    topics = rows.where("id % 2 = 0").select("activity_date", "docIdentifier", F.concat("label", F.lit(" debate")).alias("title"))
    got = {r.id: r.title for r in R.match_agenda(rows, topics).collect()}
    assert got == {i: f"fishing water policy p{i} debate" if i % 2 == 0 else None for i in range(400)}
    assert 0 < seen.value < 2_000  # all pairs: 80,000


def test_most_alike_equals_all_pairs(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7)))
    rows = [(i, f"d{i % 3}", text().upper() if i % 5 else None) for i in range(150)]
    topics = [(f"d{i % 4}", None, text()) for i in range(60)] + [(None, None, "a b"), ("d0", None, None)]
    score = lambda a, b: len(a & b) / max(len(a | b), 1)
    for least in (0.3, 0.6, 1.0):
        got = R.match_agenda(spark.createDataFrame(rows, "id long, activity_date string, label string").withColumn("docIdentifier", F.lit(None).cast("string")), spark.createDataFrame(topics, "activity_date string, docIdentifier string, title string"), least)
        expected = {}
        for i, day, label in rows:
            alike = [(score({*(label or "").lower().split()}, {*title.split()}), title) for d, _, title in topics if d == day and title is not None]
            expected[i] = max((x for x in alike if x[0] >= least), default=(0, None))[1]
        assert {r.id: r.title for r in got.collect()} == expected


def test_agenda_by_document_compares_no_pair_of_other_sizes(spark, monkeypatch):
    seen = _compared(spark, monkeypatch)
    rows = spark.range(400).select("id", F.lit("1996-01-01").alias("activity_date"), F.col("id").cast("string").alias("docIdentifier"), F.lit("no such words").alias("label"))
    topics = rows.where("id % 2 = 0").select("activity_date", "docIdentifier", F.concat(F.lit("T"), "docIdentifier").alias("title"))
    got = {r.id: r.title for r in R.match_agenda(rows, topics).collect()}
    assert got == {i: f"T{i}" if i % 2 == 0 else None for i in range(400)}
    assert seen.value == 0  # all pairs: 40,000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_matched_without_broadcasts(spark):
    said = spark.createDataFrame([(1, 1, "some words of a longer speech about water and fish " * 3)], "sitting_id long, speech_order int, speech_content string")
    listed = said.select("sitting_id", F.lit(1).alias("ordinal"), F.lit("A").alias("title"), F.lit(None).cast("string").alias("docIdentifier"), F.col("speech_content").alias("text"))
    got = transcripts.match_sections(said, listed)
    assert "Broadcast" not in _plan(got)
    assert [(r.section.title, r.section.score) for r in got.collect()] == [("A", 1.0)]


def test_contained_equals_all_pairs(spark):
    rng = random.Random(5)
    body = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    texts = [(i % 3, body(rng.randrange(0, 120))) for i in range(60)]
    forms = [(i % 3, rng.choice(texts)[1][a : a + rng.randrange(0, 60)]) for i in range(120) for a in [rng.randrange(0, 60)]]
    expected = {(k, f, t) for k, f in forms for j, t in texts if j == k and f and f in t}
    found = contained(spark.createDataFrame(forms, "k int, form string"), spark.createDataFrame(texts, "k int, text string"), ["k"])
    got = found.collect()
    assert len(got) == len(expected) and {(r.k, r.form, r.text) for r in got} == expected
    assert "Broadcast" not in _plan(found)


def test_page_to_speeches_broadcasts_nothing(spark):
    assert "Broadcast" not in _plan(QUERIES["page_to_speeches"](spark, "/root/testdata/sf0.001"))


def test_facts_meet_their_days_once_for_all_that_the_mart_keeps(spark, monkeypatch):
    calls, real = [], mart._with_days
    monkeypatch.setattr(mart, "_with_days", lambda *a: calls.append(1) or real(*a))
    QUERIES["mart_distinct_speakers"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2  # when it is built, and after the changes


def test_changes_of_the_mart_are_read_from_their_buckets(spark, monkeypatch):
    seen, real = [], stored.sinks.replace_sittings
    monkeypatch.setattr(stored.sinks, "replace_sittings", lambda df, *a, **k: seen.append(df.inputFiles()) or real(df, *a, **k))
    QUERIES["mart_incremental"](spark, "/root/testdata/sf0.001")
    assert seen[0] and all("__bucket=1996-02/" in f for f in seen[0])


def test_exports_make_their_texts_behind_the_joins(spark):
    for name in ("export_default", "export_all"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "repeat(" in plan and "repeat(" not in plan[plan.index("Join") :]


def _largest_batch(df) -> int:
    """Bytes of the largest batch that goes to Python."""
    rows = df.sparkSession.range(24, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    return max(r.n for r in rows.mapInPandas(lambda frames: (f.assign(n=f["text"].str.len().sum())[["n"]].head(1) for f in frames), "n long").collect())


def test_pages_go_to_python_in_batches_of_bounded_bytes(spark):
    spark.conf.unset(BATCH_BYTES)
    got = pages.read(spark.createDataFrame([("<p>a</p>",)], "html string"), pages.paragraphs)
    assert got.first().value == ["a"] and _largest_batch(got) <= 10_000_000


def test_texts_whose_language_is_asked_go_to_python_in_batches_of_bounded_bytes(spark):
    spark.conf.unset(BATCH_BYTES)
    got = language.decide(spark.createDataFrame([("the house of the people and that of the law",)], "text string"), "text")
    assert got.first().detected.language == "EN" and _largest_batch(got) <= 10_000_000


def test_ngrams_equal_plain_counts():
    text = "Ein Haus, ein HAUS und das Straße_x 12 a " * 2
    expected = Counter(w[i : i + n] for word in re.findall(r"[^\W\d_]+", text.lower()) for w in [f" {word} "] for n in range(1, 5) for i in range(len(w) - n + 1))
    del expected[" "]
    assert language._ngrams(text, 4) == expected and language._ngrams("", 4) == {}
    assert language.first_ngrams(text, 7, 4) == sorted(expected, key=lambda g: (-expected[g], g))[:7]
    assert language.first_ngrams(text, 10_000, 4) == sorted(expected, key=lambda g: (-expected[g], g))


def test_profiles_are_learnt_from_all_texts(spark):
    """Each of many texts of a language has its own letter; a profile of all n-grams knows every one."""
    texts = [chr(0x4E00 + i) * 3 for i in range(2500)]
    scorer = language.profiles(spark.createDataFrame([("A", t) for t in texts] + [("B", "b")], "language string, text string"), top=30_000)
    assert set(scorer(pd.Series(texts))["language"]) == {"A"}


def test_ngrams_of_many_texts_equal_those_of_each(monkeypatch):
    rng = random.Random(4)
    odd = ["", " ", "_1,", "a", " a", "A b", "½ ² Ⅷ_٣", "İI ıß ΑΣ ΑΣ.", "e\u0301t\u00e9 \U00010400\U0001d7d8 x\0y", "a" * 3000, "ab " * 2000, "字" * 5 + "。字典"]
    texts = odd + ["".join(rng.choice("aabcdÄß_1 ,.\n字") for _ in range(rng.randrange(80))) for _ in range(700)] + ["".join(map(chr, range(0x4E00, 0x9F00)))] + odd[::-1]
    for longest in (1, 2, 4, 7):
        for alone in (language.ALONE, 1000):
            monkeypatch.setattr(language, "ALONE", alone)
            first, counts = [], Counter()
            for block in language._blocks([None, *texts], 4000):
                owner, nth, grams = language._first_ngrams_of_each(block, 40, longest)
                own = [[] for _ in block]
                for i, k, gram in zip(owner, nth, grams):
                    assert k == len(own[i])
                    own[i].append(gram)
                first += own
                for gram, n in zip(*language._ngrams_of_all(block, longest)):
                    counts[gram] += n
            assert first == [language.first_ngrams(t, 40, longest) for t in ["", *texts]]
            assert counts == sum((language._ngrams(t, longest) for t in texts), Counter())


class _Handle:
    """State of one sitting that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def test_a_batch_of_a_sitting_calls_its_state_twice():
    handle, newest = _Handle(), corrections.Newest(None)
    newest.init(handle)
    frame = lambda topic, at: pd.DataFrame({"speech_order": range(5), "day": "d", "topic": topic, "changed_at": pd.Timestamp(at), "version": 1})
    rows = lambda f: sorted(map(tuple, pd.concat(list(newest.handleInputRows("s", iter([f]), None)) or [pd.DataFrame()]).values.tolist()))
    assert rows(frame("a", "2020-01-01")) == [("d", "a", 5)] and handle.calls == 2
    assert rows(frame("b", "2020-01-02")) == [("d", "a", -5), ("d", "b", 5)] and handle.calls == 4
    assert rows(frame("c", "2020-01-01")) == [] and handle.calls == 5


def test_writers_of_a_session_do_their_work_once(spark, monkeypatch):
    failed, real = [], stored.sinks.commits.attempt

    def attempt(work, tries=50):
        def counted():
            try:
                return work()
            except stored.sinks.commits.Conflict:
                failed.append(1)
                raise

        return real(counted, tries)

    monkeypatch.setattr(stored.sinks.commits, "attempt", attempt)
    QUERIES["stored_concurrent_writers"](spark, "/root/testdata/sf0.001")
    # An append may still come between; before, each rewrite undid all others that had begun (up to 28 times).
    assert len(failed) <= 8


def test_sections_meet_speeches_in_blocks_with_few_shuffles(spark, monkeypatch):
    plan = _plan(QUERIES["page_to_speeches"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange ") <= 14  # by an index of words and grams: over 40, whose plans are the driver's
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("water fishing boats sea sea-coast fish council of the policy longwordwithfish".split()) for _ in range(n))
    listed = [(i % 2, i, f"T{i}", None, text(rng.randrange(0, 40))) for i in range(40)]
    said = [(i % 2, i, rng.choice(listed)[4][10:190] if i % 3 else text(rng.randrange(0, 15))) for i in range(60)]
    norm = lambda t: " ".join(re.sub("[^a-z0-9 ]", " ", t.lower()).split())
    expected = {}
    for k, i, t in said:
        words, found = list(dict.fromkeys(norm(t).split())), []
        snippets = [s for at in (0, 40, 80, 120) if len(s := norm(t)[at : at + 160]) >= 80]
        for _, o, title, _, x in (r for r in listed if r[0] == k):
            whole = len(norm(x)) >= 100 and any(s in norm(x) for s in snippets)
            score = 2.0 if whole else sum(len(w) > 3 and w in norm(x) for w in words) / max(len(words), 1)
            found.append((score, -o, title))
        best = max((f for f in found if f[0] >= 0.08), default=None) if len(norm(t)) >= 50 else None
        expected[i] = (best[2], min(best[0], 1.0)) if best else None
    monkeypatch.setattr(transcripts, "BLOCK", 4)
    speeches = spark.createDataFrame(said, "sitting_id int, speech_order int, speech_content string")
    got = transcripts.match_sections(speeches, spark.createDataFrame(listed, "sitting_id int, ordinal int, title string, docIdentifier string, text string")).collect()
    assert len(got) == 60 and {r.speech_order: (r.section.title, r.section.score) if r.section else None for r in got} == expected
    assert len(set(expected.values())) > 10


def test_entries_of_other_sizes_are_left_out_before_their_words_are_counted(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), F.explode
    counted = F.udf(lambda words: seen.add(1) or words, "array<string>")
    monkeypatch.setattr(R.F, "explode", lambda c: real(counted(c)) if isinstance(c, str) and c == "__t" else real(c))
    rows = spark.createDataFrame([("d", "no such words"), ("e", "one"), ("e", "a b c d e f g h")], "day string, label string")
    titles = spark.range(200).select(F.lit("d").alias("day"), F.concat(F.lit("T"), "id").alias("title")).union(spark.createDataFrame([("e", "One"), ("e", "x y"), ("f", "one")], "day string, title string"))
    got = R.most_alike(rows, titles, "day", "label", "title", 0.6).collect()
    assert [tuple(r) for r in got] == [("e", "one", "One")]
    assert seen.value < 20  # all entries, once for each use: 406 and more


def test_the_mart_reads_its_cube_twice_for_all_tables(spark, tmp_path, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), mart.sinks.read
    counted = F.udf(lambda n: seen.add(1) or n, "long").asNondeterministic()
    monkeypatch.setattr(mart.sinks, "read", lambda s, p: real(s, p).withColumn("n", counted("n")) if p.endswith("/cube") else real(s, p))
    facts = spark.createDataFrame([(i % 4, f"t{i % 3}" if i % 5 else None, "f", "g", None, "en") for i in range(40)], "sitting_id long, macro_topic string, macro_specific_focus string, political_group string, political_group_std string, language string")
    days = spark.createDataFrame([(i, f"2020-01-0{i + 1}") for i in range(3)], "id long, activity_date string")
    mart.build(facts, days, f"{tmp_path}/mart")
    assert seen.value == 2 * real(spark, f"{tmp_path}/mart/cube").count()  # once for each table and join: over 10 times
    assert mart.load(spark, f"{tmp_path}/mart")["overview"].first()["total"] == 40


def test_one_csv_file_is_read_by_many_tasks_although_values_hold_line_ends(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice('ab,"\n\r;ü') for _ in range(rng.choice((0, 3, 9, 40, 700))))
    rows = [(i, text() or None, rng.random()) for i in range(400)]
    export.write_one_csv(spark.createDataFrame(rows, "id long, props string, value double").orderBy("id"), f"{tmp_path}/one.csv")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (150, 1000, 1 << 30):  # records over several blocks, some blocks, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = export.read_one_csv(spark, f"{tmp_path}/one.csv", "id long, props string, value double")
            assert sorted(map(tuple, got.collect())) == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Scan csv" not in _plan(QUERIES["export_one_csv"](spark, "/root/testdata/sf0.001"))  # by multiLine, which is one task
