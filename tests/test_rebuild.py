"""Flows over stored tables, fetching, requests and implied end tags."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenaria.functions import groups, language, pages, requests
from plenaria.operators import analytics, relational
from plenaria.plans import mart, rebuild
from plenaria.schema import SPEECHES, conform
from plenaria.sources import records, sinks

PAGE = "<html><body><table><tr><td class='doc_title'><img src='arrow_title_doc.gif'>1. Fish quotas</td></tr></table>{}</body></html>"
SAID = "Ann Lee (PPE). – We must talk about fish and quotas today.\nMore of it.\nBo Wu (ECR). – No." + "\nand so on" * 60


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_topic_filters_and_time_frames(spark):
    assert requests.topic_filter(["a", "b"]) == ["a", "b"] and requests.topic_filter(' ["a", "b,c"]') == ["a", "b,c"] and requests.topic_filter("a, b ,,c") == ["a", "b", "c"]
    assert requests.topic_filter('["a"') is None and requests.topic_filter("") is None and requests.topic_filter(None) is None
    assert requests.time_frame("year", "2024-02-29") == ("2023-03-01", None) and requests.time_frame("6months", "2024-08-31") == ("2024-03-02", None)
    assert requests.time_frame("3months", "2024-01-15") == ("2023-10-15", None) and requests.time_frame("custom", "2024-01-15", "", "2020-01-01") == (None, "2020-01-01")
    assert requests.time_frame("all", "2024-01-15", "2000-01-01") == (None, None)
    facts = spark.createDataFrame([("Air &amp; sea",), ("air & Sea",), ("Land",)], "macro_topic string")
    variants = mart.topic_variants(facts)
    (label,) = [r["topic"] for r in variants.collect() if len(r["variants"]) == 2]
    assert {r[0] for r in requests.with_variants([label, "Gone"], variants).collect()} == {"Air &amp; sea", "air & Sea", label, "Gone"}


def test_export_fields(spark):
    facts = spark.createDataFrame([(1, "s1", 2, 7, "PPE", None), (2, "s1", 1, None, "x", "ECR"), (3, "s2", 1, 8, "y", None)], "id long, sitting_id string, speech_order int, mep_id long, political_group string, political_group_std string")
    sittings = spark.createDataFrame([("s1", "2020-01-01", "L"), ("s3", "2021-01-01", "M")], "id string, activity_date string, label string")
    persons = spark.createDataFrame([(7, "FR")], "id long, country string")
    got = relational.export(facts, sittings, persons, ["id", "date", "nothing", "political_group", "country", "notation_id"], ordered=True)
    assert [tuple(r) for r in got.collect()] == [(2, "2020-01-01", "ECR", None, None), (1, "2020-01-01", "PPE", "FR", None), (3, None, "y", None, None)]
    assert len(relational.EXPORT) == 30 and len(relational.export(facts, sittings, persons).columns) == 13
    assert relational.export(facts, sittings, persons, ["id"], start="2020-01-01").count() == 2
    with pytest.raises(ValueError):
        relational.export(facts, sittings, persons, ["nothing"])


def test_rules_with_their_counts(spark):
    facts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "macro_topic string")
    rules = spark.createDataFrame([("A", ["a", "b"]), ("C", ["z"])], "canonical string, variants array<string>")
    out, n = relational.applied_rules(facts, rules)
    assert rows(out) == [("A",), ("A",), ("A",), ("c",)] and rows(n) == [("A", 3)]


def test_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "id long, v string, at int")
    sinks.upsert(df((1, "a", 1), (1, "b", 2), (2, "c", 1)), path, last="at")
    assert rows(sinks.read(spark, path)) == [(1, "b", 2), (2, "c", 1)]
    sinks.upsert(df((2, "x", 5), (2, "y", 4), (3, "z", 1), (3, "z", 1)), path, last="at")
    assert rows(sinks.read(spark, path)) == [(1, "b", 2), (2, "x", 5), (3, "z", 1)]
    before = sinks.current(spark, path)
    sinks.insert_absent(df((3, "no", 9), (4, "p", 1), (4, "q", 2)), path, last="at")
    assert rows(sinks.read(spark, path))[2:] == [(3, "z", 1), (4, "q", 2)]
    assert sinks.current(spark, path)[:1] == before and len(sinks.current(spark, path)) == 2
    assert rows(spark.read.parquet(before[0])) == [(1, "b", 2), (2, "x", 5), (3, "z", 1)]
    first = sinks.one_per_key(df((1, "a", None), (1, "b", None)), "id").collect()
    assert first == sinks.one_per_key(df((1, "b", None), (1, "a", None)), "id").collect() and len(first) == 1


def test_fetching_with_failures(spark):
    def load(url):
        if "bad" in url:
            raise OSError("closed")
        return f"page of {url}"

    asked = spark.createDataFrame([(1, "u1"), (2, "bad"), (3, None)], "id int, url string")
    got = rows(records.fetched(asked, tries=2, pause=0.0, load=load))
    assert got == [(1, "u1", "page of u1", None), (2, "bad", None, "OSError: closed"), (3, None, None, "no address")]


def test_newest_document(spark):
    known = spark.createDataFrame([("2020-03-05",)], "activity_date string")
    page = PAGE.format("x" * 500)
    load = lambda url: page if "2020-03-0" in url else "nothing"
    (row,) = records.newest_document(known, spark, "2020-03-12", 10, load=load, pause=0.0).collect()
    assert (row["activity_date"], row["html"]) == ("2020-03-09", page)


def test_synonyms(spark, tmp_path):
    path = tmp_path / "s.json"
    assert records.synonyms(spark, str(path)) == {}
    path.write_text('{"MY CLUB": "ECR", "ALDE": "NI"}')
    more = records.synonyms(spark, str(path))
    raw = spark.createDataFrame([("My Club",), ("ALDE",), ("PPE",)], "raw string")
    assert {r["raw"]: r["std"] for r in groups.group_decisions(raw, more).collect()} == {"My Club": "ECR", "ALDE": "NI", "PPE": "PPE"}
    path.write_text("[1]")
    assert records.synonyms(spark, str(path)) == {}


def test_metadata_content_and_parsing(spark, tmp_path):
    path = str(tmp_path)
    api = lambda *r: spark.createDataFrame(list(r), "id string, labels map<string,string>, date string, activity_date string, content string, other_content string, docIdentifier string, notationId string")
    assert rebuild.metadata(spark, path, api(("a", {"FR": "fr", "EN": "en"}, None, "2020-01-01", "x", "longer", "d1", ""), ("sitting-2020-01-02", {"FR": "fr"}, None, None, None, None, "", "n1"))) == 2
    assert rebuild.metadata(spark, path, api(("b", {}, "2020-01-03", None, None, None, "d1", ""), ("c", None, "2020-01-04", None, "", "", "", ""), ("c", None, "2020-01-04", None, "", "", "", ""))) == 3
    assert rows(sinks.read(spark, f"{path}/sittings").select("id", "label", "activity_date", "content")) == [("a", "en", "2020-01-01", "longer"), ("c", "", "2020-01-04", ""), ("sitting-2020-01-02", "fr", "2020-01-02", None)]
    page = PAGE.format(f"<div class='doc-content'>{SAID}</div>")

    def load(url):
        if "2020-01-02" in url:
            raise OSError("gone")
        return page if "2020-01-01" in url else "z" * 600

    got = rebuild.content(spark, path, "2020-12-31", load=load, tries=1, pause=0.0)
    assert got == {"asked": 3, "fetched": 2, "failed": 1, "parsed": 1}
    assert rows(sinks.read(spark, f"{path}/speeches").select("sitting_id", "speech_order", "speaker_name", "political_group")) == [("a", 1, "Ann Lee", "PPE"), ("a", 2, "Bo Wu", "ECR")]
    assert rows(sinks.read(spark, f"{path}/failures").select("kind", "what", "message")) == [("content", "sitting-2020-01-02", "OSError: gone"), ("parse", "c", "not a transcript")]
    assert rebuild.parse(spark, path, since="2020-01-01")["parsed"] == 0
    assert rebuild.metadata(spark, path, api(("only", {}, "2021-01-01", None, None, None, "", "")), everything=True) == 1


def test_person_dataset(spark, tmp_path):
    path = str(tmp_path)
    said = [(1, "s", "Ann Lee", "PPE", 99), (2, "s", "LEE Ann", "PPE", None), (3, "s", "Bo X Wu", "ALDE", None), (4, "s", "Bo Wu", "ALDE", 5), (5, "s", None, None, None), (6, "s", "Bo Wu", "NI", None)]
    speeches = conform(spark.createDataFrame(said, "id long, sitting_id string, speaker_name string, political_group string, mep_id long"), SPEECHES)
    sinks.write(speeches, f"{path}/speeches")
    api = spark.createDataFrame([("7", 9, "Ann Lee", "FR"), ("7", 10, "Ann LEE", "FR"), ("8", 5, "Old Member", "IT")], "identifier string, term int, label string, country string")
    got = rebuild.persons(spark, path, api, at_least=1)
    assert got == {"unlinked": 2, "api": 2, "linked": 2, "created": 1, "linked_to_created": 3}
    assert rows(sinks.read(spark, f"{path}/persons").select("id", "label", "is_current", "source", "politicalGroup")) == [(7, "Ann LEE", True, "api", "PPE"), (8, "Old Member", False, "api", None), (9, "Bo Wu", None, "historic", "Renew")]
    assert rows(sinks.read(spark, f"{path}/speeches").select("id", "mep_id", "political_group_std"), "id") == [(1, 7, "PPE"), (2, 7, "PPE"), (3, 9, "Renew"), (4, 9, "Renew"), (5, None, "NI"), (6, 9, "NI")]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one<p>two<p>three", ["one", "two", "three"]), ("<div><p>a<div>b</div>c</div><p>d", ["a", "d"]), ("<p>a <b>bold<p>next", ["a bold", "next"]),
        ("<table><tr><td><p>x<td><p>y<tr><td>z</table><p>w", ["x", "y", "w"]), ("<ul><li><p>1<li>2<ul><li><p>3</ul></ul>", ["1", "3"]), ("<p>a</p>b</p><p>c", ["a", "c"]),
    ],
)
def test_paragraphs_without_end_tags(html, want):
    assert pages.paragraphs(html) == want


def test_pages_take_linear_time_and_space():
    start = time.time()
    for tag in ("<p>x", "<b>x", "<td>x", "<li>x", "<div>x", "<span><p>x"):
        page = pages.Page(tag * 20_000)
        assert len(page.elements) >= 20_000 and all(e.until >= e.after for e in page.elements)
    assert time.time() - start < 20


def test_sections_of_cells_without_end_tags():
    html = "<table><tr><td class=doc_title><img src=arrow_title_doc.gif>1. One <a href='/doceo/document/A-9_EN.html'>doc</a><tr><td>text of one<tr><td class=doc_title><img src=arrow_title_doc.gif>2. Two (debate)<tr><td>text of two</table>"
    assert [(s["title"], s["docIdentifier"], s["text"]) for s in pages.sections(html)] == [("One doc", "A-9", "1. One doctext of one"), ("Two", None, "2. Two (debate)text of two")]


def test_votes_and_answers(spark):
    scorer = lambda texts: pd.DataFrame([("EN", 0.7) if "x" in (t or "") else ("FR", 0.9) if t else (None, None) for t in texts], columns=["language", "confidence"])
    assert language.vote("y" * 600 + "x" * 600, scorer) == ("FR", 0.9) and language.vote("", scorer) is None
    docs = spark.createDataFrame([(1, "x" * 700), (2, "α" * 40), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["detected"] and (r["detected"]["language"], r["detected"]["how"]) for r in language.decide(docs, "t", scorer).collect()}
    assert got == {1: ("EN", "one_shot"), 2: ("EL", "script"), 3: None, 4: None}


def test_samples_are_whole_and_repeatable(spark):
    data = spark.range(5000).select("id", F.when(F.col("id") < 4000, "a").when(F.col("id") < 4007, "b").when(F.col("id") < 4500, "c").alias("lang"))
    got = rows(analytics.sampled(data, "lang", "id", k=30, buckets=4))
    assert got == rows(analytics.sampled(data.repartition(7), "lang", "id", k=30, buckets=64))
    assert pd.Series([r[1] or "-" for r in got]).value_counts().to_dict() == {"a": 30, "c": 30, "-": 30}


def test_small_documents_reports_and_catalogue(spark, tmp_path):
    path = str(tmp_path)
    sinks.write_json(spark, ["é", 1], f"{path}/topics.json")
    sinks.write_json(spark, {"a": ["x"]}, f"{path}/topics.json")
    assert (tmp_path / "topics.json").read_text() == '{\n  "a": [\n    "x"\n  ]\n}'
    sinks.write_quoted(spark.createDataFrame([("b", 1), ("a", 3), (None, 2)], "raw string, n long").coalesce(1), f"{path}/report", "raw", "n")
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")) == '"a" (3)\n"" (2)\n"b" (1)\n'
    sinks.write(spark.createDataFrame([(1, "x")], "id long, label string"), f"{path}/sittings")
    sinks.write(spark.createDataFrame([(1, 1), (2, 1)], "sitting_id long, n int"), f"{path}/speeches")
    assert rows(sinks.catalogue(spark, path)) == [("sittings", 0, "id", "bigint"), ("sittings", 1, "label", "string"), ("speeches", 0, "sitting_id", "bigint"), ("speeches", 1, "n", "int")]
    sinks.delete_sittings(spark.createDataFrame([(1,)], "id long"), path)
    assert rows(sinks.read(spark, f"{path}/speeches")) == [(2, 1)] and sinks.read(spark, f"{path}/sittings").count() == 0


def test_payload_of_a_sitting(spark, tmp_path):
    file = tmp_path / "p.json"
    file.write_text('{"date": "2020-01-01",\n "html": "<p>x", "speeches": [{"speaker_name": "Ann", "speech_content": "hi"}, {"speaker_name": "Bo", "speech_order": 7}]}')
    sitting, said = records.payload(spark, str(file))
    assert rows(sitting.select("id", "activity_date", "content")) == [("sitting-2020-01-01", "2020-01-01", "<p>x")]
    assert rows(said.select("sitting_id", "speech_order", "speaker_name", "speech_content")) == [("sitting-2020-01-01", 1, "Ann", "hi"), ("sitting-2020-01-01", 7, "Bo", None)]
    sinks.replace_sittings(said, str(tmp_path / "speeches"))
    assert sinks.read(spark, str(tmp_path / "speeches")).count() == 2


def test_settings(spark, monkeypatch):
    from plenaria.settings import settings

    assert settings(spark).page_size == 500
    monkeypatch.setenv("PLENARIA_PAGE_SIZE", "7")
    monkeypatch.setenv("PLENARIA_TABLES", "a/b")
    spark.conf.set("spark.plenaria.page_size", "9")
    assert (settings(spark).page_size, settings(spark).tables) == (9, "a/b")
    spark.conf.unset("spark.plenaria.page_size")
    assert settings(spark).page_size == 7


def test_a_trained_scorer_on_texts_it_has_not_seen(spark):
    """Learns four invented languages from most documents and is asked about the others."""
    rows_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").select("doc_id", "text", F.upper("lang").alias("language"))
    held = F.col("doc_id") % 5 == 0
    scorer = language.trained(rows_.where(~held), top=400)
    asked = rows_.where(held).toPandas()
    got = scorer(asked["text"])
    assert (got["language"] == asked["language"]).mean() > 0.9 and got["confidence"].between(0, 1).all()
    assert scorer(pd.Series([None, "", "日本"]))["language"].isna().all()


def test_every_language_has_frequent_words():
    assert set(language.FREQUENT) == set(language.LANGUAGES)
    said = {"EN": "the state of the union is in the hands of that house", "LT": "tai yra svarbu, kad jis ir ji su tuo iš to", "GA": "agus is é an rud go bhí na daoine ar an lá le chéile"}
    got = language.frequent_words(pd.Series(list(said.values())))
    assert got["language"].tolist() == list(said)
