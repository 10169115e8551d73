"""Sources, sinks, persons, relational operators, mart, refresh and streaming on small tables."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.columns import longer, sitting_date
from plenaria.operators import analytics as A
from plenaria.operators import persons, relational
from plenaria.plans import mart, refresh
from plenaria.sources import records, sinks
from plenaria.streaming import counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


class Api(BaseHTTPRequestHandler):
    failures: dict = {}

    def do_GET(self):
        url = urlparse(self.path)
        query = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
        key = (url.path, query["offset"])
        if Api.failures.get(key, 0) > 0:
            Api.failures[key] -= 1
            self.send_response(500)
            self.end_headers()
            return
        total = {"/a": 25, "/b": 0}.get(url.path)
        self.send_response(200 if total is not None else 404)
        self.end_headers()
        if total is not None:
            listed = [{"identifier": f"{url.path[1:]}{i}", "label": None if i == 3 else f"L{i}"} for i in range(query["offset"], min(total, query["offset"] + query["limit"]))]
            self.wfile.write(json.dumps({"data": listed}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def api():
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_source(spark, api):
    Api.failures = {("/a", 10): 1, ("/a", 0): 0}
    got = records.paged(spark, [f"{api}/a", f"{api}/b", f"{api}/missing"], "identifier string, label string", page_size=10, pause=0.01)
    assert got.count() == 25 and got.where("label is null").count() == 1
    Api.failures = {("/a", 10): 99}
    skipped = records.paged(spark, [f"{api}/a"], "identifier string, label string", page_size=10, pause=0.001, tries=2)
    assert skipped.count() == 15


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('["Energy", "Fish"]')
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "r.json").write_text('{"rules": [{"canonical": "A", "variants": ["a", "b"]}, {"canonical": "B"}, {"variants": ["c"]}]}')
    (tmp_path / "list.json").write_text('[{"canonical": "A", "variants": ["a"]}]')
    assert rows(records.taxonomy(spark, str(tmp_path / "t.json"))) == [("Energy", 0), ("Fish", 1)]
    assert rows(records.taxonomy(spark, str(tmp_path / "bad.json"))) == [] == rows(records.taxonomy(spark, str(tmp_path / "none.json")))
    assert rows(records.rules(spark, str(tmp_path / "r.json"))) == [("A", ["a", "b"])]
    assert rows(records.rules(spark, str(tmp_path / "list.json"))) == [("A", ["a"])]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "id long, sitting_id string, v string")
    with pytest.raises(sinks.TableNotFound):
        sinks.read(spark, path)
    sinks.upsert(df((1, "a", "x"), (2, "b", "y")), path)
    sinks.upsert(df((2, "b", "new"), (3, "c", "z")), path)
    assert rows(sinks.read(spark, path)) == [(1, "a", "x"), (2, "b", "new"), (3, "c", "z")]
    sinks.insert_absent(df((3, "c", "no"), (4, "d", "yes")), path)
    assert rows(sinks.read(spark, path))[2:] == [(3, "c", "z"), (4, "d", "yes")]
    sinks.replace_sittings(df((9, "a", "r1"), (10, "a", "r2"), (11, "e", "r3")), path)
    assert rows(sinks.read(spark, path).where("sitting_id in ('a', 'e')")) == [(9, "a", "r1"), (10, "a", "r2"), (11, "e", "r3")]
    sinks.replace_sittings(df((12, "a", "no"), (13, "f", "yes")), path, replace=False)
    assert rows(sinks.read(spark, path).where("id > 11")) == [(13, "f", "yes")]
    sinks.vacuum(spark, path)
    assert sinks.read(spark, path).count() == 7 and len(list((tmp_path / "t").glob("v-*"))) == 1
    assert rows(sinks.changed(df((1, "a", "x"), (2, "b", None)), df((1, "a", "x"), (2, "b", "y")), ["id"], "v").select("id")) == [(2,)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", value', None, "line\nbreak", " x ")], "a string, b string, c string, d string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), byte_order_mark=True)
    text = next((tmp_path / "c").glob("part-*")).read_text(encoding="utf-8")
    assert text == '﻿a,b,c,d\n"a ""quoted"", value",,"line\nbreak", x \n'


def test_conform(spark):
    out = schema.conform(spark.createDataFrame([("1", "x")], "id string, extra string"), "id long, label string")
    assert out.dtypes == [("id", "bigint"), ("label", "string"), ("extra", "string")] and rows(out) == [(1, None, "x")]
    assert schema.conform(spark.range(0), schema.SPEECHES).columns[:3] == ["id", "sitting_id", "speaker_name"]


PERSONS = "id long, label string, givenName string, familyName string, country string"


def test_linking(spark):
    known = spark.createDataFrame([(1, "Anna Berg", "Anna", "Berg", "SE"), (2, "Berg Anna", "Berg", "Anna", "DE"), (3, "Jan van der Kow", "Jan", "van der Kow", "NL")], PERSONS)
    said = [("Anna Berg", None), ("anna  berg", None), ("der Kow Jan", None), ("van der Kow", None), ("Unknown Person", None), ("Linked", 7), (None, None)]
    speeches = spark.createDataFrame(said, "speaker_name string, mep_id long")
    got = {r["speaker_name"]: r["mep_id"] for r in persons.link_speeches(speeches, known).collect()}
    assert got == {"Anna Berg": 1, "anna  berg": 1, "der Kow Jan": None, "van der Kow": 3, "Unknown Person": None, "Linked": 7, None: None}
    added = persons.missing_persons(spark.createDataFrame([("Unknown Person", None)] * 3 + [("unknown person", None), ("Zed Q. Best", None), ("Zed Best", None), ("Zed Best", None), ("", None), ("Jan Kow", None)], "speaker_name string, mep_id long"), known)
    assert rows(added.select("id", "label", "n")) == [(4, "Unknown Person", 4), (5, "Zed Best", 2)]


def test_affiliation(spark):
    said = spark.createDataFrame([(1, 1, "PPE"), (2, 1, "ECR"), (3, 1, "ECR"), (4, 2, "ID"), (5, 2, "NI"), (6, 3, "Unknown"), (7, 4, None)], "id long, mep_id long, label string")
    assert rows(persons.most_frequent(said, "mep_id", "label", "id")) == [(1, "ECR"), (2, "ID")]
    assert rows(persons.first_value(said, "mep_id", "label", "id")) == [(1, "PPE"), (2, "ID"), (3, "Unknown")]
    groups = spark.createDataFrame([(i, "A" if i < 10 else "B") for i in range(19)] + [(99, None)], "id long, political_group string")
    assert rows(persons.small_to_other(groups).groupBy("political_group").count()) == [(None, 1), ("A", 10), ("Other", 9)]
    terms = spark.createDataFrame([("p", 9, "old"), ("p", 10, "new"), ("q", 8, "x")], "identifier string, term int, label string")
    assert rows(persons.merged_terms(terms).select("identifier", "label", "is_current")) == [("p", "new", True), ("q", "x", False)]


def test_numbered(spark):
    df = spark.range(100).withColumn("b", F.col("id") % 7)
    got = persons.numbered(df, [F.col("id")], F.col("b")).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1, 101)) and [(r["b"], r["id"]) for r in got] == sorted((r["b"], r["id"]) for r in got)


def test_relational_cases(spark):
    known = spark.createDataFrame([("Energy", 0)], "name string, ordinal int")
    fresh = spark.createDataFrame([(" energy ", 0), ("Fish", 1), ("FISH", 2), ("", 3), ("Water", 4)], "name string, ordinal int")
    assert [r[0] for r in rows(relational.add_if_new(known, fresh), "ordinal")] == ["Energy", "Fish", "Water"]
    agenda = spark.createDataFrame([("s", 0, "D", "Fish"), ("s", 1, "D", "fish "), ("s", 2, None, "Fish"), ("t", 0, "D", "Fish")], "sitting_id string, ordinal int, docIdentifier string, title string")
    assert relational.first_agenda(agenda).count() == 3
    rules = spark.createDataFrame([("A", ["A"]), ("B (alt)", ["x"]), ("C", ["x", "y"]), ("D", ["y", "z"])], "canonical string, variants array<string>")
    assert rows(relational.sanitised(rules)) == [("C", ["x", "y"]), ("D", ["z"])]
    dated = spark.createDataFrame([(None, None, "sitting-2020-01-02"), ("2019-01-01", "x", "y"), (None, None, "other")], "d string, a string, i string")
    assert [r[0] for r in dated.select(sitting_date("d", "a", "i")).collect()] == ["2020-01-02", "2019-01-01", None]
    assert spark.createDataFrame([("ab", None)], "a string, b string").select(longer(F.col("a"), F.col("b"))).first()[0] == "ab"
    with pytest.raises(ValueError):
        relational.export(spark.range(1), spark.range(1), spark.range(1), ["nothing"])
    assert relational.dates(spark, "2020-02-28", "2020-03-01").count() == 3 and relational.dates(spark, "2020-03-02", "2020-03-01").count() == 0
    nulls = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, content string")
    assert [r[0] for r in rows(relational.keep_first(nulls, "content", "id"))] == [1, 3, 4]


def test_empty_tables(spark):
    facts = spark.createDataFrame([], "sitting_id long, macro_topic string, macro_specific_focus string, political_group string, political_group_std string, language string, mep_id long")
    sittings = spark.createDataFrame([], "id long, activity_date string")
    assert rows(A.coverage(facts)) == [(0, 0, 0.0)]
    assert A.grid(A.time_series(A.dated(facts, sittings))).count() == 0 and A.trends(A.dated(facts, sittings)).count() == 0
    assert relational.needs_processing(sittings, facts).count() == 0


def test_mart(spark, tmp_path):
    said = [(1, "Energy &amp; Climate", "f", "PPE", None, "EN", 1), (1, "energy & climate", "f", "PPE", "ECR", None, 1), (2, "Fish", None, "ID", None, "fr", 2), (3, " ", None, None, None, "EN", None), (4, "Fish", "g", "ID", None, "EN", 2)]
    facts = spark.createDataFrame(said, "sitting_id long, macro_topic string, macro_specific_focus string, political_group string, political_group_std string, language string, mep_id long")
    sittings = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-03-05"), (3, "2020-03-06"), (4, None)], "id long, activity_date string")
    path = str(tmp_path / "m")
    with pytest.raises(sinks.TableNotFound):
        mart.load(spark, path)
    mart.build(facts, sittings, path)
    made = mart.load(spark, path)
    assert rows(made["overview"]) == [(5, 4, 80.0)]
    assert rows(mart.series(made, "month")) == [("2020-01", "Energy & Climate", 2), ("2020-01", "Fish", 0), ("2020-03", "Energy & Climate", 0), ("2020-03", "Fish", 1)]
    assert rows(mart.series(made, "year", topics=["Fish"])) == [("2020", "Fish", 1)]
    assert rows(made["top_topics"]) == [("Energy & Climate", 2, 1), ("Fish", 2, 2)]
    assert rows(made["by_group"]) == [("Energy & Climate", "ECR", 1), ("Energy & Climate", "PPE", 1), ("Fish", "ID", 2)]
    assert rows(made["languages"]) == [("EN", 3), ("FR", 1), ("UNK", 1)]
    assert made["topics"].where("size(variants) = 2").count() == 1 and made["metadata"].count() == 1


def test_classification(spark):
    titles = spark.createDataFrame([(t,) for t in ["Vote", "Fish", "Fish", None, " ", "Boom"]], "title string")
    ok = rows(refresh.classify_topics(titles))
    assert [(r[0], r[1]) for r in ok] == [("Boom", "Other"), ("Fish", "Other"), ("Vote", refresh.PROCEDURAL)]

    def fails(some):
        raise RuntimeError("service down")

    def short(some):
        return pd.DataFrame({"macro_topic": ["T"], "specific_focus": some[:1], "confidence": [0.9]})

    assert {r[3] for r in rows(refresh.classify_topics(titles, fails))} == {0.2}
    assert sorted(r[3] for r in rows(refresh.classify_topics(titles.coalesce(1), short))) in ([0.3, 0.3, 0.9], [0.3, 0.9, 0.9], [0.9, 0.9, 0.9])
    known = spark.createDataFrame([("other",)], "name string")
    assert rows(refresh.new_topics(refresh.classify_topics(titles), known)) == [(refresh.PROCEDURAL,)]


def test_page_to_speeches(spark):
    body = "Maria Silva (PPE). – Fish stocks in the northern seas are falling and fleets must adapt to quotas soon.\nMore of it here.\nPresident. – Closed."
    html = '<html><body><table><tr><td class="doc_title"><img src="arrow_title_doc.gif">3. Fish stocks (debate)</td></tr></table>\n' + body.replace("\n", "<br>\n") + "x" * 400 + "</body></html>"
    said = refresh.speeches_of(spark.createDataFrame([("s1", html), ("s2", "too short")], "sitting_id string, html string"))
    known = spark.createDataFrame([(5, "Maria Silva", "Maria", "Silva", "PT")], PERSONS)
    got = refresh.enriched(said, known).orderBy("speech_order").collect()
    assert [(r["speaker_name"], r["mep_id"], r["political_group_std"], r["speech_order"]) for r in got] == [("Maria Silva", 5, "PPE", 1), ("President", None, "NI", 2)]
    assert got[0]["topic"] == "Fish stocks" and got[0]["macro_topic"] == "Other"


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    event = lambda i, day, kind: (i, pd.Timestamp(day).to_pydatetime(), 1, kind, 1.5, "{}")
    write = lambda name, *e: spark.createDataFrame(list(e), counts.EVENTS).coalesce(1).write.parquet(str(source / name))
    write("a", event(1, "2024-01-01 10:00", "x"), event(2, "2024-01-01 11:00", "x"), event(3, "2024-01-02", "y"))
    run = lambda: rows(counts.run_daily(spark, str(source / "*"), "*.parquet", out))
    assert run() == [("2024-01-01", "x", 2, 3.0), ("2024-01-02", "y", 1, 1.5)]
    assert run() == [("2024-01-01", "x", 2, 3.0), ("2024-01-02", "y", 1, 1.5)]
    write("b", event(4, "2024-01-02 10:00", "y"))
    assert run() == [("2024-01-01", "x", 2, 3.0), ("2024-01-02", "y", 2, 3.0)]


def test_sittings_are_replaced_by_a_stream(spark, tmp_path):
    source, table, kind = tmp_path / "in", str(tmp_path / "t"), "sitting_id string, speech_order int"
    put = lambda name, *r: spark.createDataFrame(list(r), kind).coalesce(1).write.parquet(str(source / name))
    put("a", ("s1", 1), ("s1", 2), ("s2", 1))
    go = lambda: counts.refresh_sittings(spark.readStream.schema(kind).parquet(str(source / "*")), table, str(tmp_path / "state")).awaitTermination()
    go()
    put("b", ("s1", 9))
    go()
    assert rows(sinks.read(spark, table)) == [("s1", 9), ("s2", 1)]


def page_of(title, *speeches):
    head = f'<html><body><table><tr><td class="doc_title"><img src="arrow_title_doc.gif">1. {title} (debate)</td></tr></table>\n'
    return head + "<br>\n".join(f"{name}. – {text}" for name, text in speeches) + "<br>\n" + "z" * 500 + "</body></html>"


def test_refresh_run(spark, tmp_path):
    known = spark.createDataFrame([(5, "Maria Silva", "Maria", "Silva", "PT")], PERSONS)
    kind = "sitting_id string, activity_date string, html string"
    fish = "Stocks of fish in the northern seas are falling and all fleets have to adapt to the new quotas"
    one = [("s1", "2020-01-01", page_of("Fish stocks", ("Maria Silva (PPE)", fish), ("President", "Closed."))), ("s2", "2020-01-02", "broken")]
    go = lambda listed, **more: refresh.run(spark, spark.createDataFrame(listed, kind), known, str(tmp_path), "2020-12-31", **more)
    assert go(one) == {"asked": 2, "processed": 1, "failed": 1}
    two = [one[0], ("s2", "2020-01-02", page_of("Water", ("Jan Kow", "Water. " * 20)))]
    assert go(two) == {"asked": 1, "processed": 1, "failed": 0}
    speeches = sinks.read(spark, f"{tmp_path}/speeches")
    assert speeches.count() == 3 and rows(speeches.where("mep_id = 5").select("sitting_id", "topic", "political_group_std")) == [("s1", "Fish stocks", "PPE")]
    assert mart.load(spark, f"{tmp_path}/mart")["overview"].first()["total"] == 3
    assert go(two, everything=True)["processed"] == 2 and sinks.read(spark, f"{tmp_path}/speeches").count() == 3


def test_agenda_content_and_reparse(spark):
    sittings = spark.createDataFrame([("1", "2020-01-01", "D1", "x", ""), ("2", "2020-01-01", None, "fish stocks at sea", None), ("3", "2030-01-01", None, "none", "c" * 200)], "id string, activity_date string, docIdentifier string, label string, content string")
    topics = spark.createDataFrame([("2020-01-01", "D1", "Energy"), ("2020-01-01", "D2", "Fish stocks at sea today")], "activity_date string, docIdentifier string, title string")
    assert rows(relational.match_agenda(sittings, topics)) == [("1", "Energy"), ("2", "Fish stocks at sea today"), ("3", None)]
    assert [r[0] for r in rows(relational.needs_content(sittings, "2025-01-01"), "id")] == ["1", "2"]
    kind = "sitting_id string, speech_order int, political_group string"
    old = spark.createDataFrame([("a", 1, None), ("a", 2, "ID"), ("b", 1, "x")], kind)
    new = spark.createDataFrame([("a", 1, "PPE"), ("a", 2, "ID"), ("b", 1, "y"), ("b", 2, "z")], kind)
    assert rows(relational.reparsed(new, old)) == [("a", 1, "PPE")]
    assert rows(relational.envelope(old, 2, 1)) == [(3, 2, 1, False)] and relational.unlinked(old).where("mep_id is null").count() == 3


def test_seed(spark, tmp_path):
    assert sinks.seed(spark.range(0), str(tmp_path / "s")) and sinks.seed(spark.range(2), str(tmp_path / "s")) and not sinks.seed(spark.range(9), str(tmp_path / "s"))
    assert sinks.read(spark, str(tmp_path / "s")).count() == 2
