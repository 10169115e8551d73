"""Text functions against hand-written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plenaria.functions import columns as C
from plenaria.functions import groups, language, pages, transcripts

GROUP_CASES = [
    ("Anna-Michelle (PPE)", "PPE", "group", "parentheses_extraction"),
    ("Some text ECR)", "ECR", "group", "parentheses_extraction"),
    ("on behalf of the S&D Group", "S&D", "group", "on_behalf_pattern"),
    ("au nom du groupe Renew", "Renew", "group", "on_behalf_pattern"),
    ("im Namen der PPE-Fraktion", "PPE", "group", "on_behalf_pattern"),
    ("Member of the Commission, on behalf of VP/HR", "NI", "institution", "institutional_markers"),
    ("Vice-President of the Commission", "NI", "institution", "institutional_markers"),
    ("rapporteur for the Committee on Petitions", "NI", "role", "parliamentary_markers"),
    ("Chair of the Delegation for Relations", "NI", "role", "parliamentary_markers"),
    ("PPE", "PPE", "group", "direct_canonical"),
    ("Verts/ALE", "Verts/ALE", "group", "direct_canonical"),
    ("ALDE", "Renew", "group", "direct_token"),
    ("GUE/NGL", "The Left", "group", "direct_token"),
    ("I believe the single-use plastics directive is unfairly treating expanded polystyrene", "NI", "unknown", "looks_like_sentence"),
    ("", "NI", "unknown", "empty_input"),
    ("PSE, in writing", "S&D", "group", "direct_token"),
]


def test_group_cases(spark):
    rows = groups.group_decisions(spark.createDataFrame([(c[0],) for c in GROUP_CASES], "raw string")).collect()
    assert {r["raw"]: (r["std"], r["kind"], r["reason"]) for r in rows} == {c[0]: c[1:] for c in GROUP_CASES}


def test_groups_of_speeches_are_decided_once_per_text(spark):
    rows = spark.createDataFrame([(1, "PPE"), (2, None), (3, "PPE"), (4, "ALDE")], "id int, political_group string")
    got = {r["id"]: (r["political_group_std"], r["political_group_kind"]) for r in groups.normalise_groups(rows).collect()}
    assert got == {1: ("PPE", "group"), 2: ("NI", "unknown"), 3: ("PPE", "group"), 4: ("Renew", "group")}


@pytest.mark.parametrize(
    "std, kind, raw, want",
    [
        ("NI", "institution", "Member of the Commission", "European Commission"), ("NI", "institution", "x", "EU Institution"),
        ("NI", "role", "rapporteur", "Committee Rapporteur"), ("NI", "role", "Chair", "Committee Chair"), ("NI", "group", "NI", "Non-Attached"),
        ("PPE", "group", "PPE", "PPE"), (None, None, None, "Unknown"),
    ],
)
def test_display_label(spark, std, kind, raw, want):
    row = spark.createDataFrame([(std, kind, raw)], "s string, k string, r string")
    assert row.select(groups.display_label(F.col("s"), F.col("k"), F.col("r"))).first()[0] == want


def test_titles(spark):
    titles = {"in writing": "", "Berichterstatter": "Committee Rapporteur", "EPP": "PPE", "Member of the Commission": "European Commission", None: "", "odd": "Parliamentary Role"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r[0]: r[1] for r in rows.select("t", groups.title_label(F.col("t"))).collect()} == titles


def test_labels_and_keys(spark):
    rows = spark.createDataFrame([("A &amp; B",), (" A – B ",), ("a-b",), ("A  -  B",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(C.topic_label("t"), C.collapse_key("t")).collect()]
    assert got == [("A & B", "a & b"), ("A - B", "a b"), ("a-b", "a b"), ("A  -  B", "a b"), (None, None)]


def test_terms_periods_and_percent(spark):
    rows = spark.createDataFrame([("2024-07-16",), ("2024-07-15",), ("1984-07-24",), ("1970-01-01",), (None,)], "d string")
    assert [r[0] for r in rows.select(C.term("d")).collect()] == [10, 9, 2, 1, 10]
    one = spark.createDataFrame([("2020-11-05",)], "d string")
    assert list(one.select(C.period("d", "month"), C.period("d", "quarter"), C.period("d", "year")).first()) == ["2020-11", "2020-Q4", "2020"]
    assert spark.range(1).select(C.percent(F.lit(1), F.lit(8)), C.percent(F.lit(0), F.lit(0))).first()[:] == (12.5, 0.0)
    with pytest.raises(ValueError):
        C.period("d", "week")


def test_scripts(spark):
    rows = spark.createDataFrame([("Καλημέρα σας κυρίες και κύριοι",), ("Добър ден на всички колеги",), ("short",), ("plain english text of some length",)], "t string")
    assert [r[0] and r[0][0] for r in rows.select(C.script_language("t")).collect()] == ["EL", "BG", None, None]


TRANSCRIPT = """noise before the first speech
Maria Silva, rapporteur. – Thank you.
It goes on here.
Jan Kowalski (PPE). – I agree.
Anna Berg (S&D), on behalf of the S&D Group. – Colleagues!
President. – The debate is closed.
Karl Alt (ECR), author. – One more."""


def test_speeches(spark):
    rows = transcripts.parse_speeches(spark.createDataFrame([("s1", TRANSCRIPT), ("s2", None), ("s3", "nothing here")], "sitting_id string, content string"))
    got = [tuple(r)[1:] for r in rows.orderBy("sitting_id", "speech_order").collect()]
    assert got == [
        ("Maria Silva", None, "rapporteur", "Thank you. It goes on here.", 1),
        ("Jan Kowalski", "PPE", None, "I agree.", 2),
        ("Anna Berg", "on behalf of the S&D Group", None, "Colleagues!", 3),
        ("President", None, None, "The debate is closed.", 4),
        ("Karl Alt", "ECR", "author", "One more.", 5),
    ]


HTML = """<html><head><style>td {}</style></head><body>
<table><tr><td class="doc_title"><img src="/img/arrow_title_doc.gif">11.2. Water policy (debate)
<a href="/doceo/document/A-10-2025-0001_EN.html">doc</a></td></tr></table><a name="c1"></a><p>First part about rivers.</p>
<table><tr><td class="doc_title"><img src="arrow_title_doc.gif">12. Fish stocks (vote)</td></tr></table><a name="c2"></a><p>Second part about the sea &amp; its fish.</p>
<script>hidden()</script><a href="#c2">Fish</a></body></html>"""


def test_pages(spark):
    row = spark.createDataFrame([(HTML, "c1"), (None, "x")], "html string, anchor string")
    entries = pages.read(row, pages.agenda).collect()[0]["value"]
    assert [(e["ordinal"], e["docIdentifier"]) for e in entries] == [("11.2", "A-10-2025-0001"), ("12", None)]
    assert entries[1]["title"] == "Fish stocks"
    listed = pages.read(row, pages.sections).collect()
    assert "rivers" in listed[0]["value"][0]["text"] and "rivers" not in listed[0]["value"][1]["text"] and listed[1]["value"] == []
    text = pages.read(row, pages.main_text).collect()[0]["value"]
    assert "sea & its fish" in text and "hidden" not in text and "td {}" not in text
    assert [tuple(x) for x in pages.read(row, pages.contents).collect()[0]["value"]] == [("c2", "Fish")]
    assert pages.read_anchor(row, "anchor").collect()[0]["value"].startswith("First part about rivers.")
    assert pages.read(row, pages.paragraphs).collect()[0]["value"][0] == "First part about rivers."


def test_sections_of_speeches(spark):
    said = "The quality of drinking water in our rivers must improve before the end of this decade, and every region has to report on it."
    agenda = [("s", 0, "Water", "D1", "On water. " + said + " More words follow here to make it long."), ("s", 1, "Fish", None, "Stocks of fish and fleets at sea, quotas and ports; " * 4)]
    sections = spark.createDataFrame(agenda, "sitting_id string, ordinal int, title string, docIdentifier string, text string")
    speeches = spark.createDataFrame([("s", said), ("s", "fleets and ports need quotas; fish stocks at sea are low in all regions"), ("s", "short"), ("t", said)], "sitting_id string, speech_content string")
    got = {r["speech_content"]: r["section"] and r["section"]["title"] for r in transcripts.match_sections(speeches, sections).where("sitting_id = 's'").collect()}
    assert list(got.values()) == ["Water", "Fish", None] or set(got.values()) == {"Water", "Fish", None}
    assert got[said] == "Water" and got["short"] is None


def test_language_decision(spark):
    texts = [(1, "the house of the people and the will of the people is that for which we stand"), (2, "der Hund und die Katze sind in den Garten von dem Haus mit der Tür"), (3, "Καλημέρα σας κυρίες και κύριοι"), (4, ""), (5, None)]
    docs = spark.createDataFrame(texts, "id int, t string")
    got = {r["id"]: r["detected"] and r["detected"]["language"] for r in language.decide(docs, "t").collect()}
    assert got == {1: "EN", 2: "DE", 3: "EL", 4: None, 5: None}


def test_iso_codes(spark):
    rows = spark.createDataFrame([("eng",), ("pt-BR",), ("de",), ("jpn",)], "c string")
    assert [r[0] for r in rows.select(language.iso2("c")).collect()] == ["EN", "PT", "DE", None]
