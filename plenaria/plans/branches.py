"""Registered queries that write files and read them back, and inputs that reach every branch of what other queries see one branch of."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenaria.functions import transcripts
from plenaria.operators import conversation
from plenaria.operators import relational as R
from plenaria.plans import mart, refresh
from plenaria.plans.queries import query
from plenaria.sources import export, records, sinks, views
from plenaria.streaming import counts


@query("export_one_csv", "SELECT id, macro_topic, activity_date, value, props FROM ev")
def export_one_csv(s, d):
    """All facts as one ordered CSV file with quotes, read back."""
    path = f"{counts.scratch(s, 'csv')}/export.csv"
    rows = views.event_speeches(s, d).select("id", "macro_topic", "activity_date", "value", "props")
    export.write_one_csv(rows.orderBy(F.desc("activity_date"), "id"), path)
    return export.read_one_csv(s, path, "id long, macro_topic string, activity_date string, value double, props string")


@query("taxonomy_file", "SELECT p_type AS name, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT p_type FROM part)")
def taxonomy_file(s, d):
    """Topics added to the taxonomy's file one by one under its lock, and read from it."""
    path = f"{counts.scratch(s, 'taxonomy')}/topics.json"
    for topic in [r["p_type"] for r in views.table(s, d, "part").select("p_type").distinct().collect()]:
        sinks.update_json(s, path, lambda old, t=topic: sorted({*(old or []), t}))
    return records.taxonomy(s, path)


@query("rules_file", "SELECT p_brand AS canonical, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS variants FROM part GROUP BY 1")
def rules_file(s, d):
    """A rule for each focus, written as a file with malformed entries among them, and read back."""
    path = f"{counts.scratch(s, 'rules')}/rules.json"
    listed = views.table(s, d, "part").groupBy(F.col("p_brand").alias("canonical")).agg(F.array_sort(F.collect_set("p_type")).alias("variants")).collect()
    sinks.write_json(s, {"rules": [{"canonical": r["canonical"], "variants": r["variants"]} for r in listed] + [{"canonical": "no variants"}, {"variants": ["no name"]}]}, path)
    return records.rules(s, path).select("canonical", F.array_join("variants", "|").alias("variants"))


@query("quoted_report", """SELECT '"' || macro_topic || '" (' || count(*) || ')' AS line FROM ev GROUP BY macro_topic""")
def quoted_report(s, d):
    path = counts.scratch(s, "report")
    sinks.write_quoted(views.event_speeches(s, d).groupBy("macro_topic").agg(F.count("*").alias("n")), path, "macro_topic", "n")
    return s.read.text(path).withColumnRenamed("value", "line")


@query("failures_log", "SELECT 'parse' AS kind, CAST(id AS VARCHAR) AS what, macro_topic AS message FROM ev WHERE macro_topic IN ('error', 'signup')")
def failures_log(s, d):
    """Failures of two runs, added one after the other."""
    path, rows = f"{counts.scratch(s, 'failures')}/failures", views.event_speeches(s, d)
    for topic in ("error", "signup"):
        sinks.log_failures(rows.where(F.col("macro_topic") == topic).select(F.lit("parse").alias("kind"), F.col("id").alias("what"), F.col("macro_topic").alias("message")), path)
    return sinks.read(s, path).drop("happened")


TITLED = "titled AS (SELECT DISTINCT p_type || CASE p_partkey % 4 WHEN 0 THEN ' voting time' WHEN 1 THEN ' Agenda' WHEN 2 THEN '' ELSE ' debate' END AS title, p_partkey % 4 < 2 AS p FROM part)"


@query("topic_classify_branches", f"""{TITLED} SELECT title, CASE WHEN p THEN 'Procedural & Parliamentary business' ELSE 'Other' END AS macro_topic, title AS specific_focus, CASE WHEN p THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM titled""")
def topic_classify_branches(s, d):
    nth = F.col("p_partkey") % 4
    title = F.concat("p_type", F.when(nth == 0, " voting time").when(nth == 1, " Agenda").when(nth == 2, "").otherwise(" debate"))
    return refresh.classify_topics(views.table(s, d, "part").select(title.alias("title")))


@query("topic_classify_failing", f"""{TITLED} SELECT title, 'Procedural & Parliamentary business' AS macro_topic, CASE WHEN p THEN NULL ELSE title END AS specific_focus, CASE WHEN p THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM titled""")
def topic_classify_failing(s, d):
    """A classifier that fails for batches of debates and gives no answer for the others: the fallback at 0.2 and 0.3."""

    def classifier(titles):
        if not titles[0].endswith((" voting time", " Agenda")):
            raise ValueError("no service")
        import pandas as pd

        return pd.DataFrame({"macro_topic": [None] * len(titles), "specific_focus": [None] * len(titles), "confidence": [None] * len(titles)}).head(len(titles) - 1)

    nth = F.col("p_partkey") % 4
    title = F.concat("p_type", F.when(nth == 0, " voting time").when(nth == 1, " Agenda").when(nth == 2, "").otherwise(" debate"))
    return refresh.classify_topics(views.table(s, d, "part").select(title.alias("title")), classifier, batch=1)


@query("mart_overview_gaps", """SELECT count(*) AS total, count(*) FILTER (WHERE sitting_id % 3 > 0) AS with_macro, floor(count(*) FILTER (WHERE sitting_id % 3 > 0) * 1000.0 / count(*) + 0.5) / 10.0 AS pct_with_macro FROM star""")
def mart_overview_gaps(s, d):
    path, rows = counts.scratch(s, "mart"), views.speeches(s, d)
    gaps = rows.withColumn("macro_topic", F.when(F.col("sitting_id") % 3 == 0, F.when(F.col("speech_order") > 1, " ")).otherwise(F.col("macro_topic")))
    mart.build(gaps, views.sittings(s, d), path)
    return mart.load(s, path)["overview"]


@query("agenda_by_words", """SELECT s.id, t.title FROM sittings s LEFT JOIN (SELECT DISTINCT activity_date, person_id, 'fishing water policy p' || person_id || ' debate' AS title FROM sittings WHERE label = 'F') t
  ON t.activity_date = s.activity_date AND t.person_id = s.person_id""")
def agenda_by_words(s, d):
    """Agenda entries without identifiers: the entry that shares four of five words."""
    rows = views.sittings(s, d)
    words = F.concat(F.lit("fishing water policy p"), "person_id")
    topics = rows.where("label = 'F'").select("activity_date", F.lit(None).cast("string").alias("docIdentifier"), F.concat(words, F.lit(" debate")).alias("title")).distinct()
    return R.match_agenda(rows.withColumns({"docIdentifier": F.col("person_id").cast("string"), "label": words}), topics)


SPOKEN = "regexp_replace(replace(speech_content, '–', '-'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


@query("speech_parse_openings", f"""said AS (SELECT sitting_id, speech_order, upper(substr(speaker_name, 1, 1)) || substr(speaker_name, 2) AS name, {SPOKEN} AS text,
  CAST(row_number() OVER (PARTITION BY sitting_id ORDER BY speech_order) AS INT) AS nth FROM turns WHERE trim(speech_content) <> '')
  SELECT sitting_id, nth AS speech_order, name AS speaker_name, CASE speech_order % 4 WHEN 0 THEN 'for it' WHEN 1 THEN 'PPE' WHEN 2 THEN 'S&D' END AS political_group,
  CASE speech_order % 4 WHEN 2 THEN 'rapporteur' END AS title, length(trim(text)) AS n FROM said""")
def speech_parse_openings(s, d):
    """A transcript whose speeches open in each of the forms: a group's sign, a party in brackets, both a party and a role, a name alone."""
    rows = views.turns(s, d).where(F.trim("speech_content") != "").withColumn("name", F.initcap("speaker_name"))
    nth = F.col("speech_order") % 4
    head = F.when(nth == 0, F.concat("name", F.lit(", for it"))).when(nth == 1, F.concat("name", F.lit(" (PPE)"))).when(nth == 2, F.concat("name", F.lit(" (S&D), rapporteur"))).otherwise(F.col("name"))
    text = F.regexp_replace(F.regexp_replace("speech_content", "–", "-"), r"\s+", " ")
    rows = rows.withColumn("speech_content", F.concat(head, F.lit(". – "), text))
    made = transcripts.parse_speeches(conversation.combined(rows, "\n"))
    return made.select("sitting_id", "speech_order", "speaker_name", "political_group", "title", F.length("speech_content").alias("n"))


CLEAN = "trim(regexp_replace(regexp_replace(replace(speech_content, '–', '-'), '[<>&]', ' ', 'g'), '[ \\t\\n\\r\\f\\v ]+', ' ', 'g'))"
NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(said)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _pages(s, d):
    """A page for each conversation, with one agenda entry and its turns as speeches."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("speech_content", "–", "-"), "[<>&]", " "), "[\\s ]+", " "))
    rows = views.turns(s, d).withColumn("said", text).where("said <> ''")
    line = F.concat(F.initcap("speaker_name"), F.lit(" (PPE). – "), "said")
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speech_order", line.alias("line")))), lambda x: x["line"]), "<br>\n")
    head = F.concat(F.lit('<html><body><table><tr><td class="doc_title"><img src="arrow_title_doc.gif">1. Topic number '), "sitting_id", F.lit(" (debate)</td></tr></table>\n"))
    return rows.groupBy("sitting_id").agg(F.concat(head, spoken, F.lit("<br>\n<!-- " + "z" * 500 + " --></body></html>")).alias("html"))


@query("page_to_speeches", f"""cleaned AS (SELECT sitting_id, speech_order, upper(substr(speaker_name, 1, 1)) || substr(speaker_name, 2) AS speaker_name, {CLEAN} AS said FROM turns)
  SELECT sitting_id, CAST(row_number() OVER (PARTITION BY sitting_id ORDER BY speech_order) AS INT) AS speech_order, speaker_name, 'PPE' AS political_group, length(said) AS n,
  CASE WHEN length({NORM}) >= 50 THEN 'Topic number ' || sitting_id END AS topic FROM cleaned WHERE said <> ''""")
def page_to_speeches(s, d):
    """Pages to speeches with the agenda entry each belongs to: main text, segmentation, sections and matching in one."""
    return refresh.speeches_of(_pages(s, d)).select("sitting_id", "speech_order", "speaker_name", "political_group", F.length("speech_content").alias("n"), "topic")
