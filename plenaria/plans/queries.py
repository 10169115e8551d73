"""The registered queries over the test tables, each with the DuckDB SQL that it must equal where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.functions import columns as C
from plenaria.functions import groups, language, pages, requests, transcripts
from plenaria.operators import analytics as A
from plenaria.operators import conversation, persons
from plenaria.operators import relational as R
from plenaria.plans import mart, rebuild, refresh
from plenaria.schema import SITTINGS
from plenaria.settings import bounded_batches
from plenaria.sources import sinks, views
from plenaria.streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {views.SQL}{'' if sql.lstrip().upper().startswith('SELECT') else ','}\n{sql}"
        return fn

    return add


def _dated(spark, d, start=None, end=None) -> DataFrame:
    return A.dated(views.speeches(spark, d), views.sittings(spark, d, start, end))


PERIOD = {"month": "substr(activity_date, 1, 7)", "quarter": "substr(activity_date, 1, 4) || '-Q' || ((CAST(substr(activity_date, 6, 2) AS INT) + 2) // 3)", "year": "substr(activity_date, 1, 4)"}
for _interval, _expr in PERIOD.items():
    query(f"ts_{_interval}", f"SELECT {_expr} AS period, macro_topic AS topic, count(*) AS n FROM dated GROUP BY 1, 2")(
        lambda s, d, i=_interval: A.time_series(_dated(s, d), i)
    )


@query("ts_range", "SELECT substr(activity_date, 1, 7) AS period, macro_topic AS topic, count(*) AS n FROM dated WHERE substr(activity_date, 1, 7) BETWEEN '1996-03' AND '1997-09' GROUP BY 1, 2")
def ts_range(s, d):
    return A.time_series(_dated(s, d, "1996-03-01", "1997-09-30"), "month", "1996-03", "1997-09")


MONTHS = "series AS (SELECT substr(activity_date, 1, 7) AS period, macro_topic AS topic, count(*) AS n FROM dated GROUP BY 1, 2)"
GRID = f"{MONTHS}, grid AS (SELECT p.period, t.topic, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM series) p CROSS JOIN (SELECT DISTINCT topic FROM series) t LEFT JOIN series s ON s.period = p.period AND s.topic = t.topic)"


@query("ts_grid_month", f"{GRID} SELECT * FROM grid")
def ts_grid_month(s, d):
    return A.grid(A.time_series(_dated(s, d)))


@query("ts_smooth6", f"""{GRID} SELECT period, topic, n, CASE WHEN count(*) OVER w = 6 THEN floor(CAST(sum(n) OVER w AS DOUBLE) / 6 * 100.0 + 0.5) / 100.0 END AS average
  FROM grid WINDOW w AS (PARTITION BY topic ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def ts_smooth6(s, d):
    return A.moving_average(A.grid(A.time_series(_dated(s, d))), 6)


@query("trend_top5_last12", f"""{MONTHS}, lead_topics AS (SELECT topic FROM series GROUP BY topic ORDER BY sum(n) DESC, topic LIMIT 5),
  late AS (SELECT DISTINCT period FROM series WHERE topic IN (SELECT topic FROM lead_topics) ORDER BY period DESC LIMIT 12)
  SELECT period, topic, n FROM series WHERE topic IN (SELECT topic FROM lead_topics) AND period IN (SELECT period FROM late)""")
def trend_top5_last12(s, d):
    return A.trends(_dated(s, d))


@query("overview_coverage", """SELECT count(*) AS total, count(*) FILTER (WHERE language IS NOT NULL) AS with_macro,
  floor(count(*) FILTER (WHERE language IS NOT NULL) * 1000.0 / count(*) + 0.5) / 10.0 AS pct_with_macro FROM star""")
def overview_coverage(s, d):
    return A.coverage(views.speeches(s, d).withColumn("macro_topic", F.col("language")))


TOPICS = "tops AS (SELECT macro_topic AS topic, count(*) AS n FROM star WHERE trim(macro_topic) <> '' GROUP BY 1 ORDER BY n DESC, topic LIMIT 20)"


@query("top_topics", f"{TOPICS} SELECT * FROM tops")
def top_topics(s, d):
    return A.top_topics(views.speeches(s, d))


@query("top_topics_ranked", f"{TOPICS} SELECT *, row_number() OVER (ORDER BY n DESC, topic) AS topic_rank FROM tops")
def top_topics_ranked(s, d):
    return A.ranked(A.top_topics(views.speeches(s, d)), "topic")


@query("top_focus", "SELECT macro_topic AS topic, macro_specific_focus AS focus, count(*) AS n FROM star GROUP BY 1, 2 ORDER BY n DESC, topic, focus LIMIT 20")
def top_focus(s, d):
    return A.top_focuses(views.speeches(s, d))


CELLS = "cells AS (SELECT macro_topic AS topic, coalesce(political_group_std, political_group) AS grp, count(*) AS n FROM star GROUP BY 1, 2)"
LEADING = "lead_groups AS (SELECT grp FROM cells WHERE grp IS NOT NULL GROUP BY grp ORDER BY sum(n) DESC, grp LIMIT 10)"


@query("by_group_long", f"{CELLS}, {LEADING} SELECT * FROM cells WHERE grp IN (SELECT grp FROM lead_groups)")
def by_group_long(s, d):
    return A.by_group(views.speeches(s, d))


@query("by_group_pivot", f"""{CELLS} SELECT topic, CAST(coalesce(sum(n) FILTER (WHERE grp = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(n) FILTER (WHERE grp = 'F'), 0) AS BIGINT) AS F,
  CAST(coalesce(sum(n) FILTER (WHERE grp = 'N'), 0) AS BIGINT) AS N, CAST(coalesce(sum(n) FILTER (WHERE grp = 'R'), 0) AS BIGINT) AS R FROM cells GROUP BY topic""")
def by_group_pivot(s, d):
    return A.pivoted(A.by_group(views.speeches(s, d)), "grp", ["A", "F", "N", "R"])


@query("top_groups", f"{CELLS} SELECT grp, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE grp IS NOT NULL GROUP BY grp ORDER BY n DESC, grp LIMIT 10")
def top_groups(s, d):
    return A.top_groups(views.speeches(s, d))


@query("by_language", "SELECT macro_topic AS topic, upper(coalesce(language, 'UNK')) AS language, count(*) AS n FROM star GROUP BY 1, 2")
def by_language(s, d):
    return A.by_language(views.speeches(s, d))


@query("languages", "SELECT upper(coalesce(language, 'UNK')) AS language, count(*) AS n FROM star GROUP BY 1")
def languages(s, d):
    return A.languages(views.speeches(s, d))


@query("languages_for_topics", "SELECT upper(coalesce(language, 'UNK')) AS language, count(*) AS n FROM ev2 WHERE macro_topic IN ('click', 'view') GROUP BY 1".replace("ev2", "(SELECT *, CASE WHEN mep_id % 3 = 0 THEN NULL ELSE 'en' END AS language FROM ev)"))
def languages_for_topics(s, d):
    rows = views.event_speeches(s, d).withColumn("language", F.when(F.col("mep_id") % 3 != 0, "en"))
    return A.languages(rows, ["click", "view"])


@query("top_speakers", """SELECT mep_id, label, country, grp, n FROM (SELECT mep_id, coalesce(political_group_std, political_group) AS grp, count(*) AS n FROM star
  WHERE macro_topic = (SELECT min(macro_topic) FROM star) GROUP BY 1, 2) LEFT JOIN persons ON id = mep_id ORDER BY n DESC, mep_id, grp LIMIT 10""")
def top_speakers(s, d):
    facts = views.speeches(s, d)
    first = facts.agg(F.min("macro_topic").alias("first"))
    return A.top_speakers(facts.join(F.broadcast(first), F.col("macro_topic") == F.col("first")), views.persons(s, d))


@query("persons_with_counts", "SELECT persons.*, coalesce(n, 0) AS n FROM persons LEFT JOIN (SELECT mep_id, count(*) AS n FROM ev GROUP BY 1) ON id = mep_id")
def persons_with_counts(s, d):
    return A.persons_with_counts(views.persons(s, d), views.event_speeches(s, d))


@query("persons_filtered", """SELECT persons.*, n FROM persons JOIN (SELECT mep_id, count(*) AS n FROM ev GROUP BY 1) ON id = mep_id WHERE n >= 5 AND is_current""")
def persons_filtered(s, d):
    return A.filter_persons(A.persons_with_counts(views.persons(s, d), views.event_speeches(s, d)), current=True, at_least=5)


@query("small_groups_to_other", """SELECT id, label, CASE WHEN (SELECT count(*) FROM persons q WHERE q.country = p.country) < 60 THEN 'Other' ELSE country END AS country FROM persons p""")
def small_groups_to_other(s, d):
    return persons.small_to_other(views.persons(s, d), "country", 60).select("id", "label", "country")


MODE = "SELECT mep_id, macro_topic FROM (SELECT mep_id, macro_topic, row_number() OVER (PARTITION BY mep_id ORDER BY count(*) DESC, min(id)) AS k FROM ev GROUP BY 1, 2) WHERE k = 1"


@query("person_affiliation_mode", MODE)
def person_affiliation_mode(s, d):
    return persons.most_frequent(views.event_speeches(s, d), "mep_id", "macro_topic", "id")


@query("first_group_per_person", "SELECT mep_id, macro_topic FROM (SELECT mep_id, macro_topic, row_number() OVER (PARTITION BY mep_id ORDER BY id) AS k FROM ev WHERE macro_topic <> 'view') WHERE k = 1")
def first_group_per_person(s, d):
    return persons.first_value(views.event_speeches(s, d).withColumn("macro_topic", F.nullif("macro_topic", F.lit("view"))), "mep_id", "macro_topic", "id")


@query("sittings_page", """SELECT s.*, (SELECT count(*) FROM star WHERE sitting_id = s.id) AS n FROM (SELECT * FROM sittings WHERE activity_date BETWEEN '1996-01-01' AND '1998-12-31'
  ORDER BY activity_date DESC, id LIMIT 50 OFFSET 100) s""")
def sittings_page(s, d):
    return R.sittings_page(views.sittings(s, d, "1996-01-01", "1998-12-31"), views.speeches(s, d), "1996-01-01", "1998-12-31", 50, 100)


@query("person_speeches_page", "SELECT * FROM ev WHERE mep_id = 7 ORDER BY activity_date DESC, id LIMIT 25 OFFSET 5")
def person_speeches_page(s, d):
    return R.page(views.event_speeches(s, d).where("mep_id = 7"), [F.desc("activity_date"), F.asc("id")], 25, 5)


@query("sittings_total_distinct", "SELECT count(DISTINCT sitting_id) AS total FROM dated WHERE activity_date >= '1997-01-01'")
def sittings_total_distinct(s, d):
    return _dated(s, d, "1997-01-01").agg(F.countDistinct("sitting_id").alias("total"))


@query("sittings_without_speeches", "SELECT * FROM sittings s WHERE NOT EXISTS (SELECT 1 FROM star WHERE sitting_id = s.id)")
def sittings_without_speeches(s, d):
    return R.without_facts(views.sittings(s, d), views.speeches(s, d))


@query("sittings_with_speeches", "SELECT * FROM sittings s WHERE EXISTS (SELECT 1 FROM star WHERE sitting_id = s.id)")
def sittings_with_speeches(s, d):
    return R.with_facts(views.sittings(s, d), views.speeches(s, d))


DONE = "done AS (SELECT sitting_id, count(*) AS n, count(*) FILTER (WHERE language IS NULL OR language = '') AS n_unset FROM star GROUP BY 1)"


@query("fully_processed_latest", f"{DONE} SELECT max(activity_date) AS activity_date FROM sittings JOIN done ON id = sitting_id WHERE n_unset = 0")
def fully_processed_latest(s, d):
    return R.fully_processed_latest(views.sittings(s, d), views.speeches(s, d), "language")


@query("needs_processing", f"{DONE} SELECT sittings.* FROM sittings LEFT JOIN done ON id = sitting_id WHERE n IS NULL OR n_unset > 0")
def needs_processing(s, d):
    return R.needs_processing(views.sittings(s, d), views.speeches(s, d), "language")


@query("new_dates", """SELECT strftime(t, '%Y-%m-%d') AS activity_date FROM (SELECT unnest(generate_series(TIMESTAMP '2001-06-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS t)
  WHERE strftime(t, '%Y-%m-%d') NOT IN (SELECT activity_date FROM sittings)""")
def new_dates(s, d):
    return R.new_dates(R.dates(s, "2001-06-01", "2001-12-31"), views.sittings(s, d))


@query("date_union", "SELECT activity_date FROM sittings UNION SELECT activity_date FROM ev")
def date_union(s, d):
    return R.date_union(views.sittings(s, d), views.event_speeches(s, d))


@query("dup_sittings", "SELECT activity_date, count(*) AS n FROM sittings GROUP BY 1 HAVING count(*) > 1")
def dup_sittings(s, d):
    return R.repeated(views.sittings(s, d), ["activity_date"])


@query("dup_texts", """SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_key, max(doc_id) AS last_key, count(DISTINCT doc_id) AS keys
  FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_texts(s, d):
    return R.duplicate_groups(views.table(s, d, "documents"), "text", "doc_id")


@query("dedupe_texts", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def dedupe_texts(s, d):
    return R.keep_first(views.table(s, d, "documents"), "text", "doc_id").select("doc_id", "lang", "n_chars")


@query("longest_per_day", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def longest_per_day(s, d):
    return R.longest_per(views.table(s, d, "documents"), "source", "text", "doc_id").select("source", "doc_id", "n_chars")


@query("refresh_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE length(text) > 100) AS with_content, max(doc_id) AS last FROM documents")
def refresh_stats(s, d):
    return views.table(s, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.length("text") > 100).alias("with_content"), F.max("doc_id").alias("last"))


@query("era_case", """SELECT activity_date, CASE WHEN activity_date < '1997-06-23' THEN 1 ELSE 0 END AS early,
  CASE WHEN shifted < '2016-06-23' THEN 'Pre-Brexit' WHEN shifted <= '2020-01-31' THEN 'Brexit-Negotiation' ELSE 'Post-Brexit' END AS era,
  CASE WHEN shifted BETWEEN '2020-03-01' AND '2022-06-01' THEN 'COVID-Crisis' WHEN shifted >= '2022-02-24' THEN 'Ukraine-War' ELSE 'Normal' END AS crisis, count(*) AS n
  FROM (SELECT activity_date, (CAST(substr(activity_date, 1, 4) AS INT) + 21) || substr(activity_date, 5) AS shifted FROM sittings) GROUP BY ALL""")
def era_case(s, d):
    day = F.col("activity_date")
    shifted = F.concat((F.substring(day, 1, 4).cast("int") + 21).cast("string"), F.substring(day, 5, 10))
    rows = views.sittings(s, d).select(day, F.when(day < "1997-06-23", 1).otherwise(0).alias("early"), C.brexit_era(shifted).alias("era"), C.crisis_era(shifted).alias("crisis"))
    return A.counted(rows, "activity_date", "early", "era", "crisis")


@query("term_lookup", """SELECT activity_date, CASE WHEN activity_date >= '2024-07-16' THEN 10 WHEN activity_date >= '2019-07-02' THEN 9 WHEN activity_date >= '2014-07-01' THEN 8
  WHEN activity_date >= '2009-07-14' THEN 7 WHEN activity_date >= '2004-07-20' THEN 6 WHEN activity_date >= '1999-07-20' THEN 5 WHEN activity_date >= '1994-07-19' THEN 4
  WHEN activity_date >= '1989-07-25' THEN 3 WHEN activity_date >= '1984-07-24' THEN 2 ELSE 1 END AS term, count(*) AS n FROM sittings GROUP BY ALL""")
def term_lookup(s, d):
    return A.counted(views.sittings(s, d), "activity_date", C.term("activity_date").alias("term"))


@query("speaker_stats", """SELECT mep_id, count(*) AS n, CAST(floor(avg(length(props)) + 0.5) AS BIGINT) AS mean_size, min(activity_date) AS first_day, max(activity_date) AS last_day,
  count(DISTINCT activity_date) AS days, count(DISTINCT substr(activity_date, 1, 4)) AS years FROM ev GROUP BY 1 HAVING count(*) >= 5""")
def speaker_stats(s, d):
    return A.speaker_stats(views.event_speeches(s, d).withColumn("size", F.length("props")))


@query("group_year_summary", """SELECT coalesce(political_group_std, political_group) AS grp, substr(activity_date, 1, 4) AS year, count(*) AS n, count(DISTINCT mep_id) AS speakers,
  count(DISTINCT activity_date) AS days FROM dated GROUP BY 1, 2""")
def group_year_summary(s, d):
    return A.group_year_summary(_dated(s, d))


@query("dq_counters", """SELECT * FROM (SELECT mep_id, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(language), '') = '') AS raw_empty,
  count(*) FILTER (WHERE coalesce(trim(rare), '') = '') AS std_empty, count(*) FILTER (WHERE coalesce(trim(rare), '') <> '') AS std_set
  FROM (SELECT *, CASE WHEN mep_id % 2 = 0 THEN political_group_std END AS rare FROM star) GROUP BY 1) WHERE std_set = 0""")
def dq_counters(s, d):
    rows = views.speeches(s, d).withColumn("political_group", F.col("language")).withColumn("political_group_std", F.when(F.col("mep_id") % 2 == 0, F.col("political_group_std")))
    return A.quality_counters(rows)


@query("topic_counts", "SELECT trim(macro_topic) AS topic, count(*) AS n FROM star GROUP BY 1")
def topic_counts(s, d):
    return A.topic_counts(views.speeches(s, d))


@query("topic_presence", "SELECT sitting_id, count(*) AS n, count(language) AS with_language FROM star GROUP BY 1")
def topic_presence(s, d):
    return A.presence(views.speeches(s, d))


@query("recent_sittings", "SELECT s.*, (SELECT count(*) FROM star WHERE sitting_id = s.id) AS n FROM (SELECT * FROM sittings ORDER BY activity_date DESC, id LIMIT 20) s")
def recent_sittings(s, d):
    return R.sittings_page(views.sittings(s, d), views.speeches(s, d), limit=20)


@query("persons_by_country", "SELECT country, count(*) AS n FROM persons GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
def persons_by_country(s, d):
    return A.top(A.counted(views.persons(s, d), "country"), 10, "country")


@query("largest_per_date", """SELECT activity_date, count(*) AS sittings, max(coalesce(n, 0)) AS most, min(id) AS first_id FROM sittings
  LEFT JOIN (SELECT sitting_id, count(*) AS n FROM star GROUP BY 1) ON id = sitting_id GROUP BY 1""")
def largest_per_date(s, d):
    return A.largest_per_date(views.sittings(s, d), views.speeches(s, d))


@query("classification_costs", """SELECT macro_topic, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS tokens, floor(sum(length(props)) / 1e6 * 0.4 * 1e6 + 0.5) / 1e6 AS cost FROM ev GROUP BY 1""")
def classification_costs(s, d):
    rows = views.event_speeches(s, d).groupBy("macro_topic").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("tokens"))
    return rows.withColumn("cost", C.rounded(C.cost(F.col("tokens"), 0.4), 6))


@query("metadata", """SELECT string_agg(DISTINCT coalesce(political_group_std, political_group), ',' ORDER BY coalesce(political_group_std, political_group)) AS groups,
  string_agg(DISTINCT substr(activity_date, 1, 4), ',' ORDER BY substr(activity_date, 1, 4)) AS years, min(activity_date) AS first_day, max(activity_date) AS last_day FROM dated""")
def metadata(s, d):
    return A.metadata(_dated(s, d))


@query("newest15", "SELECT id, mep_id, activity_date, k AS nth FROM (SELECT *, row_number() OVER (PARTITION BY mep_id ORDER BY activity_date DESC, id DESC) AS k FROM ev) WHERE k <= 15")
def newest15(s, d):
    return A.newest(views.event_speeches(s, d)).select("id", "mep_id", "activity_date", "nth")


@query("sample_per_language", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k,
  count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= 80 AND n >= 10""")
def sample_per_language(s, d):
    return A.sampled(views.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


def _full_columns() -> dict:
    """Texts made of the facts' keys, so that each field of an export has a value of its own."""
    k, n = F.col("sitting_id"), F.col("speech_order")
    return {
        "id": k * 10 + n, "speaker_name": F.concat(F.lit("Speaker "), "mep_id"), "title": F.concat(F.lit("Title "), n), "speech_content": F.repeat("macro_topic", 3),
        "topic": F.concat("macro_topic", F.lit(" ("), n, F.lit(")")), "political_group_raw": F.concat(F.lit("raw "), "political_group"), "political_group_kind": F.lit("group"),
        "political_group_reason": F.when(n == 1, "direct_canonical"), "macro_confidence": n / F.lit(10.0), "macro_classified_by": F.lit("rules"),
        "macro_classification_cost": (k % 7) / F.lit(4.0), "created_at": F.lit(None).cast("timestamp"), "macro_classified_at": F.lit(None).cast("timestamp"),
    }


def _full_speeches(s, d) -> DataFrame:
    return views.speeches(s, d).withColumns(_full_columns())


FULL = """full_star AS (SELECT *, sitting_id * 10 + speech_order AS id, 'Speaker ' || mep_id AS speaker_name, 'Title ' || speech_order AS title, repeat(macro_topic, 3) AS speech_content,
  macro_topic || ' (' || speech_order || ')' AS topic, 'raw ' || political_group AS political_group_raw, 'group' AS political_group_kind,
  CASE WHEN speech_order = 1 THEN 'direct_canonical' END AS political_group_reason, speech_order / 10.0::DOUBLE AS macro_confidence, 'rules' AS macro_classified_by,
  (sitting_id % 7) / 4.0::DOUBLE AS macro_classification_cost FROM star)"""
FROM_FULL = "FROM full_star f LEFT JOIN sittings ON sittings.id = sitting_id LEFT JOIN persons ON persons.id = mep_id"


@query("export_default", f"""{FULL} SELECT f.id, sitting_id, activity_date AS date, speaker_name, coalesce(political_group_std, f.political_group) AS political_group, title, speech_content,
  language, macro_topic, macro_specific_focus AS specific_focus, topic, country, mep_id {FROM_FULL} WHERE activity_date BETWEEN '1997-01-01' AND '1997-12-31'""")
def export_default(s, d):
    days = views.sittings(s, d, "1997-01-01", "1997-12-31")
    return R.export(views.speeches(s, d, of=days), days, views.persons(s, d), start="1997-01-01", end="1997-12-31", made=_full_columns())


@query("export_all", f"""{FULL} SELECT f.id, sitting_id, activity_date AS date, activity_date || 'T00' AS activity_start_date, type AS activity_type, speech_order, CAST(NULL AS TIMESTAMP) AS created_at,
  speaker_name, mep_id, country, coalesce(political_group_std, f.political_group) AS political_group, political_group_raw, political_group_std, political_group_kind, political_group_reason,
  title, speech_content, language, 'Content ' || sittings.label AS sitting_content, sittings.label AS sitting_label, type AS sitting_type, 'D' || sittings.id AS doc_identifier,
  CAST(NULL AS VARCHAR) AS notation_id, topic, macro_topic, macro_specific_focus AS specific_focus, macro_confidence, macro_classified_by, CAST(NULL AS TIMESTAMP) AS macro_classified_at,
  macro_classification_cost {FROM_FULL} WHERE activity_date >= '1998-01-01'""")
def export_all(s, d):
    """All fields; the table of sittings lacks one of its columns."""
    more = {"activity_start_date": F.concat("activity_date", F.lit("T00")), "activity_type": F.col("type"), "content": F.concat(F.lit("Content "), "label"), "docIdentifier": F.concat(F.lit("D"), "id")}
    days = views.sittings(s, d, "1998-01-01").withColumns(more)
    return R.export(views.speeches(s, d, of=days), days, views.persons(s, d), list(R.EXPORT), start="1998-01-01", made=_full_columns())


@query("topics_asked", """SELECT upper(coalesce(language, 'UNK')) AS language, count(*) AS n FROM (SELECT CASE WHEN id % 2 = 0 THEN upper(macro_topic) ELSE macro_topic END AS macro_topic,
  CASE WHEN mep_id % 3 = 0 THEN NULL ELSE 'en' END AS language FROM ev) WHERE lower(macro_topic) IN ('click', 'view') GROUP BY 1""")
def topics_asked(s, d):
    """A JSON list of canonical topics, each with the variants that the facts have."""
    rows = views.event_speeches(s, d).withColumn("language", F.when(F.col("mep_id") % 3 != 0, "en"))
    rows = rows.withColumn("macro_topic", F.when(F.col("id") % 2 == 0, F.upper("macro_topic")).otherwise(F.col("macro_topic")))
    asked = requests.topic_filter('["CLICK", "VIEW"]')
    return A.languages(rows.join(requests.with_variants(asked, mart.topic_variants(rows)), "macro_topic", "left_semi"))


@query("time_frames", """SELECT 'year' AS frame, count(*) AS n FROM sittings WHERE activity_date >= '1997-08-31' UNION ALL SELECT '6months', count(*) FROM sittings WHERE activity_date >= '1998-03-03'
  UNION ALL SELECT '3months', count(*) FROM sittings WHERE activity_date >= '1998-05-31' UNION ALL SELECT 'custom', count(*) FROM sittings WHERE activity_date <= '1995-01-31' UNION ALL SELECT 'all', count(*) FROM sittings""")
def time_frames(s, d):
    """Sittings of each named span before a day whose date some months lack."""
    frames = {name: requests.time_frame(name, "1998-08-31", end="1995-01-31") for name in ("year", "6months", "3months", "custom", "all")}
    inside = F.array(*(F.when(C.between("activity_date", *span), F.lit(name)) for name, span in frames.items()))
    days = A.counted(views.sittings(s, d), "activity_date").select(F.explode(F.array_compact(inside)).alias("frame"), "n")
    return days.groupBy("frame").agg(F.sum("n").alias("n"))


@query("export_fields", "SELECT sitting_id, language, country FROM star LEFT JOIN persons ON persons.id = mep_id")
def export_fields(s, d):
    return R.export(views.speeches(s, d), views.sittings(s, d), views.persons(s, d), ["sitting_id", "language", "nothing", "country"])


@query("export_count", "SELECT count(*) AS n FROM dated WHERE activity_date >= '1997-01-01'")
def export_count(s, d):
    return _dated(s, d, "1997-01-01").agg(F.count("*").alias("n"))


VARIED = "varied AS (SELECT CASE sitting_id % 4 WHEN 0 THEN macro_topic WHEN 1 THEN lower(macro_topic) || ' ' WHEN 2 THEN 'X &amp; ' || macro_topic ELSE 'x & ' || replace(macro_topic, ' ', ' – ') END AS macro_topic FROM star)"
LABEL = "trim(replace(replace(replace({c}, '&amp;', '&'), '–', '-'), '—', '-'))"


def _varied(s, d) -> DataFrame:
    t, k = F.col("macro_topic"), F.col("sitting_id") % 4
    other = F.concat(F.lit("x & "), F.replace(t, F.lit(" "), F.lit(" – ")))
    value = F.when(k == 0, t).when(k == 1, F.concat(F.lower(t), F.lit(" "))).when(k == 2, F.concat(F.lit("X &amp; "), t)).otherwise(other)
    return views.speeches(s, d).select(value.alias("macro_topic"))


@query("topic_normalize", f"{VARIED} SELECT {LABEL.format(c='macro_topic')} AS topic, count(*) AS n FROM varied GROUP BY 1")
def topic_normalize(s, d):
    return A.counted(_varied(s, d), C.topic_label("macro_topic").alias("topic"))


@query("topic_collapse_variants", f"""{VARIED}, labels AS (SELECT DISTINCT macro_topic, {LABEL.format(c='macro_topic')} AS label FROM varied)
  SELECT trim(regexp_replace(regexp_replace(lower(label), '\\s*-\\s*', ' ', 'g'), '\\s+', ' ', 'g')) AS key, min(label) AS topic, string_agg(macro_topic, '|' ORDER BY macro_topic) AS variants FROM labels GROUP BY 1""")
def topic_collapse_variants(s, d):
    return mart.topic_variants(_varied(s, d)).select("key", "topic", F.array_join("variants", "|").alias("variants"))


def _rules(s) -> DataFrame:
    rows = [("Access", ["click", "view"]), ("Signs", ["signup", "view"]), ("None (other)", ["error"]), ("purchase", ["purchase"])]
    return s.createDataFrame(rows, "canonical string, variants array<string>")


RULED = "CASE WHEN macro_topic IN ('click', 'view') THEN 'Access' WHEN macro_topic = 'signup' THEN 'Signs' ELSE macro_topic END"


@query("rules_apply", f"SELECT {RULED} AS macro_topic, count(*) AS n FROM ev GROUP BY 1")
def rules_apply(s, d):
    return A.counted(R.apply_rules(views.event_speeches(s, d), _rules(s)), "macro_topic")


@query("rules_impact", f"SELECT {RULED} AS canonical, count(*) AS n FROM ev WHERE macro_topic IN ('click', 'view', 'signup') GROUP BY 1")
def rules_impact(s, d):
    return R.rules_impact(views.event_speeches(s, d), _rules(s))


@query("label_fallback_json", "SELECT id, coalesce(json_extract_string(props, '$.EN'), json_extract_string(props, '$.k'), '') AS label FROM ev")
def label_fallback_json(s, d):
    return views.event_speeches(s, d).select("id", C.label_of(F.from_json("props", "map<string,string>")).alias("label"))


@query("upsert_sittings", """SELECT id, activity_date, 'new' AS label FROM sittings WHERE id % 5 = 0 UNION ALL SELECT id + 10000000, activity_date, 'new' FROM sittings WHERE id % 7 = 0
  UNION ALL SELECT id, activity_date, label FROM sittings WHERE id % 5 <> 0""")
def upsert_sittings(s, d):
    old = views.sittings(s, d).select("id", "activity_date", "label")
    new = old.where("id % 5 = 0").union(old.where("id % 7 = 0").withColumn("id", F.col("id") + 10_000_000)).withColumn("label", F.lit("new"))
    return sinks.upserted(old, new)


@query("insert_absent", "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)")
def insert_absent(s, d):
    return sinks.absent(views.sittings(s, d).select("id"), views.event_speeches(s, d).select("id"))


@query("grouped_records", """SELECT activity_date, count(*) AS n, min(id) AS id, arg_min(type, id) AS type, arg_min(label, id) AS label FROM sittings GROUP BY 1""")
def grouped_records(s, d):
    rows = views.sittings(s, d).withColumns({"activity_start_date": F.col("activity_date"), "activity_date": F.when(F.col("id") % 2 == 0, F.col("activity_date")), "ordinal": F.col("id")})
    return R.grouped_records(rows)


@query("subset_since", """SELECT (SELECT count(*) FROM sittings WHERE activity_date >= '1999-01-01') AS sittings, (SELECT count(*) FROM dated WHERE activity_date >= '1999-01-01') AS speeches,
  (SELECT count(*) FROM persons WHERE id IN (SELECT mep_id FROM dated WHERE activity_date >= '1999-01-01')) AS persons""")
def subset_since(s, d):
    named = views.persons(s, d).withColumns({"givenName": F.lit(""), "familyName": F.lit("")})
    parts = sinks.subset(views.sittings(s, d, "1999-01-01"), views.speeches(s, d).withColumn("speaker_name", F.lit(None).cast("string")), named, "1999-01-01")
    out = None
    for name, part in zip(("sittings", "speeches", "persons"), parts):
        one = part.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


@query("link_speakers", """SELECT label AS speaker_name, min(id) AS person_id FROM persons WHERE id % 3 = 0 GROUP BY 1 UNION ALL SELECT 'Nobody Known', NULL""")
def link_speakers(s, d):
    known = views.persons(s, d)
    turned = F.array_join(F.reverse(F.split("label", "#")), "#")
    names = known.where("id % 3 = 0").select(F.when(turned == "", "").otherwise(F.col("label")).alias("speaker_name")).distinct()
    return persons.link_speakers(names.union(s.range(1).select(F.lit("Nobody Known").alias("speaker_name"))), known)


@query("missing_persons", """SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY n DESC, label) AS id, label, n
  FROM (SELECT speaker_name AS label, count(*) AS n FROM turns GROUP BY 1)""")
def missing_persons(s, d):
    known = views.persons(s, d).withColumns({"givenName": F.lit(None).cast("string"), "familyName": F.lit(None).cast("string")})
    return persons.missing_persons(views.turns(s, d).withColumn("mep_id", F.lit(None).cast("long")), known).select("id", "label", "n")


@query("conv_topk4", "SELECT sitting_id, speech_order, k || ' of ' || m AS place FROM (SELECT *, row_number() OVER (PARTITION BY sitting_id, speaker_name ORDER BY speech_order) AS k, count(*) OVER (PARTITION BY sitting_id, speaker_name) AS m FROM turns) WHERE k <= 4")
def conv_topk4(s, d):
    return conversation.first_per_topic(views.turns(s, d)).select("sitting_id", "speech_order", "place")


@query("conv_last6", "SELECT sitting_id, speech_order, k AS back FROM (SELECT *, row_number() OVER (PARTITION BY sitting_id ORDER BY speech_order DESC) AS k FROM turns) WHERE k <= 6")
def conv_last6(s, d):
    return conversation.last_turns(views.turns(s, d)).select("sitting_id", "speech_order", "back")


@query("conv_change", "SELECT sitting_id, speech_order, coalesce(lag(speaker_name) OVER (PARTITION BY sitting_id ORDER BY speech_order) <> speaker_name, true) AS changed FROM turns")
def conv_change(s, d):
    return conversation.changes(views.turns(s, d)).select("sitting_id", "speech_order", "changed")


@query("conv_speakers", "SELECT sitting_id, speaker_name, min(speech_order) AS first_turn, count(*) AS n FROM turns GROUP BY 1, 2")
def conv_speakers(s, d):
    return conversation.speakers(views.turns(s, d))


@query("conv_combined_text", "SELECT sitting_id, string_agg(coalesce(speech_content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY speech_order) AS content FROM turns GROUP BY 1")
def conv_combined_text(s, d):
    return conversation.combined(views.turns(s, d))


@query("conv_context", """SELECT sitting_id, string_agg(speaker_name || ': ' || speech_content, chr(10) ORDER BY speech_order) AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY sitting_id ORDER BY speech_order DESC) AS k FROM turns) WHERE k <= 6 GROUP BY 1""")
def conv_context(s, d):
    return conversation.context(views.turns(s, d))


@query("text_clean", "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS cleaned FROM pages")
def text_clean(s, d):
    return views.table(s, d, "pages").select("page_id", F.sha2(C.cleaned("html"), 256).alias("cleaned"))


@query("script_ratio", """SELECT doc_id, CASE WHEN n >= 20 AND g >= 0.3 * n THEN 'EL' WHEN n >= 20 AND c >= 0.3 * n THEN 'BG' END AS language FROM (SELECT doc_id,
  length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS n, length(regexp_replace(text, '[^\\x{0370}-\\x{03FF}]', '', 'g')) AS g,
  length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS c FROM documents)""")
def script_ratio(s, d):
    return views.table(s, d, "documents").select("doc_id", C.script_language("text")["language"].alias("language"))


JACCARD = "regexp_split_to_array(lower({c}), '[^a-z0-9]+')"


@query("jaccard_best", f"""parts AS (SELECT p_partkey, p_brand, list_filter(list_distinct({JACCARD.format(c="p_name || ' ' || p_type")}), lambda x: x <> '') AS t FROM part),
  brands AS (SELECT p_brand, p_type, list_filter(list_distinct({JACCARD.format(c="p_type")}), lambda x: x <> '') AS u FROM part GROUP BY ALL)
  SELECT p_partkey, score, p_type FROM (SELECT p_partkey, p_type, len(list_intersect(t, u)) / greatest(len(list_distinct(list_concat(t, u))), 1) AS score,
  row_number() OVER (PARTITION BY p_partkey ORDER BY len(list_intersect(t, u)) / greatest(len(list_distinct(list_concat(t, u))), 1) DESC, p_type DESC) AS k
  FROM parts JOIN brands USING (p_brand)) WHERE k = 1 AND score >= 0.2""")
def jaccard_best(s, d):
    part = views.table(s, d, "part")
    left = part.select("p_partkey", "p_brand", C.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    right = part.select("p_brand", "p_type", C.tokens("p_type").alias("u")).distinct()
    return R.best_match(left, right, "p_brand", C.jaccard(F.col("t"), F.col("u")), 0.2, "p_partkey", "p_type")


@query("filtered_listing", "SELECT id, label FROM persons WHERE lower(label) LIKE '%00001%' AND length(label) BETWEEN 5 AND 100 AND country IN ('FRANCE', 'NATION_1', 'NATION_2', 'GERMANY')")
def filtered_listing(s, d):
    rows = views.persons(s, d).where(F.contains(F.lower("label"), F.lit("00001")) & F.length("label").between(5, 100))
    return rows.where(F.col("country").isin("FRANCE", "NATION_1", "NATION_2", "GERMANY")).select("id", "label")


@query("latest_day", "SELECT id, mep_id FROM ev WHERE activity_date = (SELECT max(activity_date) FROM ev)")
def latest_day(s, d):
    rows = views.event_speeches(s, d)
    return rows.join(F.broadcast(rows.agg(F.max("activity_date").alias("activity_date"))), "activity_date").select("id", "mep_id")


@query("unknown_records", "SELECT id FROM (SELECT o_orderkey AS id, o_custkey % 400 AS k FROM orders) WHERE id >= 500 AND k NOT BETWEEN 1 AND 99 AND (id % 10 <> 3)")
def unknown_records(s, d):
    rows = views.sittings(s, d).select(F.col("id").cast("string").alias("id"), (F.col("person_id") % 400).cast("string").alias("docIdentifier"), (F.col("id") % 10).cast("string").alias("notationId"))
    known = s.range(500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id").between(1, 99), F.col("id").cast("string")).otherwise("").alias("docIdentifier"), F.lit("3").alias("notationId"))
    return R.unknown_records(rows, known).select(F.col("id").cast("long").alias("id"))


TO_DO = """tasks AS (SELECT sitting_id, count(*) AS n, count(*) FILTER (WHERE sitting_id % 50 = 0) AS n_unset FROM star GROUP BY 1),
  latest AS (SELECT coalesce(max(activity_date)::DATE + 1, DATE '1999-07-20') AS first FROM sittings JOIN tasks ON id = sitting_id WHERE n_unset = 0)"""


@query("days_to_process", f"""{TO_DO} SELECT strftime(t, '%Y-%m-%d') AS activity_date FROM (SELECT unnest(generate_series(first::TIMESTAMP, TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS t FROM latest)
  WHERE strftime(t, '%Y-%m-%d') NOT IN (SELECT activity_date FROM sittings)
  UNION SELECT activity_date FROM sittings LEFT JOIN tasks ON id = sitting_id WHERE n IS NULL OR n_unset > 0""")
def days_to_process(s, d):
    return refresh.days_to_process(s, views.sittings(s, d), views.speeches(s, d).withColumn("macro_topic", F.when(F.col("sitting_id") % 50 > 0, F.col("macro_topic"))), "2001-12-31")


@query("mart_series", f"{GRID} SELECT period, topic, CAST(n AS BIGINT) AS n FROM grid WHERE period BETWEEN '1996-01' AND '1996-12'")
def mart_series(s, d):
    path = counts.scratch(s, "mart")
    mart.build(views.speeches(s, d), views.sittings(s, d), path)
    return mart.series(mart.load(s, path), "month", "1996-01", "1996-12")


@query("stream_daily_counts", "SELECT activity_date AS day, macro_topic AS topic, count(*) AS n, sum(value) AS total FROM ev GROUP BY 1, 2".replace("sum(value)", "floor(sum(value) * 100 + 0.5) / 100"))
def stream_daily_counts(s, d):
    out = counts.run_daily(s, d, "events.parquet", counts.scratch(s, "daily"))
    return out.withColumn("total", C.rounded(F.col("total"), 2))


@query("group_normalize")
def group_normalize(s, d):
    """Group texts made of the sources and roles of the tables."""
    rows = views.table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    forms = F.array(*(F.concat(F.lit(a), F.lit(b)) for a, b in (("on behalf of the ", "S&D Group"), ("", "GUE/NGL"), ("rapporteur for ", "it"), ("Name (", "PPE)"))), F.col("source"))
    return groups.group_decisions(rows.select(F.explode(forms).alias("raw"), "n")).groupBy("raw", "std", "kind", "reason").agg(F.sum("n").alias("n"))


@query("html_text")
def html_text(s, d):
    return pages.read(views.table(s, d, "pages"), pages.main_text).select("page_id", F.length("value").alias("n"), F.sha2("value", 256).alias("digest"))


@query("html_contents")
def html_contents(s, d):
    return pages.read(views.table(s, d, "pages"), pages.contents).select("page_id", F.size("value").alias("links"))


@query("speech_parse", """SELECT sitting_id, CAST(row_number() OVER (PARTITION BY sitting_id ORDER BY speech_order) AS INT) AS speech_order, upper(substr(speaker_name, 1, 1)) || substr(speaker_name, 2) AS speaker_name,
  'for it' AS political_group, length(trim(regexp_replace(speech_content, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS n FROM turns WHERE trim(speech_content) <> ''""")
def speech_parse(s, d):
    """Conversations written as a transcript and read back."""
    line = F.concat(F.initcap("speaker_name"), F.lit(", for it. – "), F.regexp_replace("speech_content", r"\s+", " "))
    rows = views.turns(s, d).where(F.trim("speech_content") != "").withColumn("speech_content", line)
    return transcripts.parse_speeches(conversation.combined(rows, "\n")).select("sitting_id", "speech_order", "speaker_name", "political_group", F.length("speech_content").alias("n"))


@query("lang_vote")
def lang_vote(s, d):
    docs = views.table(s, d, "documents").select("doc_id", "text")
    return language.decide(docs, "text").select("doc_id", F.col("detected.language").alias("language"), F.col("detected.how").alias("how"))


@query("lang_profiles")
def lang_profiles(s, d):
    """The language of every whole text by rank-order profiles, learnt from all documents whose ids the hash doesn't hold out."""
    docs = views.table(s, d, "documents")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    bounded_batches(s)
    scorer = language.profiles(docs.where(~held_out), "lang")
    said = F.pandas_udf(lambda texts: scorer(texts), "language string, confidence double")  # noqa: PLW0108
    return docs.select("doc_id", held_out.alias("held_out"), said(F.coalesce("text", F.lit(""))).alias("said")).select("doc_id", "held_out", "said.language", F.round("said.confidence", 6).alias("confidence"))


@query("topic_classify", """SELECT title, CASE WHEN p THEN 'Procedural & Parliamentary business' ELSE 'Other' END AS macro_topic, title AS specific_focus, CASE WHEN p THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence
  FROM (SELECT DISTINCT p_type AS title, regexp_matches(lower(p_type), 'agenda|order of business|minutes|voting|vote|opening|closing|one-minute') AS p FROM part)""")
def topic_classify(s, d):
    return refresh.classify_topics(views.table(s, d, "part").select(F.col("p_type").alias("title")))


@query("needs_content", "SELECT doc_id AS id FROM documents WHERE length(coalesce(text, '')) < 300 AND doc_id % 400 < 300")
def needs_content(s, d):
    rows = views.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lpad((F.col("doc_id") % 400).cast("string"), 3, "0").alias("activity_date"))
    return R.needs_content(rows, "299", 300).select("id")


@query("listing_envelope", "SELECT count(*) AS total, 50 AS limit, 100 AS offset, count(*) > 150 AS has_more FROM sittings WHERE activity_date >= '1999-06-01'".replace("AS limit", 'AS "limit"').replace("AS offset", 'AS "offset"'))
def listing_envelope(s, d):
    return R.envelope(views.sittings(s, d, "1999-06-01"), 50, 100)


@query("date_fallback", "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN activity_date END, CASE WHEN id % 3 = 1 THEN activity_date END, activity_date) AS day FROM sittings")
def date_fallback(s, d):
    day = F.col("activity_date")
    return views.sittings(s, d).select("id", C.sitting_date(F.when(F.col("id") % 3 == 0, day), F.when(F.col("id") % 3 == 1, day), F.concat(F.lit("sitting-"), day)).alias("day"))


@query("document_urls", """SELECT activity_date, 'https://www.europarl.europa.eu/doceo/document/CRE-' || CASE WHEN activity_date >= '1999-07-20' THEN 5 WHEN activity_date >= '1994-07-19' THEN 4 ELSE 3 END
  || '-' || activity_date || '_EN.html' AS url FROM (SELECT DISTINCT activity_date FROM sittings)""")
def document_urls(s, d):
    return views.sittings(s, d).select("activity_date").distinct().select("activity_date", C.document_url("activity_date").alias("url"))


@query("longer_content", "SELECT page_id, CASE WHEN length(html) > length(url || repeat('x', 3000)) THEN sha256(html) ELSE sha256(url || repeat('x', 3000)) END AS digest FROM pages")
def longer_content(s, d):
    padded = F.concat("url", F.repeat(F.lit("x"), 3000))
    return views.table(s, d, "pages").select("page_id", F.sha2(C.longer(padded, F.col("html")), 256).alias("digest"))


@query("uri_names", "SELECT page_id, list_last(string_split(url, '/')) AS short FROM pages")
def uri_names(s, d):
    return views.table(s, d, "pages").select("page_id", C.short_uri("url").alias("short"))


@query("markup_flags", """SELECT page_id, contains(html, '<p ') OR contains(html, '<div ') AS markup, length(html) >= 500 AND regexp_matches(html, '(?i)<html|arrow_title_doc\\.gif|<table|<td') AS page FROM pages""")
def markup_flags(s, d):
    return views.table(s, d, "pages").select("page_id", C.has_markup("html").alias("markup"), C.looks_like_page("html").alias("page"))


@query("text_preview", "SELECT sitting_id, substr(string_agg(speech_content, ' ' ORDER BY speech_order) FILTER (WHERE speech_order < 3), 1, 300) AS preview FROM turns GROUP BY 1")
def text_preview(s, d):
    rows = views.turns(s, d).groupBy("sitting_id").agg(F.sort_array(F.collect_list(F.struct("speech_order", "speech_content"))).alias("t"))
    return rows.select("sitting_id", C.preview(F.transform("t", lambda t: t["speech_content"])).alias("preview"))


@query("reply_parsing", "SELECT id, CASE WHEN id % 2 = 0 THEN macro_topic ELSE 'x' END AS topic FROM ev")
def reply_parsing(s, d):
    """Replies with and without text around their JSON."""
    body = F.concat(F.lit('[{"macro_topic": "'), F.when(F.col("id") % 2 == 0, F.col("macro_topic")).otherwise("x"), F.lit('"}]'))
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    return views.event_speeches(s, d).select("id", C.json_block(reply, "array<struct<macro_topic:string>>")[0]["macro_topic"].alias("topic"))


@query("merged_terms", "SELECT mep_id AS identifier, max(id % 5 + 6) AS term, max(id % 5 + 6) = 10 AS is_current FROM ev GROUP BY 1")
def merged_terms(s, d):
    rows = views.event_speeches(s, d).select(F.col("mep_id").alias("identifier"), (F.col("id") % 5 + 6).alias("term"), "macro_topic")
    return persons.merged_terms(rows).select("identifier", "term", "is_current")


@query("taxonomy_additions", """SELECT name FROM (SELECT 'click' AS name UNION ALL SELECT 'Other' UNION ALL SELECT DISTINCT macro_topic FROM ev WHERE macro_topic <> 'click')""")
def taxonomy_additions(s, d):
    known = s.createDataFrame([("click", 0), ("Other", 1)], "name string, ordinal int")
    names = views.event_speeches(s, d).select(F.upper("macro_topic").alias("name"), F.col("id").alias("ordinal"))
    return R.add_if_new(known, names).select(F.when(F.col("name") == "Other", "Other").otherwise(F.lower("name")).alias("name"))


@query("available_topics", "SELECT DISTINCT macro_topic FROM ev WHERE macro_topic IN ('click', 'view', 'absent')")
def available_topics(s, d):
    wanted = s.createDataFrame([("click",), ("view",), ("absent",)], "macro_topic string")
    return wanted.join(views.event_speeches(s, d).select("macro_topic"), "macro_topic", "left_semi")


@query("creation_keys", "SELECT lower(label) AS key, max(id) AS person_id FROM persons GROUP BY 1 UNION ALL SELECT lower(country) || ' ' || lower(political_group) AS key, max(id) FROM persons GROUP BY 1 UNION ALL SELECT lower(political_group) || ' ' || lower(country) AS key, max(id) FROM persons GROUP BY 1")
def creation_keys(s, d):
    return persons.creation_keys(views.persons(s, d).withColumns({"givenName": F.col("country"), "familyName": F.col("political_group")}))


@query("snippet_offsets", "SELECT doc_id, strpos(text, ' the ') - 1 AS at FROM documents")
def snippet_offsets(s, d):
    return views.table(s, d, "documents").select("doc_id", transcripts.snippet_offset("text", F.lit(" the ")).alias("at"))


@query("phases", """SELECT activity_date, CASE WHEN shifted < '2016-06-23' THEN 'Pre-Referendum' WHEN shifted <= '2017-03-29' THEN 'Post-Referendum' WHEN shifted <= '2020-01-31' THEN 'Article-50' ELSE 'Post-Exit' END AS phase
  FROM (SELECT DISTINCT activity_date, (CAST(substr(activity_date, 1, 4) AS INT) + 19) || substr(activity_date, 5) AS shifted FROM sittings)""")
def phases(s, d):
    day = F.col("activity_date")
    shifted = F.concat((F.substring(day, 1, 4).cast("int") + 19).cast("string"), F.substring(day, 5, 10))
    return views.sittings(s, d).select("activity_date").distinct().select("activity_date", C.brexit_phase(shifted).alias("phase"))


@query("display_labels", """SELECT std, kind, raw, CASE WHEN kind = 'institution' THEN 'EU Institution' WHEN kind = 'role' THEN 'Parliamentary Role' WHEN std = 'NI' THEN 'Non-Attached' ELSE coalesce(std, 'Unknown') END AS label, n
  FROM (SELECT CASE mep_id % 3 WHEN 0 THEN 'NI' WHEN 1 THEN 'PPE' END AS std, CASE mep_id % 4 WHEN 0 THEN 'institution' WHEN 1 THEN 'role' ELSE 'group' END AS kind, macro_topic AS raw, count(*) AS n FROM ev GROUP BY ALL)""")
def display_labels(s, d):
    k = F.col("mep_id")
    std, kind = F.when(k % 3 == 0, "NI").when(k % 3 == 1, "PPE"), F.when(k % 4 == 0, "institution").when(k % 4 == 1, "role").otherwise("group")
    rows = A.counted(views.event_speeches(s, d), std.alias("std"), kind.alias("kind"), F.col("macro_topic").alias("raw"))
    return rows.withColumn("label", groups.display_label(F.col("std"), F.col("kind"), F.col("raw")))


@query("reparsed_groups", """SELECT sitting_id, speech_order, 'fresh' AS speaker_name FROM turns WHERE speech_order = 1 AND sitting_id % 2 = 0""")
def reparsed_groups(s, d):
    old = views.turns(s, d).select("sitting_id", "speech_order", "speaker_name")
    new = old.where((F.col("sitting_id") % 2 == 0) | (F.col("speech_order") > 0)).withColumn("speaker_name", F.when(F.col("speech_order") == 1, "fresh").otherwise(F.col("speaker_name")))
    return R.reparsed(new, old, "speaker_name")


@query("agenda_by_document", "SELECT id, CASE WHEN person_id % 2 = 0 THEN 'T' || person_id END AS title FROM sittings")
def agenda_by_document(s, d):
    rows = views.sittings(s, d).withColumns({"docIdentifier": F.col("person_id").cast("string"), "label": F.lit("no such words")})
    topics = rows.where("person_id % 2 = 0").select("activity_date", "docIdentifier", F.concat(F.lit("T"), "docIdentifier").alias("title"))
    return R.match_agenda(rows, topics)


@query("mart_overview", "SELECT count(*) AS total, count(*) AS with_macro, 100.0::DOUBLE AS pct_with_macro FROM star")
def mart_overview(s, d):
    path = counts.scratch(s, "mart")
    mart.build(views.speeches(s, d), views.sittings(s, d), path)
    return mart.load(s, path)["overview"]


@query("group_report", """SELECT 'unknown' AS kind, 'NI' AS std, 'no_match' AS reason, count(*) AS texts, CAST(sum(n) AS BIGINT) AS n, 'Unknown' AS hint FROM (SELECT speaker_name, count(*) AS n FROM turns GROUP BY 1)""")
def group_report(s, d):
    rows = views.turns(s, d).groupBy(F.col("speaker_name").alias("raw")).agg(F.count("*").alias("n"))
    return groups.mapping_report(groups.group_decisions(rows)).withColumn("hint", groups.suggestion(F.col("reason")))


@query("section_match", """said AS (SELECT sitting_id, speech_order, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(speech_content, chr(160), ' '))), '[^a-z0-9 \\t\\n\\r\\f\\v]', ' ', 'g'),
    '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS norm FROM turns),
  parts AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS words, list_filter([substr(norm, 1, 160), substr(norm, 41, 160), substr(norm, 81, 160), substr(norm, 121, 160)], lambda x: length(x) >= 80) AS snippets FROM said),
  pairs AS (SELECT t.sitting_id, t.speech_order, length(t.norm) AS size, s.speech_order AS part,
    CASE WHEN length(s.norm) >= 100 AND len(list_filter(t.snippets, lambda x: contains(s.norm, x))) > 0 THEN 2.0::DOUBLE
      ELSE len(list_filter(t.words, lambda x: length(x) > 3 AND contains(s.norm, x))) / greatest(len(t.words), 1)::DOUBLE END AS score
    FROM parts t JOIN parts s USING (sitting_id)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sitting_id, speech_order ORDER BY score DESC, part) AS k FROM pairs WHERE score >= 0.08 AND size >= 50) WHERE k = 1)
  SELECT t.sitting_id, t.speech_order, 'Part ' || part AS title, CASE WHEN score > 1 THEN 1.0::DOUBLE ELSE score END AS score FROM turns t LEFT JOIN best USING (sitting_id, speech_order)""")
def section_match(s, d):
    """Each turn against the texts of its conversation as sections."""
    said = views.turns(s, d).select("sitting_id", "speech_order", "speech_content")
    listed = said.select("sitting_id", F.col("speech_order").cast("int").alias("ordinal"), F.concat(F.lit("Part "), "speech_order").alias("title"), F.lit(None).cast("string").alias("docIdentifier"), F.col("speech_content").alias("text"))
    return transcripts.match_sections(said, listed).select("sitting_id", "speech_order", F.col("section.title").alias("title"), F.col("section.score").alias("score"))


@query("html_paragraphs")
def html_paragraphs(s, d):
    rows = pages.read(views.table(s, d, "pages"), pages.paragraphs)
    return pages.read_anchor(rows.withColumn("anchor", F.lit("main")), "anchor", name="near").select("page_id", F.size("value").alias("n"), F.length("near").alias("near"))


SHORT = "trim(replace(replace(replace({c}, '&amp;', '&'), '–', '-'), '—', '-'))"


@query("topic_short", f"{VARIED} SELECT DISTINCT macro_topic, {SHORT.format(c='macro_topic')} AS short FROM varied")
def topic_short(s, d):
    return _varied(s, d).distinct().select("macro_topic", C.topic_label_short("macro_topic").alias("short"))


@query("iso_codes", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(lang) WHEN 1 THEN upper(lang) WHEN 2 THEN upper(lang) WHEN 3 THEN CASE lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' END END AS code FROM documents""")
def iso_codes(s, d):
    """Codes of two letters, in capitals, with a region, of three letters, of an unknown language and none."""
    k = F.col("doc_id") % 6
    three = F.create_map(*(F.lit(x) for pair in (("en", "eng"), ("de", "deu"), ("fr", "fra"), ("es", "spa")) for x in pair))
    lang = F.col("lang")
    code = F.when(k == 0, lang).when(k == 1, F.upper(lang)).when(k == 2, F.concat(lang, F.lit("-XX"))).when(k == 3, F.try_element_at(three, lang)).when(k == 4, F.lit("zz"))
    return views.table(s, d, "documents").select("doc_id", language.iso2(code).alias("code"))


@query("agenda_first", """SELECT sitting_id, ordinal, title FROM (SELECT *, row_number() OVER (PARTITION BY sitting_id, doc, lower(trim(title)) ORDER BY ordinal) AS k FROM
  (SELECT sitting_id, speech_order AS ordinal, CASE WHEN speech_order % 2 = 0 THEN upper(macro_topic) || ' ' ELSE macro_topic END AS title, macro_specific_focus AS doc FROM star)) WHERE k = 1""")
def agenda_first(s, d):
    title = F.when(F.col("speech_order") % 2 == 0, F.concat(F.upper("macro_topic"), F.lit(" "))).otherwise(F.col("macro_topic"))
    rows = views.speeches(s, d).select("sitting_id", F.col("speech_order").alias("ordinal"), title.alias("title"), F.col("macro_specific_focus").alias("docIdentifier"))
    return R.first_agenda(rows).select("sitting_id", "ordinal", "title")


@query("affiliation_labels", """SELECT label, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'PPE' WHEN 1 THEN 'Non-Attached' WHEN 2 THEN 'Renew' WHEN 3 THEN 'Committee Rapporteur'
  WHEN 4 THEN 'European Commission' WHEN 5 THEN '' ELSE 'Parliamentary Role' END AS label FROM (SELECT id % 7 AS k FROM ev)) GROUP BY 1""")
def affiliation_labels(s, d):
    """Speeches with a standard group, with a raw one, and with a title only."""
    k = F.col("id") % 7
    cases = {0: ("PPE", "group", None, None), 1: ("NI", "group", None, None), 2: (None, None, "ALDE", None), 3: ("", None, "", "Rapporteur for it"), 4: (None, None, None, "Member of the Commission"), 5: (None, None, None, "in writing"), 6: (None, None, None, "Guest")}
    pick = lambda i: F.coalesce(*(F.when(k == n, F.lit(c[i])) for n, c in cases.items()), F.lit(None).cast("string"))
    label = groups.affiliation(pick(0), pick(1), F.lit(None).cast("string"), pick(2), pick(3))
    return A.counted(views.event_speeches(s, d), label.alias("label"))


@query("person_dataset", """named AS (SELECT id, mep_id, 'Nm' || (mep_id % 50) || ' Fam' || (mep_id % 50) AS speaker_name, macro_topic FROM ev),
  who AS (SELECT speaker_name, mep_id % 50 AS k, count(*) AS n FROM named GROUP BY 1, 2),
  made AS (SELECT k, 29 + row_number() OVER (ORDER BY n DESC, lower(speaker_name)) AS id FROM who WHERE k >= 30)
  SELECT w.speaker_name, CASE WHEN w.k < 30 THEN w.k ELSE m.id END AS person_id, CASE WHEN w.k < 30 THEN 'api' ELSE 'historic' END AS source, w.n FROM who w LEFT JOIN made m ON m.k = w.k""")
def person_dataset(s, d):
    """Thirty persons of two terms, with their names turned round, and twenty who have no record."""
    k = F.col("mep_id") % 50
    said = views.event_speeches(s, d).select("id", "mep_id", F.concat(F.lit("Nm"), k, F.lit(" Fam"), k).alias("speaker_name"), F.lit("PPE").alias("political_group"), F.lit(None).cast("string").alias("title"))
    api = s.range(60).select((F.col("id") % 30).cast("string").alias("identifier"), (9 + F.floor(F.col("id") / 30)).alias("term"), F.concat(F.lit("FAM"), F.col("id") % 30, F.lit(" Nm"), F.col("id") % 30).alias("label"))
    everyone, linked, _ = rebuild.person_dataset(said, api)
    n = A.counted(linked, F.col("mep_id").alias("id"), "speaker_name")
    return n.join(everyone.select("id", "source"), "id").select("speaker_name", F.col("id").alias("person_id"), "source", "n")


@query("sittings_unparsed", "SELECT id FROM sittings WHERE id % 3 > 0 AND activity_date >= '1997-01-01' AND (SELECT count(*) FROM star WHERE sitting_id = sittings.id AND speech_order > 3) = 0")
def sittings_unparsed(s, d):
    rows = views.sittings(s, d, "1996-01-01").withColumn("content", F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 200)))
    return rebuild.unparsed(rows, views.speeches(s, d).where("speech_order > 3"), "1997-01-01").select("id")


@query("local_or_remote", "SELECT id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN label ELSE 'remote' END AS label FROM sittings WHERE id % 5 = 0 AND id % 4 <> 1")
def local_or_remote(s, d):
    """Sittings of even ids are stored; of the others, some have a remote record."""
    rows = views.sittings(s, d).select(F.col("id").cast("string").alias("id"), "label", "activity_date")
    remote = rows.where("id % 4 <> 1").select("id", F.create_map(F.lit("EN"), F.lit("remote")).alias("labels"))
    return rebuild.with_local_or_remote(rows.where("id % 5 = 0").select("id"), rows.where("id % 2 = 0"), remote).select("id", "label")


@query("point_lookup", "SELECT * FROM sittings WHERE id = 37")
def point_lookup(s, d):
    return R.by_key(views.sittings(s, d), "id", 37)


@query("toggled_sort", "SELECT topic, row_number() OVER (ORDER BY lower(topic) DESC, topic) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS topic FROM part) QUALIFY place <= 20")
def toggled_sort(s, d):
    topic = F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    names = R.toggled(views.table(s, d, "part").select(topic.alias("topic")).distinct(), "topic", descending=True).limit(20)
    return names.select("topic", F.row_number().over(Window.orderBy(F.collate("topic", "UNICODE_CI").desc(), "topic")).alias("place"))


@query("extract_rows", FULL + """ SELECT f.sitting_id, f.speech_order, activity_date, substr(activity_date, 1, 4) AS year, substr(activity_date, 1, 7) AS month, length(speech_content) AS length
  FROM full_star f JOIN sittings ON sittings.id = f.sitting_id WHERE language = 'A' AND coalesce(political_group_std, political_group) IN ('F', 'R') AND activity_date BETWEEN '1996-01-01' AND '1997-06-30'
  AND length(speech_content) BETWEEN 55 AND 75""")
def extract_rows(s, d):
    rows = R.extract(_full_speeches(s, d), views.sittings(s, d, "1996-01-01", "1997-06-30"), "A", ["F", "R"], "1996-01-01", "1997-06-30", shortest=55, longest=75)
    return rows.select("sitting_id", "speech_order", "activity_date", "year", "month", "length")


@query("delete_cascade", "SELECT sitting_id, count(*) AS n FROM star WHERE sitting_id NOT IN (SELECT id FROM sittings WHERE activity_date < '1997-01-01') GROUP BY 1")
def delete_cascade(s, d):
    gone = views.sittings(s, d, end="1996-12-31").select("id")
    return A.counted(sinks.deleted(views.speeches(s, d), gone), "sitting_id")


@query("copy_if_null", "SELECT sitting_id, speech_order, coalesce(political_group_std, political_group) AS political_group_std FROM star")
def copy_if_null(s, d):
    return sinks.filled_from(views.speeches(s, d), "political_group_std", "political_group").select("sitting_id", "speech_order", "political_group_std")


@query("mirror_rows", "SELECT id::VARCHAR AS id, type, label, activity_date AS date, activity_date FROM sittings")
def mirror_rows(s, d):
    """The sittings as records of the table they came from."""
    return sinks.mirrored(views.sittings(s, d), SITTINGS, date=F.col("activity_date")).select("id", "type", "label", "date", "activity_date")
