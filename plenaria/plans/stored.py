"""Registered queries over stored tables: changes by bucket, concurrent writers, the mart brought up to date, distinct counts of any range."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.operators import persons
from plenaria.operators.containment import contained
from plenaria.plans import mart
from plenaria.plans.queries import query
from plenaria.sources import sinks, views
from plenaria.streaming import corrections, counts


def _sittings(s, d) -> DataFrame:
    return views.sittings(s, d).select("id", "activity_date", "label")


@query("stored_changes", """SELECT id, activity_date, 'again' AS label FROM sittings WHERE substr(activity_date, 1, 7) = '1996-02'
  UNION ALL SELECT id, '1997-12-31', 'moved' FROM sittings WHERE activity_date = '1996-04-01'
  UNION ALL SELECT id, activity_date, label FROM sittings WHERE substr(activity_date, 1, 7) NOT IN ('1996-02', '1996-03') AND activity_date <> '1996-04-01'
  UNION ALL SELECT id + 10000000, activity_date, 'more' FROM sittings WHERE substr(activity_date, 1, 7) = '1996-05'""")
def stored_changes(s, d):
    """A stored table by months: one month's rows anew, one month deleted, some moved to another month, some added if they aren't there, some behind."""
    rows, path = _sittings(s, d), counts.scratch(s, "changes")
    month = lambda m: rows.where(F.substring("activity_date", 1, 7) == m)
    sinks.write(rows, f"{path}/sittings", by="substr(activity_date, 1, 7)")
    sinks.upsert(month("1996-02").withColumn("label", F.lit("again")), f"{path}/sittings")
    sinks.delete_sittings(month("1996-03"), path)
    sinks.upsert(rows.where("activity_date = '1996-04-01'").withColumns({"activity_date": F.lit("1997-12-31"), "label": F.lit("moved")}), f"{path}/sittings")
    more = month("1996-05").withColumns({"id": F.col("id") + 10_000_000, "label": F.lit("more")})
    sinks.append(more.where("id % 2 = 0"), f"{path}/sittings")
    sinks.insert_absent(more.union(month("1996-02")), f"{path}/sittings")
    return sinks.read(s, f"{path}/sittings")


@query("stored_concurrent_writers", """SELECT id, activity_date, label FROM sittings WHERE id % 1000 > 7
  UNION ALL SELECT id, activity_date, 'writer ' || (id % 1000) FROM sittings WHERE id % 1000 <= 7
  UNION ALL SELECT id + 10000000, activity_date, 'added' FROM sittings WHERE id % 1000 <= 7""")
def stored_concurrent_writers(s, d):
    """Eight writers at once, each of which replaces some rows of a stored table and adds others."""
    rows, path = _sittings(s, d), f"{counts.scratch(s, 'writers')}/sittings"
    sinks.write(rows, path, by="substr(activity_date, 1, 4)")

    def work(i: int) -> None:
        mine = rows.where(F.col("id") % 1000 == i)
        sinks.append(mine.withColumns({"id": F.col("id") + 10_000_000, "label": F.lit("added")}), path)
        sinks.replace_sittings(mine.withColumn("label", F.lit(f"writer {i}")), path, key="id")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, range(8)))
    return sinks.read(s, path)


def _named(s, d) -> tuple[DataFrame, DataFrame]:
    """(speeches, sittings) whose sittings have keys that name their day, as records have them."""
    days = views.sittings(s, d)
    key = F.concat(F.lit("sitting-"), F.col("activity_date"), F.lit("-"), F.col("id").cast("string"))
    said = views.speeches(s, d).join(days.select(F.col("id").alias("sitting_id"), key.alias("key")), "sitting_id").withColumn("sitting_id", F.col("key")).drop("key")
    return said, days.select(key.alias("id"), "activity_date")


def changed_mart(s, d) -> str:
    """The mart of stored tables, brought up to date after changes: a month's topics anew, a month deleted, a week moved."""
    path = counts.scratch(s, "mart")
    said, days = _named(s, d)
    sinks.write(said, f"{path}/speeches", key="sitting_id")
    sinks.write(days, f"{path}/sittings", key="id")
    go = lambda: mart.refresh(s, f"{path}/speeches", f"{path}/sittings", f"{path}/mart")
    go()
    # What changes lies in a month's bucket of what is stored: the facts aren't made again for it.
    of = lambda table, m, key: sinks.rows(s, f"{path}/{table}", sinks.state(s, f"{path}/{table}"), {m}).where(F.substring(key, 9, 7) == m)
    sinks.replace_sittings(of("speeches", "1996-02", "sitting_id").withColumns({"macro_topic": F.lit("CHANGED"), "mep_id": F.lit(3).cast(dict(said.dtypes)["mep_id"])}), f"{path}/speeches")
    sinks.delete_sittings(of("sittings", "1997-05", "id"), path)
    sinks.upsert(of("sittings", "1998-01", "id").withColumn("activity_date", F.lit("1999-01-01")), f"{path}/sittings")
    go()
    return f"{path}/mart"


CHANGED = """changed AS (SELECT CASE WHEN substr(activity_date, 1, 7) = '1996-02' THEN 'CHANGED' ELSE macro_topic END AS topic,
  CASE WHEN substr(activity_date, 1, 7) = '1996-02' THEN 3 ELSE mep_id END AS mep_id, coalesce(political_group_std, political_group) AS grp,
  CASE WHEN substr(activity_date, 1, 7) = '1998-01' THEN '1999-01-01' ELSE activity_date END AS day FROM dated WHERE substr(activity_date, 1, 7) <> '1997-05')"""


@query("mart_incremental", f"""{CHANGED}, n_changed AS (SELECT substr(day, 1, 7) AS period, topic, count(*) AS n FROM changed GROUP BY 1, 2)
  SELECT p.period, t.topic, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM n_changed) p CROSS JOIN (SELECT DISTINCT topic FROM n_changed) t
  LEFT JOIN n_changed c ON c.period = p.period AND c.topic = t.topic""")
def mart_incremental(s, d):
    return mart.series(mart.load(s, changed_mart(s, d)), "month")


@query("mart_distinct_speakers", f"""{CHANGED} SELECT substr(day, 1, 4) AS period, grp, count(*) AS n, count(DISTINCT mep_id) AS speakers, count(DISTINCT day) AS days
  FROM changed WHERE day BETWEEN '1996-02-10' AND '1998-06-15' GROUP BY 1, 2""")
def mart_distinct_speakers(s, d):
    return mart.distinct_counts(s, changed_mart(s, d), "1996-02-10", "1998-06-15", period_of="year")


PIECES = "pieces AS (SELECT DISTINCT substr(s_name, 3 + CAST(s_suppkey % 5 AS INT), 4 + CAST(s_suppkey % 9 AS INT)) AS form FROM supplier)"


@query("name_containment", f"{PIECES} SELECT form, count(*) AS n, min(c_custkey) AS first_id FROM pieces JOIN customer ON contains(c_name, form) GROUP BY form")
def name_containment(s, d):
    """Names inside other names, wherever they begin and end."""
    cut = F.expr("substr(s_name, int(3 + s_suppkey % 5), int(4 + s_suppkey % 9))")
    labels = views.table(s, d, "customer").select(F.col("c_name").alias("text"), "c_custkey")
    found = contained(views.table(s, d, "supplier").select(cut.alias("form")), labels)
    return found.join(labels, "text").groupBy("form").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


NAMES = r"""spoken AS (SELECT array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1 : 1 + CAST(doc_id % 3 AS INT)], ' ') AS name FROM documents),
  counted AS (SELECT name, count(*) AS n, list_filter(string_split(trim(regexp_replace(name, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM spoken WHERE trim(name) <> '' GROUP BY name),
  classed AS (SELECT name, n, CASE WHEN len(words) > 1 THEN least(lower(words[1]), lower(words[-1])) || ' ' || greatest(lower(words[1]), lower(words[-1])) ELSE lower(trim(name)) END AS pair FROM counted),
  firsts AS (SELECT pair, name, n, row_number() OVER (ORDER BY n DESC, name) + (SELECT max(c_custkey) FROM customer) AS id FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, name) AS k FROM classed) WHERE k = 1)"""


@query("persons_in_sequence", f"{NAMES} SELECT c.name AS speaker_name, f.id AS person_id, trim(f.name) AS label FROM classed c JOIN firsts f USING (pair)")
def persons_in_sequence(s, d):
    """New persons for the names with which texts open: who comes later with the same first and last word is the person made before."""
    name = F.expr("array_join(slice(split(replace(text, chr(10), ' '), ' '), 1, int(1 + doc_id % 3)), ' ')")
    said = views.table(s, d, "documents").select(name.alias("speaker_name"), F.lit(None).cast("long").alias("mep_id"))
    known = views.persons(s, d).withColumns({"givenName": F.lit(None).cast("string"), "familyName": F.lit(None).cast("string")})
    links, made = persons.in_sequence(said, known)
    return links.join(made.select(F.col("id").alias("person_id"), "label"), "person_id").select("speaker_name", "person_id", "label")


@query("stream_corrections", """newest_versions AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) AS k FROM events)
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS topic, count(*) AS n FROM newest_versions WHERE k = 1 AND event_type <> 'error' GROUP BY 1, 2""")
def stream_corrections(s, d):
    """Events as versions of speeches, in files that come in no order: each replaces the older ones of its user and number, errors take a speech away."""
    path = counts.scratch(s, "corrections")
    versions = views.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("sitting_id"), (F.col("event_id") % 5).alias("speech_order"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("topic"), F.col("ts").cast("timestamp").alias("changed_at"), F.col("event_id").alias("version"),
    )
    versions.repartition(3, F.xxhash64("version")).write.parquet(f"{path}/in")
    stream = s.readStream.schema(corrections.VERSIONS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return corrections.run_corrections(s, stream, path)
