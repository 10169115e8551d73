"""Refresh: which days to work on, the way of a transcript from page to classified speeches, and topic classification."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions import pages, transcripts
from plenaria.functions.columns import filled, looks_like_page, unset
from plenaria.functions.groups import normalise_groups
from plenaria.functions.language import fill_language
from plenaria.operators import relational as R
from plenaria.operators.persons import link_speeches
from plenaria.plans import mart
from plenaria.schema import SITTINGS, SPEECHES, conform
from plenaria.settings import settings
from plenaria.sources import sinks

#: Titles of a batch to (macro_topic, specific_focus, confidence), one row each, in their order.
Classifier = Callable[[list[str]], pd.DataFrame]
SPEECH_COLUMNS = [part.split()[0] for part in SPEECHES.split(", ")]
PROCEDURAL = "Procedural & Parliamentary business"


def days_to_process(spark: SparkSession, sittings: DataFrame, speeches: DataFrame, until: str, first: str = "1999-07-20") -> DataFrame:
    """Days after the last fully processed one that are new, and known days with sittings that need work."""
    latest = R.fully_processed_latest(sittings, speeches).select(F.coalesce(F.date_add(F.to_date("activity_date"), 1), F.to_date(F.lit(first))).alias("start"))
    span = latest.where(F.col("start") <= F.to_date(F.lit(until))).select(F.explode(F.sequence("start", F.to_date(F.lit(until)))).alias("day"))
    span = span.select(F.col("day").cast("string").alias("activity_date"))
    return R.date_union(R.new_dates(span, sittings), R.needs_processing(sittings, speeches).where(filled("activity_date")))


def by_keywords(titles: list[str]) -> pd.DataFrame:
    """The classifier where no service is set: a title's own words as focus, the procedural topic where it is about procedure."""
    low = [t.lower() for t in titles]
    procedural = [any(w in t for w in ("agenda", "order of business", "minutes", "voting", "vote", "opening", "closing", "one-minute")) for t in low]
    topics = [PROCEDURAL if p else "Other" for p in procedural]
    return pd.DataFrame({"macro_topic": topics, "specific_focus": titles, "confidence": [0.8 if p else 0.3 for p in procedural]})


def classify_topics(titles: DataFrame, classifier: Classifier = by_keywords, batch: int | None = None, fallback: str = PROCEDURAL) -> DataFrame:
    """(title, macro_topic, specific_focus, confidence) of distinct titles, in batches (of the deployment's size, if none is given); a batch that fails gets the fallback at 0.2, a missing answer at 0.3."""

    batch = batch or settings(titles.sparkSession).topic_batch

    def answer(some: list[str]) -> pd.DataFrame:
        try:
            out = classifier(some).reset_index(drop=True)[["macro_topic", "specific_focus", "confidence"]].reindex(range(len(some)))
        except Exception:
            out = pd.DataFrame({"macro_topic": [fallback] * len(some), "specific_focus": some, "confidence": 0.2})
        gaps = out["macro_topic"].isna()
        out.loc[gaps, "macro_topic"] = fallback
        out.loc[gaps, "confidence"] = 0.3
        return out.assign(title=some)[["title", "macro_topic", "specific_focus", "confidence"]]

    def run(frames):
        for frame in frames:
            names = frame["title"].tolist()
            for at in range(0, len(names), batch):
                yield answer(names[at : at + batch])

    distinct = titles.where(filled("title")).select("title").distinct()
    return distinct.mapInPandas(run, "title string, macro_topic string, specific_focus string, confidence double")


def speeches_of(transcript: DataFrame) -> DataFrame:
    """Speeches of pages (sitting_id, html) with the agenda section each belongs to as topic."""
    rows = transcript.where(looks_like_page("html"))
    texts = pages.read(rows, pages.main_text, name="content").select("sitting_id", "content")
    listed = pages.read(rows, pages.sections, name="s").select("sitting_id", F.posexplode("s").alias("ordinal", "s")).select("sitting_id", "ordinal", "s.*")
    matched = transcripts.match_sections(transcripts.parse_speeches(texts), listed)
    return matched.withColumn("topic", F.col("section.title")).drop("section")


def enriched(speeches: DataFrame, persons: DataFrame, classifier: Classifier = by_keywords) -> DataFrame:
    """Speeches (as speeches_of() gives them) with persons, groups, topics and languages."""
    rows = speeches.withColumns({"mep_id": F.lit(None).cast("long"), "language": F.lit(None).cast("string")})
    rows = normalise_groups(link_speeches(rows, persons))
    topics = classify_topics(rows.select(F.col("topic").alias("title")), classifier)
    topics = topics.select(F.col("title").alias("topic"), "macro_topic", F.col("specific_focus").alias("macro_specific_focus"), F.col("confidence").alias("macro_confidence"))
    rows = rows.join(topics, "topic", "left").withColumn("id", F.xxhash64("sitting_id", "speech_order"))
    return fill_language(rows)


def unclassified(speeches: DataFrame) -> DataFrame:
    return speeches.where(unset("macro_topic"))


def new_topics(classified: DataFrame, known: DataFrame) -> DataFrame:
    """Topics that the taxonomy (name) lacks, without regard to case."""
    names = classified.select(F.col("macro_topic").alias("name")).distinct()
    return names.join(known.select(F.lower(F.trim("name")).alias("key")).distinct(), F.lower(F.trim("name")) == F.col("key"), "left_anti")


def run(spark: SparkSession, pages_of: DataFrame, persons: DataFrame, path: str | None, until: str, classifier: Classifier = by_keywords, everything: bool = False) -> dict[str, int]:
    """Bring the tables under `path` (None: the deployment's folder) up to date from pages (sitting_id, activity_date, html); counts of what was done.

    Works on new days, and on known ones that have no speeches or some without a topic;
    `everything` does all days again. Sittings and speeches are replaced by sitting, and
    the mart reads the buckets again that have changed. Pages that aren't transcripts are
    counted as failed, logged in the table `failures` and left for the next run.
    """
    own = settings(spark)
    mart_path, path = (own.mart, own.tables) if path is None else (f"{path}/mart", path)
    sittings, speeches = f"{path}/sittings", f"{path}/speeches"
    wanted = pages_of.where(F.col("activity_date") <= until)
    if not everything and sinks.exists(spark, sittings):
        days = days_to_process(spark, sinks.read(spark, sittings), sinks.read(spark, speeches), until, "1900-01-01")
        wanted = wanted.join(days, "activity_date", "left_semi").select(pages_of.columns)
    good = wanted.where(looks_like_page("html"))
    asked, usable = wanted.count(), good.count()
    if asked > usable:
        bad = wanted.where(~F.coalesce(looks_like_page("html"), F.lit(False)))
        sinks.log_failures(bad.select(F.lit("transcript").alias("kind"), F.col("activity_date").alias("what"), F.lit("not a transcript").alias("message")), f"{path}/failures")
    if usable:
        stored = good.select(F.col("sitting_id").alias("id"), "activity_date", F.lit("PLENARY").alias("type"), F.col("html").alias("content"))
        made = conform(enriched(speeches_of(good.select("sitting_id", "html")), persons, classifier), SPEECHES).select(*SPEECH_COLUMNS)
        sinks.replace_sittings(made, speeches, by_key=True)
        sinks.upsert(conform(stored, SITTINGS), sittings, by_key=True)
        mart.refresh(spark, speeches, sittings, mart_path)
    return {"asked": asked, "processed": usable, "failed": asked - usable}
