"""Descriptive statistics over speeches: counts, shares, time series, crosstabs and speaker tables.

Facts have sitting_id, macro_topic, macro_specific_focus, political_group(_std),
language and mep_id; sittings have id and activity_date. Counts are aggregated on
both sides of the shuffle; the axes (topics, periods) are small aggregates
themselves. Ties in a top-k go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.functions.columns import effective_group, effective_language, filled, percent, period, rounded

INTERVALS = ("month", "quarter", "year")


def dated(facts: DataFrame, sittings: DataFrame) -> DataFrame:
    """Facts with the date of their sitting; only the two columns that matter of the sittings are read."""
    days = sittings.select(F.col("id").alias("sitting_id"), "activity_date").where(F.col("activity_date").isNotNull())
    return facts.join(days, "sitting_id")


def counted(facts: DataFrame, *keys) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count("*").alias("n"))


def top(df: DataFrame, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("n"), *ties).limit(k)


def coverage(facts: DataFrame) -> DataFrame:
    out = facts.agg(F.count("*").alias("total"), F.count_if(filled("macro_topic")).alias("with_macro"))
    return out.withColumn("pct_with_macro", percent(F.col("with_macro"), F.col("total")))


def top_topics(facts: DataFrame, k: int = 20) -> DataFrame:
    return top(counted(facts.where(filled("macro_topic")), F.col("macro_topic").alias("topic")), k, "topic")


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    """With topic_rank from 1; for the few rows of a top-k."""
    return df.withColumn("topic_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), *ties)))


def top_focuses(facts: DataFrame, k: int = 20) -> DataFrame:
    rows = facts.where(filled("macro_topic") & filled("macro_specific_focus"))
    return top(counted(rows, F.col("macro_topic").alias("topic"), F.col("macro_specific_focus").alias("focus")), k, "topic", "focus")


def time_series(rows: DataFrame, interval: str = "month", start: str | None = None, end: str | None = None, topics: Sequence[str] | None = None) -> DataFrame:
    """(period, topic, n) of dated facts, optionally within periods and of some topics."""
    rows = rows.where(filled("macro_topic"))
    if topics is not None:
        rows = rows.where(F.col("macro_topic").isin(list(topics)))
    out = counted(rows, period("activity_date", interval).alias("period"), F.col("macro_topic").alias("topic"))
    if start is not None:
        out = out.where(F.col("period") >= start)
    return out if end is None else out.where(F.col("period") <= end)


def grid(series: DataFrame) -> DataFrame:
    """The series with zeros for periods in which a topic has none. The periods are one row's array, as many as the calendar has."""
    periods = series.agg(F.collect_set("period").alias("periods"))
    axes = series.select("topic").distinct().join(F.broadcast(periods)).select("topic", F.explode("periods").alias("period"))
    return axes.join(series, ["period", "topic"], "left").select("period", "topic", F.coalesce("n", F.lit(0)).alias("n"))


def moving_average(series: DataFrame, width: int = 6) -> DataFrame:
    """With `average` over `width` periods of a topic, null until there are as many; two decimals."""
    last = Window.partitionBy("topic").orderBy("period").rowsBetween(1 - width, 0)
    mean = rounded(F.sum("n").over(last) / width, 2)
    return series.withColumn("average", F.when(F.count("*").over(last) == width, mean))


def trends(rows: DataFrame, k: int = 5, months: int = 12) -> DataFrame:
    """Monthly counts of the k most frequent topics over the last months that have any of them."""
    series = time_series(rows, "month")
    leading = series.groupBy("topic").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "topic").limit(k).select("topic")
    series = series.join(leading, "topic", "left_semi")
    late = series.select("period").distinct().orderBy(F.desc("period")).limit(months)
    return series.join(late, "period", "left_semi").select("period", "topic", "n")


def cross(facts: DataFrame, by, name: str, k: int) -> DataFrame:
    """(topic, name, n) for the k most frequent values of `by`."""
    cells = counted(facts.where(filled("macro_topic")), F.col("macro_topic").alias("topic"), by.alias(name))
    totals = counted(facts.withColumn(name, by).where(F.col(name).isNotNull()), name)
    return cells.join(top(totals, k, name).select(name), name, "left_semi").select("topic", name, "n")


def by_group(facts: DataFrame, k: int = 10) -> DataFrame:
    return cross(facts, effective_group(), "grp", k)


def by_language(facts: DataFrame, k: int = 24) -> DataFrame:
    return cross(facts, effective_language(), "language", k)


def top_groups(facts: DataFrame, k: int = 10) -> DataFrame:
    return top(counted(facts.withColumn("grp", effective_group()).where("grp is not null"), "grp"), k, "grp")


def pivoted(cells: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    out = cells.groupBy("topic").pivot(column, list(values)).agg(F.sum("n"))
    return out.select("topic", *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values))


def languages(facts: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    rows = facts if topics is None else facts.where(F.col("macro_topic").isin(list(topics)))
    return counted(rows, effective_language().alias("language"))


def top_speakers(facts: DataFrame, persons: DataFrame, topic: str | None = None, k: int = 10) -> DataFrame:
    """Most frequent speakers of a topic; facts are counted before they meet the persons, and unlinked ones are a group too."""
    k = min(100, max(1, k))
    rows = facts if topic is None else facts.where(F.col("macro_topic") == topic)
    n = counted(rows, "mep_id", effective_group().alias("grp"))
    named = persons.select(F.col("id").alias("mep_id"), "label", "country")
    return top(n.join(named, "mep_id", "left").select("mep_id", "label", "country", "grp", "n"), k, "mep_id", "grp")


def persons_with_counts(persons: DataFrame, facts: DataFrame) -> DataFrame:
    n = counted(facts.where(F.col("mep_id").isNotNull()), F.col("mep_id").alias("id"))
    return persons.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def filter_persons(persons: DataFrame, current: bool | None = None, country: str | None = None, group: str | None = None, at_least: int = 0) -> DataFrame:
    """Conjunction of the filters that are given, on the result of persons_with_counts()."""
    out = persons.where(F.col("n") >= at_least)
    for name, value in (("is_current", current), ("country", country), ("political_group", group)):
        out = out if value is None else out.where(F.col(name) == value)
    return out


def speaker_stats(rows: DataFrame, at_least: int = 5) -> DataFrame:
    """Per speaker of dated facts with `size`: speeches, mean size, first and last day, distinct days and years."""
    return (
        rows.groupBy("mep_id")
        .agg(
            F.count("*").alias("n"), rounded(F.avg("size"), 0).cast("long").alias("mean_size"), F.min("activity_date").alias("first_day"),
            F.max("activity_date").alias("last_day"), F.countDistinct("activity_date").alias("days"),
            F.countDistinct(period("activity_date", "year")).alias("years"),
        )
        .where(F.col("n") >= at_least)
    )


def group_year_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(effective_group().alias("grp"), period("activity_date", "year").alias("year")).agg(
        F.count("*").alias("n"), F.countDistinct("mep_id").alias("speakers"), F.countDistinct("activity_date").alias("days")
    )


def quality_counters(facts: DataFrame) -> DataFrame:
    """Per person: facts with an empty raw group, an empty and a set standard group; persons without any standard group only."""
    out = facts.groupBy("mep_id").agg(
        F.count("*").alias("n"),
        F.count_if(unset_group("political_group")).alias("raw_empty"),
        F.count_if(unset_group("political_group_std")).alias("std_empty"),
        F.count_if(~unset_group("political_group_std")).alias("std_set"),
    )
    return out.where("std_set = 0")


def unset_group(name: str):
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def topic_counts(facts: DataFrame) -> DataFrame:
    """Distinct trimmed topics with how often they stand."""
    return counted(facts.where(filled("macro_topic")), F.trim("macro_topic").alias("topic"))


def presence(facts: DataFrame) -> DataFrame:
    """Per sitting: facts, and facts with a language."""
    return facts.groupBy("sitting_id").agg(F.count("*").alias("n"), F.count("language").alias("with_language"))


def largest_per_date(sittings: DataFrame, facts: DataFrame) -> DataFrame:
    """Per day: its sittings, the largest number of speeches of one, and the smallest id."""
    n = counted(facts, F.col("sitting_id").alias("id"))
    return sittings.join(n, "id", "left").groupBy("activity_date").agg(F.count("*").alias("sittings"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.min("id").alias("first_id"))


def newest(rows: DataFrame, k: int = 15) -> DataFrame:
    """The k newest facts of each person."""
    w = Window.partitionBy("mep_id").orderBy(F.desc("activity_date"), F.desc("id"))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def sampled(rows: DataFrame, by: str, key: str, k: int = 80, at_least: int = 10, seed: int = 7, buckets: int = 256) -> DataFrame:
    """A random sample of k rows of each value of `by` that has `at_least` rows; by a hash of the key, so a run can be repeated.

    The first k of each bucket of a value are found first, so no task sorts all rows of a frequent value.
    """
    drawn = rows.withColumn("__drawn", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("__drawn", key))
    few = drawn.withColumn("__bucket", F.pmod(F.xxhash64("__drawn"), F.lit(buckets))).withColumn("__nth", place(by, "__bucket")).where(F.col("__nth") <= k)
    few = few.withColumn("__nth", place(by)).where(F.col("__nth") <= k)
    enough = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")).where(F.col("__n") >= at_least)
    return few.join(enough, F.col(by).eqNullSafe(F.col("__by"))).select(*rows.columns)


def metadata(rows: DataFrame) -> DataFrame:
    """Distinct groups and years, sorted and joined, and the first and last day."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    small = rows.groupBy(effective_group().alias("grp"), period("activity_date", "year").alias("year")).agg(F.min("activity_date").alias("low"), F.max("activity_date").alias("high"))
    return small.agg(names("grp").alias("groups"), names("year").alias("years"), F.min("low").alias("first_day"), F.max("high").alias("last_day"))
