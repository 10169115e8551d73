"""The analytics mart: all series, crosstabs and rankings as Parquet tables, built from one pass over the facts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.columns import collapse_key, effective_group, effective_language, filled, period, topic_label
from plenaria.operators import analytics as A
from plenaria.schema import MART, conform
from plenaria.sources import sinks


def topic_variants(facts: DataFrame) -> DataFrame:
    """(key, topic, variants): labels that differ in case, spacing, dashes or entities only.

    The smallest cleaned label stands for all: rows have no order of arrival here that could make it the first seen.
    """
    labels = facts.where(filled("macro_topic")).groupBy("macro_topic").agg(F.count("*").alias("n"))
    return labels.groupBy(collapse_key("macro_topic").alias("key")).agg(F.min(topic_label("macro_topic")).alias("topic"), F.array_sort(F.collect_set("macro_topic")).alias("variants"))


def canonical(facts: DataFrame, variants: DataFrame) -> DataFrame:
    """Facts with their topic's canonical label; the map is as large as the list of labels."""
    flat = variants.select(F.col("topic").alias("__topic"), F.explode("variants").alias("__variant"))
    joined = facts.join(flat, F.col("macro_topic") == F.col("__variant"), "left")
    return joined.select(*(F.coalesce("__topic", "macro_topic").alias(c) if c == "macro_topic" else c for c in facts.columns))


BUCKET = "sitting_bucket"


def _with_days(facts: DataFrame, sittings: DataFrame, by_bucket: bool) -> DataFrame:
    """What is kept of the facts with their days: one join for all of KEPT."""
    rows = facts if "mep_id" in facts.columns else facts.withColumn("mep_id", F.lit(None).cast("long"))
    days = sittings.select(F.col("id").alias("sitting_id"), "activity_date")
    bucket = sinks.bucket_column("sitting_id") if by_bucket else F.lit(sinks.ALL)
    kept = [bucket.alias(BUCKET), "activity_date", "macro_topic", "macro_specific_focus", effective_group().alias("grp"), effective_language().alias("language"), F.col("mep_id").cast("long").alias("mep_id")]
    return rows.join(days, "sitting_id", "left").select(*kept)


def cube(dated: DataFrame) -> DataFrame:
    """n by day, topic, focus, group and language: all that the mart's tables need, many times smaller than the facts.

    Rows of a bucket of sittings come from that bucket's facts alone. Topics are as the
    facts have them, as later facts may change which label stands for its variants.
    """
    return dated.groupBy(BUCKET, "activity_date", "macro_topic", "macro_specific_focus", "grp", "language").agg(F.count("*").alias("n"))


def speaker_days(dated: DataFrame) -> DataFrame:
    """(sitting_bucket, activity_date, grp, mep_id) once each: who speaks for a group on a day."""
    return dated.where("mep_id is not null and activity_date is not null").select(BUCKET, "activity_date", "grp", "mep_id").distinct()


#: What is kept of the facts, each a function of facts with their days that works bucket by bucket.
KEPT = {"cube": cube, "speaker_days": speaker_days}


#: The sums of the cube that the mart's tables come of: by day, and by all that isn't a day.
SUMS = (("activity_date", "macro_topic"), ("macro_topic", "macro_specific_focus", "grp", "language"))


def build(facts: DataFrame, sittings: DataFrame, path: str, people: bool = False) -> None:
    """Write the mart. Each table is an aggregate of the cube; `people` adds what distinct_counts() needs."""
    dated = _with_days(facts, sittings, False)
    for name in KEPT if people else ["cube"]:
        sinks.write(KEPT[name](dated), f"{path}/{name}")
    derive(facts.sparkSession, path)


def refresh(spark: SparkSession, speeches: str, sittings: str, path: str) -> dict[str, set[str]]:
    """Bring the mart up to date with two stored tables laid out by sitting; the buckets that were read again for each part.

    The cube's description keeps the numbers of the tables' commits that it was made from.
    Only buckets whose files have changed since are read, and take the place of what the cube has
    of them in one commit with the new numbers; so a run that ends halfway is made good by the
    next one, and doing it twice changes nothing. Where there is no mart yet, or those commits
    are cleared away, all is built anew.
    """
    tables, read = {"speeches": speeches, "sittings": sittings}, {}
    state = {name: sinks.state(spark, table) for name, table in tables.items()}
    done = {name: s.number for name, s in state.items()}
    together = (state["speeches"].key, state["sittings"].key) == ("sitting_id", "id")
    needed: dict[str, frozenset[str] | None] = {}
    for name in KEPT:
        target = f"{path}/{name}"
        known = sinks.state(spark, target).done if sinks.exists(spark, target) else {}
        changes = [sinks.changed_buckets(spark, table, known[t]) if t in known and together else None for t, table in tables.items()]
        needed[name] = None if None in changes else frozenset().union(*changes)
        read[name] = set(state["speeches"].parts) if needed[name] is None else set(needed[name])
    for buckets in {b for b in needed.values() if b is None or b}:
        # Facts meet their days once, and what comes of it is written in few bytes, instead of a join for each part.
        rows = [sinks.rows(spark, tables[t], state[t], buckets) for t in tables]
        dated, stage = sinks.staged(_with_days(rows[0], rows[1], True), f"{path}/cube")
        for name in (n for n, b in needed.items() if b == buckets):
            if buckets is None:
                sinks.write(KEPT[name](dated), f"{path}/{name}", by=BUCKET, done=done)
            else:
                sinks.replace_buckets(KEPT[name](dated), f"{path}/{name}", set(buckets), done)
        sinks.clear(spark, stage)
    derive(spark, path)
    return read


def derive(spark: SparkSession, path: str) -> None:
    """The mart's tables from the stored cube."""
    raw = sinks.read(spark, f"{path}/cube")
    # All tables come of two small sums of the cube, which may be nearly as large as the facts: it is read twice, not once for each table and join.
    sums, stages = zip(*(sinks.staged(raw.groupBy(*keys).agg(F.sum("n").alias("n")), f"{path}/cube") for keys in SUMS))
    variants = topic_variants(sums[1])
    by_day, base = (canonical(rows, variants) for rows in sums)
    known = base.where(filled("macro_topic")).withColumnRenamed("macro_topic", "topic")
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"))
    dated = by_day.where(filled("macro_topic") & F.col("activity_date").isNotNull()).withColumnRenamed("macro_topic", "topic")
    series = None
    for interval in A.INTERVALS:
        one = A.grid(summed(dated, period("activity_date", interval).alias("period"), "topic")).withColumn("interval_type", F.lit(interval))
        series = one if series is None else series.unionByName(one)
    leading = lambda name, k: summed(base.where(F.col(name).isNotNull()), name).orderBy(F.desc("n"), name).limit(k).select(name)
    totals = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(filled("macro_topic"), F.col("n"))), F.lit(0)).alias("with_macro"))
    tables = {
        "topics": variants.drop("key"),
        "timeseries": series,
        "by_group": summed(known.join(leading("grp", 10), "grp", "left_semi"), "topic", "grp"),
        "by_language": summed(known.join(leading("language", 24), "language", "left_semi"), "topic", "language"),
        "languages": summed(base, "language"),
        "overview": totals.withColumn("pct_with_macro", A.percent(F.col("with_macro"), F.col("total"))),
        "top_topics": A.ranked(summed(known, "topic").orderBy(F.desc("n"), "topic").limit(20), "topic"),
        "top_focuses": summed(known.where(filled("macro_specific_focus")), "topic", F.col("macro_specific_focus").alias("focus")).orderBy(F.desc("n"), "topic", "focus").limit(20),
    }
    tables["periods"] = series.select("period", "interval_type").distinct()
    tables["metadata"] = spark.range(1).select(F.lit("last_computed").alias("key"), F.current_timestamp().cast("string").alias("value"))

    def put(name: str) -> None:
        table = conform(tables[name], MART[name]) if name in MART else tables[name]
        sinks.write(table, f"{path}/{name}", "interval_type" if name == "timeseries" else None)

    if sinks.exists(spark, f"{path}/speaker_days"):
        tables["speakers"] = month_bits(sinks.read(spark, f"{path}/speaker_days"))
    # The tables are small and don't depend on each other: their jobs share the cluster.
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(put, tables))
    for stage in stages:
        sinks.clear(spark, stage)


def month_bits(days: DataFrame) -> DataFrame:
    """(month, grp, part, bits): who speaks for a group in a month, as bitmaps of 32,768 speaker numbers each, which can be merged."""
    keys = [F.substring("activity_date", 1, 7).alias("month"), "grp", F.bitmap_bucket_number("mep_id").alias("part")]
    return days.groupBy(*keys).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mep_id")).alias("bits"))


def distinct_counts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, by: str | None = "grp", period_of: str | None = None) -> DataFrame:
    """(period, grp, n, speakers, days) of an inclusive range of days, from the mart alone.

    Speakers are bits of merged bitmaps: those of whole months as they are stored, and
    of the days of a first and last month that the range cuts. `by` None: all groups together; `period_of`
    month, quarter or year: for each of them. Group and period are left out where they aren't asked for.
    """
    day, month = F.col("activity_date"), F.col("month")
    low, high = start or "0000-01-01", end or "9999-12-31"
    # A month is whole if the range has its first and its last possible day.
    whole = (F.concat(month, F.lit("-01")) >= low) & (F.concat(month, F.lit("-31")) <= high)
    names = (["period"] if period_of else []) + ([by] if by else [])
    of_day, of_month = ([period(c, period_of).alias("period")] if period_of else [] for c in ("activity_date", "month"))
    rows = sinks.read(spark, f"{path}/cube").where(day.isNotNull() & day.between(low, high))
    counted = rows.groupBy(*of_day, *names[len(of_day) :]).agg(F.sum("n").alias("n"), F.count_distinct("activity_date").alias("days"))
    cut = sinks.read(spark, f"{path}/speaker_days").where(day.between(low, high)).withColumn("month", F.substring("activity_date", 1, 7)).where(~whole)
    bits = sinks.read(spark, f"{path}/speakers").where(whole).unionByName(month_bits(cut))
    parts = bits.groupBy(*of_month, *names[len(of_month) :], "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("speakers")).groupBy(*names).agg(F.sum("speakers").alias("speakers"))
    if not names:
        return counted.join(F.broadcast(parts)).select("n", F.coalesce("speakers", F.lit(0)).alias("speakers"), "days")
    parts = parts.select(*(F.col(n).alias(f"__{n}") for n in names), "speakers")
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    return counted.join(parts, same, "left").select(*names, "n", F.coalesce("speakers", F.lit(0)).alias("speakers"), "days")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The mart's tables; raises TableNotFound where it hasn't been built."""
    return {name: sinks.read(spark, f"{path}/{name}") for name in MART}


def series(tables: dict[str, DataFrame], interval: str, start: str | None = None, end: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """A slice of the stored grid: one partition, filtered by period and topic."""
    out = tables["timeseries"].where(F.col("interval_type") == interval)
    out = out if start is None else out.where(F.col("period") >= start)
    out = out if end is None else out.where(F.col("period") <= end)
    return (out if topics is None else out.where(F.col("topic").isin(topics))).select("period", "topic", "n")
