"""Flows over stored tables: the persons anew, sittings' metadata, missing content, and speeches that aren't parsed yet.

All of them work on the tables under one folder (`sittings`, `speeches`, `persons`), write through
sinks, and leave what failed in the table `failures`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.columns import document_url, filled, label_of, longer, looks_like_page, sitting_date
from plenaria.functions.groups import affiliation, normalise_groups
from plenaria.operators import persons as P
from plenaria.operators import relational as R
from plenaria.plans import refresh
from plenaria.schema import PERSONS, SITTINGS, SPEECHES, conform
from plenaria.sources import records, sinks


def affiliated(persons: DataFrame, speeches: DataFrame, at_least: int = 10) -> DataFrame:
    """Persons with the label that most of their speeches have as politicalGroup; labels of fewer than `at_least` persons become Other."""
    label = affiliation(*(F.col(f"political_group_{c}") for c in ("std", "kind", "raw")), F.col("political_group"), F.col("title"))
    said = speeches.where("mep_id is not null").select("mep_id", label.alias("found"), "id")
    most = P.most_frequent(said, "mep_id", "found", "id").withColumnRenamed("mep_id", "id")
    joined = persons.join(most, "id", "left").withColumn("politicalGroup", F.coalesce("found", "politicalGroup")).drop("found")
    return P.small_to_other(joined, "politicalGroup", at_least).select(persons.columns)


def person_dataset(speeches: DataFrame, api: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, speeches, linked speeches before new persons were made) from the records of all terms (identifier, term, label, ...): links are cleared and made anew, and speakers without a record become persons. `keep` may store what is used several times."""
    known = conform(P.merged_terms(api).withColumns({"id": F.col("identifier").cast("long"), "source": F.lit("api")}), PERSONS)
    known = known.select(*(p.split()[0] for p in PERSONS.split(", ")))
    linked = keep(P.link_speeches(R.unlinked(speeches), known))
    made = keep(conform(P.missing_persons(linked, known).drop("n"), PERSONS))
    everyone = known.unionByName(made)
    # A new person's speeches are those whose speaker has the same first and last word as its name.
    return everyone, P.link_ends(P.link_speeches(linked, everyone), made), linked


def persons(spark: SparkSession, path: str, api: DataFrame, more: dict[str, str] | None = None, at_least: int = 10) -> dict[str, int]:
    """The person dataset of the tables under `path` anew: links, new persons, groups and affiliations; counts of what was done."""
    speeches = sinks.read(spark, f"{path}/speeches")

    def keep(df: DataFrame) -> DataFrame:
        return sinks.prepare(df, f"{path}/persons").rows()  # never published: vacuum() clears it away

    everyone, again, linked = person_dataset(speeches, api, keep)
    unlinked = speeches.where("mep_id is not null").count()
    n_linked = linked.where("mep_id is not null").count()
    said = sinks.prepare(normalise_groups(again, more=more).select(speeches.columns), f"{path}/speeches", key="sitting_id")
    # Affiliations follow the new speeches; both tables change together once all is written.
    known = sinks.prepare(affiliated(everyone, said.rows(), at_least), f"{path}/persons")
    said.publish()
    known.publish()
    stored = sinks.read(spark, f"{path}/persons")
    by_source = {r["source"]: r["count"] for r in stored.groupBy("source").count().collect()}
    total = said.rows().where("mep_id is not null").count()
    return {"unlinked": unlinked, "api": by_source.get("api", 0), "linked": n_linked, "created": by_source.get("historic", 0), "linked_to_created": total - n_linked}


def described(api: DataFrame) -> DataFrame:
    """Sittings of metadata records (id, type, label by language or plain, dates, contents): the language's label, the first date there is, the longer of two contents."""
    have = set(api.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    label = label_of(F.col("labels")) if "labels" in have else of("label")
    return conform(
        api.withColumns(
            {
                "label": label,
                "activity_date": sitting_date(of("date"), of("activity_date"), of("id")),
                "content": longer(of("content"), of("other_content")),
            }
        ),
        SITTINGS,
    ).select(*(p.split()[0] for p in SITTINGS.split(", ")))


def metadata(spark: SparkSession, path: str, api: DataFrame, everything: bool = False) -> int:
    """Sittings of new metadata records, none of whose identifiers is known, are added; `everything` replaces the table. How many there are now."""
    target, rows = f"{path}/sittings", sinks.one_per_key(described(api), "id")
    if everything or not sinks.exists(spark, target):
        sinks.write(rows, target, key="id")
    else:
        sinks.append(R.unknown_records(rows, sinks.read(spark, target)), target)
    return sinks.read(spark, target).count()


def unparsed(sittings: DataFrame, speeches: DataFrame, since: str | None = None, least: int = 100) -> DataFrame:
    """Sittings with content but without speeches; `since` a day, or all."""
    rows = sittings.where(F.length("content") > least)
    rows = rows if since is None else rows.where(F.col("activity_date") >= since)
    return R.without_facts(rows, speeches)


def parse(spark: SparkSession, path: str, since: str | None = None) -> dict[str, int]:
    """Speeches of sittings that have none yet; contents that aren't transcripts are logged as failures."""
    sittings, target = sinks.read(spark, f"{path}/sittings"), f"{path}/speeches"
    empty = conform(spark.createDataFrame([], "sitting_id string"), SPEECHES)
    todo = unparsed(sittings, sinks.read(spark, target) if sinks.exists(spark, target) else empty, since)
    bad = todo.where(~looks_like_page("content"))
    asked, failed = todo.count(), bad.count()
    if failed:
        sinks.log_failures(bad.select(F.lit("parse").alias("kind"), F.col("id").alias("what"), F.lit("not a transcript").alias("message")), f"{path}/failures")
    if asked > failed:
        made = refresh.speeches_of(todo.select(F.col("id").alias("sitting_id"), F.col("content").alias("html")))
        made = conform(made.withColumn("id", F.xxhash64("sitting_id", "speech_order")), SPEECHES).select(*refresh.SPEECH_COLUMNS)
        sinks.replace_sittings(made, target, replace=False, by_key=True)
    return {"asked": asked, "parsed": asked - failed, "failed": failed}


def content(spark: SparkSession, path: str, as_of: str, load: Callable[[str], str] = records.get, least: int = 50, **options) -> dict[str, int]:
    """Missing contents fetched and stored where they have over `least` characters, failures logged, and what is new parsed."""
    target = f"{path}/sittings"
    sittings = sinks.read(spark, target)
    asked = R.needs_content(sittings, as_of).select("id", "activity_date", document_url("activity_date").alias("url"))
    got = f"{path}/fetched"
    sinks.write(records.fetched(asked, load=load, **options), got)
    found = sinks.read(spark, got)
    good = found.where(F.length("html") > least)
    bad = found.join(good.select("id"), "id", "left_anti")
    n, failed = good.count(), bad.count()
    if failed:
        sinks.log_failures(bad.select(F.lit("content").alias("kind"), F.col("id").alias("what"), F.coalesce("failure", F.lit("too short")).alias("message")), f"{path}/failures")
    if n:
        fresh = sittings.join(good.select("id", "html"), "id").withColumn("content", F.col("html")).drop("html")
        sinks.upsert(fresh.select(sittings.columns), target, by_key=True)
    return {"asked": n + failed, "fetched": n, "failed": failed} | ({"parsed": parse(spark, path)["parsed"]} if n else {"parsed": 0})


def with_local_or_remote(wanted: DataFrame, sittings: DataFrame, remote: DataFrame) -> DataFrame:
    """The sittings asked for (id): as stored, else as a remote record has them; ids that neither knows are left out."""
    local = wanted.join(sittings, "id")
    other = wanted.join(sittings.select("id"), "id", "left_anti").join(described(remote), "id")
    return local.unionByName(other, allowMissingColumns=True).where(filled("id"))
