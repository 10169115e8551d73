"""Persons: affiliation from speeches, linking of speakers, and members that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.operators.containment import contained

def most_frequent(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): each one's most frequent value, of equals the one seen first by `order`. Aggregates only; no window over all rows."""
    n = rows.where((F.col(value) != "Unknown") & (F.col(value) != "")).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return n.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("seen"))).alias(value))


def first_value(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): the first value that isn't null."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.min_by(value, order).alias(value))


def small_to_other(persons: DataFrame, column: str = "political_group", at_least: int = 10, other: str = "Other") -> DataFrame:
    """Groups of fewer than `at_least` persons become `other`."""
    n = persons.groupBy(column).agg(F.count("*").alias("members"))
    return persons.join(n, column, "left").withColumn(column, F.when(F.col("members") < at_least, F.lit(other)).otherwise(F.col(column))).drop("members")


def name_key(c: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def turned(c: str | Column) -> Column:
    """The words of a name in reverse order."""
    return F.array_join(F.reverse(F.split(name_key(c), " ")), " ")


def name_keys(persons: DataFrame) -> DataFrame:
    """(key, person_id): names as they are written and turned round; the smallest id has a name that several share."""
    keys = persons.select("id", F.explode(F.array(name_key("label"), turned("label"))).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min("id").alias("person_id"))


def creation_keys(persons: DataFrame) -> DataFrame:
    """(key, person_id) by label and by given and family name in either order; the largest id has a shared name."""
    forms = F.array(F.col("label"), F.concat_ws(" ", "givenName", "familyName"), F.concat_ws(" ", "familyName", "givenName"))
    keys = persons.select("id", F.explode(F.transform(forms, name_key)).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.max("id").alias("person_id"))


def link_speakers(speakers: DataFrame, persons: DataFrame, within: bool = True) -> DataFrame:
    """`speakers` (speaker_name, once each) with person_id: by name, in either order, or else by a label that contains the name.

    The second way only sees speakers that the first left over, and finds the labels, also
    those in which a name begins or ends inside a word, by an index of their grams; of several the smallest id counts.
    """
    exact = speakers.join(name_keys(persons), name_key("speaker_name") == F.col("key"), "left").drop("key")
    if not within:
        return exact
    labels = persons.select(name_key("label").alias("text"), "id").where("text <> ''").groupBy("text").agg(F.min("id").alias("found"))
    missing = exact.where("person_id is null").select("speaker_name", F.explode(F.array(name_key("speaker_name"), turned("speaker_name"))).alias("form")).where("form <> ''")
    near = contained(missing, labels).join(labels, "text").groupBy("form").agg(F.min("found").alias("found"))
    near = missing.join(near, "form").groupBy("speaker_name").agg(F.min("found").alias("found"))
    return exact.join(near, "speaker_name", "left").withColumn("person_id", F.coalesce("person_id", "found")).drop("found")


def link_speeches(speeches: DataFrame, persons: DataFrame) -> DataFrame:
    """Speeches with mep_id where it was missing and the speaker is known; speakers are linked once each."""
    names = speeches.where("mep_id is null and speaker_name is not null").select("speaker_name").distinct()
    linked = link_speakers(names, persons).where("person_id is not null").select("speaker_name", "person_id")
    return speeches.join(linked, "speaker_name", "left").withColumn("mep_id", F.coalesce("mep_id", "person_id")).drop("person_id")


def numbered(df: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """`df` with `number` from 1 by bucket and order, without one task for all: each bucket's rows are numbered by themselves and moved by the earlier buckets' counts."""
    rows = df.withColumn("bucket", bucket)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return rows.withColumn("own", own).join(counts, "bucket").withColumn("number", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def name_ends(key: Column) -> Column:
    """First and last word of a name's key."""
    words = F.split(key, " ")
    return F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1))


def link_ends(speeches: DataFrame, made: DataFrame) -> DataFrame:
    """Speeches without a person linked to the new member (see missing_persons) with the same first and last word."""
    ends = made.groupBy(name_ends(name_key("label")).alias("ends")).agg(F.min("id").alias("found"))
    names = speeches.where("mep_id is null").select("speaker_name").where(name_key("speaker_name") != "").distinct()
    found = names.join(ends, name_ends(name_key("speaker_name")) == F.col("ends")).select("speaker_name", "found")
    return speeches.join(found, "speaker_name", "left").withColumn("mep_id", F.coalesce("mep_id", "found")).select(speeches.columns)


def missing_persons(speeches: DataFrame, persons: DataFrame) -> DataFrame:
    """New members (id, label, country, source, n) for speakers whom nobody matches, ids after the largest one.

    One for each name without regard to case; frequent speakers come first, then names.
    Speakers who share first and last word with a known person or with a more frequent
    new one are that person and get none.
    """
    names = speeches.where("mep_id is null").groupBy(name_key("speaker_name").alias("key")).agg(F.count("*").alias("n"), F.min("speaker_name").alias("label"))
    names = names.where("key <> ''").join(creation_keys(persons).select("key"), "key", "left_anti")
    known = persons.select(name_ends(name_key("label")).alias("ends")).distinct()
    names = names.withColumn("ends", name_ends(F.col("key"))).join(known, "ends", "left_anti")
    names = names.groupBy("ends").agg(F.min_by(F.struct("key", "label", "n"), F.struct(-F.col("n"), F.col("key"))).alias("x")).select("x.*")
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = numbered(names, [F.col("key")], F.struct((-F.col("n")).alias("rank"), F.substring("key", 1, 2).alias("start")))
    return placed.join(F.broadcast(top)).select((F.col("top") + F.col("number")).alias("id"), "label", F.lit("Unknown").alias("country"), F.lit("historic").alias("source"), "n")


def in_sequence(speeches: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, made): speaker_name and person_id of all speakers without a person, and the new persons, as if one speaker came after the other.

    In that order (most speeches first, then by name) a speaker is whoever has the
    speaker's name, or its first and last word in either order, and else becomes a new person
    under these three keys. No lookup in a loop is needed: two speakers share a key just
    if their first and last words are the same pair, or they are one and the same word,
    so speakers fall into classes whose members all share keys. Of those in a class
    whom no known person matches the first one is new, and the others are that person.
    """
    said = speeches.where("mep_id is null and trim(speaker_name) <> ''")
    has_group = "political_group" in speeches.columns
    names = said.groupBy("speaker_name").agg(F.count("*").alias("n"), F.max("political_group" if has_group else F.lit(None).cast("string")).alias("grp"))
    words = F.split(F.trim(F.regexp_replace("speaker_name", r"\s+", " ")), " ")
    names = names.withColumns({"key": F.lower(F.trim("speaker_name")), "first": words[0], "last": F.element_at(words, -1), "many": F.size(words) > 1})
    ends = (F.lower("first"), F.lower("last"))
    forms = F.when(F.col("many"), F.array("key", F.concat_ws(" ", *ends), F.concat_ws(" ", *reversed(ends)))).otherwise(F.array("key"))
    lookup = _lookup(persons)
    known = names.select("speaker_name", F.posexplode(forms).alias("place", "form")).join(lookup, F.col("form") == lookup["name"])
    known = known.groupBy("speaker_name").agg(F.min_by("person_id", "place").alias("person_id"))
    rest = names.join(known, "speaker_name", "left_anti")
    rest = rest.withColumn("pair", F.when(F.col("many"), F.concat_ws(" ", F.least(*ends), F.greatest(*ends))).otherwise(F.col("key")))
    leading = rest.groupBy("pair").agg(F.min_by(F.struct("speaker_name", "n", "first", "last", "grp"), F.struct(-F.col("n"), F.col("speaker_name"))).alias("x")).select("pair", "x.*")
    placed = numbered(leading, [F.col("speaker_name")], F.struct((-F.col("n")).alias("rank"), F.substring("speaker_name", 1, 2).alias("start")))
    top = persons.agg(F.coalesce(F.nullif(F.max("id"), F.lit(0)), F.lit(1_000_000)).alias("top"))
    made = placed.join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("number"))
    links = known.unionByName(rest.join(made.select("pair", F.col("id").alias("person_id")), "pair").select("speaker_name", "person_id"))
    name = F.trim("speaker_name")
    out = made.select(
        "id", name.alias("label"), F.col("first").alias("givenName"), F.col("last").alias("familyName"), name.alias("sortLabel"), F.lit("Unknown").alias("country"),
        F.coalesce(F.nullif("grp", F.lit("")), F.lit("Unknown")).alias("politicalGroup"), F.lit(False).alias("is_current"), F.lit("historic").alias("source"), "n",
    )
    return links, out


def _lookup(persons: DataFrame) -> DataFrame:
    """(name, person_id): label, given and family name in either order; the largest id has a shared one."""
    low = lambda c: F.lower(F.trim(c))
    both = F.when((low("givenName") != "") & (low("familyName") != ""), F.array(F.concat_ws(" ", low("givenName"), low("familyName")), F.concat_ws(" ", low("familyName"), low("givenName"))))
    keys = persons.select("id", F.explode(F.concat(F.array(low("label")), F.coalesce(both, F.array().cast("array<string>")))).alias("name"))
    return keys.where("name <> ''").groupBy("name").agg(F.max("id").alias("person_id"))


def merged_terms(records: DataFrame, current: int = 10) -> DataFrame:
    """Persons of several terms (identifier, term, ...) once each: the newest term's record, with is_current."""
    newest = records.groupBy("identifier").agg(F.max_by(F.struct(*[c for c in records.columns if c != "identifier"]), "term").alias("x"))
    return newest.select("identifier", "x.*").withColumn("is_current", F.col("term") == current)
