"""Joins, set operations, duplicates and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.functions.columns import between, effective_group, filled, jaccard, tokens, unset
from plenaria.schema import PERSONS, SITTINGS, SPEECHES


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key, as a filter that reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def toggled(df: DataFrame, column: str, descending: bool = False, collation: str = "UNICODE_CI") -> DataFrame:
    """Sorted by a text as a reader expects it (case doesn't count, accents follow their letter), either way; ties by the text itself."""
    order = F.collate(column, collation)
    return df.orderBy(order.desc() if descending else order.asc(), column)


def extract(
    facts: DataFrame, sittings: DataFrame, language: str | None = None, groups: Sequence[str] | None = None, start: str | None = None, end: str | None = None,
    text: str = "speech_content", shortest: int = 0, longest: int | None = None,
) -> DataFrame:
    """Facts of a language, of some groups, of days and of a length, with activity_date, year, month and length."""
    days = sittings.select(F.col("id").alias("sitting_id"), "activity_date").where(between("activity_date", start, end))
    rows = facts if language is None else facts.where(F.col("language") == language)
    rows = rows if groups is None else rows.where(effective_group().isin(list(groups)))
    size = F.length(text)
    rows = rows.where((size >= shortest) & (F.lit(True) if longest is None else size <= longest)).withColumn("length", size)
    return rows.join(days, "sitting_id").withColumns({"year": F.substring("activity_date", 1, 4), "month": F.substring("activity_date", 1, 7)})


def sittings_page(
    sittings: DataFrame, facts: DataFrame, start: str | None = None, end: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Sittings with their number of speeches, newest first. The page is cut before the facts are counted."""
    chosen = page(sittings.where(between("activity_date", start, end)), [F.desc("activity_date"), F.asc("id")], limit, offset)
    n = facts.join(chosen.select(F.col("id").alias("sitting_id")), "sitting_id", "left_semi").groupBy("sitting_id").agg(F.count("*").alias("n"))
    return chosen.join(n.withColumnRenamed("sitting_id", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def without_facts(sittings: DataFrame, facts: DataFrame) -> DataFrame:
    return sittings.join(facts.select(F.col("sitting_id").alias("id")), "id", "left_anti")


def with_facts(sittings: DataFrame, facts: DataFrame) -> DataFrame:
    return sittings.join(facts.select(F.col("sitting_id").alias("id")), "id", "left_semi")


def progress(sittings: DataFrame, facts: DataFrame, topic: str = "macro_topic") -> DataFrame:
    """Sittings with n and n_unset: speeches, and those without a topic (null where there are none)."""
    done = facts.groupBy(F.col("sitting_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(unset(topic)).alias("n_unset"))
    return sittings.join(done, "id", "left")


def needs_processing(sittings: DataFrame, facts: DataFrame, topic: str = "macro_topic") -> DataFrame:
    """Without speeches, or with some that have no topic."""
    return progress(sittings, facts, topic).where("n is null or n_unset > 0").drop("n", "n_unset")


def fully_processed_latest(sittings: DataFrame, facts: DataFrame, topic: str = "macro_topic") -> DataFrame:
    return progress(sittings, facts, topic).where("n > 0 and n_unset = 0").agg(F.max("activity_date").alias("activity_date"))


def dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Each day of an inclusive range as an ISO date."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    listed = spark.range(1).select(F.explode(days).alias("day")).where(F.lit(start <= end))
    return listed.select(F.col("day").cast("string").alias("activity_date"))


def new_dates(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.join(known.select("activity_date"), "activity_date", "left_anti")


def date_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("activity_date").union(b.select("activity_date")).distinct()


def unknown_records(new: DataFrame, known: DataFrame, keys: Sequence[str] = ("id", "docIdentifier", "notationId")) -> DataFrame:
    """New records of which no identifier is known; empty identifiers know nothing."""
    for k in keys:
        seen = known.select(F.col(k).alias("seen")).where(filled("seen")).distinct()
        new = new.join(seen, F.col(k) == F.col("seen"), "left_anti")
    return new


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row per content that stands more than once, named by its hash: n and the smallest and largest key.

    The keys are not listed, as a group may hold a large share of all rows; join
    them back by the hash where they are wanted.
    """
    return (
        df.groupBy(F.sha2(content, 256).alias("content_hash"))
        .agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.countDistinct(key).alias("keys"))
        .where("n > 1")
    )


def keep_first(df: DataFrame, content: str, key: str) -> DataFrame:
    """Of rows of equal content the one of the smallest key; rows without content all stay. Only hashes and keys are aggregated."""
    hashed = df.withColumn("content_hash", F.sha2(content, 256))
    firsts = hashed.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(key).alias("first_key")).select("first_key")
    kept = df.join(firsts, F.col(key) == F.col("first_key"), "left_semi")
    return kept.unionByName(df.where(F.col(content).isNull()))


def longest_per(df: DataFrame, by: str, content: str, key: str) -> DataFrame:
    """Of each value of `by` the row with the longest content, then the smallest key."""
    w = Window.partitionBy(by).orderBy(F.desc(F.length(content)), key)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def grouped_records(records: DataFrame) -> DataFrame:
    """Records of a day as one: (activity_date, n, id, type, label), the first record's values. Undated ones are dropped."""
    dated = records.withColumn("activity_date", F.coalesce("activity_date", "activity_start_date")).where(filled("activity_date"))
    first = F.min_by(F.struct("id", "type", "label"), "ordinal").alias("first")
    return dated.groupBy("activity_date").agg(F.count("*").alias("n"), first).select("activity_date", "n", "first.*")


def add_if_new(known: DataFrame, names: DataFrame) -> DataFrame:
    """`known` (name, ordinal) and after it the names it lacks, compared without case and outer spaces, in their order."""
    key = F.lower(F.trim("name"))
    fresh = names.where(filled("name")).withColumn("key", key).join(known.select(key.alias("key")).distinct(), "key", "left_anti")
    fresh = fresh.groupBy("key").agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))
    base = known.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("base"))
    placed = fresh.join(F.broadcast(base)).select(F.trim("name").alias("name"), (F.col("base") + 1 + F.col("ordinal")).alias("ordinal"))
    return known.select("name", "ordinal").unionByName(placed)


def first_agenda(topics: DataFrame, by: str = "sitting_id") -> DataFrame:
    """Agenda entries without repetitions of (docIdentifier, title); the first stays."""
    w = Window.partitionBy(by, "docIdentifier", F.lower(F.trim("title"))).orderBy("ordinal")
    return topics.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def best_match(left: DataFrame, right: DataFrame, block: str, score: Column, least: float, key: str, label: str) -> DataFrame:
    """(key, label, score): for each left row the best right one in the same block, if it reaches `least`; ties go to the smaller label."""
    scored = left.join(right, block).withColumn("score", score).where(F.col("score") >= least)
    return scored.groupBy(key).agg(F.max(F.struct("score", label)).alias("best")).select(key, f"best.{label}", "best.score")


def most_alike(left: DataFrame, right: DataFrame, block: str, a: str, b: str, least: float) -> DataFrame:
    """(block, a, b): for each text `a` of `left` the text `b` of the same block whose words are most like its own, if the sets' similarity reaches `least` (above 0).

    Ties go as in best_match(). Equal texts and equal sets are compared once. Sets of m and n
    words can only be so alike if they share k words, so they have one in common among the m - k + 1
    and n - k + 1 rarest of the block: only those are looked up, by sizes, and pairs found are
    compared exactly. A set that the other side has too needs no further look.
    """
    if least <= 0:
        raise ValueError("least has to be above 0")
    # A little less than the bound, as it is a rounded number.
    common = lambda m, n: F.greatest(F.ceil((m + n) * (least / (1 + least)) - 1e-6), F.lit(1)).cast("int")

    def sized(own: DataFrame, words: str, other: DataFrame, others: str) -> DataFrame:
        """The sets whose sizes allow the similarity with a size that the other side has in their block."""
        sizes = other.groupBy(block).agg(F.collect_set(F.size(others)).alias("__sizes"))
        return own.join(sizes, block).where(F.exists("__sizes", lambda n: common(F.size(words), n) <= F.least(F.size(words), n))).drop("__sizes")

    asked = left.select(block, a, F.array_sort(tokens(a)).alias("__s")).where(F.size("__s") > 0).distinct()
    given = right.select(block, b, F.array_sort(tokens(b)).alias("__t")).where(F.size("__t") > 0)
    given = sized(given, "__t", asked, "__s").groupBy(block, "__t").agg(F.max(b).alias(b))
    sets = asked.select(block, "__s").distinct()
    same = sets.join(given.withColumnRenamed("__t", "__s"), [block, "__s"])
    rest = sets.join(given.select(block, F.col("__t").alias("__s")), [block, "__s"], "left_anti")
    held = given.select(block, F.explode("__t").alias("__w")).groupBy(block, "__w").agg(F.count("*").alias("__n"))

    def keys(own: DataFrame, words: str, other: DataFrame, others: str) -> DataFrame:
        """Each set's rarest words, by the sizes that it has to have in common with the other side's."""
        size = F.size(words)
        sizes = other.groupBy(block).agg(F.array_sort(F.collect_set(F.size(others))).alias("__sizes"))
        ranked = own.select(block, words, F.explode(words).alias("__w")).join(held, [block, "__w"], "left")
        ranked = ranked.groupBy(block, words).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__w").alias("w")))).alias("__order"))
        ranked = ranked.join(sizes, block).select(block, words, "__order", F.explode("__sizes").alias("__size"))
        shared = common(size, F.col("__size"))
        ranked = ranked.where(shared <= F.least(size, F.col("__size"))).withColumn("__few", F.slice("__order", 1, size - shared + 1))
        return ranked.select(block, words, size.alias(f"{words}_n"), F.col("__size").alias("__s_n" if words == "__t" else "__t_n"), F.explode(F.col("__few.w")).alias("__w"))

    near = keys(rest, "__s", given, "__t").join(keys(given, "__t", rest, "__s"), [block, "__s_n", "__t_n", "__w"]).select(block, "__s", "__t")
    scored = near.distinct().withColumn("__score", jaccard(F.col("__s"), F.col("__t"))).where(F.col("__score") >= least).join(given, [block, "__t"])
    best = scored.groupBy(block, "__s").agg(F.max(F.struct("__score", b)).alias("__best")).select(block, "__s", f"__best.{b}")
    found = same.select(block, "__s", b) if least <= 1 else same.select(block, "__s", b).limit(0)
    return asked.join(found.unionByName(best), [block, "__s"]).select(block, a, b)


def apply_rules(facts: DataFrame, rules: DataFrame, column: str = "macro_topic") -> DataFrame:
    """`column` replaced by the rules' canonical label; rules (canonical, variants) are sanitised first."""
    pairs = sanitised(rules).select(F.explode("variants").alias("__variant"), F.col("canonical").alias("__label")).where("__variant <> __label")
    joined = facts.join(pairs, F.col(column) == F.col("__variant"), "left")
    return joined.select(*(F.coalesce("__label", column).alias(c) if c == column else c for c in facts.columns))


def applied_rules(facts: DataFrame, rules: DataFrame, column: str = "macro_topic") -> tuple[DataFrame, DataFrame]:
    """The facts under the rules, and (canonical, n): how many rows each rule changed."""
    return apply_rules(facts, rules, column), rules_impact(facts, rules, column)


def sanitised(rules: DataFrame) -> DataFrame:
    """Rules without "(alt)" or "(other)" labels and without effect; a variant stays with the first rule (by canonical) that has it."""
    rows = rules.where(~F.lower("canonical").rlike(r"\((alt|other)\)")).where(F.exists("variants", lambda v: v != F.col("canonical")))
    w = Window.partitionBy("variant").orderBy("canonical")
    flat = rows.select("canonical", F.explode("variants").alias("variant")).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return flat.groupBy("canonical").agg(F.array_sort(F.collect_set("variant")).alias("variants"))


def rules_impact(facts: DataFrame, rules: DataFrame, column: str = "macro_topic") -> DataFrame:
    """(canonical, n): how many rows each rule would change."""
    pairs = sanitised(rules).select(F.explode("variants").alias("variant"), "canonical").where("variant <> canonical")
    counts = facts.groupBy(F.col(column).alias("variant")).agg(F.count("*").alias("n"))
    return pairs.join(counts, "variant").groupBy("canonical").agg(F.sum("n").alias("n"))


# The fields of an export, by table and column; those without another name are called like their column.
EXPORT = {
    "id": ("speech", "id"), "sitting_id": ("speech", "sitting_id"), "date": ("sitting", "activity_date"), "activity_start_date": ("sitting", "activity_start_date"),
    "activity_type": ("sitting", "activity_type"), "speech_order": ("speech", "speech_order"), "created_at": ("speech", "created_at"),
    "speaker_name": ("speech", "speaker_name"), "mep_id": ("speech", "mep_id"), "country": ("person", "country"), "political_group": ("speech", "political_group"),
    "political_group_raw": ("speech", "political_group_raw"), "political_group_std": ("speech", "political_group_std"),
    "political_group_kind": ("speech", "political_group_kind"), "political_group_reason": ("speech", "political_group_reason"),
    "title": ("speech", "title"), "speech_content": ("speech", "speech_content"), "language": ("speech", "language"), "sitting_content": ("sitting", "content"),
    "sitting_label": ("sitting", "label"), "sitting_type": ("sitting", "type"), "doc_identifier": ("sitting", "docIdentifier"), "notation_id": ("sitting", "notationId"),
    "topic": ("speech", "topic"), "macro_topic": ("speech", "macro_topic"), "specific_focus": ("speech", "macro_specific_focus"),
    "macro_confidence": ("speech", "macro_confidence"), "macro_classified_by": ("speech", "macro_classified_by"),
    "macro_classified_at": ("speech", "macro_classified_at"), "macro_classification_cost": ("speech", "macro_classification_cost"),
}
# The fields of an export that names none.
DEFAULT_EXPORT = (
    "id", "sitting_id", "date", "speaker_name", "political_group", "title", "speech_content", "language", "macro_topic", "specific_focus", "topic", "country", "mep_id",
)
KINDS = {table: dict(part.split() for part in ddl.split(", ")) for table, ddl in (("speech", SPEECHES), ("sitting", SITTINGS), ("person", PERSONS))}


def export(
    facts: DataFrame, sittings: DataFrame, persons: DataFrame, fields: Sequence[str] | None = None, start: str | None = None, end: str | None = None,
    ordered: bool = False, made: dict[str, Column] | None = None,
) -> DataFrame:
    """Facts with their sitting and person, as the fields asked for; unknown ones are left out, none at all is an error.

    A table none of whose fields is asked for is not joined; a column that a table of
    another age lacks is null. ordered: newest sittings first, then by order of speech.
    made: columns of the facts that come of their other ones; they are made behind the joins,
    so that what is shuffled is what they come of.
    """
    made = made or {}
    chosen = [f for f in (fields or DEFAULT_EXPORT) if f in EXPORT]
    if not chosen:
        raise ValueError("no known field")

    def value(df: DataFrame, table: str, column: str) -> Column:
        if table == "speech" and column == "political_group" and {"political_group", "political_group_std"} <= set(df.columns):
            return effective_group()
        return F.col(column) if column in df.columns else F.lit(None).cast(KINDS[table][column])

    def picked(df: DataFrame, table: str) -> list[Column]:
        return [value(df, table, EXPORT[f][1]).alias(f"__{f}") for f in dict.fromkeys(chosen) if EXPORT[f][0] == table]

    fields = [f for f in dict.fromkeys(chosen) if EXPORT[f][0] == "speech"]
    order = [F.col("__day").desc(), F.col("speech_order").asc()]
    of_sitting, of_person = picked(sittings, "sitting"), picked(persons, "person")
    out = facts
    if of_sitting or start or end or ordered:
        days = sittings.where(between("activity_date", start, end)).select(F.col("id").alias("__sitting"), *of_sitting, *[F.col("activity_date").alias("__day")] * ordered)
        out = out.join(days, out["sitting_id"] == days["__sitting"], "inner" if start or end else "left")
    if of_person:
        out = out.join(persons.select(F.col("id").alias("__person"), *of_person), out["mep_id"] == F.col("__person"), "left")
    out = out.withColumns(made) if made else out
    out = out.withColumns({f"__{f}": value(out, "speech", EXPORT[f][1]) for f in fields})
    return (out.orderBy(*order) if ordered else out).select(*(F.col(f"__{f}").alias(f) for f in chosen))


def needs_content(sittings: DataFrame, as_of: str, least: int = 100) -> DataFrame:
    """Dated sittings, not in the future, whose content is missing or shorter than `least` characters."""
    short = F.length(F.coalesce("content", F.lit(""))) < least
    return sittings.where(short & filled("activity_date") & (F.col("activity_date") <= as_of))


def match_agenda(sittings: DataFrame, topics: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, title): for each sitting the agenda entry of its day with its document identifier, else the one whose title is most like its label."""
    by_document = topics.where(filled("docIdentifier")).groupBy("activity_date", "docIdentifier").agg(F.min("title").alias("title"))
    direct = sittings.join(by_document, ["activity_date", "docIdentifier"], "left")
    near = most_alike(direct.where("title is null"), topics, "activity_date", "label", "title", least).withColumnRenamed("title", "near")
    return direct.join(near, ["activity_date", "label"], "left").select("id", F.coalesce("title", "near").alias("title"))


def reparsed(parsed: DataFrame, stored: DataFrame, column: str = "political_group", key: str = "sitting_id", order: str = "speech_order") -> DataFrame:
    """Stored rows with another value of `column` in the new parse, of sittings with as many speeches in both."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    same = count(parsed, "a").join(count(stored, "b"), key).where("a = b").select(key)
    fresh = parsed.join(same, key, "left_semi").select(key, order, F.col(column).alias("fresh"))
    both = stored.join(fresh, [key, order]).where(~F.col("fresh").eqNullSafe(F.col(column)))
    return both.withColumn(column, F.col("fresh")).drop("fresh")


def envelope(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(total, limit, offset, has_more) of a listing."""
    total = rows.agg(F.count("*").alias("total"))
    return total.select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > limit + offset).alias("has_more"))


def unlinked(speeches: DataFrame) -> DataFrame:
    """Speeches without their persons."""
    return speeches.withColumn("mep_id", F.lit(None).cast("long"))
