"""Speeches from transcript text, and the agenda section to which each belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenaria.operators.containment import joined
from plenaria.streaming.counts import scratch

from .columns import trimmed
from .groups import search_text

# How a speech opens, in the order in which the forms are tried, and where name, role and text stand in each.
OPENINGS = (
    (r"^([^,]+),\s*(.+?)\.\s*–\s*(.+)$", 1, 2, 3),
    (r"^([^(]+)\s*\(([^)]+)\)\.\s*–\s*(.+)$", 1, 2, 3),
    (r"^([^(]+)\s*\(([^)]+)\),\s*(.+?)\.\s*–\s*(.+)$", 1, 3, 4),
    (r"^([^.]+)\.\s*–\s*(.+)$", 1, 0, 2),
)
# Codes that are parties, and parts of a role that make it a group.
PARTIES = r"(?i)(PPE|S&D|ECR|Renew|Verts/ALE|ID|The Left|NI|ALDE)"
GROUP_SIGNS = (
    "on behalf of", "au nom de", "a nome del", "en nombre del", "im Namen der", "fraktion", "gruppo", "grupo", "group", "groupe", "εξ ονόματος", "namens",
    "w imieniu", "în numele", "for ", "för ", "thar ceann", "u ime", "za skupinu", "em nome", "(PPE)", "(S&D)", "(ECR)", "(Renew)", "(Verts/ALE)", "(ID)",
    "(The Left)", "(NI)", "(ALDE)",
)


def _opening(line: Column) -> Column:
    out = F.lit(None).cast("struct<name:string,role:string,text:string>")
    for pattern, name, role, text in reversed(OPENINGS):
        part = lambda i, p=pattern: trimmed(F.regexp_extract(line, p, i)) if i else F.lit("")
        out = F.when(line.rlike(pattern), F.struct(part(name).alias("name"), part(role).alias("role"), part(text).alias("text"))).otherwise(out)
    return out


def parse_speeches(sittings: DataFrame, key: str = "sitting_id", content: str = "content") -> DataFrame:
    """(key, speaker_name, political_group, title, speech_content, speech_order) of each speech of a transcript.

    A line that opens a speech starts one; other lines go on with it; lines before the
    first one are dropped. One shuffle by sitting: the running number of openings and
    the grouping share it.
    """
    lines = sittings.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line")).withColumn("line", trimmed("line")).where("line <> ''")
    lines = lines.withColumn("o", _opening(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("speech_order", F.sum(F.col("o").isNotNull().cast("int")).over(so_far)).where("speech_order > 0")
    rows = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("o.text", "line").alias("text"))))
    made = lines.groupBy(key, "speech_order").agg(F.min_by("o", "pos").alias("o"), F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("speech_content"))
    in_name = r"^(.+?)\s*\(([^)]+)\)$"
    code = trimmed(F.regexp_extract("o.name", in_name, 2))
    named = code.rlike(f"^{PARTIES}$")
    role = F.col("o.role")
    sign = F.lit(False)
    for s in GROUP_SIGNS:
        sign = sign | F.contains(role, F.lit(s))
    is_group = (~named & role.rlike(f"^{PARTIES}$")) | sign
    return made.select(
        key,
        F.when(named, trimmed(F.regexp_extract("o.name", in_name, 1))).otherwise(F.col("o.name")).alias("speaker_name"),
        F.when((role != "") & is_group, role).when(named, code).alias("political_group"),
        F.when((role != "") & ~is_group, role).alias("title"),
        "speech_content",
        F.col("speech_order").cast("int").alias("speech_order"),
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder: it is read several times, and made of pages that take long to parse."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Speeches, and sections, of a sitting that meet in one task.
BLOCK = 256


def match_sections(speeches: DataFrame, sections: DataFrame, key: str = "sitting_id", least: float = 0.08) -> DataFrame:
    """Speeches with section (title, docIdentifier, score): the first section that contains a snippet, else the one with most of the words.

    sections: (key, ordinal, title, docIdentifier, text). The speeches and sections of a sitting meet once for each two
    different texts, in blocks of about BLOCK by BLOCK, so that a long sitting is many tasks; a pair is scored as it is
    made, and only its score goes on. Nothing is exploded into words or grams, and nothing is broadcast. Both
    sides are written to the shared folder first, as they may be made of pages. `least` is above 0.
    """
    listed = _stored(sections.select(key, "ordinal", "title", "docIdentifier", search_text("text").alias("norm")), "sections")
    spoken = _stored(speeches, "speeches")
    hashes = ["__h", "__i"]
    rows = spoken.withColumn("said", search_text("speech_content")).select("*", F.xxhash64("said").alias("__h"), F.xxhash64(F.lit(1), F.col("said")).alias("__i"))
    counted = spoken.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(listed.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    blocks = counted.groupBy(key).agg(*(F.ceil(F.sum(c) / BLOCK).cast("int").alias(f"__{c}s") for c in "ab")).where("__as > 0 and __bs > 0")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    asked = rows.where(F.length("said") >= 50).select(key, *hashes, "said").dropDuplicates([key, *hashes])
    asked = joined(asked, blocks, [key]).select(key, *hashes, "said", F.pmod("__h", "__as").cast("int").alias("__a"), every("__bs").alias("__b"))
    words = F.array_distinct(F.filter(F.split("said", " "), lambda w: w != ""))
    asked = asked.withColumn("words", words).withColumn("size", F.greatest(F.size("words"), F.lit(1))).withColumn("words", F.filter("words", lambda w: F.length(w) > 3))
    asked = asked.withColumn("snippets", F.filter(F.array(*(F.substring("said", 1 + at, 160) for at in (0, 40, 80, 120))), lambda s: F.length(s) >= 80)).drop("said")
    # Of sections with one text the first one stands for all, as their scores are equal.
    texts = listed.where("norm <> ''").groupBy(key, "norm").agg(F.min("ordinal").alias("ordinal"))
    texts = joined(texts, blocks, [key]).select(key, "ordinal", "norm", F.pmod(F.xxhash64("norm"), "__bs").cast("int").alias("__b"), every("__as").alias("__a"))
    texts = texts.withColumn("there", F.array_distinct(F.split("norm", " ")))

    # Most words of a speech that a text contains are words of it; only the others are looked for inside.
    absent = F.filter(F.array_except("words", "there"), lambda w: ~F.contains(F.col("norm"), w))
    by_snippet = (F.length("norm") >= 100) & F.exists("snippets", lambda s: F.contains(F.col("norm"), s))
    score = F.when(by_snippet, F.lit(2.0)).otherwise((F.size("words") - F.size(absent)) / F.col("size"))
    scored = joined(asked, texts, [key, "__a", "__b"]).select(key, *hashes, F.struct(score.alias("score"), (-F.col("ordinal")).alias("back")).alias("pair"))
    best = scored.where(F.col("pair.score") >= least).groupBy(key, *hashes).agg(F.max("pair").alias("best"))
    named = listed.groupBy(key, F.col("ordinal").alias("__ordinal")).agg(F.max(F.struct("title", "docIdentifier")).alias("of"))
    found = joined(best.withColumn("__ordinal", -F.col("best.back")), named, [key, "__ordinal"])
    found = found.select(key, *hashes, F.struct(F.col("of.title").alias("title"), F.col("of.docIdentifier").alias("docIdentifier"), F.least("best.score", F.lit(1.0)).alias("score")).alias("section"))
    return joined(rows.drop("said"), found, [key, *hashes], "left").select(*speeches.columns, "section")


def snippet_offset(page_text: str | Column, snippet: Column) -> Column:
    """Offset (from 0) of a snippet in a page's text; -1 if it isn't there."""
    return F.instr(page_text, snippet) - 1
