"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A run is a stretch of consecutive lines; it counts as repeated if it has `words`
words or more and all its lines stand, one after the other, at an earlier place
too. Earlier: a smaller doc_id, or the same document and an earlier line.

1. Lines that aren't blank become (document, position, hash, words). For each line
   there are two windows: the fewest lines from it on that reach `words` words, and
   the fewest lines (two at least) up to it that do.
2. Winnowing: the smallest line hash of each window (leftmost of equals) is its
   fingerprint. The windows of both places of a repeated run choose the same line, so
   no repeated run is missed. Neighbouring windows share their fingerprint: the postings
   are one row per chosen line.
3. Join: only fingerprints that stand at two places or more go on.
4. Extension both ways: a posting holds the windows around its line, to the left
   and to the right, each with the hash of its lines' sequence. Windows with equal
   sequences are the same text; the earliest keeps it and later ones are marked.
   Marked windows that touch or overlap are one maximal run, which is deleted.

In a repeated run every line lies in the window that starts at the run's first line or
in one that ends at the line itself and begins inside the run; the latter also holds the
line before, so blank lines between are in one, too. So all of the run is deleted.

The earliest place is an aggregate that is joined back, never a list of places or
pairs of them: a line that a third of all rows share costs one partial minimum per
task and a join whose skewed side adaptive execution splits.

Blank lines (white space only) count for nothing but go with a run around them.
Nulls: a null text has no lines and stays null; null doc_ids come last. Rows that
repeat doc_id and text stand at one place: none is earlier than the others. Extra
columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

DOC = ["__doc", "__text_hash"]
WHITE = " \t\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the order of its documents: the id (null: last) and a hash of the text."""
    last = F.lit(2**63 - 1)
    return docs.withColumns({DOC[0]: F.coalesce(F.col("doc_id").cast("long"), last), DOC[1]: F.xxhash64("text")})


def windows(docs: DataFrame, words: int) -> DataFrame:
    """(document, at, last, print_hash, print_at, sequence): the full windows that start at each line, and those of two lines or more that end there."""
    lines = _keyed(docs).select(*DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.btrim("line", F.lit(WHITE)) != "")
    lines = lines.select(*DOC, "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"))
    in_doc = Window.partitionBy(*DOC)
    before = F.coalesce(F.sum("w").over(in_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Rows that repeat a document share its positions: one of them is enough. One shuffle serves this and all windows.
    lines = lines.repartition(*DOC).groupBy(*DOC, "pos").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.first("w").alias("w")).withColumn("s", before)
    lines = lines.withColumn("e", F.col("s") + F.col("w"))
    ahead, behind = in_doc.orderBy("s").rangeBetween(0, words - 1), in_doc.orderBy("e").rangeBetween(1 - words, 0)
    here, alone = F.struct("h", "pos"), F.col("w") >= words
    line = F.struct("h", "g")
    hashed = lambda lines: F.struct(F.xxhash64(lines).alias("a"), F.xxhash64(F.lit(1), lines).alias("b"))
    one_before = in_doc.orderBy("e")
    starting = F.struct(
        F.col("pos").alias("at"),
        F.max("pos").over(ahead).alias("last"),
        F.min(here).over(ahead).alias("chosen"),
        hashed(F.collect_list(line).over(ahead)).alias("sequence"),
        (F.max("e").over(ahead) >= F.col("s") + words).alias("full"),
    )
    other = F.lag("pos").over(one_before)
    ending = F.struct(
        F.when(alone, other).otherwise(F.min("pos").over(behind)).alias("at"),
        F.col("pos").alias("last"),
        F.when(alone, F.least(F.lag(here).over(one_before), here)).otherwise(F.min(here).over(behind)).alias("chosen"),
        hashed(F.when(alone, F.array(F.lag(line).over(one_before), line)).otherwise(F.collect_list(line).over(behind))).alias("sequence"),
        F.when(alone, other.isNotNull()).otherwise(F.min("s").over(behind) <= F.col("e") - words).alias("full"),
    )
    made = lines.select(*DOC, starting.alias("starting"), ending.alias("ending")).select(*DOC, F.explode(F.array("starting", "ending")).alias("x")).where("x.full")
    return made.select(*DOC, "x.at", "x.last", F.col("x.chosen.h").alias("print_hash"), F.col("x.chosen.pos").alias("print_at"), "x.sequence")


def repeated_runs(docs: DataFrame, words: int = 50) -> DataFrame:
    """(document, start, last): the maximal runs of lines that repeat an earlier one, as line numbers from 0."""
    postings = windows(docs, words).groupBy(*DOC, "print_hash", "print_at").agg(F.collect_set(F.struct("at", "last", "sequence")).alias("around"))
    postings = stored(postings, "line-postings")
    place = F.struct(*DOC, "print_at")
    shared = postings.groupBy("print_hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("print_hash")
    # Written first, so that each join meets two plain shuffles, whose skewed partitions can be split.
    shared = stored(shared, "line-prints")
    extended = postings.join(shared, "print_hash").select(*DOC, F.explode("around").alias("x")).select(*DOC, "x.*")
    extended = stored(extended, "line-windows")
    place = F.struct(*DOC, "at")
    firsts = extended.groupBy("sequence").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("sequence", "low")
    firsts = stored(firsts, "line-firsts")
    marked = extended.join(firsts, "sequence").where(place > F.col("low")).select(*DOC, "at", "last")
    in_doc = Window.partitionBy(*DOC).orderBy("at", "last")
    reached = F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("at") > F.coalesce(F.col("reached"), F.lit(-2)) + 1).cast("int")
    numbered = marked.withColumn("reached", reached).withColumn("run", F.sum(opens).over(in_doc))
    return numbered.groupBy(*DOC, "run").agg(F.min("at").alias("start"), F.max("last").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, words: int = 50) -> DataFrame:
    """`docs` with repeated runs deleted from its texts, and n_lines and n_removed (in place of columns of these names)."""
    runs = repeated_runs(docs, words).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "last"))).alias("__runs"))
    joined = _keyed(docs).join(runs, DOC, "left")
    lines = F.split("text", "\n")
    n = F.coalesce(F.size(lines), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["last"] + 1))
    stops = F.concat(F.transform("__runs", lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))
    removed = F.aggregate("__runs", F.lit(0), lambda acc, r: acc + r["last"] - r["start"] + 1)
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select(
        *(text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    made = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


LINES_SQL = """
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})
), filled AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
), placed AS (
  SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS other,
    lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS other_line FROM filled
), framed AS (
  SELECT doc_id, pos, line, w, e, other, other_line, max(pos) OVER f AS last, max(e) OVER f AS reach, list(line) OVER f AS seq,
    min(pos) OVER b AS back, min(e - w) OVER b AS back_s, list(line) OVER b AS back_seq
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY e - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
    b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), full_windows AS (
  SELECT *, doc_id * 1000000 + pos AS place FROM (
    SELECT doc_id, pos, last, seq FROM framed WHERE reach >= e - w + 50
    UNION ALL SELECT doc_id, back, pos, back_seq FROM framed WHERE w < 50 AND back_s <= e - 50
    UNION ALL SELECT doc_id, other, pos, [other_line, line] FROM framed WHERE w >= 50 AND other IS NOT NULL)
), firsts AS (
  SELECT seq, min(place) AS low FROM full_windows GROUP BY seq HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT doc_id, unnest(range(pos, last + 1)) AS pos FROM full_windows JOIN firsts USING (seq) WHERE place > low)
), deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
"""
OP7_SQL = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM deduped
"""
