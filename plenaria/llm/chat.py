"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is rendered as its turns, one after the other:

    <turn ROLE>TEXT</turn>        or        <turn* ROLE>ESCAPED TEXT</turn>

Control strings are `<turn` and `</turn`. The parser is deterministic: it cuts at
`</turn>`, takes the role up to the first `>`, and refuses a segment whose text
holds another control string. Each turn is first rendered as it is and parsed
again. Where the parse differs from the source, the turn is escaped (a backslash
before each backslash, and inside each control string) and marked with `*`; roles
are always escaped. In the end the whole rendering is parsed: if what it gives
isn't identical to the source, every turn is escaped, and if even that differs the
job fails rather than writing a wrong text.

Loss: `loss_spans` are the places (code points) of the assistant's texts in the
rendering, without role and marks.

A conversation is one output text, so its turns meet in one row; that is the size
of one conversation, and a first turn that very many conversations share is only
many rows. Nulls: a null text or role is empty; null conv_ids are one conversation;
turns with equal numbers come by role and then text, null numbers first. Repeated
rows are repeated turns. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END = "<turn", "</turn>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn"), F.lit("<\\/turn"))
    return F.replace(out, F.lit("<turn"), F.lit("<\\turn"))


def escape_role(role: Column) -> Column:
    """As escape(), and no `>` or `<` stays bare: the role ends at the first `>`."""
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role(); an escaped backslash is kept apart while the others are undone."""
    parts = F.split(role, r"\\\\", -1)
    undone = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.when(F.instr(role, "\\") == 0, role).otherwise(F.array_join(undone, "\\"))


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    opened = F.when(escaped, F.lit("<turn* ")).otherwise(F.lit("<turn "))
    return F.concat(opened, escape_role(role), F.lit(">"), F.when(escaped, escape(text)).otherwise(text), F.lit(END))


def parse(rendered: Column) -> Column:
    """The turns of a rendering as array<struct<role, text>>; null if it isn't of the grammar."""
    pattern = r"(?s)\A<turn(\*?) ([^>]*)>(.*)\z"
    segments = F.split(rendered, END, -1)
    body = lambda s: F.regexp_extract(s, pattern, 3)
    turns = F.transform(
        F.slice(segments, 1, F.size(segments) - 1),
        lambda s: F.when(
            F.regexp_like(s, F.lit(pattern)) & ~F.contains(body(s), F.lit("<turn")) & ~F.contains(body(s), F.lit("</turn")),
            F.struct(
                unescape_role(F.regexp_extract(s, pattern, 2)).alias("role"),
                F.when(F.regexp_extract(s, pattern, 1) == "*", unescape(body(s))).otherwise(body(s)).alias("text"),
            ),
        ),
    )
    whole = (F.element_at(segments, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans) per conversation; turns are those read back from formatted."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    # Turn by turn: as it is, unless reparsing gives something else.
    plain = parse(render_turn(F.col("t.role"), F.col("t.text"), F.lit(False)))
    same = (F.size(plain) == 1) & (plain[0]["role"] == F.col("t.role")) & (plain[0]["text"] == F.col("t.text"))
    rows = rows.withColumn("marked", ~F.coalesce(same, F.lit(False)))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t.turn", "t.role", "t.text", "marked"))).alias("source"))
    joined = lambda every: F.array_join(F.transform("source", lambda t: render_turn(t["role"], t["text"], t["marked"] | F.lit(every))), "")
    plainly = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = made.withColumn("wanted", plainly).withColumn("formatted", joined(False))
    made = made.withColumn("formatted", F.when(parse(F.col("formatted")).eqNullSafe(F.col("wanted")), F.col("formatted")).otherwise(joined(True)))
    made = made.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns").eqNullSafe(F.col("wanted")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    return made.select("conv_id", checked.alias("formatted"), "turns", loss_spans(F.col("formatted")).alias("loss_spans"))


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, length, escaped>>: where the assistant's texts are in a rendering (code points, from 0)."""
    segments = F.split(formatted, END, -1)
    measured = F.transform(
        F.slice(segments, 1, F.size(segments) - 1),
        lambda s: F.struct(
            F.char_length(s).alias("n"),
            F.instr(s, ">").alias("head"),
            F.startswith(s, F.lit("<turn*")).alias("escaped"),
            F.regexp_like(s, F.lit(r"\A<turn\*? assistant>")).alias("loss"),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,escaped:boolean>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + s["head"]).alias("start"), (s["n"] - s["head"]).alias("length"), s["escaped"].alias("escaped"))
        spans = F.when(s["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + s["n"] + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(measured, zero, step)["spans"]


def with_fixture(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold control strings."""
    hard = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    made = format_chats(with_fixture(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def under_mask(s: Column) -> Column:
        text = F.substring(F.col("formatted"), s["start"] + 1, s["length"])
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    loss = F.array_join(F.transform("loss_spans", under_mask), "")
    return made.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), rendered AS (
  SELECT *, CASE WHEN contains(text, '<turn') OR contains(text, '</turn')
    THEN 1 + length(replace(replace(replace(text, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn')) ELSE length(text) END
    + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + 14 AS n
  FROM source
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""
