"""Windows over the turns of a sitting: first and last ones, changes of speaker, speakers by appearance, combined text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_topic(turns: DataFrame, k: int = 4, topic: str = "speaker_name") -> DataFrame:
    """The first k turns of each topic of a sitting, with "n of m"."""
    group = Window.partitionBy("sitting_id", topic)
    out = turns.withColumn("nth", F.row_number().over(group.orderBy("speech_order"))).withColumn("total", F.count("*").over(group))
    return out.where(F.col("nth") <= k).withColumn("place", F.concat_ws(" of ", "nth", "total"))


def last_turns(turns: DataFrame, k: int = 6) -> DataFrame:
    back = Window.partitionBy("sitting_id").orderBy(F.desc("speech_order"))
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= k)


def changes(turns: DataFrame, of: str = "speaker_name") -> DataFrame:
    """Turns with `changed`: whether the value differs from the turn before; true for the first."""
    before = F.lag(of).over(Window.partitionBy("sitting_id").orderBy("speech_order"))
    return turns.withColumn("changed", ~F.coalesce(before.eqNullSafe(F.col(of)), F.lit(False)) | before.isNull())


def speakers(turns: DataFrame) -> DataFrame:
    """Distinct speakers of each sitting with the turn of their first appearance."""
    return turns.groupBy("sitting_id", "speaker_name").agg(F.min("speech_order").alias("first_turn"), F.count("*").alias("n"))


def combined(turns: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """All text of a sitting in order. A sitting is one output text, so its turns meet in one row."""
    rows = F.sort_array(F.collect_list(F.struct("speech_order", F.coalesce("speech_content", F.lit("")).alias("text"))))
    return turns.groupBy("sitting_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("content"))


def context(turns: DataFrame, k: int = 6) -> DataFrame:
    """The last k turns of each sitting as one prompt text: "role: text" lines in order."""
    rows = F.sort_array(F.collect_list(F.struct("speech_order", "speaker_name", "speech_content")))
    lines = F.transform(rows, lambda r: F.concat_ws(": ", r["speaker_name"], r["speech_content"]))
    return last_turns(turns, k).groupBy("sitting_id").agg(F.array_join(lines, "\n").alias("prompt"))
