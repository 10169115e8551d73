"""Streaming refresh: daily counts from a folder of fact files, and replacement of changed sittings.

The daily counts' state is as large as days times topics. A batch gives the counts that
it has changed, which take the place of the older ones in a stored table: only the months
they lie in are rewritten, and a batch that is repeated after a failure writes the same
again. In append mode (`daily` with a file sink) a day comes out once it is
over by `late`; what comes later than that is left to the batch refresh.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.sources import sinks

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def daily(stream: DataFrame, time: str = "ts", topic: str = "event_type", value: str = "value", late: str | None = "2 days") -> DataFrame:
    """(day, topic, n, total) of a stream, by event time; `late` None: nothing is ever too late."""
    timed = stream.withColumn("at", F.col(time).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("at", late)
    counted = timed.groupBy(F.window("at", "1 day"), F.col(topic).alias("topic")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "topic", "n", "total")


def run_daily(spark: SparkSession, folder: str, files: str, out: str, schema: str = EVENTS) -> DataFrame:
    """All files there are, as one run: the state goes on from the last one. The counts so far."""
    source = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 16).parquet(folder)
    key = F.concat_ws("|", "day", F.coalesce("topic", F.lit("\0")))

    def put(batch: DataFrame, number: int) -> None:
        sinks.upsert(batch.withColumn("key", key), out, "key", by_key=True)

    query = daily(source, late=None).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sinks.read(spark, out).drop("key")


def refresh_sittings(stream: DataFrame, table: str, state: str):
    """Replace the speeches of each sitting that a stream brings (all of them, each time it changes); a batch rewrites the buckets of its sittings."""

    def put(batch: DataFrame, number: int) -> None:
        sinks.replace_sittings(batch, table, by_key=True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="plenaria-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plenaria/{label}-{uuid.uuid4().hex}"
