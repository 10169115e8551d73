"""One ordered CSV file from many tasks: a data source writer whose parts are joined behind one mark and one header; and read again by many tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType
from pyspark.sql.window import Window

MARK = "﻿"


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


def _place(path: str):
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


class LinesWriter(DataSourceArrowWriter):
    """Each task writes its lines to a file of its own beside the target. The commit joins them in the order of tasks under a name that isn't the target's yet, and then renames; an abort leaves nothing."""

    def __init__(self, options, overwrite: bool):
        self.path, self.head, self.overwrite = options["path"], options.get("head", ""), overwrite
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        files, folder = _place(self.folder)
        files.create_dir(folder, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        return Part(task.partitionId(), name)

    def commit(self, messages) -> None:
        files, folder = _place(self.folder)
        target = _place(self.path)[1]
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/joined") as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                with files.open_input_stream(f"{folder}/{part.name}") as lines:
                    while data := lines.read(1 << 20):
                        out.write(data)
        if not self.overwrite and files.get_file_info(target).type != arrow_fs.FileType.NotFound:
            files.delete_dir(folder)
            raise FileExistsError(self.path)
        files.move(f"{folder}/joined", target)
        files.delete_dir(folder)

    def abort(self, messages) -> None:
        files, folder = _place(self.folder)
        if files.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            files.delete_dir(folder)


class Lines(DataSource):
    """df.write.format("ordered_lines").option("head", ...).save(path): one column of text as the lines of one file, in the frame's order."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool):
        return LinesWriter(self.options, overwrite)


def cell(c: str, kind) -> Column:
    """A value as the export has it: null is empty, whole doubles have no point, booleans are 1 and 0; quotes where it has a comma, a quote or a line's end."""
    value = F.col(f"`{c}`")
    if isinstance(kind, BooleanType):
        value = value.cast("int")
    text = value.cast("string")
    if isinstance(kind, (DoubleType, FloatType)):
        text = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(text)
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)


def write_one_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """`df`, in its order, as one CSV file with a byte order mark and a header. Lines are made by Spark in parallel; only joining them is one stream of bytes."""
    df.sparkSession.dataSource.register(Lines)
    names = [F.when(F.lit(c).rlike('[,"\n\r]'), F.lit('"' + c.replace('"', '""') + '"')).otherwise(F.lit(c)) for c in df.columns]
    head = df.sparkSession.range(1).select(F.concat_ws(",", *names)).first()[0]
    lines = df.select(F.concat_ws(",", *(cell(f.name, f.dataType) for f in df.schema)).alias("line"))
    lines.write.format("ordered_lines").mode("overwrite" if overwrite else "append").option("head", f"{MARK}{head}\n").save(path)


def read_one_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a CSV file with a header, read in blocks by many tasks although values may hold line ends.

    A line begins a record just if the quotes before it are even in number. They are counted by block first; in a
    block its lines are numbered in their order. Parts of a record that blocks cut, at most two a block, are put together last.
    """
    odd = lambda c: F.length(F.regexp_replace(c, '[^"]', "")) % 2
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), odd("value").alias("odd"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as the file has blocks.
    blocks = lines.groupBy("block").agg(F.sum("odd").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    so_far = Window.partitionBy("block").orderBy("nth")
    rows = lines.join(F.broadcast(blocks), "block").withColumn("until", (F.col("start") + F.sum("odd").over(so_far)) % 2)
    rows = rows.withColumn("begins", (F.col("until") + F.col("odd")) % 2 == 0).withColumn("record", F.sum(F.col("begins").cast("int")).over(so_far))
    whole = F.col("begins") & (F.col("until") == 0)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), "\n")
    several = rows.where(~whole).groupBy("block", "record").agg(text.alias("value"))
    cut = (F.col("record") == 0) | (odd("value") == 1)
    ends = several.where(cut).withColumn("nth", F.sum((F.col("record") > 0).cast("int")).over(Window.orderBy("block", "record")))
    place = F.sort_array(F.collect_list(F.struct("block", "record", "value")))
    joined = ends.groupBy("nth").agg(place.alias("of")).select(F.get("of", F.lit(0))["block"].alias("block"), F.get("of", F.lit(0))["record"].alias("record"), F.array_join(F.transform("of", lambda x: x["value"]), "\n").alias("value"))
    records = rows.where(whole).select("block", "record", "value").unionAll(several.where(~cut).select("block", "record", "value")).unionAll(joined)
    # The first record is the header.
    records = records.where(~((F.col("block") == 0) & (F.col("record") == 1)) & (F.col("value") != ""))
    return records.select(F.from_csv("value", schema, {"escape": '"', "multiLine": "true"}).alias("row")).select("row.*")
