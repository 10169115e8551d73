"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination and packing, one stage after the other.

Each stage works on all rows that its predecessor kept. Nulls: a null text is clean, has no
lines, is one group with other texts without words, covers no benchmark item and packs as
one token; rows with a null doc_id stay rows of their own text's group. Repeated rows: one
row of each group of equal or near texts stays, that of the smallest doc_id (null: last).
Empty and very long texts are texts like others. Columns besides doc_id and text pass
through all stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.llm import decontaminate, line_dedup, packing, simhash_dedup, toxicity
from plenaria.llm.shared import shared_folder, table

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _whole_texts(spark: SparkSession) -> None:
    """Rows are whole texts here: where the session doesn't set how many go to Python at a time, 2,000 do instead of 10,000.

    The stages are lazy, so that stays set; a number of the session's own is left alone.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, "2000")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this input, scores under 0.5."""
    _whole_texts(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines of 50 words or more that an earlier one has; n_chars follows the text."""
    _whole_texts(spark)
    made = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (five words, similarity of 0.8 or more)."""
    _whole_texts(spark)
    return simhash_dedup.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of each benchmark item."""
    _whole_texts(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens, and their token ids."""
    _whole_texts(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", packed),
]
#: The classifier, the sketches and the tokenizer are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's output is a Parquet table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/plenaria/pipeline-{name}-{uuid.uuid4().hex}"
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
