"""Places and numbers that a deployment may set: by the session's configuration first, then by the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX = "spark.plenaria."


@dataclass(frozen=True)
class Settings:
    """Folder of the tables and of the mart, file of the taxonomy, titles of a batch of the classifier, rows of a page of a source, tries of a fetch."""

    tables: str = "tables"
    mart: str = "tables/mart"
    taxonomy: str = "taxonomy.json"
    topic_batch: int = 20
    page_size: int = 500
    tries: int = 3


def settings(spark: SparkSession) -> Settings:
    """Each setting from `spark.plenaria.<name>`, else from `PLENARIA_<NAME>`, else its default; a number that isn't one is an error."""
    found = {}
    for name, default in vars(Settings()).items():
        value = spark.conf.get(PREFIX + name, None) or os.environ.get(f"PLENARIA_{name.upper()}")
        if value:
            found[name] = type(default)(value)
    return Settings(**found)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Whole texts go to Python in batches of so many bytes, where the session doesn't set how many: the rows of a batch say nothing about its size.

    What runs Python is lazy, so that stays set; a number of the session's own is left alone.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)
