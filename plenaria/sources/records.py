"""Paged record sources as a Spark data source, term merging, and tolerant JSON configuration."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plenaria.functions.columns import document_url, looks_like_page
from plenaria.schema import SITTINGS, SPEECHES, conform
from plenaria.settings import settings


class Pages(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PagedReader(DataSourceReader):
    """Pages of one address after the other until a short one; each address is a partition.

    A page is tried `tries` times with growing pauses; `most_failures` pages in a row that
    fail end the address, and "not found" is its end. A page that fails is skipped, but where
    the schema has a column `failure`, one row says which, so that its rows can be asked for again.
    """

    def __init__(self, schema, options):
        self.fields, self.urls = schema.names, [u for u in options.get("urls", "").split(",") if u]
        self.size, self.tries = int(options.get("page_size", 500)), int(options.get("tries", 3))
        self.most_failures, self.pause = int(options.get("most_failures", 5)), float(options.get("pause", 1.0))

    def partitions(self):
        return [Pages(u) for u in self.urls]

    def read(self, partition: Pages) -> Iterator[tuple]:
        offset = failures = 0
        while failures < self.most_failures:
            rows = self._page(f"{partition.url}{'&' if '?' in partition.url else '?'}limit={self.size}&offset={offset}")
            offset += self.size
            if rows is None:
                failures += 1
                if "failure" in self.fields:
                    yield tuple(f"{partition.url} offset {offset - self.size}" if f == "failure" else None for f in self.fields)
                continue
            failures = 0
            for row in rows:
                yield tuple(None if row.get(f) is None else str(row[f]) for f in self.fields)
            if len(rows) < self.size:
                return

    def _page(self, url: str) -> list[dict] | None:
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=25) as reply:  # noqa: S310
                    data = json.loads(reply.read())
                return data if isinstance(data, list) else data.get("data", [])
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return []
            except (OSError, ValueError):
                pass
            time.sleep(self.pause * 2**attempt)
        return None


class PagedSource(DataSource):
    """spark.read.format("paged_json").schema(...).option("urls", "a,b").load(); all columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "identifier string, label string"

    def reader(self, schema):
        return PagedReader(schema, self.options)


def paged(spark: SparkSession, urls: list[str], schema: str, **options) -> DataFrame:
    """The pages of addresses; page size and tries are the deployment's (settings.py) where no option says otherwise."""
    spark.dataSource.register(PagedSource)
    own = settings(spark)
    options = {"page_size": own.page_size, "tries": own.tries} | options
    return spark.read.format("paged_json").schema(schema).options(urls=",".join(urls), **options).load()


def taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name, ordinal) of a JSON array of strings (the deployment's taxonomy, if no other is named); empty where the file is missing or isn't one."""
    path = path or settings(spark).taxonomy
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string, ordinal int")
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "name")).select("name", "ordinal").where("name is not null")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, variants) of a JSON array or of {"rules": [...]}; malformed entries are left out."""
    kind = "array<struct<canonical:string,variants:array<string>>>"
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<rules:{kind}>")["rules"], F.from_json("value", kind))
    return text.select(F.inline(listed)).where("canonical is not null and size(variants) > 0")


def synonyms(spark: SparkSession, path: str) -> dict[str, str]:
    """Further names of groups from a JSON object; none where the file is missing or isn't one. It is as small as a list of groups."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    row = text.select(F.from_json("value", "map<string,string>").alias("m")).first()
    return {k: v for k, v in (row["m"] or {}).items() if v is not None} if row else {}


def get(url: str, timeout: float = 25) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return reply.read().decode("utf-8", "replace")


def payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sitting, speeches) of a JSON file about one sitting: {"date", "html", "speeches": [...]}, as the tables have them; what a speech lacks is null."""
    row = spark.read.schema(f"date string, html string, speeches array<struct<{', '.join(p.replace(' ', ':') for p in SPEECHES.split(', '))}>>").json(path, multiLine=True)
    key = F.concat(F.lit("sitting-"), "date")
    sitting = conform(row.select(key.alias("id"), F.col("date").alias("activity_date"), F.lit("PLENARY").alias("type"), F.col("html").alias("content")), SITTINGS)
    said = row.select(key.alias("key"), F.posexplode("speeches").alias("at", "x")).select("key", "at", "x.*")
    said = said.withColumns({"sitting_id": F.coalesce("sitting_id", "key"), "speech_order": F.coalesce("speech_order", F.col("at") + 1)}).drop("key", "at")
    return sitting, said.withColumn("id", F.coalesce("id", F.xxhash64("sitting_id", "speech_order")))


def fetched(rows: DataFrame, url: str = "url", tries: int = 3, pause: float = 1.0, load: Callable[[str], str] = get, tasks: int = 20) -> DataFrame:
    """`rows` with html, the document at each one's address, and failure, why there is none.

    An address is tried `tries` times with pauses that double; "not found" isn't tried again. Rows are
    dealt over `tasks` tasks by their address, so no more requests are open at once; nothing that is
    fetched goes through the driver.
    """

    def one(address: str | None) -> tuple[str | None, str | None]:
        why = "no address"
        for attempt in range(tries if address else 0):
            try:
                return load(address), None
            except urllib.error.HTTPError as e:
                why = f"HTTP {e.code}"
                if e.code == 404:
                    break
            except (OSError, ValueError) as e:
                why = f"{type(e).__name__}: {e}"
            time.sleep(pause * 2**attempt)
        return None, why

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 50):
                some = frame.iloc[at : at + 50]
                got = [one(u) for u in some[url]]
                yield some.assign(html=[h for h, _ in got], failure=[w for _, w in got])

    fields = [*rows.schema.fields, *StructType.fromDDL("html string, failure string").fields]
    return rows.repartition(tasks, url).mapInPandas(run, StructType(fields))


def newest_document(known: DataFrame, spark: SparkSession, newest: str, days_back: int = 365, block: int = 8, **options) -> DataFrame:
    """(activity_date, url, html): of the days that aren't known, the newest whose address gives a transcript.

    Days are fetched in blocks, newest first, the days of a block side by side: the first block has
    `block` days, each later one twice as many, and none is fetched behind the one with a transcript.
    """
    days = [r["activity_date"] for r in document_dates(known, spark, newest, days_back).collect()]
    at = 0
    while at < len(days):
        some = spark.createDataFrame([(d,) for d in days[at : at + block]], "activity_date string").withColumn("url", document_url("activity_date"))
        good = fetched(some, **options).where(looks_like_page("html")).drop("failure")
        found = good.orderBy(F.desc("activity_date")).limit(1).collect()
        if found:
            return spark.createDataFrame(found, good.schema)
        at, block = at + block, 2 * block
    return spark.createDataFrame([], "activity_date string, url string, html string")


def document_dates(known: DataFrame, spark: SparkSession, newest: str, days_back: int = 365) -> DataFrame:
    """Days before `newest`, newest first, that aren't known: the candidates of a search for the latest transcript."""
    days = F.sequence(F.date_sub(F.to_date(F.lit(newest)), days_back), F.to_date(F.lit(newest)))
    wanted = spark.range(1).select(F.explode(days).alias("day")).select(F.col("day").cast("string").alias("activity_date"))
    return wanted.join(known.select("activity_date"), "activity_date", "left_anti").orderBy(F.desc("activity_date"))
