"""Documents of days as a Spark data source, and record pages as a stream that survives restarts and failed pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from plenaria.functions.columns import TERMS
from plenaria.settings import settings
from plenaria.sources import sinks

DOCUMENT = "https://www.europarl.europa.eu/doceo/document/CRE-{term}-{day}_EN.html"


def term_of(day: str) -> int:
    return next((number for number, first in TERMS if day >= first), 1)


def load(url: str, tries: int, pause: float, timeout: float = 25) -> tuple[bytes | None, str | None]:
    """(body, None) or (None, why): tried again with pauses that double; "not found" isn't tried again."""
    why = None
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
                return reply.read(), None
        except urllib.error.HTTPError as e:
            why = f"HTTP {e.code}"
            if e.code == 404:
                break
        except OSError as e:
            why = f"{type(e).__name__}: {e}"
        time.sleep(pause * 2**attempt)
    return None, why


class Days(InputPartition):
    def __init__(self, days: list[str]):
        self.days = days


class DayReader(DataSourceReader):
    """Days from `first` to `last`, cut by pushed filters, in at most `tasks` partitions of `block` days or more: so many requests are open at once."""

    def __init__(self, options):
        self.template, self.first, self.last = options.get("template", DOCUMENT), options["first"], options["last"]
        self.block, self.tasks = int(options.get("block", 7)), int(options.get("tasks", 20))
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("activity_date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value)
                else:
                    wanted = set(f.value if isinstance(f, In) else [f.value])
                    self.only = wanted if self.only is None else self.only & wanted
            yield f  # what is left over is evaluated again

    def partitions(self):
        try:
            first, last = (date.fromisoformat(d[:10]) for d in (self.first, self.last))
        except ValueError:
            first, last = date(1900, 1, 2), date(1900, 1, 1)
        days = [str(first + timedelta(i)) for i in range((last - first).days + 1)]
        days = [d for d in days if self.only is None or d in self.only]
        size = max(self.block, -(-len(days) // self.tasks), 1)
        return [Days(days[i : i + size]) for i in range(0, len(days), size)] or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        for day in partition.days:
            url = self.template.format(term=term_of(day), day=day)
            body, why = load(url, self.tries, self.pause)
            yield day, url, None if body is None else body.decode("utf-8", "replace"), why


class DaySource(DataSource):
    """spark.read.format("day_documents").options(first=..., last=...).load(): (activity_date, url, html, failure); filters of activity_date decide which days are asked for."""

    @classmethod
    def name(cls) -> str:
        return "day_documents"

    def schema(self) -> str:
        return "activity_date string, url string, html string, failure string"

    def reader(self, schema):
        return DayReader(self.options)


def day_documents(spark: SparkSession, first: str, last: str, **options) -> DataFrame:
    """The documents of a range of days. Turns on the session's setting by which Python sources see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DaySource)
    return spark.read.format("day_documents").options(first=first, last=last, **({"tries": settings(spark).tries} | options)).load()


class Page(InputPartition):
    def __init__(self, url: str, offset: int, limit: int):
        self.url, self.offset, self.limit = url, offset, limit


def page_of(url: str, offset: int, limit: int, tries: int, pause: float) -> tuple[list[dict], str | None]:
    """The records of a page and None, or nothing and why it failed; what isn't there is empty."""
    body, why = load(f"{url}{'&' if '?' in url else '?'}limit={limit}&offset={offset}", tries, pause)
    if body is None:
        return [], None if why == "HTTP 404" else why
    try:
        data = json.loads(body)
        return (data if isinstance(data, list) else data.get("data", [])), None
    except ValueError as e:
        return [], f"not JSON: {e}"


class PageStream(DataSourceStreamReader):
    """Records behind the ones already read, for each address; pages of a batch are partitions.

    The offset is the number of records of each address. How many there are now is
    found by looking at single records at doubling places and halving the rest, so a
    batch costs the driver a few small requests. A page that fails comes out as
    one row that names it, with nothing else in it. Records are only ever added behind.
    """

    def __init__(self, schema, options):
        self.fields, self.urls = schema.names, [u for u in options.get("urls", "").split(",") if u]
        self.size, self.tries, self.pause = int(options.get("page_size", 500)), int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.urls, 0)

    def _has(self, url: str, at: int) -> bool:
        found, why = page_of(url, at, 1, self.tries, self.pause)
        if why:
            raise OSError(f"{url}: {why}")
        return bool(found)

    def latestOffset(self) -> dict:
        out = {}
        for url in self.urls:
            low, step = self.seen.get(url, 0), self.size
            try:
                while self._has(url, low + step - 1):
                    low, step = low + step, 2 * step
                high = low + step - 1
                while low < high:
                    middle = (low + high) // 2
                    low, high = (middle + 1, high) if self._has(url, middle) else (low, middle)
            except OSError:
                pass  # what is known to be there is read; the rest is looked for in the next batch
            out[url] = self.seen[url] = low
        return out

    def partitions(self, start: dict, end: dict):
        self.seen.update({u: max(n, self.seen.get(u, 0)) for u, n in end.items()})
        return [Page(u, at, min(self.size, end[u] - at)) for u in end for at in range(start.get(u, 0), end[u], self.size)] or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.limit:
            return
        found, why = page_of(partition.url, partition.offset, partition.limit, self.tries, self.pause)
        if why is None and len(found) < partition.limit:
            why = f"{len(found)} of {partition.limit} records"
        if why:
            yield tuple(json.dumps([partition.url, partition.offset, partition.limit, why]) if f == "failure" else None for f in self.fields)
            return
        for row in found:
            yield tuple(None if row.get(f) is None else str(row[f]) for f in self.fields)


class PageReader(DataSourceReader):
    """Exactly the pages of the option `pages`, a JSON list of [address, offset, limit]."""

    def __init__(self, schema, options):
        self.stream, self.pages = PageStream(schema, options), [Page(*p) for p in json.loads(options["pages"])]

    def partitions(self):
        return self.pages or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.stream.read(partition)


class PageSource(DataSource):
    """Format "record_pages": as a stream the records of `urls`, as a batch the `pages`. All columns are strings; `failure` names a page that failed."""

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return "identifier string, label string, failure string"

    def streamReader(self, schema):
        return PageStream(schema, self.options)

    def reader(self, schema):
        return PageReader(schema, self.options)


FAILED = "url string, offset long, limit long, why string"


def follow(spark: SparkSession, urls: list[str], schema: str, path: str, **options) -> dict[str, int]:
    """Bring the table `path`/records up to what the addresses have now: each record once, also after restarts; counts of records and of pages that are still missing.

    Pages that failed are rows of `path`/failed and asked for again in each run. Both
    tables take a batch once, by its number.
    """
    spark.dataSource.register(PageSource)
    own = settings(spark)
    options = {"page_size": own.page_size, "tries": own.tries} | options
    full = f"{schema}, failure string"
    stream = spark.readStream.format("record_pages").schema(full).options(urls=",".join(urls), **options).load()
    pages = F.from_json("failure", "array<string>")
    failed_of = lambda df: df.where("failure is not null").select(pages[0].alias("url"), pages[1].cast("long").alias("offset"), pages[2].cast("long").alias("limit"), pages[3].alias("why"))
    good_of = lambda df: df.where("failure is null").drop("failure")
    records, failed = f"{path}/records", f"{path}/failed"

    def put(batch: DataFrame, number: int) -> None:
        # Fetched once: both tables are written from the same rows.
        got = f"{path}/batch-{number}"
        if not sinks.exists(spark, got):
            sinks.write(batch, got)
        rows = sinks.read(spark, got)
        sinks.append(good_of(rows), records, once=("stream", number))
        sinks.append(failed_of(rows), failed, once=("stream", number))

    if sinks.exists(spark, failed):
        _again(spark, path, full, options, good_of, failed_of)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    count = lambda table: sinks.read(spark, table).count() if sinks.exists(spark, table) else 0
    return {"records": count(records), "failed": count(failed)}


def _again(spark: SparkSession, path: str, schema: str, options: dict, good_of, failed_of) -> None:
    """Ask for the failed pages again. The answer is stored under the number of the failures' commit first, so that a run that ends in between takes up that very answer."""
    state = sinks.state(spark, f"{path}/failed")
    wanted = [[r["url"], r["offset"], r["limit"]] for r in sinks.read(spark, f"{path}/failed").collect()]
    if not wanted:
        return
    got = f"{path}/again-{state.number}"
    if not sinks.exists(spark, got):
        reader = spark.read.format("record_pages").schema(schema).options(**options, pages=json.dumps(wanted))
        sinks.write(reader.load(), got)
    rows = sinks.read(spark, got)
    sinks.append(good_of(rows), f"{path}/records", once=("again", state.number))
    sinks.write(failed_of(rows), f"{path}/failed")
