"""Documents of days over HTTP: parallel, pushed filters, an early end; record pages as a stream with restarts and failures."""

from __future__ import annotations

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from plenaria.sources import documents, records, sinks

PAGE = "<html><body>" + "x" * 600 + "</body></html>"


class Site(BaseHTTPRequestHandler):
    asked: list = []
    open_now = most_open = 0
    totals: dict = {}
    broken: set = set()
    lock = threading.Lock()

    def do_GET(self):
        url = urlparse(self.path)
        with Site.lock:
            Site.asked.append(self.path)
            Site.open_now += 1
            Site.most_open = max(Site.most_open, Site.open_now)
        try:
            self.answer(url, {k: int(v[0]) for k, v in parse_qs(url.query).items()})
        finally:
            with Site.lock:
                Site.open_now -= 1

    def answer(self, url, query):
        if url.path.startswith("/doc-"):
            time.sleep(0.02)
            day = re.search(r"\d{4}-\d\d-\d\d", url.path).group()
            return self.send(200, PAGE) if day in Site.totals else self.send(404, "")
        total = Site.totals.get(url.path)
        if total is None or (url.path, query["offset"], query["limit"]) in Site.broken:
            return self.send(404 if total is None else 500, "")
        found = [{"identifier": f"{url.path[1:]}{i}", "label": f"L{i}"} for i in range(query["offset"], min(total, query["offset"] + query["limit"]))]
        self.send(200, json.dumps({"data": found}))

    def send(self, code, text):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    Site.asked, Site.totals, Site.broken, Site.most_open = [], {}, set(), 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def days(paths):
    return sorted({re.search(r"\d{4}-\d\d-\d\d", p).group() for p in paths if p.startswith("/doc-")})


def test_days_are_asked_for_in_parallel_and_by_filters(spark, site):
    Site.totals = {"2020-01-03": 1, "2020-03-01": 1}
    source = documents.day_documents(spark, "2020-01-01", "2020-04-09", template=site + "/doc-{term}-{day}.html", pause=0.0, tries=1, tasks=6)
    assert source.rdd.getNumPartitions() == 6
    got = source.where("html is not null").select("activity_date", "url", "failure").orderBy("activity_date").collect()
    assert [tuple(r) for r in got] == [(d, f"{site}/doc-9-{d}.html", None) for d in ("2020-01-03", "2020-03-01")]
    assert len(days(Site.asked)) == 100 and 1 < Site.most_open <= 6
    Site.asked = []
    few = source.where("activity_date >= '2020-02-27' and activity_date < '2020-03-03'")
    assert few.count() == 5 and {r["failure"] for r in few.collect()} == {None, "HTTP 404"}
    assert days(Site.asked) == ["2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01", "2020-03-02", "2020-03-03"]
    Site.asked = []
    assert source.where(F.col("activity_date").isin("2020-01-03", "2020-01-09", "1999-01-01")).count() == 2 and days(Site.asked) == ["2020-01-03", "2020-01-09"]
    assert source.where("activity_date > '2021-01-01'").count() == 0
    assert [documents.term_of(d) for d in ("2024-07-16", "2019-07-01", "1970-01-01")] == [10, 8, 1]


def test_the_search_ends_at_the_first_hit(spark, site):
    """Of 365 days only two blocks are fetched, in several tasks."""
    known = spark.createDataFrame([("2020-12-30",)], "activity_date string")
    folder, asked = site, spark.sparkContext.accumulator(0)

    def load(url):
        asked.add(1)
        day = re.search(r"\d{4}-\d\d-\d\d", url).group()
        return records.get(f"{folder}/doc-9-{day}.html")

    Site.totals = {"2020-12-30": 1, "2020-12-16": 1, "2020-12-15": 1, "2020-05-01": 1}
    (row,) = records.newest_document(known, spark, "2020-12-31", load=load, pause=0.0, tries=1).collect()
    assert row["activity_date"] == "2020-12-16" and asked.value == 24 and "2020-12-30" not in days(Site.asked) and Site.most_open > 1
    assert records.newest_document(known, spark, "1990-01-10", 5, load=load, pause=0.0, tries=1).collect() == []
    rows = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url")).coalesce(1)
    tasks = records.fetched(rows, load=str, tasks=7).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 7


def test_records_are_read_once_over_restarts(spark, site, tmp_path):
    urls, kind = [f"{site}/a", f"{site}/b?x=1", f"{site}/none"], "identifier string, label string"
    go = lambda: documents.follow(spark, urls, kind, str(tmp_path), page_size=10, tries=1, pause=0.0)
    held = lambda: sorted(r["identifier"] for r in sinks.read(spark, f"{tmp_path}/records").collect())
    Site.totals = {"/a": 25, "/b": 0}
    assert go() == {"records": 25, "failed": 0} == go()
    Site.totals = {"/a": 43, "/b": 7}
    assert go() == {"records": 50, "failed": 0}
    assert held() == sorted([f"a{i}" for i in range(43)] + [f"b{i}" for i in range(7)])
    pages = [p for p in Site.asked if "limit=1&" not in p]
    assert len(pages) == len(set(pages))


def test_failed_pages_are_kept_and_asked_for_again(spark, site, tmp_path):
    Site.totals, Site.broken = {"/a": 35}, {("/a", 10, 10), ("/a", 30, 5)}
    go = lambda: documents.follow(spark, [f"{site}/a"], "identifier string, label string", str(tmp_path), page_size=10, tries=2, pause=0.0)
    assert go() == {"records": 20, "failed": 2}
    assert sorted((r["offset"], r["limit"], r["why"]) for r in sinks.read(spark, f"{tmp_path}/failed").collect()) == [(10, 10, "HTTP 500"), (30, 5, "HTTP 500")]
    Site.totals, Site.broken = {"/a": 38}, {("/a", 10, 10)}
    assert go() == {"records": 28, "failed": 1}
    Site.broken = set()
    assert go() == {"records": 38, "failed": 0} == go()
    assert sorted(int(r["identifier"][1:]) for r in sinks.read(spark, f"{tmp_path}/records").collect()) == list(range(38))


def test_settings_decide_what_no_option_does(spark, site):
    Site.totals = {"/a": 25}
    spark.conf.set("spark.plenaria.page_size", "5")
    try:
        assert records.paged(spark, [f"{site}/a"], "identifier string", pause=0.0).count() == 25
        assert {p.split("limit=")[1].split("&")[0] for p in Site.asked} == {"5"}
        Site.asked = []
        assert records.paged(spark, [f"{site}/a"], "identifier string", pause=0.0, page_size=20).count() == 25 and len(Site.asked) == 2
    finally:
        spark.conf.unset("spark.plenaria.page_size")
