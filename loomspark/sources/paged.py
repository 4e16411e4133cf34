"""A paged, rate-limited search service as a data source, its query plan and its log.

One partition per (field, query); pages are read lazily until one is empty or short, a page fails for good, or the page
limit is reached. The transport is a class found by name, so that a file-backed stub stands in where there is no network.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def query_plan(spark: SparkSession, sets: Sequence[str], terms: Sequence[str], extra: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, q): every set combined with every term, the extra queries, each for every field. Constants only."""
    one = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    crossed = one("s", sets).crossJoin(one("t", terms)).select(F.concat_ws(" ", "s", "t").alias("q"))
    return one("field", fields).crossJoin(crossed.unionByName(one("q", extra)))


class HttpTransport:
    """GET of a template URL with {field}, {q}, {page} and {size}."""

    def __init__(self, options: dict[str, str]):
        self.template = options["url"]

    def page(self, field: str, q: str, page: int, size: int) -> str:
        quote = urllib.parse.quote
        with urllib.request.urlopen(self.template.format(field=quote(field), q=quote(q), page=page, size=size), timeout=60) as r:
            return r.read().decode("utf-8")


class FolderTransport:
    """Pages from a JSON file {"field|q": [page, …]}; a query that is absent has no pages. For tests and replays."""

    def __init__(self, options: dict[str, str]):
        with open(options["file"], encoding="utf-8") as f:
            self.pages = json.load(f)

    def page(self, field: str, q: str, page: int, size: int) -> str:
        own = self.pages.get(f"{field}|{q}", [])
        if page <= len(own) and own[page - 1] == "!error":
            raise OSError("page failed")
        return own[page - 1] if page <= len(own) else ""


def _transport(options: dict[str, str]):
    module, _, name = options.get("transport", "loomspark.sources.paged.HttpTransport").rpartition(".")
    return getattr(importlib.import_module(module), name)(options)


def _tried(call, retries: int, pause: float) -> tuple[str | None, str | None]:
    """(body, error) of a call that may fail: tried again after a pause that grows, up to `retries` times."""
    failed = "no attempt"
    for attempt in range(retries):
        try:
            return call(), None
        except OSError as e:
            failed = str(e)
            if attempt + 1 < retries:
                time.sleep(pause * (attempt + 1))
    return None, failed


class _Query(InputPartition):
    def __init__(self, field: str, q: str):
        super().__init__((field, q))
        self.field, self.q = field, q


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.queries = json.loads(options["queries"])
        self.size, self.max_pages, self.retries = int(options.get("size", 100)), int(options.get("maxPages", 20)), int(options.get("retries", 3))
        self.pause, self.record = float(options.get("pauseMs", 250)) / 1000, options.get("recordTag", "record")

    def partitions(self):
        return [_Query(f, q) for f, q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        transport = _transport(self.options)
        for page in range(1, self.max_pages + 1):
            body, failed = _tried(lambda: transport.page(partition.field, partition.q, page, self.size), self.retries, self.pause)  # noqa: B023
            if body is None:
                yield partition.field, partition.q, page, None, 0, failed
                return
            got = body.count(f"</{self.record}>")
            yield partition.field, partition.q, page, body, got, None
            if got < self.size:
                return
            time.sleep(self.pause)


class PagedSource(DataSource):
    """format('paged'): field, q, page, body, records, error."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "field string, q string, page int, body string, records int, error string"

    def reader(self, schema) -> _PagedReader:
        return _PagedReader(self.options)


def harvest(spark: SparkSession, queries: Sequence[tuple[str, str]], **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("queries", json.dumps([list(q) for q in queries]))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def fetch_details(ids: DataFrame, key: str, field: str = "detail", **options: str) -> DataFrame:
    """(key, body, error): one response for each id, tried again on failure; ids are spread over the tasks of the input.
    A null id is not asked for. A failed id has a null body and the last error."""
    retries, pause, settings = int(options.get("retries", 3)), float(options.get("pauseMs", 500)) / 1000, dict(options)
    kind = dict(ids.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = _transport(settings)
        for batch in batches:
            got = [_tried(lambda: transport.page(field, str(i), 1, 1), retries, pause) for i in batch["k"]]  # noqa: B023
            yield pd.DataFrame({"k": batch["k"], "body": [b for b, _ in got], "error": [e for _, e in got]})

    asked = ids.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    return asked.mapInPandas(run, f"k {kind}, body string, error string").withColumnRenamed("k", key)


def cached_first(ids: DataFrame, cache: DataFrame, key: str, body: str, fetched_at: str, now: Column, days: int = 30, **options: str) -> DataFrame:
    """(key, body, error, source) of every distinct id: from the cache where it holds a response within its lifetime (the
    youngest counts), else asked for; source is 'cache' or 'live'. Only what the cache lacks is asked for, once per id."""
    wanted = ids.where(F.col(key).isNotNull()).select(key).distinct()
    held = cache.where(F.col(fetched_at) > now - F.expr(f"INTERVAL {int(days)} DAYS")).groupBy(key).agg(F.max_by(body, fetched_at).alias("body"))
    hits = wanted.join(held, key).select(key, "body", F.lit(None).cast("string").alias("error"), F.lit("cache").alias("source"))
    missing = wanted.join(held.select(key), key, "left_anti")
    return hits.unionByName(fetch_details(missing, key, **options).withColumn("source", F.lit("live")))


def harvest_log(pages: DataFrame, records: DataFrame, known: DataFrame) -> DataFrame:
    """(field, q, pages, got, fresh): fresh counts ids that are not known and not seen by an earlier query."""
    base = pages.groupBy("field", "q").agg(F.count("*").alias("pages"), F.sum("records").alias("got"))
    first = records.groupBy("arti_id").agg(F.min(F.struct("field", "q")).alias("by")).join(known.select("arti_id"), "arti_id", "left_anti")
    fresh = first.groupBy("by.field", "by.q").agg(F.count("*").alias("fresh"))
    return base.join(fresh, ["field", "q"], "left").na.fill(0, ["fresh"])


def first_seen(records: DataFrame, key: str, order: str, tag: str) -> DataFrame:
    """(key, first, tags): where a record was seen first, and all distinct tags in order of appearance. Tags are folded
    per key and tag before they are gathered, so that a key seen over and over stays small."""
    per_tag = records.groupBy(key, tag).agg(F.min(order).alias("at"))
    return per_tag.groupBy(key).agg(F.min("at").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("at", tag))), lambda x: x.getField(tag)).alias("tags"))
