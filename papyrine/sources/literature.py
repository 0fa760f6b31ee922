"""A Python data source over literature services: one partition for each batch of ids or page.

The transport is a parameter, so the reader is tested offline; retries with growing pauses happen inside
a partition, and a lost executor only repeats its partitions.
"""

from __future__ import annotations

import datetime as dt
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH, RETRIES, BACKOFF = 100, 4, 2.0
#: Seconds between requests without and with a key.
PAUSE, PAUSE_WITH_KEY = 0.34, 0.11


def http_get(url: str, timeout: float = 30.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8")


def patient(call: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The result of `call`, tried again after 1, 2, 4, ... seconds; None if it never succeeds."""
    for attempt in range(retries):
        try:
            return call()
        except (OSError, urllib.error.URLError):
            if attempt + 1 < retries:
                sleep(backoff**attempt)
    return None


class Batch(InputPartition):
    def __init__(self, number: int, url: str) -> None:
        super().__init__(number)
        self.number, self.url = number, url


class PayloadReader(DataSourceReader):
    """Rows (batch, payload), one for each address in option `urls` (one a line)."""

    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.pause = PAUSE_WITH_KEY if options.get("key") else PAUSE

    def partitions(self) -> list[Batch]:
        return [Batch(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        payload = patient(lambda: http_get(partition.url))
        time.sleep(self.pause)
        if payload is not None:  # a failed batch is skipped
            yield (partition.number, payload)


class LiteratureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return "batch int, payload string"

    def reader(self, schema: object) -> PayloadReader:
        return PayloadReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LiteratureSource)


def id_batches(ids: list[str], size: int = BATCH) -> list[list[str]]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def search_url(base: str, term: str, most: int = 20, key: str | None = None) -> str:
    """Address of an id search, by relevance."""
    fields = {"db": "pubmed", "term": term, "retmax": most, "sort": "relevance", "retmode": "json"} | ({"api_key": key} if key else {})
    return f"{base}?{urllib.parse.urlencode(fields)}"


def fetch_urls(base: str, ids: list[str], key: str | None = None) -> list[str]:
    """Addresses of record batches."""
    more = {"api_key": key} if key else {}
    return [f"{base}?{urllib.parse.urlencode({'db': 'pubmed', 'id': ','.join(b), 'retmode': 'xml'} | more)}" for b in id_batches(ids)]


def page_urls(base: str, server: str, start: dt.date, end: dt.date, most: int, total: int | None = None) -> list[str]:
    """Addresses of preprint pages until three times the wanted number of items is covered or the total is reached."""
    want = 3 * most if total is None else min(3 * most, total)
    return [f"{base}/{server}/{start:%Y-%m-%d}/{end:%Y-%m-%d}/{cursor}" for cursor in range(0, max(1, want), BATCH)]


def date_range(now: dt.datetime, days: int = 180) -> tuple[dt.date, dt.date]:
    return (now - dt.timedelta(days=days)).date(), now.date()


def fallback_url(base: str, query: str, most: int) -> str:
    """Address of the fallback search among preprints; pages of three times the wanted number, 25 to 100."""
    return f"{base}?{urllib.parse.urlencode({'query': f'SRC:PPR AND ({query})', 'pageSize': max(25, min(100, 3 * most)), 'format': 'json', 'resultType': 'core'})}"
