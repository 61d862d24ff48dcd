"""A paged search service as a Spark data source, and bounded requests.

Each page is a partition. Requests go through `get`, which waits and tries again; pages behind the end give no rows.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page, tries, longest wait in seconds, and the most bytes of a body.
PAGE, TRIES, LONGEST_WAIT, MOST_BYTES = 100, 6, 60.0, 40_000_000
FIELDS = "paperId string, title string, abstract string, year int, venue string, citationCount int"


def opened(url: str, timeout: float = 30.0) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and at most MOST_BYTES of the body behind an address; an error's status is a status."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return getattr(r, "status", None) or 200, dict(r.headers.items()), r.read(MOST_BYTES)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers.items()), b""


def get(url: str, ask: Callable = opened, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body behind an address, or None if it answers 400.

    After 429 and 5xx it waits, as long as the answer says or twice as long as before, and tries again, TRIES times in all; any
    other error is raised.
    """
    delay = 1.0
    for k in range(TRIES):
        status, headers, body = ask(url)
        if status < 300:
            return body
        if status == 400:
            return None
        if status != 429 and status < 500 or k == TRIES - 1:
            raise OSError(f"{url} answers {status}")
        said = {n.lower(): v for n, v in headers.items()}.get("retry-after", "")
        wait(min(LONGEST_WAIT, float(said) if said.replace(".", "", 1).isdigit() else delay))
        delay *= 2
    return None


def fetched(url: str, ask: Callable = opened) -> dict:
    """Status, type and bytes of a body as one record; it never raises (S3)."""
    started = time.perf_counter()
    try:
        status, headers, body = ask(url)
        kind = {n.lower(): v for n, v in headers.items()}.get("content-type", "").split(";")[0].strip()
        out = {"ok": True, "status": status, "content_type": kind, "error": None, "body": body}
    except Exception as e:
        out = {"ok": False, "status": None, "content_type": None, "error": f"{type(e).__name__}: {e}", "body": b""}
    return out | {"latency_ms": round((time.perf_counter() - started) * 1000, 1)}


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema.fields]
        self.address, self.pool = options["address"], int(options.get("pool", PAGE))
        self.years = [int(y) for y in options["years"].split("-")] if options.get("years") else None

    def partitions(self):
        return [Page(k) for k in range(0, self.pool, PAGE)]

    def read(self, partition):
        url = self.address.format(offset=partition.offset, limit=min(PAGE, self.pool - partition.offset), fields=",".join(self.names))
        body = get(url)
        for row in json.loads(body).get("data", []) if body else ():
            if not self.years or row.get("year") and self.years[0] <= row["year"] <= self.years[-1]:
                yield tuple(row.get(n) for n in self.names)


class PaperSearch(DataSource):
    """Format `paper_search` (S1): `address` with {offset}, {limit} and {fields}, `pool` (most rows), `years` (first-last)."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema):
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PaperSearch)
