"""Paged search services (issues, wiki pages, pull requests) as a source for batch and stream.

    paged.register(spark)
    spark.read.format("paged").option("url", "https://host/search").option("from", "2024-01-01").load()
    spark.readStream.format("paged").option("url", ...).option("overlap_seconds", 60).load()

Rows are (id, updated, body): body is the item as JSON, for ``from_json`` and the connectors. The service is asked for items in order of
their update, from ``since`` up to ``until``, ``size`` at a time; how it calls these is set by options. A task reads a few
pages and holds one of them. A page that fails is asked for again, alone, some times; a task that fails is repeated by Spark.
``from`` bounds the search; with ``push`` so does a lower bound on ``updated`` in a filter, which takes
``spark.sql.python.filterPushdown.enabled`` in the session. The stream's offset is the newest update that the service knows; each
batch begins ``overlap_seconds`` before the last one's end, since clocks differ and updates arrive late: what comes again is for the upsert to merge.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

#: What a service calls the parameters and the fields of an answer, and how it is asked; options override it.
DEFAULTS = {
    "start": "startAt", "size": "maxResults", "since": "since", "until": "until", "items": "items", "total": "total", "newest": "newest",
    "id": "id", "updated": "updated", "page_size": "100", "pages_per_task": "10", "attempts": "5", "pause_seconds": "1", "timeout_seconds": "60",
    "overlap_seconds": "60", "authorization": "",
}
BEGINNING = "1970-01-01T00:00:00.000Z"


def instant(value: dt.datetime | str) -> str:
    """An instant as services spell it, to the millisecond; without a zone it is taken as UTC."""
    own = dt.datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    own = own.replace(tzinfo=dt.timezone.utc) if own.tzinfo is None else own.astimezone(dt.timezone.utc)
    return own.strftime("%Y-%m-%dT%H:%M:%S.") + f"{own.microsecond // 1000:03d}Z"


def earlier(value: str, seconds: float) -> str:
    return max(BEGINNING, instant(dt.datetime.fromisoformat(value.replace("Z", "+00:00")) - dt.timedelta(seconds=seconds))) if value > BEGINNING else BEGINNING


@dataclass(frozen=True)
class Service:
    """A search service and the names it uses."""

    url: str
    names: dict[str, str]

    def ask(self, since: str, until: str, start: int, size: int) -> dict:
        """One answer; busy or failing services are asked again after a pause that doubles."""
        own = self.names
        query = urllib.parse.urlencode({own["since"]: since, own["until"]: until, own["start"]: start, own["size"]: size})
        request = urllib.request.Request(f"{self.url}?{query}", headers={"Authorization": own["authorization"]} if own["authorization"] else {})
        pause = float(own["pause_seconds"])
        for attempt in range(int(own["attempts"])):
            try:
                with urllib.request.urlopen(request, timeout=float(own["timeout_seconds"])) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as error:
                refused = isinstance(error, urllib.error.HTTPError) and error.code < 500 and error.code != 429
                if refused or attempt + 1 == int(own["attempts"]):
                    raise
                time.sleep(pause * 2**attempt)
        raise ValueError("attempts must be positive")

    def newest(self) -> str:
        return instant(self.ask(BEGINNING, "", 0, 1).get(self.names["newest"]) or BEGINNING)

    def partitions(self, since: str, until: str) -> list[Pages]:
        """Ranges of pages of what was updated from ``since`` up to ``until``; both are fixed, so repeated reads see the same order."""
        total = int(self.ask(since, until, 0, 1)[self.names["total"]])
        step = int(self.names["page_size"]) * int(self.names["pages_per_task"])
        return [Pages(since, until, at, min(at + step, total)) for at in range(0, total, step)]

    def rows(self, pages: Pages) -> Iterator[tuple]:
        at = pages.first
        while at < pages.last:
            found = self.ask(pages.since, pages.until, at, min(int(self.names["page_size"]), pages.last - at))[self.names["items"]]
            if not found:  # fewer than the service said
                return
            for item in found:
                yield str(item[self.names["id"]]), dt.datetime.fromisoformat(instant(item[self.names["updated"]]).replace("Z", "+00:00")), json.dumps(item)
            at += len(found)


@dataclass
class Pages(InputPartition):
    """Items [first, last) of a search."""

    since: str
    until: str
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, service: Service, since: str) -> None:
        self.service, self.since = service, since

    def partitions(self) -> list[Pages]:
        return self.service.partitions(self.since, self.service.newest())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.service.rows(partition)


class PushingReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A lower bound on ``updated`` narrows the search; Spark still applies every filter, so the bound may be a little low."""
        for own in filters:
            if isinstance(own, GreaterThan | GreaterThanOrEqual) and own.attribute == ("updated",):
                self.since = max(self.since, instant(own.value))
            yield own


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, service: Service) -> None:
        self.service = service

    def initialOffset(self) -> dict:
        return {"until": BEGINNING}

    def latestOffset(self) -> dict:
        return {"until": self.service.newest()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.service.partitions(earlier(start["until"], float(self.service.names["overlap_seconds"])), end["until"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.service.rows(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset; the service has nothing to forget."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, updated timestamp, body string"

    def _service(self) -> Service:
        return Service(self.options["url"], {k: self.options.get(k, v) for k, v in DEFAULTS.items()})

    def reader(self, schema: StructType) -> PagedReader:
        kind = PushingReader if self.options.get("push", "false").lower() == "true" else PagedReader
        return kind(self._service(), instant(self.options.get("from", BEGINNING)))

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(self._service())


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(PagedSource)
