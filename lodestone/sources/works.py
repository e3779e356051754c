"""A catalogue of works as a Spark data source: pages planned as partitions, dates pushed into the request, one rate for all tasks.

    spark.dataSource.register(WorksSource)
    spark.read.format("works").option("path", base).option("search", "graphs").load().filter("published >= '2020-01-01'")

Options: path (address), search, page_size (200), partitions (4), rate (requests a second with one credential; none: as fast as
answers come), keys (names of environment variables that hold credentials, by commas), key_param (api_key), retries, seconds, wait.
Filter push-down needs spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from math import ceil
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lodestone.sources.remote import Http

SCHEMA = "paper_id string, title string, published date, year int, citation_count int, doi string, value string"
DAY = timedelta(days=1)


@dataclass
class Pages(InputPartition):
    """Pages first to last (open: and on until a page is short), asked every `interval` seconds from `delay` on."""

    first: int
    last: int
    open: bool
    key: str | None
    interval: float
    delay: float


class WorksSource(DataSource):
    """Rows of a catalogue, with the whole record as JSON in `value` (papers.from_works takes it)."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorksReader:
        return WorksReader(self.options)


class WorksReader(DataSourceReader):
    def __init__(self, options) -> None:
        get = lambda name, default: options.get(name, default)
        self.base, self.search = options["path"], get("search", None)
        self.page_size, self.most = int(get("page_size", "200")), int(get("partitions", "4"))
        self.rate = float(get("rate", "0"))
        self.keys = [k.strip() for k in get("keys", "").split(",") if k.strip()] or [None]
        self.key_param = get("key_param", "api_key")
        self.retries, self.seconds, self.wait = int(get("retries", "2")), float(get("seconds", "20")), float(get("wait", "1"))
        self.dates: dict[str, date] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - name of the interface
        """Bounds of `published` go into the request. All filters stay with Spark, which checks them again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("published",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                    self._bound("from", f.value + DAY if isinstance(f, GreaterThan) else f.value, max)
                if isinstance(f, LessThanOrEqual | LessThan | EqualTo):
                    self._bound("to", f.value - DAY if isinstance(f, LessThan) else f.value, min)
            yield f

    def _bound(self, side: str, day: date, tighter) -> None:
        self.dates[side] = tighter(self.dates.get(side, day), day)

    def _http(self, interval: float = 0.0) -> Http:
        return Http(seconds=self.seconds, retries=self.retries, interval=interval, wait=self.wait)

    def _address(self, page: int, size: int, key: str | None) -> str:
        dates = ",".join(f"{side}_publication_date:{day.isoformat()}" for side, day in sorted(self.dates.items()))
        asked = {"search": self.search, "filter": dates or None, "page": page, "per-page": size, self.key_param: os.environ.get(key) if key else None}
        return f"{self.base}?{urlencode({k: v for k, v in asked.items() if v is not None})}"

    def partitions(self) -> list[InputPartition]:
        """One request tells how many works there are. Partitions of one credential share its rate: each asks as many times slower
        as there are of them, one after the other at the start, so all of them together never exceed it."""
        answer = json.loads(self._http().get(self._address(1, 1, self.keys[0])))
        pages = max(1, ceil(int(answer.get("meta", {}).get("count") or 0) / self.page_size))
        parts = max(1, min(self.most, pages))
        ends = [pages * k // parts for k in range(parts + 1)]
        sharing = [len(range(k, parts, len(self.keys))) for k in range(len(self.keys))]
        made = []
        for k in range(parts):
            own, place = k % len(self.keys), k // len(self.keys)
            step = 1 / self.rate if self.rate else 0.0
            made.append(Pages(ends[k] + 1, ends[k + 1], k == parts - 1, self.keys[own], step * sharing[own], step * (place + 1)))
        return made

    def read(self, partition: Pages) -> Iterator[tuple]:
        http, page = self._http(partition.interval), partition.first
        time.sleep(partition.delay)
        while page <= partition.last or partition.open:
            found = json.loads(http.get(self._address(page, self.page_size, partition.key))).get("results") or []
            for work in found:
                yield _row(work)
            if page >= partition.last and len(found) < self.page_size:
                return
            page += 1


def _row(work: dict) -> tuple:
    day = work.get("publication_date")
    try:
        day = date.fromisoformat(day) if day else None
    except ValueError:
        day = None
    return (work.get("id"), work.get("display_name"), day, work.get("publication_year"), work.get("cited_by_count"), work.get("doi"), json.dumps(work, ensure_ascii=False))
