"""The sweep of a paginated review service as a resumable source.

A title's filters are swept one after the other into one pool: page after page, until one is empty, the cursor is missing
or stands still, there are `max_pages`, or, after `min_pages`, the pool holds the quota of every bucket. Every page that was
fetched is kept in the cache with the cursor that led to it, before it is given on; a page counts as cached only under that
cursor. So a task that runs again, a later micro-batch and a new run go through the cached pages without a request, and
fetch on from the last cursor. A stream's offset is the number of pages of each title that have been given on.

Modes: live; replay, which ends a filter where the cache ends; strict, which raises there.
"""

from __future__ import annotations

import functools
import importlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tallyfield import config as C
from tallyfield.package import ship
from tallyfield.sources.entity_files import located, replace_file
from tallyfield.sources.paged import with_backoff

#: Partitions of a sweep at most, where the caller names no number.
SLICES = 256
SWEPT = "appid string, filter string, page int, cursor string, next_cursor string, payload string, cached boolean"


class LiveCall(Exception):
    """A replay asked for a page that isn't in the cache."""


class PageCache:
    def __init__(self, folder: str) -> None:
        self.files, self.root = located(folder.rstrip("/"))

    def _path(self, appid: str, filter_: str, page: int) -> str:
        return f"{self.root}/{quote(appid, safe='')}/{quote(filter_, safe='')}/{page:06d}.json"

    def get(self, appid: str, filter_: str, page: int, cursor: str) -> dict | None:
        """The page, if it was fetched with this very cursor; a file that can't be parsed is none."""
        path = self._path(appid, filter_, page)
        if self.files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            try:
                kept = json.loads(f.read())
            except ValueError:
                return None
        return kept["response"] if isinstance(kept, dict) and kept.get("cursor") == cursor else None

    def put(self, appid: str, filter_: str, page: int, cursor: str, response: dict) -> None:
        path = self._path(appid, filter_, page)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        replace_file(self.files, path, json.dumps({"cursor": cursor, "response": response}, sort_keys=True).encode())


def bucket_name(minutes: int | None) -> str:
    """The cohort of a review for the pool's counts; a missing time is none played."""
    return next((name for name, low, high in C.BUCKETS if (minutes or 0) >= low and (high is None or (minutes or 0) < high)), C.UNKNOWN)


def sweep_title(
    fetch: Callable[[str, str, str], dict], cache: PageCache, appid: str, filters: list[str], max_pages: int, min_pages: int = 0, quota: int | None = None, mode: str = "live"
) -> Iterator[tuple]:
    """Rows as in SWEPT. Reviews are told apart by recommendationid; one that several filters show counts once."""
    seen: set = set()
    counts: Counter = Counter()
    for filter_ in filters:
        cursor = "*"
        for page in range(max_pages):
            body = cache.get(appid, filter_, page, cursor)
            cached = body is not None
            if not cached:
                if mode == "replay":
                    break
                if mode == "strict":
                    raise LiveCall(f"page {page} of {appid}, {filter_}, isn't in the cache")
                body = with_backoff(lambda: fetch(appid, filter_, cursor))  # noqa: B023
                cache.put(appid, filter_, page, cursor, body)
            reviews, after = body.get("reviews") or [], body.get("cursor")
            yield appid, filter_, page, cursor, after, json.dumps(body, sort_keys=True), cached
            for r in reviews:
                id_ = r.get("recommendationid")
                if id_ is not None and id_ not in seen:
                    seen.add(id_)
                    counts[bucket_name((r.get("author") or {}).get("playtime_at_review"))] += 1
            met = quota is not None and all(counts[name] >= quota for name in C.BUCKET_NAMES)
            if not reviews or not after or after == cursor or page + 1 >= min_pages and met:
                break
            cursor = after


def served(root: str, appid: str, filter_: str, cursor: str) -> dict:
    """A transport that answers from files, as `read_entities` has them; a page that isn't there is empty."""
    files, folder = located(root)
    path = f"{folder}/{appid}-{filter_}-{'0' if cursor == '*' else cursor}.json"
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return {"reviews": [], "cursor": cursor}
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _transport(named: str) -> Callable[[str, str, str], dict]:
    """"module:function", or "module:function?first argument"."""
    called, _, argument = named.partition("?")
    module, _, function = called.partition(":")
    found = getattr(importlib.import_module(module), function)
    return functools.partial(found, argument) if argument else found


class Sweep(DataSource):
    """Options: appids and filters by commas, transport, cache (a folder), max_pages, min_pages, quota, mode, and for streams
    pages, the number of pages of each title that a micro-batch gives on; slices, the number of partitions at most."""

    @classmethod
    def name(cls) -> str:
        return "review_sweep"

    def schema(self) -> str:
        return SWEPT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Titles:
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def titles(self, first: int, last: int | None) -> list[InputPartition]:
        """Slices of the titles: a task for each title costs more than its pages, where there are many."""
        named = [appid for appid in self.options["appids"].split(",") if appid]
        n = min(int(self.options.get("slices", SLICES)), len(named))
        return [InputPartition((named[k::n], first, last)) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        appids, first, last = partition.value
        for appid in appids:
            yield from self._title(appid, first, last)

    def _title(self, appid: str, first: int, last: int | None) -> Iterator[tuple]:
        o = self.options
        limit, least, quota = int(o.get("max_pages", 20)), int(o.get("min_pages", 0)), o.get("quota")
        rows = sweep_title(_transport(o["transport"]), PageCache(o["cache"]), appid, o["filters"].split(","), limit, least, int(quota) if quota else None, o.get("mode", "live"))
        for k, row in enumerate(rows):
            if last is not None and k >= last:
                return
            if k >= first:
                yield row


class _Reader(_Titles, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.titles(0, None)


class _StreamReader(_Titles, DataSourceStreamReader):
    given = None

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        most = int(self.options.get("max_pages", 20)) * len(self.options["filters"].split(","))
        self.given = min((self.given or 0) + int(self.options.get("pages", most)), most)
        return {"pages": self.given}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.given = max(self.given or 0, end["pages"])
        return self.titles(start["pages"], end["pages"])

    def commit(self, end: dict) -> None:
        pass


def _options(appids: list[str], filters: list[str], transport: str, cache: str, **more: object) -> dict[str, str]:
    return {"appids": ",".join(appids), "filters": ",".join(filters), "transport": transport, "cache": cache} | {k: str(v) for k, v in more.items() if v is not None}


def read_sweep(spark: SparkSession, appids: list[str], filters: list[str], transport: str, cache: str, **more: object) -> DataFrame:
    """The pages of a sweep, whose titles are dealt to partitions. `more`: max_pages, min_pages, quota, mode, slices."""
    ship(spark)
    spark.dataSource.register(Sweep)
    return spark.read.format("review_sweep").options(**_options(appids, filters, transport, cache, **more)).load()


def stream_sweep(spark: SparkSession, appids: list[str], filters: list[str], transport: str, cache: str, **more: object) -> DataFrame:
    """The same as a stream; `more` may also hold pages."""
    ship(spark)
    spark.dataSource.register(Sweep)
    return spark.readStream.format("review_sweep").options(**_options(appids, filters, transport, cache, **more)).load()
