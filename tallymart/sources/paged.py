"""Landed result pages of searches, by target and page, as a Spark data source for batch and stream.

A landing folder has ``round=<r>/target=<t>/start=<n>/<file>``: what a search
for target ``t`` returned in round ``r`` from its n-th result on, a JSON
document ``{"ads": [...], "count_all": n}``, newest ads first. Large rounds
have packs of pages: ``target=<t>/start=<n>/last=<m>/pages=<k>/<file>`` holds
the k pages from n to m, a line each, with its own ``start`` in the document.
A round counts once its folder holds ``_SUCCESS``, which Spark's writer leaves
there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime
from io import BufferedReader
from itertools import islice
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tallymart.session import ship_package

SCHEMA = "round string, target string, start int, place int, count_all long, url string, title string, price double, published timestamp, ad string"
_ARROW = pa.schema([("round", pa.string()), ("target", pa.string()), ("start", pa.int32()), ("place", pa.int32()), ("count_all", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("price", pa.float64()), ("published", pa.timestamp("us", "UTC")), ("ad", pa.string())])
_PAGE = re.compile(r"round=([^/]+)/target=([^/]+)/start=(\d+)(?:/last=(\d+)/pages=(\d+))?/[^/._][^/]*$")
_COMPARE = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
#: Columns that a page's path decides, and those that its ads do.
_OF_PATH, _OF_AD = ("round", "target", "start"), ("price", "published")


@dataclass(frozen=True)
class Page:
    """A file with one page or, where ``packed``, the pages from ``start`` to ``last``, of which the first ``count`` are wanted."""

    round: str
    target: str
    start: int
    path: str
    last: int
    count: int = 1
    packed: bool = False

    def may(self, name: str, kind: type, value: Any) -> bool:
        """Whether a page in the file can meet a test."""
        if name != "start":
            return _COMPARE[kind](getattr(self, name), value)
        if kind in (EqualTo, In):
            return any(self.start <= v <= self.last for v in (value if kind is In else (value,)) if v is not None)
        return _COMPARE[kind](self.last if kind in (GreaterThan, GreaterThanOrEqual) else self.start, value)


@dataclass
class Pages(InputPartition):
    """Pages of one target, in order."""

    pages: list[Page] = field(default_factory=list)


def _files(path: str) -> tuple[Any, str]:
    """The file system of a path and the path in it; a colon-less path is local."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def landed(path: str) -> list[Page]:
    """The pages of complete rounds by round, target and place."""
    from pyarrow import fs

    system, root = _files(path)
    found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File]
    whole = {m[1] for p in found if (m := re.search(r"round=([^/]+)/_SUCCESS$", p))}
    pages = [Page(unquote(m[1]), unquote(m[2]), int(m[3]), p, int(m[4] or m[3]), int(m[5] or 1), m[5] is not None) for p in found if (m := _PAGE.search(p)) and m[1] in whole]
    return sorted(pages, key=lambda p: (p.round, p.target, p.start))


def price_of(ad: dict) -> float | None:
    """Digits before the decimal comma of the price in an ad's feature list."""
    for feature in ad.get("features") or ():
        if feature.get("uri") == "/price":
            first = (feature.get("values") or [{}])[0]
            digits = re.sub(r"\D", "", str(first.get("value") or first.get("key") or "").split(",")[0])
            return float(digits) if digits else None
    return None


def _published(ad: dict) -> datetime | None:
    try:
        return datetime.fromisoformat(f"{ad.get('date')}+00:00")
    except ValueError:
        return None


def _opened(system: Any, pages: Iterable[Page]) -> Iterator[tuple[Page, int, dict]]:
    """The pages of the files with their starts; of a pack no more is read than is asked for."""
    for page in pages:
        with system.open_input_stream(page.path) as stream:
            if not page.packed:
                yield page, page.start, json.loads(stream.read())
                continue
            for line in islice(BufferedReader(stream), page.count):
                payload = json.loads(line)
                yield page, payload["start"], payload


def _rows(root: str, pages: Iterable[Page], of_path: list[tuple[str, Any, Any]], tests: list[tuple[str, Any, Any]], quota: int | None, low: float | None, high: float | None) -> Iterator[pa.RecordBatch]:
    """A batch for each page; a page without ads, or the number of all results, ends a target."""
    system, _ = _files(root)
    starts = [(test, v) for name, test, v in of_path if name == "start"]
    admitted = 0
    for page, start, payload in _opened(system, pages):
        ads, total = payload.get("ads") or [], payload.get("count_all")
        if not ads or total and start >= total:
            return
        if not all(test(start, v) for test, v in starts):
            continue
        rows = []
        for place, ad in enumerate(ads):
            url, title, values = (ad.get("urls") or {}).get("default"), ad.get("subject"), {"price": price_of(ad), "published": _published(ad)}
            if not url or not title or any(values[c] is None or not test(values[c], v) for c, test, v in tests):
                continue
            price = values["price"]
            if low is not None or high is not None:
                if price is None or low is not None and price < low or high is not None and price > high:
                    continue
            if quota is not None and admitted >= quota:
                break
            admitted += 1
            rows.append((page.round, page.target, start, place, total, url, title.strip(), price, values["published"], json.dumps(ad, ensure_ascii=False)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        if quota is not None and admitted >= quota:
            return


@dataclass
class _Options:
    path: str
    quota: int | None
    max_pages: int | None
    pages_per_task: int
    low: float | None
    high: float | None

    def parts(self, pages: list[Page], of_path: list[tuple[str, Any, Any]] = ()) -> list[Pages]:
        """A partition for each target and range of pages, or pack; a quota needs a target's pages one after the other."""
        by_target: dict[tuple[str, str], list[Page]] = {}
        for page in pages:
            by_target.setdefault((page.round, page.target), []).append(page)
        out = []
        for own in by_target.values():
            part, held, left = [], 0, self.max_pages
            for page in own:
                if left is not None:
                    page = replace(page, count=min(page.count, left))
                    left -= page.count
                if not page.count or not all(page.may(*test) for test in of_path):
                    continue
                if part and self.quota is None and held + page.count > max(self.pages_per_task, 1):
                    out.append(Pages(pages=part))
                    part, held = [], 0
                part.append(page)
                held += page.count
            if part:
                out.append(Pages(pages=part))
        return out


class PagedReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options, self.of_path, self.of_ad = options, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on round, target and start leave pages unread, those on price and date leave ads out.

        With a quota nothing is pushed: what is admitted must not depend on
        what is asked of it afterwards.
        """
        for f in filters:
            name, value = f.attribute[0] if hasattr(f, "attribute") else "", getattr(f, "value", None)
            kept = self.options.quota is None and type(f) in _COMPARE and value is not None
            if kept and name in _OF_PATH:
                self.of_path.append((name, type(f), value))
            elif kept and name in _OF_AD:
                self.of_ad.append((name, type(f), value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return self.options.parts(landed(self.options.path), self.of_path) or [Pages()]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        o = self.options
        of_path, of_ad = ([(name, _COMPARE[kind], value) for name, kind, value in tests] for tests in (self.of_path, self.of_ad))
        yield from _rows(o.path, partition.pages, of_path, of_ad, o.quota, o.low, o.high)


class PagedStream(DataSourceStreamReader):
    """Rounds as they become complete, in their order; an offset is the last round taken."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"round": ""}

    def latestOffset(self) -> dict:
        pages = landed(self.options.path)
        return {"round": pages[-1].round if pages else ""}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.options.parts([p for p in landed(self.options.path) if start["round"] < p.round <= end["round"]]) or [Pages()]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        o = self.options
        yield from _rows(o.path, partition.pages, [], [], o.quota, o.low, o.high)


class PagedAds(DataSource):
    """``format("paged_ads")``; options: path; quota (ads a target and round), minPrice and maxPrice (what a quota admits), maxPages, pagesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "paged_ads"

    def schema(self) -> str:
        return SCHEMA

    def _read_options(self) -> _Options:
        number = lambda name, kind: kind(self.options[name]) if self.options.get(name) else None
        return _Options(self.options["path"], number("quota", int), number("maxPages", int), number("pagesPerTask", int) or 20, number("minPrice", float), number("maxPrice", float))

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self._read_options())

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self._read_options())


def register(spark: SparkSession) -> None:
    """Make ``paged_ads`` known to a session, let filters reach it, and send the package to the executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedAds)


def scan(spark: SparkSession, path: str, stream: bool = False, quota: int | None = None, max_pages: int | None = None, pages_per_task: int = 20, min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """One row an ad with a url and a title: see ``SCHEMA``.

    Without a quota all pages are read (the first ``max_pages`` of a target: a
    deep backfill). With one, at most so many ads within the price bounds are
    admitted for each target and round, from its first page on. Ads without a
    price meet no bound.
    """
    register(spark)
    wanted = {"path": path, "quota": quota, "maxPages": max_pages, "pagesPerTask": pages_per_task, "minPrice": min_price, "maxPrice": max_price}
    options = {k: str(v) for k, v in wanted.items() if v is not None}
    return (spark.readStream if stream else spark.read).format("paged_ads").options(**options).load()
