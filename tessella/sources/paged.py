"""A paged API as a Spark source, for batches and streams: spark.read.format("paged").

Options: `url` with {offset}, {page} or {size} in it; `size`, the rows of a full page; `items`, the
field that holds a page's rows (default: the page is a list); `limit`, at most so many rows; `span`,
pages a partition; `get`, a function "package.module:name" that answers a url with status, headers
and body (default: urllib, which also opens file: urls; a file that is missing is an empty page).

A page that is short or empty ends the source. How many pages there are is found by asking for pages
1, 2, 4, ... and halving what is left, so a source of n pages costs the driver log n requests; each
partition is a range of offsets and asks for its own pages. A stream's offset is the number
of rows before it: a last page that grows is read on where it ended.

Columns: seq (the row's place, from 0), page, and value (the row as JSON), or with a schema of
one's own any of these and fields of the rows; other fields are left out where they are read.
Filters on seq choose pages before anything is asked for. Fields that are missing or of another
kind are null; nested ones are JSON where the column is a string.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from .remote import Get, get_with_backoff

DEFAULT = "seq long, page long, value string"


def open_url(url: str) -> tuple[int, dict[str, str], bytes]:
    """A url by urllib; a file that is not there is an empty page."""
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as answer:  # noqa: S310
            return getattr(answer, "status", None) or 200, dict(answer.headers), answer.read()
    except HTTPError as e:
        return e.code, dict(e.headers), b""
    except URLError as e:
        if url.startswith("file:") and isinstance(e.reason, FileNotFoundError | OSError):
            return 200, {}, b""
        raise


@dataclass(frozen=True)
class Api:
    url: str
    size: int
    items: str
    limit: int | None
    get: str

    @classmethod
    def of(cls, options: dict[str, str]) -> Api:
        if "url" not in options:
            raise ValueError("a paged source needs a url")
        size = int(options.get("size", 200))
        if size < 1:
            raise ValueError("size must be positive")
        return cls(options["url"], size, options.get("items", ""), int(options["limit"]) if "limit" in options else None, options.get("get", ""))

    def page(self, number: int) -> list:
        """The rows of a page; none behind the end or the limit."""
        first = number * self.size
        if self.limit is not None and first >= self.limit:
            return []
        get: Get = open_url
        if self.get:
            module, _, name = self.get.partition(":")
            get = getattr(importlib.import_module(module), name)
        body = get_with_backoff(get, self.url.replace("{offset}", str(first)).replace("{page}", str(number)).replace("{size}", str(self.size)))
        found = json.loads(body) if body.strip() else []
        if isinstance(found, dict):
            found = found.get(self.items) if self.items else None
        rows = (found or [])[: self.size]
        return rows if self.limit is None else rows[: self.limit - first]

    def rows(self, known: int = 0) -> int:
        """How many rows there are, `known` at least: a page is full, or it is the last one."""
        low = known // self.size  # every page before it is full
        step = 1
        sizes: dict[int, int] = {}

        def count(n: int) -> int:
            if n not in sizes:
                sizes[n] = len(self.page(n))
            return sizes[n]

        while count(low + step - 1) == self.size:
            low, step = low + step, step * 2
        high = low + step - 1  # this page is short or empty
        while low < high:
            middle = (low + high) // 2
            if count(middle) == self.size:
                low = middle + 1
            else:
                high = middle
        return max(known, low * self.size + count(low))


class Range(InputPartition):
    """Rows of these places."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def ranges(first: int, end: int, step: int) -> list[Range]:
    return [Range(max(first, at), min(end, at + step)) for at in range(first // step * step, end, step)]


def cell(value: object, kind: object) -> object:
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    try:
        if isinstance(kind, LongType | IntegerType):
            return None if isinstance(value, float) and not value.is_integer() else int(value)
        if isinstance(kind, DoubleType | FloatType):
            return float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    raise TypeError(f"a paged source has no columns of type {kind.simpleString()}")


def read(api: Api, schema: StructType, part: Range | None) -> Iterator[tuple]:
    if part is None:  # what Spark hands on where there is no partition
        return
    for number in range(part.first // api.size, math.ceil(part.end / api.size)):
        rows = api.page(number)
        for at, row in enumerate(rows, number * api.size):
            if part.first <= at < part.end:
                own = {"seq": at, "page": number, "value": json.dumps(row, ensure_ascii=False)}
                have = row if isinstance(row, dict) else {}
                yield tuple(cell(own.get(f.name, have.get(f.name)), f.dataType) for f in schema)
        if len(rows) < api.size:
            return


class Reader(DataSourceReader):
    def __init__(self, api: Api, schema: StructType, span: int):
        self.api, self.schema, self.span = api, schema, span
        self.first, self.end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of seq choose the pages; every filter is left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",) and isinstance(getattr(f, "value", None), int):
                low, high = None, None
                if isinstance(f, EqualTo):
                    low, high = f.value, f.value + 1
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = f.value + isinstance(f, GreaterThan)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = f.value + isinstance(f, LessThanOrEqual)
                if low is not None:
                    self.first = max(self.first, low)
                if high is not None:
                    self.end = high if self.end is None else min(self.end, high)
            yield f

    def partitions(self) -> list[Range]:
        if self.end is not None and self.end <= self.first:
            return []
        total = self.end if self.end is not None and self.end - self.first <= self.span * self.api.size else self.api.rows()
        end = total if self.end is None else min(total, self.end)
        return ranges(self.first, end, self.span * self.api.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return read(self.api, self.schema, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, api: Api, schema: StructType, span: int):
        self.api, self.schema, self.span, self.known = api, schema, span, 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.known = self.api.rows(self.known)
        return {"row": self.known}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = max(self.known, start["row"])
        return ranges(start["row"], end["row"], self.span * self.api.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return read(self.api, self.schema, partition)


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return DEFAULT

    def _span(self) -> int:
        return max(1, int(self.options.get("span", 10)))

    def reader(self, schema: StructType) -> Reader:
        return Reader(Api.of(dict(self.options)), schema, self._span())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(Api.of(dict(self.options)), schema, self._span())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
