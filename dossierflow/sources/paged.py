"""Paged services (mail, invoices) as a Python data source: cursor or numbered paging, pushed filters, bad items as rows.

    spark.read.format("paged_service").option("root", uri).option("resources", "inbox,sent").load().where("at >= ...")

A partition is a resource, whose pages are asked for one after the other, as such services demand; where pages are
numbered and the first one tells the last, it is SPLIT_PAGES of them. Filters on `resource`
and `at` reach the reader: resources that are not asked for have no partition, and where a service lists its newest items
first (`order` is newest-first) the reader stops at the first page that is wholly older. A page that leads back to a page
already seen ends the resource with a row of problem `loop`; so does the bound on pages, with `page bound`. An item
that is no object or has no id is a row with a problem and its JSON, and the rest goes on.

`transport` names a class (module:Class) with `fetch(link) -> dict`, made with the options; the default reads pages that
`write_pages` or a crawler has stored. It may raise `TryLater`: the page is asked for again, `tries` times.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull

from dossierflow.session import settled
from dossierflow.sources.stores import opened, write_files

#: Pages of a resource, waits and tries unless options say otherwise.
MAX_PAGES, TRIES, LONGEST_WAIT = 1000, 3, 60.0
#: Numbered pages of a partition.
SPLIT_PAGES = 200
SCHEMA = "resource string, page int, item_id string, at timestamp, item string, problem string"
_ARROW = pa.schema([("resource", pa.string()), ("page", pa.int32()), ("item_id", pa.string()), ("at", pa.timestamp("us", tz="UTC")), ("item", pa.string()), ("problem", pa.string())])


class TryLater(Exception):
    """The service asks to wait so many seconds."""

    def __init__(self, seconds: float = 1.0):
        super().__init__(f"try again in {seconds} s")
        self.seconds = seconds


class StoredPages:
    """Pages stored as text files of one JSON object each: root/<link>/<one file>. `request_log` gets a file for each request."""

    def __init__(self, options: dict):
        self.store, self.root = opened(options["root"])
        self.log = options.get("request_log")

    def fetch(self, link: str) -> dict:
        if self.log:
            store, folder = opened(self.log)
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{uuid.uuid4().hex}-{link.replace('/', '_')}"):
                pass
        found = [i.path for i in self.store.get_file_info(fs.FileSelector(f"{self.root}/{link}")) if i.is_file and not i.base_name.startswith(("_", "."))]
        with self.store.open_input_stream(sorted(found)[0]) as f:
            return json.loads(f.read())


def _moment(value: object) -> datetime | None:
    try:
        found = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.resources = [r for r in self.options.get("resources", "").split(",") if r]
        self.since, self.after = _moment(self.options.get("since")), None
        #: Set where a filter of the plan asks for times: rows without one, problems among them, are not wanted then.
        self.timed = False

    # ------------------------------------------------------------ planning

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("at",) and isinstance(f, GreaterThanOrEqual | GreaterThan):
                strict, value = isinstance(f, GreaterThan), f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                held = self.after if strict else self.since
                held = value if held is None else max(held, value)
                self.after, self.since, self.timed = (held, self.since, True) if strict else (self.after, held, True)
            elif column == ("at",) and isinstance(f, IsNotNull):
                self.timed = True
            elif column == ("resource",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.resources = [r for r in self.resources if r in asked]
            elif column == ("resource",) and isinstance(f, IsNotNull):
                pass
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # Spark reads one empty partition where there is none.
        return [InputPartition((r, *part)) for r in self.resources for part in self._parts(r)] or [InputPartition(None)]

    def _parts(self, resource: str) -> list[tuple[int, int | None]]:
        """First page of each partition and the one behind its last; the last partition goes on to the end."""
        if self.options.get("paging") != "numbers" or (self.timed and self.options.get("order") == "newest-first"):
            return [(1, None)]
        last = self._fetch(self._transport(), f"resource={resource}/page=1").get("last_page")
        most = int(self.options.get("max_pages", MAX_PAGES))
        first = list(range(1, min(int(last), most) + 1, SPLIT_PAGES)) if last is not None else [1]
        return list(zip(first or [1], [*first[1:], None], strict=True))

    # ------------------------------------------------------------ reading

    def _old(self, at: datetime | None) -> bool:
        return at is not None and ((self.since is not None and at < self.since) or (self.after is not None and at <= self.after))

    def _fetch(self, transport, link: str) -> dict:
        tries = int(self.options.get("tries", TRIES))
        for k in range(tries):
            try:
                return transport.fetch(link)
            except TryLater as e:
                if k + 1 == tries:
                    raise
                time.sleep(min(max(e.seconds, 0.0), float(self.options.get("longest_wait", LONGEST_WAIT))))
        raise AssertionError

    def _transport(self):
        module, _, name = self.options.get("transport", f"{__name__}:StoredPages").partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def _pages(self, resource: str, first: int, behind: int | None) -> Iterator[tuple[int, list, str | None]]:
        """Page number, items, and what ended the resource if that was not its last page."""
        transport = self._transport()
        numbered = self.options.get("paging") == "numbers"
        field, size = self.options.get("field", "value"), int(self.options.get("per_page", 50))
        link, followed, ids = f"resource={resource}/page={first}", set(), set()
        for number in range(first, int(self.options.get("max_pages", MAX_PAGES)) + 1):
            page = self._fetch(transport, link)
            items = page.get(field) or []
            following = page.get("next")
            if numbered and page.get("last_page") is not None:
                current = int(page.get("current_page") or number)
                following = f"resource={resource}/page={current + 1}" if current < int(page["last_page"]) else None
            elif numbered:
                own = {i.get("id") for i in items if isinstance(i, dict)} - {None}
                following = f"resource={resource}/page={number + 1}" if len(items) >= size else None
                if following and own and own <= ids:
                    yield number, items, "loop"
                    return
                ids |= own
            if following is not None and following in followed:
                yield number, items, "loop"
                return
            # A part that begins later knows no links before it: a page that is not the one asked for leads back.
            if numbered and (first > 1 or behind) and int(page.get("current_page") or number) != number:
                yield number, items, "loop"
                return
            yield number, items, None
            if following is None or number + 1 == behind:
                return
            followed.add(following)
            link = following
        yield int(self.options.get("max_pages", MAX_PAGES)) + 1, [], "page bound"

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        field = self.options.get("time_field", "at")
        newest_first = self.options.get("order") == "newest-first"
        resource, first, behind = partition.value
        for number, items, ended in self._pages(resource, first, behind):
            rows, seen, old = [], 0, 0
            for item in items:
                if not isinstance(item, dict) or item.get("id") is None:
                    rows.append((None, None, json.dumps(item, sort_keys=True, ensure_ascii=False), "no id" if isinstance(item, dict) else "no object"))
                    continue
                at = _moment(item.get(field))
                seen += at is not None
                if self._old(at):
                    old += 1
                    continue
                rows.append((str(item["id"]), at, json.dumps(item, sort_keys=True, ensure_ascii=False), None))
            if ended:
                rows.append((None, None, None, ended))
            if self.timed:
                rows = [r for r in rows if r[1] is not None]
            if rows:
                ids, times, texts, problems = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([resource] * len(rows)), pa.array([number] * len(rows), pa.int32()), pa.array(ids, pa.string()), pa.array(times, _ARROW.field("at").type), pa.array(texts, pa.string()), pa.array(problems, pa.string())],
                    schema=_ARROW,
                )
            if newest_first and seen and old == seen:
                return


def read_pages(spark: SparkSession, root: str, resources: Iterable[str], **options: str) -> DataFrame:
    """The listing of a service's resources. Filters are pushed down, which Spark allows Python sources by a setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)
    reader = spark.read.format("paged_service").option("root", root).option("resources", ",".join(resources))
    return reader.options(**options).load()


def write_pages(items: DataFrame, root: str, per_page: int = 50, numbered: bool = False) -> None:
    """Stores (resource, at, item) as pages, newest first: what a crawler leaves and `read_pages` reads.

    Rows are dealt by ranges of (resource, time), and each task cuts its own rows into pages, so no resource meets in one
    task; only the list of pages, one short row each, is ordered by resource to find what follows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) == per_page):
                    yield page(held)
                    held = []
                held.append(row)
        if held:
            yield page(held)

    def page(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"resource": [rows[0][0]], "first": pa.array([rows[0][1]], pa.string()), "items": [f"[{','.join(r[2] for r in rows)}]"], "mark": [uuid.uuid4().hex]})

    ordered = items.select("resource", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("first"), "item")
    key = [F.col("resource"), F.col("first").desc_nulls_last(), F.col("item")]
    pages = settled(ordered.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(cut, "resource string, first string, items string, mark string"))
    by = Window.partitionBy("resource").orderBy(F.col("first").desc_nulls_last(), "mark")
    numbers = pages.select("resource", "mark", F.row_number().over(by).alias("page"), F.count("*").over(Window.partitionBy("resource")).alias("last"))
    following = F.concat(F.lit('"resource='), "resource", F.lit("/page="), (F.col("page") + 1).cast("string"), F.lit('"'))
    foot = F.concat(F.lit(',"current_page":'), F.col("page").cast("string"), F.lit(',"last_page":'), F.col("last").cast("string")) if numbered else F.concat(F.lit(',"next":'), F.when(F.col("page") < F.col("last"), following).otherwise("null"))
    text = F.concat(F.lit('{"value":'), "items", foot, F.lit("}"))
    place = F.concat(F.lit("resource="), "resource", F.lit("/page="), F.col("page").cast("string"), F.lit("/page.json"))
    write_files(pages.join(numbers, ["resource", "mark"]).select(place.alias("path"), F.encode(text, "UTF-8").alias("content")), root)
