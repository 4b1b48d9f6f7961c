"""Dumps of feeds and sitemaps as data sources of their own: ``feed_dump`` and ``sitemap``, in batch and as streams.

    register(spark)
    spark.read.format("feed_dump").load(folder).where("day >= DATE'2025-03-01' AND host = 'a.org'")
    spark.readStream.format("sitemap").load(folder)

A folder's files are the partitions (one file is one, as compressed files can't be cut); what day or month a file is of
says the first date in its name or in those of its folders below the given one. Filters on that column and on ``host`` are
pushed down: files of other days aren't opened, and items of other hosts go before they become rows.

A stream's offset is the change time and name of the newest file that was taken, so a batch has the files that came since,
each once; files have to be moved into the folder whole. Files may lie wherever Arrow's file systems reach (local folders,
HDFS, object stores) and may be compressed by gzip.

Lines of a dump that aren't well-formed are repaired; those without a link are left out. Elements of a sitemap that say no
address are left out, a sitemap that isn't well-formed is an error that names it. Times without a zone are in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from corpusloom.functions.dates import mail_time

DATE = re.compile(r"(?<!\d)((?:19|20)\d\d)[-/_.]?(0[1-9]|1[0-2])(?:[-/_.]?(0[1-9]|[12]\d|3[01]))?(?!\d)")
#: Rows of a batch that a task hands on.
BATCH = 5000


def date_of(name: str) -> date | None:
    """The first date that a name says; the first of a month if it says only that."""
    m = DATE.search(name)
    try:
        return date(int(m[1]), int(m[2]), int(m[3] or 1)) if m else None
    except ValueError:
        return None


def host_of(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


@dataclass(frozen=True)
class File(ds.InputPartition):
    path: str
    name: str
    changed: int

    @property
    def offset(self) -> tuple[int, str]:
        return self.changed, self.name


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/*", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def files(path: str) -> list[File]:
    """The files of a folder (or the one file), by name, without hidden ones."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
    named = [(x, x.path[len(root) :].lstrip("/") or x.base_name) for x in found]
    return sorted((File(x.path, n, x.mtime_ns or 0) for x, n in named if not re.search(r"(^|/)[._]", n)), key=lambda f: f.name)


def passes(f: ds.Filter, value: object) -> bool | None:
    """Whether a value fits a filter; None as in SQL."""
    if isinstance(f, ds.Not):
        inner = passes(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, ds.EqualTo):
        return value == f.value
    if isinstance(f, ds.In):
        return value in f.value or (None if None in f.value else False)
    return {ds.GreaterThan: lambda: value > f.value, ds.GreaterThanOrEqual: lambda: value >= f.value, ds.LessThan: lambda: value < f.value, ds.LessThanOrEqual: lambda: value <= f.value}[type(f)]()


KNOWN = (ds.Not, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


class _Source(ds.DataSource):
    """``KEY``: the column that a file's name decides; ``rows``: what a file says, as tuples of SCHEMA's columns."""

    SCHEMA, KEY = "", ""

    @classmethod
    def rows(cls, file: File, stream) -> Iterator[tuple]:
        raise NotImplementedError

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return Reader(type(self), self.options, schema)

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        return StreamReader(type(self), self.options, schema)


class _Reading:
    def __init__(self, source: type[_Source], options: dict, schema: StructType):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.source, self.path, self.columns, self.filters = source, options["path"], schema.names, []

    def fits(self, column: str, value: object) -> bool:
        return all(passes(f, value) for c, f in self.filters if c == column)

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where there are no files Spark reads one partition that is none
            return
        names = [x.split()[0] for x in self.source.SCHEMA.split(", ")]
        types = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
        kinds = [types[x.split()[1]] for x in self.source.SCHEMA.split(", ")]
        wanted = [names.index(c) for c in self.columns]
        host, held = names.index("host"), []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in wanted], names=[names[i] for i in wanted])

        system, _ = file_system(self.path)
        with system.open_input_stream(partition.path, compression="gzip" if partition.path.endswith(".gz") else None) as stream:
            for row in self.source.rows(partition, stream):
                if self.fits("host", row[host]):
                    held.append(row)
                if len(held) >= BATCH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class Reader(_Reading, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            inner = f.child if isinstance(f, ds.Not) else f
            if isinstance(inner, KNOWN) and not isinstance(inner, ds.Not) and inner.attribute in ((self.source.KEY,), ("host",)):
                self.filters.append((inner.attribute[0], f))
            else:
                yield f

    def partitions(self) -> Sequence[File]:
        return [f for f in files(self.path) if self.fits(self.source.KEY, date_of(f.name))]


class StreamReader(_Reading, ds.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": 0, "name": ""}

    def latestOffset(self) -> dict:
        changed, name = max((f.offset for f in files(self.path)), default=(0, ""))
        return {"changed": changed, "name": name}

    def partitions(self, start: dict, end: dict) -> Sequence[File]:
        return [f for f in files(self.path) if (start["changed"], start["name"]) < f.offset <= (end["changed"], end["name"])]


#: Elements of an item; any other < in a line that isn't well-formed is text.
ELEMENTS = "item|link|pubDate|domain|title|source|guid|description|category"


def item_of(line: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(line)
    except ElementTree.ParseError:
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", line)
        clean = re.sub(rf"<(?!/?(?:{ELEMENTS})\b)", "&lt;", re.sub(r"&(?!#?\w{1,10};)", "&amp;", clean))
    try:
        return ElementTree.fromstring(clean)
    except ElementTree.ParseError:
        return None


def lines_of(stream) -> Iterator[str]:
    rest = b""
    while block := stream.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        for x in lines:
            yield x.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


class FeedDump(_Source):
    """Items, one a line, of dumps of a day."""

    SCHEMA = "path string, day date, line bigint, link string, host string, pub_date timestamp, domain string, title string, source_url string, mc_source_id string"
    KEY = "day"

    @classmethod
    def name(cls) -> str:
        return "feed_dump"

    @classmethod
    def rows(cls, file: File, stream) -> Iterator[tuple]:
        day = date_of(file.name)
        for n, line in enumerate(lines_of(stream)):
            line = line.strip()
            if not line.startswith("<item>") or (item := item_of(line)) is None:
                continue
            said = {k: " ".join((item.findtext(k) or "").split()) if k != "title" else (item.findtext(k) or "").strip() for k in ("link", "pubDate", "domain", "title")}
            source = item.find("source")
            told = source.attrib if source is not None else {}
            if said["link"]:
                yield file.path, day, n, said["link"], host_of(said["link"]), mail_time(said["pubDate"]), said["domain"].lower(), said["title"], told.get("url"), told.get("mcSourceId")


def iso_time(text: str | None) -> datetime | None:
    try:
        t = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


class Sitemap(_Source):
    """Addresses of sitemaps (kind page) and of indexes (kind child)."""

    SCHEMA = "path string, month date, kind string, loc string, host string, lastmod timestamp, pub_date timestamp, title string"
    KEY = "month"

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    @classmethod
    def rows(cls, file: File, stream) -> Iterator[tuple]:
        day = date_of(file.name)
        month = day and day.replace(day=1)
        kinds, said = {"url": "page", "sitemap": "child"}, {}
        try:
            for event, e in ElementTree.iterparse(stream, ("start", "end")):
                tag = e.tag.rpartition("}")[2]
                if event == "start":
                    if tag in kinds:
                        said = {}
                    continue
                if tag not in kinds:
                    said.setdefault(tag, (e.text or "").strip())
                    continue
                if loc := said.get("loc"):
                    yield file.path, month, kinds[tag], loc, host_of(loc), iso_time(said.get("lastmod")), iso_time(said.get("publication_date")), said.get("title")
                e.clear()
        except ElementTree.ParseError as error:
            raise ValueError(f"{file.path}: {error}") from error


def register(spark: SparkSession) -> None:
    """Makes the two formats known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FeedDump, Sitemap):
        spark.dataSource.register(source)
