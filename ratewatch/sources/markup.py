"""Entries of feeds and rows of tables, from files that Spark reads: event parsers that go through a file once.

Files come as bytes through Spark, so they may be in any store; each gives rows, an error row, or both (what stands before
a break is kept).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree.ElementTree import Element, ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that hold an entry, and its parts in RSS 2.0, RSS 1.0 (RDF) and Atom, the first that is there.
ENTRIES = ("item", "entry")
SUMMARY, WHEN = ("description", "summary", "content"), ("pubDate", "date", "published", "updated")
_CHUNK = 1 << 16
_entity = re.compile(rb"<!\[CDATA\[.*?\]\]>|&([A-Za-z][A-Za-z0-9]*);", re.DOTALL)
_KEPT = {b"amp", b"lt", b"gt", b"quot", b"apos"}


def _numbered(match: re.Match) -> bytes:
    """HTML's names of characters as numbers, which XML knows too."""
    name = match[1]
    if name is None or name in _KEPT or (known := html5.get(name.decode() + ";")) is None:
        return match[0]
    return b"".join(b"&#%d;" % ord(c) for c in known)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _part(entry: Element, names: tuple[str, ...]) -> str | None:
    for name in names:
        for child in entry:
            if _name(child.tag) == name:
                return "".join(child.itertext()).strip()
    return None


def _link(entry: Element) -> str | None:
    """The text of a link, or where it points to; of several, the one that is the entry's page."""
    links = [c for c in entry if _name(c.tag) == "link"]
    pages = [c for c in links if c.get("rel", "alternate") == "alternate"] or links
    return next((x for x in ((c.get("href") or "".join(c.itertext())).strip() for c in pages) if x), None)


def feed_entries(content: bytes) -> tuple[str | None, list[tuple[str | None, ...]], str | None]:
    """The feed's title, (title, summary, link, date) of each entry in order, and what is wrong with the file."""
    parser, stack, channel, entries, error = XMLPullParser(("start", "end")), [], None, [], None
    content = _entity.sub(_numbered, content)
    try:
        for at in range(0, len(content), _CHUNK):
            parser.feed(content[at : at + _CHUNK])
            for event, element in parser.read_events():
                if event == "start":
                    stack.append(element)
                    continue
                stack.pop()
                name, parent = _name(element.tag), _name(stack[-1].tag) if stack else ""
                if name in ENTRIES:
                    entries.append((_part(element, ("title",)), _part(element, SUMMARY), _link(element), _part(element, WHEN)))
                    element.clear()
                    if stack:
                        stack[-1].remove(element)
                elif name == "title" and parent in ("channel", "feed") and channel is None:
                    channel = "".join(element.itertext()).strip() or None
        parser.close()
    except ParseError as e:
        error = f"broken after {len(entries)} entries: {e.msg if hasattr(e, 'msg') else e}".split(": line")[0]
    if error is None and not entries:
        error = "no entries"
    return channel, entries, error


class _Rows(HTMLParser):
    """Cells of each table row; a table within a cell has rows of its own, and its text is not the cell's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open: list[list[list[str]]] = []  # for each open table, the cells of its open row

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr":
            self._end_row()
        elif tag == "td":
            if not self.open:
                self.open.append([])
            self.open[-1].append([])

    def handle_endtag(self, tag):
        if tag in ("tr", "table"):
            self._end_row()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]:
            self.open[-1][-1].append(data)

    def _end_row(self):
        if self.open and self.open[-1]:
            self.rows.append([" ".join("".join(c).split()) for c in self.open[-1]])
            self.open[-1] = []


def table_rows(content: bytes) -> tuple[list[list[str]], str | None]:
    """The cells of each row of the tables of a page, and what is wrong with it."""
    parser = _Rows()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    while parser.open:  # the page ends within a table
        parser.handle_endtag("table")
    return parser.rows, None if parser.rows else "no table rows"


def _each_file(spark: SparkSession, path: str, schema: str, parse: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = parse(batch.column("file")[i].as_py(), batch.column("content")[i].as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(run, schema)


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of the files without a byte, which Spark's readers pass over. The names are in the driver's file index anyway."""
    files = spark.read.format("binaryFile").load(path)
    every = spark.createDataFrame([(name,) for name in files.inputFiles()], "file string")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  both spellings of a local path
    return every.join(files.select(plain(F.col("_metadata.file_path")).alias("seen")), plain(F.col("file")) == F.col("seen"), "left_anti")


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, channel, entry_seq, title, summary, link, when, error``: a row for each entry, and one for each file that has an error."""

    def parse(file: str, content: bytes) -> list[tuple]:
        channel, entries, error = feed_entries(content)
        return [(file, channel, i, *entry, None) for i, entry in enumerate(entries)] + ([(file, channel, None, None, None, None, None, error)] if error else [])

    return _each_file(spark, path, "file string, channel string, entry_seq long, title string, summary string, link string, when string, error string", parse)


def read_table_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, first, second, error``: the first two cells of each table row with two or more, and a row for each page without one."""

    def parse(file: str, content: bytes) -> list[tuple]:
        rows, error = table_rows(content)
        found = [(file, i, r[0], r[1], None) for i, r in enumerate(rows) if len(r) > 1]
        return found or [(file, None, None, None, error or "no row with two cells")]

    return _each_file(spark, path, "file string, row long, first string, second string, error string", parse)
