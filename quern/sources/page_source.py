"""A source of pages: answers of an encyclopedia's interface, kept as files, read as a batch or as a stream.

A folder has files of answers, each for a range of titles; a line is ``{"asked": title, "answer": text}``, the text being what the
interface said.  The readers give (title, extract, links, error): an answer that can't be
read, or has no page, is a row with an error, and so is a file that can't be opened, so one bad answer fails no round.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("from", "A").option("to", "M").load(folder)

A batch is cut by files, which are ranges of titles; bounds on titles, given as options,
leave files outside unread.  A stream takes files by their time and name, each once.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "title string, extract string, links array<string>, error string"
SUFFIX = ".answers"
#: Answers of about so many bytes go into a file, and into a batch that a reader gives out; a batch has so many rows at most.
FILE_BYTES, BATCH_BYTES, BATCH_ROWS = 8 << 20, 1 << 20, 1000
TYPES = pa.schema([("title", pa.string()), ("extract", pa.string()), ("links", pa.list_(pa.string())), ("error", pa.string())])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _files(uri: str) -> list[tuple[str, int, int]]:
    """(name, time in nanoseconds, bytes) of the finished files of a folder."""
    store, path = _store(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.mtime_ns or 0, f.size or 0) for f in found if f.base_name.endswith(SUFFIX))


def _first(name: str) -> str:
    """The first title of a file."""
    return unquote(name[: -len(SUFFIX)].partition("~")[2])


def _text(x) -> str | None:
    """A value as text, as answers may hold others."""
    return x if x is None or isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def decoded(asked: str | None, answer: str | None) -> tuple:
    """(title, extract, links, error) of one answer."""
    try:
        pages = json.loads(answer or "")["query"]["pages"]
        page = next(iter(pages.values()), None)
        if page is None or "missing" in page:
            return asked, None, None, "no page"
        return _text(page.get("title", asked)), _text(page.get("extract")), [_text(x["title"]) for x in page.get("links") or []], None
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return asked, None, None, f"unreadable answer: {type(e).__name__}"


@dataclass
class Files(InputPartition):
    uri: str
    names: list[str]


class _Reads:
    """What tasks of both readers do."""

    low, high = None, None

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of bounded size: Spark would collect ten thousand tuples, however long."""
        held, size = [], 0
        for row in self._rows(partition):
            held.append(row)
            size += len(row[1] or "") + 100
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _rows(self, partition: Files) -> Iterator[tuple]:
        store, path = _store(partition.uri)
        for name in partition.names:
            try:
                with store.open_input_stream(f"{path}/{name}") as f:
                    for line in _lines(f):
                        row = json.loads(line)
                        if (self.low is None or row["asked"] >= self.low) and (self.high is None or row["asked"] <= self.high):
                            yield decoded(row["asked"], row["answer"])
            except (OSError, ValueError, KeyError, TypeError) as e:
                yield _first(name), None, None, f"unreadable file: {type(e).__name__}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], schema=TYPES)


def _lines(f, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := f.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def _dealt(uri: str, files: list[tuple[str, int, int]], parts: int) -> list[Files]:
    """Neighbouring files in groups of about equally many bytes."""
    share, out, held, size = max(1, -(-sum(f[2] for f in files) // max(1, parts))), [], [], 0
    for name, _, n in files:
        held.append(name)
        size += n
        if size >= share:
            out.append(Files(uri, held))
            held, size = [], 0
    return out + ([Files(uri, held)] if held else [])


class PageReader(_Reads, DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.parts = options["path"], int(options.get("partitions", "64"))
        self.low, self.high = options.get("from"), options.get("to")

    def partitions(self) -> list[Files]:
        files = sorted(_files(self.uri), key=lambda f: (_first(f[0]), f[0]))
        firsts = [_first(f[0]) for f in files]
        # A file reaches from its first title to the next one that a file starts with.
        ends = [firsts[j] if (j := bisect_right(firsts, x)) < len(firsts) else None for x in firsts]
        kept = [f for f, x, end in zip(files, firsts, ends, strict=True) if (self.high is None or x <= self.high) and (self.low is None or end is None or end >= self.low)]
        return _dealt(self.uri, kept, self.parts) or [Files(self.uri, [])]


class PageStream(_Reads, DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.parts = options["path"], int(options.get("partitions", "64"))

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        """The newest file; a batch is all that came since the last one, in as many tasks as the partitions say."""
        files = sorted((f[1], f[0]) for f in _files(self.uri))
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def _between(self, start: dict, end: dict) -> list[tuple[str, int, int]]:
        place = lambda o: (o["time"], o["name"])
        return [f for f in sorted(_files(self.uri), key=lambda f: (f[1], f[0])) if place(start) < (f[1], f[0]) <= place(end)]

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt(self.uri, self._between(start, end), self.parts)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def save_answers(answers: DataFrame, folder: str, files: int) -> int:
    """Writes (title, answer) as files of title ranges, as a fetcher leaves them behind; gives the number of files.

    There are so many files at least, and as many more as it takes for `FILE_BYTES` in each: a task holds the answers of one file at most.
    A file gets its name when it is whole, and a task that runs again writes the same one.
    """

    def write(batches):
        number, out, store, path, place = 0, None, *_store(folder), None
        store.create_dir(path, recursive=True)
        for b in batches:
            for title, answer in ((t.as_py(), a.as_py()) for t, a in zip(b.column("title"), b.column("answer"), strict=True)):
                if out is None:
                    place = f"{path}/{b.column('part')[0].as_py():06d}~{quote(title, safe='')[:180]}{SUFFIX}"
                    out = store.open_output_stream(place + ".draft")
                out.write(json.dumps({"asked": title, "answer": answer}).encode() + b"\n")
        if out:
            out.close()
            store.move(place + ".draft", place)
            number = 1
        yield pa.RecordBatch.from_arrays([pa.array([number])], names=["n"])

    answers = answers.where("title is not null").select("title", "answer")
    size = answers.agg(F.sum(F.octet_length("answer").cast("long"))).first()[0] or 0
    rows = answers.repartitionByRange(max(files, -(-size // FILE_BYTES)), "title").sortWithinPartitions("title")
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def answer_of(title: Column, extract: Column, links: Column) -> Column:
    """The interface's answer for one page, links as an array of titles."""
    page = F.struct(title.alias("title"), extract.alias("extract"), F.transform(links, lambda x: F.struct(x.alias("title"))).alias("links"))
    return F.to_json(F.struct(F.struct(F.create_map(F.lit("1"), page).alias("pages")).alias("query")))
