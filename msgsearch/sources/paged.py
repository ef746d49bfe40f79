"""Exports in pages, as a data source for batches and streams.

    <path>/account=<name>/chat=<id>/page=<number>/<files of JSON lines>

Pages of a chat are numbered from 0 without gaps, and a page appears whole (write it elsewhere, then rename).
How many there are is found by probing, so neither the driver nor a checkpoint ever lists pages: the offset
of a stream is one number for each chat. Tasks get stretches of pages, of several chats or of a part of one.

    spark.dataSource.register(PagedExport)
    spark.read.format("paged_export").option("path", ...).load()        # account, chat, page, line
    write_pages(rows, path)                                             # the same columns
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "paged_export"
LINE = "account string, chat string, page bigint, line string"
PAGES_PER_TASK = 64
# Tasks of one read; a larger one has more pages in each, unless the reader is told how many.
MOST_TASKS = 1_000
# The folder of a missing account or chat, as Spark names it.
MISSING = "__HIVE_DEFAULT_PARTITION__"
# Chats that are probed at a time, and bytes of one batch of lines.
PROBES = 32
BATCH = 1 << 22

_KINDS = pa.schema([("account", pa.string()), ("chat", pa.string()), ("page", pa.int64()), ("line", pa.string())])


@dataclass
class Pages(InputPartition):
    """What one task reads: folder of a chat, first page, and the page after the last."""

    stretches: list[tuple[str, int, int]]


class Export:
    """The folders of an export."""

    def __init__(self, path: str):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = path.removeprefix("file:")
        self.files, root = fs.FileSystem.from_uri(path)
        self.root = root.rstrip("/")

    def folders(self, below: str, prefix: str) -> list[str]:
        """Names of folders, in order; none where there is no such folder."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{below}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(prefix))

    def chats(self) -> list[str]:
        return [f"{a}/{c}" for a in self.folders("", "account=") for c in self.folders(a, "chat=")]

    def has(self, chat: str, page: int) -> bool:
        return self.files.get_file_info(f"{self.root}/{chat}/page={page}").type != fs.FileType.NotFound

    def count(self, chat: str, known: int = 0) -> int:
        """Number of pages of a chat, by doubling steps from ``known`` on and halving them again."""
        low, step = known, 1
        while self.has(chat, low + step - 1):
            low, step = low + step, step * 2
        high = low + step - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.has(chat, middle) else (low, middle)
        return low

    def counts(self, known: dict[str, int]) -> dict[str, int]:
        chats = self.chats()
        with ThreadPoolExecutor(PROBES) as pool:
            return dict(zip(chats, pool.map(lambda chat: self.count(chat, known.get(chat, 0)), chats)))

    def lines(self, chat: str, page: int) -> Iterator[bytes]:
        """Lines of all files of a page that are not empty; files whose names begin with _ or . do not count."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{chat}/page={page}"))
        for file in sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", "."))):
            with self.files.open_input_stream(file) as stream:
                rest = b""
                while block := stream.read(BATCH):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from filter(bytes.strip, whole)
                if rest.strip():
                    yield rest


def stretches(start: dict[str, int], end: dict[str, int], most: int) -> list[Pages]:
    """Tasks of up to ``most`` pages for the pages of ``end`` that are not in ``start``."""
    tasks: list[Pages] = []
    room = 0
    for chat in sorted(end):
        at = start.get(chat, 0)
        while at < end[chat]:
            if not room:
                tasks.append(Pages([]))
                room = most
            some = min(room, end[chat] - at)
            tasks[-1].stretches.append((chat, at, at + some))
            at, room = at + some, room - some
    return tasks


def read_stretches(path: str, task: Pages) -> Iterator[pa.RecordBatch]:
    export = Export(path)
    rows: list[tuple] = []
    size = 0
    for chat, first, last in task.stretches:
        account, name = (unquote(part.split("=", 1)[1]) for part in chat.split("/"))
        for page in range(first, last):
            for line in export.lines(chat, page):
                rows.append((account, name, page, line.decode("utf-8", "replace")))
                size += len(line)
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.types)], schema=_KINDS)


def write_pages(rows: DataFrame, path: str) -> None:
    """Write ``account, chat, page, line`` as an export, each page as one file.

    A page is written elsewhere and renamed by the task that has its rows, so nothing is left to be moved by the
    driver. A page that is there already stays, and one that is tried again comes from the same rows.
    """
    keys = ["account", "chat", "page"]
    dealt = rows.select(*keys, "line").repartition(*keys).sortWithinPartitions(*keys)
    dealt.foreachPartition(lambda part: _write_partition(path, part))


def _write_partition(path: str, rows: Iterator) -> None:
    export, made = Export(path), set()
    own = f"{export.root}/_writing/{uuid.uuid4().hex}"
    for (account, chat, page), lines in groupby(rows, itemgetter(0, 1, 2)):
        folder = "/".join(f"{k}={quote(str(v), safe='') if v not in (None, '') else MISSING}" for k, v in (("account", account), ("chat", chat)))
        if export.has(folder, page):
            continue
        if folder not in made:
            export.files.create_dir(f"{export.root}/{folder}", recursive=True)
            made.add(folder)
        written = f"{own}/page={page}"
        export.files.create_dir(written, recursive=True)
        with export.files.open_output_stream(f"{written}/lines.json") as stream:
            for row in lines:
                stream.write(row[3].encode() + b"\n")
        export.files.move(written, f"{export.root}/{folder}/page={page}")


class PagedExport(DataSource):
    """Options: ``path``, and ``pages_per_task``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Reader:
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options["pages_per_task"]) if "pages_per_task" in options else None
        if self.most is not None and self.most < 1:
            raise ValueError("pages_per_task is 1 or more")

    def tasks(self, start: dict[str, int], end: dict[str, int]) -> list[Pages]:
        pages = sum(end.values()) - sum(start.get(chat, 0) for chat in end)
        return stretches(start, end, self.most or max(PAGES_PER_TASK, -(-pages // MOST_TASKS)))

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return read_stretches(self.path, partition)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Pages]:
        # Spark reads a source without partitions as one that does not say which it has.
        return self.tasks({}, Export(self.path).counts({})) or [Pages([])]


class _Stream(_Reader, DataSourceStreamReader):
    """Pages that were never read before. ``known`` saves probes only: a restarted query probes from 0."""

    def __init__(self, options):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = Export(self.path).counts(self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.tasks(start, end)
