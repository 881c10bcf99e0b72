"""Data sources by name: ``spark.read.format("captured_folder")`` and ``spark.read.format("saved_searches")``.

Both plan their partitions from the sizes of the files alone and read them in the tasks. Paths may be of any store that
pyarrow reaches (local, ``file:``, ``hdfs:``, ``s3:``).
"""

from __future__ import annotations

import io
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from parcelscope import schema

PART_BYTES = 32 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
SEARCH = schema.HUNTS[schema.HUNTS.index("struct<"):-1]  # one definition
SPACE = re.compile(r"\s*")
LINES = (".jsonl", ".json", ".txt")  # files of one JSON page a line, cut anywhere; every other file is one page


@dataclass
class Part(InputPartition):
    """Byte ranges of files, read by one task."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(None)
        self.ranges = ranges


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of all files under a folder, but for hidden ones and those that start with an underscore."""
    store, base = store_of(path)
    found = store.get_file_info(base)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    entries = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base, recursive=True))
    files = [(f.path, f.size) for f in entries if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted(files)


def planned(files: list[tuple[str, int]], part_bytes: int, cut: bool = True) -> list[Part]:
    """Partitions of about ``part_bytes``: small files share one, files of lines are cut where they are larger."""
    parts: list[Part] = []
    ranges: list[tuple[str, int, int]] = []
    room = part_bytes
    for name, size in files:
        start = 0
        while start < size:
            whole = not (cut and name.endswith(LINES))
            take = size - start if whole else min(size - start, room)
            ranges.append((name, start, start + take))
            start, room = start + take, room - take
            if room <= 0:
                parts.append(Part(ranges))
                ranges, room = [], part_bytes
    return [*parts, Part(ranges)] if ranges else parts


def lines_between(file, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin in [start, stop): a line belongs to the range that holds its first byte."""
    reader = io.BufferedReader(file, 1 << 20)
    if start:
        reader.seek(start - 1)
        start += len(reader.readline()) - 1
    while start < stop and (line := reader.readline()):
        start += len(line)
        yield line


class CapturedFolder(DataSource):
    """Captured pages: lines of ``{"url", "html"}``, or files that are a page each (their path is its url). Option ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "captured_folder"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CapturedReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class CapturedReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Part]:
        return planned(files_of(self.path), self.part_bytes) or [Part([])]

    def pages(self, part: Part) -> Iterator[tuple[str | None, str | None]]:
        store, _ = store_of(self.path)
        for name, start, stop in part.ranges:
            with store.open_input_file(name) as file:
                if not name.endswith(LINES):
                    yield name, file.read().decode("utf-8", "replace")
                    continue
                for line in lines_between(file, start, stop):
                    if line.strip():
                        page = json.loads(line)
                        yield page.get("url"), page.get("html")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        urls, texts, held = [], [], 0
        for url, html in self.pages(partition):
            urls.append(url)
            texts.append(html)
            held += len(html or "")
            if held >= BATCH_BYTES:
                yield pa.record_batch([pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["url", "html"])
                urls, texts, held = [], [], 0
        yield pa.record_batch([pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["url", "html"])


class SavedSearches(DataSource):
    """Saved searches of definition files (``{"hunts": [...]}``, one or several objects a file), the enabled ones.

    Option ``disabled`` = ``include`` reads the others too. A definition without ``enabled`` is enabled. Options ``part_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_searches"

    def schema(self) -> str:
        return SEARCH

    def reader(self, schema: StructType) -> DataSourceReader:
        every = str(self.options.get("disabled", "")).lower() == "include"
        return SearchReader(self.options["path"], schema, every, int(self.options.get("part_bytes", PART_BYTES)))


class SearchReader(DataSourceReader):
    def __init__(self, path: str, columns: StructType, every: bool, part_bytes: int):
        self.path, self.columns, self.every, self.part_bytes = path, columns, every, part_bytes

    def partitions(self) -> list[Part]:
        return planned(files_of(self.path), self.part_bytes, cut=False) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        decoder = json.JSONDecoder()
        for name, _, _ in partition.ranges:
            with store.open_input_file(name) as file:
                text = file.read().decode("utf-8")
            at = SPACE.match(text).end()
            while at < len(text):
                found, end = decoder.raw_decode(text, at)
                at = SPACE.match(text, end).end()
                for hunt in found.get("hunts") or ():
                    if self.every or hunt.get("enabled") is not False:
                        yield ordered(hunt, self.columns)


def ordered(values: dict, columns: StructType) -> tuple:
    """Values in the order of the columns, None for missing ones, nested structs likewise."""
    return tuple(
        ordered(values[f.name], f.dataType) if isinstance(f.dataType, StructType) and isinstance(values.get(f.name), dict) else values.get(f.name)
        for f in columns
    )


def register(spark: SparkSession) -> None:
    """Make both sources known to a session. Executors need no copy of this package: the classes travel by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (CapturedFolder, SavedSearches):
        spark.dataSource.register(source)
