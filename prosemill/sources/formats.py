"""Formats for spark.read.format and df.write.format: JSON lines (plain or gzip), feeds and e-books, a partition for each file.

    formats.register(spark)
    spark.read.format("prosemill-jsonl").schema("id long, text string").option("rows", 1000).load("s3://bucket/folder")
    df.write.format("prosemill-jsonl").option("compression", "gzip").mode("append").save(path)

Files are found when a query is planned and read by the tasks, through whatever file system the path names. Lines, feeds and books that can't be parsed are skipped, or with option("strict", "true") end the read;
feeds and books tell the reason in a column. Option rows: how many rows of each file are taken at most (a feature of the reader; unset: all). A writer's task writes files of its own, which appear under
their names when the whole write is committed; those of failed tasks are deleted."""

from __future__ import annotations

import gzip
import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, MapType, StringType, StructType, TimestampType

from ..functions.dates import any_unix
from .corpus import book_text, feed_entries


@dataclass
class FilePart(InputPartition):
    uri: str


def _files(uri: str, suffixes: tuple[str, ...], missing: bool) -> list[str]:
    """A file, or all files below a folder with one of the suffixes, in order; names that start with a dot or an underscore don't count."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(os.path.abspath(uri))
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        if missing:
            return []
        raise FileNotFoundError(uri)
    found = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
    kept = sorted(p for p in found if p.endswith(suffixes) and not any(x[:1] in "._" for x in p[len(path) :].split("/") if x))
    return [uri.rstrip("/") + p[len(path.rstrip("/")) :] for p in kept]


def _bytes(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return f.read()


class _Reader(DataSourceReader):
    suffixes: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.strict, self.most = schema, str(options.get("strict", "false")).lower() == "true", int(options["rows"]) if "rows" in options else None
        self.uri, self.missing = options["path"], str(options.get("missing", "error")).lower() == "skip"

    def partitions(self) -> list[InputPartition]:
        return [FilePart(u) for u in _files(self.uri, self.suffixes, self.missing)] or [FilePart("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.uri:
            for i, row in enumerate(self.rows(partition.uri)):
                if self.most is not None and i >= self.most:
                    return
                yield row

    def rows(self, uri: str) -> Iterator[tuple]:
        raise NotImplementedError


def _value(x: object, kind: DataType) -> object:
    """A JSON value as the column's type; what doesn't fit is null."""
    if x is None:
        return None
    if isinstance(kind, StructType):
        return Row(**{f.name: _value(x.get(f.name), f.dataType) for f in kind.fields}) if isinstance(x, dict) else None
    if isinstance(kind, ArrayType):
        return [_value(y, kind.elementType) for y in x] if isinstance(x, list) else None
    if isinstance(kind, MapType):
        return {k: _value(y, kind.valueType) for k, y in x.items()} if isinstance(x, dict) else None
    if isinstance(kind, StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    try:
        if isinstance(kind, (DoubleType, FloatType)):
            return float(x)
        if isinstance(kind, TimestampType):
            return datetime.fromisoformat(x)
        if isinstance(kind, DateType):
            return date.fromisoformat(x)
        if kind.typeName() == "boolean":
            return x if isinstance(x, bool) else None
        return int(x) if not isinstance(x, (str, float)) or float(x).is_integer() else None
    except (TypeError, ValueError):
        return None


class LineReader(_Reader):
    suffixes = (".jsonl", ".jsonl.gz", ".json", ".ndjson", ".ndjson.gz")

    def rows(self, uri: str) -> Iterator[tuple]:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path, compression=None) as raw:
            lines = gzip.open(raw, "rb") if uri.endswith(".gz") else io.BufferedReader(raw)
            for line in lines:
                try:
                    found = json.loads(line) if line.strip() else None
                except ValueError:
                    found = None
                    if self.strict:
                        raise
                if isinstance(found, dict):
                    yield tuple(_value(found.get(f.name), f.dataType) for f in self.schema.fields)


class FeedReader(_Reader):
    suffixes = (".xml", ".rss", ".atom")

    def rows(self, uri: str, most: int = 2_000_000) -> Iterator[tuple]:
        text = _bytes(uri).decode("utf-8", "replace")
        reason = "too long" if len(text) > most else "entities" if "<!ENTITY" in text else None
        if not reason:
            try:
                ElementTree.fromstring(text)
            except ElementTree.ParseError:
                reason = "malformed"
        if reason:
            if self.strict:
                raise ValueError(f"{uri}: {reason}")
            yield uri, None, None, None, None, reason
            return
        for title, url, content, published in feed_entries(text):
            yield uri, title, url, content, any_unix(published), None


class BookReader(_Reader):
    suffixes = (".epub",)

    def rows(self, uri: str) -> Iterator[tuple]:
        try:
            yield uri, book_text(_bytes(uri)), None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
            if self.strict:
                raise
            yield uri, None, type(e).__name__


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class LineWriter(DataSourceWriter):
    """Rows as JSON lines; null values are left out."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.uri, self.overwrite = schema.names, options["path"].rstrip("/"), overwrite
        self.suffix, self.run = ".jsonl.gz" if options.get("compression") in ("gzip", "gz") else ".jsonl", uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, path = fs.FileSystem.from_uri(self.uri)
        name, count = f"part-{uuid.uuid4().hex}{self.suffix}", 0
        system.create_dir(f"{path}/_writing-{self.run}", recursive=True)
        with system.open_output_stream(f"{path}/_writing-{self.run}/{name}", compression="gzip" if self.suffix.endswith("gz") else None) as out:
            for row in iterator:
                found = row.asDict(recursive=True)
                out.write((json.dumps({k: v for k, v in found.items() if v is not None}, ensure_ascii=False, default=str) + "\n").encode())
                count += 1
        return Written(name, count)

    def commit(self, messages: list) -> None:
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{path}/_writing-{self.run}/{m.name}", f"{path}/{m.name}")
        for p in old:
            system.delete_file(p)
        self._clear(system, path)

    def abort(self, messages: list) -> None:
        self._clear(*fs.FileSystem.from_uri(self.uri))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/_writing-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_writing-{self.run}")


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prosemill-jsonl"

    def schema(self) -> str:
        return "text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LineWriter(schema, self.options, overwrite)


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prosemill-feeds"

    def schema(self) -> str:
        return "file string, title string, url string, content string, published long, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(schema, self.options)


class Books(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prosemill-books"

    def schema(self) -> str:
        return "file string, text string, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BookReader(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (JsonLines, Feeds, Books):
        spark.dataSource.register(source)
