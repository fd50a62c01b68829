"""A data source for FASTQ files: ``spark.read.format("fastq").load(path)`` after ``register(spark)``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, seq string, quality string"


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FastqReader(DataSourceReader):
    """Spans of about ``split`` bytes of each file. A span owns the records that start in it; to find the first, it looks for a
    line with ``@`` whose next line is letters and the one after starts with ``+``, which a quality line that happens to
    start with ``@`` is not (a header follows it)."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Span]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Span(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows: list[tuple] = []
        with system.open_input_file(span.path) as file:
            for record in records(lines(file, span.start), span.end):
                rows.append(record)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["name", "seq", "quality"])


def lines(file, start: int, chunk: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """Lines with their offsets, from the first that begins at or after ``start``."""
    file.seek(max(0, start - 1))
    at, rest, skip = max(0, start - 1), b"", start > 0
    while True:
        data = file.read(chunk)
        rest += data
        parts = rest.split(b"\n")
        rest = parts.pop()
        for p in parts:
            if skip:
                skip = False
            else:
                yield at, p.decode("utf-8", "replace").rstrip()
            at += len(p) + 1
        if not data:
            if rest and not skip:
                yield at, rest.decode("utf-8", "replace").rstrip()
            return


def records(source: Iterator[tuple[int, str]], end: int) -> Iterator[tuple[str, str, str | None]]:
    held: list[tuple[int, str]] = []

    def peek(i: int) -> tuple[int, str] | None:
        while len(held) <= i:
            line = next(source, None)
            if line is None:
                return None
            held.append(line)
        return held[i]

    def is_start() -> bool:
        head, body, plus = peek(0), peek(1), peek(2)
        return bool(head and head[1].startswith("@") and body is not None and plus is not None and not body[1].startswith(("@", "+")) and (plus[1].startswith("+") or plus[1].isalpha()))

    while (head := peek(0)) is not None:
        if not is_start():
            held.pop(0)
            continue
        if head[0] >= end:
            return
        held.pop(0)
        seq = []
        while (line := peek(0)) is not None and not line[1].startswith("+"):
            seq.append(held.pop(0)[1])
        if peek(0) is not None:
            held.pop(0)
        quality = peek(0)
        if quality is not None:
            held.pop(0)
        yield head[1][1:], "".join(seq), quality[1] if quality else None


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options["path"], int(self.options.get("split", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fastq)
