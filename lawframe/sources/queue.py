"""A queue as a data source: `spark.readStream.format("docqueue")`, `df.write` and `writeStream.format("docqueue")`.

The queue is a folder on storage that all machines mount (option `path`). Messages lie in segments, JSON lines with
consecutive numbers:

    ready/00000000000000000007.jsonl    not yet acknowledged
    acked                               the number of the last segment that was taken and deleted
    commits/WRITER-BATCH                what a writer's batch became, so that a batch that comes again is not doubled
    parts/                              what tasks have written and no commit has taken yet

A stream reads segments as partitions, its offset is a segment's number. Spark asks for a commit only once a batch and
its sink are done; then the segments go (delete after success). A query that dies before that is handed the same
segments again under the same batch number; one that dies between the two finds them taken. So with a sink that takes a
batch number once (files, this queue) nothing is lost and nothing doubled.

A segment number is claimed by linking the finished part under a name that does not exist yet: readers see whole segments
alone, and writers that meet take the next number. Empty parts become no segment.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "docqueue"


class Folder:
    """The queue's folder."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        for name in ("ready", "commits", "parts"):
            os.makedirs(f"{self.path}/{name}", exist_ok=True)

    def segment(self, number: int) -> str:
        return f"{self.path}/ready/{number:020d}.jsonl"

    def acked(self) -> int:
        try:
            with open(f"{self.path}/acked") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def last(self) -> int:
        """The greatest number given so far."""
        return max([self.acked(), *(int(n[:20]) for n in os.listdir(f"{self.path}/ready") if n.endswith(".jsonl"))])

    def replace(self, name: str, content: str) -> None:
        own = f"{self.path}/parts/{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, f"{self.path}/{name}")

    def add(self, part: str) -> int:
        """A finished part becomes the next segment."""
        number = self.last() + 1
        while True:
            with contextlib.suppress(FileExistsError):
                os.link(part, self.segment(number))
                os.unlink(part)
                return number
            number += 1

    def acknowledge(self, number: int) -> None:
        """Segments up to `number` are done. The mark goes first: what is left behind it is deleted another time."""
        if number > self.acked():
            self.replace("acked", str(number))
        for name in os.listdir(f"{self.path}/ready"):
            if name.endswith(".jsonl") and int(name[:20]) <= number:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(f"{self.path}/ready/{name}")


@dataclass
class Segment(InputPartition):
    number: int


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


def _written(path: str, rows: Iterator) -> Part:
    own, n = f"{Folder(path).path}/parts/{uuid.uuid4().hex}.part", 0
    with open(own, "w", encoding="utf-8") as f:
        for row in rows:
            f.write(json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False, default=str) + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    return Part(own, n)


def _dropped(parts: list) -> None:
    for part in parts:
        if part is not None:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part.path)


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segment": Folder(self.path).acked()}

    def latestOffset(self) -> dict:
        return {"segment": Folder(self.path).last()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(n) for n in range(start["segment"] + 1, end["segment"] + 1)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        with open(Folder(self.path).segment(partition.number), encoding="utf-8") as lines:
            for place, line in enumerate(lines):
                yield partition.number, place, line.rstrip("\n")

    def commit(self, end: dict) -> None:
        Folder(self.path).acknowledge(end["segment"])


class QueueStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator) -> Part:
        return _written(self.path, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        """The batch's parts become segments, once: a plan with their names is written first, and a batch that comes
        again finishes the plan that is there."""
        folder, name = Folder(self.path), f"commits/{self.writer}-{batchId:012d}"
        if os.path.exists(f"{folder.path}/{name}"):
            _dropped(messages)
        else:
            folder.replace(name, json.dumps([m.path for m in messages if m is not None and m.rows]))
            _dropped([m for m in messages if m is not None and not m.rows])
        with open(f"{folder.path}/{name}") as f:
            for part in json.load(f):
                if os.path.exists(part):
                    folder.add(part)

    def abort(self, messages: list, batchId: int) -> None:
        _dropped(messages)


class QueueWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Part:
        return _written(self.path, iterator)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.rows:
                Folder(self.path).add(m.path)
        _dropped([m for m in messages if m is not None and not m.rows])

    def abort(self, messages: list) -> None:
        _dropped(messages)


class QueueSource(DataSource):
    """Options: `path`, the queue's folder; for a stream that writes `writer`, its name, the same after a restart."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "segment long, place long, value string"

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("a queue needs a path")
        return path

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self._path())

    def writer(self, schema, overwrite: bool) -> QueueWriter:
        if overwrite:
            raise ValueError("messages can only be appended to a queue")
        return QueueWriter(self._path())

    def streamWriter(self, schema, overwrite: bool) -> QueueStreamWriter:
        if not (name := self.options.get("writer")) or not name.replace("_", "").isalnum():
            raise ValueError("a stream that writes to a queue needs a writer's name of letters, digits and underscores")
        return QueueStreamWriter(self._path(), name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QueueSource)
