"""A source of change topics with offsets for each topic: bounded batches, topics by pattern, an error where offsets are lost.

``TopicSource`` is a Python data source of Spark. A batch plans offset ranges only, at most ``cap`` messages over all topics in turn; tasks
fetch their ranges. What holds the messages is a log (``Log``), here a folder of segment files.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fenbrook.sources.shared import ship

_SCHEMA = "topic string, offset bigint, value string"


class OffsetsLost(Exception):
    """The log has let go of messages that were never read: going on would lose them silently."""


class Log(Protocol):
    def topics(self) -> list[str]: ...
    def bounds(self, topic: str) -> tuple[int, int]:
        """The first offset that is kept, and the next one to be written."""
    def fetch(self, topic: str, start: int, end: int) -> Iterator[tuple[int, str]]: ...


class FolderLog:
    """Topics as folders of segments, named by their first offset, one message a line; for a folder that all machines see."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def topics(self) -> list[str]:
        return sorted(x.name for x in os.scandir(self.path) if x.is_dir()) if os.path.isdir(self.path) else []

    def _segments(self, topic: str) -> list[tuple[int, str]]:
        return sorted((int(x.name.split(".")[0]), x.path) for x in os.scandir(f"{self.path}/{topic}") if x.name.endswith(".jsonl"))

    def bounds(self, topic: str) -> tuple[int, int]:
        segments = self._segments(topic)
        if not segments:
            return 0, 0
        with open(segments[-1][1], "rb") as f:
            return segments[0][0], segments[-1][0] + sum(1 for _ in f)

    def fetch(self, topic: str, start: int, end: int) -> Iterator[tuple[int, str]]:
        segments = self._segments(topic)
        for (first, path), following in zip(segments, [*(s[0] for s in segments[1:]), end], strict=True):
            if first >= end or following <= start:
                continue
            with open(path, encoding="utf-8") as f:
                for offset, line in enumerate(f, first):
                    if start <= offset < end:
                        yield offset, line.rstrip("\n")


@dataclass
class Range(InputPartition):
    topic: str
    start: int
    end: int


class TopicReader(DataSourceStreamReader):
    def __init__(self, log: Log, pattern: str, cap: int, per_task: int):
        self.log, self.pattern, self.cap, self.per_task = log, re.compile(pattern), cap, per_task
        self.at: dict | None = None

    def _bounds(self) -> dict[str, tuple[int, int]]:
        return {t: self.log.bounds(t) for t in self.log.topics() if self.pattern.fullmatch(t)}

    def initialOffset(self) -> dict:
        return {t: first for t, (first, _) in self._bounds().items()}

    def latestOffset(self) -> dict:
        """The end of the next batch: what is there, but at most ``cap`` messages, dealt evenly over the topics that have some."""
        start = self.at if self.at is not None else self.initialOffset()
        bounds, end, left = self._bounds(), dict(start), self.cap
        for t, (first, _) in bounds.items():
            end.setdefault(t, first)
        waiting = {t: n - end[t] for t, (_, n) in bounds.items() if n > end[t]}
        while waiting and left > 0:
            share = max(1, left // len(waiting))
            for t in list(waiting):
                took = min(share, waiting[t], left)
                end[t], waiting[t], left = end[t] + took, waiting[t] - took, left - took
                if not waiting[t]:
                    del waiting[t]
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:
            self.at = end  # a restart: Spark plans its last batch before it asks for the next
        out: list[InputPartition] = []
        for t, until in end.items():
            first, following = self.log.bounds(t)
            since = start.get(t, first)
            if since < until and (first > since or following < until):
                raise OffsetsLost(f"{t}: offsets {since} to {until} are to be read, {first} to {following} are there")
            out += [Range(t, a, min(a + self.per_task, until)) for a in range(since, until, self.per_task)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset, value in self.log.fetch(partition.topic, partition.start, partition.end):
            yield partition.topic, offset, value


class TopicSource(DataSource):
    """Options: path, topics (a pattern that whole names match), cap (100,000), per_task (10,000)."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> TopicReader:
        o = self.options
        return TopicReader(FolderLog(o["path"]), o.get("topics", ".*"), int(o.get("cap", 100_000)), int(o.get("per_task", 10_000)))


def read_topics(spark: SparkSession, path: str, topics: str = ".*", cap: int = 100_000, per_task: int = 10_000) -> DataFrame:
    """Streams topic, offset, value of a log's topics that match a pattern, new ones too, each from the first message that is kept."""
    ship(spark)
    spark.dataSource.register(TopicSource)
    return spark.readStream.format("topic_log").options(path=path, topics=topics, cap=cap, per_task=per_task).load()


def append_messages(path: str, topic: str, messages: list[dict], first: int | None = None) -> None:
    """A new segment of a folder log, after what is there."""
    log = FolderLog(path)
    folder = f"{log.path}/{topic}"
    os.makedirs(folder, exist_ok=True)
    at = log.bounds(topic)[1] if first is None else first
    with open(f"{folder}/{at:020d}.tmp", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(m) + "\n" for m in messages)
    os.rename(f"{folder}/{at:020d}.tmp", f"{folder}/{at:020d}.jsonl")
