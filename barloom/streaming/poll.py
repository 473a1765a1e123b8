"""Bars that are polled, as a table and as a stream: spark.read and spark.readStream.format("bar_poll").

A poll is numbered; what it brought can be read again by its number, so a batch that runs again
reads the same rows, and the number of polls is the stream's offset. A poll that fails brings
nothing, and the next is not looked for until `next_delay` has passed: twice as long after each
failure in a row. `Polls` says where polls come from; a folder of recorded ones is built in.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..sources.bars import OHLCV
from ..sources.scratch import remove, touch
from .bars import next_delay

POLLED = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, poll int"
ARROW = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), *[(c, pa.float64()) for c in OHLCV], ("poll", pa.int32())])
FAILED = "_failed"


class PollError(Exception):
    """A poll that brought nothing."""


class Polls:
    """Where polls come from: subclass it for a vendor. Objects travel to executors."""

    def made(self) -> list[tuple[int, bool]]:
        """(number, whether it failed) of all polls so far, in order; raises PollError where that cannot be told now."""
        raise NotImplementedError

    def pieces(self, poll: int) -> list[str]:
        """Parts of a poll that tasks read on their own."""
        raise NotImplementedError

    def rows(self, poll: int, piece: str, where) -> Iterator[pa.RecordBatch]:
        """Rows of a part, but for the column poll; where: an Arrow expression that they meet, or None."""
        raise NotImplementedError


class RecordedPolls(Polls):
    """A folder with a folder of Parquet files for each poll (poll=0, poll=1, ...), or with a file _failed in it."""

    def __init__(self, path: str):
        self.path = path

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def _files(self, folder: str) -> list[str]:
        fs, _ = self._at()
        return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file)

    def made(self) -> list[tuple[int, bool]]:
        fs, root = self._at()
        found = sorted((int(m[1]), f.path) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if (m := re.fullmatch(r"poll=(\d+)", f.base_name)))
        return [(n, any(x.endswith("/" + FAILED) for x in self._files(p))) for n, p in found]

    def pieces(self, poll: int) -> list[str]:
        return [f for f in self._files(f"{self._at()[1]}/poll={poll}") if f.endswith(".parquet")]

    def rows(self, poll: int, piece: str, where) -> Iterator[pa.RecordBatch]:
        yield from ds.dataset(piece, filesystem=self._at()[0], format="parquet").to_batches(filter=where)


def record(spark: SparkSession, bars: DataFrame, path: str, poll: int) -> None:
    """What a poll brought, kept by its number; again replaces it."""
    bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *OHLCV).write.mode("overwrite").parquet(f"{path}/poll={poll}")


def record_failure(spark: SparkSession, path: str, poll: int) -> None:
    folder = f"{path}/poll={poll}"
    remove(spark, folder)
    touch(spark, f"{folder}/{FAILED}")


@dataclass
class Piece(InputPartition):
    poll: int
    piece: str


def _where(f: Filter):
    """The Arrow expression of a filter on symbol or ts; None where there is none."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in ("symbol", "ts"):
        return None
    as_arrow = lambda v: pa.scalar(v, pa.string()) if name == "symbol" else pa.scalar(v, ARROW.field("ts").type)
    field = ds.field(name) if name == "symbol" else ds.field(name).cast(ARROW.field("ts").type)
    if isinstance(f, EqualTo):
        return field == as_arrow(f.value)
    if isinstance(f, In):
        return field.isin(pa.array([v for v in f.value], as_arrow(f.value[0]).type)) if len(f.value) else None
    for kind, make in ((GreaterThan, lambda v: field > v), (GreaterThanOrEqual, lambda v: field >= v), (LessThan, lambda v: field < v), (LessThanOrEqual, lambda v: field <= v)):
        if isinstance(f, kind):
            return make(as_arrow(f.value))
    return None


def _read(polls: Polls, part: Piece, where) -> Iterator[pa.RecordBatch]:
    for b in polls.rows(part.poll, part.piece, where):
        if b.num_rows:
            number = pa.array([part.poll] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[pc.cast(b.column(n), ARROW.field(n).type, safe=False) for n in ARROW.names[:-1]], number], schema=ARROW)


class PollReader(DataSourceReader):
    """All polls made so far; a task for each part, which meets filters on symbol and time while reading."""

    def __init__(self, polls: Polls):
        self.polls, self.where, self.only = polls, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("poll",):
                self.only = f.value
                continue
            found = _where(f)
            if found is None:
                yield f
            else:
                self.where = found if self.where is None else self.where & found

    def partitions(self) -> list[Piece]:
        return [Piece(n, p) for n, failed in self.polls.made() if not failed and self.only in (None, n) for p in self.polls.pieces(n)]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        yield from _read(self.polls, part, self.where)


class PollStream(DataSourceStreamReader):
    """Polls from one number to another. The offset is the first poll that has not been taken in.

    A reader that begins anew takes all polls there are: where the stream went on from is Spark's
    checkpoint to know. One that runs on stops at a poll that failed, and looks again after a delay.
    """

    def __init__(self, polls: Polls, interval: float, most: float, clock=time.monotonic, sleep=time.sleep):
        self.polls, self.interval, self.most, self.clock, self.sleep = polls, interval, most, clock, sleep
        self.next: int | None = None
        self.failures, self.due = 0, 0.0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _failed(self) -> None:
        self.failures += 1
        self.due = self.clock() + next_delay(self.interval, self.failures, self.most)

    def latestOffset(self) -> dict:
        while self.next is None or self.clock() >= self.due:
            try:
                made = self.polls.made()
            except PollError:
                self._failed()
                if self.next is not None:
                    break
                self.sleep(max(0.0, self.due - self.clock()))  # nothing is known yet
                continue
            fresh = [(n, failed) for n, failed in made if self.next is None or n >= self.next]
            running, self.next = self.next is not None, self.next or 0
            for n, failed in fresh:
                self.next = n + 1
                if failed and running:
                    self._failed()
                    break
                self.failures = 0
            break
        return {"poll": self.next}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(n, p) for n, failed in self.polls.made() if start["poll"] <= n < end["poll"] and not failed for p in self.polls.pieces(n)]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        yield from _read(self.polls, part, None)

    def commit(self, end: dict) -> None:
        """Recorded polls stay."""


class PollSource(DataSource):
    """Options: path (of recorded polls), interval and most (seconds between polls, and after failures at most)."""

    @classmethod
    def name(cls) -> str:
        return "bar_poll"

    def schema(self) -> str:
        return POLLED

    def polls(self) -> Polls:
        return RecordedPolls(self.options["path"])

    def reader(self, schema) -> PollReader:
        return PollReader(self.polls())

    def streamReader(self, schema) -> PollStream:
        return PollStream(self.polls(), float(self.options.get("interval", 60)), float(self.options.get("most", 900)))


def register(spark: SparkSession, source: type[DataSource] = PollSource) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def progress(query) -> list[dict]:
    """Offsets that a stream's batches ended at."""
    return [json.loads(p["sources"][0]["endOffset"]) if isinstance(p["sources"][0]["endOffset"], str) else p["sources"][0]["endOffset"] for p in query.recentProgress]
