"""Sources that are read over a wire: listings in pages, and channels that push messages.

Both are Python data sources around a small transport object, which is pickled into the tasks: what a listing's page or a
channel's messages are is the transport's, what is read by which task, retried, stopped and resumed is the source's.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from storyline.operators.state import first_per_key


class Listing(Protocol):
    """Pages of records by number, from 1 on."""

    def page(self, number: int) -> list[dict[str, Any]]:
        """The records of a page, none past the last one; any exception may pass on another try."""


class Channel(Protocol):
    """Messages in order of a number that only grows, from 0 or more."""

    def first_since(self, seconds: float) -> int:
        """The number of the first message at or after a time; one past the last if there is none."""

    def last(self) -> int:
        """The number of the newest message, -1 before any."""

    def messages(self, low: int, high: int) -> Iterator[tuple]:
        """The messages from one number to another, both included; numbers may be missing."""


def retried(f: Callable[[], Any], tries: int, pause: float) -> Any:
    """f's result; after a failure it is called again, with pauses that double, so many times in all."""
    for k in range(tries):
        try:
            return f()
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("tries must be 1 or more")


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _PagesReader(DataSourceReader):
    def __init__(self, listing: Listing, schema: StructType, options: Mapping[str, str]):
        self.listing, self.names = listing, schema.names
        self.pages, self.each = int(options.get("pages", "1000")), int(options.get("pagesPerTask", "20"))
        self.tries, self.pause = int(options.get("tries", "3")), float(options.get("pause", "0.5"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(k, min(k + self.each - 1, self.pages)) for k in range(1, self.pages + 1, self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number in range(partition.low, partition.high + 1):
            records = retried(lambda n=number: self.listing.page(n), self.tries, self.pause)
            if not records:
                return  # past the last page; tasks that begin there ask once
            for place, record in enumerate(records):
                yield (number, place, *(record.get(c) for c in self.names[2:]))


def read_listing(spark: SparkSession, listing: Listing, fields: str, **options) -> DataFrame:
    """(page, place, fields) of a listing. Options: ``pages`` that are asked for at most (the listing's limit), ``pagesPerTask``,
    ``tries`` and ``pause`` (seconds) of a page. A page that fails to the last fails the read; a page without records ends a task's range."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "storyline_listing"

        def schema(self) -> str:
            return f"page int, place int, {fields}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _PagesReader(listing, schema, self.options)

    spark.dataSource.register(Pages)
    return spark.read.format("storyline_listing").options(**{k: str(v) for k, v in options.items()}).load()


def first_seen(records: DataFrame, key: str) -> DataFrame:
    """Each record once, as the first page has it: a listing that moves while it is read shows records twice."""
    return first_per_key(records.where(F.col(key).isNotNull()), [key], [F.col("page"), F.col("place")])


class FolderListing:
    """Pages kept as folders ``page=N`` of JSON lines, in any store that Arrow's file systems reach."""

    def __init__(self, root: str):
        self.root = root

    def page(self, number: int) -> list[dict[str, Any]]:
        store, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        found = [i.path for i in store.get_file_info(fs.FileSelector(f"{path}/page={number}", allow_not_found=True)) if i.path.endswith(".json")]
        if not found:
            return []
        out = []
        for p in sorted(found):
            with store.open_input_stream(p) as f:
                out += [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        return out


class _ChannelReader(DataSourceStreamReader):
    def __init__(self, channel: Channel, options: Mapping[str, str]):
        self.channel, self.each, self.tasks = channel, int(options.get("messagesPerTask", "10000")), int(options.get("tasks", "64"))
        self.since = float(options["since"]) if "since" in options else None

    def initialOffset(self) -> dict:
        # The number before the first message that is wanted.
        return {"after": -1 if self.since is None else self.channel.first_since(self.since) - 1}

    def latestOffset(self) -> dict:
        return {"after": self.channel.last()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = start["after"] + 1, end["after"]
        step = max(self.each, -(-(high - low + 1) // self.tasks))
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.channel.messages(partition.low, partition.high)

    def commit(self, end: dict) -> None:
        pass


def channel_stream(spark: SparkSession, channel: Channel, schema: str, since: float | None = None, **options) -> DataFrame:
    """A stream of a channel's messages. The first run begins at the first message since a time (a backfill), later runs with the
    same checkpoint where the last one ended: offsets are message numbers, so a batch that runs again reads the same messages."""

    class Messages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "storyline_channel"

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _ChannelReader(channel, self.options)

    spark.dataSource.register(Messages)
    given = {k: str(v) for k, v in options.items()} | ({} if since is None else {"since": repr(since)})
    return spark.readStream.format("storyline_channel").options(**given).load()


class TableChannel:
    """A Parquet table as a channel: its rows are messages, numbered by a column that grows with their time. Ends are read from the files' statistics, no rows pass the driver but those of one row group."""

    def __init__(self, path: str, number: str, stamp: str, fields: Sequence[str]):
        self.path, self.number, self.stamp, self.fields = path, number, stamp, list(fields)

    def _groups(self) -> list[tuple[dict, ds.Fragment]]:
        """(statistics, row group) in order of number."""
        groups = [(g.row_groups[0].statistics, g) for f in ds.dataset(self.path, format="parquet").get_fragments() for g in f.split_by_row_group()]
        return sorted((x for x in groups if self.number in x[0]), key=lambda x: x[0][self.number]["min"])

    def first_since(self, seconds: float) -> int:
        at = pa.scalar(round(seconds * 1_000_000), pa.int64()).cast(pa.timestamp("us"))
        for statistics, group in self._groups():
            if statistics[self.stamp]["max"] >= at.as_py():
                return min(group.to_table(columns=[self.number], filter=ds.field(self.stamp) >= at).column(0).to_pylist())
        return self.last() + 1

    def last(self) -> int:
        return max((statistics[self.number]["max"] for statistics, _ in self._groups()), default=-1)

    def messages(self, low: int, high: int) -> Iterator[tuple]:
        field = ds.field(self.number)
        for b in ds.dataset(self.path, format="parquet").scanner(columns=self.fields, filter=(field >= low) & (field <= high)).to_batches():
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)
