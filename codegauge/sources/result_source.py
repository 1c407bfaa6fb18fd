"""Task results as a Spark data source: ``spark.read.format("task_results")``.

A store is a folder of Parquet files under ``data`` and of commits under ``commits``.  Each
file holds rows of one model and run.  A commit is a small JSON file, numbered without
gaps, that names the files it adds; only what a commit names is ever read.

* Reading plans partitions from the commits alone.  The options ``model_id``, ``run_from``
  and ``run_to`` choose files, ``latest`` keeps each model's newest run; files of other
  runs are not opened.  Files are cut at their row groups.  The choice is part of the
  relation: Spark 4.1 keeps the filters it pushes to a Python source once per relation, so
  a frame that is filtered in two ways, or joined with itself, would read the wrong files.
* Writing has two phases.  Tasks write files nobody knows of; the driver publishes them in
  one commit, which takes the next number only if nobody else has it, or tries the one after.
  A failed job deletes its files and leaves no commit.
* A stream reads commits by number.  A stream that writes names itself
  (``option("stream", ...)``): a batch that is run again finds its commit and adds nothing.

Paths are those of ``pyarrow.fs``: a folder all machines share, or the address of a store.
Publishing needs a file system that links or renames without replacing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codegauge.sources.results import RUN_COLUMNS, STORED_RESULT

NAME = "task_results"
#: Bytes of a read partition, rows of a row group, rows handed to Spark at once.
PARTITION_BYTES = 64 << 20
GROUP_ROWS = 50_000
READ_ROWS = 10_000


@dataclass
class ResultFile:
    """A file of one model and run."""

    path: str
    model_id: str | None
    run_ts: str | None
    rows: int
    #: (bytes, rows) of each row group
    groups: list[tuple[int, int]]


class Store:
    """Files and commits of one folder."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        else:
            self.fs, self.root = pafs.LocalFileSystem(), path
        self.root = self.root.rstrip("/")

    def numbers(self) -> list[int]:
        """Numbers of the commits, in order."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _place(self, number: int) -> str:
        return f"{self.root}/commits/{number:020d}.json"

    def commit_of(self, number: int) -> dict:
        with self.fs.open_input_stream(self._place(number)) as stream:
            return json.loads(stream.read())

    def files(self, after: int = -1, upto: int | None = None) -> list[ResultFile]:
        """Files of the commits with numbers in (after, upto]."""
        wanted = [n for n in self.numbers() if n > after and (upto is None or n <= upto)]
        return [ResultFile(**{**f, "groups": [tuple(g) for g in f["groups"]]}) for n in wanted for f in self.commit_of(n)["files"]]

    def publish(self, commit: dict) -> int:
        """Write a commit under the next free number."""
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        hidden = f"{self.root}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as stream:
            stream.write(json.dumps(commit).encode())
        number = max(self.numbers(), default=-1) + 1
        while not self._take(hidden, self._place(number)):
            number += 1
        return number

    def _take(self, hidden: str, place: str) -> bool:
        """Give a finished file its name unless there is one of that name."""
        if isinstance(self.fs, pafs.LocalFileSystem):
            try:
                os.link(hidden, place)
            except FileExistsError:
                return False
            os.unlink(hidden)
            return True
        if self.fs.get_file_info(place).type != pafs.FileType.NotFound:
            return False
        try:
            self.fs.move(hidden, place)
        except OSError:
            if self.fs.get_file_info(place).type == pafs.FileType.NotFound:
                raise
            return False
        return True


class OpenFile:
    """A Parquet file that is being written."""

    def __init__(self, store: Store, schema: pa.Schema, model_id: str | None, run_ts: str | None):
        store.fs.create_dir(f"{store.root}/data", recursive=True)
        self.name = f"data/{uuid.uuid4().hex}.parquet"
        self.key, self.rows = (model_id, run_ts), 0
        self.stream = store.fs.open_output_stream(f"{store.root}/{self.name}")
        self.writer = pq.ParquetWriter(self.stream, schema, compression="zstd")
        self.held: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.rows += rows.num_rows
        if sum(b.num_rows for b in self.held) >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP_ROWS)
            self.held = []

    def close(self) -> ResultFile:
        self._flush()
        self.writer.close()
        self.stream.close()
        about = self.writer.writer.metadata
        groups = [(about.row_group(k).total_byte_size, about.row_group(k).num_rows) for k in range(about.num_row_groups)]
        return ResultFile(self.name, *self.key, self.rows, groups)


@dataclass
class Piece(InputPartition):
    """Row groups of files: (file, first group, group after the last)."""

    parts: list[tuple[str, int, int]]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


def plan(files: list[ResultFile], target: int = PARTITION_BYTES) -> list[Piece]:
    """Pieces of about ``target`` bytes, cut at row groups."""
    pieces, parts, size = [], [], 0
    for file in files:
        first = 0
        for k, (n_bytes, _) in enumerate(file.groups):
            if size and size + n_bytes > target:
                if k > first:
                    parts.append((file.path, first, k))
                pieces.append(Piece(parts))
                parts, size, first = [], 0, k
            size += n_bytes
        if len(file.groups) > first:
            parts.append((file.path, first, len(file.groups)))
    return pieces + ([Piece(parts)] if parts else [])


def read_piece(path: str, piece: Piece, schema: StructType) -> Iterator[pa.RecordBatch]:
    store, wanted = Store(path), to_arrow_schema(schema)
    for name, first, last in piece.parts:
        with store.fs.open_input_file(f"{store.root}/{name}") as stream:
            file = pq.ParquetFile(stream)
            # one row group in memory at a time, only the columns asked for
            for batch in file.iter_batches(READ_ROWS, list(range(first, last)), columns=wanted.names):
                yield pa.Table.from_batches([batch]).select(wanted.names).cast(wanted).combine_chunks().to_batches()[0]


@dataclass(frozen=True)
class Choice:
    """Which files a reader wants; no bound means all."""

    model_id: str | None = None
    run_from: str | None = None
    run_to: str | None = None
    latest: bool = False

    def of(self, files: list[ResultFile]) -> list[ResultFile]:
        if self.model_id is not None:
            files = [f for f in files if f.model_id == self.model_id]
        if self.latest:  # of all rows of a model, so bounds on runs come after it
            newest: dict[str | None, str] = {}
            for file in files:
                newest[file.model_id] = max(newest.get(file.model_id) or "", file.run_ts or "")
            files = [f for f in files if (f.run_ts or "") == newest[f.model_id]]
        if self.run_from is not None:
            files = [f for f in files if f.run_ts is not None and f.run_ts >= self.run_from]
        if self.run_to is not None:
            files = [f for f in files if f.run_ts is not None and f.run_ts <= self.run_to]
        return files


class ResultReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, choice: Choice):
        self.path, self.schema, self.choice = path, schema, choice

    def partitions(self) -> list[Piece]:
        return plan(self.choice.of(Store(self.path).files())) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(self.path, partition, self.schema)


class ResultStream(DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max(Store(self.path).numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return plan(Store(self.path).files(start["commit"], end["commit"])) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(self.path, partition, self.schema)

    def commit(self, end: dict) -> None:
        """Commits stay: other readers may need them."""


@dataclass
class Written(WriterCommitMessage):
    files: list[ResultFile]


class _Writing:
    """What batch and stream writers share."""

    def __init__(self, path: str, schema: StructType, stream: str | None = None):
        missing = [c for c in RUN_COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"results need the columns {missing}")
        self.path, self.schema, self.stream = path, to_arrow_schema(schema), stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of one task: one for each model and run, open at once."""
        store, opened = Store(self.path), {}
        for batch in iterator:
            rows = pa.Table.from_batches([batch]).cast(self.schema)
            runs = rows.select(RUN_COLUMNS).group_by(RUN_COLUMNS).aggregate([]).to_pylist()
            for run in runs:
                key = tuple(run[c] for c in RUN_COLUMNS)
                part = rows
                for column, value in zip(RUN_COLUMNS, key):
                    part = part.filter(pc.is_null(part[column]) if value is None else pc.equal(part[column], value))
                if key not in opened:
                    opened[key] = OpenFile(store, self.schema, *key)
                for piece in part.to_batches():
                    opened[key].add(piece)
        return Written([file.close() for file in opened.values()])

    def _publish(self, messages: list[Written | None], **about) -> None:
        files = [vars(f) for m in messages if m for f in m.files]
        Store(self.path).publish({**about, "files": files})

    def _discard(self, messages: list[Written | None]) -> None:
        store = Store(self.path)
        for message in messages:
            for file in message.files if message else []:
                store.fs.delete_file(f"{store.root}/{file.path}")


class ResultWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._discard(messages)


class ResultStreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store = Store(self.path)
        mine = [c for c in map(store.commit_of, store.numbers()) if c.get("stream") == self.stream and c.get("batch") == batchId]
        if mine:  # this batch is run again after its commit
            self._discard(messages)
        elif any(m and m.files for m in messages):
            self._publish(messages, stream=self.stream, batch=batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._discard(messages)


class ResultSource(DataSource):
    """Options: ``path``; to read ``model_id``, ``run_from``, ``run_to`` and ``latest``; to write a stream ``stream``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return STORED_RESULT

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a store needs a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> ResultReader:
        bounds = [self.options.get(name) for name in ("model_id", "run_from", "run_to")]
        return ResultReader(self._path(), schema, Choice(*bounds, self.options.get("latest", "false").lower() == "true"))

    def streamReader(self, schema: StructType) -> ResultStream:
        return ResultStream(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        if overwrite:
            raise ValueError("results are appended: use mode('append')")
        return ResultWriter(self._path(), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> ResultStreamWriter:
        if "stream" not in self.options:
            raise ValueError("a stream that writes needs a name: option('stream', ...)")
        return ResultStreamWriter(self._path(), schema, self.options["stream"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ResultSource)


def append_to_store(results: DataFrame, path: str) -> None:
    """Append results in one commit.  Rows are rebalanced by run first, so that a task
    holds few runs and a run few files."""
    register(results.sparkSession)
    results.hint("rebalance", *RUN_COLUMNS).write.format(NAME).mode("append").save(path)


def read_store(
    spark: SparkSession, path: str, model_id: str | None = None, run_from: str | None = None,
    run_to: str | None = None, latest: bool = False,
) -> DataFrame:
    """Committed results of a model and of runs in a range (both ends count); with
    ``latest`` those of each model's newest run."""
    register(spark)
    chosen = {"model_id": model_id, "run_from": run_from, "run_to": run_to, "latest": str(latest).lower()}
    return spark.read.format(NAME).options(**{k: v for k, v in chosen.items() if v is not None}).load(path)


def read_store_stream(spark: SparkSession, path: str) -> DataFrame:
    """Results as they are committed."""
    register(spark)
    return spark.readStream.format(NAME).load(path)
