"""The Spark data source "telemetrylog": batch and streaming reads and writes of one log.

Reading splits the log into ranges of whole records; a task decodes its range with numpy and hands Arrow batches on. Options:
    path        the log
    from_index, to_index   read records [from, to) only: a seek, since records have a fixed size
    only_bad    "true" gives just the rows that break the log (and the partial tail), for validation
    task_records   records in a task (1,000,000)
Writing stages one file a task; the driver checks that the sequences run on without a gap, appends the parts in order and commits.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.functions import layout, schema
from tidelog.sources.files import local, opened
from tidelog.sources.log_writer import LogWriter, Options

BATCH_RECORDS = 100_000


@dataclass
class Range(InputPartition):
    start: int
    end: int
    tail: bool = False


def shape(path: str) -> tuple[int, bytes, int, int]:
    """The log's size, its first 24 bytes, its whole records and the first one's sequence."""
    with opened(path) as f:
        size = f.size()
        head = f.read_at(min(size, layout.HEADER_BYTES + layout.RECORD_BYTES), 0)
    whole = max(0, size - layout.HEADER_BYTES) // layout.RECORD_BYTES
    first = int(layout.decode(head[layout.HEADER_BYTES :])["sequence"][0]) if whole else 0
    return size, head[: layout.HEADER_BYTES], whole, first


def checked(records: np.ndarray, start: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """meta_ok, crc_ok, seq_ok of records from index start on. A record is in sequence where it is first + index, without passing the largest unsigned number; so no record needs its neighbour."""
    index = np.arange(start, start + len(records), dtype=np.uint64)
    fits = index <= np.uint64(layout.U64_MAX - first)
    return layout.meta_ok(records), layout.crcs(records) == records["crc32"], fits & (records["sequence"] == np.uint64(first) + index)


class LogReader(DataSourceReader):
    def __init__(self, options: dict, of: StructType):
        self.path, self.schema = options["path"], to_arrow_schema(of)
        self.size, head, self.whole, self.first = shape(self.path)
        if fault := layout.header_fault(head):
            raise ValueError(f"{self.path}: {fault}")
        self.only_bad = options.get("only_bad", "false").lower() == "true"
        self.low, self.high = int(options.get("from_index", 0)), min(self.whole, int(options.get("to_index", self.whole)))
        self.tail = "to_index" not in options
        self.each = int(options.get("task_records", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        ranges = [Range(i, min(self.high, i + self.each)) for i in range(self.low, self.high, self.each)]
        return [*ranges, Range(self.whole, self.whole, True)] if self.tail and (self.size - layout.HEADER_BYTES) % layout.RECORD_BYTES or not ranges else ranges

    def read(self, part: Range):
        with opened(self.path) as f:
            for at in range(part.start, part.end, BATCH_RECORDS):
                n = min(part.end, at + BATCH_RECORDS) - at
                yield from self._batch(layout.decode(f.read_at(n * layout.RECORD_BYTES, layout.HEADER_BYTES + at * layout.RECORD_BYTES)), at)
            if part.tail:
                yield from self._tail(f)

    def _batch(self, r: np.ndarray, at: int):
        meta, crc, seq = checked(r, at, self.first)
        index = np.arange(at, at + len(r))
        columns = [r["sequence"].astype(np.int64), r["timestamp_us"].astype(np.int64), *[r[n].astype(np.float64) for n, _ in layout.PAYLOAD[:-1]], r["system_status"].astype(np.int64), index, layout.HEADER_BYTES + index * layout.RECORD_BYTES, meta, r["crc32"].astype(np.int64), crc, seq, pa.nulls(len(r), pa.string())]
        batch = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=self.schema)
        yield batch.filter(pa.array(~(meta & crc & seq))) if self.only_bad else batch

    def _tail(self, f):
        at = layout.HEADER_BYTES + self.whole * layout.RECORD_BYTES
        rest = f.read_at(self.size - at, at)
        if not rest:
            return
        r = layout.decode(rest.ljust(layout.RECORD_BYTES, b"\0"))
        whole_header = len(rest) >= layout.RECORD_HEADER_BYTES
        meta = bool(layout.meta_ok(r)[0]) if whole_header else True
        kind = "header" if not whole_header else "payload" if len(rest) < 80 else "crc"
        row = dict.fromkeys(self.schema.names) | {"sequence": int(r["sequence"].astype(np.int64)[0]) if whole_header else None, "record_index": self.whole, "byte_offset": at, "meta_ok": meta, "crc_ok": False, "seq_ok": False, "tail_kind": kind}
        yield pa.RecordBatch.from_pylist([row], schema=self.schema)


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int
    last: int
    count: int


def staged(batches, folder: str) -> Part:
    """Encodes a task's rows, ascending by sequence, to a file of its own."""
    os.makedirs(folder, exist_ok=True)
    path, first, last, count = f"{folder}/{uuid.uuid4().hex}", 0, 0, 0
    with open(path, "wb") as out:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in layout.COLUMNS}
            seq = columns["sequence"].astype(np.uint64)
            if (np.diff(seq) != 1).any() or (count and int(seq[0]) != last + 1):
                raise ValueError("sequences must run on without a gap")
            first, last, count = first if count else int(seq[0]), int(seq[-1]), count + len(seq)
            out.write(layout.encode(columns))
        out.flush()
        os.fsync(out.fileno())
    return Part(path, first, last, count)


def appended(path: str, parts: list[Part], options: Options, start_us: int | None) -> None:
    """The parts in order of sequence; each of sync_every_batches batches is a commit, and what is left at the end."""
    parts = sorted((p for p in parts if p is not None and p.count), key=lambda p: p.first)
    if any(b.first != a.last + 1 for a, b in zip(parts, parts[1:], strict=False)):
        raise ValueError("sequences must run on without a gap")
    writer = LogWriter(path, options, start_us=start_us)
    size = options.batch_capacity * layout.RECORD_BYTES
    ok = writer.open()
    for p in parts:
        with open(p.path, "rb") as f:
            while ok and (data := f.read(size)):
                ok = writer.append_encoded(data)
    if not (writer.close() and ok):
        raise OSError(f"{path}: the records weren't committed")


def _options(options: dict) -> tuple[str, str, Options, int | None]:
    path = local(options["path"])
    start = options.get("start_us")
    return path, f"{path}.staging", Options(int(options.get("batch_capacity", 65_536)), int(options.get("sync_every_batches", 64))), int(start) if start else None


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.folder, self.options, self.start_us = _options(options)
        self.folder += f"-{uuid.uuid4().hex}"
        self.overwrite = overwrite

    def write(self, iterator):
        return staged(iterator, self.folder)

    def commit(self, messages):
        if self.overwrite:
            for p in (self.path, layout.journal_path(self.path)):
                if os.path.exists(p):
                    os.remove(p)
        appended(self.path, messages, self.options, self.start_us)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.folder, ignore_errors=True)


class StreamWriter(DataSourceStreamArrowWriter):
    """A micro-batch is committed as a whole. One that the log already holds (a repeated batch after a restart) is left out."""

    def __init__(self, options: dict):
        self.path, self.folder, self.options, self.start_us = _options(options)

    def write(self, iterator):
        return staged(iterator, self.folder)

    def commit(self, messages, batchId):
        parts = [p for p in messages if p is not None and p.count]
        held = 0
        if os.path.exists(self.path):
            _, _, whole, first = shape(self.path)
            held = first + whole - 1 if whole else 0
        if parts and max(p.last for p in parts) > held:
            appended(self.path, parts, self.options, self.start_us)
        self.abort(messages, batchId)

    def abort(self, messages, batchId):
        for p in messages:
            if p is not None and os.path.exists(p.path):
                os.remove(p.path)


class StreamReader(DataSourceStreamReader):
    """Records as the journal commits them. max_records bounds what a micro-batch adds under a trigger that goes on; with availableNow, which asks for an end once, it bounds the whole run, so leave it out there."""

    def __init__(self, options: dict, of: StructType):
        self.options, self.of = dict(options), of
        self.most, self.reached = int(options.get("max_records", layout.U64_MAX)), 0

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        journal = layout.journal_path(self.options["path"])
        held = 0
        if os.path.exists(local(journal)):
            with open(local(journal), "rb") as f:
                raw = f.read()
            if len(raw) == layout.JOURNAL_BYTES:
                held = max([0, *(s["record_count"] for s in layout.slots(raw) if s["slot_valid"])])
        self.reached = min(held, self.reached + self.most)
        return {"records": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = max(self.reached, end["records"])
        each = int(self.options.get("task_records", 1_000_000))
        return [Range(i, min(end["records"], i + each)) for i in range(start["records"], end["records"], each)]

    def read(self, part: Range):
        yield from LogReader(self.options, self.of).read(part)


class TelemetryLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetrylog"

    def schema(self) -> str:
        return schema.RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TelemetryLog)
