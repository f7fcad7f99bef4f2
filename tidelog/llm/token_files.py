"""Binary token files with Elias-Fano document boundaries.

A file holds the ids of its documents one after the other, then the documents' starts as an Elias-Fano code, then their
doc_ids, then a footer. Little-endian throughout:

    ids        n * width bytes (width 2 if every id of the vocabulary fits, else 4)
    low bits   m + 1 starts, l low bits each, packed from the lowest bit up
    high bits  unary code of the starts' high parts: bit (start >> l) + i is set for start i
    doc_ids    m * 8 bytes, signed, then m bits (one per document, packed): 1 if the doc_id is null
    footer     magic "TLEF", version u32 = 1, width u32, l u32, m u64, n u64, base u64, crc32 of the ids u32

m documents cost m * (2 + log2(n / m)) bits instead of 64 m. select(i) finds the i-th set high bit from a count kept for each
512 bits, and so the start of document i, without decoding the others.

Defined cases: a null or empty text is one end id; repeated doc_ids stay rows of their own, ordered by their texts' hashes;
null doc_ids come first; an empty table gives no file and no rows; other columns are left out, whatever their names; a text of any length is encoded whole and
stays in one file. Reading a whole file checks the CRC of its ids, and raises where it differs.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import column, documents, estimated_bytes, filesystem, fresh_dir, give_back, slices, table
from tidelog.llm.encoding import ended, encoder

MAGIC, VERSION = b"TLEF", 1
FOOTER = struct.Struct("<4sIIIQQQI")
BLOCK = 512
ENCODED_AT_ONCE = 2_000
#: A file holds the documents of about so many bytes of input, or fewer.
FILE_BYTES = 256 << 20


class EliasFano:
    """A non-decreasing sequence of integers below universe."""

    def __init__(self, low_width: int, count: int, low: bytes, high: bytes):
        self.l, self.count = low_width, count
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        padded = np.zeros(-(-len(self.high) * 8 // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(self.high)] = np.bitwise_count(self.high)
        self.before = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK // 8).sum(1, dtype=np.int64))])

    @staticmethod
    def low_bits(count: int, universe: int) -> int:
        return max(0, (universe // max(1, count)).bit_length() - 1)

    @classmethod
    def parts(cls, values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
        """The number of low bits, the low and the high bits of the values."""
        values = np.asarray(values, np.uint64)
        width = cls.low_bits(len(values), universe)
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        high = np.zeros(int(universe >> width) + len(values) + 1, np.uint8)
        high[((values >> np.uint64(width)) + np.arange(len(values), dtype=np.uint64)).astype(np.int64)] = 1
        return width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.l):
            at = i * self.l + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The value of index i."""
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        at = block * BLOCK + int(np.flatnonzero(bits)[i - int(self.before[block])])
        return (at - i) << self.l | int(self._low(np.array([i]))[0])

    def selects(self, start: int, end: int) -> np.ndarray:
        """The values of indices start to end - 1; reads only the blocks of high bits that hold them."""
        i = np.arange(start, end, dtype=np.int64)
        first, last = np.searchsorted(self.before, i[[0, -1]], side="right") - 1
        bits = np.unpackbits(self.high[first * BLOCK // 8 : (last + 1) * BLOCK // 8], bitorder="little")
        at = first * BLOCK + np.flatnonzero(bits)[i - self.before[first]]
        return (at - i) << self.l | self._low(i)

    def all(self) -> np.ndarray:
        i = np.arange(self.count, dtype=np.int64)
        return (np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count] - i) << self.l | self._low(i)


class Writer:
    """Streams one file; only the boundaries are held. The file gets its name when it is whole, so that a lost task leaves none."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = filesystem(uri)
        self.width, self.starts, self.ids, self.crc, self.total = width, [np.zeros(1, np.int64)], [], 0, 0
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> None:
        """Documents whose ids stand one after the other; starts: where each one's begin, and the end."""
        body = ids.astype(f"<u{self.width}").tobytes()
        self.crc = zlib.crc32(body, self.crc)
        self.out.write(body)
        self.starts.append(starts[1:] + self.total)
        self.total += len(ids)
        self.ids += doc_ids

    def close(self) -> None:
        width, low, high = EliasFano.parts(np.concatenate(self.starts), self.total)
        null = np.packbits(np.array([d is None for d in self.ids], np.uint8), bitorder="little").tobytes()
        for part in (low, high, np.array([d or 0 for d in self.ids], "<i8").tobytes(), null, FOOTER.pack(MAGIC, VERSION, self.width, width, len(self.ids), self.total, 0, self.crc)):
            self.out.write(part)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """One file: starts (Elias-Fano), doc_ids, and ids(i) of document i."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, version, self.width, low_width, self.count, self.total, _, self.crc = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path} is no token file of version {VERSION}")
        at = self.total * self.width
        low, high = -(-(self.count + 1) * low_width // 8), -(-((self.total >> low_width) + self.count + 2) // 8)
        rest = self.file.read_at(size - at - FOOTER.size, at)
        self.starts = EliasFano(low_width, self.count + 1, rest[:low], rest[low : low + high])
        ids = np.frombuffer(rest, "<i8", self.count, low + high)
        null = np.unpackbits(np.frombuffer(rest, np.uint8, -1, low + high + 8 * self.count), bitorder="little", count=self.count)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null, strict=True)]

    def span(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.starts.select(i), self.starts.select(i + 1))


def _writes(tokenizer: str, folder: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        width = 2 if max(enc.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        shard, out = TaskContext.get().partitionId(), None
        path = f"{folder}/shard-{shard:08d}.tlef"
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), ENCODED_AT_ONCE):
                out = out or Writer(path, width)
                ids, starts = ended(*enc.encode(texts), end)
                out.add(batch.column(0).slice(at, len(texts)).to_pylist(), ids, starts)
                at += len(texts)
        give_back()
        if out:
            out.close()
            yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": pa.array([path]), "documents": pa.array([len(out.ids)], pa.int64()), "tokens": pa.array([out.total], pa.int64())})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all docs in ascending doc_id order, a file for each range of doc_ids; gives the manifest: shard, path, documents, tokens, base (ids in the files before).
    The ranges come from Spark's range partitioning; a doc_id that many rows share is split by the texts' hashes and the rows' places. The manifest has a row per file."""
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(rows, "text") // FILE_BYTES))
    ordered = rows.repartitionByRange(files, *keys).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = table(ordered.mapInArrow(_writes(tokenizer, folder, end), "shard long, path string, documents long, tokens long"), "manifest")
    before, base = done.orderBy("shard").collect(), 0  # a row per file
    based = []
    for r in before:
        based.append((*r, base))
        base += r["tokens"]
    return done.sparkSession.createDataFrame(based, "shard long, path string, documents long, tokens long, base long")


def _reads(batches):
    for batch in batches:
        for row in batch.to_pylist():
            file, crc = Reader(row["path"]), 0
            for at in range(0, file.count, ENCODED_AT_ONCE):
                own = file.starts.selects(at, min(at + ENCODED_AT_ONCE, file.count) + 1)
                body = file.span(int(own[0]), int(own[-1]))
                crc, body = zlib.crc32(body, crc), body.astype("<u4")
                local = own - own[0]
                ids = [body[a:b].tobytes() for a, b in zip(local, local[1:], strict=False)]
                yield pa.record_batch({"doc_id": pa.array(file.doc_ids[at : at + ENCODED_AT_ONCE], pa.int64()), "start": pa.array(own[:-1] + row["base"], pa.int64()), "n_tokens": pa.array(np.diff(own), pa.int64()), "ids": pa.array(ids, pa.binary())})
            if crc != file.crc:
                raise ValueError(f"{row['path']}: the ids differ from their CRC")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32) of every document in the files; a task per file."""
    return manifest.select("path", "base").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(_reads, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads them back; a row per document."""
    import public_tokenizers

    manifest = write_token_files(documents(spark, sf_dir), fresh_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
