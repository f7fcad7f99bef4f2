"""Best-fit-decreasing packing of token sequences into fixed windows.

Documents are encoded once and cut into full windows and one remainder; the pieces, ids and all, go to a table. Remainders
are dealt by a hash to groups of bounded size, and each group is packed by best-fit decreasing: the longest piece first,
into the open window that it leaves least room in. A segment tree over the remaining capacities finds that window.

Defined cases: a null or empty text is one end id; a text longer than a window becomes full windows, each a sequence of its
own, and a remainder, whatever its length (texts are encoded at_once rows or BYTES_AT_ONCE together, a longer one alone); repeated rows, also of one doc_id, are packed once per row; an empty table gives no rows; null doc_ids
are kept; other columns are left out, whatever their names. Of equal lengths, the smaller piece_id is placed first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import column, documents, give_back, slices, table
from tidelog.llm.encoding import ended, encoder

#: Remainders of about so many tokens and pieces are packed together.
GROUP_TOKENS, GROUP_PIECES = 4_000_000, 200_000
ENCODED_AT_ONCE = 3_000


class CapacityTree:
    """Open windows by remaining capacity. A node of the segment tree counts the open windows in its range of capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, capacity: int, by: int) -> None:
        node, count = capacity + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window of the least capacity that is at least need, with that capacity; None if there is none."""
        count, node = self.count, need + self.size
        while not count[node]:
            while node & 1:  # up, while a right child
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node *= 2
            node += not count[node]
        capacity = node - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """The window and the offset there of each piece, for lengths from 1 to window; ties in the given order."""
    tree, windows = CapacityTree(window), 0
    where, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        if found := tree.take(need):
            at, capacity = found
        else:
            at, capacity = windows, window
            windows += 1
        where[i], offsets[i] = at, window - capacity
        tree.put(capacity - need, at)
    return where, offsets


PIECES = pa.schema([("piece_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _cut(tokenizer: str, window: int, end: int, at_once: int, remembered: int | None):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, remembered)
        piece = TaskContext.get().partitionId() << 36
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), at_once):
                part, at = batch.slice(at, len(texts)), at + len(texts)
                ids, starts = ended(*enc.encode(texts), end)
                totals = np.diff(starts)
                counts = -(-totals // window)
                doc = np.repeat(np.arange(part.num_rows), counts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(totals[doc] - start, window)
                own = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(starts[doc] + start, starts[-1]).astype(np.int32) * np.int32(4)), pa.py_buffer(ids)])
                columns = [np.arange(piece, piece + len(doc)), part.column(0).take(pa.array(doc)), start, length, totals[doc], own]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)
                piece += len(doc)
        give_back()

    return run


def _placed(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece_id")
        where, offsets = best_fit_decreasing(group.column("length").to_pylist(), window)
        base = group.column("group")[0].as_py() << 32
        return pa.table({"piece_id": group.column("piece_id").cast(pa.int64()), "sequence_id": pa.array([base + w for w in where], pa.int64()), "offset": pa.array(offsets, pa.int64())})

    return run


@dataclass
class Packed:
    """pieces: piece_id, doc_id, start, length, doc_tokens, ids (binary, little-endian uint32). places: piece_id, sequence_id, offset."""

    pieces: DataFrame
    places: DataFrame
    window: int

    def rows(self, *columns) -> DataFrame:
        """The pieces with their places. columns: what to take of the pieces (all, ids too, if none); the rest isn't read or shuffled."""
        return self.pieces.select("piece_id", *(columns or self.pieces.columns[1:])).join(self.places, "piece_id")

    def sequences(self) -> DataFrame:
        """sequence_id, ids (binary, at most a window), used, doc_ids and lengths in order of offset."""
        own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
        return self.rows().groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("used"), F.col("own.doc_id").alias("doc_ids"), F.col("own.length").alias("lengths"))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", at_once: int = ENCODED_AT_ONCE, remembered: int | None = None) -> Packed:
    """Packs all docs into windows. tokenizer: a file of the tokenizers library. A full window gets a sequence of its own. at_once, remembered: texts encoded together and pieces that a worker remembers; fewer take less memory and more time, and give the same ids."""
    pieces = table(docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).mapInArrow(_cut(tokenizer, window, end, at_once, remembered), "piece_id long, doc_id long, start long, length long, doc_tokens long, ids binary"), "pieces")
    tails = pieces.filter(F.col("length") < window).select("piece_id", "length")
    rows, tokens = tails.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, math.ceil(rows / GROUP_PIECES), math.ceil(tokens / GROUP_TOKENS))
    packed = tails.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups))).groupBy("group").applyInArrow(_placed(window), "piece_id long, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == window).select("piece_id", (F.col("piece_id") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return Packed(pieces, packed.unionByName(full), window)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; a row per piece, its checksum taken from its ids."""
    import public_tokenizers

    packed = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.rows("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
