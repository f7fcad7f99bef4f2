"""Language-model scores from a log-frequency Bloom filter (after Talbot and Osborne, 2007).

Learning counts the words and the pairs of neighbouring words of all training texts exactly: tasks count what they read, the counts are dealt by
the n-gram's hash and added up. A count c is quantised to q = 1 + floor(log c / log BASE), and the filter holds the n-gram
with each of the marks 1 to q. Asking for mark 1, 2, ... until one is missing gives q back, never too small, and too large only where
all HASHES bits of the next mark happen to be set. The filter takes BITS bits a mark, whatever their number, and leaves no n-gram out. It is made of
segments by hash prefix, each built by one task, in the shared folder. No process holds it whole: a task gathers the n-grams of ASKED_TOKENS tokens,
and reads the segments one after the other to ask each for those of its prefix.

A text's score is the sum over its words, and one end, of log10 of MIX * pair + (1 - MIX) * word, where
    word(w)    = (c(w) + 1) / (N + V + 1)
    pair(w | h) = (c(h w) + k(h) word(w)) / (c(h) + k(h)),  k(h) = c(h) ** SPREAD
and the history h of the first word is an end. Quantised counts are rounded down for w and h w and up for h, so that the
probabilities add up to one at most but for false marks. The HEAD most frequent words' counts are broadcast exactly.

The base score is exact for every word: the words outside HEAD are joined with the table of all counts.

Defined cases: null and empty texts are one end; a null doc_id counts for training; no training text: N = V = 0; repeated rows
count and score each; a text of any length is counted and scored whole, by one task; an empty table gives no rows; other columns are left out, whatever their names. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import claim, column, documents, filesystem, fold, fresh_dir, give_back, slices, table
from tidelog.llm.words import hashed, mixed, words

HEAD = 1 << 18
BASE, HASHES, BITS = 1.5, 4, 10
MIX, SPREAD = 0.6, 0.8
FLUSH_TOKENS, ASKED_TOKENS, DOCS_AT_ONCE = 2_000_000, 4_000_000, 1_000
END = np.uint64(0x0E0D0E0D0E0D0E0D)
_ONE, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_key(h: np.ndarray) -> np.ndarray:
    return mixed(h + _ONE)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _FIRST + second * _SECOND)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and the end (the last), the index of each token, ends included, and where each text's tokens start, and the end."""
    distinct, of, starts = words(texts)
    n = np.arange(len(starts))
    out = np.full(len(of) + len(n) - 1, len(distinct), np.int64)
    stays = np.ones(len(out), bool)
    stays[starts[1:] + n[:-1]] = False
    out[stays] = of
    return np.append(hashed(distinct), END), out, starts + n


def before(token: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; an end before a text's first."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[starts[:-1]] = end
    return out


def short(keys: np.ndarray, prefix: int) -> np.ndarray:
    """The first `prefix` bits and the last 48 of keys of n-grams: what is stored of them, in six bytes of a known segment."""
    return keys & np.uint64(((1 << prefix) - 1) << (64 - prefix) | (1 << 48) - 1)


def packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes, part: int, prefix: int) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64(part << (64 - prefix))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with its counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count))."""
    return (1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9)).astype(np.uint8)


def least_of(q: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(q > 0, np.ceil(BASE ** (q.astype(float) - 1) - 1e-9), 0.0)


def most_of(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.ceil(BASE ** q.astype(float) - 1e-9) - 1, 0.0)


COUNTED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _counts(bits: int):
    """kind 0: words; kind 1: all n-grams, as keys of the filter. Keys are dealt by their first bits."""

    def flushed(kind: int, keys: np.ndarray, counts: np.ndarray):
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.record_batch([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int64()), pa.array([packed(own) if kind else own.tobytes() for own in (keys[cuts[p] : cuts[p + 1]] for p in some)], pa.binary()), pa.array([counts[cuts[p] : cuts[p + 1]].astype("<u4").tobytes() for p in some], pa.binary())], schema=COUNTED)

    def run(batches):
        claim("language_model")
        singles, pairs, held = [], [], 0

        def flush():
            keys, counts = added(np.concatenate([k for k, _ in singles]), np.concatenate([c for _, c in singles]))
            yield flushed(0, keys, counts)
            seen, times = np.unique(np.concatenate(pairs), return_counts=True)
            yield flushed(1, *added(np.concatenate([word_key(keys), seen]), np.concatenate([counts, times])))

        for batch in batches:
            for part in slices(batch.column(0), DOCS_AT_ONCE):
                h, token, starts = tokens(part)
                times = np.bincount(token, minlength=len(h))
                singles.append((h[times > 0], times[times > 0]))
                pairs.append(pair_key(h[before(token, starts, len(h) - 1)], h[token]))
                held += len(token)
                if held >= FLUSH_TOKENS:
                    yield from flush()
                    singles, pairs, held = [], [], 0
        if held:
            yield from flush()
        give_back()

    return run


def _words_of(group: pa.Table) -> pa.Table:
    keys, counts = added(np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64), np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u4").astype(np.int64))
    return pa.table({"h": pa.array(keys.view(np.int64)), "c": pa.array(counts)})


def _levels_of(prefix: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        keys, counts = added(unpacked(b"".join(group.column("keys").to_pylist()), part, prefix), np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u4").astype(np.int64))
        q = level(counts)
        return pa.table({"part": pa.array([part], pa.int64()), "keys": pa.array([packed(keys)], pa.binary()), "q": pa.array([q.tobytes()], pa.binary())})

    return run


def places(keys: np.ndarray, mark: int, n: int, size: np.ndarray | int) -> np.ndarray:
    """The bit of hash n of (key, mark) in a segment of so many bits."""
    return (mixed(keys + np.uint64((0x632BE59BD9B4E019 * mark + 0xD1342543DE82EF95 * (n + 1)) & (1 << 64) - 1)) % np.asarray(size, np.uint64)).astype(np.int64)


def segment(keys: np.ndarray, q: np.ndarray, least: int = 1) -> np.ndarray:
    """The bits, in bytes, of the keys of level least or more."""
    keys, q = keys[q >= least], q[q >= least]
    size = max(64, -(-int(q.sum(dtype=np.int64)) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for mark in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= mark]
        for n in range(HASHES):
            bits[places(own, mark, n, size)] = True
    return np.packbits(bits, bitorder="little")


def _segments(prefix: int):
    def run(batches):
        for batch in batches:
            for part, keys, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield pa.record_batch({"part": pa.array([part], pa.int64()), "bits": pa.array([segment(unpacked(keys, part, prefix), np.frombuffer(q, np.uint8)).tobytes()], pa.binary())})

    return run


@dataclass
class Filter:
    """Some segments. bits: one after the other; start, size: of each segment, in bits; prefix: of the keys' bits, how many name the segment."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    prefix: int

    def holds(self, keys: np.ndarray, mark: int) -> np.ndarray:
        """Which keys have the mark, by membership probes."""
        keys = short(keys, self.prefix)
        part = (keys >> np.uint64(64 - self.prefix)).astype(np.int64)
        start, size = self.start[part], self.size[part]
        alive = np.flatnonzero(size)
        for n in range(HASHES):
            at = start[alive] + places(keys[alive], mark, n, size[alive])
            alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        q, alive, mark = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(alive) and mark < 255:
            alive = alive[self.holds(keys[alive], mark)]
            q[alive] = mark
            mark += 1
        return q


def found(folder: str, prefix: int, keys: np.ndarray) -> np.ndarray:
    """The levels of keys by the filter of a folder of segments (part, bits), read one after the other."""
    import pyarrow.dataset as ds

    fs, path = filesystem(folder)
    keys = short(keys, prefix)
    order = np.argsort(keys)
    keys, q = keys[order], np.zeros(len(keys), np.uint8)
    cuts = np.searchsorted(keys >> np.uint64(64 - prefix), np.arange((1 << prefix) + 1, dtype=np.uint64))
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1, use_threads=False):
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
            own, size = slice(cuts[part], cuts[part + 1]), np.zeros(1 << prefix, np.int64)
            size[part] = 8 * len(bits.as_buffer())
            q[own] = Filter(np.frombuffer(bits.as_buffer(), np.uint8), np.zeros_like(size), size, prefix).levels(keys[own])
    out = np.empty_like(q)
    out[order] = q
    return out


@dataclass
class Model:
    folder: str  # of the filter's segments
    prefix: int
    head: np.ndarray  # hashes, ascending
    head_counts: np.ndarray
    n: int
    v: int
    words: DataFrame  # h, c: all training tokens

    def exact(self, h: np.ndarray) -> np.ndarray:
        """The counts of words in the head, -1 for others."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.searchsorted(self.head, h).clip(0, len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_counts[at], -1)


def learn(texts: DataFrame, text: str = "text") -> Model:
    """Counts all texts and builds the filter."""
    spark = texts.sparkSession
    rows = texts.select(column(text).cast("string").alias("text"))
    bits = max(4, math.ceil(math.log2(2 * max(1, rows.rdd.getNumPartitions()))))
    counted = table(rows.mapInArrow(_counts(bits), "kind int, part long, keys binary, counts binary"), "counts")
    vocabulary = table(counted.filter("kind = 0").groupBy("part").applyInArrow(_words_of, "h long, c long"), "vocabulary")
    leveled = table(counted.filter("kind = 1").groupBy("part").applyInArrow(_levels_of(bits), "part long, keys binary, q binary"), "levels")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    folder = fresh_dir(spark, "filter")
    leveled.select("part", "keys", "q").mapInArrow(_segments(bits), "part long, bits binary").write.option("compression", "none").parquet(folder)
    top = vocabulary.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()  # HEAD rows
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return Model(folder, bits, h[order], c[order], n, v, vocabulary)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, score double, rare array<long>, times array<int>"


@dataclass
class Asked:
    """Some texts (doc_id, held_out) and the n-grams to look for: the rare words, then the distinct pairs."""

    rows: pa.RecordBatch
    h: np.ndarray
    token: np.ndarray
    starts: np.ndarray
    exact: np.ndarray
    keys: np.ndarray
    pair: np.ndarray  # of each token, the place of its pair among the pairs

    @classmethod
    def of(cls, part: pa.RecordBatch, model: Model) -> Asked:
        h, token, starts = tokens(part.column(2))
        exact = model.exact(h)
        pairs, pair = np.unique(pair_key(h[before(token, starts, len(h) - 1)], h[token]), return_inverse=True)
        return cls(part.select([0, 1]), h, token.astype(np.int32), starts, exact, np.concatenate([word_key(h[exact < 0]), pairs]), pair.astype(np.int32))

    def scored(self, levels: np.ndarray, uid: int, total: int) -> pa.RecordBatch:
        h, token, starts, exact, n = self.h, self.token, self.starts, self.exact, self.rows.num_rows
        rare = exact < 0
        q = np.zeros(len(h), np.uint8)
        q[rare], of_pair = np.split(levels, [np.count_nonzero(rare)])
        low, high = np.where(rare, least_of(q), exact), np.where(rare, most_of(q), exact)
        single = (low + 1) / total
        spread = np.maximum(high, 1.0) ** SPREAD
        history = before(token, starts, len(h) - 1)
        pair = (least_of(of_pair[self.pair]) + spread[history] * single[token]) / (high[history] + spread[history])
        score = np.add.reduceat(np.log10(MIX * pair + (1 - MIX) * single[token]), starts[:-1])
        common = np.log10(single) * ~rare
        doc = np.repeat(np.arange(n), np.diff(starts))
        of_rare = rare[token]
        packed, times = np.unique(doc[of_rare] * len(h) + token[of_rare], return_counts=True)
        offsets = pa.array(np.searchsorted(packed // len(h), np.arange(n + 1)), pa.int32())
        return pa.record_batch({"uid": pa.array(np.arange(uid, uid + n)), "doc_id": self.rows.column(0), "held_out": self.rows.column(1), "n_tokens": pa.array(np.diff(starts).astype(np.int64)), "head_known": pa.array(np.add.reduceat((exact > 0)[token].astype(np.int64), starts[:-1])), "head_base": pa.array(np.add.reduceat(common[token], starts[:-1])), "score": pa.array(score), "rare": pa.ListArray.from_arrays(offsets, pa.array(h[packed % len(h)].view(np.int64))), "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))})


def _scores(shared):
    def run(batches):
        from pyspark import TaskContext

        claim("language_model")
        model, held, n = shared.value, [], 0
        uid, total = TaskContext.get().partitionId() << 36, model.n + model.v + 1

        def flush():
            nonlocal uid
            levels, at = found(model.folder, model.prefix, np.concatenate([a.keys for a in held])), 0
            for asked in held:
                yield asked.scored(levels[at : at + len(asked.keys)], uid, total)
                at += len(asked.keys)
                uid += asked.rows.num_rows

        for batch in batches:
            at = 0
            for part in slices(batch.column(2), DOCS_AT_ONCE):
                held.append(Asked.of(batch.slice(at, len(part)), model))
                at += len(part)
                n += len(held[-1].token)
                if n >= ASKED_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()
        give_back()

    return run


def score(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), column(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(Model(model.folder, model.prefix, model.head, model.head_counts, model.n, model.v, None))
    scored = table(rows.mapInArrow(_scores(shared), SCORED), "scores")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    counted = rare.join(model.words, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.lit(float(model.n + model.v + 1))
    sums = counted.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / total)).alias("base"))
    whole = scored.select("uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "score").join(sums, "uid", "left")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 2 of 7."""
    docs, held_out = documents(spark, sf_dir), fold("doc_id", 7) == 2
    return score(docs, learn(docs.filter(~held_out)), held_out)
