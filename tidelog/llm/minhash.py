"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles. Each shingle's hash names one of REGISTERS buckets; of the least hash of a
bucket, a register keeps the count of leading zeros (6 bits) and the MANTISSA bits after the first one: 16 bits in place of 64.
Bands of four registers are the join keys. Empty buckets borrow another bucket's register for the bands, along a fixed random
sequence, so that small sets band as large ones do. Pairs that share a band go on if their set sizes allow the similarity and if
the estimate from equal registers, less the expected accidental ones, comes within SIGMAS deviations of it. What is left is
confirmed on the full shingle sets.

Equal sets are one class from the start, so copies never meet each other. In a bucket of a band, each class is compared with
one leader, the first of them in one order for all bands; a class first with the first of its leaders, then, together with what follows, with those that are still
in other components. A group of near copies mostly has the same few leaders in all its bands, so a class has one pair or a few to compare, not one for each band. Links from these give components. Where a bucket of three or more holds more than
one component, its pairs across components are compared: all of a small bucket's; of a large one's, in tiles of bounded size, first the likeliest
partner of each member, and then all that are left inside the tiles, which carry the sets, compare them whole and return a
link for each two components that meet. So a large group of near copies costs a few comparisons a member, and no
pair that shares a band and may change a component goes untested. New links join the components found before; those are not found again.

Four registers a band and 32 bands find a pair of similarity 0.8 but for about one in 10^7 (0.59^32).

Skew: a bucket, a leader or a text that many rows share is a key of many rows in inner or left joins only, which Spark splits
by its skew join; aggregations by such keys start inside the tasks. A task holds one tile, of TILE members and TILE_SHINGLES shingles a side,
or one text: a text of any length is shingled whole, alone once it is longer than BYTES_AT_ONCE.

Defined cases: null text, or text without words, has the empty set and links with nothing; with fewer words than a shingle has,
the whole sequence is the one shingle; repeated rows link as equal sets do; a null doc_id takes part, and a component of null
doc_ids alone has a null component_id; an empty table gives no rows; other columns are left out. Shingles are known by
64-bit hashes, of which a pair's sets hold few; equal sets and texts are known by 128 bits, since those of all documents meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import claim, column, documents, give_back, slices, table, whole
from tidelog.llm.graph import components, joined
from tidelog.llm.words import hashed, mixed, words

REGISTERS, BITS, MANTISSA = 256, 8, 10
BAND, BANDS = 4, 32
SIGMAS = 4.5
#: Share of the registers of unequal items that agree by accident, times 2^(mantissa bits): the published constant of HyperMinHash.
ACCIDENT = 0.169919487159739
SMALL_BUCKET, TILE, TILE_SHINGLES = 32, 1024, 1_000_000
TEXTS_AT_ONCE = 500
#: Partners of each member of a large bucket that are compared first.
PARTNERS = 1
#: Up to so many keys of texts are broadcast to find the texts again (24 bytes each).
BROADCAST_KEYS = 500_000


def scramble(place: int) -> np.uint64:
    """The odd factor of a shingle's word at a place, a different one for each place."""
    return mixed(np.array([place + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


def shingles(w: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles' hashes of a text's words' hashes, ascending, so that those of a bucket (the first BITS bits) stand together, least first."""
    if not len(w):
        return np.empty(0, np.uint64)
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += w[j : j + n] * scramble(j)
    return np.unique(mixed(h + np.uint64(width)))


def shingled(texts: pa.Array, width: int):
    """The shingles of each text."""
    for part in slices(texts, TEXTS_AT_ONCE):
        distinct, of, starts = words(part)
        w = hashed(distinct)[of]
        for a, b in zip(starts, starts[1:], strict=False):
            yield shingles(w[a:b], width)


def digest(own: np.ndarray) -> bytes:
    """What a set is known by: 128 bits."""
    return xxhash.xxh3_128_digest(own.tobytes())


def text_key(text: Column) -> Column:
    """What a text is known by: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def registers(ordered: np.ndarray) -> np.ndarray:
    """The sketch of a set: (leading zeros + 1) << MANTISSA | mantissa of each bucket's least hash, 0 where there is none. The bucket is the hash's top BITS bits."""
    rest = np.uint64(64 - BITS)
    buckets = ordered >> rest
    first = np.concatenate([[True], buckets[1:] != buckets[:-1]]) if len(ordered) else np.empty(0, bool)
    least = ordered[first] & ((np.uint64(1) << rest) - np.uint64(1))
    zeros = (64 - BITS - np.frexp(least.astype(np.float64))[1]).clip(0, 62).astype(np.uint64)
    fraction = (least << (zeros + np.uint64(BITS + 1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    out[buckets[first].astype(np.int64)] = (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | fraction).astype(np.uint16)
    return out


_TRIES = np.stack([np.random.default_rng(7 + t).integers(0, REGISTERS, BAND * BANDS) for t in range(24)])


def dense(sketch: np.ndarray) -> np.ndarray:
    """The registers of the bands, empty ones filled from the first non-empty one along a fixed sequence for each."""
    out = sketch[: BAND * BANDS].copy()
    for tries in _TRIES:
        empty = np.flatnonzero(out == 0)
        if not len(empty):
            return out
        out[empty] = sketch[tries[empty]]
    if len(empty := np.flatnonzero(out == 0)):
        full = np.flatnonzero(sketch)
        order = mixed(empty[:, None].astype(np.uint64) * np.uint64(REGISTERS) + full[None, :].astype(np.uint64))
        out[empty] = sketch[full[order.argmin(1)]]
    return out


def _sketches(width: int):
    def run(batches):
        claim("minhash")
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for own in shingled(batch.column(2), width):
                sketch = registers(own)
                values = (len(own), digest(own), sketch.tobytes(), dense(sketch).tobytes()) if len(own) else (0, None, None, None)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.record_batch({"doc_id": batch.column(0), "tkey": batch.column(1), "n_shingles": pa.array(rows[0], pa.int64()), "digest": pa.array(rows[1], pa.binary()), "sketch": pa.array(rows[2], pa.binary()), "dense": pa.array(rows[3], pa.binary())})
        give_back()

    return run


def _sets(width: int):
    def run(batches):
        claim("minhash")
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), TEXTS_AT_ONCE):
                own = pa.array([s.view(np.int64) for s in shingled(part, width)], pa.list_(pa.int64()))
                yield pa.record_batch({"cls": batch.column(0).slice(at, len(part)), "members": own})
                at += len(part)
        give_back()

    return run


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of sketches (rows of registers) of sets of n_a and n_b items, and how many registers it rests on."""
    used = ((a != 0) | (b != 0)).sum(-1)
    equal = ((a == b) & (a != 0)).sum(-1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    by_chance = ACCIDENT * used / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (equal - by_chance) / np.maximum(1, used), used


def may_reach(similarity: float, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    est, used = estimate(a, b, n_a, n_b)
    return est >= similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) / np.maximum(1, used)) - 0.5 / np.maximum(1, used)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _near(similarity: float):
    def run(batches):
        for batch in batches:
            ok = may_reach(similarity, _matrix(batch.column("sketch_x")), _matrix(batch.column("sketch_y")), batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy())
            yield batch.select(["x", "y", "n_x", "n_y"]).filter(pa.array(ok))
        give_back()

    return run


def _rivals(x: int, rows: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """Those of rows that are in another component than x and may be similar to it."""
    rows = rows[(comp[rows] != comp[x]) & (np.minimum(n[rows], n[x]) >= similarity * np.maximum(n[rows], n[x]) - 1e-9)]
    return rows[may_reach(similarity, sketch[x][None], sketch[rows], n[x], n[rows])] if len(rows) else rows


def _likeliest(similarity: float):
    """For each member of a tile that has rivals in it, unless it belongs to the tile's largest component, the PARTNERS ones of best estimate: x < y, and whether there are more.
    Members of the largest component have a row without a pair: their rivals look for them."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("cls")
        cls, comp, n, chunk = (tile.column(c).to_numpy() for c in ("cls", "comp", "n", "chunk"))
        sketch, key = _matrix(tile.column("sketch")), tile.column("key")[0].as_py()
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        named, sizes = np.unique(comp, return_counts=True)
        largest = named[sizes.argmax()]
        sides, found = [np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)], []
        for own, others in (sides,) if i == j else (sides, sides[::-1]):
            for x in own:
                to = _rivals(x, others, comp, n, sketch, similarity)
                if not len(to):
                    continue
                if comp[x] == largest:
                    found.append((key, cls[x], None, None, False))
                    continue
                if more := len(to) > PARTNERS:
                    to = to[np.lexsort((cls[to], -estimate(sketch[x][None], sketch[to], n[x], n[to])[0]))[:PARTNERS]]
                found += [(key, cls[x], min(cls[x], c), max(cls[x], c), more) for c in cls[to]]
        return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["key", "member", "x", "y", "more"])

    return run


def _linked(similarity: float, percent: int):
    """Compares all rivals of a tile on their whole sets; a link for each two components that meet in one."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("cls")
        cls, comp, n, chunk = (tile.column(c).to_numpy() for c in ("cls", "comp", "n", "chunk"))
        comp, sketch = comp.copy(), _matrix(tile.column("sketch"))
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        sets = tile.column("members_of").combine_chunks()
        ends, (universe, of) = sets.offsets.to_numpy().astype(np.int64), np.unique(sets.flatten().to_numpy(), return_inverse=True)
        ends = ends - ends[0]
        there, found = np.zeros(len(universe), np.int32), []
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        for x in left:
            to = _rivals(x, right[right > x] if i == j else right, comp, n, sketch, similarity)
            if not len(to):
                continue
            own = of[ends[x] : ends[x + 1]]
            there[own] = 1
            at = np.concatenate([of[ends[y] : ends[y + 1]] for y in to])
            shared = np.add.reduceat(there[at], np.concatenate([[0], np.cumsum(ends[to + 1] - ends[to])[:-1]]))
            there[own] = 0
            for y in to[100 * shared >= percent * (n[x] + n[to] - shared)]:
                if comp[y] != comp[x]:
                    found.append((min(cls[x], cls[y]), max(cls[x], cls[y])))
                    comp[comp == comp[y]] = comp[x]
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["x", "y"])

    return run


def _texts(ends: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, text: one text of each class of ends (cls)."""
    keys = table(classes.select("cls", "tkey").join(ends, "cls"), "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, "tkey").groupBy("cls").agg(F.first("text").alias("text")).select("cls", "text")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (x, y of classes, x < y), those that are similar enough, on the full sets of their texts."""
    similarity = percent / 100
    own = classes.select("cls", F.col("n_shingles").alias("n"), "sketch")
    sides = pairs.join(own.select(F.col("cls").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("sketch_x")), "x").join(own.select(F.col("cls").alias("y"), F.col("n").alias("n_y"), F.col("sketch").alias("sketch_y")), "y")
    sized = sides.filter(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    near = table(sized.mapInArrow(_near(similarity), "x long, y long, n_x long, n_y long"), "candidates")
    ends = near.select(F.col("x").alias("cls")).unionByName(near.select(F.col("y").alias("cls"))).distinct()
    sets = table(_texts(ends, classes, docs).mapInArrow(_sets(width), "cls long, members array<long>"), "sets")
    both = near.join(sets.select(F.col("cls").alias("x"), F.col("members").alias("in_x")), "x").join(sets.select(F.col("cls").alias("y"), F.col("members").alias("in_y")), "y")
    shared = F.size(F.array_intersect("in_x", "in_y")).cast("long")
    return both.select("x", "y", "n_x", "n_y", shared.alias("shared")).filter(100 * F.col("shared") >= percent * (F.col("n_x") + F.col("n_y") - F.col("shared"))).select("x", "y")


def _pair(a: str, b: str) -> tuple[Column, Column]:
    """Two classes as x < y."""
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def _apart(led: DataFrame, roots: DataFrame) -> DataFrame:
    """cls, leader: those of different components."""
    of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    return led.join(of("cls"), "cls", "left").join(of("leader"), "leader", "left").filter(F.coalesce("cls_root", "cls") != F.coalesce("leader_root", "leader")).select("cls", "leader")


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """key, cls, members, comp: buckets of three or more members of more than one component."""
    placed = buckets.filter("members > 2").join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", "members", F.coalesce("root", "cls").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
    return table(placed.join(split, "key"), "open")


def _tiles(rows: DataFrame, *columns: str) -> DataFrame:
    """rows: key, members, shingles (both of the whole bucket), cls. Each bucket in chunks of about TILE members and TILE_SHINGLES shingles, and each two chunks (i <= j) in a tile."""
    chunks = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    chunked = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select("key", "cls", *columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, digest (of the set), root (a number for the component), component_id, kept for each row of docs. Links: 100 * intersection >= percent * union of the sets of width-word shingles."""
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), text_key(column(text)).alias("tkey"), column(text).cast("string").alias("text"))
    sketched = table(rows.mapInArrow(_sketches(width), "doc_id long, tkey binary, n_shingles long, digest binary, sketch binary, dense binary"), "sketches")
    alike = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least_doc"), F.first("tkey").alias("tkey"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("dense").alias("dense"))
    classes = table(alike.withColumn("cls", F.monotonically_increasing_id()), "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("dense"), b * 2 * BAND + 1, F.lit(2 * BAND))))
    banded = classes.select("cls", F.explode(band).alias("key"))
    met = table(banded.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("cls"), "cls")).alias("leader")).filter("members > 1").select("key", "members", F.col("leader.cls").alias("leader")), "met")
    buckets = table(banded.join(met, "key"), "buckets")
    led = table(buckets.filter("cls != leader").select("cls", "leader").distinct(), "led")
    source = rows.select("tkey", "text")
    first = table(led.groupBy("cls").agg(F.min(F.struct(F.xxhash64("leader"), "leader")).alias("first")).select("cls", F.col("first.leader").alias("leader")).select(*_pair("cls", "leader")).distinct(), "first")
    roots = table(components(_confirmed(first, classes, source, width, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
    rest = _apart(led, roots).select(*_pair("cls", "leader"))
    own = classes.select("cls", F.col("n_shingles").alias("n"), "sketch")
    open_ = _open(buckets, roots)
    few = open_.filter(F.col("members") <= SMALL_BUCKET)
    small = few.select("key", F.col("cls").alias("x"), F.col("comp").alias("cx")).join(few.select("key", F.col("cls").alias("y"), F.col("comp").alias("cy")), "key").filter("x < y and cx != cy").select("x", "y")
    many = open_.filter(F.col("members") > SMALL_BUCKET).join(own, "cls").withColumn("shingles", F.lit(0))
    likely = table(_tiles(many, "comp", "n", "sketch").groupBy("key", "i", "j").applyInArrow(_likeliest(percent / 100), "key long, member long, x long, y long, more boolean"), "likely")
    more = rest.unionByName(small).unionByName(likely.filter("x is not null").select("x", "y")).distinct().join(first, ["x", "y"], "left_anti")
    new = table(_confirmed(table(more, "more"), classes, source, width, percent), "links")
    if not new.isEmpty():
        roots = table(joined(roots, new.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
    if not likely.filter("more").isEmpty():  # who had no rival has none now, as components only grow
        rivals = table(likely.select("key", F.col("member").alias("cls")).distinct(), "rivals")
        still = _open(buckets.join(rivals, ["key", "cls"], "left_semi"), roots)
        sets = table(_texts(still.select("cls").distinct(), classes, source).mapInArrow(_sets(width), "cls long, members array<long>").withColumnRenamed("members", "members_of"), "sets")
        weighed = table(still.join(own.select("cls", "n"), "cls"), "weighed")
        heavy = weighed.groupBy("key").agg(F.sum("n").alias("shingles"))
        last = weighed.join(heavy, "key").join(own.select("cls", "sketch").join(sets, "cls"), "cls")
        found = table(_tiles(last, "comp", "n", "sketch", "members_of").groupBy("key", "i", "j").applyInArrow(_linked(percent / 100, percent), "x long, y long"), "found")
        if not found.isEmpty():
            roots = table(joined(roots, found.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    labelled = classes.select("digest", "cls", "least_doc").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = labelled.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    named = labelled.join(least, "root").select("digest", "component_id", "root")
    out = sketched.select("doc_id", "tkey", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tkey", "n_shingles", "digest", "root", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component one row of the least doc_id (then least hash of the text); every row without shingles stays."""
    found = near_duplicates(docs, width, percent, doc_id, text)
    first = found.filter("digest is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first")).select(F.col("first.doc_id").alias("__doc"), F.col("first.tkey").alias("__tkey"))
    worded = F.coalesce(column(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare = docs.filter(~worded)
    keyed = docs.filter(worded).select(whole(docs).alias("__row"), column(doc_id).cast("long").alias("__doc"), text_key(column(text)).alias("__tkey"))
    same = (keyed["__tkey"] == first["__tkey"]) & keyed["__doc"].eqNullSafe(first["__doc"])
    kept = keyed.join(first, same, "left_semi").groupBy("__doc", "__tkey").agg(F.first("__row").alias("__row")).select("__row.*")
    return kept.unionByName(bare)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the least doc_id that links of two-word shingles reach."""
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


#: Exact links from every pair of sets that share a shingle, and their components.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
members AS (SELECT doc_id, unnest(s) AS m FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM members a JOIN members b ON a.m = b.m AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * k >= 80 * (len(a.s) + len(b.s) - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
