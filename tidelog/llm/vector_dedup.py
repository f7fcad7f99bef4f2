"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c or more are at most t = 2 - 2c apart in squared distance. A fixed rotation (random signs and a Hadamard transform)
spreads each vector over all coordinates; these are split into BLOCKS blocks, each with its share t / BLOCKS of the budget. A pair within t
is within the share in one block at least. So each block is range-joined: a tree of cuts at medians of the block's coordinates deals
the vectors into cells of about RANGE_ROWS, and a vector also visits the cells before its own whose box lies within the share of it. The deeper the tree,
the more coordinates prune, so a vector's visits grow about as the root of the table does. A cell of many visitors takes them in parts, each a tile with the cell's own
vectors; a leaf that no cut divides (equal coordinates) is split by a hash into cells that visit each other. In a tile a grid
over two coordinates and a sweep along another leave the rows to compare, and pairs within the share are confirmed by the cosine of the original vectors in double
precision. A pair counts in the first block that it is within the share in, so the union of candidates needs no distinct.

The cuts are medians of SAMPLE_ROWS vectors at most (SAMPLE_BYTES in all), those of least hash; all vectors are dealt, counted and joined, and a leaf that the sample got wrong is split by the hash.

Equal vectors are one class from the start. A tile returns counts and one edge per vector, not its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different dimensions aren't linked; repeated rows link with each other; a null vec_id counts as a vector,
and a component of null vec_ids alone has a null component_id; an empty table gives no rows; other columns are left out. Components of any finite size
count, since vectors are scaled by powers of two before products are taken.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table
from tidelog.llm.graph import Forest, components
from tidelog.llm.vectors import inner, matrix, scaled, stored, vectors

#: Rows of a cell, and bytes of their vectors, whichever are fewer.
BLOCKS, RANGE_ROWS, RANGE_BYTES = 8, 131_072, 32 << 20
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
ROWS_AT_ONCE, OTHERS_AT_ONCE, PAIRS_AT_ONCE, DEALT_AT_ONCE = 512, 16_384, 50_000, 20_000
#: What rounding to float may change of squared distances within a block: the share is widened by it, and what leads to a pair by more.
SLACK, MARGIN = 1e-6, 1e-5
LINKS = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors turned by a fixed orthogonal map, padded to a power of two. Sums and differences element by element, so a vector's image never depends on the rows beside it."""
    size, (x, _) = max(BLOCKS, 1 << (x.shape[1] - 1).bit_length()), scaled(x)
    out = np.zeros((len(x), size))
    signs = np.random.default_rng(11).integers(0, 2, size)[: x.shape[1]] * 2.0 - 1.0
    out[:, : x.shape[1]] = x / np.sqrt(inner(x, x))[:, None] * signs
    half = 1
    while half < size:
        pair = out.reshape(len(x), -1, 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    return out / math.sqrt(size)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    (x, _), (y, _) = scaled(x), scaled(y)
    return inner(x, y) / (np.sqrt(inner(x, x)) * np.sqrt(inner(y, y)))


class Cells:
    """The cells of one block: the leaves of a tree of cuts, each split by a hash into cells where it holds too many rows."""

    def __init__(self, sample: np.ndarray, rows: int, most: int):
        """Cuts a sample (of coordinates of the block) of so many rows until a leaf stands for `most` rows."""
        self.cuts: list[tuple[int, float, int, int] | int] = []  # a cut: coordinate, value, nodes below it and from it on; a leaf: its number
        self.leaves = 0
        self._grow(sample, rows / max(1, len(sample)), most)
        self.splits = self.chunks = np.ones(self.leaves, np.int64)
        self.first = np.arange(self.leaves + 1)

    def _grow(self, sample: np.ndarray, each: float, most: int) -> int:
        node, low = len(self.cuts), None
        self.cuts.append(0)
        if len(sample) * each > most and len(sample) >= 16:
            at = int(sample.std(0).argmax())
            cut = float(np.median(sample[:, at]))
            low = sample[:, at] < cut
        if low is None or not low.any():
            self.cuts[node] = self.leaves
            self.leaves += 1
        else:
            self.cuts[node] = (at, cut, self._grow(sample[low], each, most), self._grow(sample[~low], each, most))
        return node

    def sized(self, home: np.ndarray, visits: np.ndarray, most: int) -> None:
        """How many cells each leaf is split into, and in how many parts a cell takes its visitors. home, visits: rows of each leaf, and rows of later leaves that visit it."""
        self.splits = np.maximum(1, -(-home * 2 // (3 * most)))
        self.chunks = np.maximum(1, -(-(visits + np.where(self.splits > 1, home, 0)) // most))
        self.first = np.concatenate([[0], np.cumsum(self.splits)])

    def within(self, b: np.ndarray, share: float):
        """(leaf, rows): the rows of b whose squared distance from the leaf's box is within the share. The first row list of each row's own leaf included."""
        todo = [(0, np.arange(len(b)), np.zeros(b.shape), np.zeros(len(b)))]
        while todo:
            node, rows, off, total = todo.pop()
            if isinstance(cut := self.cuts[node], int):
                yield cut, rows
                continue
            at, value, *below = cut
            beyond = b[rows, at] - value
            for child, outside in zip(below, (beyond >= 0, beyond < 0), strict=True):
                far = np.where(outside, beyond, off[:, at])
                now = total - off[:, at] ** 2 + far**2
                stays = np.flatnonzero(now <= share)
                if len(stays):
                    moved = off[stays]
                    moved[:, at] = far[stays]
                    todo.append((child, rows[stays], moved, now[stays]))

    def leaf_of(self, b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(b), np.int64), [(0, np.arange(len(b)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(cut := self.cuts[node], int):
                out[rows] = cut
                continue
            at, value, *below = cut
            low = b[rows, at] < value
            todo += [(below[0], rows[low]), (below[1], rows[~low])]
        return out


def _blocks(batch, width: str):
    """(dim, rows of that dim, their rotated vectors) of a batch."""
    of = batch.column("dim").to_numpy()
    for dim in np.unique(of).tolist():
        part = batch.filter(pa.array(of == dim))
        yield dim, part, rotated(matrix(part.column("body"), width, dim))


def _tallied(width: str, cells: dict[int, list[Cells]], share: float):
    """Rows that each leaf holds, and rows of later leaves that visit it."""

    def run(batches):
        for batch in batches:
            for dim, _, r in _blocks(batch, width):
                size = r.shape[1] // BLOCKS
                for block, own in enumerate(cells[dim]):
                    b = r[:, block * size : (block + 1) * size]
                    leaf, visits = own.leaf_of(b), np.zeros(own.leaves, np.int64)
                    for other, rows in own.within(b, share):
                        visits[other] += np.count_nonzero(leaf[rows] > other)
                    home = np.bincount(leaf, minlength=own.leaves)
                    some = np.flatnonzero(home + visits)
                    yield pa.record_batch({"dim": pa.array(np.full(len(some), dim), pa.int32()), "block": pa.array(np.full(len(some), block), pa.int32()), "leaf": pa.array(some), "home": pa.array(home[some]), "visits": pa.array(visits[some])})

    return run


def _dealt(width: str, cells: dict[int, list[Cells]], share: float):
    """Each row to the tiles of its own cell, and to one tile of each cell before it that it visits."""

    def run(batches):
        for batch in batches:
            for dim, part, r in _blocks(batch, width):
                size, cls = r.shape[1] // BLOCKS, part.column("cls").to_numpy()
                salt = cls * np.int64(0x2545F4914F6CDD1D) >> np.int64(33)
                for block, own in enumerate(cells[dim]):
                    b = r[:, block * size : (block + 1) * size]
                    leaf = own.leaf_of(b)
                    home = own.first[leaf] + salt % own.splits[leaf]
                    tiles = [(np.repeat(np.arange(len(r)), own.chunks[leaf]), np.repeat(home, own.chunks[leaf]), np.arange(own.chunks[leaf].sum()) - np.repeat(np.cumsum(own.chunks[leaf]) - own.chunks[leaf], own.chunks[leaf]), True)]
                    for other, rows in own.within(b, share):
                        for cell in range(int(own.first[other]), int(own.first[other + 1])):
                            if len(guests := rows[home[rows] > cell]):
                                tiles.append((guests, np.full(len(guests), cell), (salt[guests] >> np.int64(7)) % own.chunks[other], False))
                    rows, cell, chunk, at_home = (np.concatenate([np.broadcast_to(t[k], len(t[0])) for t in tiles]) for k in range(4))
                    for at in range(0, len(rows), DEALT_AT_ONCE):
                        some = slice(at, at + DEALT_AT_ONCE)
                        take = part.select(["cls", "n", "body"]).take(pa.array(rows[some]))
                        n = len(rows[some])
                        yield pa.record_batch({"dim": pa.array(np.full(n, dim), pa.int32()), "block": pa.array(np.full(n, block), pa.int32()), "cell": pa.array(cell[some], pa.int64()), "chunk": pa.array(chunk[some], pa.int64()), "home": pa.array(at_home[some]), "cls": take.column("cls"), "n": take.column("n"), "body": take.column("body")})

    return run


def _joined(width: str, least: float):
    share = (2 - 2 * least) / BLOCKS + SLACK
    reach = math.sqrt(share) + MARGIN

    def run(tile: pa.Table) -> pa.Table:
        dim, block, chunk = (tile.column(c)[0].as_py() for c in ("dim", "block", "chunk"))
        cls, n, home = (tile.column(c).to_numpy() for c in ("cls", "n", "home"))
        x = stored(tile.column("body"), width, dim)
        del tile
        r = np.concatenate([rotated(x[at : at + DEALT_AT_ONCE].astype(np.float64)).astype(np.float32) for at in range(0, len(x), DEALT_AT_ONCE)])
        size = r.shape[1] // BLOCKS
        b = np.ascontiguousarray(r[:, block * size : (block + 1) * size])
        square, at = (b.astype(np.float64) ** 2).sum(1).astype(np.float32), b[:, 0]
        grid = np.floor(b[:, 1:3].astype(np.float64) / reach).astype(np.int64)

        def by_cell(rows: np.ndarray) -> dict[tuple, np.ndarray]:
            """Rows by their cell in the block's next two coordinates, in order of the first."""
            rows = rows[np.argsort(at[rows], kind="stable")]
            if not grid.shape[1] or not len(rows):
                return {(): rows} if len(rows) else {}
            named, of = np.unique(grid[rows], axis=0, return_inverse=True)
            order = np.argsort(of, kind="stable")
            return dict(zip(map(tuple, named.tolist()), np.split(rows[order], np.flatnonzero(np.diff(of[order])) + 1), strict=True))

        def confirm(u: np.ndarray, v: np.ndarray) -> None:
            apart = (r[u] - r[v]).reshape(len(u), BLOCKS, size)
            total = apart[:, :, 0] ** 2
            for k in range(1, size):  # one order of adding for every pair, in whatever tile
                total += apart[:, :, k] ** 2
            near = total <= np.float32(share)
            first = near[:, block] & ~near[:, :block].any(1)
            u, v = u[first], v[first]
            linked = cosine(x[u].astype(np.float64), x[v].astype(np.float64)) >= least
            u, v = u[linked], v[linked]
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            forest.link(u, v)

        def meet(a: np.ndarray, others: np.ndarray, once: bool) -> None:
            low, high = np.searchsorted(at[others], [at[a[0]] - np.float32(reach), at[a[-1]] + np.float32(reach)])
            for start in range(low, high, OTHERS_AT_ONCE):
                to = others[start : min(high, start + OTHERS_AT_ONCE)]
                p, q = np.nonzero(square[a][:, None] + square[to] - 2 * (b[a] @ b[to].T) <= share + MARGIN)
                p, q = a[p], to[q]
                if once:
                    p, q = p[p < q], q[p < q]
                for s in range(0, len(p), PAIRS_AT_ONCE):
                    confirm(p[s : s + PAIRS_AT_ONCE], q[s : s + PAIRS_AT_ONCE])

        steps = list(itertools.product((-1, 0, 1), repeat=grid.shape[1]))
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        own, guests = by_cell(np.flatnonzero(home)), by_cell(np.flatnonzero(~home))
        for right, same in ((own, True), (guests, False)):
            if same and chunk:  # the cell's own pairs count in its first tile
                continue
            for of, step in itertools.product(own, steps):
                others = right.get(tuple(c + d for c, d in zip(of, step, strict=True)))
                if others is None or (same and step < (0,) * len(step)):
                    continue
                for k in range(0, len(own[of]), ROWS_AT_ONCE):
                    meet(own[of][k : k + ROWS_AT_ONCE], others, same and not any(step))
        some = np.flatnonzero(links)
        return pa.table([cls[some], links[some], cls[forest.root[some]]], schema=LINKS)

    return run


def near_vectors(rows: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links are pairs of cosine >= least."""
    every, width = vectors(rows, vec_id, embedding)
    spark = rows.sparkSession
    classes = table(every.filter("body is not null").groupBy("dim", "body").agg(F.min("uid").alias("cls"), F.min("vec_id").alias("least_id"), F.count("*").alias("n")), "classes")
    share = (2 - 2 * least) / BLOCKS + MARGIN
    bytes_of, cells = np.dtype(width).itemsize, {}
    for dim, count in classes.groupBy("dim").count().collect():  # a row per dimension
        most, size = max(1, min(RANGE_ROWS, RANGE_BYTES // (dim * bytes_of))), max(1, (1 << (dim - 1).bit_length()) // BLOCKS)
        r = np.zeros((0, BLOCKS * size))
        if count > most:  # SAMPLE_BYTES at most
            sample = classes.filter(F.col("dim") == dim).select("body").orderBy(F.xxhash64("body"), "body").limit(max(16, min(SAMPLE_ROWS, SAMPLE_BYTES // (dim * bytes_of)))).toArrow()
            r = rotated(matrix(sample.column("body"), width, dim))
        cells[dim] = [Cells(r[:, k * size : (k + 1) * size], count, most) for k in range(BLOCKS)]
        if count > most:
            tally = classes.filter(F.col("dim") == dim).select("dim", "body").mapInArrow(_tallied(width, cells, share), "dim int, block int, leaf long, home long, visits long").groupBy("block", "leaf").agg(F.sum("home").alias("home"), F.sum("visits").alias("visits")).collect()  # a row per leaf
            for k, own in enumerate(cells[dim]):
                home, visits = np.zeros((2, own.leaves), np.int64)
                for t in tally:
                    if t["block"] == k:
                        home[t["leaf"]], visits[t["leaf"]] = t["home"], t["visits"]
                own.sized(home, visits, most)
    tiles = classes.select("dim", "cls", "n", "body").mapInArrow(_dealt(width, cells, share), "dim int, block int, cell long, chunk long, home boolean, cls long, n long, body binary")
    found = table(tiles.groupBy("dim", "block", "cell", "chunk").applyInArrow(_joined(width, least), "cls long, links long, root long"), "links") if cells else spark.createDataFrame([], "cls long, links long, root long")
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = table(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))), "roots")
    own = classes.select("cls", "body", "dim", "n", "least_id").join(counted, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = own.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = own.join(component, "root").select("dim", "body", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = every.join(named, ["dim", "body"], "left")
    least_id = F.when(F.col("body").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least_id.alias("component_id"), F.col("vec_id").eqNullSafe(least_id).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of cosine 0.95 or more and their component."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept FROM embeddings e JOIN least l ON l.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
"""
