"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks of bounded size; each pair of a query block and a candidate block is a tile. In a
tile the vectors are quantised to int8 with a scale each. The product of two quantised vectors is off from the true one by at
most |ex| |y| + |x'| |ey| (ex, ey: what quantising changed; x': the quantised vector). A candidate whose upper bound is below the k-th best lower
bound of a query in the tile is out; for the rest the product is computed again in double precision, from the original
vectors. The tiles' sorted lists of a query are merged by a heap.
The result is exact: the bounds never drop a true neighbour. Vectors are divided by powers of two for the computation and the products multiplied back,
so components of any finite size count; where products of a tile differ beyond doubles, or leave them, all its products are computed exactly. A product beyond the doubles is infinite, and ties with others.

Each tile holds one block of queries and one of candidates, of so many rows and bytes: no key has more, whatever values repeat.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; candidates of another
dimension than the query aren't compared; a row isn't a candidate of queries with its own vec_id; null vec_ids take no part; repeated
vec_ids with different vectors are queries of their own; ties go to the smaller vec_id; fewer than k candidates are all
returned; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.vectors import inner, matrix, scaled, vectors

#: Rows of a block, and bytes of its vectors as doubles, whichever are fewer.
QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES, MERGE_ROWS = 4096, 8192, 64 << 20, 400_000
ROWS_AT_ONCE, PAIRS_AT_ONCE = 256, 200_000
FOUND = pa.schema([("uid", pa.int64()), ("block", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, the length of what quantising changed, and the length of the quantised vectors."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def _best(order_by: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each value of order_by, best first, ties to smaller ids."""
    order = np.lexsort((ids, -score, order_by))
    group = order_by[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, int)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)]))
    return order[rank < k]


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows of a tile."""
    (queries, of_query), (rows, of_row) = scaled(queries), scaled(rows)
    comparable = not len(rows) or not len(queries) or (np.ptp(of_row) < 900 and of_query.max() + of_row.max() < 1000 and of_query.min() + of_row.min() > -900)
    shift = np.ldexp(1.0, of_row - of_row.max(initial=0)) if comparable else np.ones(len(rows))  # of one query's products against each other
    qq, qs, qe, qn = quantised(queries)
    rq, rs, re, _ = quantised(rows)
    rs, re, length = rs * shift, re * shift, np.linalg.norm(rows, axis=1) * shift
    kind = np.float32 if queries.shape[1] <= 1000 else np.float64  # sums of int8 products are exact in it
    left, right = qq.astype(kind), rq.astype(kind).T
    out: list[tuple] = []
    for at in range(0, len(queries), ROWS_AT_ONCE):
        to = slice(at, at + ROWS_AT_ONCE)
        about = (left[to] @ right).astype(np.float64) * qs[to, None] * rs
        bound = (qe[to, None] * length + qn[to, None] * re) * (1 + 1e-9) + 1e-12 * np.abs(about) + 1e-300
        if not comparable:
            bound = np.full_like(about, np.finfo(float).max)
        low = np.where(query_ids[to, None] == ids, -np.inf, about - bound)
        least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(low), -np.inf)
        a, b = np.nonzero((about + bound >= least[:, None]) & (low > -np.inf))
        for part in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[part : part + PAIRS_AT_ONCE] + at, b[part : part + PAIRS_AT_ONCE]
            with np.errstate(over="ignore"):
                score = np.ldexp(inner(queries[x], rows[y]), of_query[x] + of_row[y])
            best = _best(x, score, ids[y], k)
            out.append((x[best], y[best], score[best]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    x, y, score = (np.concatenate(c) for c in zip(*out, strict=True))
    best = _best(x, score, ids[y], k)
    return x[best], y[best], score[best]


def _tile(width: str, k: int):
    def run(tile: pa.Table) -> pa.Table:
        is_query, dim = tile.column("is_query").to_numpy(zero_copy_only=False), tile.column("dim")[0].as_py()
        both, uid, vec = matrix(tile.column("body"), width, dim), tile.column("uid").to_numpy(), tile.column("vec_id").to_numpy()
        q, r = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(r):
            return FOUND.empty_table()
        x, y, score = search(both[q], vec[q], both[r], vec[r], k)
        return pa.table([uid[q][x], np.full(len(x), tile.column("block")[0].as_py(), np.int32), vec[q][x], vec[r][y], score], schema=FOUND)

    return run


def _merge(k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("uid", "ascending"), ("block", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        uid, block, query, vec, score = (group.column(c).to_pylist() for c in ("uid", "block", "query_id", "vec_id", "score"))
        rows: list[tuple] = []
        for _, of in itertools.groupby(range(len(uid)), key=uid.__getitem__):
            lists = [list(run) for _, run in itertools.groupby(of, key=block.__getitem__)]
            merged = heapq.merge(*lists, key=lambda i: (-score[i], vec[i]))
            rows += [(query[i], n + 1, vec[i], score[i]) for n, i in enumerate(itertools.islice(merged, k))]
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "rank": pa.array([r[1] for r in rows], pa.int32()), "vec_id": pa.array([r[2] for r in rows], pa.int64()), "score": pa.array([r[3] for r in rows], pa.float64())})

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k rows of largest inner product with each row for which is_query (a condition on vec_id) holds."""
    every, width = vectors(rows, vec_id, embedding)
    every = every.filter("body is not null and vec_id is not null").withColumn("is_query", is_query)
    n, of_them, all_bytes, their_bytes = every.agg(F.count("*"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)), F.coalesce(F.sum(8 * F.col("dim").cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_query"), 8 * F.col("dim").cast("long"))), F.lit(0))).first()
    query_blocks, blocks = (max(1, math.ceil(rows / most), math.ceil(size / BLOCK_BYTES)) for rows, most, size in ((of_them, QUERY_BLOCK, their_bytes), (n, CANDIDATE_BLOCK, all_bytes)))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    asked = every.filter("is_query").withColumn("query_block", own(query_blocks)).withColumn("block", all_of(blocks))
    told = every.withColumn("is_query", F.lit(False)).withColumn("block", own(blocks)).withColumn("query_block", all_of(query_blocks))
    found = asked.unionByName(told).groupBy("dim", "query_block", "block").applyInArrow(_tile(width, k), "uid long, block int, query_id long, vec_id long, score double")
    groups = max(1, math.ceil(of_them * blocks * k / MERGE_ROWS))
    return found.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("part").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
