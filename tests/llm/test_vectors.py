import math
from fractions import Fraction

import numpy as np
import pytest

from tidelog.llm import nearest as nn
from tidelog.llm import vector_dedup as vd
from tidelog.llm.vectors import inner

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, body string, n int, block int, cls bigint"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "u", None, 1, 2, 3) for i, v in rows], schema)


def table(n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.08, 1.0], n)[:, None]).astype(np.float32)
    v[5:9] = v[4]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * dim), (1040, [1.0, None] + [0.0] * (dim - 2)), (1060, [math.nan] * dim), (1080, [math.inf] * dim), (1100, []), (1120, [1.0, 2.0])]
    return rows, v


@pytest.mark.parametrize("blocks", [(4096, 8192), (3, 40)])
def test_nearest_is_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(nn, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(nn, "MERGE_ROWS", 500)
    rows, v = table()
    x = v.astype(float)
    got = nn.nearest(frame(spark, rows), nn.F.col("vec_id") % 20 == 0, 20).collect()
    for q in range(0, 300, 20):
        scores = inner(np.repeat(x[q : q + 1], len(x), 0), x)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["rank"], r["vec_id"], r["score"]) for r in own] == [(k + 1, i, scores[i]) for k, i in enumerate(want)]
    assert {r["query_id"] for r in got} == {*range(0, 300, 20)}  # 1120 has no partner of its dimension


def test_nearest_with_few_or_no_rows(spark):
    one = nn.nearest(frame(spark, [(0, [1, 0]), (3, [2, 0]), (7, [2, 0]), (None, [5, 0])]), nn.F.col("vec_id") % 20 == 0, 20)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in one.orderBy("rank").collect()] == [(1, 3, 2.0), (2, 7, 2.0)]
    assert nn.nearest(frame(spark, []), nn.F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 24)), rng.normal(size=(60, 24)) * 5
    q, s, e, n = nn.quantised(x)
    p, t, f, _ = nn.quantised(y)
    about = (q.astype(float) @ p.T.astype(float)) * s[:, None] * t
    assert (np.abs(about - x @ y.T) <= e[:, None] * np.linalg.norm(y, axis=1) + n[:, None] * f + 1e-12).all()


def plain_links(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and vd.cosine(x[None], y[None])[0] >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((i, len(links[i]), min(seen), i == min(seen)))
    return sorted(out)


@pytest.mark.parametrize("size", [32_768, 37])
def test_near_vectors_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(vd, "RANGE_ROWS", size)
    rows, _ = table(400, 16, 2)
    got = vd.near_vectors(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == plain_links(rows)


def test_near_vectors_of_equal_coordinates_and_small_dimensions(spark, monkeypatch):
    monkeypatch.setattr(vd, "RANGE_ROWS", 4)
    rows = [(i, [float(i % 3 == k) for k in range(3)]) for i in range(20)] + [(50, [2.0, 0.0, 0.0]), (51, [3.0])]
    got = vd.near_vectors(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == plain_links(rows)


def test_near_vectors_of_nothing(spark):
    assert vd.near_vectors(frame(spark, [])).count() == 0
    bad = vd.near_vectors(frame(spark, [(3, None), (4, [0, 0])])).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in bad] == [(0, 3, True), (0, 4, True)]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(5).normal(size=(30, 20))
    r = vd.rotated(x)
    assert np.allclose(np.linalg.norm(r, axis=1), 1) and np.allclose(r @ r.T, (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T)
    assert (vd.rotated(x[:7]) == r[:7]).all()


DOUBLES = SCHEMA.replace("array<float>", "array<double>")


def test_components_of_any_size(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    for powers in ([520], [-520], [-900, 0, 900], [-300, 300]):
        v = np.ldexp(base, np.array(powers * 40)[:40, None])
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        df = frame(spark, rows, DOUBLES)
        exact = [[sum(Fraction(a) * Fraction(b) for a, b in zip(x, y, strict=True)) for y in v.tolist()] for x in v.tolist()]
        got = {(r["query_id"], r["rank"]): r for r in nn.nearest(df, nn.F.col("vec_id") % 20 == 0, 5).collect()}
        for q in (0, 20):
            near = lambda i, q=q: float(exact[q][i]) if abs(exact[q][i]) < Fraction(2) ** 1024 else math.inf if exact[q][i] > 0 else -math.inf
            want = sorted((i for i in range(40) if i != q), key=lambda i: (-near(i), i))[:5]
            assert [got[q, k + 1]["vec_id"] for k in range(5)] == want
            assert all(math.isclose(got[q, k + 1]["score"], near(i), rel_tol=1e-12, abs_tol=1e-320) for k, i in enumerate(want))
        plain = plain_links([(i, x.tolist()) for i, x in enumerate(base)])
        linked = vd.near_vectors(df).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in linked) == plain


def test_trees_deal_every_near_pair_to_one_tile():
    rng = np.random.default_rng(8)
    b = np.concatenate([rng.normal(size=(900, 8)) / 8, np.repeat(rng.normal(size=(1, 8)) / 8, 100, 0) + rng.normal(size=(100, 8)) / 500])
    cells, share = vd.Cells(b[::2], len(b), 60), 0.0125
    assert cells.leaves > 10
    leaf = cells.leaf_of(b)
    visits = {(int(r), other) for other, rows in cells.within(b, share) for r in rows}
    assert len(visits) == sum(len(rows) for _, rows in cells.within(b, share))
    assert all((r, of) in visits for r, of in enumerate(leaf.tolist()))
    near = ((b[:, None] - b[None]) ** 2).sum(2) <= share
    assert all((int(p), int(leaf[q])) in visits for p, q in zip(*np.nonzero(near), strict=True))
    assert len(visits) < 0.6 * len(b) * cells.leaves


def test_near_vectors_in_cells_of_many_visitors(spark, monkeypatch):
    monkeypatch.setattr(vd, "RANGE_ROWS", 40)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    group = centre + rng.normal(size=(250, 32)) * 0.2  # of cosine about 0.95 with each other
    apart = rng.normal(size=(250, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([group, apart]).astype(np.float32))]
    got = vd.near_vectors(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == plain_links(rows)


def test_copies_of_a_vector_grow_slower_than_the_table():
    """Tiles that a vector is dealt to, for tables of vectors without structure."""
    share, least = 0.0125, {}
    for n in (50_000, 200_000, 3_200_000):
        b = np.random.default_rng(10).normal(size=(20_000, 8)) / 8
        cells = vd.Cells(b, n, vd.RANGE_ROWS)
        leaf = cells.leaf_of(b)
        visits = np.zeros(cells.leaves)
        for other, rows in cells.within(b, share):
            visits[other] += np.count_nonzero(leaf[rows] > other) * n / len(b)
        cells.sized(np.bincount(leaf, minlength=cells.leaves) * n // len(b), visits.astype(int), vd.RANGE_ROWS)
        least[n] = (visits.sum() + (cells.chunks[leaf] * n / len(b)).sum()) / n
    assert least[50_000] == 1 and least[200_000] < 4 and least[3_200_000] < 20, least
