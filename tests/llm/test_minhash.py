import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import TEXTS, WORDS, awkward, near_classes, shingle_set
from tidelog.llm import graph
from tidelog.llm import minhash as m
from tidelog.llm.graph import components, contracted, joined


def as_rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def edited(rng, words, share):
    return [rng.choice(WORDS) + str(rng.randrange(50)) if rng.random() < share else w for w in words]


def corpus(seed=1, groups=6, size=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(rng.choice([1, 2, 5, 8, 30, 120, 600]))]
        for _ in range(size):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width, monkeypatch):
    monkeypatch.setattr(m, "SMALL_BUCKET", 2)  # so that tiles do the work
    monkeypatch.setattr(m, "TILE", 8)
    rows = corpus(width)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(m.near_duplicates(df, width, 80)) == near_classes(rows, width, 80)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    df = awkward(spark).filter("doc_id is not null")
    assert as_rows(m.near_duplicates(df, 2, 80)) == near_classes(rows, 2, 80)
    found = m.near_duplicates(awkward(spark), 2, 80)
    assert found.count() == len(TEXTS)
    assert m.near_duplicates(awkward(spark, []), 2, 80).count() == 0
    nulls = found.filter("doc_id is null").collect()
    assert all(r["component_id"] is None and r["kept"] for r in nulls)


def test_one_row_of_each_stays(spark):
    df = awkward(spark)
    left = m.one_of_each(df, 5, 80)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((d is None, d or 0, t or "") for k, (d, t) in enumerate(TEXTS) if k not in (6, 9, 12))
    assert m.one_of_each(awkward(spark, []), 5, 80).count() == 0


def test_shingles_follow_the_words():
    texts = ["", None, " \t", "a", "a b", "A b c", "x y x y x y", "a\tB ", "b a c"]
    got = list(m.shingled(pa.array(texts), 2))
    assert [len(g) for g in got] == [len(shingle_set(t, 2)) for t in texts]
    assert (got[4] == got[7]).all() and not set(got[5]) & set(got[8])


def test_registers_keep_the_least_hash():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    got = m.registers(hashes)
    for bucket in range(m.REGISTERS):
        own = [int(x) & ((1 << 56) - 1) for x in hashes if int(x) >> 56 == bucket]
        least = min(own)
        zeros = 56 - least.bit_length()
        assert abs(int(got[bucket] >> m.MANTISSA) - 1 - zeros) == 0
        assert got[bucket] & 1023 == (least << (zeros + 1) & ((1 << 56) - 1)) >> 46
    assert not m.registers(np.empty(0, np.uint64)).any()


def test_estimates_are_close_and_dense_registers_are_full():
    rng = np.random.default_rng(2)
    shared, own = rng.integers(0, 1 << 64, 8000, dtype=np.uint64), rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    a, b = np.unique(shared), np.unique(np.concatenate([shared, own]))
    est, used = m.estimate(m.registers(a)[None], m.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(est[0] - 0.8) < 5 * np.sqrt(0.16 / used[0])
    for n in (1, 2, 5, 40):
        assert (m.dense(m.registers(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)))) > 0).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 150), (150, 120), (7, 7)] + [(200, x) for x in range(201, 230)] + [tuple(rng.sample(range(300, 360), 2)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in root.items() if (x, r) != (7, 7) or x != 7 or 6 in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def least_reached(edges):
    root = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_contraction_keeps_components_and_leaves_a_forest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 900) * 3, rng.integers(0, 400, 900) * 3
    x, y = contracted(a, b)
    root = least_reached(list(zip(a.tolist(), b.tolist(), strict=True)))
    assert len(set(x.tolist())) == len(x) and dict(zip(x.tolist(), y.tolist(), strict=True)) == {n: r for n, r in root.items() if n != r}
    long = np.random.default_rng(6).permutation(20_000)
    x, y = contracted(long[:-1], long[1:])
    assert len(x) == 19_999 and not y.any()


@pytest.mark.parametrize("at_once", [500_000, 60])
def test_components_in_many_tasks(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", at_once)
    rng = random.Random(8)
    edges = [(i + 1, i) for i in range(500)] + [(x, 1000) for x in range(1001, 1400)] + [tuple(rng.sample(range(2000, 2300), 2)) for _ in range(250)]
    rng.shuffle(edges)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(16)).collect()}
    assert got == least_reached(edges)


def test_further_edges_join_components(spark):
    rng = random.Random(9)
    edges = [tuple(rng.sample(range(200), 2)) for _ in range(160)]
    frame = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    roots = components(frame(edges[:70]))
    for part in (edges[70:90], edges[90:], []):
        roots = joined(roots, frame(part))
    assert {r["id"]: r["root"] for r in roots.collect()} == least_reached(edges)


def test_shingles_of_any_width_follow_the_order_of_words():
    words = [f"w{i}" for i in range(24)]
    for width in (9, 12, 24):
        for other in (0, 1):
            swapped = list(words)
            swapped[other], swapped[other + 8] = swapped[other + 8], swapped[other]
            a, b = m.shingled(pa.array([" ".join(words), " ".join(swapped)]), width)
            wanted = [shingle_set(" ".join(t), width) for t in (words, swapped)]
            assert len(set(a) & set(b)) == len(wanted[0] & wanted[1])


def test_a_group_of_near_copies_has_few_pairs_a_member(spark, monkeypatch):
    rng, written, own = random.Random(10), {}, m.table
    base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.003))) for i in range(500)]

    def table(df, name):
        made = own(df, name)
        written.setdefault(name, made)
        return made

    monkeypatch.setattr(m, "table", table)
    found = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
    assert as_rows(found) == near_classes(rows, 5, 80)
    classes, pairs = written["classes"].count(), sum(written[k].count() for k in ("first", "more"))
    assert classes > 150 and pairs < 3 * classes


def test_long_texts_are_cut_by_bytes_not_by_rows(monkeypatch):
    from tidelog.llm.common import slices

    texts = pa.array(["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 30, "é" * 20])
    assert [len(p) for p in slices(texts, 100, 64)] == [2, 1, 3, 1]
    assert [len(p) for p in slices(texts, 2, 1 << 20)] == [2, 2, 2, 1]
    assert [len(p) for p in slices(texts.slice(2, 3), 100, 64)] == [1, 2] and list(slices(texts.slice(0, 0), 5)) == []


def test_a_text_of_megabytes(spark):
    rng = random.Random(3)
    long = [rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:200_000], "other", *long[200_000:]])), (3, " ".join(long[:300_000]))]
    assert as_rows(m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)) == near_classes(rows, 5, 80)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "same text here", 1, 2), (2, "same text here", 3, 4), (3, "another one", 5, 6)], "doc_id bigint, text string, `a.b` int, `c``d e` int")
    left = m.one_of_each(df, 2, 80)
    assert left.columns == df.columns and sorted(r["a.b"] for r in left.collect()) == [1, 5]
