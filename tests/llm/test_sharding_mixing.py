import random
import re

import pytest

from tests.llm.common import TEXTS, awkward
from tidelog.llm import mixing, sharding


def test_shards_hold_all_rows_evenly(spark, tmp_path):
    df = awkward(spark)
    placed = sharding.shuffle_into_shards(df, bucket_bytes=2_000)
    rows = placed.collect()
    assert sorted(map(repr, (tuple(r["record"]) for r in rows))) == sorted(map(repr, map(tuple, df.collect())))
    slots = {}
    for r in rows:
        assert r["size"] == len((r["record"]["text"] or "").encode()) + 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(k, [])) for k in range(8)) <= 1
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)
    assert sharding.shuffle_into_shards(awkward(spark, [])).count() == 0


def test_order_is_mixed_and_repeats_with_the_seed(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 20) AS text").coalesce(2)
    place = lambda seed: {r["record"]["doc_id"]: r["slot"] * 8 + r["shard"] for r in sharding.shuffle_into_shards(df, seed=seed, bucket_bytes=20_000).collect()}
    a, b, c = place(1), place(1), place(2)
    assert a == b != c and sorted(a.values()) == list(range(4000))
    near = sum(abs(a[i] - a[i + 1]) < 10 for i in range(3999))
    assert near < 60  # neighbours of the input are no neighbours


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: int(rng.paretovariate(0.7) * 50) for s in [None, *rng.sample(["a", "B", "é", "zz", "", "s10", "s2", "\U0001f600", "￿"], rng.randrange(1, 9))]}
    frame = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "s_null boolean, s_name string, source_size bigint")
    got = {None if r["s_null"] else r["s_name"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes), rel=1e-9)


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))), rng.choice(["hot"] * 8 + ["a", "b", "c", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_mix_comes_near_its_targets(spark):
    rows, df = corpus(spark)
    out = mixing.mix(df, keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    source, sizes, taken = {i: s for i, _, s in rows}, {}, {}
    for r in out:
        s = source[r["record"]["doc_id"]]
        assert r["copies"] in (0, 1, 2) and 0 <= r["rate"] <= 2 and abs(r["copies"] - r["rate"]) <= 1
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
    want = plain_targets(sizes)
    assert {source[r["record"]["doc_id"]]: r["target"] for r in out} == pytest.approx(want)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 30)
    again = {r["record"]["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(5), keep=["doc_id"]).collect()}
    assert again == {r["record"]["doc_id"]: r["copies"] for r in out}


def test_many_cells_round_as_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rows, df = corpus(spark, 800, 2)
    out = mixing.mix(df, keep=["doc_id", "source"]).collect()
    for s in {r[2] for r in rows}:
        own = [r for r in out if r["record"]["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= max(0.02 * own[0]["target"], 60)


def test_mix_bears_awkward_rows(spark):
    out = mixing.mix(awkward(spark)).collect()
    assert sorted(r["size"] for r in out) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in TEXTS)
    assert set(out[0]["record"].asDict()) == set(awkward(spark).columns)
    assert mixing.mix(awkward(spark, [])).count() == 0
    alone = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id bigint, text string, source string")).collect()
    assert [r["size"] for r in alone] == [0, 0] and all(r["target"] == 0 for r in alone)


def test_dual_meets_the_constraint(spark):
    frame = spark.createDataFrame([(False, s, b, n, n * b) for s, bins in (("x", {1: 50, 40: 3, 900: 1}), ("y", {10: 7})) for b, n in bins.items()], "s_null boolean, s_name string, bin int, n bigint, words bigint")
    goal = spark.createDataFrame([(False, "x", 700.0), (False, "y", 139.9)], "s_null boolean, s_name string, target double")
    got = mixing._solved(frame, goal, 2.0).collect()
    words = {(r["s_name"], r["bin"]): r["words"] for r in frame.collect()}
    for s, t in (("x", 700.0), ("y", 139.9)):
        assert sum(r["rate"] * words[s, r["bin"]] for r in got if r["s_name"] == s) == pytest.approx(t, rel=1e-9)


def test_copies_of_one_partition_are_scattered(spark):
    df = spark.range(3000).selectExpr("7L AS doc_id", "'the same text' AS text").coalesce(1)
    counts = [r["count"] for r in sharding.shuffle_into_shards(df, bucket_bytes=1_000).groupBy("bucket").count().collect()]
    assert sum(counts) == 3000 and max(counts) < 160  # some 70 a bucket


def test_cells_of_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 50)
    df = spark.range(1000).selectExpr("7L AS doc_id", "'a b c d' AS text", "'s' AS source").unionByName(spark.range(500).selectExpr("id AS doc_id", "'x y' AS text", "'t' AS source"))
    rows = mixing.mix(df).selectExpr("record.source", "copies * size AS taken", "target").collect()
    for s, n in (("s", 4), ("t", 2)):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * n and max(r["taken"] for r in own) <= 2 * n


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two", "s", 5, 6), (2, None, None, 7, 8)], "doc_id bigint, text string, source string, `a.b` int, `c``d e` int")
    assert sorted(r["a.b"] for r in sharding.shuffle_into_shards(df).select("record.*").collect()) == [5, 7]
    assert sorted(r["a.b"] for r in mixing.mix(df).select("record.*").collect()) == [5, 7]


def test_shards_of_many_blocks_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    df = spark.range(500).selectExpr("id AS doc_id", "'ten letters' AS text")
    places = sorted(r["slot"] * 8 + r["shard"] for r in sharding.shuffle_into_shards(df, bucket_bytes=500).collect())
    assert places == list(range(500))
