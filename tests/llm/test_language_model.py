import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import TEXTS, awkward
from tidelog.llm import language_model as lm
from tidelog.llm.common import fold
from tidelog.llm.words import hashed, words


def test_words_split_on_ascii_blanks_only():
    texts = ["A b", None, "", " \t\n\v\f\r", "x y Éa", "  two  ", "a\x1cb"]
    distinct, of, starts = words(pa.array(texts))
    got = [[distinct[i] for i in of[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_levels_bound_the_count():
    c = np.arange(1, 5000)
    q = lm.level(c)
    assert (lm.least_of(q) <= c).all() and (c <= lm.most_of(q)).all() and lm.least_of(np.array([0]))[0] == 0


def test_filter_never_loses_a_mark():
    rng = np.random.default_rng(1)
    keys = lm.short(np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)), 4)
    q = rng.integers(1, 9, len(keys)).astype(np.uint8)
    part = (keys >> np.uint64(60)).astype(int)
    parts = [lm.segment(keys[part == p], q[part == p], 1) for p in range(16)]
    size = np.array([8 * len(p) for p in parts])
    f = lm.Filter(np.concatenate(parts), np.cumsum(size) - size, size, 4)
    got = f.levels(keys)
    assert (got >= q).all() and (got > q).mean() < 0.05
    assert (f.levels(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)) > 0).mean() < 0.05
    for p in range(16):
        assert (lm.unpacked(lm.packed(keys[part == p]), p, 4) == keys[part == p]).all()


def plain(rows, learn):
    words_of = lambda t: [*(t or "").encode().lower().split(), None]
    one, two = Counter(), Counter()
    for i, t in rows:
        if learn(i):
            w = words_of(t)
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w = words_of(t)
        single = [(one[x] + 1) / (n + v + 1) for x in w]
        pair = [(two[h, x] + max(one[h], 1) ** lm.SPREAD * p) / (one[h] + max(one[h], 1) ** lm.SPREAD) for h, x, p in zip([None, *w], w, single, strict=False)]
        out.append((i, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, single)), sum(math.log10(lm.MIX * p + (1 - lm.MIX) * s) for p, s in zip(pair, single, strict=True))))
    return out


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_scores_against_plain_counts(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, t) for i, t in TEXTS if i != 5] + [(100 + i, f"common words and word{i % 7} again and again number{i}") for i in range(60)]
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    df, held = awkward(spark, rows), fold("doc_id", 7) == 2
    got = lm.score(df, lm.learn(df.filter(~held)), held).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["held_out"]) for r in got), key=key)
    for a, b in zip(have, sorted(plain(rows, learn), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-9) and a[6] == (not learn(a[0]))
        assert a[5] == pytest.approx(b[5], abs=0.4 * b[1])  # counts are quantised
    if head > 3:  # the model beats the base on what it has not seen
        assert sum(a[5] for a in have if a[6]) > sum(a[4] for a in have if a[6])


def test_no_ngram_is_left_out_whatever_the_size(spark, monkeypatch):
    df, held = awkward(spark, [(i, f"pair{i % 90} other{i % 70} word{i % 11} again{i}") for i in range(300)]), fold("doc_id", 7) == 2
    of = lambda: sorted((r["doc_id"], r["n_known"], round(r["score"], 9)) for r in lm.score(df, lm.learn(df.filter(~held)), held).collect())
    monkeypatch.setattr(lm, "HEAD", 3)
    whole = of()
    for name, value in (("MOST_BYTES", 256), ("ASKED_TOKENS", 40), ("DOCS_AT_ONCE", 7)):  # a cap that is gone, and segments asked many times
        monkeypatch.setattr(lm, name, value, raising=False)
    assert of() == whole


def test_long_text_and_nothing(spark):
    df = awkward(spark)
    long = [r for r in lm.score(df, lm.learn(df), fold("doc_id", 7) == 2).collect() if r["doc_id"] == 5]
    assert long[0]["n_tokens"] == 30_001 == long[0]["n_known"]
    empty = awkward(spark, [])
    model = lm.learn(empty)
    assert (model.n, model.v) == (0, 0) and lm.score(empty, model, fold("doc_id", 7) == 2).count() == 0
    r = lm.score(awkward(spark, [(1, "new words")]), model, fold("doc_id", 7) == 2).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_hashes_tell_words_apart():
    assert len(set(hashed([str(i).encode() for i in range(10_000)]).tolist())) == 10_000
