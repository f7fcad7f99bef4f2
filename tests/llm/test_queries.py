"""The registered queries over small tables, each against a plain version of its own."""

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tokenizers

from tests.llm.common import TEXTS, WORDS
from tests.llm.test_packing_plain import best_fit
from tests.llm.test_sharding_mixing import plain_targets
from tests.llm.test_warc import PAGES, Plain
from tidelog.llm import language_model, registry, warc

DOCS = [(k, t, f"s{k % 3}" if k % 4 else None) for k, (_, t) in enumerate(TEXTS)] + [(100 + k, " ".join(f"{w}{k * i % 7}" for i, w in enumerate(WORDS * (1 + k % 5))), f"s{k % 5}") for k in range(60)] + [(None, "a document without id", "s1"), (103, "one id twice", "s2")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string, source string").coalesce(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(2).write.parquet(f"{top}/pages.parquet")
    return top


def rows_of(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def encoded(name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def by_doc(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_op1_packs_every_id_once(spark, folder):
    rows, encode = rows_of(spark, folder, "op1_packing"), encoded("byte_bpe_50k.json")
    wanted = []
    for d, text, _ in DOCS:
        ids = encode(text)
        wanted += [(d, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]), len(ids)) for at in range(0, len(ids), 2048)]
    assert by_doc(rows, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(wanted, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) == best_fit([w[2] for w in wanted], 2048)


def test_op5_base_is_exact_and_scores_follow_the_counts(spark, folder):
    rows = rows_of(spark, folder, "op5_language_model")
    train = [t for d, t, _ in DOCS if not held(d, 7, 2)]
    single = Counter(w for t in train for w in tokens(t))
    pairs = Counter(p for t in train for p in zip([None, *tokens(t)], tokens(t), strict=False))
    n, v = sum(single.values()), len(single)
    level = lambda c: 0 if not c else math.ceil(language_model.BASE ** math.floor(math.log(c) / math.log(language_model.BASE) + 1e-9) - 1e-9)
    got = sorted(rows, key=lambda r: (repr(r["doc_id"]), r["base_score"]))
    wanted = []
    for d, text, _ in DOCS:
        own, base, score = tokens(text), 0.0, 0.0
        for before, w in zip([None, *own], own, strict=False):
            word = (single[w] + 1) / (n + v + 1)
            base += math.log10(word)
            spread = max(single[before], 1) ** language_model.SPREAD
            score += math.log10(language_model.MIX * (level(pairs[before, w]) + spread * word) / (single[before] + spread) + (1 - language_model.MIX) * word)
        wanted.append((d, held(d, 7, 2), len(own), sum(single[w] > 0 for w in own), n, base, score))
    wanted.sort(key=lambda w: (repr(w[0]), w[5]))
    known = [i for i, w in enumerate(wanted) if w[3] == w[2]]
    for r, w in zip(got, wanted, strict=True):
        assert tuple(r)[:5] == w[:5] and r["base_score"] == pytest.approx(w[5], rel=1e-9)
        # all histories are among the exact words, so a false mark can only raise a score
        assert w[6] - 1e-6 <= r["score"] or w[3] < w[2]
    # a mark is false in (1 - exp(-4 / 10)) ** 4, some 1 in 85, and then adds a level
    excess = sum(got[i]["score"] - wanted[i][6] for i in known) / sum(wanted[i][2] for i in known)
    assert 0 <= excess < 0.02


def test_op6_rows_are_even_and_sizes_right(spark, folder):
    rows = rows_of(spark, folder, "op6_sharding")
    wanted = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for d, t, _ in DOCS]
    assert by_doc(rows, "doc_id", "size", "text_crc32", "law", "grown_shard") == sorted(wanted, key=repr)
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)}
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op8_targets_and_words_taken(spark, folder):
    rows = rows_of(spark, folder, "op8_mixing")
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, s in DOCS:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    of = {(d, size(t)): s for d, t, s in DOCS}
    assert by_doc(rows, "doc_id", "size") == sorted(((d, size(t)) for d, t, _ in DOCS), key=repr)
    taken = Counter()
    for r in rows:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(size(t) for _, t, own in DOCS if own == s)
    again = rows_of(spark, folder, "op8_mixing")
    assert by_doc(rows, "doc_id", "size", "taken") == by_doc(again, "doc_id", "size", "taken")


def test_op9_files_hold_all_documents_in_order(spark, folder):
    rows, encode = rows_of(spark, folder, "op9_token_files"), encoded("word_bpe_49k.json")
    assert by_doc(rows, "doc_id", "n_tokens", "ids_crc32") == sorted(((d, len(encode(t)), crc(encode(t))) for d, t, _ in DOCS), key=repr)
    ends = 0
    ordered = sorted(rows, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == ends
        ends += r["n_tokens"]
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_op10_records_name_their_sources(spark, folder):
    rows = rows_of(spark, folder, "op10_warc")
    sha = lambda data: "sha1:" + __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
    wanted = []
    for page, url, body in PAGES:
        plain = Plain()
        plain.feed(body or "")
        plain.close()
        text = "\n".join(filter(None, (" ".join(line.split()) for line in "".join(plain.out).split("\n")))).encode()
        wanted.append((page, "conversion", None if url is None else " ".join(url.split()), sha((body or "").encode()), sha(text), len(text), zlib.crc32(text)))
    assert by_doc([r for r in rows if r["record_type"] == "conversion"], "page_id", "record_type", "target_uri", "source_payload_digest", "block_digest", "block_bytes", "block_crc32") == sorted(wanted, key=repr)
    about = [r for r in rows if r["record_type"] == "metadata"]
    assert len(about) == len(PAGES) and {r["refers_to"] for r in about} == {r["refers_to"] for r in rows} and all(r["warc_date"] == warc.DATE for r in rows)
    assert len({r["record_id"] for r in rows}) == 2 * len({(p, u, b) for p, u, b in PAGES})
