import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import TEXTS, awkward
from tidelog.llm.encoding import Encoder, ended
from tidelog.llm.packing import CapacityTree, best_fit_decreasing, pack
from tidelog.llm.token_files import EliasFano, Reader, read_token_files, write_token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, texts):
    t = Tokenizer.from_file(path)
    return [np.array([*e.ids, 1], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    odd = ["a  b", "a   b", "x \ny", "\n\n x\n", " lead", "trail ", "it's  'S don't", "<|startoftext|>a", "é ́a", "ΑΣ ΑΣ.", " ", "\n", "a\nb", "x\x1cy \x00z", "İ i", "foo!!! bar?! (baz), qux.. 1,234.5 a1b2", "naïve,été. 中文, ok", None, "Foo FOO foo."]
    rng = random.Random(1)
    odd += ["".join(rng.choice("ab Ée.,'\n\t!1 ") for _ in range(rng.randrange(30))) for _ in range(2000)]
    enc = Encoder(path)
    for batch in (odd, odd[::-1]):
        ids, starts = ended(*enc.encode(pa.array(batch, pa.string())), 1)
        assert [ids[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)] == plain(path, batch)


def test_encoder_forgets_and_still_agrees(monkeypatch):
    from tidelog.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBERED", 20)
    enc, texts = Encoder(BYTES), [f"word{i} other{i % 7}, more" for i in range(100)]
    for _ in range(2):
        ids, starts = ended(*enc.encode(pa.array(texts)), 1)
        assert [ids[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)] == plain(BYTES, texts)
        assert len(enc.known) <= 20


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for window in (1, 7, 64, 2048):
        lengths = [rng.randint(1, window) for _ in range(300)]
        where, offsets = best_fit_decreasing(lengths, window)
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(window - n)
        used = {}
        for w, o, n in sorted(zip(where, offsets, lengths, strict=True)):
            assert o == used.get(w, 0)
            used[w] = o + n
        assert sorted(window - u for u in used.values()) == sorted(left)


def test_capacity_tree_ignores_full_windows():
    t = CapacityTree(8)
    t.put(0, 1)
    assert t.take(1) is None
    t.put(5, 2)
    t.put(8, 3)
    assert t.take(6) == (3, 8) and t.take(5) == (2, 5) and t.take(1) is None


def test_pack_whole_documents(spark):
    packed = pack(awkward(spark), BYTES, window=64)
    rows = packed.rows().collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] <= 256
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(plain(BYTES, [t for _, t in TEXTS]))
    got = b"".join(part for parts in by_doc.values() for _, part in sorted(parts))
    assert len(got) == sum(map(len, want)) and sum(r["length"] for r in rows) * 4 == len(got)
    singles = {d: t for d, t in TEXTS if sum(x == d for x, _ in TEXTS) == 1}
    for d, ids in zip(singles, plain(BYTES, singles.values()), strict=True):
        ((_, parts),) = [(k, v) for k, v in by_doc.items() if k[0] == d]
        assert b"".join(p for _, p in sorted(parts)) == ids
    full = packed.sequences().collect()
    assert sum(r["used"] for r in full) * 4 == len(got) and all(len(r["ids"]) == 4 * r["used"] for r in full)
    assert sum(r["used"] < 64 for r in full) <= 3  # little padding


def test_pack_nothing(spark):
    assert pack(awkward(spark, []), BYTES).rows("doc_id").count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (1, 9), (5, 5), (1000, 10), (3000, 10**6), (2000, 2**40)):
        values = np.sort(rng.integers(0, top + 1, n))
        width, low, high = EliasFano.parts(values, top)
        e = EliasFano(width, n, low, high)
        assert (e.all() == values).all()
        for i in rng.integers(0, n, 50):
            assert e.select(int(i)) == values[i]
    assert (len(low) + len(high)) * 8 < 2000 * (2 + np.log2(2**40 / 2000)) + 64


def test_token_files_round_trip(spark, tmp_path):
    manifest = write_token_files(awkward(spark), f"file://{tmp_path}/tokens", WORDS)
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = plain(WORDS, [t for _, t in TEXTS])
    assert sorted(zlib.crc32(r["ids"]) for r in rows) == sorted(map(zlib.crc32, want))
    m = manifest.orderBy("shard").first()
    file = Reader(m["path"])
    assert [file.ids(i).astype("<u4").tobytes() for i in range(file.count)] == [bytes(r["ids"]) for r in rows[: file.count]]
    assert zlib.crc32(file.span(0, file.total).tobytes()) == file.crc
    with pytest.raises(ValueError, match="no token file"):
        (tmp_path / "bad").write_bytes(bytes(100))
        Reader(str(tmp_path / "bad"))


def test_reading_selects_the_starts_of_each_batch(tmp_path, monkeypatch):
    from tidelog.llm import token_files as tf

    rng = np.random.default_rng(4)
    for n, top in ((1, 0), (1, 9), (3000, 10**6), (3000, 50)):
        values = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano(*(p := EliasFano.parts(values, top))[:1], n, *p[1:])
        for a in range(0, n, 700):
            assert (e.selects(a, min(a + 701, n)) == values[a : a + 701]).all()
    lengths = rng.integers(0, 9, 50)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = tf.Writer(str(tmp_path / "one.tlef"), 2)
    out.add(list(range(50)), np.arange(starts[-1], dtype=np.uint32), starts)
    out.close()
    monkeypatch.setattr(tf, "ENCODED_AT_ONCE", 7)
    monkeypatch.setattr(EliasFano, "all", None)
    got = pa.Table.from_batches(tf._reads([pa.record_batch({"path": [str(tmp_path / "one.tlef")], "base": [100]})]))
    assert got["start"].to_pylist() == (starts[:-1] + 100).tolist() and got["n_tokens"].to_pylist() == lengths.tolist()
    assert b"".join(got["ids"].to_pylist()) == np.arange(starts[-1], dtype="<u4").tobytes()


def test_token_files_of_nothing(spark, tmp_path):
    assert read_token_files(write_token_files(awkward(spark, []), str(tmp_path), WORDS)).count() == 0


def test_damaged_ids_and_small_files(spark, tmp_path, monkeypatch):
    from tidelog.llm import token_files as tf

    monkeypatch.setattr(tf, "FILE_BYTES", 200)
    manifest = write_token_files(awkward(spark), f"file://{tmp_path}/tokens", WORDS)
    files = [r["path"] for r in manifest.collect()]
    assert len(files) > 4 and read_token_files(manifest).count() == len(TEXTS)
    path = files[0].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())  # noqa: SIM115
    raw[0] ^= 1
    with open(path, "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="differ from their CRC"):
        read_token_files(manifest).collect()


def test_schemes_that_workers_cannot_reach_are_named():
    from tidelog.llm.common import filesystem

    with pytest.raises(ValueError, match="file, hdfs, s3, s3a or gs"):
        filesystem("wasbs://c@a/x")
