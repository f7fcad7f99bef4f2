import dataclasses
import os
import random

import pytest

from tests.scanner import scan
from tidelog.functions import layout
from tidelog.operators import faults, validate
from tidelog.sources.log_writer import LogWriter


def make(path, n=2, first=1):
    w = LogWriter(str(path))
    assert w.open()
    if n:
        assert w.append_columns(faults.sample_columns(first, n))
    assert w.close()
    return str(path)


def same(report, raw):
    want = scan(raw)
    got = dataclasses.asdict(report)
    assert {k: got[k] for k in want} == want


def test_absent(tmp_path):
    r = validate.validate(str(tmp_path / "none"))
    assert r.healthy and r.valid_records == 0 and r.message == "Log file not present"


@pytest.mark.parametrize("offset", [0, 4, 6, 8, 12, 20, 28, 36, 44, 52, 60, 68, 76, 80])
def test_every_field_is_guarded(tmp_path, offset):
    path = make(tmp_path / "a.log", 3)
    faults.corrupt_byte(path, 2, offset)
    r = validate.validate(path)
    same(r, open(path, "rb").read())
    assert r.valid_records == 1 and r.first_bad_record_index == 2
    assert r.checksum_failures == (0 if offset < 12 else 1)


@pytest.mark.parametrize(("size", "message"), [(10, "file header"), (24 + 10, "partial record header"), (24 + 28 + 10, "record payload"), (24 + 28 + 52 + 2, "record CRC")])
def test_truncation(tmp_path, size, message):
    path = make(tmp_path / "a.log", 2)
    os.truncate(path, size)
    r = validate.validate(path)
    same(r, open(path, "rb").read())
    assert message in r.message and r.bytes_scanned == size


@pytest.mark.parametrize("sequence", [1, 0, 3])
def test_sequence(tmp_path, sequence):
    path = make(tmp_path / "a.log", 2)
    faults.rewrite_sequence(path, 1, sequence)
    r = validate.validate(path)
    same(r, open(path, "rb").read())
    assert r.valid_records == 1 and r.valid_bytes == 108 and r.expected_sequence == 2


def test_largest_sequence_has_no_successor(tmp_path):
    path = make(tmp_path / "a.log", 3)
    for i, s in enumerate((layout.U64_MAX - 1, layout.U64_MAX, 0)):
        faults.rewrite_sequence(path, i, s)
    same(validate.validate(path), open(path, "rb").read())


def test_recover_truncates_and_forgets_the_failure(tmp_path):
    path = make(tmp_path / "a.log", 3)
    faults.corrupt_byte(path, 2, 40)
    assert not validate.recover(path, False).healthy
    r = validate.recover(path, True)
    assert r.healthy and r.truncated and r.checksum_failures == 0 and r.message == "Log validated successfully; log prefix recovered"
    assert os.path.getsize(path) == 108


def test_fuzz_against_the_sequential_scanner(tmp_path):
    rng = random.Random(5)
    path = tmp_path / "f.log"
    for _ in range(2000):
        first = rng.choice([1, 1, 5, layout.U64_MAX - 2])
        n = rng.randrange(0, 6)
        import numpy as np

        columns = faults.sample_columns(1, n)
        columns["sequence"] = np.array([(first + i) & layout.U64_MAX for i in range(n)], np.uint64)
        raw = bytearray(layout.file_header(1) + layout.encode(columns))
        for _ in range(rng.randrange(0, 3)):
            kind = rng.randrange(4)
            if kind == 0 and len(raw):
                raw[rng.randrange(len(raw))] ^= 0x5A
            elif kind == 1:
                del raw[rng.randrange(len(raw) + 1) :]
            elif kind == 2:
                raw += bytes(rng.randrange(0, 90))
            elif n and len(raw) == 24 + 84 * n:
                path.write_bytes(raw)
                faults.rewrite_sequence(str(path), rng.randrange(n), rng.randrange(8))
                raw = bytearray(path.read_bytes())
        path.write_bytes(raw)
        same(validate.validate(str(path)), bytes(raw))


def test_spark_and_local_agree(spark, tmp_path, monkeypatch):
    for kind in (None, "crc", "tail", "gap"):
        path = make(tmp_path / f"{kind}.log", 200)
        if kind == "crc":
            faults.corrupt_byte(path, 150, 30)
            faults.corrupt_byte(path, 90, 30)
        elif kind == "tail":
            faults.truncate_tail(path, 40)
        elif kind == "gap":
            faults.rewrite_sequence(path, 120, 500)
        local = validate.validate(path)
        monkeypatch.setattr(validate, "SMALL_BYTES", 0)
        assert validate.validate(path, spark) == local
        monkeypatch.undo()


def test_prefix_and_strict_reading(spark, tmp_path):
    path = make(tmp_path / "a.log", 50)
    assert validate.read_log(spark, path).count() == 50
    faults.corrupt_byte(path, 31, 50)
    rows, report = validate.valid_prefix(spark, path)
    assert rows.count() == 30 and not report.healthy
    with pytest.raises(ValueError, match="CRC mismatch"):
        validate.read_log(spark, path)


def test_unsigned_values(spark, tmp_path):
    path = make(tmp_path / "a.log", 2)
    for i, s in enumerate((layout.U64_MAX - 1, layout.U64_MAX)):
        faults.rewrite_sequence(path, i, s)
    rows, _ = validate.valid_prefix(spark, path, "decimal")
    assert [int(r["sequence"]) for r in rows.orderBy("sequence").collect()] == [layout.U64_MAX - 1, layout.U64_MAX]
    with pytest.raises(Exception, match="largest BIGINT"):
        validate.valid_prefix(spark, path)[0].collect()
