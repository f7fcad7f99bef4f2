import zlib

import numpy as np
import pytest

from tidelog.functions import layout
from tidelog.operators import faults


def test_crc_vector_and_sizes():
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert [d.itemsize for d in (layout.FILE_HEADER, layout.RECORD, layout.SLOT, layout.LEGACY)] == [24, 84, 52, 112]


def test_codec_round_trip():
    columns = faults.sample_columns(7, 5)
    back = layout.decode(layout.encode(columns))
    for name in layout.COLUMNS:
        assert (back[name] == columns[name]).all()
    assert layout.meta_ok(back).all() and (layout.crcs(back) == back["crc32"]).all()


def test_header_faults():
    good = layout.file_header(5)
    assert layout.header_fault(good) is None
    assert "partial file header" in layout.header_fault(good[:10])
    assert "metadata" in layout.header_fault(good[:4] + b"\x02\0" + good[6:])
    assert "CRC" in layout.header_fault(good[:20] + bytes([good[20] ^ 0x5A]) + good[21:])


def test_slots():
    raw = layout.slot(3, 9, 24 + 84, 1, 1) + layout.slot(0, 9, 24, 0, 0)
    first, second = layout.slots(raw)
    assert first["slot_valid"] and first["generation"] == 3 and not second["slot_valid"]  # generation 0 is never valid
    assert not layout.slots(raw[:48] + b"\0\0\0\0" + raw[52:])[0]["slot_valid"]


def test_legacy_journal():
    record = layout.encode(faults.sample_columns(2, 1))
    entry = layout.legacy_entry(2, record)
    assert layout.legacy_fault(entry) is None
    assert layout.legacy_fault(entry[:-1]) == "journal size mismatch"
    assert layout.legacy_fault(b"\1" + entry[1:]) == "journal metadata invalid"
    assert layout.legacy_fault(entry[:100] + bytes([entry[100] ^ 1]) + entry[101:]) == "journal CRC invalid"
    assert layout.legacy_fault(layout.legacy_entry(3, record)) == "journal payload invalid"


def test_status_flags_are_distinct_bits():
    assert sum(layout.STATUS.values()) == 255


def test_known_cases():
    by_number = {c["case_no"]: c for c in faults.cases()}
    assert len(by_number) == 180
    want = {1: (20, 4, 6, 2, 0, 20), 2: (6, 3, 7, 4, 0, 6), 31: (9, 1, 4, 3, 67, 9), 32: (2, 4, 5, 2, 115, 2), 61: (15, 6, 10, 1, 0, 15), 91: (22, 3, 4, 2, 0, 22), 121: (3, 8, 9, 1, 4, 3), 151: (7, 4, 8, 1, 0, 11), 152: (8, 7, 10, 4, 0, 15)}
    for n, values in want.items():
        c = by_number[n]
        assert (c["preexisting_sequence"], c["batch_size"], c["ring_capacity"], c["ring_wrap_cycles"], c["partial_cut"], c["expected_sequence"]) == values


@pytest.mark.parametrize("size", [0, 1])
def test_encode_small(size):
    assert len(layout.encode(faults.sample_columns(1, size))) == 84 * size
    assert np.all(layout.decode(b"") == layout.decode(b""))


def test_crcs_of_many_records_are_those_of_each():
    raw = np.random.default_rng(1).bytes(layout.RECORD_BYTES * (layout.TOGETHER + layout.MANY + 7))
    records = layout.decode(raw)
    each = [layout.zlib.crc32(raw[i : i + 80]) for i in range(0, len(raw), layout.RECORD_BYTES)]
    assert layout.crcs(records).tolist() == each and layout.crcs(records[:5]).tolist() == each[:5] and layout.crcs(records[::2]).tolist() == each[::2] and not len(layout.crcs(records[:0]))
