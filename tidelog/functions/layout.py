"""Byte layouts of the log, its checkpoint journal and the legacy journal, with their codecs."""

from __future__ import annotations

import functools
import time
import zlib

import numpy as np

# Fixed values of the format.
FILE_MAGIC, RECORD_MAGIC, JOURNAL_MAGIC = 0x464C4F47, 0x46524344, 0x464A4E4C
FORMAT_VERSION, CHECKPOINT_VERSION, STATE_PENDING = 1, 2, 1
FILE_HEADER = np.dtype([("magic", "<u4"), ("version", "<u2"), ("header_size", "<u2"), ("recorder_start_time_us", "<u8"), ("record_size", "<u4"), ("header_crc32", "<u4")])
PAYLOAD = [("altitude_m", "<f8"), ("airspeed_kts", "<f8"), ("heading_deg", "<f8"), ("vertical_speed_fpm", "<f8"), ("engine_temperature_c", "<f8"), ("engine_rpm", "<f8"), ("system_status", "<u4")]
RECORD = np.dtype([("magic", "<u4"), ("version", "<u2"), ("header_size", "<u2"), ("payload_size", "<u4"), ("sequence", "<u8"), ("timestamp_us", "<u8"), *PAYLOAD, ("crc32", "<u4")])
SLOT = np.dtype([("magic", "<u4"), ("version", "<u2"), ("slot_size", "<u2"), ("generation", "<u8"), ("recorder_start_time_us", "<u8"), ("committed_length", "<u8"), ("record_count", "<u8"), ("last_sequence", "<u8"), ("checkpoint_crc32", "<u4")])
LEGACY = np.dtype([("magic", "<u4"), ("version", "<u2"), ("header_size", "<u2"), ("state", "<u4"), ("entry_size", "<u4"), ("sequence", "<u8"), ("record", "V84"), ("journal_crc32", "<u4")])
HEADER_BYTES, RECORD_BYTES, RECORD_HEADER_BYTES, PAYLOAD_BYTES = 24, 84, 28, 52
SLOTS, JOURNAL_BYTES, LEGACY_BYTES = 2, 104, 112
U64_MAX = (1 << 64) - 1
POLYNOMIAL = 0xEDB88320
assert (FILE_HEADER.itemsize, RECORD.itemsize, SLOT.itemsize, LEGACY.itemsize) == (24, 84, 52, 112)

#: From so many records on, their CRCs are taken together, so many at a time.
MANY, TOGETHER = 4_096, 65_536

STATUS = {"nominal": 1, "engine_warning": 2, "low_oil_pressure": 4, "pitot_disagree": 8, "recorder_buffer_overrun": 16, "sensor_glitch": 32, "altitude_deviation": 64, "flight_phase_transition": 128}
COLUMNS = ["sequence", "timestamp_us", *[name for name, _ in PAYLOAD]]


def now_us() -> int:
    return time.time_ns() // 1000


def journal_path(path: str) -> str:
    return f"{path}.journal"


def file_header(start_us: int | None = None) -> bytes:
    h = np.zeros((), FILE_HEADER)
    h["magic"], h["version"], h["header_size"], h["record_size"] = FILE_MAGIC, FORMAT_VERSION, HEADER_BYTES, RECORD_BYTES
    h["recorder_start_time_us"] = now_us() if start_us is None else start_us
    h["header_crc32"] = zlib.crc32(h.tobytes())  # over the header with this field zero
    return h.tobytes()


def header_fault(raw: bytes) -> str | None:
    """The message for a file header that can't be used, None if it can."""
    if len(raw) < HEADER_BYTES:
        return "Detected missing or partial file header"
    h = np.frombuffer(raw[:HEADER_BYTES], FILE_HEADER)[0]
    if (h["magic"], h["version"], h["header_size"], h["record_size"]) != (FILE_MAGIC, FORMAT_VERSION, HEADER_BYTES, RECORD_BYTES):
        return "Detected invalid file header metadata"
    return None if zlib.crc32(raw[:20] + bytes(4)) == h["header_crc32"] else "Detected corrupted file header CRC"


def encode(columns: dict[str, np.ndarray]) -> bytes:
    """Records of parallel arrays named as COLUMNS."""
    n = len(columns["sequence"])
    r = np.zeros(n, RECORD)
    r["magic"], r["version"], r["header_size"], r["payload_size"] = RECORD_MAGIC, FORMAT_VERSION, RECORD_HEADER_BYTES, PAYLOAD_BYTES
    for name in COLUMNS:
        r[name] = columns[name]
    r["crc32"] = crcs(r)
    return r.tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The whole records in raw."""
    return np.frombuffer(raw, RECORD, len(raw) // RECORD_BYTES)


@functools.cache
def _steps() -> np.ndarray:
    """What 16 bits of input make of a CRC's low 16 bits, by the rule of the polynomial."""
    c = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        c = c >> np.uint32(1) ^ (c & np.uint32(1)) * np.uint32(POLYNOMIAL)
    return c


def crcs(records: np.ndarray) -> np.ndarray:
    """Each record's CRC over its header and payload. Many records go 16 bits at a time, all together (measured: 260 ns a record instead of 930); a few, one by one."""
    raw, crc32 = memoryview(np.ascontiguousarray(records).tobytes()), zlib.crc32
    if len(records) < MANY:
        return np.fromiter((crc32(raw[i : i + 80]) for i in range(0, len(raw), RECORD_BYTES)), np.uint32, len(records))
    words, out, steps = np.frombuffer(raw, "<u2").reshape(-1, RECORD_BYTES // 2), np.empty(len(records), np.uint32), _steps()
    for at in range(0, len(records), TOGETHER):
        part = np.ascontiguousarray(words[at : at + TOGETHER, :40].T)
        c = np.full(part.shape[1], 0xFFFFFFFF, np.uint32)
        for word in part:
            c = steps[c & np.uint32(0xFFFF) ^ word] ^ c >> np.uint32(16)
        out[at : at + TOGETHER] = ~c
    return out


def meta_ok(records: np.ndarray) -> np.ndarray:
    return (records["magic"] == RECORD_MAGIC) & (records["version"] == FORMAT_VERSION) & (records["header_size"] == RECORD_HEADER_BYTES) & (records["payload_size"] == PAYLOAD_BYTES)


def slot(generation: int, start_us: int, length: int, count: int, last: int) -> bytes:
    s = np.zeros((), SLOT)
    s["magic"], s["version"], s["slot_size"] = JOURNAL_MAGIC, CHECKPOINT_VERSION, SLOT.itemsize
    s["generation"], s["recorder_start_time_us"], s["committed_length"], s["record_count"], s["last_sequence"] = generation, start_us, length, count, last
    s["checkpoint_crc32"] = zlib.crc32(s.tobytes())
    return s.tobytes()


def slots(raw: bytes) -> list[dict]:
    """The slots of a journal, with slot_valid for their own fields and CRC."""
    out = []
    for i in range(SLOTS):
        part = raw[i * SLOT.itemsize : (i + 1) * SLOT.itemsize]
        s = np.frombuffer(part, SLOT)[0]
        own = (s["magic"], s["version"], s["slot_size"]) == (JOURNAL_MAGIC, CHECKPOINT_VERSION, SLOT.itemsize) and s["generation"] != 0
        names = ("generation", "recorder_start_time_us", "committed_length", "record_count", "last_sequence")
        out.append({"slot": i} | {n: int(s[n]) for n in names} | {"slot_valid": bool(own and zlib.crc32(part[:48] + bytes(4)) == s["checkpoint_crc32"])})
    return out


def legacy_entry(sequence: int, record: bytes) -> bytes:
    """A pending entry of the legacy journal, for one encoded record."""
    e = np.zeros((), LEGACY)
    e["magic"], e["version"], e["header_size"], e["state"], e["entry_size"], e["sequence"] = JOURNAL_MAGIC, FORMAT_VERSION, LEGACY_BYTES, STATE_PENDING, LEGACY_BYTES, sequence
    e["record"] = np.void(record)
    e["journal_crc32"] = zlib.crc32(e.tobytes())
    return e.tobytes()


def legacy_fault(raw: bytes) -> str | None:
    """Why a legacy journal can't be used, None if its entry is pending."""
    if len(raw) != LEGACY_BYTES:
        return "journal size mismatch"
    e = np.frombuffer(raw, LEGACY)[0]
    if (e["magic"], e["version"], e["header_size"], e["entry_size"], e["state"]) != (JOURNAL_MAGIC, FORMAT_VERSION, LEGACY_BYTES, LEGACY_BYTES, STATE_PENDING):
        return "journal metadata invalid"
    if zlib.crc32(raw[:108] + bytes(4)) != e["journal_crc32"]:
        return "journal CRC invalid"
    r = decode(raw[24:108])
    return None if meta_ok(r)[0] and r["sequence"][0] == e["sequence"] and crcs(r)[0] == r["crc32"][0] else "journal payload invalid"
