"""A sequential reading of a log, record by record, for comparison. It shares no code with the engine but struct formats of its own."""

import struct
import zlib

HEAD, REC = struct.Struct("<IHHQII"), struct.Struct("<IHHIQQ")


def scan(raw: bytes) -> dict:
    out = dict(healthy=False, valid_records=0, valid_bytes=0, bytes_scanned=0, last_sequence=0, checksum_failures=0, first_bad_record_index=0, first_bad_record_sequence=0, corruption_offset=0, expected_sequence=0)

    def bad(message, **more):
        return out | more | {"corruption_detected": True, "message": message}

    if len(raw) < 24:
        return bad("Detected missing or partial file header", bytes_scanned=len(raw))
    magic, version, size, _, record, crc = HEAD.unpack(raw[:24])
    if (magic, version, size, record) != (0x464C4F47, 1, 24, 84):
        return bad("Detected invalid file header metadata", bytes_scanned=24)
    if zlib.crc32(raw[:20] + b"\0" * 4) != crc:
        return bad("Detected corrupted file header CRC", bytes_scanned=24)
    at, previous = 24, None
    out |= dict(valid_bytes=24)
    while True:
        out |= dict(first_bad_record_index=out["valid_records"] + 1, corruption_offset=at)
        part = raw[at : at + 28]
        if not part:
            return out | dict(healthy=True, corruption_detected=False, bytes_scanned=at, message="Log validated successfully")
        if len(part) < 28:
            return bad("Detected partial record header at end of file", bytes_scanned=at + len(part))
        magic, version, size, payload, sequence, _ = REC.unpack(part)
        out["first_bad_record_sequence"] = sequence
        if (magic, version, size, payload) != (0x46524344, 1, 28, 52):
            return bad("Detected invalid record metadata", bytes_scanned=at + 28)
        body = raw[at + 28 : at + 80]
        if len(body) < 52:
            return bad("Detected truncated record payload", bytes_scanned=at + 28 + len(body))
        tail = raw[at + 80 : at + 84]
        if len(tail) < 4:
            return bad("Detected truncated record CRC", bytes_scanned=at + 80 + len(tail))
        if zlib.crc32(part + body) != int.from_bytes(tail, "little"):
            return bad("Detected CRC mismatch", bytes_scanned=at + 84, checksum_failures=1)
        if previous is not None and (previous == (1 << 64) - 1 or sequence != previous + 1):
            expected = (previous + 1) % (1 << 64)
            return bad(f"Detected non-contiguous record sequence: expected {expected}, observed {sequence}", bytes_scanned=at + 84, expected_sequence=expected)
        previous, at = sequence, at + 84
        out |= dict(valid_records=out["valid_records"] + 1, valid_bytes=at, last_sequence=sequence)
