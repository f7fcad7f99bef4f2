"""Damage to logs, for tests, and the grid of crash cases."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidelog.functions import layout
from tidelog.operators.recovery import recover_startup
from tidelog.operators.validate import validate
from tidelog.sources.files import local
from tidelog.sources.log_source import shape
from tidelog.sources.log_writer import SITES, Fault, LogWriter, Options, SimulatedCrash
from tidelog.streaming.ring import Ring

#: The crash sites of the grid, in order, and whether the new batch counts as committed.
GRID = [("before_main_write", "before_main_write", False), ("during_main_write", "during_main_write", False), ("after_main_write_before_sync", "after_main_write", False), ("after_main_sync_before_checkpoint", "after_main_sync", False), ("during_checkpoint_write", "during_checkpoint_write", False), ("after_journal_sync", "after_journal_sync", True)]
SEED, STRIDE, PER_SITE = 0xC0FFEE, 7919, 30


def truncate_tail(path: str, count: int) -> None:
    """Takes count bytes off the end; refuses to take all."""
    if not os.path.exists(local(path)):
        raise FileNotFoundError("log file does not exist")
    size = os.path.getsize(local(path))
    if count >= size:
        raise ValueError("the log is not longer than that")
    os.truncate(local(path), size - count)


def corrupt_byte(path: str, sequence: int, offset: int) -> None:
    """Flips bits (XOR 0x5A) of a byte of the record of that sequence in the valid prefix."""
    report, first = validate(path), shape(path)[3]
    if not 0 <= offset < layout.RECORD_BYTES:
        raise ValueError("the offset lies outside a record")
    if not report.valid_records or not first <= sequence < first + report.valid_records:
        raise ValueError("no valid record has that sequence")
    at = layout.HEADER_BYTES + (sequence - first) * layout.RECORD_BYTES + offset
    with open(local(path), "r+b") as f:
        f.seek(at)
        byte = f.read(1)[0]
        f.seek(at)
        f.write(bytes([byte ^ 0x5A]))


def rewrite_sequence(path: str, index: int, sequence: int) -> None:
    """Gives the record at an index another sequence, with a valid CRC."""
    with open(local(path), "r+b") as f:
        f.seek(layout.HEADER_BYTES + index * layout.RECORD_BYTES)
        r = layout.decode(f.read(layout.RECORD_BYTES)).copy()
        r["sequence"] = sequence
        r["crc32"] = layout.crcs(r)
        f.seek(layout.HEADER_BYTES + index * layout.RECORD_BYTES)
        f.write(r.tobytes())


def cases() -> list[dict]:
    """The 180 cases; each draws from a standard 32-bit Mersenne twister of its own seed."""
    out = []
    for name, site, acknowledged in GRID:
        for _ in range(PER_SITE):
            number = len(out) + 1
            seed = (SEED + number * STRIDE) & 0xFFFFFFFF
            twister = np.random.MT19937()
            twister._legacy_seeding(seed)
            rng = np.random.RandomState(twister)
            draw = lambda below, rng=rng: int.from_bytes(rng.bytes(4), "little") % below
            existing, batch = 1 + draw(23), 1 + draw(8)
            ring, wraps = batch + 1 + draw(5), 1 + draw(4)
            torn = {"during_main_write": batch * layout.RECORD_BYTES, "during_checkpoint_write": layout.SLOT.itemsize}.get(name)
            cut = 1 + draw(torn - 1) if torn else 0
            out.append({"case_no": number, "seed": seed, "crash_site": name, "fault": site, "preexisting_sequence": existing, "batch_size": batch, "ring_capacity": ring, "ring_wrap_cycles": wraps, "partial_cut": cut, "expected_sequence": existing + batch * acknowledged})
    return out


def case_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in cases()], "case_no bigint, seed bigint, crash_site string, fault string, preexisting_sequence bigint, batch_size bigint, ring_capacity bigint, ring_wrap_cycles bigint, partial_cut bigint, expected_sequence bigint")


def sample_columns(first: int, count: int) -> dict[str, np.ndarray]:
    seq = np.arange(first, first + count, dtype=np.uint64)
    zero = np.zeros(count)
    return {"sequence": seq, "timestamp_us": 1_000_000 + seq, "altitude_m": seq.astype(float), "airspeed_kts": zero + 120, "heading_deg": zero, "vertical_speed_fpm": zero, "engine_temperature_c": zero, "engine_rpm": zero, "system_status": np.ones(count, np.uint32)}


def wrapped(first: int, count: int, capacity: int, wraps: int) -> dict[str, np.ndarray]:
    """A batch that has gone through a ring whose cursors have wrapped around."""
    ring: Ring[int] = Ring(capacity)
    for i in range(wraps * capacity):
        ring.try_push(i)
        ring.try_pop()
    for s in range(first, first + count):
        ring.try_push(s)
    assert ring.try_pop_batch(count) == list(range(first, first + count))
    return sample_columns(first, count)


def run_case(case: dict, folder: str) -> dict:
    """Writes, crashes, recovers twice; adds what came back and `passed`."""
    path = f"{folder}/case-{case['case_no']}.bin"
    writer = LogWriter(path)
    writer.open()
    writer.append_columns(sample_columns(1, case["preexisting_sequence"]))
    writer.close()
    acknowledged = [case["preexisting_sequence"]]
    fault = Fault(case["fault"], case["preexisting_sequence"] + case["batch_size"], case["partial_cut"], acknowledged)
    crashed = LogWriter(path, Options(case["batch_size"], 1, 4096), fault)
    code = -1
    try:
        crashed.open()
        crashed.append_columns(wrapped(case["preexisting_sequence"] + 1, case["batch_size"], case["ring_capacity"], case["ring_wrap_cycles"]))
    except SimulatedCrash as e:
        code = e.code
    first = recover_startup(path)
    before = Path(path).read_bytes(), Path(layout.journal_path(path)).read_bytes()
    second = recover_startup(path)
    same = before == (Path(path).read_bytes(), Path(layout.journal_path(path)).read_bytes())
    exact = os.path.getsize(path) == layout.HEADER_BYTES + layout.RECORD_BYTES * first.valid_records
    report = validate(path)
    want = case["expected_sequence"]
    passed = code == SITES[case["fault"]] and acknowledged[-1] == want and first.healthy and second.healthy and first.last_sequence == want == first.valid_records and report.healthy and exact and same
    return case | {"acknowledged_sequence": acknowledged[-1], "recovered_sequence": first.last_sequence, "recovered_records": first.valid_records, "child_exit": code, "healthy": first.healthy, "contiguous": report.healthy, "exact_size": exact, "idempotent": same, "passed": passed}


def crash_report(results: list[dict]) -> str:
    passed = sum(r["passed"] for r in results)
    return json.dumps({"crash_cases": len(results), "passed": passed, "failed": len(results) - passed, "cases": results})
