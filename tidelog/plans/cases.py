"""Queries with a row for each case of a state machine (recovery, journals, scans, writers, rings, crashes), and their SQL.

Logs come from the events table, except the few records that the writer's and the crash cases write themselves. A case's expected row is
written out in SQL, with n for the number of events.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import layout
from tidelog.operators import faults, metrics, recovery, replay, simulate, validate
from tidelog.operators.recorder import Config, Recorder
from tidelog.plans.fixtures import START_US, damaged, events_log, telemetry
from tidelog.sources.files import scratch
from tidelog.sources.log_writer import Fault, Io, LogWriter, Options
from tidelog.streaming.ring import Ring

N = "n AS (SELECT count(*) AS n, count(*) // 2 AS half FROM events)"
REPORT = "healthy boolean, truncated boolean, corruption_detected boolean, valid_records bigint, valid_bytes bigint, bytes_scanned bigint, last_sequence bigint, checksum_failures bigint, first_bad_record_index bigint, first_bad_record_sequence bigint, corruption_offset bigint, expected_sequence bigint, message string"
STARTUP = "healthy boolean, log_truncated boolean, journal_found boolean, journal_replayed boolean, journal_cleared boolean, journal_discarded boolean, journal_migrated boolean, valid_records bigint, last_sequence bigint, checksum_failures bigint, checkpoint_generation bigint, committed_length bigint, message string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _values(schema: str, rows: list[tuple], source: str = "n") -> str:
    """SQL of rows of expressions over n and half, typed as the schema says."""
    kinds = [c.split() for c in schema.split(", ")]
    sql = {"boolean": "BOOLEAN", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
    one = lambda row: "SELECT " + ", ".join(f"CAST({str(v).lower() if isinstance(v, bool) else 'NULL' if v is None else v} AS {sql[k]}) AS \"{c}\"" for v, (c, k) in zip(row, kinds, strict=True)) + f" FROM {source}"
    return f"WITH {N} " + " UNION ALL ".join(map(one, rows))


# Scans: files of all shapes, checked on the driver and by tasks.

_SCANS = ["clean", "absent", "empty", "short_header", "header_crc", "header_magic", "header_only", "tail_header", "tail_payload", "tail_crc", "tail_meta", "crc", "meta", "gap", "dup"]


def _scanned(spark: SparkSession, sf: str, kind: str, folder: str) -> str:
    if kind in ("crc", "meta", "gap", "dup"):
        return damaged(spark, sf, kind)
    path, source = f"{folder}/{kind}.log", events_log(spark, sf)
    if kind == "absent":
        return path
    shutil.copyfile(source, path)
    size = os.path.getsize(path)
    cut = {"empty": 0, "short_header": 10, "header_only": 24, "tail_header": size - 74, "tail_payload": size - 34, "tail_crc": size - 2, "tail_meta": size - 34}
    if kind in cut:
        os.truncate(path, cut[kind])
    at = {"header_crc": 8, "header_magic": 0, "tail_meta": size - layout.RECORD_BYTES}.get(kind)
    if at is None:
        return path
    with open(path, "r+b") as f:
        f.seek(at)
        byte = f.read(1)[0]
        f.seek(at)
        f.write(bytes([byte ^ 0x5A]))
    return path


def scan_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The report on each file, from the driver's scan and from tasks of a seventh of the records each."""
    folder, rows = scratch(spark), []
    for kind in _SCANS:
        path = _scanned(spark, sf, kind, folder)
        each = max(1, (os.path.getsize(path) if os.path.exists(path) else 0) // layout.RECORD_BYTES // 7)
        for way, report in (("driver", validate.validate(path)), ("tasks", validate.validate(path, spark, each))):
            rows.append((kind, way, *astuple(report)))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, f"kind string, way string, {REPORT}")


def _bad(valid: str, scanned: str, sums: int, sequence: str, expected: str, message: str) -> tuple:
    end = f"24 + 84 * ({valid})"
    return (False, False, True, valid, end, scanned, valid, sums, f"({valid}) + 1", sequence, end, expected, message)


def _head(scanned: int, message: str) -> tuple:
    return (False, False, True, 0, 0, scanned, 0, 0, 0, 0, 0, 0, f"'{message}'")


_GAP = "'Detected non-contiguous record sequence: expected ' || (half + 1) || ', observed ' || "
_SCAN_ROWS = {
    "clean": (True, False, False, "n", "24 + 84 * n", "24 + 84 * n", "n", 0, "n + 1", "n", "24 + 84 * n", 0, "'Log validated successfully'"),
    "absent": (True, False, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, "'Log file not present'"),
    "empty": _head(0, "Detected missing or partial file header"),
    "short_header": _head(10, "Detected missing or partial file header"),
    "header_crc": _head(24, "Detected corrupted file header CRC"),
    "header_magic": _head(24, "Detected invalid file header metadata"),
    "header_only": (True, False, False, 0, 24, 24, 0, 0, 1, 0, 24, 0, "'Log validated successfully'"),
    "tail_header": _bad("n - 1", "24 + 84 * (n - 1) + 10", 0, "n - 1", "0", "'Detected partial record header at end of file'"),
    "tail_payload": _bad("n - 1", "24 + 84 * (n - 1) + 50", 0, "n", "0", "'Detected truncated record payload'"),
    "tail_crc": _bad("n - 1", "24 + 84 * (n - 1) + 82", 0, "n", "0", "'Detected truncated record CRC'"),
    "tail_meta": _bad("n - 1", "24 + 84 * (n - 1) + 28", 0, "n", "0", "'Detected invalid record metadata'"),
    "crc": _bad("half", "24 + 84 * half + 84", 1, "half + 1", "0", "'Detected CRC mismatch'"),
    "meta": _bad("half", "24 + 84 * half + 28", 0, "half + 1", "0", "'Detected invalid record metadata'"),
    "gap": _bad("half", "24 + 84 * half + 84", 0, "half + 3", "half + 1", f"{_GAP}(half + 3)"),
    "dup": _bad("half", "24 + 84 * half + 84", 0, "half", "half + 1", f"{_GAP}half"),
}
SCAN_SQL = _values(f"kind string, way string, {REPORT}", [(f"'{k}'", f"'{way}'", *row) for k, row in _SCAN_ROWS.items() for way in ("driver", "tasks")])


def valid_prefix_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The valid prefix of a log with a bad CRC, as tasks find and read it."""
    path = damaged(spark, sf, "crc")
    return validate.records(spark, path, 0, validate.validate(path, spark, 997).valid_records)


def invalid_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line that names the first bad record, for each kind of damage."""
    return spark.createDataFrame([(kind, replay.invalid_line(validate.validate(damaged(spark, sf, kind), spark))) for kind in ("crc", "meta", "gap", "dup", "tail")], "kind string, line string")


def _line_sql(kind: str) -> str:
    row = dict(zip(_names(REPORT), _SCAN_ROWS[kind], strict=True))
    parts = " || ".join(f"' {c}=' || ({row[c]})" for c in ("first_bad_record_index", "first_bad_record_sequence", "corruption_offset", "valid_bytes", "bytes_scanned", "expected_sequence"))
    return f"SELECT '{kind}' AS kind, 'invalid_record' || {parts} || ' reason=\"' || ({row['message']}) || '\"' AS line FROM n"


LINES_SQL = f"WITH {N} " + " UNION ALL ".join([*map(_line_sql, ("crc", "meta", "gap", "dup")), _line_sql("tail_payload").replace("'tail_payload'", "'tail'").replace("24 + 84 * (n - 1) + 50", "24 + 84 * n - 10")])


# Recovery at the start: each state of a journal beside a log.


def _entry(path: str, sequence: int) -> bytes:
    return layout.legacy_entry(sequence, layout.encode(faults.sample_columns(sequence, 1)))


def _slot(generation: int, count: int, start_us: int = START_US) -> bytes:
    return layout.slot(generation, start_us, 24 + 84 * count, count, count)


def _journals(n: int, half: int, path: str) -> dict[str, tuple[str | None, bytes | None]]:
    """Damage to the log (None: no log) and the journal (None: no journal) of each case."""
    broken = bytearray(_slot(9, n))
    broken[20] ^= 1
    return {
        "nothing": (None, None),
        "journal_missing": ("copy", None),
        "journal_empty": ("copy", b""),
        "journal_torn": ("copy", _slot(1, n)[:50]),
        "legacy_corrupt": ("copy", bytes(layout.LEGACY_BYTES)),
        "legacy_committed": ("copy", _entry(path, n)),
        "legacy_next": ("copy", _entry(path, n + 1)),
        "legacy_beyond": ("copy", _entry(path, n + 2)),
        "legacy_bad_log": ("header", _entry(path, n + 1)),
        "slots_whole": ("copy", _slot(4, half) + _slot(5, n)),
        "slots_behind": ("copy", _slot(3, half) + _slot(2, half - 1)),
        "slots_torn_newest": ("copy", _slot(3, half) + bytes(broken)),
        "slots_other_log": ("copy", _slot(3, half, START_US + 1) + _slot(4, n, START_US + 1)),
        "slots_empty": ("copy", bytes(layout.JOURNAL_BYTES)),
        "slots_cut_log": ("tail", _slot(4, n - 1) + _slot(5, n)),
        "slots_bad_log": ("header", _slot(4, half) + _slot(5, n)),
        "slots_no_log": (None, _slot(4, half) + _slot(5, n)),
    }


def recovery_cases(spark: SparkSession, sf: str) -> DataFrame:
    """What startup recovery makes of each case, and whether doing it again changes neither file."""
    n, rows = (os.path.getsize(events_log(spark, sf)) - 24) // 84, []
    folder = scratch(spark)
    for name, (kind, journal) in _journals(n, n // 2, events_log(spark, sf)).items():
        path = f"{folder}/{name}.log" if kind is None else damaged(spark, sf, kind)
        beside = layout.journal_path(path)
        if os.path.exists(beside):
            os.remove(beside)
        if journal is not None:
            with open(beside, "wb") as f:
                f.write(journal)
        state = lambda path=path, beside=beside: [os.path.exists(p) and (os.path.getsize(p), p == beside and open(p, "rb").read()) for p in (path, beside)]  # noqa: E731, SIM115
        first = recovery.recover_startup(path, spark)
        after = state()
        second = recovery.recover_startup(path, spark)
        rows.append((name, *astuple(first), after == state() and second.healthy == first.healthy))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, f"kind string, {STARTUP}, idempotent boolean")


def _started(healthy: bool, message: str, valid: str = "n", cut: bool = False, found: bool = True, replayed: bool = False, cleared: bool = False, discarded: bool = False, migrated: bool = False, generation: int = 0, length: str | None = None) -> tuple:
    length = length or (f"24 + 84 * ({valid})" if generation else "0")
    return (healthy, cut, found, replayed, cleared, discarded, migrated, valid, valid, 0, generation, length, f"'{message}'", True)


_RESTORED = "restored newest valid committed checkpoint and removed unacknowledged tail"
_START_ROWS = {
    "nothing": _started(True, "Log file not present; journal not present", "0", found=False),
    "journal_missing": _started(False, "journal missing for existing log; refusing to infer committed state", found=False),
    "journal_empty": _started(True, "migrated legacy empty journal to committed checkpoint slots", migrated=True, generation=1),
    "journal_torn": _started(False, "unsupported or torn journal length; refusing to infer committed state"),
    "legacy_corrupt": _started(True, "discarded corrupt legacy journal and migrated valid committed log", discarded=True, migrated=True, generation=1),
    "legacy_committed": _started(True, "journal described an already committed record; migrated checkpoint", cleared=True, migrated=True, generation=1),
    "legacy_next": _started(True, "rolled legacy pending entry forward and migrated checkpoint slots", "n + 1", replayed=True, cleared=True, migrated=True, generation=1),
    "legacy_beyond": _started(False, "legacy journal sequence does not match log tail; refusing migration"),
    "legacy_bad_log": _started(False, "main log is not recoverable before journal replay", "0"),
    "slots_whole": _started(True, _RESTORED, generation=5),
    "slots_behind": _started(True, _RESTORED, "half", cut=True, generation=3),
    "slots_torn_newest": _started(True, _RESTORED, "half", cut=True, generation=3),
    "slots_other_log": _started(False, "no valid checkpoint is consistent with the main log", "0"),
    "slots_empty": _started(False, "no valid checkpoint is consistent with the main log", "0"),
    "slots_cut_log": _started(True, _RESTORED, "n - 1", cut=True, generation=4),
    "slots_bad_log": _started(False, "main log has no CRC-valid prefix for checkpoint recovery", "0"),
    "slots_no_log": _started(False, "failed to read file identity for checkpoint recovery", "0"),
}
RECOVERY_SQL = _values(f"kind string, {STARTUP}, idempotent boolean", [(f"'{k}'", *row) for k, row in _START_ROWS.items()])


def legacy_journals(spark: SparkSession, sf: str) -> DataFrame:
    """State and reason of a legacy journal in each condition."""
    n, folder = (os.path.getsize(events_log(spark, sf)) - 24) // 84, scratch(spark)
    good = _entry("", n)

    def put(of: bytes, at: int) -> bytes:
        return of[:at] + bytes([of[at] ^ 1]) + of[at + 1 :]

    def signed(of: bytes) -> bytes:
        e = bytearray(of[:108] + bytes(4))
        e[108:] = layout.zlib.crc32(bytes(e)).to_bytes(4, "little")
        return bytes(e)

    held = {"absent": None, "empty": b"", "short": good[:60], "metadata": put(good, 0), "crc": put(good, 50), "payload": signed(put(good, 80)), "sequence": signed(put(good, 16)), "pending": good}
    rows = []
    for name, raw in held.items():
        path = f"{folder}/{name}.log"
        if raw is not None:
            with open(layout.journal_path(path), "wb") as f:
                f.write(raw)
        rows.append((name, *recovery.inspect(path)))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, "kind string, state string, reason string")


LEGACY_SQL = _values("kind string, state string, reason string", [("'absent'", "'empty'", "'journal not present'"), ("'empty'", "'empty'", "'journal empty'"), ("'short'", "'corrupt'", "'journal size mismatch'"), ("'metadata'", "'corrupt'", "'journal metadata invalid'"), ("'crc'", "'corrupt'", "'journal CRC invalid'"), ("'payload'", "'corrupt'", "'journal payload invalid'"), ("'sequence'", "'corrupt'", "'journal payload invalid'"), ("'pending'", "'pending'", "'pending journal entry found'")])


# Writing: what a writer takes, refuses and counts.


class Scripted(Io):
    """Disk calls that go as a script says, then as they should."""

    def __init__(self, *script: str):
        self.script = list(script)

    def pwrite(self, fd: int, data: bytes, offset: int) -> int:
        step = self.script.pop(0) if self.script else "whole"
        if step == "interrupted":
            raise InterruptedError
        if step == "error":
            raise OSError(5, "scripted")
        return 0 if step == "nothing" else os.pwrite(fd, data[:7] if step == "short" else data, offset)


WRITER = "kind string, ok boolean, records_written bigint, records_committed bigint, commits bigint, generation bigint, preallocations bigint, failures bigint, valid_records bigint"


def writer_cases(spark: SparkSession, sf: str) -> DataFrame:
    folder, rows = scratch(spark), []

    def case(name: str, batches: list[tuple[int, int]], options: Options | None = None, io: Io | None = None, fault: Fault | None = None, after=None) -> None:
        path = f"{folder}/{name}.log"
        w = LogWriter(path, options, fault)
        w.open()
        w.reset_counters()
        w.io = io or w.io
        ok = all([w.append_columns(faults.sample_columns(*b)) for b in batches])
        if after:
            w.close()
            w = LogWriter(path, options)
            ok = w.open() and after(w)
        ok = ok and w.flush()
        w.release()
        s = w.stats
        rows.append((name, bool(ok), s.records_written, s.records_committed, s.commits, w.generation, s.preallocation_calls, s.failures, validate.validate(path).valid_records))

    one = Options(256, 1)
    case("new", [])
    case("one_record", [(1, 1)])
    case("each_batch", [(1, 4), (5, 4), (9, 4)], one)
    case("every_second_batch", [(1, 4), (5, 4), (9, 4)], Options(256, 2))
    case("at_the_end", [(1, 1), (2, 1), (3, 1)], Options(8, 10))
    case("resumed", [(1, 2), (3, 2)], one, after=lambda w: w.append_columns(faults.sample_columns(5, 1)))
    case("resumed_with_gap", [(1, 2), (3, 2)], one, after=lambda w: w.append_columns(faults.sample_columns(6, 1)))
    case("uncommitted", [(1, 1), (2, 1)], one, fault=Fault("drop_commit", 2), after=lambda w: True)
    case("batch_of_none", [(1, 0)])
    case("batch_too_large", [(1, 5)], Options(4, 1))
    case("gap", [(1, 2), (4, 1)])
    case("interrupted_and_short", [(1, 3)], one, Scripted("interrupted", "short", "interrupted", "short"))
    case("nothing_written", [(1, 3)], one, Scripted("nothing"))
    case("disk_error", [(1, 3)], one, Scripted("error"))
    case("preallocated", [(1, 48), (49, 48)], Options(64, 1, 4096))
    shutil.rmtree(folder)
    return spark.createDataFrame(rows, WRITER)


WRITER_SQL = _values(WRITER, [("'new'", True, 0, 0, 0, 1, 0, 0, 0), ("'one_record'", True, 1, 1, 1, 2, 0, 0, 1), ("'each_batch'", True, 12, 12, 3, 4, 0, 0, 12), ("'every_second_batch'", True, 12, 12, 2, 3, 0, 0, 12), ("'at_the_end'", True, 3, 3, 1, 2, 0, 0, 3), ("'resumed'", True, 1, 1, 1, 4, 0, 0, 5), ("'resumed_with_gap'", False, 0, 0, 0, 3, 0, 1, 4), ("'uncommitted'", False, 0, 0, 0, 0, 0, 1, 2), ("'batch_of_none'", False, 0, 0, 0, 1, 0, 1, 0), ("'batch_too_large'", False, 0, 0, 0, 1, 0, 1, 0), ("'gap'", False, 2, 2, 1, 2, 0, 1, 2), ("'interrupted_and_short'", True, 3, 3, 1, 2, 0, 0, 3), ("'nothing_written'", False, 0, 0, 0, 1, 0, 1, 0), ("'disk_error'", False, 0, 0, 0, 1, 0, 1, 0), ("'preallocated'", True, 96, 96, 2, 3, 2, 0, 96)])


# The ring and the recorder.

RING = "step bigint, call string, outcome string, size bigint, dropped bigint, high_watermark bigint"
_CALLS = [("try_push", 1), ("push_wait_for", 2, 0.0), ("push_blocking", 3), ("try_push", 4), ("push_wait_for", 4, 0.001), ("try_pop",), ("push_wait_for", 5, 0.001), ("pop_wait_for", 0.001), ("try_pop_batch", 9), ("try_pop",), ("pop_wait_for", 0.001), ("try_push", 6), ("close",), ("try_push", 7), ("push_wait_for", 7, 0.001), ("push_blocking", 7), ("pop_blocking",), ("try_pop",), ("pop_wait_for", 0.001), ("pop_blocking",), ("reset",), ("try_push", 8), ("try_pop_batch", 0), ("try_pop_batch", 9)]


def ring_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A ring of three, call by call."""
    ring, rows = Ring(3), []
    for step, (name, *args) in enumerate(_CALLS):
        out = getattr(ring, name)(*args)
        told = "" if out is None else out if isinstance(out, str) else ",".join(map(str, out)) if isinstance(out, list) else " ".join(str(x) for x in out if x is not None)
        s = ring.stats()
        rows.append((step, name, told, s["size"], s["dropped"], s["high_watermark"]))
    return spark.createDataFrame(rows, RING)


_OUTCOMES = [("ok", 1, 0, 1), ("ok", 2, 0, 2), ("ok", 3, 0, 3), ("timeout", 3, 0, 3), ("timeout", 3, 1, 3), ("ok 1", 2, 1, 3), ("ok", 3, 1, 3), ("ok 2", 2, 1, 3), ("3,5", 0, 1, 3), ("timeout", 0, 1, 3), ("timeout", 0, 1, 3), ("ok", 1, 1, 3), ("", 1, 1, 3), ("closed", 1, 1, 3), ("closed", 1, 1, 3), ("closed", 1, 1, 3), ("ok 6", 0, 1, 3), ("closed", 0, 1, 3), ("closed", 0, 1, 3), ("closed", 0, 1, 3), ("", 0, 0, 0), ("ok", 1, 0, 1), ("", 1, 0, 1), ("8", 0, 0, 1)]
RING_SQL = _values(RING, [(k, f"'{call[0]}'", f"'{told}'", *rest) for k, (call, (told, *rest)) in enumerate(zip(_CALLS, _OUTCOMES, strict=True))])
RUNS = "kind string, started boolean, some boolean, nothing_lost boolean, committed boolean, in_sequence boolean, writer_error boolean, healthy boolean"


def recorder_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Recorders that run for a moment: what was generated is what was written and committed, numbers run on, and one whose commit fails stops by itself."""
    import time

    folder, rows = scratch(spark), []
    for name, config, start, fault in [("count", {}, 0, None), ("timer", {"sync_every_batches": 1000, "flush_interval_ms": 20}, 0, None), ("resumed", {}, None, None), ("wrong_start", {}, 7, None), ("failed_commit", {}, 0, Fault("drop_commit", 1))]:
        path = f"{folder}/{'count' if name in ('resumed', 'wrong_start') else name}.log"
        before = validate.validate(path).last_sequence
        r = Recorder(Config(path, hertz=2000.0, push_timeout_ms=1000.0, **config), before if start is None else start, fault)
        if started := r.start():
            for _ in range(200):
                time.sleep(0.02)
                if r.error or r.writer.stats.records_written >= 100:
                    break
            r.stop()
        else:
            r.writer.release()
        s, report = r.stats(), validate.validate(path)
        lost = s["dropped"] or s["generated"] != s["written"]
        rows.append((name, started, s["written"] > 0, not lost, s["written"] == s["committed"], report.last_sequence == before + s["written"], s["writer_error"], report.healthy))
    shutil.rmtree(folder)
    return spark.createDataFrame([(k, st, some, True if k == "failed_commit" else ok, *rest) for k, st, some, ok, *rest in rows], RUNS)


RUNS_SQL = _values(RUNS, [("'count'", True, True, True, True, True, False, True), ("'timer'", True, True, True, True, True, False, True), ("'resumed'", True, True, True, True, True, False, True), ("'wrong_start'", False, False, True, True, True, False, True), ("'failed_commit'", True, True, True, False, True, True, True)])


# Crashes.

CASE = "case_no bigint, seed bigint, crash_site string, fault string, preexisting_sequence bigint, batch_size bigint, ring_capacity bigint, ring_wrap_cycles bigint, partial_cut bigint, expected_sequence bigint"
RESULT = f"{CASE}, acknowledged_sequence bigint, recovered_sequence bigint, recovered_records bigint, child_exit bigint, healthy boolean, contiguous boolean, exact_size boolean, idempotent boolean, passed boolean"


def crash_results(spark: SparkSession) -> DataFrame:
    """All cases, each written, crashed and recovered twice by some task, in the shared folder."""
    folder = scratch(spark)

    def run(frames):
        for frame in frames:
            own = f"{folder}/{uuid.uuid4().hex}"  # a repeated task starts anew
            os.makedirs(own)
            rows = [faults.run_case({k: v if isinstance(v, str) else int(v) for k, v in r.items()}, own) for r in frame.to_dict("records")]
            shutil.rmtree(own)
            yield pd.DataFrame([[r[c] for c in _names(RESULT)] for r in rows], columns=_names(RESULT))

    return faults.case_grid(spark).repartition(8, "case_no").mapInPandas(run, RESULT)


def crash_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return crash_results(spark).select("case_no", "crash_site", "expected_sequence", "recovered_sequence", "recovered_records", "child_exit", "healthy", "contiguous", "exact_size", "idempotent", "passed")


def crash_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Cases passed and failed, counted by Spark and as the JSON report has them."""
    results = crash_results(spark).orderBy("case_no").collect()  # 180 rows
    told = json.loads(faults.crash_report([r.asDict() for r in results]))
    counted = metrics.passed(spark.createDataFrame(results, RESULT))
    return counted.select("*", F.lit(told["crash_cases"]).cast("bigint").alias("json_cases"), F.lit(told["passed"]).cast("bigint").alias("json_passed"), F.lit(told["failed"]).cast("bigint").alias("json_failed"), F.lit(len(told["cases"])).cast("bigint").alias("json_rows"))


#: The grid by the standard recurrence of the 32-bit Mersenne twister, of which a case needs five numbers.
_SITES_SQL = " UNION ALL ".join(f"SELECT {i} AS site, '{name}' AS crash_site, '{fault}' AS fault, {int(acknowledged)} AS acknowledged" for i, (name, fault, acknowledged) in enumerate(faults.GRID))
GRID_SQL = f"""WITH RECURSIVE sites AS ({_SITES_SQL}),
c AS (SELECT i AS case_no, ({faults.SEED} + i * {faults.STRIDE}) & 4294967295 AS seed, (i - 1) // {faults.PER_SITE} AS site FROM range(1, {len(faults.GRID) * faults.PER_SITE + 1}) t(i)),
mt AS (SELECT case_no, 0 AS i, CAST(seed AS BIGINT) AS v FROM c UNION ALL SELECT case_no, i + 1, (1812433253 * xor(v, v >> 30) + i + 1) & 4294967295 FROM mt WHERE i < 402),
twisted AS (SELECT a.case_no, a.i AS k, xor(xor(d.v, ((a.v & 2147483648) | (b.v & 2147483647)) >> 1), CASE WHEN b.v & 1 = 1 THEN 2567483615 ELSE 0 END) AS y FROM mt a JOIN mt b ON a.case_no = b.case_no AND b.i = a.i + 1 JOIN mt d ON a.case_no = d.case_no AND d.i = a.i + 397 WHERE a.i < 5),
t1 AS (SELECT case_no, k, xor(y, y >> 11) AS y FROM twisted), t2 AS (SELECT case_no, k, xor(y, (y << 7) & 2636928640) AS y FROM t1), t3 AS (SELECT case_no, k, xor(y, (y << 15) & 4022730752) AS y FROM t2),
drawn AS (SELECT case_no, list(xor(y, y >> 18) ORDER BY k) AS r FROM t3 GROUP BY case_no),
g AS (SELECT c.case_no, c.seed, s.crash_site, s.fault, s.acknowledged, 1 + r[1] % 23 AS existing, 1 + r[2] % 8 AS batch, r FROM c JOIN sites s USING (site) JOIN drawn USING (case_no)),
w AS (SELECT *, CASE crash_site WHEN 'during_main_write' THEN batch * 84 WHEN 'during_checkpoint_write' THEN 52 END AS torn FROM g),
grid AS (SELECT CAST(case_no AS BIGINT) AS case_no, CAST(seed AS BIGINT) AS seed, crash_site, fault, CAST(existing AS BIGINT) AS preexisting_sequence, CAST(batch AS BIGINT) AS batch_size, CAST(batch + 1 + r[3] % 5 AS BIGINT) AS ring_capacity, CAST(1 + r[4] % 4 AS BIGINT) AS ring_wrap_cycles, CAST(CASE WHEN torn IS NULL THEN 0 ELSE 1 + r[5] % (torn - 1) END AS BIGINT) AS partial_cut, CAST(existing + batch * acknowledged AS BIGINT) AS expected_sequence FROM w)
"""
_EXITS = " ".join(f"WHEN '{name}' THEN {code}" for name, code in (("before_main_write", 81), ("during_main_write", 92), ("after_main_write_before_sync", 83), ("after_main_sync_before_checkpoint", 85), ("during_checkpoint_write", 87), ("after_journal_sync", 90)))
MATRIX_SQL = f"{GRID_SQL} SELECT case_no, crash_site, expected_sequence, expected_sequence AS recovered_sequence, expected_sequence AS recovered_records, CAST(CASE crash_site {_EXITS} END AS BIGINT) AS child_exit, true AS healthy, true AS contiguous, true AS exact_size, true AS idempotent, true AS passed FROM grid"
TOTALS_SQL = "SELECT CAST(180 AS BIGINT) AS cases, CAST(180 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS failed, CAST(180 AS BIGINT) AS json_cases, CAST(180 AS BIGINT) AS json_passed, CAST(0 AS BIGINT) AS json_failed, CAST(180 AS BIGINT) AS json_rows"


# Flights.


def _ramps(name: str) -> list[tuple[float, float]]:
    return [(base, base) for base, _, _ in simulate.WAVES] if name == "Cruise" else list(simulate.RAMPS[name][:-1])


def profile_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Progress and the targets of each place in the profile; in cruise, the values that its waves go around."""
    rows = []
    for i, (name, progress) in enumerate(simulate.PLACES):
        rows.append((i, name, progress, *(float(a + (b - a) * progress) for a, b in _ramps(name))))
    return spark.createDataFrame(rows, "profile_index bigint, phase string, progress double, altitude_m double, airspeed_kts double, vertical_speed_fpm double, engine_temperature_c double, engine_rpm double")


_STARTS = [sum(length for _, length in simulate.PHASES[:k]) for k in range(len(simulate.PHASES))]
_PLACES_SQL = " UNION ALL ".join(f"SELECT i AS profile_index, '{name}' AS phase, (i - {start}) / {float(length - 1)} AS x, " + ", ".join(f"{float(a)} AS a{k}, {float(b)} AS b{k}" for k, (a, b) in enumerate(_ramps(name))) + f" FROM range({start}, {start + length}) t(i)" for (name, length), start in zip(simulate.PHASES, _STARTS, strict=True))
TARGETS_SQL = f"WITH p AS ({_PLACES_SQL}), q AS (SELECT *, CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * (3 - 2 * CAST(x AS DOUBLE)) AS progress FROM p) SELECT profile_index, phase, progress, " + ", ".join(f"CAST(a{k} AS DOUBLE) + (CAST(b{k} AS DOUBLE) - CAST(a{k} AS DOUBLE)) * progress AS {c}" for k, c in enumerate(("altitude_m", "airspeed_kts", "vertical_speed_fpm", "engine_temperature_c", "engine_rpm"))) + " FROM q"

#: Two passes of the profile's part that repeats.
FLOWN = simulate.TOTAL + simulate.TOTAL - simulate.WRAP


def _flights(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.sessions(spark, spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("bigint").alias("session")).distinct(), FLOWN)


def simulate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A flight for each user: where its flags stand, and whether its values keep their ranges."""
    flag = lambda name: F.col("system_status").bitwiseAND(layout.STATUS[name]) != 0
    count = lambda name: F.count_if(flag(name)).alias(name)
    kept = F.col("heading_deg").between(0, 360) & (F.col("altitude_m") >= 0) & (F.col("airspeed_kts") > -20) & (F.col("system_status").bitwiseAND(1) == 1)
    ended = Window.partitionBy("session").orderBy("sample")
    f = _flights(spark, sf).withColumn("period", F.col("timestamp_us") - F.lag("timestamp_us").over(ended))
    at = F.array_sort(F.collect_list(F.when(flag("flight_phase_transition"), F.col("sample"))))
    return f.groupBy("session").agg(F.count("*").alias("samples"), F.array_join(at.cast("array<string>"), ",").alias("transitions"), count("altitude_deviation"), count("sensor_glitch"), count("pitot_disagree"), count("recorder_buffer_overrun"), F.bool_and(kept).alias("in_range"), (F.count_if(flag("engine_warning")) >= simulate.SPIKE[2]).alias("warned"), F.min("period").alias("least_period_us"), F.max("period").alias("most_period_us"))


FLAGS_SQL = f"SELECT DISTINCT CAST(user_id AS BIGINT) AS session, CAST({FLOWN} AS BIGINT) AS samples, '25,45,115,235,300,335,455,520' AS transitions, CAST(8 AS BIGINT) AS altitude_deviation, CAST(6 AS BIGINT) AS sensor_glitch, CAST(6 AS BIGINT) AS pitot_disagree, CAST(0 AS BIGINT) AS recorder_buffer_overrun, true AS in_range, true AS warned, CAST(50000 AS BIGINT) AS least_period_us, CAST(50000 AS BIGINT) AS most_period_us FROM events"


# Rates and drops.


def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of a counter for each user at the times of the user's events: it goes up by what the event is worth."""
    t = telemetry(spark, sf).select(F.col("airspeed_kts").cast("bigint").alias("session"), F.col("timestamp_us").alias("at_us"), "sequence", F.floor(F.col("altitude_m") * 1e6).cast("bigint").alias("worth"))
    run = Window.partitionBy("session").orderBy("at_us", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    return metrics.counter_rates(t.withColumn("written", F.sum("worth").over(run)).select("session", "at_us", "written"))


RATES_SQL = "WITH e AS (SELECT CAST(user_id AS BIGINT) AS session, epoch_us(ts) AS at_us, event_id, CAST(floor(value * 1e6) AS BIGINT) AS worth FROM events), w AS (SELECT session, at_us, CAST(sum(worth) OVER (PARTITION BY session ORDER BY at_us, event_id) AS BIGINT) AS written FROM e), r AS (SELECT *, CAST(floor((written - lag(written) OVER o) / ((at_us - lag(at_us) OVER o) / 1e6)) AS BIGINT) AS rate FROM w WINDOW o AS (PARTITION BY session ORDER BY at_us)) SELECT session, at_us, written, rate FROM r WHERE rate IS NOT NULL"

#: A queue of two that serves one in six hours and waits two, folded over each user's events.
DROPS_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS session, event_id + 1 AS nth, epoch_us(ts) AS at_us, CAST(1 + CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'click' THEN 40 WHEN 'signup' THEN 128 ELSE 0 END AS BIGINT) AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
q AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS free, CAST([] AS DOUBLE[]) AS leaves, false AS after_drop, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS at_us, false AS dropped, false AS overrun, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS status FROM (SELECT DISTINCT session FROM e)
UNION ALL SELECT session, k, CASE WHEN drops THEN free ELSE greatest(free, enters) + 21600000000.0 END, CASE WHEN drops THEN alive ELSE list_append(alive, greatest(free, enters) + 21600000000.0) END, drops, CASE WHEN drops THEN seq ELSE seq + 1 END, nth, at_us, drops, after_drop, CAST(CASE WHEN drops THEN len(alive) ELSE len(list_filter(list_append(alive, greatest(free, enters) + 21600000000.0), lambda x: x > enters)) END AS BIGINT), status
FROM (SELECT *, len(alive) >= 2 AND enters > at_us + 7200000000.0 AS drops FROM (SELECT *, CASE WHEN len(alive) >= 2 THEN alive[len(alive) - 1] ELSE CAST(at_us AS DOUBLE) END AS enters FROM (SELECT q.session, e.k, q.free, list_filter(q.leaves, lambda x: x > e.at_us) AS alive, q.after_drop, q.seq, e.nth, e.at_us, e.status FROM q JOIN e ON e.session = q.session AND e.k = q.k + 1))))
SELECT session, CAST(nth AS BIGINT) AS sample, at_us AS timestamp_us, dropped, overrun, depth, CASE WHEN dropped THEN NULL ELSE seq END AS sequence, status | CASE WHEN overrun THEN 16 ELSE 0 END AS system_status FROM q WHERE k > 0"""

QUERIES: dict[str, tuple] = {
    "scan_cases": (scan_cases, SCAN_SQL),
    "invalid_lines": (invalid_lines, LINES_SQL),
    "recovery_cases": (recovery_cases, RECOVERY_SQL),
    "legacy_journals": (legacy_journals, LEGACY_SQL),
    "writer_cases": (writer_cases, WRITER_SQL),
    "ring_steps": (ring_steps, RING_SQL),
    "recorder_runs": (recorder_runs, RUNS_SQL),
    "crash_matrix": (crash_matrix, MATRIX_SQL),
    "crash_totals": (crash_totals, TOTALS_SQL),
    "crash_case_grid": (lambda spark, sf: faults.case_grid(spark), f"{GRID_SQL} SELECT * FROM grid"),
    "profile_targets": (profile_targets, TARGETS_SQL),
    "simulate_sessions": (_flights, None),
    "simulate_flags": (simulate_flags, FLAGS_SQL),
    "counter_rates": (counter_rates, RATES_SQL),
}
