"""The longest valid prefix of a log, found in parallel, and the report on what ends it.

A record's validity needs no neighbour (see `checked` in the source), so tasks check ranges on their own and send back only the rows that
fail; the first of these by index ends the prefix. Readers of the prefix then seek: they never touch what lies behind it.
"""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, replace
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import layout, schema
from tidelog.sources.files import local
from tidelog.sources.log_source import checked, register, shape

HEALTHY = "Log validated successfully"
#: Logs up to this size are checked on the driver.
SMALL_BYTES = 16 << 20


@dataclass(frozen=True)
class Report:
    healthy: bool = False
    truncated: bool = False
    corruption_detected: bool = False
    valid_records: int = 0
    valid_bytes: int = 0
    bytes_scanned: int = 0
    last_sequence: int = 0
    checksum_failures: int = 0
    first_bad_record_index: int = 0
    first_bad_record_sequence: int = 0
    corruption_offset: int = 0
    expected_sequence: int = 0
    message: str = ""

    def row(self, spark: SparkSession) -> DataFrame:
        """One row; counts and offsets as BIGINT."""
        values = asdict(self)
        values |= {c: Decimal(values[c]) for c in ("last_sequence", "first_bad_record_sequence", "expected_sequence")}
        return spark.createDataFrame([tuple(values.values())], "healthy boolean, truncated boolean, corruption_detected boolean, valid_records bigint, valid_bytes bigint, bytes_scanned bigint, last_sequence decimal(20,0), checksum_failures bigint, first_bad_record_index bigint, first_bad_record_sequence decimal(20,0), corruption_offset bigint, expected_sequence decimal(20,0), message string").withColumns({c: F.col(c).cast("bigint") for c in ("last_sequence", "first_bad_record_sequence", "expected_sequence")})


def _described(size: int, whole: int, first: int, bad: dict | None) -> Report:
    """bad: the first failing row (index, sequence, meta_ok, crc_ok, tail_kind), None if there is none."""
    valid = whole if bad is None else bad["index"]
    off = layout.HEADER_BYTES + layout.RECORD_BYTES * valid
    last = first + valid - 1 if valid else 0
    out = Report(True, valid_records=valid, valid_bytes=off, bytes_scanned=size, last_sequence=last, first_bad_record_index=valid + 1, first_bad_record_sequence=last, corruption_offset=off, message=HEALTHY)
    if bad is None:
        return out
    out = replace(out, healthy=False, corruption_detected=True)
    if bad["tail_kind"] == "header":
        return replace(out, message="Detected partial record header at end of file")
    out = replace(out, first_bad_record_sequence=bad["sequence"])
    if not bad["meta_ok"]:
        return replace(out, bytes_scanned=off + layout.RECORD_HEADER_BYTES, message="Detected invalid record metadata")
    if bad["tail_kind"]:
        return replace(out, message=f"Detected truncated record {'payload' if bad['tail_kind'] == 'payload' else 'CRC'}")
    out = replace(out, bytes_scanned=off + layout.RECORD_BYTES)
    if not bad["crc_ok"]:
        return replace(out, checksum_failures=1, message="Detected CRC mismatch")
    expected = (last + 1) & layout.U64_MAX
    return replace(out, expected_sequence=expected, message=f"Detected non-contiguous record sequence: expected {expected}, observed {bad['sequence']}")


def _first_bad_local(path: str, size: int, whole: int, first: int) -> dict | None:
    with open(local(path), "rb") as f:
        f.seek(layout.HEADER_BYTES)
        raw = f.read()
    r = layout.decode(raw)
    meta, crc, seq = checked(r, 0, first)
    if len(bad := np.flatnonzero(~(meta & crc & seq))):
        i = int(bad[0])
        return {"index": i, "sequence": int(r["sequence"][i]), "meta_ok": bool(meta[i]), "crc_ok": bool(crc[i]), "tail_kind": None}
    rest = raw[whole * layout.RECORD_BYTES :]
    if not rest:
        return None
    t = layout.decode(rest.ljust(layout.RECORD_BYTES, b"\0"))
    kind = "header" if len(rest) < layout.RECORD_HEADER_BYTES else "payload" if len(rest) < 80 else "crc"
    return {"index": whole, "sequence": int(t["sequence"][0]), "meta_ok": kind == "header" or bool(layout.meta_ok(t)[0]), "crc_ok": False, "tail_kind": kind}


def raw_scan(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Every record of a log with a usable header, and its partial tail, with the checks' outcomes."""
    register(spark)
    return spark.read.format("telemetrylog").options(path=path, **{k: str(v).lower() for k, v in options.items()}).load()


def _first_bad(spark: SparkSession, path: str, task_records: int | None) -> dict | None:
    sized = {} if task_records is None else {"task_records": task_records}
    bad = raw_scan(spark, path, only_bad=True, **sized).agg(F.min_by(F.struct("record_index", schema.unsigned(F.col("sequence")).alias("sequence"), "meta_ok", "crc_ok", "tail_kind"), "record_index").alias("bad")).first()["bad"]
    return bad and {"index": bad["record_index"], "sequence": int(bad["sequence"] or 0), "meta_ok": bad["meta_ok"], "crc_ok": bad["crc_ok"], "tail_kind": bad["tail_kind"]}


def _exists(path: str) -> bool:
    return "://" in path and not path.startswith("file:") or os.path.exists(local(path))


def validate(path: str, spark: SparkSession | None = None, task_records: int | None = None) -> Report:
    """Checks a log and changes nothing. With a session, logs beyond SMALL_BYTES are checked by tasks, and those of any size are where task_records says how many records a task takes."""
    if not _exists(path):
        return Report(True, message="Log file not present")
    size, head, whole, first = shape(path)
    if fault := layout.header_fault(head):
        return Report(corruption_detected=True, bytes_scanned=len(head), message=fault)
    bad = _first_bad_local(path, size, whole, first) if spark is None or (task_records is None and size <= SMALL_BYTES) else _first_bad(spark, path, task_records)
    return _described(size, whole, first, bad)


def recover(path: str, truncate: bool, spark: SparkSession | None = None) -> Report:
    """validate, and where asked, an invalid tail is cut off and the log checked again."""
    report = validate(path, spark)
    if report.healthy or not truncate or report.valid_bytes < layout.HEADER_BYTES:
        return report
    os.truncate(local(path), report.valid_bytes)
    again = validate(path, spark)
    return replace(again, truncated=True, message=f"{again.message}; log prefix recovered")


def metadata(path: str) -> dict[str, int]:
    """format_version, recorder_start_time_us, record_size; zeros without a usable header."""
    head = shape(path)[1] if _exists(path) else b""
    if layout.header_fault(head):
        return {"format_version": 0, "recorder_start_time_us": 0, "record_size": 0}
    h = np.frombuffer(head, layout.FILE_HEADER)[0]
    return {"format_version": int(h["version"]), "recorder_start_time_us": int(h["recorder_start_time_us"]), "record_size": int(h["record_size"])}


def header_rows(spark: SparkSession, path: str) -> DataFrame:
    m = metadata(path)
    return spark.createDataFrame([(m["format_version"], m["recorder_start_time_us"], m["record_size"])], "format_version bigint, recorder_start_time_us bigint, record_size bigint")


def records(spark: SparkSession, path: str, low: int, high: int, unsigned: str = "long") -> DataFrame:
    """The records of index low to high - 1, in telemetry columns. unsigned: "long" fails on a value beyond BIGINT, "decimal" has DECIMAL(20,0)."""
    if high <= low:
        kinds = "sequence decimal(20,0), timestamp_us decimal(20,0)" if unsigned == "decimal" else "sequence bigint, timestamp_us bigint"
        return spark.createDataFrame([], f"{kinds}, altitude_m double, airspeed_kts double, heading_deg double, vertical_speed_fpm double, engine_temperature_c double, engine_rpm double, system_status bigint")
    rows = raw_scan(spark, path, from_index=low, to_index=high)
    wide = {c: schema.unsigned(F.col(c)) for c in ("sequence", "timestamp_us")}
    if unsigned != "decimal":
        wide = {c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} passes the largest BIGINT; read with unsigned='decimal'")).cast("bigint")) for c in wide}
    return rows.withColumns(wide).select(*layout.COLUMNS)


def valid_prefix(spark: SparkSession, path: str, unsigned: str = "long") -> tuple[DataFrame, Report]:
    """The rows before the first bad one, whether or not the log is healthy, and the report."""
    report = validate(path, spark)
    return records(spark, path, 0, report.valid_records, unsigned), report


def read_log(spark: SparkSession, path: str, unsigned: str = "long") -> DataFrame:
    """All rows of a healthy log; raises for any other."""
    rows, report = valid_prefix(spark, path, unsigned)
    if not report.healthy:
        raise ValueError(report.message)
    return rows
