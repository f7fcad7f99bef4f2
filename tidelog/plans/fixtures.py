"""Logs made from the events table."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import layout
from tidelog.operators import faults
from tidelog.sources.files import scratch
from tidelog.sources.log_source import register

START_US = 1_700_000_000_000_000
#: The events as telemetry, in DuckDB's SQL.
TELEMETRY_SQL = """SELECT event_id + 1 AS sequence, epoch_us(ts) AS timestamp_us, value AS altitude_m, CAST(user_id AS DOUBLE) AS airspeed_kts,
CAST((event_id * 7) % 360 AS DOUBLE) AS heading_deg, value - 250 AS vertical_speed_fpm, value + 400 AS engine_temperature_c,
CAST((event_id % 100) * 25 AS DOUBLE) AS engine_rpm,
CAST(1 + CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'click' THEN 40 WHEN 'signup' THEN 128 ELSE 0 END AS BIGINT) AS system_status FROM events"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    added = F.create_map(*[F.lit(x) for kv in (("error", 2), ("purchase", 4), ("click", 40), ("signup", 128)) for x in kv])
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select((F.col("event_id") + 1).alias("sequence"), micros.alias("timestamp_us"), F.col("value").alias("altitude_m"), F.col("user_id").cast("double").alias("airspeed_kts"), ((F.col("event_id") * 7) % 360).cast("double").alias("heading_deg"), (F.col("value") - 250).alias("vertical_speed_fpm"), (F.col("value") + 400).alias("engine_temperature_c"), ((F.col("event_id") % 100) * 25).cast("double").alias("engine_rpm"), (1 + F.coalesce(F.try_element_at(added, F.col("event_type")), F.lit(0))).cast("bigint").alias("system_status"))


def write_log(rows: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Telemetry rows, in order of sequence, to a log."""
    register(rows.sparkSession)
    ordered = rows.select(*layout.COLUMNS).repartitionByRange("sequence").sortWithinPartitions("sequence")
    ordered.write.format("telemetrylog").options(path=path, **{k: str(v) for k, v in options.items()}).mode(mode).save()


_made: dict[tuple[str, str], str] = {}


def events_log(spark: SparkSession, sf_dir: str) -> str:
    """The path of a log of all events, written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made or not os.path.exists(_made[key]):
        path = f"{scratch(spark)}/events.log"
        write_log(telemetry(spark, sf_dir), path, start_us=START_US)
        _made[key] = path
    return _made[key]


def damaged(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A copy of the log of all events, damaged in its middle or at its end: crc, meta, gap, dup, tail (10 bytes cut off), header."""
    source = events_log(spark, sf_dir)
    path = f"{scratch(spark)}/{kind}.log"
    shutil.copyfile(source, path)
    shutil.copyfile(layout.journal_path(source), layout.journal_path(path))
    middle = (os.path.getsize(path) - layout.HEADER_BYTES) // layout.RECORD_BYTES // 2  # the sequence of the record before the damaged one
    if kind == "crc":
        faults.corrupt_byte(path, middle + 1, 40)
    elif kind == "meta":
        faults.corrupt_byte(path, middle + 1, 0)
    elif kind == "gap":
        faults.rewrite_sequence(path, middle, middle + 3)
    elif kind == "dup":
        faults.rewrite_sequence(path, middle, middle)
    elif kind == "tail":
        faults.truncate_tail(path, 10)
    elif kind == "header":
        with open(path, "r+b") as f:
            f.seek(16)
            f.write(b"\x55")
    return path
