"""Spark schemas and column expressions over records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TELEMETRY = "sequence BIGINT NOT NULL, timestamp_us BIGINT NOT NULL, altitude_m DOUBLE NOT NULL, airspeed_kts DOUBLE NOT NULL, heading_deg DOUBLE NOT NULL, vertical_speed_fpm DOUBLE NOT NULL, engine_temperature_c DOUBLE NOT NULL, engine_rpm DOUBLE NOT NULL, system_status BIGINT NOT NULL"
#: sequence and timestamp_us hold the unsigned fields' bits; tail_kind names what the bytes after the last whole record lack.
RAW = TELEMETRY.replace(" NOT NULL", "") + ", record_index BIGINT, byte_offset BIGINT, meta_ok BOOLEAN, crc_stored BIGINT, crc_ok BOOLEAN, seq_ok BOOLEAN, tail_kind STRING"
SLOT = "slot INT, generation DECIMAL(20,0), recorder_start_time_us DECIMAL(20,0), committed_length DECIMAL(20,0), record_count DECIMAL(20,0), last_sequence DECIMAL(20,0), slot_valid BOOLEAN"


def unsigned(bits: Column) -> Column:
    """The unsigned value of a 64-bit field."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.expr("18446744073709551616BD")).otherwise(wide).cast("decimal(20,0)")


def status_hex(status: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(status)))


def has_flag(status: Column, flag: int) -> Column:
    return status.bitwiseAND(flag) != 0
