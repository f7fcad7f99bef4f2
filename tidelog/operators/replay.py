"""Range, limit, summary and renderings of a log's valid prefix.

Sequences run on from the first record's, so a range of them is a range of records: it is read by a seek, not by a filter over
the log. The limit shortens that range too.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions import layout, schema
from tidelog.operators.validate import Report, records, validate
from tidelog.sources.log_source import shape

CSV_HEADER = ",".join(layout.COLUMNS)
#: The table's headings and widths.
TABLE = [("SEQ", 8), ("TIMESTAMP_US", 18), ("ALT_M", 12), ("AIRSPEED_KTS", 14), ("HEADING_DEG", 13), ("VS_FPM", 12), ("ENG_TEMP_C", 14), ("ENG_RPM", 12), ("STATUS", 0)]
EXTREMES = {"altitude_m": "altitude_m", "airspeed_kts": "airspeed_kts", "engine_temperature_c": "engine_temp_c"}


@dataclass
class Replay:
    rows: DataFrame
    report: Report
    count: int


def replay(spark: SparkSession, path: str, low: int = 0, high: int = layout.U64_MAX, most: int | None = None, unsigned: str = "long", report: Report | None = None) -> Replay:
    """Records of sequence low to high, both included, at most `most` of them. A limit of 0 gives one row, as long as the range has any. report: of a validation of this log as it is, if there was one; else it is validated."""
    if low > high:
        raise ValueError("the range's start lies behind its end")
    report = report or validate(path, spark)
    first = shape(path)[3] if report.valid_records else 0
    start = max(0, low - first)
    end = max(start, min(report.valid_records, high - first + 1))
    if most is not None:
        end = min(end, start + max(1, most))
    return Replay(records(spark, path, start, end, unsigned), report, end - start)


def points(path: str, sequences: list[int], report: Report) -> list[int | None]:
    """The record index of each sequence in the valid prefix, None where it holds no such record. The report of one validation serves any number of lookups."""
    first = shape(path)[3]
    return [s - first if first <= s < first + report.valid_records else None for s in sequences]


def point(spark: SparkSession, path: str, sequence: int) -> int | None:
    """The record index of a sequence in the valid prefix."""
    return points(path, [sequence], validate(path, spark))[0]


def summary(rows: DataFrame, report: Report, prefix: str = "") -> DataFrame:
    """One row: count, invalid records (of the log, not of the rows), first and last timestamp in log order, and extremes; zeros for no rows. A NaN counts only where all values are."""
    zero = lambda c, of: F.coalesce(c, F.lit(of))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    extremes = [zero(F.coalesce(f(real(c)), f(c)), 0.0).alias(f"{n}_{c}") for c in EXTREMES for n, f in (("min", F.min), ("max", F.max))]
    return rows.agg(F.count("*").alias("total_valid_records"), F.lit(int(report.corruption_detected)).cast("bigint").alias("invalid_records"), F.lit(report.checksum_failures).cast("bigint").alias("checksum_failures"), zero(F.min_by("timestamp_us", "sequence"), 0).alias("first_timestamp_us"), zero(F.max_by("timestamp_us", "sequence"), 0).alias("last_timestamp_us"), *extremes)


def summary_line(s: DataFrame) -> DataFrame:
    """line: the summary as key=value."""
    parts = ["total_valid_records=%d", "invalid_corrupt_records=%d", "checksum_failures=%d", "first_timestamp_us=%d", "last_timestamp_us=%d"]
    columns = ["total_valid_records", "invalid_records", "checksum_failures", "first_timestamp_us", "last_timestamp_us"]
    for c, name in EXTREMES.items():
        parts += [f"min_{name}=%.2f", f"max_{name}=%.2f"]
        columns += [f"min_{c}", f"max_{c}"]
    return s.select(F.format_string("summary " + " ".join(parts), *columns).alias("line"))


@F.pandas_udf(StringType())
def six_digits(*columns: pd.Series) -> pd.Series:
    """Doubles with six significant digits, trailing zeros left out (Spark's own format keeps them), those of a row with commas between."""
    line = ",".join(["%.6g"] * len(columns))
    return pd.Series([line % row for row in zip(*columns, strict=True)], dtype=object)


def csv_lines(rows: DataFrame) -> DataFrame:
    """sequence, line: a CSV line of each row, status in decimal."""
    text = lambda c: F.col(c).cast("string")
    return rows.select("sequence", F.concat_ws(",", text("sequence"), text("timestamp_us"), six_digits(*layout.COLUMNS[2:-1]), text("system_status")).alias("line"))


def table_lines(rows: DataFrame) -> DataFrame:
    """sequence, line: a line of the table for each row, numbers with two decimals, status in hexadecimal."""
    values: list[Column] = []
    for (_, width), c in zip(TABLE, layout.COLUMNS, strict=True):
        text = schema.status_hex(F.col(c)) if c == "system_status" else F.col(c).cast("string") if c in ("sequence", "timestamp_us") else F.format_string("%.2f", c)
        values.append(F.when(F.length(text) >= width, text).otherwise(F.rpad(text, max(width, 1), " ")) if width else text)
    return rows.select("sequence", F.concat(*values).alias("line"))


def table_header() -> str:
    return "".join(name.ljust(width) for name, width in TABLE)


def invalid_line(report: Report) -> str:
    return f'invalid_record first_bad_record_index={report.first_bad_record_index} first_bad_record_sequence={report.first_bad_record_sequence} corruption_offset={report.corruption_offset} valid_bytes={report.valid_bytes} bytes_scanned={report.bytes_scanned} expected_sequence={report.expected_sequence} reason="{report.message}"'


def write_csv(rows: DataFrame, path: str) -> int:
    """One file with a heading, replaced if it exists; rows stream through the driver a partition at a time. Gives the rows written."""
    n = 0
    with open(path, "w") as out:
        out.write(CSV_HEADER + "\n")
        for r in csv_lines(rows).orderBy("sequence").select("line").toLocalIterator(prefetchPartitions=True):
            out.write(r["line"] + "\n")
            n += 1
    return n


def write_csv_folder(rows: DataFrame, folder: str) -> None:
    """Lines in files by ranges of sequences, written by all tasks; the way for large logs."""
    csv_lines(rows).repartitionByRange("sequence").sortWithinPartitions("sequence").select("line").write.mode("overwrite").text(folder)
