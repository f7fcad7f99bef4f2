"""Checkpoint slots and the accounting of group commits."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import layout, schema
from tidelog.operators.validate import Report
from tidelog.sources.files import local, opened


def read_slots(path: str) -> list[dict]:
    """The two slots of a log's journal."""
    with open(local(layout.journal_path(path)), "rb") as f:
        raw = f.read()
    if len(raw) != layout.JOURNAL_BYTES:
        raise ValueError("the journal doesn't hold two slots")
    return layout.slots(raw)


def slot_rows(spark: SparkSession, slots: list[dict]) -> DataFrame:
    from decimal import Decimal

    return spark.createDataFrame([tuple(v if k in ("slot", "slot_valid") else Decimal(v) for k, v in s.items()) for s in slots], schema.SLOT)


def consistent(slots: DataFrame, log: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds `consistent`: the slot is valid and describes a prefix of the log. log: one row of recorder_start_time_us, valid_bytes. sequences: record_index, sequence of the log's records."""
    body = F.col("committed_length") - layout.HEADER_BYTES
    fits = F.col("slot_valid") & (F.col("recorder_start_time_us") == F.col("log_start")) & (F.col("committed_length") >= layout.HEADER_BYTES) & (F.col("committed_length") <= F.col("valid_bytes")) & (body % layout.RECORD_BYTES == 0) & (F.col("record_count") * layout.RECORD_BYTES == body)
    joined = slots.crossJoin(F.broadcast(log.select(F.col("recorder_start_time_us").alias("log_start"), "valid_bytes")))  # two rows by one
    at = sequences.select((F.col("record_index") + 1).cast("decimal(20,0)").alias("record_count"), F.col("sequence").cast("decimal(20,0)").alias("at_sequence"))
    ends = F.when(F.col("record_count") == 0, F.col("last_sequence") == 0).otherwise(F.coalesce(F.col("at_sequence") == F.col("last_sequence"), F.lit(False)))
    return joined.join(at, "record_count", "left").withColumn("consistent", fits & ends).select(*slots.columns, "consistent")


def newest(slots: DataFrame) -> DataFrame:
    """The consistent slot of the highest generation; the earlier slot of equal ones; no row if there is none."""
    best = F.max_by(F.struct(*slots.columns), F.struct("generation", -F.col("slot")))
    return slots.filter("consistent").agg(best.alias("s")).filter("s is not null").select("s.*")


def select_local(path: str, slots: list[dict], start_us: int, report: Report) -> dict | None:
    """As consistent and newest, with single reads of the log."""
    best = None
    with opened(path) as f:
        for s in slots:
            body = s["committed_length"] - layout.HEADER_BYTES
            if not s["slot_valid"] or s["recorder_start_time_us"] != start_us or not layout.HEADER_BYTES <= s["committed_length"] <= report.valid_bytes or body % layout.RECORD_BYTES or s["record_count"] != body // layout.RECORD_BYTES:
                continue
            last = int(layout.decode(f.read_at(layout.RECORD_BYTES, s["committed_length"] - layout.RECORD_BYTES))["sequence"][0]) if body else 0
            if last == s["last_sequence"] and (best is None or s["generation"] > best["generation"]):
                best = s
    return best


def write_first(path: str, start_us: int, report: Report) -> None:
    """A journal of generation 1 for a log's valid prefix, in slot 0."""
    fd = os.open(local(layout.journal_path(path)), os.O_CREAT | os.O_RDWR | os.O_TRUNC, 0o644)
    try:
        os.pwrite(fd, layout.slot(1, start_us, report.valid_bytes, report.valid_records, report.last_sequence).ljust(layout.JOURNAL_BYTES, b"\0"), 0)
        os.fdatasync(fd)
    finally:
        os.close(fd)


def batches(rows: DataFrame, size: int, order: str = "sequence") -> DataFrame:
    """session, batch, first_us, records: rows of a session in batches of `size` by order. rows: session, order and timestamp_us; order runs on without gaps in a session."""
    low = rows.groupBy("session").agg(F.min(order).alias("low"))
    return rows.join(low, "session").groupBy("session", F.floor((F.col(order) - F.col("low")) / size).cast("bigint").alias("batch")).agg(F.min("timestamp_us").alias("first_us"), F.count("*").alias("records"))


def commits_by_count(b: DataFrame, every: int) -> DataFrame:
    """session, commit, batches, records: a commit after each `every` batches, the last may be short."""
    return b.groupBy("session", F.floor(F.col("batch") / every).cast("bigint").alias("commit")).agg(F.count("*").alias("batches"), F.sum("records").alias("records"))


def commits_by_timer(b: DataFrame, interval_us: int, every: int) -> DataFrame:
    """session, commit, first_batch, batches, records. A commit opens with the first pending batch and takes those that come before that one's time plus the interval, `every` at most.
    Where a commit ends depends on where it began, so a session is folded in order by one task; sessions run side by side, and a session has a row per batch here."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        out, opened_at, taken = [], None, 0
        for session, batch, at, n in zip(pdf["session"], pdf["batch"], pdf["first_us"], pdf["records"], strict=True):
            if opened_at is None or at >= opened_at + interval_us or taken == every:
                opened_at, taken = at, 0
                out.append([session, len(out), batch, 0, 0])
            taken += 1
            out[-1][3] += 1
            out[-1][4] += n
        return pd.DataFrame(out, columns=["session", "commit", "first_batch", "batches", "records"])

    return b.groupBy("session").applyInPandas(fold, "session bigint, commit bigint, first_batch bigint, batches bigint, records bigint")
