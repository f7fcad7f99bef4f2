"""Recording as a structured stream: samples from Spark's rate source to a committed log, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.functions import layout
from tidelog.sources.log_source import register


def log_stream(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """A log's committed records as a stream of telemetry rows. max_records: see the source."""
    register(spark)
    bound = {} if max_records is None else {"max_records": str(max_records)}
    return spark.readStream.format("telemetrylog").options(path=path, **bound).load().select(*layout.COLUMNS)


def record_stream(rows: DataFrame, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Appends a stream of telemetry rows to a log: each micro-batch is ordered, written by one task and committed to the journal. Stops by itself at the end of what is there."""
    register(rows.sparkSession)
    writer = rows.select(*layout.COLUMNS).coalesce(1).writeStream.format("telemetrylog").options(path=path, **{k: str(v) for k, v in options.items()})
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(rows: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """window_start, records: records in windows of event time, closed once the watermark passes."""
    timed = rows.withColumn("ts", F.timestamp_micros("timestamp_us")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("records")).select(F.col("w.start").alias("window_start"), "records")


def observed(rows: DataFrame, name: str = "recorder") -> DataFrame:
    """Counters for a listener: rows, and rows that carry the overrun flag."""
    return rows.observe(name, F.count("*").alias("generated"), F.count_if(F.col("system_status").bitwiseAND(layout.STATUS["recorder_buffer_overrun"]) != 0).alias("overruns"), F.max("sequence").alias("last_sequence"))


class LiveStatus(StreamingQueryListener):
    """Keeps, and prints if asked, a line for each micro-batch."""

    def __init__(self, show: bool = False):
        self.lines: list[str] = []
        self.show = show

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines.append(f"batch={p.batchId} rows={p.numInputRows} rows_per_second={p.processedRowsPerSecond:.0f}")
        if self.show:
            print(self.lines[-1], flush=True)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
