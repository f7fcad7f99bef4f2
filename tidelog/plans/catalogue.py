"""The registered queries of the log engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import layout, schema
from tidelog.operators import checkpoint, metrics, recovery, replay, simulate, validate
from tidelog.plans import cases
from tidelog.plans.fixtures import START_US, TELEMETRY_SQL, damaged, events_log, telemetry
from tidelog.streaming.queue_model import simulate as simulate_queue

WITH = f"WITH t AS ({TELEMETRY_SQL}), n AS (SELECT count(*) AS n, count(*) // 2 AS half FROM events)"
RANGE, LIMIT = (101, 400), 25
ONE = ("healthy", "truncated", "corruption_detected", "valid_records", "valid_bytes", "bytes_scanned", "last_sequence", "checksum_failures", "first_bad_record_index", "first_bad_record_sequence", "corruption_offset", "expected_sequence", "message")


def _report_sql(valid: str, scanned: str, sums: str, bad: str, expected: str, message: str, healthy: str = "false", truncated: str = "false") -> str:
    end = f"24 + 84 * ({valid})"
    values = (healthy, truncated, "false" if healthy == "true" else "true", valid, end, scanned, valid, sums, f"({valid}) + 1", bad, end, expected)
    columns = ", ".join(f"CAST({v} AS {'BOOLEAN' if i < 3 else 'BIGINT'}) AS {c}" for i, (v, c) in enumerate(zip(values, ONE, strict=False)))
    return f"{WITH} SELECT {columns}, {message} AS message FROM n"


def scan_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return validate.read_log(spark, events_log(spark, sf))


def header_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return validate.header_rows(spark, events_log(spark, sf))


def _prefix(kind: str):
    return lambda spark, sf: validate.valid_prefix(spark, damaged(spark, sf, kind))[0]


def _report(kind: str | None):
    return lambda spark, sf: validate.validate(damaged(spark, sf, kind) if kind else events_log(spark, sf), spark).row(spark)


def recover_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.recover(damaged(spark, sf, "tail"), True, spark).row(spark)


def replay_range(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(spark, events_log(spark, sf), *RANGE).rows


def replay_max(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(spark, events_log(spark, sf), most=LIMIT).rows


def replay_max_zero(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(spark, events_log(spark, sf), *RANGE, most=0).rows


def _summary(spark: SparkSession, path: str, *of: int) -> DataFrame:
    r = replay.replay(spark, path, *of)
    return replay.summary(r.rows, r.report)


def replay_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, events_log(spark, sf))


def replay_summary_damaged(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, damaged(spark, sf, "crc"), *RANGE)


def replay_summary_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, events_log(spark, sf), 1 << 40, (1 << 40) + 1)


def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return replay.csv_lines(validate.read_log(spark, events_log(spark, sf)))


def table_lines(spark: SparkSession, sf: str) -> DataFrame:
    return replay.table_lines(validate.read_log(spark, events_log(spark, sf)))


def summary_line(spark: SparkSession, sf: str) -> DataFrame:
    return replay.summary_line(replay_summary(spark, sf))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate.read_log(spark, events_log(spark, sf))
    flags = F.explode(F.array(*[F.struct(F.lit(v).alias("flag"), schema.has_flag(F.col("system_status"), v).alias("is_set")) for v in layout.STATUS.values()])).alias("x")
    return rows.select(flags).filter("x.is_set").groupBy(F.col("x.flag").cast("bigint").alias("flag")).agg(F.count("*").alias("records"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint.batches(telemetry(spark, sf).withColumn("session", F.lit(1).cast("bigint")), 8)


def commit_groups_count(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint.commits_by_count(_batches(spark, sf), 4)


def commit_groups_timer(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint.commits_by_timer(_batches(spark, sf), 7_200_000_000, 4)


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    return checkpoint.slot_rows(spark, checkpoint.read_slots(events_log(spark, sf)))


def checkpoint_slots(spark: SparkSession, sf: str) -> DataFrame:
    s = _slots(spark, sf)
    return s.filter(F.col("record_count") > 0).orderBy(F.desc("generation")).limit(1).select(*[F.col(c).cast("bigint") for c in ("recorder_start_time_us", "committed_length", "record_count", "last_sequence")], "slot_valid")


def checkpoint_select(spark: SparkSession, sf: str) -> DataFrame:
    """Two good slots, of which the log holds only the older one's records: it is cut in its middle."""
    path = events_log(spark, sf)
    half = validate.validate(path, spark).valid_records // 2
    made = layout.slots(layout.slot(5, START_US, 24 + 84 * half, half, half) + layout.slot(6, START_US, 24 + 84 * half * 2, half * 2, half * 2))
    log = spark.createDataFrame([(START_US, 24 + 84 * half)], "recorder_start_time_us bigint, valid_bytes bigint")
    rows = validate.raw_scan(spark, path, to_index=half).select("record_index", "sequence")
    best = checkpoint.newest(checkpoint.consistent(checkpoint.slot_rows(spark, made), log, rows).filter("consistent").withColumn("consistent", F.lit(True)))
    return best.select(*[F.col(c).cast("bigint") for c in ("generation", "committed_length", "record_count", "last_sequence")])


def recovered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records that were written behind the last commit are gone after recovery."""
    path = damaged(spark, sf, "copy")
    half = validate.validate(path, spark).valid_records // 2
    with open(layout.journal_path(path), "wb") as f:
        f.write(layout.slot(3, START_US, 24 + 84 * half, half, half) + bytes(layout.SLOT.itemsize))
    started = recovery.recover_startup(path, spark)
    if not started.healthy:
        raise ValueError(started.message)
    return validate.read_log(spark, path)


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.round(F.col("value") * 1e6 / F.when(F.col("event_id") % 3 == 0, 1000).when(F.col("event_id") % 3 == 1, 10).otherwise(1)).cast("bigint").alias("ns"))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(_latencies(spark, sf))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.percentiles(metrics.histogram(_latencies(spark, sf)))


DAY_US = 86_400_000_000


def rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rate_windows(telemetry(spark, sf), DAY_US)


def rate_min(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rate_windows(telemetry(spark, sf), DAY_US).agg(F.min("records").alias("min_rate"), F.max("records").alias("max_rate"))


def run_validity(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each user: those with a count that divides by five pretend to have lost a record."""
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.count("*").alias("generated"))
    lost = F.when(F.col("generated") % 5 == 0, 1).otherwise(0)
    w = F.col("generated") - lost
    columns = {"healthy": F.lit(True), "dropped": lost, "written": w, "committed": w, "replayed": w, "file_bytes": 24 + 84 * w, "writer_error": F.lit(False), "failures": F.lit(0)}
    return runs.withColumns(columns).select("user_id", metrics.run_valid().alias("valid_run"), metrics.throughput(F.col("written"), F.lit(30.0)).alias("records_per_second"))


def trial_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    trials = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("event_id") % 5).alias("trial")).agg(F.count("*").alias("records_per_second"), F.min("user_id").alias("min_window"), F.max("user_id").alias("write_p99_ns"), F.max("event_id").alias("sync_p99_ns"))
    rows = trials.withColumns({"valid_run": F.lit(True), "os_kernel": F.lit("Linux 6.1"), "warmup_seconds": F.lit(2), "duration_seconds": F.lit(30)})
    return metrics.trial_set(rows).select("accepted", "valid_trials", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("records_per_second", "min_window", "write_p99_ns", "sync_p99_ns")])


def sequence_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: runs of sequences in a conversation's turns without every seventh."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").filter("turn % 7 <> 3")
    from pyspark.sql import Window

    island = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("island", island).groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns")).drop("island")


def drop_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user offered to a queue of two that serves one in six hours and waits two."""
    t = telemetry(spark, sf)
    samples = t.select(F.col("airspeed_kts").cast("bigint").alias("session"), F.col("sequence").alias("sample"), "timestamp_us", "system_status")
    return simulate_queue(samples, 2, 6 * 3.6e9, 2 * 3.6e9)


def simulate_phases(spark: SparkSession, sf: str) -> DataFrame:
    return simulate.phase_rows(spark, spark.read.parquet(f"{sf}/events.parquet").count())


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences at every tenth of the log, and those beside its ends, which have index -1."""
    path = events_log(spark, sf)
    report = validate.validate(path, spark)
    asked = sorted({0, 1, report.valid_records + 1, *(max(1, report.valid_records * k // 10) for k in range(1, 11))})
    return spark.createDataFrame([(s, -1 if i is None else i) for s, i in zip(asked, replay.points(path, asked, report), strict=True)], "sequence bigint, record_index bigint")


_ALL = "sequence, timestamp_us, altitude_m, airspeed_kts, heading_deg, vertical_speed_fpm, engine_temperature_c, engine_rpm, system_status"
_HALF = f"{WITH} SELECT {_ALL} FROM t, n WHERE sequence <= half"


def _summary_sql(where: str, invalid: int, sums: int) -> str:
    x = ", ".join(f"coalesce({f}({c}), 0) AS {f}_{c}" for c in ("altitude_m", "airspeed_kts", "engine_temperature_c") for f in ("min", "max"))
    return f"{WITH} SELECT count(*) AS total_valid_records, CAST({invalid} AS BIGINT) AS invalid_records, CAST({sums} AS BIGINT) AS checksum_failures, coalesce(arg_min(timestamp_us, sequence), 0) AS first_timestamp_us, coalesce(arg_max(timestamp_us, sequence), 0) AS last_timestamp_us, {x} FROM t WHERE {where}"


_WIDTHS = dict(zip(layout.COLUMNS, (w for _, w in replay.TABLE), strict=True))


def _cell(c: str) -> str:
    text = f"printf('0x%x', {c})" if c == "system_status" else f"CAST({c} AS VARCHAR)" if c in ("sequence", "timestamp_us") else f"printf('%.2f', {c})"
    return f"CASE WHEN length({text}) >= {_WIDTHS[c]} THEN {text} ELSE rpad({text}, {_WIDTHS[c]}, ' ') END" if _WIDTHS[c] else text


_BATCH_SQL = f"{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, b AS (SELECT CAST(1 AS BIGINT) AS session, (sequence - 1) // 8 AS batch, min(timestamp_us) AS first_us, count(*) AS records FROM t GROUP BY 2)"
_NS = "CAST(round(value * 1e6 / CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 10 ELSE 1 END) AS BIGINT)"
_BIN = "CAST(CASE WHEN ns < 1000000 THEN ns // 100 ELSE least(19900, 10000 + (ns - 1000000) // 10000) END AS BIGINT)"
_HIST = f"h AS (SELECT {_BIN} AS bin, count(*) AS count, max(ns) AS max_ns FROM (SELECT {_NS} AS ns FROM events) GROUP BY 1)"


def _percentile(p: int) -> str:
    return f"CAST(coalesce((SELECT CASE WHEN bin = 19900 THEN (SELECT max(max_ns) FROM h) WHEN bin < 10000 THEN (bin + 1) * 100 ELSE 1000000 + (bin - 9999) * 10000 END FROM r WHERE reached >= (n * {p} + 99) // 100 ORDER BY bin LIMIT 1), 0) AS BIGINT) AS p{p}_ns"


_QUERIES: dict[str, tuple] = {
    "replay_summary": (replay_summary, _summary_sql("true", 0, 0)),
    "scan_roundtrip": (scan_roundtrip, f"{WITH} SELECT {_ALL} FROM t"),
    "header_metadata": (header_metadata, f"SELECT CAST(1 AS BIGINT) AS format_version, CAST({START_US} AS BIGINT) AS recorder_start_time_us, CAST(84 AS BIGINT) AS record_size"),
    "valid_prefix_crc": (_prefix("crc"), _HALF),
    "valid_prefix_meta": (_prefix("meta"), _HALF),
    "valid_prefix_gap": (_prefix("gap"), _HALF),
    "valid_prefix_dup": (_prefix("dup"), _HALF),
    "valid_prefix_trunc": (_prefix("tail"), f"{WITH} SELECT {_ALL} FROM t, n WHERE sequence < n"),
    "scan_report_clean": (_report(None), _report_sql("n", "24 + 84 * n", "0", "n", "0", "'Log validated successfully'", "true")),
    "scan_report_crc": (_report("crc"), _report_sql("half", "24 + 84 * half + 84", "1", "half + 1", "0", "'Detected CRC mismatch'")),
    "scan_report_meta": (_report("meta"), _report_sql("half", "24 + 84 * half + 28", "0", "half + 1", "0", "'Detected invalid record metadata'")),
    "scan_report_gap": (_report("gap"), _report_sql("half", "24 + 84 * half + 84", "0", "half + 3", "half + 1", "'Detected non-contiguous record sequence: expected ' || (half + 1) || ', observed ' || (half + 3)")),
    "scan_report_dup": (_report("dup"), _report_sql("half", "24 + 84 * half + 84", "0", "half", "half + 1", "'Detected non-contiguous record sequence: expected ' || (half + 1) || ', observed ' || half")),
    "scan_report_trunc": (_report("tail"), _report_sql("n - 1", "24 + 84 * n - 10", "0", "n", "0", "'Detected truncated record payload'")),
    "scan_report_header": (_report("header"), "SELECT false AS healthy, false AS truncated, true AS corruption_detected, " + ", ".join(f"CAST({24 if c == 'bytes_scanned' else 0} AS BIGINT) AS {c}" for c in ONE[3:12]) + ", 'Detected invalid file header metadata' AS message"),
    "recover_report": (recover_report, _report_sql("n - 1", "24 + 84 * (n - 1)", "0", "n - 1", "0", "'Log validated successfully; log prefix recovered'", "true", "true")),
    "replay_range": (replay_range, f"{WITH} SELECT {_ALL} FROM t WHERE sequence BETWEEN {RANGE[0]} AND {RANGE[1]}"),
    "replay_max": (replay_max, f"{WITH} SELECT {_ALL} FROM t ORDER BY sequence LIMIT {LIMIT}"),
    "replay_max_zero": (replay_max_zero, f"{WITH} SELECT {_ALL} FROM t WHERE sequence = {RANGE[0]}"),
    "replay_summary_damaged": (replay_summary_damaged, _summary_sql(f"sequence BETWEEN {RANGE[0]} AND {RANGE[1]}", 1, 1)),
    "replay_summary_empty": (replay_summary_empty, _summary_sql("false", 0, 0)),
    "csv_lines": (csv_lines, f"{WITH} SELECT sequence, sequence || ',' || timestamp_us || ',' || " + " || ',' || ".join(f"printf('%.6g', {c})" for c in layout.COLUMNS[2:-1]) + " || ',' || system_status AS line FROM t"),
    "table_lines": (table_lines, f"{WITH} SELECT sequence, " + " || ".join(_cell(c) for c in layout.COLUMNS) + " AS line FROM t"),
    "summary_line": (summary_line, f"{WITH} SELECT 'summary total_valid_records=' || count(*) || ' invalid_corrupt_records=0 checksum_failures=0 first_timestamp_us=' || arg_min(timestamp_us, sequence) || ' last_timestamp_us=' || arg_max(timestamp_us, sequence) || " + " || ".join(f"printf(' {f}_{n}=%.2f', {f}({c}))" for c, n in replay.EXTREMES.items() for f in ("min", "max")) + " AS line FROM t"),
    "status_counts": (status_counts, f"{WITH} SELECT flag, count(*) AS records FROM t, (SELECT unnest(CAST({list(layout.STATUS.values())} AS BIGINT[])) AS flag) WHERE system_status & flag <> 0 GROUP BY flag"),
    "point_lookup": (point_lookup, f"{WITH} SELECT DISTINCT CAST(s AS BIGINT) AS sequence, CASE WHEN s BETWEEN 1 AND n THEN CAST(s - 1 AS BIGINT) ELSE -1 END AS record_index FROM (SELECT n, unnest([0, 1, n + 1] || list_transform(range(1, 11), lambda k: greatest(1, n * k // 10))) AS s FROM n)"),
    "commit_groups_count": (commit_groups_count, f"{_BATCH_SQL} SELECT session, batch // 4 AS \"commit\", count(*) AS batches, CAST(sum(records) AS BIGINT) AS records FROM b GROUP BY 1, 2"),
    "commit_groups_timer": (commit_groups_timer, f"{_BATCH_SQL}, g AS (SELECT batch, CAST(0 AS BIGINT) AS c, first_us AS opened, 1 AS taken FROM b WHERE batch = 0 UNION ALL SELECT b.batch, CASE WHEN b.first_us >= g.opened + 7200000000 OR g.taken = 4 THEN g.c + 1 ELSE g.c END, CASE WHEN b.first_us >= g.opened + 7200000000 OR g.taken = 4 THEN b.first_us ELSE g.opened END, CASE WHEN b.first_us >= g.opened + 7200000000 OR g.taken = 4 THEN 1 ELSE g.taken + 1 END FROM g JOIN b ON b.batch = g.batch + 1) SELECT CAST(1 AS BIGINT) AS session, c AS \"commit\", min(batch) AS first_batch, count(*) AS batches, CAST(sum(records) AS BIGINT) AS records FROM g JOIN b USING (batch) GROUP BY c"),
    "checkpoint_slots": (checkpoint_slots, f"{WITH} SELECT CAST({START_US} AS BIGINT) AS recorder_start_time_us, 24 + 84 * n AS committed_length, n AS record_count, n AS last_sequence, true AS slot_valid FROM n"),
    "checkpoint_select": (checkpoint_select, f"{WITH} SELECT CAST(5 AS BIGINT) AS generation, CAST(24 + 84 * half AS BIGINT) AS committed_length, CAST(half AS BIGINT) AS record_count, CAST(half AS BIGINT) AS last_sequence FROM n"),
    "recovered_rows": (recovered_rows, _HALF),
    "latency_histogram": (latency_histogram, f"WITH {_HIST} SELECT bin, count, max_ns FROM h"),
    "latency_percentiles": (latency_percentiles, f"WITH {_HIST}, r AS (SELECT bin, sum(count) OVER (ORDER BY bin) AS reached, (SELECT sum(count) FROM h) AS n FROM h) SELECT CAST((SELECT sum(count) FROM h) AS BIGINT) AS samples, {_percentile(50)}, {_percentile(95)}, {_percentile(99)}, (SELECT max(max_ns) FROM h) AS max_ns"),
    "rate_windows": (rate_windows, f"{WITH} SELECT timestamp_us - timestamp_us % {DAY_US} AS window_start_us, count(*) AS records FROM t GROUP BY 1"),
    "rate_min": (rate_min, f"{WITH} SELECT min(c) AS min_rate, max(c) AS max_rate FROM (SELECT count(*) AS c FROM t GROUP BY timestamp_us // {DAY_US})"),
    "run_validity": (run_validity, "SELECT user_id, count(*) % 5 <> 0 AS valid_run, CAST(floor((count(*) - CASE WHEN count(*) % 5 = 0 THEN 1 ELSE 0 END) / 30.0) AS BIGINT) AS records_per_second FROM events GROUP BY user_id"),
    "trial_aggregate": (trial_aggregate, "SELECT count(*) = 5 AS accepted, count(*) AS valid_trials, string_agg(r, ',' ORDER BY trial) AS records_per_second, string_agg(lo, ',' ORDER BY trial) AS min_window, string_agg(hi, ',' ORDER BY trial) AS write_p99_ns, string_agg(e, ',' ORDER BY trial) AS sync_p99_ns FROM (SELECT event_id % 5 AS trial, CAST(count(*) AS VARCHAR) AS r, CAST(min(user_id) AS VARCHAR) AS lo, CAST(max(user_id) AS VARCHAR) AS hi, CAST(max(event_id) AS VARCHAR) AS e FROM events GROUP BY 1)"),
    "sequence_islands": (sequence_islands, "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations WHERE turn % 7 <> 3) GROUP BY conv_id, island"),
    "simulate_phases": (simulate_phases, "WITH s AS (SELECT event_id AS sample, CASE WHEN event_id < 335 THEN event_id ELSE 115 + (event_id - 115) % 220 END AS i FROM events), p AS (SELECT sample, i AS profile_index, CASE WHEN i < 25 THEN 'Startup' WHEN i < 45 THEN 'Takeoff' WHEN i < 115 THEN 'Climb' WHEN i < 235 THEN 'Cruise' WHEN i < 300 THEN 'Descent' ELSE 'Landing' END AS phase FROM s) SELECT sample, profile_index, phase, coalesce(phase <> lag(phase) OVER (ORDER BY sample), false) AS transition FROM p"),
    "drop_accounting": (drop_accounting, cases.DROPS_SQL),
    **cases.QUERIES,
    "valid_prefix_tasks": (cases.valid_prefix_tasks, _HALF),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
