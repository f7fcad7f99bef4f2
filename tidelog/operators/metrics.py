"""Latency histograms and percentiles, rates, and the validity of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 10,000 bins of 100 ns, 9,900 of 10 us, one for all beyond.
FINE_BINS, FINE_NS, COARSE_BINS, COARSE_NS = 10_000, 100, 9_900, 10_000
FINE_LIMIT, OVERFLOW = FINE_BINS * FINE_NS, FINE_BINS + COARSE_BINS


def bin_of(ns: Column) -> Column:
    fine = F.floor(ns / F.lit(FINE_NS))
    coarse = FINE_BINS + F.floor((ns - FINE_LIMIT) / F.lit(COARSE_NS))
    return F.when(ns < FINE_LIMIT, fine).otherwise(F.least(F.lit(OVERFLOW).cast("bigint"), coarse)).cast("bigint")


def upper_edge(b: Column) -> Column:
    return F.when(b < FINE_BINS, (b + 1) * FINE_NS).otherwise(FINE_LIMIT + (b - FINE_BINS + 1) * COARSE_NS)


def histogram(latencies: DataFrame, ns: str = "ns", by: tuple[str, ...] = ()) -> DataFrame:
    """by..., bin, count, max_ns; counted on the map side first."""
    return latencies.groupBy(*by, bin_of(F.col(ns)).alias("bin")).agg(F.count("*").alias("count"), F.max(ns).alias("max_ns"))


def percentiles(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., samples, p50_ns, p95_ns, p99_ns, max_ns: the upper edge of the bin that the rank (n * p + 99) div 100 falls in, the exact maximum for the last bin. A group has a row per bin, some 20,000 at most."""
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    h = hist.withColumn("reached", F.sum("count").over(run)).withColumn("n", F.sum("count").over(whole)).withColumn("top", F.max("max_ns").over(whole))
    at = lambda p: F.min(F.when(F.col("reached") >= F.floor((F.col("n") * p + 99) / 100), F.col("bin")))
    ranked = h.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("samples"), *[at(p).alias(f"b{p}") for p in (50, 95, 99)], F.coalesce(F.max("top"), F.lit(0)).alias("max_ns"))
    named = [F.coalesce(F.when(F.col(f"b{p}") == OVERFLOW, F.col("max_ns")).otherwise(upper_edge(F.col(f"b{p}"))), F.lit(0)).cast("bigint").alias(f"p{p}_ns") for p in (50, 95, 99)]
    return ranked.select(*by, "samples", *named, "max_ns")


def rate_windows(rows: DataFrame, width_us: int, timestamp_us: str = "timestamp_us") -> DataFrame:
    """window_start_us, records: windows that hold records."""
    start = F.col(timestamp_us) - F.pmod(F.col(timestamp_us), F.lit(width_us))
    return rows.groupBy(start.alias("window_start_us")).agg(F.count("*").alias("records"))


def counter_rates(samples: DataFrame) -> DataFrame:
    """Rate between neighbouring readings of a counter: floor(difference / actual seconds). samples: session, at_us, written."""
    order = Window.partitionBy("session").orderBy("at_us")
    change = F.col("written") - F.lag("written").over(order)
    seconds = (F.col("at_us") - F.lag("at_us").over(order)) / 1e6
    return samples.withColumn("rate", F.floor(change / seconds).cast("bigint")).filter("rate is not null")


def throughput(written: Column, seconds: Column) -> Column:
    return F.floor(written / seconds).cast("bigint")


def run_valid() -> Column:
    """Over columns healthy, file_bytes, writer_error, dropped, generated, written, committed, replayed, failures."""
    c = F.col
    return c("healthy") & (c("file_bytes") == 24 + 84 * c("written")) & ~c("writer_error") & (c("dropped") == 0) & (c("generated") == c("written")) & (c("written") == c("committed")) & (c("replayed") == c("written")) & (c("failures") == 0)


def trial_set(trials: DataFrame) -> DataFrame:
    """One row: whether the set counts (five valid trials on Linux, 2 s of warm-up and 30 s at least) and the lists of rates and percentiles by trial."""
    ok = F.col("valid_run") & F.col("os_kernel").startswith("Linux ") & (F.col("warmup_seconds") >= 2) & (F.col("duration_seconds") >= 30)
    listed = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("trial", v))), lambda x: x[v]).alias(v)
    return trials.agg((F.bool_and(ok) & (F.count("*") == 5)).alias("accepted"), F.count("*").alias("valid_trials"), listed("records_per_second"), listed("min_window"), listed("write_p99_ns"), listed("sync_p99_ns"))


def passed(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """A JSON object of each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
