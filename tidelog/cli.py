"""python -m tidelog.cli record|replay|recover|inject|validate ... Exit status: 0 fine, 1 wrong use or no result, 2 an unhealthy log."""

from __future__ import annotations

import argparse
import signal
import sys
import threading

from tidelog.functions import layout
from tidelog.operators import faults, replay
from tidelog.operators.recorder import Config, Recorder
from tidelog.operators.recovery import recover_startup
from tidelog.operators.validate import metadata, recover, validate


def whole(text: str) -> int:
    """Decimal digits only."""
    if not text.isascii() or not text.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no whole number")
    value = int(text)
    if value > layout.U64_MAX:
        raise argparse.ArgumentTypeError(f"{text!r} is too large")
    return value


def positive(text: str) -> int:
    if not (value := whole(text)):
        raise argparse.ArgumentTypeError("0 is not allowed")
    return value


def flag(value: bool) -> str:
    return "true" if value else "false"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidelog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def do_record(a) -> int:
    started = recover_startup(a.output)
    print(f"startup healthy={flag(started.healthy)} last_sequence={started.last_sequence} message={started.message}")
    if not started.healthy:
        return 1
    recorder = Recorder(Config(a.output, a.hertz, a.ring, a.batch, a.sync_every, a.flush_interval_ms, seed=a.seed), started.last_sequence)
    ended = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: ended.set())
    if not recorder.start():
        return 1
    left = a.duration_seconds
    while left > 0 and not ended.is_set() and not recorder.error:
        step = min(left, a.stats_interval_ms / 1e3 if a.stats_interval_ms else 0.02)
        ended.wait(step)
        left -= step
        if a.stats_interval_ms:
            print("status " + " ".join(f"{k}={v}" for k, v in recorder.stats().items()), flush=True)
    recorder.stop()
    report = validate(a.output)
    print("final " + " ".join(f"{k}={v}" for k, v in recorder.stats().items()), f"healthy={flag(report.healthy)}")
    return 0 if report.healthy and not recorder.error else 2


def do_replay(a) -> int:
    if a.low > a.high:
        print("the range's start lies behind its end", file=sys.stderr)
        return 1
    spark, head = _session(), metadata(a.log)
    found = replay.replay(spark, a.log, a.low, a.high, a.max)
    r = found.report
    print(f"file_header version={head['format_version']} recorder_start_us={head['recorder_start_time_us']} record_size={head['record_size']} total_records_in_valid_prefix={r.valid_records} healthy={flag(r.healthy)}")
    if not a.summary_only:
        print(replay.table_header())
        for row in replay.table_lines(found.rows).orderBy("sequence").toLocalIterator():
            print(row["line"])
    print(replay.summary_line(replay.summary(found.rows, r)).first()["line"])
    if a.csv:
        try:
            print(f"csv_export path={a.csv} records={replay.write_csv(found.rows, a.csv)}")
        except OSError:
            print(f"failed to write CSV to {a.csv}", file=sys.stderr)
            return 1
    if r.corruption_detected and a.show_invalid:
        print(replay.invalid_line(r), file=sys.stderr)
    return 0 if r.healthy else 2


def do_recover(a) -> int:
    """Startup recovery runs, and so cuts an invalid tail, with or without --truncate."""
    s = recover_startup(a.log)
    print(f"startup_recovery healthy={flag(s.healthy)} log_truncated={flag(s.log_truncated)} journal_found={flag(s.journal_found)} journal_replayed={flag(s.journal_replayed)} journal_cleared={flag(s.journal_cleared)} journal_discarded={flag(s.journal_discarded)} valid_records={s.valid_records} recovered_records={s.valid_records} last_sequence={s.last_sequence} checkpoint_generation={s.checkpoint_generation} committed_length={s.committed_length}")
    print(s.message)
    r = recover(a.log, a.truncate)
    print(f"healthy={flag(r.healthy)} truncated={flag(r.truncated)} valid_records={r.valid_records} valid_bytes={r.valid_bytes} bytes_scanned={r.bytes_scanned} last_sequence={r.last_sequence} corruption_detected={flag(r.corruption_detected)} first_bad_record_index={r.first_bad_record_index} first_bad_record_sequence={r.first_bad_record_sequence} expected_sequence={r.expected_sequence}")
    print(r.message)
    return 0 if r.healthy else 2


def do_inject(a) -> int:
    try:
        if a.mode == "truncate":
            faults.truncate_tail(a.log, a.values[0])
            print(f"truncate_complete path={a.log} bytes_removed={a.values[0]}")
        else:
            faults.corrupt_byte(a.log, a.values[0], a.values[1])
            print(f"corruption_complete path={a.log} sequence={a.values[0]} offset={a.values[1]}")
    except (OSError, ValueError, IndexError) as e:
        print(f"{a.mode} failed: {e}", file=sys.stderr)
        return 1
    return 0


def do_validate(a) -> int:
    r = validate(a.log)
    print(r.message)
    return 0 if r.healthy else 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("record")
    c.add_argument("output")
    c.add_argument("--duration-seconds", type=positive, default=10)
    c.add_argument("--hertz", type=float, default=20.0)
    c.add_argument("--ring", type=positive, default=4096)
    c.add_argument("--batch", type=positive, default=64)
    c.add_argument("--sync-every", type=positive, default=1)
    c.add_argument("--flush-interval-ms", type=whole, default=0)
    c.add_argument("--stats-interval-ms", type=whole, default=0)
    c.add_argument("--seed", type=whole, default=42)
    c.set_defaults(do=do_record)
    c = sub.add_parser("replay")
    c.add_argument("log")
    c.add_argument("--from", dest="low", type=whole, default=0)
    c.add_argument("--to", dest="high", type=whole, default=layout.U64_MAX)
    c.add_argument("--max", type=whole)
    c.add_argument("--csv")
    c.add_argument("--summary-only", action="store_true")
    c.add_argument("--show-invalid", action="store_true")
    c.set_defaults(do=do_replay)
    c = sub.add_parser("recover")
    c.add_argument("log")
    c.add_argument("--truncate", action="store_true")
    c.set_defaults(do=do_recover)
    c = sub.add_parser("inject")
    c.add_argument("mode", choices=["truncate", "corrupt"])
    c.add_argument("log")
    c.add_argument("values", type=whole, nargs="+")
    c.set_defaults(do=do_inject)
    c = sub.add_parser("validate")
    c.add_argument("log")
    c.set_defaults(do=do_validate)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        if getattr(a, "hertz", 1.0) <= 0:
            raise ValueError("--hertz must be positive")
    except (SystemExit, ValueError) as e:
        return 0 if getattr(e, "code", 1) == 0 else 1
    return a.do(a)


if __name__ == "__main__":
    sys.exit(main())
