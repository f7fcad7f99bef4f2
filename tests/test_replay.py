import pytest

from tests.test_validate import make
from tidelog import cli
from tidelog.functions import layout
from tidelog.operators import faults, replay


@pytest.fixture
def log(tmp_path):
    return make(tmp_path / "r.log", 100, first=11)


def test_range_limit_and_point(spark, log):
    r = replay.replay(spark, log, 20, 30)
    assert [x["sequence"] for x in r.rows.orderBy("sequence").collect()] == list(range(20, 31)) and r.count == 11
    assert replay.replay(spark, log, 20, 30, 0).rows.count() == 1  # a limit of 0 gives one
    assert replay.replay(spark, log, 0, 5, 0).rows.count() == 0
    assert replay.replay(spark, log, most=7).rows.count() == 7
    assert replay.point(spark, log, 15) == 4 and replay.point(spark, log, 10) is None
    with pytest.raises(ValueError, match="behind"):
        replay.replay(spark, log, 3, 2)


def test_summary_of_nothing_and_nan(spark, log):
    r = replay.replay(spark, log, 0, 5)
    row = replay.summary(r.rows, r.report).first()
    assert row["total_valid_records"] == 0 and row["min_altitude_m"] == 0.0
    frame = spark.createDataFrame([(1, 5, 2.0), (2, 6, float("nan")), (3, 7, -1.0)], "sequence bigint, timestamp_us bigint, altitude_m double").selectExpr("*", "1D AS airspeed_kts", "2D AS engine_temperature_c")
    row = replay.summary(frame, r.report).first()
    assert (row["min_altitude_m"], row["max_altitude_m"], row["last_timestamp_us"]) == (-1.0, 2.0, 7)


def test_renderings(spark, log):
    rows = replay.replay(spark, log, 11, 11).rows
    assert replay.csv_lines(rows).first()["line"] == "11,1000011,11,120,0,0,0,0,1"
    assert replay.table_lines(rows).first()["line"] == "11      1000011           11.00       120.00        0.00         0.00        0.00          0.00        0x1"
    assert replay.table_header().startswith("SEQ     TIMESTAMP_US      ALT_M")


def test_cli(spark, log, tmp_path, capsys):
    assert cli.main(["replay", log, "--from", "12", "--to", "13", "--csv", str(tmp_path / "o.csv")]) == 0
    out = capsys.readouterr().out
    assert "file_header version=1" in out and "summary total_valid_records=2 invalid_corrupt_records=0" in out and "csv_export" in out
    assert (tmp_path / "o.csv").read_text().splitlines() == [replay.CSV_HEADER, "12,1000012,12,120,0,0,0,0,1", "13,1000013,13,120,0,0,0,0,1"]
    faults.corrupt_byte(log, 50, 40)
    assert cli.main(["replay", log, "--summary-only", "--show-invalid"]) == 2
    got = capsys.readouterr()
    assert "healthy=false" in got.out and 'reason="Detected CRC mismatch"' in got.err
    assert cli.main(["replay", log, "--from", "9", "--to", "3"]) == 1
    assert cli.main(["replay", log, "--from", "-1"]) == 1
    assert cli.main(["replay", str(tmp_path / "none"), "--summary-only"]) == 0


def test_cli_recover_and_inject(tmp_path, capsys):
    path = make(tmp_path / "c.log", 5)
    assert cli.main(["inject", "truncate", path, "10"]) == 0
    assert cli.main(["validate", path]) == 2
    assert cli.main(["recover", path]) == 0  # the newest slot is ahead of what is left, so the one before it, of the empty log, holds
    assert "valid_records=0" in capsys.readouterr().out
    assert cli.main(["inject", "corrupt", path, "99", "0"]) == 1
    assert cli.main(["inject", "nothing", path, "1"]) == 1


def test_cli_record_goes_on_where_it_was(tmp_path, capsys):
    path = str(tmp_path / "rec.log")
    assert cli.main(["record", path, "--duration-seconds", "1", "--hertz", "200", "--flush-interval-ms", "50", "--sync-every", "100"]) == 0
    assert cli.main(["record", path, "--duration-seconds", "1", "--hertz", "200"]) == 0
    from tidelog.operators.validate import validate

    r = validate(path)
    assert r.healthy and r.last_sequence == r.valid_records > 100
    assert cli.main(["record", str(tmp_path / "x.log"), "--batch", "0"]) == 1 and not (tmp_path / "x.log").exists()


def test_unsigned_limits():
    assert layout.U64_MAX == cli.whole(str(layout.U64_MAX))
