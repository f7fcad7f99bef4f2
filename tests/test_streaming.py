import random
import threading
from collections import deque

from tests.test_validate import make
from tidelog.operators import metrics, simulate
from tidelog.operators.recorder import Config, Recorder, benchmark
from tidelog.operators.validate import validate
from tidelog.streaming import pipeline
from tidelog.streaming.queue_model import simulate as simulate_queue
from tidelog.streaming.queue_model import simulate_stream
from tidelog.streaming.ring import CLOSED, OK, TIMEOUT, Ring, queue_benchmark


def test_ring_against_a_deque():
    rng, ring, model, high = random.Random(42), Ring(5), deque(), 0
    for step in range(20_000):
        if rng.random() < 0.55:
            got = ring.try_push(step)
            assert got == (OK if len(model) < 5 else TIMEOUT)
            if got == OK:
                model.append(step)
                high = max(high, len(model))
        elif rng.random() < 0.5:
            assert ring.try_pop() == ((OK, model.popleft()) if model else (TIMEOUT, None))
        else:
            n = rng.randrange(4)
            assert ring.try_pop_batch(n) == [model.popleft() for _ in range(min(n, len(model)))]
    assert ring.stats() == {"capacity": 5, "size": len(model), "dropped": 0, "high_watermark": high}


def test_ring_close_drop_and_drain():
    ring = Ring(1)
    assert ring.try_push(1) == OK and ring.push_wait_for(2, 0.01) == TIMEOUT and ring.dropped == 1
    ring.close()
    assert ring.try_push(3) == CLOSED and ring.pop_blocking() == (OK, 1) and ring.pop_blocking() == (CLOSED, None)
    ring.reset()
    waiting = threading.Thread(target=lambda: ring.push_blocking(9))
    ring.try_push(8)
    waiting.start()
    assert ring.pop_wait_for(1)[1] == 8
    waiting.join()
    assert ring.try_pop() == (OK, 9)


def test_queue_moves_all_in_order():
    assert queue_benchmark(20_000, 256, 32)["valid"]


def test_queue_model(spark):
    rows = [(1, i, i * 10, 1) for i in range(12)]
    samples = spark.createDataFrame(rows, "session bigint, sample bigint, timestamp_us bigint, system_status bigint")
    out = simulate_queue(samples, 2, 25.0, 5.0).orderBy("sample").collect()
    dropped = [r["dropped"] for r in out]
    assert any(dropped) and [r["sequence"] for r in out if not r["dropped"]] == list(range(1, dropped.count(False) + 1))
    for a, b in zip(out, out[1:], strict=False):
        assert b["overrun"] == a["dropped"] and (b["system_status"] & 16 > 0) == b["overrun"]
    assert max(r["depth"] for r in out) <= 2
    assert not any(r["dropped"] for r in simulate_queue(samples, 2, 5.0, 0.0).collect())


def test_queue_model_streams(spark, tmp_path):
    rows = [(1, i, i * 10, 1) for i in range(12)]
    samples = spark.createDataFrame(rows, "session bigint, sample bigint, timestamp_us bigint, system_status bigint")
    want = {tuple(r) for r in simulate_queue(samples, 2, 25.0, 5.0).collect()}
    for n, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, samples.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = simulate_stream(stream, 2, 25.0, 5.0).writeStream.format("memory").queryName("queued").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("queued").collect()} == want


def test_log_to_log_stream(spark, tmp_path):
    source, target = make(tmp_path / "a.log", 200), str(tmp_path / "b.log")
    for _ in range(2):  # the second run has nothing to add
        query = pipeline.record_stream(pipeline.log_stream(spark, source), target, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert validate(target).valid_records == 200 and open(source, "rb").read()[24:] == open(target, "rb").read()[24:]


def test_phases_follow_the_profile(spark):
    rows = simulate.phase_rows(spark, 600).orderBy("sample").collect()
    sim = simulate.Simulator(1)
    for r in rows:
        assert (sim.index, simulate.PLACES[sim.index][0]) == (r["profile_index"], r["phase"])
        status = sim.next_sample(0)[-1]
        assert bool(status & 128) == r["transition"] and status & 1


def test_simulated_flags_and_ranges():
    sim = simulate.Simulator(7)
    assert 110 <= sim.spike <= 150 and 220 <= sim.drop <= 250 and 155 <= sim.glitch <= 205
    rows = [sim.next_sample(i, i == 5) for i in range(1000)]
    assert [i for i, r in enumerate(rows) if r[-1] & 16] == [5]
    assert sum(bool(r[-1] & 32) for r in rows[:335]) == 3 and all(0 <= r[3] < 360 and r[1] >= 0 and r[2] >= -14 for r in rows)


def test_recorder_counts(tmp_path):
    r = Recorder(Config(str(tmp_path / "a.log"), hertz=500, batch=16, sync_every_batches=4))
    assert r.start()
    threading.Event().wait(0.5)
    r.stop()
    s = r.stats()
    assert s["written"] == s["committed"] == s["generated"] - s["dropped"] > 0 and not s["writer_error"]
    assert validate(str(tmp_path / "a.log")).valid_records == s["written"]


def test_benchmark_artifact(spark, tmp_path):
    import json

    run = json.loads(benchmark(spark, Config(str(tmp_path / "b.log"), hertz=300), 1.0))
    assert run["valid_run"] and run["records_per_second"] > 50 and run["platform"]["os_kernel"]


def test_percentile_edges(spark):
    of = lambda *ns: metrics.percentiles(metrics.histogram(spark.createDataFrame([(n,) for n in ns], "ns bigint"))).first().asDict()
    assert of(50) == {"samples": 1, "p50_ns": 100, "p95_ns": 100, "p99_ns": 100, "max_ns": 50}
    assert of(1_000_000)["p50_ns"] == 1_010_000 and of(500_000_000)["p99_ns"] == 500_000_000
    assert of()["samples"] == 0
