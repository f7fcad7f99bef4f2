"""Drops of a bounded queue as a model with stated rates, in batch and streaming form.

A producer's sample joins the queue if there is room; with none, it waits up to a timeout for the consumer, which takes one
every service_us. If none is taken in time the sample is dropped, and the next one accepted or tried carries the overrun flag. Numbers
are given to what was accepted, so drops leave no gap. The model says nothing about a real machine's timing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.layout import STATUS

OUT = "session bigint, sample bigint, timestamp_us bigint, dropped boolean, overrun boolean, depth bigint, sequence bigint, system_status bigint"
STATE = "free_us double, leaves string, after_drop boolean, sequence bigint"


class Queue:
    """leaves: when the consumer takes each waiting sample; free_us: when it can take the next."""

    def __init__(self, capacity: int, service_us: float, timeout_us: float, start: int = 0):
        self.capacity, self.service, self.timeout = capacity, service_us, timeout_us
        self.free, self.leaves, self.after_drop, self.sequence = 0.0, [], False, start

    def offer(self, at: float) -> tuple[bool, bool, int, int | None]:
        """dropped, overrun, depth after, sequence."""
        self.leaves = [t for t in self.leaves if t > at]
        overrun = self.after_drop
        enters = at
        if len(self.leaves) >= self.capacity:
            enters = self.leaves[len(self.leaves) - self.capacity]
            if enters > at + self.timeout:
                self.after_drop = True
                return True, overrun, len(self.leaves), None
        self.after_drop = False
        self.free = max(self.free, enters) + self.service
        self.leaves.append(self.free)
        self.sequence += 1
        return False, overrun, sum(t > enters for t in self.leaves), self.sequence

    def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for session, sample, at, status in zip(pdf["session"], pdf["sample"], pdf["timestamp_us"], pdf["system_status"], strict=True):
            dropped, overrun, depth, sequence = self.offer(float(at))
            out.append((session, sample, at, dropped, overrun, depth, sequence, status | (STATUS["recorder_buffer_overrun"] if overrun else 0)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype({"sequence": "Int64"})


def simulate(samples: DataFrame, capacity: int, service_us: float, timeout_us: float) -> DataFrame:
    """samples: session, sample, timestamp_us, system_status. Sessions side by side, each in order."""
    return samples.groupBy("session").applyInPandas(lambda pdf: Queue(capacity, service_us, timeout_us).rows(pdf.sort_values("sample")), OUT)


def simulate_stream(samples: DataFrame, capacity: int, service_us: float, timeout_us: float) -> DataFrame:
    """The same over a stream: the queue's state goes on from one micro-batch to the next."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = Queue(capacity, service_us, timeout_us)
        if state.exists:
            free, leaves, after, sequence = state.get
            queue.free, queue.leaves, queue.after_drop, queue.sequence = free, [float(t) for t in leaves.split(",") if t], after, sequence
        pdf = pd.concat(list(frames)).sort_values("sample")
        out = queue.rows(pdf)
        state.update((queue.free, ",".join(map(repr, queue.leaves)), queue.after_drop, queue.sequence))
        yield out

    return samples.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
