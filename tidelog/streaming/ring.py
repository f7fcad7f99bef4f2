"""A bounded queue between one producer and one consumer, and its drop accounting."""

from __future__ import annotations

import threading
import time
from collections import deque
from typing import Generic, TypeVar

T = TypeVar("T")
OK, TIMEOUT, CLOSED = "ok", "timeout", "closed"


class Ring(Generic[T]):
    """Pushes fail on a full or closed ring; pops drain a closed one first. Only a timed push that runs out counts as dropped. high_watermark is the largest depth after a push."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("a ring holds one item at least")
        self.capacity, self._items, self._changed = capacity, deque(), threading.Condition()
        self._closed, self.dropped, self.high_watermark = False, 0, 0

    def _put(self, item: T) -> str:
        self._items.append(item)
        self.high_watermark = max(self.high_watermark, len(self._items))
        self._changed.notify_all()
        return OK

    def _wait(self, ready, timeout: float | None) -> bool:
        return self._changed.wait_for(ready, timeout)

    def try_push(self, item: T) -> str:
        with self._changed:
            if self._closed:
                return CLOSED
            return self._put(item) if len(self._items) < self.capacity else TIMEOUT

    def push_wait_for(self, item: T, seconds: float) -> str:
        with self._changed:
            if not self._wait(lambda: self._closed or len(self._items) < self.capacity, seconds):
                self.dropped += 1
                return TIMEOUT
            return CLOSED if self._closed else self._put(item)

    def push_blocking(self, item: T) -> str:
        with self._changed:
            self._wait(lambda: self._closed or len(self._items) < self.capacity, None)
            return CLOSED if self._closed else self._put(item)

    def _take(self) -> T:
        item = self._items.popleft()
        self._changed.notify_all()
        return item

    def try_pop(self) -> tuple[str, T | None]:
        with self._changed:
            if self._items:
                return OK, self._take()
            return (CLOSED if self._closed else TIMEOUT), None

    def pop_wait_for(self, seconds: float | None) -> tuple[str, T | None]:
        with self._changed:
            self._wait(lambda: self._closed or self._items, seconds)
            if self._items:
                return OK, self._take()
            return (CLOSED if self._closed else TIMEOUT), None

    def pop_blocking(self) -> tuple[str, T | None]:
        return self.pop_wait_for(None)

    def try_pop_batch(self, most: int) -> list[T]:
        with self._changed:
            return [self._take() for _ in range(min(most, len(self._items)))]

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify_all()

    def reset(self) -> None:
        with self._changed:
            self._items.clear()
            self._closed, self.dropped, self.high_watermark = False, 0, 0

    def stats(self) -> dict[str, int]:
        with self._changed:
            return {"capacity": self.capacity, "size": len(self._items), "dropped": self.dropped, "high_watermark": self.high_watermark}


def queue_benchmark(records: int = 5_000_000, capacity: int = 65_536, batch: int = 256) -> dict:
    """Moves numbers through a ring between two threads; valid if all arrive in order."""
    ring: Ring[int] = Ring(capacity)
    state = {"ordered": True, "count": 0}

    def consume() -> None:
        while state["count"] < records:
            got = ring.try_pop_batch(batch)
            if not got:
                status, one = ring.pop_wait_for(0.1)
                if status == CLOSED:
                    return
                got = [one] if status == OK else []
            for v in got:
                state["ordered"] &= v == state["count"]
                state["count"] += 1

    began = time.perf_counter()
    worker = threading.Thread(target=consume)
    worker.start()
    for i in range(records):
        ring.push_blocking(i)
    ring.close()
    worker.join()
    seconds = time.perf_counter() - began
    return {"records": state["count"], "seconds": seconds, "records_per_second": int(state["count"] / seconds), "valid": state["ordered"] and state["count"] == records}
