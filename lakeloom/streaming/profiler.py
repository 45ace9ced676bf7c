"""A log of timed operations of the driver, as a DataFrame, and the progress of streaming queries."""

from __future__ import annotations

import functools
import inspect
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "operation string, type string, id long, at_ms double, duration_ms double, details string"


class Profiler:
    """Off until start_log; ``n`` bounds what is kept, the oldest going first."""

    def __init__(self, n: int = 100_000):
        self.n, self._on, self._rows, self._next, self._lock = n, False, [], 0, threading.Lock()

    def start_log(self) -> None:
        self._on, self._rows = True, []

    def _add(self, *row) -> None:
        with self._lock:
            self._rows = [*self._rows[-self.n + 1 :], row] if len(self._rows) >= self.n else [*self._rows, row]

    def log(self, operation: str, details: str = "") -> None:
        if self._on:
            self._add(operation, "log", None, time.time() * 1000, None, details)

    def begin(self, operation: str, details: str = "") -> tuple[str, int, float]:
        with self._lock:
            self._next += 1
            mark = (operation, self._next, time.time() * 1000)
        if self._on:
            self._add(operation, "begin", mark[1], mark[2], None, details)
        return mark

    def end(self, mark: tuple[str, int, float], details: str = "") -> None:
        if self._on:
            now = time.time() * 1000
            self._add(mark[0], "end", mark[1], now, now - mark[2], details)

    @contextmanager
    def profile(self, operation: str, details: str = ""):
        mark = self.begin(operation, details)
        try:
            yield
        finally:
            self.end(mark)

    def profiled(self, f: Callable) -> Callable:
        """f, with each call timed and its arguments named."""
        signature = inspect.signature(f)

        @functools.wraps(f)
        def call(*args, **kwargs):
            said = ", ".join(f"{k}={v!r:.80}" for k, v in signature.bind(*args, **kwargs).arguments.items())
            with self.profile(f.__qualname__, said):
                return f(*args, **kwargs)

        return call

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), SCHEMA)


class StreamProfiler(StreamingQueryListener):
    """Notes what streaming queries do in a profiler; register with spark.streams.addListener."""

    def __init__(self, profiler: Profiler):
        self.profiler = profiler

    def onQueryStarted(self, event):
        self.profiler.log("stream started", str(event.id))

    def onQueryProgress(self, event):
        self.profiler.log("stream progress", f"batch {event.progress.batchId}, {event.progress.numInputRows} rows")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.profiler.log("stream ended", event.exception or "")


profile_log = Profiler()
