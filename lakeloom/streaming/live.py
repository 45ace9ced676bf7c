"""Live queries: a result on the driver, brought up to date from the changes of its sources, with observers.

As the result is an object of the driver it is bounded: a query with more rows than ``most`` is an error. Results that may be
larger belong in an index.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import Row
from pyspark.sql import functions as F

from lakeloom.operators.predicates import Range
from lakeloom.plans.query import Frame, Input, Output
from lakeloom.session import release, work_path
from lakeloom.sources.changelog import TruncatedError
from lakeloom.streaming.follow import follow

Observer = Callable[[str, Any, Any], None]


class LiveList:
    """Rows ordered by id. Observers get ``set`` with the whole list, then ``putByField`` (row, row before) and ``removeByField`` (None, row)."""

    def __init__(self, database, code: Callable, most: int = 100_000):
        self.database, self.code, self.most = database, code, most
        self._rows: dict[str, Row] = {}
        self._observers: list[Observer] = []
        self._lock = threading.RLock()
        self._query = self._followed = None
        self.reverse = False
        self.disposed = False
        self._read()

    def _run(self, frame: Frame) -> Output:
        output = Output(self.database.spark, self.database)
        self.code(Input(self.database, frame), output)
        self.reverse = output.reverse
        return output

    def _read(self) -> None:
        frame = Frame(incremental=True)
        rows = self._run(frame)._folded().limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} rows: make it an index")
        with self._lock:
            self._rows, self._as_of, self._lineage = {r["id"]: r for r in rows}, frame.now, frame.lineage
            self._tell("set", self.value(), None)

    def value(self) -> list[Row]:
        with self._lock:
            return [self._rows[i] for i in sorted(self._rows, reverse=self.reverse)]

    def observe(self, observer: Observer) -> None:
        with self._lock:
            self._observers.append(observer)
            observer("set", self.value(), None)

    def unobserve(self, observer: Observer) -> None:
        with self._lock:
            self._observers.remove(observer)

    def _tell(self, signal: str, new: Any, old: Any) -> None:
        for observer in list(self._observers):
            observer(signal, new, old)

    def update(self) -> int:
        """Take in what was appended to the sources; the number of rows that changed. More than ``most`` changes, or ones that are gone, are an anew read of the result.

        If the result has more than ``most`` rows that's an error, and the list stays as it was.
        """
        with self._lock:
            if self.disposed:
                return 0
            frame = Frame(self._as_of, incremental=True)
            output = self._run(frame)
            if not frame.moved:
                return 0
            try:
                changed = output.changed()
                changes = None if changed is None else changed.changes.select("id", "obj").limit(self.most + 1).collect()
                if changed is not None:
                    release(changed.changes)
            except TruncatedError:
                changes = None
            if changes is None or len(changes) > self.most:  # maybe not all of them, though the result may have fewer rows
                self._read()
                return len(self._rows)
            changes.sort(key=lambda c: c["obj"] is not None)  # a row that moves to an id another leaves
            after = self._rows | {c["id"]: c["obj"] for c in changes}
            if sum(row is not None for row in after.values()) > self.most:
                raise ValueError(f"more than {self.most} rows: make it an index")
            n = sum(self._apply(c["id"], c["obj"]) for c in changes)
            self._as_of = frame.now
            return n

    def _apply(self, key: str, row: Row | None) -> bool:
        old = self._rows.get(key)
        if row == old:
            return False
        if row is None:
            del self._rows[key]
            self._tell("removeByField", None, old)
        else:
            self._rows[key] = row
            self._tell("putByField", row, old)
        return True

    def start(self, interval: str = "500 milliseconds", once: bool = False):
        """Update from a stream over the sources' changelogs until disposed."""
        logs = [self.database.open(s["type"], s["name"]).changelog for s in self._lineage]
        self._query = follow(self.database.spark, logs, self.update, work_path(self.database.spark, "live"), interval, once)
        self._followed = None if once else interval
        return self._query

    def dispose(self) -> None:
        self.disposed = True
        if self._query is not None:
            self._query.stop()
            self._query = None
        self._observers.clear()

    def respawn(self) -> None:
        """Run the query anew after a dispose, and follow its sources again if it did."""
        self.disposed = False
        self._read()
        if self._followed:
            self.start(self._followed)


class LiveObject(LiveList):
    """The first row of a live list, or None. Observers get ``set`` whenever it changes."""

    def _tell(self, signal: str, new: Any, old: Any) -> None:
        first = self.first()
        if signal == "set" or first != getattr(self, "_last", None):
            self._last = first
            super()._tell("set", first, None)

    def first(self) -> Row | None:
        with self._lock:
            if not self._rows:
                return None
            return self._rows[(max if self.reverse else min)(self._rows)]

    def observe(self, observer: Observer) -> None:
        with self._lock:
            self._observers.append(observer)
            observer("set", self.first(), None)


class LiveCount:
    """The number of rows in a range of a collection, kept by adding inserts and taking off deletes; no rows come to the driver."""

    def __init__(self, collection, r: Range | dict | None = None):
        self.collection, self.range = collection, Range.of(r)
        self.version = collection.changelog.version()
        self.value = self.range.filter(collection.changelog.snapshot(self.version)).count()

    def update(self) -> int:
        now = self.collection.changelog.version()
        if now != self.version:
            changes = self.range.filter(self.collection.changelog.changes(self.version, now))
            sign = F.col("obj").isNotNull().cast("int") - F.col("old").isNotNull().cast("int")
            self.value += changes.agg(F.coalesce(F.sum(sign), F.lit(0))).first()[0]
            self.version = now
        return self.value


def live_object(database, collection: str, key: str) -> LiveObject:
    return LiveObject(database, lambda input, output: input.table(collection).object(key).to(output))


def live_range(database, collection: str, r: Range | dict | None = None) -> LiveList:
    return LiveList(database, lambda input, output: input.table(collection).of_range(r or {}).to(output))
