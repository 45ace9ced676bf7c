"""Queries as functions ``code(input, output)`` over facades that build DataFrames.

A query names its sources through ``input`` and puts streams of changes, or DataFrames of rows, to ``output``. The same function runs over
snapshots (get), with writers (update), and as the definition of an index or a live query, which are kept up to date from changes.
To make that possible a stream is a small plan of its own: it knows its rows at a point in time and how changes of its sources
change them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.changes import ChangeStream, Fields, fold, net
from lakeloom.operators.joins import lookup_join, restricted
from lakeloom.operators.predicates import Range
from lakeloom.session import materialize, owning
from lakeloom.sources.changelog import TruncatedError


def doc_of(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


class Stream:
    """A node of a query: rows at a moment (``now`` or ``before`` the changes looked at), and the changes between the two."""

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        """The rows with their string id in ``id``; ids: (id), restricts them."""
        raise NotImplementedError

    def changes(self) -> ChangeStream:
        raise NotImplementedError

    def moved(self) -> bool:
        """Whether any source changed between the two."""
        raise NotImplementedError

    def latest(self) -> ChangeStream:
        """The rows of all ids that may have changed, as they are now; for what compares them with rows of its own."""
        return self.changes().by_result_id()

    def filter(self, test: Callable[[Fields], Column]) -> Stream:
        return Linear(self, lambda c: c.filter(test))

    def map(self, project: Callable[[Fields], dict[str, Column]]) -> Stream:
        return Linear(self, lambda c: c.map(project))

    def flat_map(self, rows: Callable[[Fields], Column]) -> Stream:
        """Each row as an array of rows with ids of their own, which no other row makes."""
        return Linear(self, lambda c: c.flat_map(rows))

    def index_by(self, key: Callable[[Fields], Any], when: Callable[[Fields], Column] | None = None) -> Stream:
        return Linear(self, lambda c: c.index_by(key, when))

    def lookup(self, other: Stream, key: str, into: str) -> Stream:
        """Each row with the row of another collection that its field names, embedded; null where there's none."""
        return Lookup(self, other, key, into)

    def group(self, key: str, aggregates: Mapping[str, Column]) -> Stream:
        """One row for each value of a field, its text as id, with aggregates over the rows."""
        return Group(self, key, aggregates)

    def to(self, output: Output) -> None:
        output.change(self)

    def get(self, r: Range | dict | None = None) -> DataFrame:
        return Range.of(r).apply(self.rows())

    def count(self, r: Range | dict | None = None) -> DataFrame:
        return Range.of(r).filter(self.rows()).agg(F.count("*").alias("n"))


class Source(Stream):
    """A table, log or index, or a range of it."""

    def __init__(self, collection, frame: Frame, r: Range | None = None):
        self.collection, self.frame, self.range = collection, frame, r or Range()

    def on_change(self) -> Stream:
        return self

    def object(self, key: str) -> Source:
        return Source(self.collection, self.frame, Range(gte=key, lte=key))

    def of_range(self, r: Range | dict) -> Source:
        r = Range.of(r)
        if self.frame.incremental and (r.limit is not None or r.offset is not None):
            raise ValueError("a range with limit or offset can't be kept up to date from changes")
        return Source(self.collection, self.frame, r)

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        if self.range.limit is not None or self.range.offset:
            return restricted(self.range.apply(self.frame.rows(self.collection, when)), ids)
        return self.range.filter(self.frame.rows(self.collection, when, ids))

    def changes(self) -> ChangeStream:
        return ChangeStream(self.range.filter(net(self.frame.changes(self.collection))))

    def moved(self) -> bool:
        return self.frame.before.get(self.collection.changelog.path) != self.frame.see(self.collection)


class Rows(Stream):
    """Rows of a DataFrame with a string ``id``, as a stream that never changes."""

    def __init__(self, df: DataFrame):
        self.df = df

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        return restricted(self.df, ids)

    def changes(self) -> ChangeStream:
        return ChangeStream.of_rows(self.df.limit(0))

    def moved(self) -> bool:
        return False


class Linear(Stream):
    """What treats each change by itself."""

    def __init__(self, source: Stream, step: Callable[[ChangeStream], ChangeStream]):
        self.source, self.step = source, step

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        out = self.step(ChangeStream.of_rows(self.source.rows(when))).changes
        out = out.filter("obj is not null").select("obj.*")
        return restricted(out, ids)

    def changes(self) -> ChangeStream:
        return self.step(self.source.changes()).by_result_id()

    def moved(self) -> bool:
        return self.source.moved()


class Lookup(Stream):
    def __init__(self, left: Stream, right: Stream, key: str, into: str):
        self.left, self.right, self.key, self.into = left, right, key, into

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        left = self.left.rows(when, ids)
        # with few left rows only the right rows they name are put together
        right = self.right.rows(when, None if ids is None else left.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("id")).distinct())
        return lookup_join(left, right, self.key, self.into)

    def _touched(self) -> DataFrame:
        """Left rows that changed or that name a right row that did. A left row that no longer names it is itself a change, so looking at what names it now is enough."""
        touched = self.left.changes().changes.select("id") if self.left.moved() else None
        if self.right.moved():
            of_right = self.right.changes().changes.select(F.col("id").alias("_right"))
            left = self.left.rows("now").select("id", self.key)
            named = left.join(of_right, left[self.key] == of_right["_right"], "left_semi").select("id")
            touched = named if touched is None else touched.union(named)
        return self.left.rows("now").select("id").limit(0) if touched is None else touched.distinct()

    def changes(self) -> ChangeStream:
        return _difference(self, self._touched())

    def latest(self) -> ChangeStream:
        return _as_now(self, self._touched())

    def moved(self) -> bool:
        return self.left.moved() or self.right.moved()


class Group(Stream):
    def __init__(self, source: Stream, key: str, aggregates: Mapping[str, Column]):
        self.source, self.key, self.aggregates = source, key, dict(aggregates)

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        rows = self.source.rows(when).withColumn("_group", F.col(self.key).cast("string"))
        rows = restricted(rows.filter("_group is not null"), ids, "_group")
        return rows.groupBy(F.col("_group").alias("id")).agg(*[c.alias(n) for n, c in self.aggregates.items()])

    def _touched(self) -> DataFrame:
        c = self.source.changes().changes
        sides = [c.select(F.col(f"{s}.{self.key}").cast("string").alias("id")) for s in ("obj", "old")]
        return sides[0].union(sides[1]).filter("id is not null").distinct()

    def changes(self) -> ChangeStream:
        return _difference(self, self._touched())

    def latest(self) -> ChangeStream:
        return _as_now(self, self._touched())

    def moved(self) -> bool:
        return self.source.moved()


def _difference(node: Stream, ids: DataFrame) -> ChangeStream:
    ids = materialize(ids, "touched")  # few as a rule: written once, then broadcast to every side if small
    now, before = node.rows("now", ids), node.rows("before", ids)
    a = now.select(F.col("id").alias("_a"), doc_of(now).alias("obj"))
    b = before.select(F.col("id").alias("_b"), doc_of(before).alias("old"))
    both = a.join(b, a["_a"] == b["_b"], "full")
    out = ChangeStream(both.filter(~F.col("obj").eqNullSafe(F.col("old"))).select(F.coalesce("_a", "_b").alias("id"), F.lit("").alias("seq"), "obj", "old"))
    owning(out.changes, ids)
    return out


def _as_now(node: Stream, ids: DataFrame) -> ChangeStream:
    """The rows with these ids as they are now; of those that aren't there only the id is known, on the old side."""
    ids = materialize(ids.select("id"), "touched")
    now = node.rows("now", ids)
    found = now.select(F.col("id").alias("_found"), doc_of(now).alias("obj"))
    none = F.struct(*[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema.fields])
    both = ids.join(found, ids["id"] == found["_found"], "left")
    out = ChangeStream(both.select("id", F.lit("").alias("seq"), "obj", F.when(F.col("_found").isNull(), none).alias("old")))
    owning(out.changes, ids)
    return out


class Frame:
    """The moments a query looks at: for each source the version before and now. Without ``before`` everything is new."""

    def __init__(self, before: Mapping[str, int] | None = None, incremental: bool = False):
        self.before, self.incremental = dict(before or {}), incremental
        self.now: dict[str, int] = {}
        self.lineage: list[dict] = []

    def see(self, collection) -> int:
        key = collection.changelog.path
        if key not in self.now:
            self.now[key] = collection.changelog.version()
        return self.now[key]

    def rows(self, collection, when: str, ids: DataFrame | None = None) -> DataFrame:
        version = self.see(collection)
        return collection.changelog.snapshot(version if when == "now" else self.before.get(collection.changelog.path, 0), ids)

    def changes(self, collection) -> DataFrame:
        version = self.see(collection)
        return collection.changelog.changes(self.before.get(collection.changelog.path, 0), version)

    @property
    def moved(self) -> bool:
        return any(self.before.get(k) != v for k, v in self.now.items())


class Input:
    def __init__(self, database, frame: Frame | None = None):
        self.database, self.frame = database, frame or Frame()

    def _source(self, kind: str, name: str) -> Source:
        collection = self.database.open(kind, name)
        found = {"type": kind, "name": name, "uid": self.database.config(kind, name)["uid"]}
        if found not in self.frame.lineage:
            self.frame.lineage.append(found)
        self.frame.see(collection)
        return Source(collection, self.frame)

    def table(self, name: str) -> Source:
        return self._source("table", name)

    def index(self, name: str) -> Source:
        return self._source("index", name)

    def log(self, name: str) -> Source:
        return self._source("log", name)


class Output:
    """What a query says: streams and rows, of which the last for an id counts, and deletes."""

    def __init__(self, spark: SparkSession, database=None, can_update: bool = False):
        self.spark, self.database, self.can_update = spark, database, can_update
        self.reverse = False
        self.streams: list[Stream] = []
        self._said: list[ChangeStream | Stream] = []

    def change(self, what: Stream | ChangeStream) -> None:
        if isinstance(what, Stream):
            self.streams.append(what)
        self._said.append(what if isinstance(what, Stream) else what.by_result_id())

    def put(self, rows: DataFrame) -> None:
        self._said.append(ChangeStream.of_rows(rows))

    def delete(self, rows: DataFrame) -> None:
        ids = rows.select("id")
        shape = self._changes()[0].changes.schema["obj"].dataType if self._said else ids.schema
        none = F.lit(None).cast(shape)
        self._said.append(_Deletes(ids.select("id", F.lit("").alias("seq"), none.alias("obj"), none.alias("old"))))

    def update(self, source: Stream, key: str, aggregates: Mapping[str, Column]) -> None:
        """Accumulate rows of a source into one row for each value of a field; in an index, groups that change are computed anew, so all aggregates can shrink."""
        self.change(source.group(key, aggregates))

    def set_reverse(self, reverse: bool = True) -> None:
        self.reverse = reverse

    def get(self, key: str) -> DataFrame:
        """The row with an id in the result so far."""
        return self._folded().filter(F.col("id") == key)

    @contextmanager
    def synchronized(self, key: str):
        """Nothing to guard: a query is one plan, and its writes are serialized by version."""
        yield

    def debug(self, what: Stream | DataFrame, n: int = 20) -> None:
        (what.rows() if isinstance(what, Stream) else what).show(n, truncate=False)

    def table(self, name: str):
        return self._writer("table", name)

    def log(self, name: str):
        return self._writer("log", name)

    def _writer(self, kind: str, name: str):
        if not self.can_update:
            raise PermissionError("only an update query may write")
        return self.database.open(kind, name)

    def changed(self) -> ChangeStream | None:
        """All rows of the result that the changes of the sources may have changed, as they are now; None where only comparing whole results can tell, as rows or deletes were said.

        With several streams a row that one of them loses may still be held by another, so the ids that any of them touches are looked
        up in all.
        """
        if not all(isinstance(s, Stream) for s in self._said):
            return None
        if len(self._said) == 1:
            return self._said[0].latest()
        ids = None
        for stream in self._said:
            if stream.moved():
                own = stream.latest().changes.select("id")
                ids = own if ids is None else ids.union(own)
        return None if ids is None else _as_now(_Result(self), ids.distinct())

    def _changes(self, when: str = "now", ids: DataFrame | None = None) -> list[ChangeStream]:
        """What was said, streams as inserts of their rows."""
        return [ChangeStream.of_rows(s.rows(when, ids)) if isinstance(s, Stream) else s for s in self._said]

    def _folded(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        if len(self._said) == 1 and isinstance(self._said[0], Stream):
            return self._said[0].rows(when, ids)
        out = None
        for i, said in enumerate(self._changes(when, ids)):
            part = said.changes.withColumn("seq", F.lit(f"{i:06d}"))
            out = part if out is None else _union_docs(out, part)
        if out is None:
            return self.spark.createDataFrame([], "id string")
        return fold(out).select("obj.*")

    def result(self) -> DataFrame:
        rows = self._folded()
        return rows.orderBy(F.desc("id") if self.reverse else F.asc("id"))


class _Result(Stream):
    """All that an output was told, as one stream."""

    def __init__(self, output: Output):
        self.output = output

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        return self.output._folded(when, ids)


class _Deletes(ChangeStream):
    def __init__(self, changes: DataFrame):
        self.changes = changes


def _union_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of changes whose documents may have different fields: missing ones are null."""
    return a.unionByName(b, allowMissingColumns=True)


def run_get(database, code: Callable, reverse: bool = False) -> DataFrame:
    output = Output(database.spark, database)
    output.reverse = reverse
    code(Input(database), output)
    return output.result()


def run_update(database, code: Callable) -> DataFrame:
    output = Output(database.spark, database, can_update=True)
    code(Input(database), output)
    return output.result()


__all__ = ["Frame", "Group", "Input", "Linear", "Lookup", "Output", "Source", "Stream", "TruncatedError", "run_get", "run_update", "Sequence"]
