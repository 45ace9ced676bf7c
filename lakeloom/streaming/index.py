"""Indexes: materialized results of queries, kept up to date from the changes of their sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.changes import ChangeStream
from lakeloom.plans.query import Frame, Input, Output, Stream, _difference
from lakeloom.session import release
from lakeloom.sources.changelog import TruncatedError
from lakeloom.sources.collection import Table
from lakeloom.streaming.follow import follow


class Index(Table):
    """A table whose writer is a query. Each update is one version of its changelog, published with the versions of the sources it is as of."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, database, code: Callable, params: Mapping):
        super().__init__(spark, path, schema)
        self.database, self.code, self.params = database, code, dict(params)
        self.query: StreamingQuery | None = None

    def _run(self, frame: Frame) -> Output:
        output = IndexOutput(self.spark, self.database)
        self.code(Input(self.database, frame), output, self.params)
        if not frame.lineage or not output._said:
            raise ValueError("the function of an index must read sources and say what they make")
        return output

    def as_of(self, version: int | None = None) -> dict[str, int]:
        """The versions of the sources that the index holds, by default in its current version."""
        for v in reversed(self.changelog.versions()):
            if (version is None or v <= version) and (sources := self.changelog.meta(v)["note"].get("sources")):
                return sources
        return {}

    def update(self) -> bool:
        """Bring the index up to its sources; False if it was. Safe to repeat, also after a failure at any point, and beside another updater."""
        return self._retried(self._update)

    def _update(self, base: int) -> bool:
        before = self.as_of(base)
        frame = Frame(before, incremental=True)
        output = self._run(frame)
        if before and not frame.moved:
            return False
        try:
            changes = (output.changed() if before else None) or self._rebuilt(output)
        except TruncatedError:
            changes = self._rebuilt(output)
        marker = None if before else self.spark.createDataFrame([("indexed",)], "op string")
        self.write_changes(changes, {"sources": frame.now}, marker, base)
        release(changes.changes)
        return True

    def _rebuilt(self, output: Output) -> ChangeStream:
        """All rows as they should be, and deletes of those that shouldn't be."""
        rows = self._conform(output._folded())
        held = self.rows()
        gone = held.join(rows.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
        none = F.lit(None).cast(self.schema)
        doc = F.struct(*self.schema.names)
        puts = rows.select("id", F.lit("").alias("seq"), doc.alias("obj"), none.alias("old"))
        return ChangeStream(puts.unionByName(gone.select("id", F.lit("").alias("seq"), none.alias("obj"), doc.alias("old"))))

    def sources(self) -> list[Table]:
        frame = Frame(incremental=True)
        self._run(frame)
        return [self.database.open(s["type"], s["name"]) for s in frame.lineage]

    def start(self, once: bool = False, interval: str = "500 milliseconds") -> StreamingQuery:
        """Keep the index up to date until stopped; a failure marks it failed in the catalog and ends the query."""

        def act():
            try:
                self.update()
            except Exception as e:
                self.database.index_failed(self, e)
                raise

        self.query = follow(self.spark, [s.changelog for s in self.sources()], act, f"{self.changelog.path}/checkpoint", interval, once)
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None


class IndexOutput(Output):
    """As Output, without order and writers. With rows put or deleted beside streams every update compares whole results."""

    def set_reverse(self, reverse: bool = True) -> None:
        raise TypeError("an index has no order of its own")


class Recompute(Stream):
    """Any function of whole sources: computed anew before and now, of which the difference is taken. For what no other stream can express."""

    def __init__(self, sources: Mapping[str, Stream], compute: Callable[[Mapping[str, DataFrame]], DataFrame]):
        self.sources, self.compute = dict(sources), compute

    def rows(self, when: str = "now", ids: DataFrame | None = None) -> DataFrame:
        out = self.compute({n: s.rows(when) for n, s in self.sources.items()})
        return out if ids is None else out.join(ids.select(F.col("id").alias("_wanted")), F.col("id") == F.col("_wanted"), "left_semi")

    def changes(self) -> ChangeStream:
        ids = self.rows("now").select("id").union(self.rows("before").select("id")).distinct()
        return _difference(self, ids)

    def moved(self) -> bool:
        return any(s.moved() for s in self.sources.values())


_NAMES = re.compile(r"'(?:[^'\\]|\\.)*'|\b\w+\b")


def sql_stream(input: Input, sources: Mapping[str, str], statement: str) -> Recompute:
    """A stream of a SQL text over tables, by their names in the text, which nothing else in it may have; the text's rows must have a string ``id``."""

    def compute(frames: Mapping[str, DataFrame]) -> DataFrame:
        # frames are named in the call, so no view is left in the session
        return input.database.spark.sql(_NAMES.sub(lambda m: f"{{{m[0]}}}" if m[0] in frames else m[0], statement.replace("{", "{{").replace("}", "}}")), **frames)

    return Recompute({n: input.table(t) for n, t in sources.items()}, compute)
