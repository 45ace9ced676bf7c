"""Tables of documents and append-only logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.keys import numbered, sequence_key
from lakeloom.operators.changes import ChangeStream
from lakeloom.operators.mutators import compile_update
from lakeloom.operators.predicates import Range
from lakeloom.session import materialize, release
from lakeloom.sources.changelog import Changelog, ConflictError, time_of
from lakeloom.sources.files import Files

BAD_ID = "an id must be a non-empty string"
#: A write that leaves more versions than this to be read one by one puts them together.
COMPACT_AFTER = 32
#: How often a write is tried when others are first.
ATTEMPTS = 50


@contextmanager
def _bad_ids():
    try:
        yield
    except Exception as e:
        if BAD_ID in str(e):
            raise ValueError(BAD_ID) from e
        raise


class Rows:
    """Reading a keyed collection; everything is a lazy DataFrame, ordered by id where an order is promised."""

    def rows(self) -> DataFrame:
        raise NotImplementedError

    def object_get(self, key: str) -> DataFrame:
        """The row with the id, or none."""
        return self.rows().filter(F.col("id") == key).limit(1)

    def range_get(self, r: Range | dict | None = None) -> DataFrame:
        return Range.of(r).apply(self.rows())

    def count_get(self, r: Range | dict | None = None) -> DataFrame:
        """One row ``n``: how many rows the range holds, its limit and offset included."""
        r = Range.of(r)
        rows = r.filter(self.rows()) if r.limit is None and not r.offset else r.apply(self.rows())
        return rows.agg(F.count("*").alias("n"))

    def page(self, after: str = "", n: int = 256) -> DataFrame:
        """The n rows whose ids follow one."""
        return self.range_get(Range(gt=after, limit=n))

    def boundary_ids(self) -> DataFrame:
        return self.rows().agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


class FrameRows(Rows):
    """A DataFrame with a string ``id`` as a collection."""

    def __init__(self, df: DataFrame):
        self._df = df

    def rows(self) -> DataFrame:
        return self._df


class Table(Rows):
    """Mutable documents with an operation log.

    A write is one version of the changelog, computed from the snapshot before it: a put that changes nothing and a delete of
    what doesn't exist leave no record. Ids must be non-empty strings. Of several rows with one id in a write the one that is last by
    ``order`` counts, without an order the greatest.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.changelog = Changelog(spark, path, schema)

    def rows(self) -> DataFrame:
        return self.changelog.snapshot()

    def changes(self, after: int = 0, upto: int | None = None) -> ChangeStream:
        return ChangeStream(self.changelog.changes(after, upto))

    def _conform(self, df: DataFrame) -> DataFrame:
        fields = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return df.select(*fields)

    def _checked_id(self, column: str = "id"):
        c = F.col(column).cast("string")
        return F.when(c.isNull() | (c == ""), F.raise_error(F.lit(BAD_ID))).otherwise(c)

    def _retried(self, attempt: Callable[[int], Any]) -> Any:
        """attempt(version to start from), again from its reads on whenever another writer was first: writes are one after the other, and none is lost."""
        for left in range(ATTEMPTS, 0, -1):
            try:
                return attempt(self.changelog.version())
            except ConflictError:
                if left == 1:
                    raise
        raise AssertionError

    def _write(self, wanted: DataFrame, note: dict | None = None, marker: DataFrame | None = None, base: int | None = None) -> int:
        """wanted: (id, obj), obj null for a delete, one row for each id; returns the version that holds.

        base: the version that wanted was made from; if it's no longer the current one, ConflictError. The snapshot is first restricted to
        the wanted ids by a semi join, so that a small write meets a large table as a broadcast of its ids.
        """
        if base is None and not self.changelog.version():
            try:  # into an empty table all is new
                with _bad_ids():
                    return self._write_from(0, wanted, note, marker)
            except ConflictError:
                pass
        with _bad_ids():
            wanted = materialize(wanted, "wanted")
        write = lambda base: self._write_from(base, wanted, note, marker)
        version = self._retried(write) if base is None else write(base)
        release(wanted)
        self._tidy()
        return version

    def _tidy(self) -> None:
        if self.changelog.uncompacted() > COMPACT_AFTER:
            self.changelog.tidy()

    def _write_from(self, base: int, wanted: DataFrame, note: dict | None, marker: DataFrame | None) -> int:
        if base:
            rows = self.changelog.snapshot(base, wanted.select("id"))
            now = rows.select(F.col("id").alias("_id"), F.struct(*[F.col(c) for c in self.schema.names]).alias("old"))
            both = wanted.join(now, wanted["id"] == now["_id"], "left")
        else:
            both = wanted.withColumn("old", F.lit(None).cast(self.schema))
        return self._append(base, both, note, marker)

    def _append(self, base: int, both: DataFrame, note: dict | None = None, marker: DataFrame | None = None) -> int:
        """both: (id, obj, old), of which those that change something become records."""
        changed = both.filter(~F.col("obj").eqNullSafe(F.col("old")))
        records = changed.select(F.when(F.col("obj").isNull(), "delete").otherwise("put").alias("op"), "id", "obj", "old")
        if marker is not None:
            records = records.unionByName(marker, allowMissingColumns=True)
        return self.changelog.append(records, note=note, base=base)

    def _last(self, df: DataFrame, order: Sequence[str] | None) -> DataFrame:
        docs = F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        keyed = df.select(self._checked_id().alias("id"), docs.alias("obj"), F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])], F.to_json(docs).alias("_text")).alias("_at"))
        return keyed.groupBy("id").agg(F.max_by("obj", "_at").alias("obj"))

    def put(self, df: DataFrame, order: Sequence[str] | None = None) -> int:
        return self._write(self._last(df, order))

    def delete(self, ids: DataFrame) -> int:
        doc = F.lit(None).cast(self.schema)
        return self._write(ids.select(self._checked_id().alias("id")).distinct().withColumn("obj", doc))

    def write_changes(self, changes: ChangeStream, note: dict | None = None, marker: DataFrame | None = None, base: int | None = None) -> int:
        """Apply changes of rows of this table; the last of each id counts. base: as of _write."""
        last = changes.changes.groupBy("id").agg(F.max_by(F.struct("obj"), "seq").alias("_last"))
        doc = F.struct(*[F.col(f"_last.obj.{f.name}").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        return self._write(last.select("id", F.when(F.col("_last.obj").isNotNull(), doc).alias("obj")), note, marker, base)

    def update(self, ids: DataFrame, operations: Sequence[dict], if_exists: bool = False, legacy: bool = False) -> int:
        """Change the documents with the given ids by a list of operations; what doesn't exist is made from {id}, unless if_exists.

        Documents are read and written as of one version; if another writer comes in between, they're read again.
        """
        with _bad_ids():
            wanted = materialize(ids.select(self._checked_id().alias("_want")).distinct(), "wanted")

        def attempt(base: int) -> int:
            rows = self.changelog.snapshot(base, wanted)
            docs = wanted.join(rows, wanted["_want"] == rows["id"], "inner" if if_exists else "left")
            old = F.when(F.col("id").isNotNull(), F.struct(*self.schema.names))
            docs = docs.select(old.alias("_old_document"), *[(F.col("_want") if c == "id" else F.col(c)).alias(c) for c in self.schema.names])
            changed = docs.select("_old_document", compile_update(self.schema, operations, legacy=legacy).alias("_doc")).select("_old_document", "_doc.*")
            obj = F.struct(*[(F.col(f.name) if f.name in changed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            return self._append(base, changed.select("id", obj.alias("obj"), F.col("_old_document").alias("old")))

        version = self._retried(attempt)
        release(wanted)
        self._tidy()
        return version

    def clear_oplog(self, before_ms: int, limit: int | None = None) -> dict:
        return self.changelog.clear(before_ms, limit)


class Log(Rows):
    """Append-only documents with ids made of the time of their arrival; a log is its own operation log."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        extra = [f for f in schema.fields if f.name not in ("id", "timestamp")]
        self.spark, self.schema = spark, T.StructType([T.StructField("id", T.StringType()), T.StructField("timestamp", T.LongType()), *extra])
        self.changelog = Changelog(spark, path, self.schema, append_only=True)

    def rows(self) -> DataFrame:
        return self.changelog.snapshot()

    def changes(self, after: int = 0, upto: int | None = None) -> ChangeStream:
        return ChangeStream(self.changelog.changes(after, upto))

    def put(self, df: DataFrame, order: Sequence[str] | None = None, now_ms: int | None = None, flag: str | None = None) -> int:
        """Append rows; ids and timestamps they bring are overwritten. order: columns that say how ids follow each other.

        A million rows share a millisecond, further ones take the next. flag: puts with a flag that was used before append nothing, so a
        repeated put has no second effect.
        """
        if flag is not None and flag in self.flags():
            return self.changelog.version()
        base = self.changelog.version()
        before = self.changelog.meta(base) if base else {"last_ts": 0}
        ms = max(int(time.time() * 1000) if now_ms is None else now_ms, before["last_ts"] + 1)
        payload = [f for f in self.schema.fields if f.name not in ("id", "timestamp")]
        rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in payload], *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order or [])])
        rows = counted = numbered(rows, [f"_by{i}" for i in range(len(order or []))])
        key = sequence_key(F.lit(ms), F.col("_n"))
        docs = F.struct(key.alias("id"), time_of(key).alias("timestamp"), *[F.col(f.name) for f in payload])
        stamped = rows.select(key.alias("seq"), time_of(key).alias("ts"), F.lit("put").alias("op"), key.alias("id"), docs.alias("obj"), F.lit(None).cast(self.schema).alias("old"), F.lit(None).cast("string").alias("from_seq"), F.lit(None).cast("string").alias("to_seq"))
        version = self.changelog._publish(stamped, base, ms, None if flag is None else {"flag": flag})
        release(counted)
        if self.changelog.uncompacted() > COMPACT_AFTER:
            self.changelog.tidy()
        return version

    def flags(self) -> set[str]:
        """The flags of all puts whose versions are kept."""
        notes = (self.changelog.meta(v)["note"] for v in self.changelog.versions())
        return {n["flag"] for n in notes if "flag" in n}

    def put_old(self, df: DataFrame) -> int:
        """Append rows with the ids they bring (replay, import)."""
        docs = F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        return self.changelog.append(df.select(F.lit("put").alias("op"), F.col("id"), docs.alias("obj"), F.lit(None).cast(self.schema).alias("old")), ["id"])


def remove(spark: SparkSession, path: str) -> None:
    Files(spark).delete(path)
