"""Changelogs: append-only, versioned folders of change records, and the snapshots folded from them.

``oplog/v=N`` holds the records of version N and a small ``_meta.json``. A batch is written to ``staging`` and becomes visible
by one rename, which fails if another writer took the number; records, their summary and whatever the writer notes in meta are
therefore published together. ``base/v=N`` holds compacted snapshots, ``delta/v=N`` what changed since the last base, ``segments`` the documents of logs. Names that begin with ``_`` are not seen by Spark's file
sources, so a stream may read ``oplog`` itself.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.keys import numbered, sequence_key
from lakeloom.operators.changes import fold
from lakeloom.operators.joins import restricted
from lakeloom.sources.files import Files


class ConflictError(RuntimeError):
    """Another writer appended first; nothing was published."""


class TruncatedError(RuntimeError):
    """The changes asked for were removed by clear_oplog."""


def nullable(t: T.DataType) -> T.DataType:
    """The type with everything in it nullable, as Parquet files give it back."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, nullable(t.valueType))
    return t


def time_of(seq: Column) -> Column:
    """The milliseconds in a sequence key."""
    return F.substring_index(seq, ":", 1).cast("bigint")


def record_schema(doc: T.StructType) -> T.StructType:
    fields = [("seq", T.StringType()), ("ts", T.LongType()), ("op", T.StringType()), ("id", T.StringType()), ("obj", doc), ("old", doc), ("from_seq", T.StringType()), ("to_seq", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


class Changelog:
    def __init__(self, spark: SparkSession, path: str, doc: T.StructType, append_only: bool = False):
        """append_only: every record is a document of its own, whatever its id, so nothing needs to be folded."""
        self.spark, self.path, self.doc, self.append_only, self.files = spark, path, doc, append_only, Files(spark)

    # versions

    def versions(self, kind: str = "oplog") -> list[int]:
        return [int(n[2:]) for n in self.files.names(f"{self.path}/{kind}") if n.startswith("v=")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _at(self, version: int, kind: str = "oplog") -> str:
        return f"{self.path}/{kind}/v={version:012d}"

    def meta(self, version: int) -> dict:
        return json.loads(self.files.read_text(f"{self._at(version)}/_meta.json")) if version else {"last_ts": 0}

    # reading

    def records(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Records of the versions after one and up to another, every operation."""
        upto = self.version() if upto is None else upto
        paths = [self._at(v) for v in self.versions() if after < v <= upto]
        schema = record_schema(self.doc)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/oplog").parquet(*paths).select(*schema.names) if paths else self.spark.createDataFrame([], schema)

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Puts and deletes as (id, seq, obj, old)."""
        if after < self.cleared_to():
            raise TruncatedError(f"changes after version {after} are gone")
        return self.records(after, upto).filter(F.col("op").isin("put", "delete")).select("id", "seq", "obj", "old")

    def cleared_to(self) -> int:
        """The last version whose records were removed."""
        present = self.versions()
        return min(present) - 1 if present else 0

    def snapshot(self, version: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """The documents that exist at a version; ids: a DataFrame whose first column are those wanted, by which records are reduced before they're folded."""
        version = self.version() if version is None else version
        if self.append_only:
            return self._appended(version, ids)
        base = max((v for v in self.versions("base") if v <= version), default=0)
        folded = max((v for v in self.versions("delta") if base < v <= version), default=base)
        if folded < self.cleared_to():
            raise TruncatedError(f"version {version} is older than what is kept")
        log = restricted(self.changes(folded, version), ids) if folded < version else None
        if folded > base:
            delta = restricted(self.spark.read.schema(record_schema(self.doc)).parquet(self._at(folded, "delta")).select("id", "seq", "obj", "old"), ids)
            log = delta if log is None else delta.unionByName(log)
        if log is None and not base:
            return self.spark.createDataFrame([], self.doc)
        if not base:
            # a version has one record for each id, so a single one is its own fold
            single = folded == base and sum(v <= version for v in self.versions()) == 1
            return log.filter("obj is not null").select("obj.*") if single else fold(log).select("obj.*")
        kept = restricted(self.spark.read.schema(self.doc).parquet(self._at(base, "base")), ids)
        if log is None:
            return kept
        # only ids that changed since the base are folded
        touched = log.select(F.col("id").alias("_touched")).distinct()
        rest = kept.join(touched, kept["id"] == touched["_touched"], "left_anti")
        return rest.unionByName(fold(log).select("obj.*"))

    def _appended(self, version: int, ids: DataFrame | None) -> DataFrame:
        """The documents of an append-only log: its segments, and the versions after them."""
        segments = self._segments(version)
        at = segments[-1][1] if segments else 0
        out = self.records(at, version).filter("op = 'put'").select("obj.*")
        if segments:
            old = self.spark.read.schema(self.doc).parquet(*[f"{self.path}/segments/s={a:012d}-{b:012d}" for a, b, _ in segments])
            out = old if at >= version else old.unionByName(out)
        return restricted(out, ids)

    def _segments(self, version: int) -> list[tuple[int, int, int]]:
        """(after, upto, rows) of segments that lie end to end, the largest where several begin at one place."""
        known: dict[int, list[int]] = {}
        for name in self.files.names(f"{self.path}/segments"):
            if name.startswith("s="):
                a, b = (int(x) for x in name[2:].split("-"))
                if b <= version:
                    known.setdefault(a, []).append(b)
        out, at = [], 0
        while at in known:
            a, at = at, max(known[at])
            out.append((a, at, sum(self.meta(v)["rows"] for v in self.versions() if a < v <= at)))
        return out

    # writing

    def append(self, rows: DataFrame, order: list[str] | None = None, note: dict | None = None, base: int | None = None, now_ms: int | None = None) -> int:
        """Stamp rows of (op, id, obj, old) with time and sequence, and publish them as the next version; 0 rows publish nothing but a note.

        order: columns of rows that say in which order they happened; without it the sequences only tell the records of the version
        apart, which spares the rows a sort: each task counts by itself, and all but the first add their number. A version must not have two puts or deletes of one id. note: kept in the version's meta. base: the version the rows
        were made from, by default the current one.
        """
        base = self.version() if base is None else base
        before = self.meta(base) if base in self.versions() else {"last_ts": 0}
        ms = max(int(time.time() * 1000) if now_ms is None else now_ms, before["last_ts"] + 1)
        schema = record_schema(self.doc)
        given = [c for c in schema.names if c in rows.columns and c not in ("seq", "ts")]
        if order:
            stamped = numbered(rows, order).withColumn("seq", sequence_key(F.lit(ms), F.col("_n")))
        else:
            n, task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), F.spark_partition_id()
            stamped = rows.withColumn("_n", n).withColumn("_task", task)
            stamped = stamped.withColumn("seq", F.concat(sequence_key(F.lit(ms), F.col("_n")), F.when(F.col("_task") > 0, F.concat(F.lit(":"), F.lpad(F.col("_task").cast("string"), 6, "0"))).otherwise("")))
        stamped = stamped.withColumn("ts", time_of(F.col("seq")))
        stamped = stamped.select(*[(F.col(c) if c in ("seq", "ts", *given) else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.names])
        return self._publish(stamped, base, ms, note)

    def _publish(self, stamped: DataFrame, base: int, ms: int, note: dict | None) -> int:
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        seen = Observation()
        stamped.observe(seen, F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).write.parquet(staged)
        n, first, last = (seen.get[k] for k in ("n", "first", "last"))
        if not n and not note:
            self.files.delete(staged)
            return base
        meta = {"last_ts": max(ms, int(last.split(":")[0]) if last else 0), "rows": n, "first": first, "last": last, "note": note or {}}
        self.files.write_text(f"{staged}/_meta.json", json.dumps(meta))
        self.files.mkdirs(f"{self.path}/oplog")
        if not self.files.rename_new(staged, self._at(base + 1)):
            self.files.delete(staged)
            raise ConflictError(f"version {base + 1} of {self.path} was appended by another writer")
        return base + 1

    def uncompacted(self) -> int:
        """How many versions a snapshot has to read one by one."""
        if self.append_only:
            folded = max((b for _, b, _ in self._segments(self.version())), default=0)
        else:
            folded = max([*self.versions("base"), *self.versions("delta")], default=0)
        return sum(v > folded for v in self.versions())

    def tidy(self) -> None:
        """Make snapshots cheaper by as little writing as that takes.

        A log's new versions become a segment, together with the segments before that aren't larger. A table's become one set of changes
        since its base, and only when that has a quarter of the base's rows a new base. So a row is written again
        in proportion to the logarithm of the table, not with every few writes.
        """
        version = self.version()
        if self.append_only:
            segments = self._segments(version)
            at = segments[-1][1] if segments else 0
            rows = sum(self.meta(v)["rows"] for v in self.versions() if v > at)
            while segments and segments[-1][2] <= 2 * rows:
                at, _, n = segments.pop()
                rows += n
            docs = self._appended(version, None) if at == 0 else self._between(at, version)
            self._place(docs, f"segments/s={at:012d}-{version:012d}", rows)
            return
        base = max(self.versions("base"), default=0)
        held = json.loads(self.files.read_text(f"{self._at(base, 'base')}/_meta.json"))["rows"] if base else 0
        if 4 * sum(self.meta(v)["rows"] for v in self.versions() if v > base) >= held:
            self.compact()
            return
        folded = max((v for v in self.versions("delta") if v > base), default=base)
        log = self.changes(folded, version)
        if folded > base:
            log = self.spark.read.schema(record_schema(self.doc)).parquet(self._at(folded, "delta")).select("id", "seq", "obj", "old").unionByName(log)
        last = log.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("obj"), "seq").alias("_last"))
        none = F.lit(None).cast(self.doc)
        last = last.select("seq", time_of(F.col("seq")).alias("ts"), F.when(F.col("_last.obj").isNull(), "delete").otherwise("put").alias("op"), "id", F.col("_last.obj").alias("obj"), none.alias("old"), F.lit(None).cast("string").alias("from_seq"), F.lit(None).cast("string").alias("to_seq"))
        self._place(last, f"delta/v={version:012d}", None)

    def _between(self, after: int, version: int) -> DataFrame:
        """Documents of an append-only log after one version and up to another, from segments where there are."""
        inside = [(a, b) for a, b, _ in self._segments(version) if a >= after]
        at = inside[-1][1] if inside else after
        out = self.records(at, version).filter("op = 'put'").select("obj.*")
        for a, b in inside:
            out = self.spark.read.schema(self.doc).parquet(f"{self.path}/segments/s={a:012d}-{b:012d}").unionByName(out)
        return out

    def _place(self, rows: DataFrame, name: str, n: int | None) -> None:
        """Write rows and rename them into place; if someone else made the same, theirs stays."""
        staged, parent = f"{self.path}/staging/{uuid.uuid4().hex}", f"{self.path}/{name.partition('/')[0]}"
        if self.files.exists(f"{self.path}/{name}"):
            return
        rows.write.parquet(staged)
        if n is None:
            n = self.spark.read.schema(rows.schema).parquet(staged).count()
        self.files.write_text(f"{staged}/_meta.json", json.dumps({"rows": n}))
        self.files.mkdirs(parent)
        if not self.files.rename_new(staged, f"{self.path}/{name}"):
            self.files.delete(staged)

    def compact(self) -> int:
        """Write the snapshot of the current version, from which later reads begin."""
        version = self.version()
        if version and self.append_only:
            self.tidy()
        elif version:
            self._place(self.snapshot(version).repartitionByRange("id").sortWithinPartitions("id"), f"base/v={version:012d}", None)
        return version

    def clear(self, before_ms: int, limit: int | None = None) -> dict:
        """Remove whole versions whose records are all older than a time, at most so many records; {count, last}.

        The snapshot is compacted first, so no document is lost. A time in the future is an error. A marker names what was removed. The last
        version stays, as the place from which readers go on.
        """
        if before_ms > int(time.time() * 1000):
            raise ValueError("cannot clear operations of the future")
        gone, count, last = [], 0, None
        for v in self.versions()[:-1]:
            m = self.meta(v)
            if m["last_ts"] >= before_ms or limit is not None and count + m["rows"] > limit:
                break
            gone, count, last = [*gone, v], count + m["rows"], m["last"] or last
        if not gone:
            return {"count": 0, "last": None}
        self.compact()
        first = self.meta(gone[0])["first"]
        marker = self.spark.createDataFrame([("clearOpLog", first, last)], "op string, from_seq string, to_seq string").withColumn("id", F.lit(None).cast("string"))
        self.append(marker)
        for v in gone:
            self.files.delete(self._at(v))
        return {"count": count, "last": last}
