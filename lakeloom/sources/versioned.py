"""Tables whose versions are published atomically.

A table is a folder. ``data/`` has one folder of Parquet files for each write, ``versions/`` one small JSON manifest for
each version, which lists the data folders it is made of. Data become visible only when the manifest is renamed into
place, and the rename fails if someone else published that version first; whatever a failed or retried job wrote before
is never listed and goes with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.sources.files import Files


class VersionConflict(RuntimeError):
    """Another writer published the version first; nothing of ours is visible."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def version(self) -> int:
        """The current version, 0 before the first."""
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1][:-5]) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "parts": [], "schema": None, "meta": {}}
        return json.loads(self.files.read_text(f"{self.path}/versions/{v:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of the version's parts, the number of the part in ``_part``; None before the first version."""
        m = self.manifest(version)
        return self.read_parts(m, m["parts"]) if m["parts"] else None

    def read_parts(self, manifest: dict, parts: Sequence[str]) -> DataFrame:
        """Rows of some parts, numbered by their place in the manifest."""
        schema, out = T.StructType.fromJson(manifest["schema"]), None
        for part in parts:
            df = self.spark.read.schema(schema).parquet(f"{self.path}/data/{part}").withColumn("_part", F.lit(manifest["parts"].index(part)))
            out = df if out is None else out.unionByName(df)
        return out

    def write_part(self, df: DataFrame) -> tuple[str, int]:
        """Write rows as a part that no version lists yet; its name and how many rows it has."""
        part, seen = uuid.uuid4().hex, Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/data/{part}")
        return part, seen.get["n"]

    def publish(self, df: DataFrame, *, append: bool = False, meta: dict | None = None, base: int | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Write df and make it the next version, alone or after the parts of the version before (append).

        base: the version df was computed from; if it's no longer the current one, VersionConflict.
        """
        old = self.manifest(base)
        part, n = self.write_part(df)
        parts, rows = ([*old["parts"], part], old.get("rows", {}) | {part: n}) if append else ([part], {part: n})
        return self.publish_parts(parts, rows, df.schema, old["version"], meta, before_publish)

    def publish_parts(self, parts: Sequence[str], rows: dict[str, int], schema: T.StructType, base: int, meta: dict | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Make parts that are written the next version after base; rows: how many each has. If another writer was first, VersionConflict."""
        if before_publish:
            before_publish()
        new = {"version": base + 1, "parts": [*parts], "rows": {p: rows[p] for p in parts if p in rows}, "schema": schema.jsonValue(), "meta": meta or {}}
        self.files.mkdirs(f"{self.path}/versions")
        tmp = f"{self.path}/versions/.{uuid.uuid4().hex}.tmp"
        self.files.write_text(tmp, json.dumps(new))
        if not self.files.rename_new(tmp, f"{self.path}/versions/{new['version']:012d}.json"):
            self.files.delete(tmp)
            raise VersionConflict(f"version {new['version']} of {self.path} was published by another writer")
        return new["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the last ``keep`` and the data that no kept manifest lists; no writer may be at work."""
        v = self.version()
        kept = {p for i in range(max(1, v - keep + 1), v + 1) for p in (*self.manifest(i)["parts"], *self.manifest(i)["meta"].get("buckets", {}).values())} if v else set()
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in kept and not n.startswith(".")]
        for n in self.files.names(f"{self.path}/versions"):
            if n.endswith(".tmp") or n.endswith(".json") and not n.startswith(".") and int(n[:-5]) <= v - keep:
                self.files.delete(f"{self.path}/versions/{n}")
        for n in gone:
            self.files.delete(f"{self.path}/data/{n}")
        return len(gone)
