"""Processing only new or changed records: the target itself is the state.

Every row of the target carries the key and the version of the source record it was made from. A run anti-joins the
source with the target on key and version, processes what remains, and publishes the next version of the target
atomically. A run that fails publishes nothing, so the next one finds the same records again; a run that is repeated
after it succeeded finds none. There's no separate bookmark that could disagree with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.joins import null_safe
from lakeloom.sources.versioned import VersionedTable


def fingerprint(value: Column) -> Column:
    """A version of a value, equal exactly for null-safely equal values: 128 bits of its JSON text with all null fields."""
    return F.md5(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))


def latest_delivery(df: DataFrame, keys: Sequence[str], arrived: str, *values: str) -> DataFrame:
    """One row for each key: the values of the delivery that arrived last.

    Aggregated before the shuffle, so a record delivered very often is one row for each task. Of deliveries that arrived at the
    same moment the greatest counts (compared field by field), so results don't depend on the order of rows; a null time is
    before all others; null keys are a key of their own.
    """
    best = F.max(F.struct(F.col(arrived).alias("_at"), *[F.col(v) for v in values])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_best._at").alias(arrived), *[F.col(f"_best.{v}").alias(v) for v in values])


class IncrementalTarget:
    """A target table kept up to date from a source of keyed, versioned records.

    keys and version name columns of the source; outputs maps the other columns of the target to expressions over the source,
    one row of the target for each record. Source columns of other names don't matter. Empty sources and a target without any
    version are fine; null keys match null keys. The source must have one row for each key (see latest_delivery). Each run adds a part;
    of more than ``compact_after`` the last ones that aren't much larger than what follows them become one, so a row is written again
    in proportion to the logarithm of the number of rows.
    """

    def __init__(self, table: VersionedTable, keys: Sequence[str], version: str, outputs: Mapping[str, Column] | None = None, compact_after: int = 8):
        self.table, self.keys, self.version, self.outputs, self.compact_after = table, list(keys), version, dict(outputs or {}), compact_after

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The target's rows, one for each key: of several parts the newest holds."""
        m = self.table.manifest(version)
        return self._newest(m, m["parts"]) if m["parts"] else None

    def _newest(self, manifest: dict, parts: Sequence[str], only: Sequence[str] | None = None) -> DataFrame:
        df = self.table.read_parts(manifest, parts)
        rest = [c for c in (df.columns if only is None else only) if c not in (*self.keys, "_part")]
        if len(parts) == 1:
            return df.select(*self.keys, *rest)
        best = df.groupBy(*self.keys).agg(F.max(F.struct("_part", *rest)).alias("_best"))
        return best.select(*self.keys, *[F.col(f"_best.{c}").alias(c) for c in rest])

    def pending(self, source: DataFrame, version: int | None = None) -> DataFrame:
        """Records of the source that the target doesn't hold in their version."""
        m = self.table.manifest(version)
        if not m["parts"]:
            return source
        rows = self._newest(m, m["parts"], [self.version])
        held = rows.select(*[F.col(c).alias(f"_held_{c}") for c in (*self.keys, self.version)])
        same = null_safe((source[c], held[f"_held_{c}"]) for c in (*self.keys, self.version))
        return source.join(held, same, "left_anti")

    def run(self, source: DataFrame, *, before_publish: Callable[[], None] | None = None) -> int:
        """Process what is pending and publish; returns the version that holds afterwards. A run that finds nothing publishes nothing."""
        base = self.table.manifest()
        shape = [*[F.col(c) for c in (*self.keys, self.version)], *[e.alias(n) for n, e in self.outputs.items()]]
        new = self.pending(source, base["version"]).select(*shape)
        part, n = self.table.write_part(new)
        if not n:
            return base["version"]
        parts, rows = [*base["parts"], part], base.get("rows", {}) | {part: n}
        if len(parts) > self.compact_after:
            first, held = len(parts) - 1, n
            while first and (first > self.compact_after - 1 or rows[parts[first - 1]] <= 2 * held):
                first -= 1
                held += rows[parts[first]]
            if first < len(parts) - 1:
                manifest = base | {"parts": parts, "schema": new.schema.jsonValue()}
                merged, n = self.table.write_part(self._newest(manifest, parts[first:]))
                parts, rows = [*parts[:first], merged], rows | {merged: n}
        return self.table.publish_parts(parts, rows, new.schema, base["version"], None, before_publish)


def run_marks(runs: DataFrame, by: Sequence[str], status: str = "status", read_to: str = "read_to", done: str = "succeeded") -> DataFrame:
    """How far the successful runs of each group read (``mark``); null for a group without any."""
    return runs.groupBy(*by).agg(F.max(F.when(F.col(status) == done, F.col(read_to))).alias("mark"))


def state_at_marks(deliveries: DataFrame, marks: DataFrame, store: str, record: str, arrived: str, version: str, index: str = "index_name") -> DataFrame:
    """For each index, every record with the version of its latest delivery up to the index's mark.

    deliveries: (store, record, arrived, version); marks: (index, store, mark), a row for each index, so few. Each delivery falls
    between two marks of its store; only the latest delivery in each such interval is kept, before the shuffle, and the few
    intervals of a record are then looked through once for each mark. A delivery without a time was read by no run, a store without
    successful runs has no state. Returns (index, store, record, version).
    """
    per_store = marks.filter(F.col("mark").isNotNull()).groupBy(store).agg(F.array_sort(F.collect_list(F.struct("mark", index))).alias("_marks"))
    slot = F.size(F.filter("_marks", lambda m: m["mark"] < F.col(arrived)))
    placed = (
        deliveries.filter(F.col(arrived).isNotNull())
        .join(per_store, store)
        .withColumn("_slot", slot)
        .filter(F.col("_slot") < F.size("_marks"))
        .groupBy(store, record, "_slot")
        .agg(F.max(F.struct(F.col(arrived).alias("a"), F.col(version).alias("v"))).alias("_last"))
        .groupBy(store, record)
        .agg(F.collect_list(F.struct("_slot", "_last")).alias("_lasts"))
        .join(per_store, store)
        .select(store, record, "_lasts", F.posexplode("_marks").alias("_at", "_mark"))
    )
    upto = F.filter("_lasts", lambda x: x["_slot"] <= F.col("_at"))
    best = F.array_max(F.transform(upto, lambda x: x["_last"]))
    return placed.filter(F.size(upto) > 0).select(F.col(f"_mark.{index}").alias(index), store, record, best["v"].alias(version))
