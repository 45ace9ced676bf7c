"""Looking back and ahead in ordered histories, also those of one entity that holds a large part of all rows.

A window over an entity is one task's work. So the rows of hot entities, found by a count, are first range-partitioned by
(entity, order) and thereby cut into chunks; windows then run over (entity, chunk), and what a chunk needs of the chunks before or after
it comes from one row for each chunk. Entities that aren't hot are one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.joins import null_safe
from lakeloom.session import materialize, shuffle_partitions

LEAST_HOT = 200_000


class OrderedHistory:
    """Rows of entities (keys, none null) in the order of a column whose values are unique within an entity.

    df gets a column ``_chunk``; the methods keep it, so any row made from a row of df by adding columns, exploding or
    grouping by (keys, _chunk, order) still works with them. An entity is hot with more rows than ``least_hot`` and than a quarter
    of an average partition, which leaves at most four hot entities for each partition: that bounds what is broadcast.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str, least_hot: int = LEAST_HOT):
        self.keys, self.order = list(keys), order
        parts = shuffle_partitions(df.sparkSession)
        counts = df.groupBy(*keys).count()
        big = counts.filter(F.col("count") > least_hot).cache()
        total = big.agg(F.sum("count")).first()[0]
        self.hot = False
        if total:
            rows = df.count()
            hot = big.filter(F.col("count") > rows // (4 * parts)).drop("count")
            self.hot = not hot.isEmpty()
        if not self.hot:
            big.unpersist()
            # partitioned once: windows and groups of an entity and whatever else need no exchange of their own
            self.df = df.withColumn("_chunk", F.lit(0)).repartition(*keys)
            return
        hot = materialize(hot, "hot")
        big.unpersist()
        few = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
        same = null_safe((df[k], few[f"_hot_{k}"]) for k in keys)
        cut = df.join(few, same, "left_semi").repartitionByRange(parts, *keys, order).withColumn("_chunk", F.spark_partition_id() + 1)
        self.df = df.join(few, same, "left_anti").withColumn("_chunk", F.lit(0)).unionByName(materialize(cut, "chunks")).repartition(*keys, "_chunk")

    def _window(self, extra: Sequence[str]):
        return Window.partitionBy(*self.keys, *extra, "_chunk").orderBy(self.order)

    def _carry(self, df: DataFrame, per_chunk: dict[str, Column], back: bool, extra: Sequence[str]) -> DataFrame:
        """df with, for each name, the nearest non-null value of the chunks before (back) or after a row's chunk."""
        by = [*self.keys, *extra]
        ends = df.filter("_chunk > 0").groupBy(*by, "_chunk").agg(*[c.alias(n) for n, c in per_chunk.items()])
        order = Window.partitionBy(*by).orderBy(F.asc("_chunk") if back else F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*[F.col(k).alias(f"_c_{k}") for k in (*by, "_chunk")], *[F.last(n, True).over(order).alias(n) for n in per_chunk])
        return df.join(ends, [df[k].eqNullSafe(ends[f"_c_{k}"]) for k in (*by, "_chunk")], "left").drop(*[f"_c_{k}" for k in (*by, "_chunk")])

    def previous(self, df: DataFrame, value: Column, out: str, extra: Sequence[str] = ()) -> DataFrame:
        """Adds as ``out`` a struct of the value in the row before (of the same entity and extra columns), null in the first row."""
        df = df.withColumn("_now", F.struct(value.alias("v")))
        df = df.withColumn(out, F.lag("_now").over(self._window(extra)))
        if self.hot:
            df = self._carry(df, {"_earlier": F.max_by("_now", self.order)}, True, extra)
            df = df.withColumn(out, F.coalesce(out, "_earlier")).drop("_earlier")
        return df.drop("_now")

    def filled(self, df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
        """Each column's last non-null value up to the row."""
        w = self._window(extra).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({c: F.last(c, True).over(w) for c in columns})
        if self.hot:
            out = self._carry(out, {f"_fill_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(self.order))) for c in columns}, True, extra)
            out = out.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in columns}).drop(*[f"_fill_{c}" for c in columns])
        return out

    def following(self, df: DataFrame, out: str, extra: Sequence[str] = ()) -> DataFrame:
        """Adds as ``out`` the order column of the next row, null in the last."""
        df = df.withColumn(out, F.lead(self.order).over(self._window(extra)))
        if self.hot:
            df = self._carry(df, {"_later": F.min(self.order)}, False, extra)
            df = df.withColumn(out, F.coalesce(out, "_later")).drop("_later")
        return df
