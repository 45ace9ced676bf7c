"""Joins: lookups with an embedded row, dereferencing of an index, and the helpers they share.

No join here needs a sort of its own or a hint: sides are broadcast only when Spark's size threshold allows it (static or
by the runtime statistics of adaptive execution), and a key that holds a large part of the rows is split by adaptive
execution's skew join, whose outer side may be divided freely in left joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """All pairs equal, null equal to null."""
    return reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in pairs))


def restricted(df: DataFrame, ids: DataFrame | None, column: str = "id") -> DataFrame:
    """Rows whose id is in the first column of ids; all of them without ids."""
    if ids is None:
        return df
    wanted = ids.select(F.col(ids.columns[0]).alias("_wanted"))
    return df.join(wanted, df[column] == wanted["_wanted"], "left_semi")


def lookup_join(left: DataFrame, right: DataFrame, key: str, into: str, right_id: str = "id") -> DataFrame:
    """Left outer N:1 join: the row of right whose id is left's key, embedded as struct ``into``; null where there's none.

    right must have one row for each id. A field of left named like ``into`` wins over the embedded row. Null keys match nothing.
    """
    if into in left.columns:
        return left
    packed = right.select(F.col(right_id).alias("_lookup_id"), F.struct(*[F.col(c) for c in right.columns]).alias(into))
    return left.join(packed, left[key] == packed["_lookup_id"], "left").select(packed[into], *[left[c] for c in left.columns])


def dereference(index: DataFrame, table: DataFrame, to: str = "to", id_col: str = "id") -> DataFrame:
    """Rows of the table that entries of a secondary index point to, with the entry's id as ``index_id``; entries that point nowhere drop out."""
    entries = index.select(F.col("id").alias("index_id"), F.col(to).alias("_to"))
    return entries.join(table, entries["_to"] == table[id_col]).drop("_to")


def having(left: DataFrame, right: DataFrame, key: str, right_id: str = "id") -> DataFrame:
    """Rows whose key names a row of right (semi join)."""
    return left.join(right.select(F.col(right_id).alias("_having_id")), F.col(key) == F.col("_having_id"), "left_semi")


def lacking(left: DataFrame, right: DataFrame, key: str, right_id: str = "id") -> DataFrame:
    """Rows whose key names no row of right (anti join); a null key names none."""
    return left.join(right.select(F.col(right_id).alias("_having_id")), F.col(key) == F.col("_having_id"), "left_anti")


def inner_lookup(left: DataFrame, right: DataFrame, key: str, into: str, right_id: str = "id") -> DataFrame:
    """As lookup_join, without the rows that find nothing."""
    packed = right.select(F.col(right_id).alias("_lookup_id"), F.struct(*[F.col(c) for c in right.columns]).alias(into))
    return left.join(packed, left[key] == packed["_lookup_id"]).select(packed[into], *[left[c] for c in left.columns])


def range_lookup(points: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: int) -> DataFrame:
    """Inner join of each point with the ranges [lo, hi) that hold it, whole numbers only.

    Both sides are cut into bins of the given width and joined on the bin, so no pair of a point and a range is looked at
    unless they share a bin. A range is repeated once for each bin it touches: choose a width near that of the ranges.
    Rows with null bounds or values match nothing.
    """
    binned = ranges.filter(F.col(hi) > F.col(lo)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    at = points.withColumn("_bin", F.floor(F.col(value) / width))
    return at.join(binned, "_bin").filter((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("_bin")
