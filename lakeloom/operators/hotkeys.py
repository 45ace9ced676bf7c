"""Per-key results when a few keys hold most rows.

Everything is made from counts that merge: histograms of (key, bin) with count, least and greatest value, combined in each task
before the shuffle, so a hot key reaches its reducer as at most one row for each task and bin, never as its values.
Selection is exact: the bin that holds a wanted rank is cut into finer bins again and again until its least and greatest
value agree or the rank is the first or last in it. Rows are never joined or shuffled for that: a broadcast of at most BUCKETS
hashed (key, bin) pairs leaves out most rows of bins that are settled, and the finer counts are then joined with the open ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import materialize

PARTS = 1 << 12
BUCKETS = 1 << 18


def id_owner(index_id: Column) -> Column:
    """The part of an index entry's id before its last ``_``; null if there's none."""
    tail = F.substring_index(index_id, "_", -1)
    return F.when(F.contains(index_id, F.lit("_")), F.substring(index_id, F.lit(1), F.length(index_id) - F.length(tail) - 1))


@dataclass(frozen=True)
class Bins:
    """A division of whole numbers into bins, as functions of a value: the least value of its bin, which names it, and the bin's width."""

    low: Callable[[Column], Column]
    width: Callable[[Column], Column]
    widest: int

    @classmethod
    def between(cls, least: int, most: int, a: int, b: int) -> Bins:
        """PARTS bins: equal ones from a to b, where nearly all values are, one for those below and one for those above."""
        w = max(1, -(-(b - a + 1) // (PARTS - 2)))
        top = a + w * (PARTS - 2)
        inside = lambda v: a + F.floor((v - F.lit(a)) / F.lit(w)).cast("bigint") * w if w < 1 << 20 else a + _div(v - F.lit(a), w) * w
        low = lambda v: F.when(v < a, F.lit(least)).when(v >= top, F.lit(top)).otherwise(inside(v))
        width = lambda v: F.when(v < a, F.lit(max(1, a - least))).when(v >= top, F.lit(max(1, most - top + 1))).otherwise(F.lit(w))
        return cls(low, width, max(w, a - least, most - top + 1))

    def finer(self) -> Bins:
        """Each bin cut into PARTS equal ones."""
        low, width = self.low, self.width
        part = lambda v: F.greatest(F.lit(1), _div(width(v) + F.lit(PARTS - 1), PARTS))
        return Bins(lambda v: v - F.pmod(v - low(v), part(v)), part, -(-self.widest // PARTS))


def _div(a: Column, b: int) -> Column:
    """Whole division of a number that isn't negative, exact beyond the precision of doubles."""
    return F.shiftright(a, b.bit_length() - 1) if b & (b - 1) == 0 else ((a - F.pmod(a, F.lit(b))).cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)")).cast("bigint")


def key_histogram(df: DataFrame, bins: Bins) -> DataFrame:
    """(key, bin, n, least, most) of (key, v): counts by key and bin of the value; null keys and null values have groups of their own."""
    return df.groupBy("key", bins.low(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


class KeyProfile:
    """Counts and exact quantiles of a whole-number value for every key.

    key: an expression, null for rows of no key; value: a bigint expression, null where it's missing; greatest less least must be a
    bigint too. Rows without a value count for their key but not for its quantiles. ``total`` counts every row. Empty tables give no keys.
    A quantile q of n values is the value of rank max(1, ceil(q * n)) in ascending order, ties counted each. The first bins are equal
    parts of where 99.8 % of all values lie, so that a few far values don't make all others share a bin.
    """

    def __init__(self, df: DataFrame, key: Column, value: Column):
        self.data = df.select(key.alias("key"), value.cast("bigint").alias("v"))
        low, high, inner = self.data.agg(F.min("v"), F.max("v"), F.percentile_approx("v", [0.001, 0.999], 1000)).first()
        a, b = inner or (0, 0)
        self.bins = Bins.between(low or 0, high or 0, a, b)
        self.histogram = materialize(key_histogram(self.data, self.bins), "histogram")
        self.total = self.histogram.agg(F.sum("n")).first()[0] or 0

    def counts(self) -> DataFrame:
        """(key, n_rows, least, most) for every key."""
        sums = self.histogram.filter("key is not null").groupBy("key")
        return sums.agg(F.sum("n").alias("n_rows"), F.min("least").alias("least"), F.max("most").alias("most"))

    def quantiles(self, qs: Sequence[float]) -> DataFrame:
        """(key, q, value) for every key with a value."""
        if not qs:
            raise ValueError("no quantiles asked for")
        wanted = self._filled().groupBy("key").agg(F.sum("n").alias("n_values")).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        return self.select(wanted.select("key", "q", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_values"))).alias("rank")))

    def _filled(self) -> DataFrame:
        return self.histogram.filter("key is not null and bin is not null")

    def select(self, wanted: DataFrame) -> DataFrame:
        """(key, q, value): the value of the rank, from 1, among its key's values for each row (key, q, rank) that names one."""
        state, bins, solved = self._locate(self._filled(), wanted), self.bins, None
        while True:
            state = materialize(state, "ranks")
            done = state.filter("value is not null").select("key", "q", "value")
            solved = done if solved is None else solved.unionByName(done)
            state = state.filter("value is null")
            if bins.widest <= 1 or state.isEmpty():
                return solved
            bucket = lambda key, bin: F.pmod(F.xxhash64(key, bin), F.lit(BUCKETS))
            open_buckets = F.broadcast(state.select(bucket(F.col("key"), F.col("bin")).alias("_bucket")).distinct())  # at most BUCKETS rows
            part = self.data.join(open_buckets, bucket(F.col("key"), bins.low(F.col("v"))) == F.col("_bucket"), "left_semi")
            finer = bins.finer()
            # every value of a finer bin lies in the same coarser one
            histogram = key_histogram(part.filter("key is not null and v is not null"), finer).withColumn("_coarse", bins.low(F.col("least")))
            state, bins = self._locate(histogram, state.select("key", "q", "rank", F.col("bin").alias("_coarse")), "_coarse"), finer

    @staticmethod
    def _locate(histogram: DataFrame, wanted: DataFrame, *coarse: str) -> DataFrame:
        """For each (key, q) the bin that holds the rank, the rank within it, and the value where that's settled."""
        order = Window.partitionBy("key", *coarse).orderBy("bin")
        upto = histogram.withColumn("_upto", F.sum("n").over(order))
        at = upto.join(wanted, ["key", *coarse]).filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("n")))
        rank = F.col("rank") - (F.col("_upto") - F.col("n"))
        value = F.when((rank == 1) | (F.col("least") == F.col("most")), F.col("least")).when(rank == F.col("n"), F.col("most"))
        return at.select("key", "q", "bin", rank.alias("rank"), value.alias("value"))


def hot_keys(df: DataFrame, key: Column, percent: int = 1) -> DataFrame:
    """(key, n_rows): keys that hold at least so many hundredths of all rows, repeats and rows without a key included.

    In the order of the hashes of their keys, rows of such a key are a run that holds at least one of every so many ranks; so the values of
    these ranks, at most 100 / percent of them, are selected exactly from histograms of the hashes, and only rows with one of these
    are then counted by key.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    keyed = df.select(key.alias("key"))
    hashed = F.when(F.col("key").isNotNull(), F.shiftrightunsigned(F.xxhash64("key"), 2))
    # all rows are one group; as 62 bits shifted by 62 it's no constant, on which Spark would join by nested loops
    profile = KeyProfile(keyed, F.shiftrightunsigned(hashed, 62), hashed)
    step = max(1, -(-profile.total * percent // 100))  # total counts rows without a key too
    ranks = df.sparkSession.range(1, profile.total // step + 1).select(F.shiftrightunsigned("id", 62).alias("key"), F.col("id").cast("double").alias("q"), (F.col("id") * step).alias("rank"))
    found = sorted({r.value for r in profile.select(ranks).collect()})
    return keyed.filter(hashed.isin(found)).groupBy("key").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") * 100 >= F.lit(profile.total * percent))


def distinct_elements(df: DataFrame, key: Column, elements: Column) -> DataFrame:
    """(key, element): the distinct non-null elements of an array column for every key, told apart before the shuffle."""
    return df.select(key.alias("key"), F.explode(elements).alias("element")).filter("key is not null and element is not null").distinct()
