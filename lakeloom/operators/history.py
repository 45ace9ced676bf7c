"""The history of changing attributes, from an event-sourced change log of each attribute.

Events say that an entity is put with certain attribute values, or deleted. Each attribute has a change log of its own, which
holds only the events that changed it, and so intervals of its own; that an entity exists is one more attribute. Versions of
an entity come from splitting at the union of all boundaries, taking each attribute's value in every piece, and coalescing
pieces that agree in everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordered import LEAST_HOT, OrderedHistory

ALIVE = "_alive"


class AttributeHistory:
    """events: keys (not null), seq (text or date, unique within an entity), ``put`` boolean and a text column for each attribute.

    null equals null, texts are compared exactly as written. A delete ends what exists and is nothing where nothing exists; a put
    after a delete starts a new version even if its attributes are as before. Intervals are half open, [valid_from, valid_to), and
    valid_to is null while a version still holds. No events, no versions.
    """

    def __init__(self, events: DataFrame, keys: Sequence[str], seq: str, attributes: Sequence[str], least_hot: int = LEAST_HOT):
        self.keys, self.seq, self.attributes = list(keys), seq, list(attributes)
        events = events.select(*keys, seq, "put", *attributes)
        self.scan = OrderedHistory(events, keys, seq, least_hot)
        self.events = self.scan.df

    def change_log(self) -> DataFrame:
        """(keys, _chunk, seq, attribute, value): the events that changed the attribute; the first put of an attribute is a change."""
        alive = F.struct(F.lit(ALIVE).alias("attribute"), F.when(F.col("put"), "1").alias("value"))
        values = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in self.attributes]
        said = F.when(F.col("put"), F.array(alive, *values)).otherwise(F.array(alive))
        long = self.events.select(*self.keys, "_chunk", self.seq, F.inline(said))
        long = self.scan.previous(long, F.col("value"), "_before", ["attribute"])
        return long.filter(F.col("_before").isNull() | ~F.col("value").eqNullSafe(F.col("_before.v"))).drop("_before")

    def intervals(self) -> DataFrame:
        """(keys, attribute, value, valid_from, valid_to) of each attribute by itself, over the time its entity is known."""
        log = self.scan.following(self.change_log(), "valid_to", ["attribute"])
        return log.select(*self.keys, "attribute", "value", F.col(self.seq).alias("valid_from"), "valid_to")

    def versions(self) -> DataFrame:
        """(keys, attributes, valid_from, valid_to): every version an entity ever had."""
        names = [ALIVE, *self.attributes]
        at = [F.max(F.when(F.col("attribute") == a, F.struct("value"))).alias(a) for a in names]
        pieces = self.scan.filled(self.change_log().groupBy(*self.keys, "_chunk", self.seq).agg(*at), names)
        # what a deleted entity had before doesn't set one absence apart from another
        state = F.when(F.col(f"{ALIVE}.value").isNotNull(), F.struct(*names))
        pieces = self.scan.previous(pieces.withColumn("_state", state), F.col("_state"), "_before")
        joined = pieces.filter(F.col("_before").isNull() | ~F.col("_state").eqNullSafe(F.col("_before.v")))
        ended = self.scan.following(joined, "valid_to").filter(F.col("_state").isNotNull())
        return ended.select(*self.keys, *[F.col(f"{a}.value").alias(a) for a in self.attributes], F.col(self.seq).alias("valid_from"), "valid_to")


def snapshot_events(snapshots: DataFrame, taken: str, keys: Sequence[str], attributes: Sequence[str], loaded: str) -> DataFrame:
    """Snapshots as events for AttributeHistory, ``seq`` being the snapshot's date as text.

    Of several rows for one entity in one snapshot the one loaded last counts (of equal times the greatest). An entity that the next
    snapshot taken doesn't hold is deleted at that one. Rows without a date or key are left out.
    """
    rows = snapshots.filter(F.col(taken).isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    best = rows.groupBy(taken, *keys).agg(F.max(F.struct(loaded, *attributes)).alias("_best"))
    dates = rows.select(F.col(taken).alias("_date")).distinct()
    # one row for each date of a snapshot
    successive = dates.select("_date", F.lead("_date").over(_by_date()).alias("_next"))
    put = best.select(*keys, F.col(taken).alias("_date"), F.lit(True).alias("put"), *[F.col(f"_best.{a}").alias(a) for a in attributes])
    gone = put.join(successive, "_date").filter("_next is not null")
    gone = gone.select(*keys, F.col("_next").alias("_date"), F.lit(False).alias("put"), *[F.lit(None).cast("string").alias(a) for a in attributes])
    either = put.unionByName(gone).groupBy(*keys, "_date").agg(F.max(F.struct("put", *attributes)).alias("_best"))
    return either.select(*keys, F.date_format("_date", "yyyy-MM-dd").alias("seq"), "_best.*")


def _by_date():
    from pyspark.sql import Window

    return Window.orderBy("_date")
