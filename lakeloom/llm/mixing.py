"""Mixing sources to target weights along a curriculum.

Each source of a mix has a weight schedule over the course t in [0, 1] of the training, piecewise linear; its integral, scaled to
the source's target share of the total size, is the source's cumulative demand for tokens. The texts of a source, in a random but
fixed order and as often as its cap on repeats allows, lie one after the other on the axis of demand; inverting the cumulative demand
at the middle of a text gives the position in the training at which it's used. Texts whose middle lies beyond the whole
demand aren't used. A range sort by position gives the training order.

The running sums that lay out the texts are made in two levels: sums of hash ranges of the source, then sums within each range, so
that a source that holds most texts is no single task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.sizes import n_tokens
from lakeloom.session import materialize


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def ramp_schedule(targets: DataFrame, tilt: float = 0.5) -> DataFrame:
    """A curriculum (mix_id, source_key, t, weight): sources used only once fade from 1 + tilt to 1 - tilt, repeated ones the other way."""
    up = F.when(F.coalesce("max_repeats", F.lit(1)) > 1, -1.0).otherwise(1.0) * tilt
    points = F.array(F.struct(F.lit(0.0).alias("t"), (1 + up).alias("weight")), F.struct(F.lit(1.0).alias("t"), (1 - up).alias("weight")))
    return targets.select("mix_id", "source_key", F.inline(points)).distinct()


class Mixture:
    """documents: (doc_id, text, source); targets: (mix_id, source_key, target_share, max_repeats), few rows; schedule: as of ramp_schedule.

    Sources are compared trimmed and in lower case. The total size is that of all documents, those without source or target
    included, and a source's demand is its share of it. A null share is 0, null repeats are 1, rows of targets that are wholly equal count
    once. A source without a schedule has a constant weight; a schedule is needed at t = 0 and 1 and constant in between if it isn't
    given there. Texts without tokens are never used. With no documents every target is reported with nothing.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, seed: int = 0):
        sized = documents.select("doc_id", source_key(F.col("source")).alias("source_key"), n_tokens(F.col("text")).alias("n_tokens"))
        self.sized = materialize(sized, "sizes")
        self.total, rows = self.sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
        self.bits = min(20, max(0, int(math.log2(max(1, rows)) / 2)))
        targets = targets.select(
            "mix_id", source_key(F.col("source_key")).alias("source_key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")
        )
        self.targets = targets.distinct().withColumn("target_tokens", F.col("target_share") * F.lit(self.total))
        self.seed, self.schedule = seed, schedule

    def laid_out(self) -> DataFrame:
        """(source_key, doc_id, n_tokens, start, supply): where each text begins in one pass over its source, and the source's size."""
        h = F.md5(F.concat_ws(":", "doc_id", F.lit(self.seed)))
        texts = self.sized.filter("source_key is not null and n_tokens > 0").withColumn("_h", h)
        texts = texts.withColumn("_range", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), 32 - self.bits))
        sums = texts.groupBy("source_key", "_range").agg(F.sum("n_tokens").alias("_n"))
        by_source = Window.partitionBy("source_key")
        upto = F.sum("_n").over(by_source.orderBy("_range")) - F.col("_n")
        sums = sums.select("source_key", "_range", upto.alias("_before"), F.sum("_n").over(by_source).alias("supply"))
        within = Window.partitionBy("source_key", "_range").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        texts = texts.withColumn("_upto", F.sum("n_tokens").over(within)).join(sums, ["source_key", "_range"])
        return texts.select("source_key", "doc_id", "n_tokens", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"), "supply")

    def _segments(self) -> DataFrame:
        """Targets with the linear pieces of their cumulative demand: (t0, t1, w0, w1, d0, d1), in tokens."""
        flat = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("weight")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("weight")))
        if self.schedule is None:
            points = self.targets.withColumn("_points", flat)
        else:
            given = self.schedule.groupBy("mix_id", source_key(F.col("source_key")).alias("source_key")).agg(F.array_sort(F.collect_set(F.struct("t", "weight"))).alias("_points"))
            points = self.targets.join(given, ["mix_id", "source_key"], "left").withColumn("_points", F.coalesce("_points", flat))
        p = F.col("_points")
        pieces = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(
            p[i - 1]["t"].alias("t0"), p[i]["t"].alias("t1"), p[i - 1]["weight"].alias("w0"), p[i]["weight"].alias("w1"),
            ((p[i]["t"] - p[i - 1]["t"]) * (p[i]["weight"] + p[i - 1]["weight"]) / 2).alias("area"),
        ))
        points = points.withColumn("_pieces", pieces)
        area = F.aggregate("_pieces", F.lit(0.0), lambda a, x: a + x["area"])
        scale = F.when(area > 0, F.col("target_tokens") / area).otherwise(0.0)
        before = lambda i: F.aggregate(F.slice("_pieces", 1, i), F.lit(0.0), lambda a, x: a + x["area"])
        pieces = F.transform("_pieces", lambda x, i: F.struct(
            x["t0"].alias("t0"), x["t1"].alias("t1"), (x["w0"] * F.col("_scale")).alias("w0"), (x["w1"] * F.col("_scale")).alias("w1"), (before(i) * F.col("_scale")).alias("d0")
        ))
        return points.withColumn("_scale", scale).withColumn("_pieces", pieces).drop("_points", "_scale")

    def sequence(self) -> DataFrame:
        """(mix_id, source_key, doc_id, use_no, n_tokens, position): every use of every chosen text; sort by (mix_id, position) to train."""
        return self._placed().drop("target_tokens", "max_repeats", "last_end")

    def _placed(self) -> DataFrame:
        """The sequence with its target and, for the last use that the target permits, where that ends on the axis of demand."""
        middle = F.col("start") + F.col("n_tokens") / 2
        uses = F.ceil((F.col("target_tokens") - middle) / F.col("supply"))
        uses = F.greatest(F.lit(0), F.least(uses, F.col("max_repeats"))).cast("int")
        chosen = self.laid_out().join(self._segments(), "source_key").withColumn("_uses", uses).filter("_uses > 0")
        used = chosen.withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1)))
        demand = F.col("use_no") * F.col("supply") + middle
        used = used.withColumn("_y", demand).withColumn("_piece", F.element_at(F.filter("_pieces", lambda x: x["d0"] <= F.col("_y")), -1))
        x, y = F.col("_piece"), F.col("_y") - F.col("_piece.d0")
        # the root of w0 x + slope x² / 2 = y, in the form that is stable for a slope near 0
        slope = (x["w1"] - x["w0"]) / (x["t1"] - x["t0"])
        root = 2 * y / (x["w0"] + F.sqrt(F.greatest(F.lit(0.0), x["w0"] * x["w0"] + 2 * slope * y)))
        position = F.least(x["t0"] + root, x["t1"])
        last = (F.col("use_no") == F.col("max_repeats") - 1) & (F.col("start") + F.col("n_tokens") == F.col("supply"))
        end = F.when(last, F.col("use_no") * F.col("supply") + F.col("start") + F.col("n_tokens"))
        return used.select("mix_id", "source_key", "doc_id", "use_no", "n_tokens", position.alias("position"), "target_tokens", "max_repeats", end.alias("last_end"))

    def ordered(self) -> DataFrame:
        """The sequence, range-sorted by mix and position; uses at the same position by document and use."""
        return self.sequence().orderBy("mix_id", "position", "doc_id", "use_no")

    def unreached(self) -> DataFrame:
        """(mix_id, source_key) of targets whose last permitted use ends before their demand, in the sequence laid out and range-sorted; or which permit no use at all."""
        ordered = materialize(self._placed().orderBy("mix_id", "position", "doc_id", "use_no"), "sequence")
        short = ordered.filter("last_end < target_tokens").select("mix_id", "source_key")
        sources = self.sized.filter("n_tokens > 0").select("source_key").distinct()
        unused = self.targets.filter("target_tokens > 0")
        none = unused.join(sources, "source_key", "left_anti").unionByName(unused.filter("max_repeats <= 0"))
        return short.unionByName(none.select("mix_id", "source_key")).distinct()

    def shares(self) -> DataFrame:
        """For each target the tokens wanted, at hand, used, and the actual share of the mix; ``exhausted`` where all uses allowed don't suffice."""
        used = self.sequence().groupBy("mix_id", "source_key").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("uses"), F.count(F.when(F.col("use_no") == 0, 1)).alias("texts"))
        used = used.select(F.col("mix_id").alias("_mix"), F.col("source_key").alias("_source"), "used_tokens", "uses", "texts")
        # where one pass over a source ends on the axis of demand
        supply = self.laid_out().groupBy(F.col("source_key").alias("_of")).agg(F.max(F.col("start") + F.col("n_tokens")).alias("supply"))
        t = self.targets
        out = t.join(supply, t["source_key"] == supply["_of"], "left")
        out = out.join(used, (t["mix_id"].eqNullSafe(used["_mix"])) & (t["source_key"] == used["_source"]), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        whole = F.sum(zero("used_tokens")).over(Window.partitionBy("mix_id"))
        return out.select(
            "mix_id", "source_key", "target_share", "max_repeats", "target_tokens", zero("supply").alias("supply_tokens"), zero("used_tokens").alias("used_tokens"),
            zero("texts").alias("texts"), zero("uses").alias("uses"), F.when(whole > 0, zero("used_tokens") / whole).otherwise(0.0).alias("actual_share"),
            (zero("supply") * F.col("max_repeats") < F.col("target_tokens")).alias("exhausted"),
        )
