"""References to records that don't exist, found as a fixpoint down the graph of foreign keys.

Round 0 finds the direct orphans: records whose key is in no row of the table they refer to, or arrived there only after
them. Each further round semi-joins the children of the records found in the round before: those are orphans by
inheritance. It ends when a round finds nothing new, so cycles and self-references are fine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.joins import null_safe
from lakeloom.session import materialize

COLUMNS = ["ref_table", "ref_name", "ref_parent", "record_id", "ref_month", "state", "kind", "depth"]


@dataclass(frozen=True)
class Reference:
    """Records of ``child`` refer by the expression ``key`` to the id of ``parent``; a null or empty key refers to nobody. References of one table need names that tell them apart."""

    child: str
    key: Column
    parent: str
    name: str = ""


def author_key(author: Column) -> Column:
    """The author text without blanks around it and then without a ``.0`` at its end; null for an empty or null one."""
    a = F.trim(author)
    a = F.when(a.endswith(".0"), F.substring(a, F.lit(1), F.length(a) - 2)).otherwise(a)
    return F.when(a != "", a)


def find_orphans(tables: Mapping[str, DataFrame], references: Sequence[Reference], record_id: str = "id", arrived: str = "arrived_at") -> DataFrame:
    """Orphan references as rows (ref_table, ref_name, ref_parent, record_id, ref_month, state, kind, depth).

    state: ``absent`` if no row has the key, ``late`` if the key's earliest arrival is after the record's; an inherited orphan
    takes the state of the reference it inherits, absent before late, also where the graver one is found in a later round. kind: ``direct``
    or ``inherited``; a record whose own reference is an orphan is not reported as inherited for that reference, but may be for another
    one. depth: the least number of rounds of inheritance, 0 for direct.

    Rows with the same id are one record that arrives at their earliest time; if they name different keys each is a
    reference of that record. A null time of a record makes ref_month null, and nothing is late against a null. Records with a null
    id have references but no children. Empty tables give no orphans among their rows, and make all references to them absent.
    Other columns of the tables don't matter. Aggregations combine before their shuffle; joins on a hot key are split by
    adaptive execution.
    """
    spark = next(iter(tables.values())).sparkSession
    if len({(r.child, r.name) for r in references}) < len(references):
        raise ValueError("two references of one table have the same name")
    parents = {r.parent for r in references}
    arrival = {
        name: tables[name].groupBy(F.col(record_id).alias("_id")).agg(F.min(arrived).alias("_at"))
        for name in {*parents, *(r.child for r in references)}
    }
    edges, direct = [], None
    for ref in references:
        pairs = tables[ref.child].select(F.col(record_id).alias("_id"), ref.key.alias("_key"), F.col(arrived).alias("_at"))
        pairs = pairs.filter(F.col("_key") != "").groupBy("_id", "_key").agg(F.min("_at").alias("_pair_at"))
        own = arrival[ref.child].select(F.col("_id").alias("_own_id"), "_at")
        pairs = materialize(pairs.join(own, pairs["_id"].eqNullSafe(own["_own_id"])).select("_id", "_key", "_at"), "references")
        edges.append((ref, pairs))
        there = arrival[ref.parent].select(F.col("_id").alias("_parent_id"), F.col("_at").alias("_parent_at"))
        state = F.when(F.col("_parent_id").isNull(), "absent").when(F.col("_parent_at") > F.col("_at"), "late")
        found = pairs.join(there, pairs["_key"] == there["_parent_id"], "left").withColumn("state", state).filter("state is not null")
        found = _shape(found, ref, "direct", 0)
        direct = found if direct is None else direct.unionByName(found)
    if direct is None:
        return spark.createDataFrame([], "ref_table string, ref_name string, ref_parent string, record_id string, ref_month string, state string, kind string, depth int")
    key = ["ref_table", "ref_name", "record_id"]
    rounds, depth = [materialize(direct, "orphans")], 0
    inherits = any(ref.parent == r.child for ref in references for r in references)
    while inherits:
        depth += 1
        last, new = rounds[-1], None
        for ref, pairs in edges:
            # states sort as absent < late, so min keeps the graver one; one row for each orphan bounds the join
            sick = last.filter(F.col("ref_table") == ref.parent).groupBy(F.col("record_id").alias("_sick")).agg(F.min("state").alias("state"))
            found = _shape(pairs.join(sick, pairs["_key"] == sick["_sick"]), ref, "inherited", depth)
            new = found if new is None else new.unionByName(found)
        new = new.groupBy(*[c for c in COLUMNS if c != "state"]).agg(F.min("state").alias("state")).select(*COLUMNS)
        seen = _all(rounds)
        seen = seen.select(*[F.col(c).alias(f"_seen_{c}") for c in key], F.when(F.col("kind") == "direct", "").otherwise(F.col("state")).alias("_seen_state"))
        same = null_safe((new[c], seen[f"_seen_{c}"]) for c in key) & (seen["_seen_state"] <= new["state"])
        new = materialize(new.join(seen, same, "left_anti"), "orphans")
        if new.isEmpty():
            break
        rounds.append(new)
    if len(rounds) < 3:
        return _all(rounds)
    best = _all(rounds).groupBy(*[c for c in COLUMNS if c not in ("state", "depth")])
    return best.agg(F.min("state").alias("state"), F.min("depth").alias("depth")).select(*COLUMNS)


def _all(rounds: Sequence[DataFrame]) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def _shape(df: DataFrame, ref: Reference, kind: str, depth: int) -> DataFrame:
    columns = [F.lit(ref.child), F.lit(ref.name), F.lit(ref.parent), F.col("_id"), F.date_format("_at", "yyyy-MM"), F.col("state"), F.lit(kind), F.lit(depth)]
    return df.select(*[c.alias(n) for c, n in zip(columns, COLUMNS)]).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted by table, month, state and kind."""
    return orphans.groupBy("ref_table", "ref_month", "state", "kind").agg(F.count("*").alias("n"))
