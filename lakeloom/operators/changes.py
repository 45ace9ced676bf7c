"""The algebra of changes: filter, map and index streams of (id, seq, obj, old).

A change has the row after it (``obj``) and before it (``old``), both structs: an insert lacks old, a delete lacks obj. The same functions
work on a whole collection, seen as inserts, and on what a changelog holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.keys import index_key

Fields = Callable[[str], Column]


class ChangeStream:
    """changes: a DataFrame of (id, seq, obj, old); changes without either side are ignored."""

    def __init__(self, changes: DataFrame):
        self.changes = changes.select("id", "seq", "obj", "old").filter("obj is not null or old is not null")

    @classmethod
    def of_rows(cls, rows: DataFrame, row_id: str = "id", seq: Column | None = None) -> ChangeStream:
        """A collection as inserts."""
        doc = F.struct(*[F.col(c) for c in rows.columns])
        return cls(rows.select(F.col(row_id).cast("string").alias("id"), (F.lit("") if seq is None else seq).alias("seq"), doc.alias("obj"), F.when(F.lit(False), doc).alias("old")))

    def filter(self, test: Callable[[Fields], Column]) -> ChangeStream:
        """Both sides by themselves: an update that crosses the test becomes an insert or a delete."""
        keep = lambda side: F.when(F.coalesce(test(lambda n: F.col(side).getField(n)), F.lit(False)), F.col(side))
        return ChangeStream(self.changes.withColumns({"obj": keep("obj"), "old": keep("old")}))

    def map(self, project: Callable[[Fields], dict[str, Column]]) -> ChangeStream:
        """Both sides projected; no side stays no side."""
        def to(side: str) -> Column:
            fields = project(lambda n: F.col(side).getField(n))
            return F.when(F.col(side).isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))

        return ChangeStream(self.changes.withColumns({"obj": to("obj"), "old": to("old")}))

    def flat_map(self, rows: Callable[[Fields], Column]) -> ChangeStream:
        """Each side as an array of rows (structs with an ``id``), none, one or many; rows that both sides have alike drop out. A null array is empty."""
        both = self.changes.select("seq", *[F.when(F.col(s).isNotNull(), rows(lambda n, s=s: F.col(s).getField(n))).alias(f"_{s}") for s in ("obj", "old")])
        none = F.when(F.lit(False), F.element_at("_obj", 1))
        puts = F.transform(F.coalesce(F.array_except("_obj", F.coalesce("_old", F.slice("_obj", 1, 0))), F.slice(F.array(none), 1, 0)), lambda r: F.struct(r["id"].alias("id"), "seq", r.alias("obj"), none.alias("old")))
        kept = F.transform(F.coalesce("_obj", F.slice(F.array(none), 1, 0)), lambda r: r["id"])
        gone = F.transform(F.filter(F.coalesce("_old", F.slice(F.array(none), 1, 0)), lambda r: ~F.array_contains(kept, r["id"])), lambda r: F.struct(r["id"].alias("id"), "seq", none.alias("obj"), r.alias("old")))
        return ChangeStream(both.select(F.explode(F.concat(puts, gone)).alias("c")).select("c.*"))

    def index_by(self, key: Callable[[Fields], Sequence[Column] | Column | None], when: Callable[[Fields], Column] | None = None) -> ChangeStream:
        """Entries {id: key_id, to: id} of a secondary index, as changes of the entries.

        Keys are lists of columns or one column. Rows for which ``when`` isn't true are not indexed. A change that leaves the key as it
        is changes no entry; one that moves it inserts the new entry and deletes the old.
        """
        sides = {}
        for side in ("obj", "old"):
            fields = lambda n, side=side: F.col(side).getField(n)
            parts = key(fields)
            parts = list(parts) if isinstance(parts, (list, tuple)) else [parts]
            types = self.changes.select(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).schema
            made = index_key([(p, f.dataType) for p, f in zip(parts, types.fields)], F.col("id"))
            present = F.col(side).isNotNull() if when is None else F.col(side).isNotNull() & F.coalesce(when(fields), F.lit(False))
            sides[side] = F.when(present, made)
        both = self.changes.select("id", "seq", sides["obj"].alias("_new"), sides["old"].alias("_old")).filter(~F.col("_new").eqNullSafe(F.col("_old")))
        entry = lambda k: F.struct(k.alias("id"), F.col("id").alias("to"))
        none = F.when(F.lit(False), entry(F.col("_new")))
        inserted = F.struct(F.col("_new").alias("id"), "seq", entry(F.col("_new")).alias("obj"), none.alias("old"))
        deleted = F.struct(F.col("_old").alias("id"), "seq", none.alias("obj"), entry(F.col("_old")).alias("old"))
        out = both.select(F.explode(F.array(inserted, deleted)).alias("c")).select("c.*")
        return ChangeStream(out.filter("id is not null"))

    def union(self, *others: ChangeStream) -> ChangeStream:
        out = self.changes
        for o in others:
            out = out.unionByName(o.changes, allowMissingColumns=True)
        return ChangeStream(out)

    def by_result_id(self) -> ChangeStream:
        """Changes of result rows, whose ids are in obj and old: one that moves a row is a delete of the old id and a put of the new."""
        moved = F.col("old.id").isNotNull() & ~F.col("old.id").eqNullSafe(F.col("obj.id"))
        none_obj, none_old = F.when(F.lit(False), F.col("obj")), F.when(F.lit(False), F.col("old"))
        put = F.when(F.col("obj").isNotNull(), F.struct(F.col("obj.id").alias("id"), "seq", "obj", F.when(moved, none_old).otherwise(F.col("old")).alias("old")))
        gone = F.when(F.col("old").isNotNull() & (F.col("obj").isNull() | moved), F.struct(F.col("old.id").alias("id"), "seq", none_obj.alias("obj"), "old"))
        out = self.changes.select(F.explode(F.array(gone, put)).alias("c")).filter("c is not null").select("c.*")
        return ChangeStream(out)

    def rows(self) -> DataFrame:
        """The collection that the changes lead to from nothing, applied in the order of seq."""
        return fold(self.by_result_id().changes).select("obj.*")

    def to(self, output) -> None:
        output.change(self)


class Pipe:
    """A source of changes that is fed by hand: every subscriber gets what is put in after it subscribed, in turn."""

    def __init__(self):
        self._subscribers: list[Callable[[ChangeStream], None]] = []

    def on_change(self, callback: Callable[[ChangeStream], None]) -> None:
        self._subscribers.append(callback)

    def unobserve(self, callback: Callable[[ChangeStream], None]) -> None:
        self._subscribers.remove(callback)

    def change(self, changes: ChangeStream) -> None:
        for callback in list(self._subscribers):
            callback(changes)


def fold(changes: DataFrame) -> DataFrame:
    """(id, obj) of what exists after all changes: the last change of each id, if it isn't a delete.

    Combined before the shuffle, so an id with very many changes is one row for each task. Of changes equal in seq a put wins over a
    delete.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("obj"), F.struct("seq", F.col("obj").isNotNull())).alias("_last"))
    return last.filter("_last.obj is not null").select("id", "_last.obj")


def net(changes: DataFrame) -> DataFrame:
    """One change for each id: from its first old to its last obj; ids that end as they began drop out."""
    one = changes.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("obj", "seq").alias("obj"), F.min_by("old", "seq").alias("old"))
    return one.filter(~F.col("obj").eqNullSafe(F.col("old")))
