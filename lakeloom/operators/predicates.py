"""Ranges over ids, and the tests of conditional updates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """A slice of a collection in the order of its ids (as text): bounds, direction, offset and limit, all optional."""

    gt: str | None = None
    gte: str | None = None
    lt: str | None = None
    lte: str | None = None
    limit: int | None = None
    reverse: bool = False
    offset: int | None = None

    @classmethod
    def of(cls, r: Range | dict | None) -> Range:
        return r if isinstance(r, Range) else cls(**(r or {}))

    @classmethod
    def prefix(cls, p: str) -> Range:
        """Ids that begin with p and go on below U+00FF; end p with the separator, or '1' also finds '10_...'."""
        return cls(gte=p, lt=p + "ÿ")

    def condition(self, column: str = "id") -> Column:
        c, out = F.col(column), F.lit(True)
        for bound, test in ((self.gt, c.__gt__), (self.gte, c.__ge__), (self.lt, c.__lt__), (self.lte, c.__le__)):
            if bound is not None:
                out = out & test(F.lit(bound))
        return out

    @property
    def bounded(self) -> bool:
        return any(b is not None for b in (self.gt, self.gte, self.lt, self.lte))

    def filter(self, df: DataFrame, column: str = "id") -> DataFrame:
        return df.filter(self.condition(column)) if self.bounded else df

    def apply(self, df: DataFrame, column: str = "id") -> DataFrame:
        """The slice in order; a limit becomes a top-k, not a full sort."""
        out = self.filter(df, column).orderBy(F.desc(column) if self.reverse else F.asc(column))
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)


def literal(value: Any) -> Column:
    """A column of a Python value; lists become arrays, dicts structs."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.lit(value)


#: Tests by name, from the value at a path and the test's value; each is false, never null, where the value is missing.
TESTS = {
    "gt": lambda c, v: F.coalesce(c > v, F.lit(False)),
    "gte": lambda c, v: F.coalesce(c >= v, F.lit(False)),
    "lt": lambda c, v: F.coalesce(c < v, F.lit(False)),
    "lte": lambda c, v: F.coalesce(c <= v, F.lit(False)),
    "eq": lambda c, v: c.eqNullSafe(v),
    "exist": lambda c, v: c.isNotNull(),
    "notExist": lambda c, v: c.isNull(),
}


def test_of(name: str):
    if name not in TESTS:
        raise ValueError(f"unknown test {name!r}")
    return TESTS[name]
