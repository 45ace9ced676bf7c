"""Each operation of the update language on small documents."""

import pytest
from pyspark.sql import functions as F

from lakeloom import compile_update

DOC = "id string, n double, s string, tags array<string>, home struct<city:string,floor:int>"
ROW = ("1", 5.0, "abc", ["a", "b"], ("x", 2))
EMPTY = ("2", None, None, None, None)


def run(spark, ops, rows=(ROW, EMPTY), legacy=False):
    df = spark.createDataFrame(list(rows), DOC)
    out = df.select(compile_update(df.schema, ops, legacy=legacy).alias("d")).select("d.*").orderBy("id")
    return [r.asDict(True) for r in out.collect()]


def op(name, prop=None, value=None, **more):
    return {"op": name, "property": prop, "value": value} | more


@pytest.mark.parametrize(
    ("operation", "field", "full", "empty"),
    [
        (op("set", "n", 7.0), "n", 7.0, 7.0),
        (op("set", "home.city", "y"), "home", {"city": "y", "floor": 2}, {"city": "y", "floor": None}),
        (op("set", "a.b.c", 1), "a", {"b": {"c": 1}}, {"b": {"c": 1}}),
        (op("delete", "s"), "s", None, None),
        (op("delete", "home.floor"), "home", {"city": "x", "floor": None}, None),
        (op("delete", "nothing.here"), "s", "abc", None),
        (op("addToSet", "tags", "a"), "tags", ["b", "a"], ["a"]),
        (op("addToSet", "s", "z"), "s", ["abc", "z"], ["z"]),
        (op("addToSet", "fresh", "z"), "fresh", ["z"], ["z"]),
        (op("deleteFromSet", "tags", "a"), "tags", ["b"], []),
        (op("mergeSets", "tags", ["b", "c"]), "tags", ["b", "c", "a"], ["b", "c"]),
        ({"op": "mergeSets", "property": "tags", "values": ["b", "c"]}, "tags", ["b", "c", "a"], ["b", "c"]),
        (op("add", "n", 2.0), "n", 7.0, 2.0),
        (op("add", "s", "d"), "s", "abcd", "d"),
        (op("add", "fresh", 2), "fresh", 2, 2),
        (op("max", "n", 9.0), "n", 9.0, 9.0),
        (op("max", "n", 1.0), "n", 5.0, 1.0),
        (op("min", "n", 1.0), "n", 1.0, 1.0),
        (op("min", "n", 9.0), "n", 5.0, 9.0),
        (op("merge", None, {"n": 1.0, "home": {"floor": 3}}), "home", {"city": "x", "floor": 3}, {"city": None, "floor": 3}),
        (op("merge", "home", {"city": "z"}), "home", {"city": "z", "floor": 2}, {"city": "z", "floor": None}),
        (op("merge", "tags", ["q"]), "tags", ["q"], ["q"]),
        (op("merge", "s", {"not": "an object"}), "s", "abc", None),
        (op("merge", "fresh", 3), "fresh", 3, 3),
        (op("reverseMerge", None, {"s": "new", "home": {"city": "new"}}), "s", "abc", "new"),
        (op("reverseMerge", "home", {"city": "new", "floor": 9}), "home", {"city": "x", "floor": 2}, {"city": "new", "floor": 9}),
        (op("conditional", conditions=[{"test": "gt", "property": "n", "value": 4}], operations=[op("set", "s", "big")]), "s", "big", None),
        (op("conditional", conditions=[{"test": "notExist", "property": "n"}], operations=[op("set", "n", 0.0)]), "n", 5.0, 0.0),
        (op("conditional", conditions=[{"test": "exist", "property": "home.city"}], operations=[op("set", "seen", True)]), "seen", True, None),
    ],
)
def test_operation(spark, operation, field, full, empty):
    a, b = run(spark, [operation])
    assert a[field] == full
    assert b[field] == empty


@pytest.mark.parametrize(("test", "value", "passes"), [("gt", 5, False), ("gte", 5, True), ("lt", 5, False), ("lte", 5, True), ("eq", 5.0, True), ("exist", None, True), ("notExist", None, False)])
def test_tests(spark, test, value, passes):
    a, b = run(spark, [op("conditional", conditions=[{"test": test, "property": "n", "value": value}], operations=[op("set", "s", "yes")])])
    assert (a["s"] == "yes") is passes
    assert (b["s"] == "yes") is (test == "notExist")


def test_conditions_are_all_needed_and_nest(spark):
    inner = op("conditional", conditions=[{"test": "eq", "property": "s", "value": "abc"}], operations=[op("add", "n", 1.0)])
    outer = op("conditional", conditions=[{"test": "gt", "property": "n", "value": 1}, {"test": "lt", "property": "n", "value": 9}], operations=[inner])
    assert [r["n"] for r in run(spark, [outer])] == [6.0, None]


def test_operations_follow_each_other(spark):
    assert run(spark, [op("set", "n", 1.0), op("add", "n", 2.0), op("max", "n", 10.0)])[0]["n"] == 10.0


def test_legacy_takes_a_stored_0_for_missing(spark):
    zero = ("3", 0.0, None, None, None)
    assert run(spark, [op("max", "n", -5.0)], [zero], legacy=True)[0]["n"] == -5.0
    assert run(spark, [op("max", "n", -5.0)], [zero])[0]["n"] == 0.0
    assert run(spark, [op("merge", "fresh", 3)], [zero], legacy=True)[0].get("fresh") is None
    assert run(spark, [op("reverseMerge", "s", "new")], [ROW], legacy=True)[0]["s"] == "new"


def test_unknown_operations_and_tests(spark):
    with pytest.raises(ValueError, match="unknown operation"):
        run(spark, [op("frobnicate", "n", 1)])
    for wrong, said in (({"op": "set", "property": "n"}, "lacks value"), ({"op": "add", "value": 1}, "lacks property"), ({"op": "max", "property": "n", "value": 1, "by": 2}, "doesn't know by"), ({"op": "mergeSets", "property": "tags"}, "lacks value")):
        with pytest.raises(ValueError, match=said):
            run(spark, [wrong])
    with pytest.raises(ValueError, match="unknown test"):
        run(spark, [op("conditional", conditions=[{"test": "near", "property": "n", "value": 1}], operations=[])])


def test_a_struct_column_as_document(spark):
    df = spark.createDataFrame([ROW], DOC).select(F.struct("*").alias("doc"))
    assert df.select(compile_update(df.schema["doc"].dataType, [op("set", "n", 8.0)], F.col("doc")).alias("d")).first().d.n == 8.0
