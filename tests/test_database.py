"""The scenarios of the document store: tables, logs, queries, indexes and live queries, restarts and failures."""

import time

import pytest
from oracle import TABLES_AT, compare, connect
from pyspark.sql import functions as F

from lakeloom import Database, Pipe, Range
from lakeloom.operators.changes import ChangeStream
from lakeloom.plans import store_queries
from lakeloom.sources.changelog import Changelog, ConflictError, TruncatedError
from lakeloom.streaming.index import sql_stream
from lakeloom.streaming.live import LiveCount, live_object, live_range
from lakeloom.streaming.profiler import Profiler

PEOPLE = [("k03", "Ines"), ("k07", "Marek"), ("k11", "Ines"), ("k20", "Tovi"), ("k31", "Aya"), ("k32", "Oleg")]
NOTES = [("n1", "k07", "red kite"), ("n2", "k20", "late train"), ("n4", "k07", "apples"), ("n5", "k31", "zinc"), ("n8", "k99", "to nobody"), ("n9", "k20", "ok"), ("nA", "k03", None)]
READINGS = [("temp", 3.5, 0), ("door", 0.0, 1), ("temp", 4.0, 2), ("rain", 7.25, 3)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fill(db):
    spark = db.spark
    db.create_table("people", "id string, name string").put(frame(spark, PEOPLE, "id string, name string"))
    db.create_table("notes", "id string, author string, text string, reactions array<string>").put(frame(spark, NOTES, "id string, author string, text string"))
    db.create_log("readings", "type string, value double").put(frame(spark, READINGS, "type string, value double, o int"), ["o"])
    return db


def by_name(input, output, params=None):
    input.table("people").map(lambda f: {"id": F.concat(f("name"), F.lit("_"), f("id")), "to": f("id")}).to(output)


def joined(input, output, params=None):
    input.table("notes").lookup(input.table("people"), "author", "user").to(output)


def by_type(input, output, params=None):
    input.log("readings").map(lambda f: {"id": F.concat(f("type"), F.lit("_"), f("id")), "to": f("id")}).to(output)


def over_index(input, output, params=None):
    input.index("by_name").filter(lambda f: f("id").startswith(params["prefix"])).to(output)


def totals(input, output, params=None):
    output.update(input.table("notes"), "author", {"n": F.count("*"), "last": F.max("text")})


def broken(input, output, params=None):
    input.table("people").filter(lambda f: F.raise_error(F.lit("broken")).isNotNull()).to(output)


def by_sql(input, output, params=None):
    output.change(sql_stream(input, {"the_people": "people"}, "SELECT name AS id, count(*) AS n FROM the_people GROUP BY name"))


def model(people, notes):
    names = dict(people)
    return sorted((i, a, t, names.get(a)) for i, a, t in notes)


def rows_of_join(df):
    return sorted((r["id"], r["author"], r["text"], r["user"]["name"] if r["user"] else None) for r in df.collect())


def test_scan_ranges_and_counts(db):
    people = fill(db).table("people")
    ids = lambda r: [x.id for x in people.range_get(r).collect()]
    assert [tuple(r) for r in people.range_get().collect()] == PEOPLE
    assert ids({"gt": "k03", "lte": "k20"}) == ["k07", "k11", "k20"]
    assert ids({"gte": "k07", "lt": "k20"}) == ["k07", "k11"]
    assert ids({"reverse": True, "limit": 2}) == ["k32", "k31"]
    assert ids({"offset": 2, "limit": 3}) == ["k11", "k20", "k31"]
    assert people.count_get({"gt": "k10"}).first().n == 4
    assert people.count_get({"gt": "k10", "limit": 1}).first().n == 1
    assert people.object_get("k07").first().name == "Marek"
    assert people.object_get("k08").first() is None
    assert tuple(people.boundary_ids().first()) == ("k03", "k32")
    assert [r.id for r in people.page("k11", 1).collect()] == ["k20"]


def test_queries(db):
    fill(db)
    assert [r.id for r in db.query_get(by_name).collect()] == ["Aya_k31", "Ines_k03", "Ines_k11", "Marek_k07", "Oleg_k32", "Tovi_k20"]
    assert rows_of_join(db.query_get(joined)) == model(PEOPLE, NOTES)
    assert [(r.type, r.value) for r in db.query_get(lambda i, o: i.log("readings").to(o)).collect()] == [e[:2] for e in READINGS]
    assert db.query_object_get(lambda i, o: i.table("people").to(o)).first().id == "k03"

    def backwards(input, output):
        output.set_reverse()
        input.table("people").of_range({"gte": "k11"}).to(output)

    assert [r.id for r in db.query_get(backwards).collect()] == ["k32", "k31", "k20", "k11"]
    exploded = lambda i, o: i.table("notes").flat_map(lambda f: F.transform(F.split(f("text"), " "), lambda w: F.struct(F.concat(w, F.lit("_"), f("id")).alias("id"), w.alias("word")))).to(o)
    assert [r.word for r in db.query_get(exploded).collect()] == sorted(w for _, _, t in NOTES if t for w in t.split())


def test_output_puts_deletes_and_unions(db):
    fill(db)
    people = db.table("people").rows()

    def code(input, output):
        output.put(people)
        output.put(people.filter("id = 'k03'").withColumn("name", F.lit("again")))
        output.delete(people.filter("id = 'k07'"))
        assert output.get("k03").first().name == "again"

    assert [tuple(r) for r in db.query_get(code).collect()] == [("k03", "again"), *PEOPLE[2:]]
    with pytest.raises(PermissionError):
        db.query_get(lambda i, o: o.table("people"))


def test_update_query_merges_reactions(db):
    fill(db)
    db.query_update(lambda i, o: o.table("notes").update(i.table("notes").get(), [{"op": "merge", "value": {"reactions": ["a", "b"]}}]))
    assert all(r.reactions == ["a", "b"] for r in db.table("notes").rows().collect())


def test_writes_and_their_operations(db):
    people, schema = fill(db).table("people"), "id string, name string"
    version = people.changelog.version()
    people.put(frame(db.spark, PEOPLE, schema))
    assert people.changelog.version() == version  # nothing changed, nothing is logged
    people.delete(frame(db.spark, [("k00",)], "id string"))
    assert people.changelog.version() == version
    people.put(frame(db.spark, [("k40", "x", 1), ("k40", "y", 2), ("k40", "z", 0)], "id string, name string, o int"), ["o"])
    assert people.object_get("k40").first().name == "y"
    people.update(frame(db.spark, [("k50",), ("k03",)], "id string"), [{"op": "set", "property": "name", "value": "n"}])
    people.update(frame(db.spark, [("k60",)], "id string"), [{"op": "set", "property": "name", "value": "n"}], if_exists=True)
    assert sorted(tuple(r) for r in people.rows().collect()) == sorted([("k03", "n"), *PEOPLE[1:], ("k40", "y"), ("k50", "n")])
    for bad in (None, ""):
        with pytest.raises(ValueError, match="non-empty"):
            people.put(frame(db.spark, [(bad, "x")], schema))
    records = people.changelog.records().orderBy("seq").collect()
    assert [r.seq for r in records] == sorted({r.seq for r in records})
    assert {(r.op, r.id, r.old.name if r.old else None) for r in records} >= {("put", "k03", "Ines"), ("put", "k50", None)}


def test_writes_of_nothing(db, spark):
    table, log, none = db.create_table("t", "id string, n int"), db.create_log("l", "n int"), frame(spark, [], "id string, n int")
    for write in (lambda: table.put(none), lambda: table.delete(none), lambda: table.update(none, [{"op": "set", "property": "n", "value": 1}]), lambda: log.put(none, ["n"]), lambda: log.put(none)):
        assert write() == 0
    table.put(frame(spark, [("a", 1)], "id string, n int"))
    for write in (lambda: table.put(none), lambda: table.delete(none.filter("false")), lambda: table.update(none, [{"op": "set", "property": "n", "value": 1}])):
        assert write() == 1
    assert [tuple(r) for r in table.rows().collect()] == [("a", 1)] and log.rows().count() == 0
    nothing = db.create_index("nothing", lambda i, o, p: i.table("t").filter(lambda f: f("n") > 5).to(o))
    table.put(frame(spark, [("b", 2)], "id string, n int"))
    nothing.update()
    assert nothing.rows().count() == 0 and not nothing.update()


def test_two_writers_conflict(db):
    log = fill(db).table("people").changelog
    record = db.spark.createDataFrame([("put", "k88")], "op string, id string")
    log.append(record, base=log.version())
    with pytest.raises(ConflictError):
        log.append(record, base=log.version() - 1)
    assert log.records().filter("id = 'k88'").count() == 1


def test_no_update_is_lost(db, spark):
    """Another handle writes between an update's read and its write; both of its additions hold, and so does a put among deletes."""
    first = db.create_table("counts", "id string, n bigint")
    first.put(frame(spark, [("a", 0), ("b", 0)], "id string, n bigint"))
    second, one = Database(spark, db.root).table("counts"), frame(spark, [("a",)], "id string")
    add, write, others = [{"op": "add", "property": "n", "value": 1}], first._append, [lambda: second.update(one, add), lambda: second.delete(frame(spark, [("b",)], "id string"))]

    def late(*args):
        if others:
            others.pop(0)()
        return write(*args)

    first._append = late
    first.update(one, add)
    assert first.object_get("a").first().n == 2
    first.put(frame(spark, [("b", 7)], "id string, n bigint"))
    assert first.object_get("b").first().n == 7 and first.changelog.records().filter("id = 'b' and op = 'delete'").count() == 1


def test_log_ids_and_replay(db):
    log, schema = fill(db).log("readings"), "type string, value double"
    assert [r.id.split(":")[1] for r in log.range_get().collect()] == [f"{i:06d}" for i in range(4)]
    log.put(frame(db.spark, [("temp", 9.0)], schema), now_ms=0)
    ids = [r.id for r in log.range_get().collect()]
    assert ids == sorted(set(ids)) and len(ids) == 5
    log.put_old(frame(db.spark, [("0000000000000001:000000", "old", 1.0)], f"id string, {schema}"))
    assert log.range_get({"limit": 1}).first().type == "old"
    for _ in range(2):
        log.put(frame(db.spark, [("once", 1.0)], schema), flag="load 1")
    assert log.rows().filter("type = 'once'").count() == 1


def test_log_order_beyond_a_million_rows(db, spark):
    log = db.create_log("many", "n bigint")
    log.put(spark.range(1_000_010).withColumnRenamed("id", "n"), ["n"])
    log.put(frame(spark, [(-1,)], "n bigint"))
    last = log.range_get({"reverse": True, "limit": 13}).collect()
    assert [r.n for r in last] == [-1, *range(1_000_009, 999_997, -1)]
    assert [r.timestamp - last[-1].timestamp for r in last[1:]] == [1] * 10 + [0] * 2


def test_sequences_without_an_order(db, spark):
    table = db.create_table("wide", "id string, n bigint")
    table.put(spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n")))
    seqs = [r.seq for r in table.changelog.records().orderBy("seq").collect()]
    assert len(set(seqs)) == 40 and {len(s) for s in seqs} <= {23, 30}
    assert {s[:16] for s in seqs} == {seqs[0][:16]}


def test_changelogs_are_tidied(db, spark, monkeypatch):
    monkeypatch.setattr("lakeloom.sources.collection.COMPACT_AFTER", 2)
    table, log, want = db.create_table("t", "id string, n bigint"), db.create_log("l", "n bigint"), {}
    table.put(spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n")))
    want |= {str(i): i for i in range(100)}
    for i in range(12):
        table.put(frame(spark, [(str(i), 1000 + i), (f"x{i}", i)], "id string, n bigint"))
        table.delete(frame(spark, [(f"x{i - 1}",)], "id string"))
        want |= {str(i): 1000 + i, f"x{i}": i}
        want.pop(f"x{i - 1}", None)
        log.put(frame(spark, [(i,)], "n bigint"))
        assert {r.id: r.n for r in table.rows().collect()} == want
        assert [r.n for r in log.range_get().collect()] == list(range(i + 1))
    assert table.changelog.versions("delta") and len(table.changelog.versions("base")) <= 3
    assert table.changelog.uncompacted() <= 2 and log.changelog.uncompacted() <= 2
    assert {r.id for r in table.changelog.snapshot(3).collect()} == {*map(str, range(100)), "x0", "x1"}  # an old version, read as of then


def test_clearing_the_operation_log(db):
    people = fill(db).table("people")
    with pytest.raises(ValueError, match="future"):
        people.clear_oplog(int(time.time() * 1000) + 10_000_000)
    people.delete(frame(db.spark, [("k03",)], "id string"))
    time.sleep(0.01)
    result = people.clear_oplog(int(time.time() * 1000))
    assert result["count"] == 6 and result["last"]
    assert sorted(r.id for r in people.rows().collect()) == [i for i, _ in PEOPLE[1:]]
    with pytest.raises(TruncatedError):
        people.changelog.changes(0)
    assert people.changelog.records().filter("op = 'clearOpLog'").count() == 1
    assert people.clear_oplog(0) == {"count": 0, "last": None}
    assert db.clear_oplogs(int(time.time() * 1000), 1)["count"] <= 1


def test_catalog(db, spark):
    seen, logs = [], []
    db.observe_config(lambda c: seen.append(sorted(c["tables"])))
    db.observe_names("log", logs.append)
    fill(db)
    assert db.names("table") == ["notes", "people"] and seen[-1] == ["notes", "people"] and logs == [[], ["readings"]]
    with pytest.raises(ValueError, match="already exists"):
        db.create_table("people", "id string")
    with pytest.raises(LookupError):
        db.table("nobody")
    db.create_index("by_name", by_name)
    db.rename("table", "people", "folk")
    assert db.table("folk").rows().count() == 6
    assert db.config("index", "by_name")["sources"][0]["name"] == "folk"
    db.delete("log", "readings")
    again = Database(spark, db.root)
    assert again.catalog().count() == 3 and again.table("folk").rows().count() == 6


def test_two_drivers_change_the_catalog(db, spark):
    other = Database(spark, db.root)
    db.create_table("mine", "id string")
    other.create_table("theirs", "id string")
    assert db.names("table") == other.names("table") == Database(spark, db.root).names("table") == ["mine", "theirs"]
    assert db.table("theirs").rows().count() == 0
    with pytest.raises(ValueError, match="already exists"):
        db.create_table("theirs", "id string")


def test_index_by_name(db):
    fill(db)
    index = db.create_index("by_name", by_name)
    people = db.table("people")
    people.put(frame(db.spark, [("k11", "renamed"), ("k44", "new")], "id string, name string"))
    people.delete(frame(db.spark, [("k20",)], "id string"))
    assert index.update() and not index.update()
    assert [r.id for r in index.range_get().collect()] == ["Aya_k31", "Ines_k03", "Marek_k07", "Oleg_k32", "new_k44", "renamed_k11"]
    assert index.changelog.records().filter("op = 'indexed'").count() == 1
    deeper = db.create_index("some", over_index, {"prefix": "Ines_"})
    assert [r.id for r in deeper.range_get().collect()] == ["Ines_k03"]
    assert db.index_order() == ["by_name", "some"]
    people.delete(frame(db.spark, [("k03",)], "id string"))
    db.update_indexes()
    assert deeper.rows().count() == 0


def either(input, output, params=None):
    input.table("a").to(output)
    input.table("b").to(output)


def with_rows(input, output, params=None):
    input.table("a").to(output)
    output.put(input.database.table("b").rows())
    output.delete(input.database.table("a").rows().filter("v = 'hidden'").select("id"))


def test_union_of_tables_with_common_ids(db, spark):
    """An index and a live list hold what the last table that has an id says of it, through changes and deletes on both sides."""
    schema, rows = "id string, v string", {"a": {"1": "a1", "2": "a2"}, "b": {"1": "b1"}}
    for name, has in rows.items():
        db.create_table(name, schema).put(frame(spark, list(has.items()), schema))
    index, live = db.create_index("either", either), db.query_observable(either)
    for name, changed in (("a", ("1", "a1x")), ("b", ("1", None)), ("b", ("2", "b2")), ("a", ("2", None)), ("b", ("2", None)), ("a", ("3", "a3"))):
        if changed[1] is None:
            db.table(name).delete(frame(spark, [changed[:1]], "id string"))
            del rows[name][changed[0]]
        else:
            db.table(name).put(frame(spark, [changed], schema))
            rows[name] |= dict([changed])
        index.update(), live.update()
        want = sorted((rows["a"] | rows["b"]).items())
        assert [tuple(r) for r in index.range_get().collect()] == want == [tuple(r) for r in live.value()] == [tuple(r) for r in db.query_get(either).collect()]


def test_an_index_of_rows_put_and_deleted(db, spark):
    schema = "id string, v string"
    for name, has in (("a", [("1", "a1"), ("2", "hidden")]), ("b", [("3", "b3")])):
        db.create_table(name, schema).put(frame(spark, has, schema))
    index = db.create_index("with_rows", with_rows)
    assert [tuple(r) for r in index.range_get().collect()] == [("1", "a1"), ("3", "b3")]
    db.table("a").put(frame(spark, [("1", "hidden"), ("2", "shown")], schema))
    index.update()
    assert [tuple(r) for r in index.range_get().collect()] == [("2", "shown"), ("3", "b3")]


def test_join_index_and_live_join_through_the_same_changes(db):
    fill(db)
    index = db.create_index("joined", joined)
    live, signals = db.query_observable(joined), []
    live.observe(lambda *s: signals.append(s))
    people, notes = dict(PEOPLE), {m[0]: m for m in NOTES}
    table, note, person = {n: db.table(n) for n in ("people", "notes")}, "id string, author string, text string", "id string, name string"
    steps = [
        lambda: (table["people"].put(frame(db.spark, [("k99", "found")], person)), people.update({"k99": "found"})),
        lambda: (table["notes"].put(frame(db.spark, [("n0", "k32", "new")], note)), notes.update({"n0": ("n0", "k32", "new")})),
        lambda: (table["people"].delete(frame(db.spark, [("k07",)], "id string")), people.pop("k07")),
        lambda: (table["notes"].put(frame(db.spark, [("n1", "k11", "moved")], note)), notes.update({"n1": ("n1", "k11", "moved")})),
        lambda: (table["notes"].delete(frame(db.spark, [("n9",)], "id string")), notes.pop("n9"), table["people"].put(frame(db.spark, [("k20", "both")], person)), people.update({"k20": "both"})),
    ]
    for step in steps:
        step()
        index.update()
        live.update()
        want = sorted(model(people.items(), notes.values()), key=repr)
        assert sorted(rows_of_join(index.rows()), key=repr) == want
        assert sorted(((r["id"], r["author"], r["text"], r["user"]["name"] if r["user"] else None) for r in live.value()), key=repr) == want
    assert signals[0][0] == "set" and {s[0] for s in signals[1:]} == {"putByField", "removeByField"}
    live.dispose()
    assert live.update() == 0
    live.respawn()
    assert len(live.value()) == len(notes)


def test_aggregate_and_sql_indexes_shrink(db):
    fill(db)
    index, by = db.create_index("totals", totals), db.create_index("by_sql", by_sql)
    assert {(r.id, r.n, r.last) for r in index.rows().collect()} == {("k07", 2, "red kite"), ("k20", 2, "ok"), ("k31", 1, "zinc"), ("k99", 1, "to nobody"), ("k03", 1, None)}
    db.table("notes").delete(frame(db.spark, [("n1",), ("n5",)], "id string"))
    db.table("people").delete(frame(db.spark, [("k11",), ("k07",)], "id string"))
    db.update_indexes()
    assert {(r.id, r.n, r.last) for r in index.rows().collect()} == {("k07", 1, "apples"), ("k20", 2, "ok"), ("k99", 1, "to nobody"), ("k03", 1, None)}
    assert {(r.id, r.n) for r in by.rows().collect()} == {("Ines", 1), ("Tovi", 1), ("Aya", 1), ("Oleg", 1)}


def test_index_follows_a_stream_and_survives_truncation(db):
    fill(db)
    index = db.create_index("by_type", by_type)
    db.log("readings").put(frame(db.spark, [("new", 1.0)], "type string, value double"))
    index.start(once=True).awaitTermination(120)
    assert index.rows().count() == 5
    names = db.create_index("by_name", by_name)
    people = db.table("people")
    people.delete(frame(db.spark, [("k03",)], "id string"))
    people.delete(frame(db.spark, [("k07",)], "id string"))
    time.sleep(0.01)
    people.clear_oplog(int(time.time() * 1000))
    names.update()  # the changes it lacks are gone: it's rebuilt
    assert [r.id for r in names.range_get().collect()] == ["Aya_k31", "Ines_k11", "Oleg_k32", "Tovi_k20"]


def test_start_opens_all_and_follows(db, spark):
    fill(db)
    db.create_index("by_name", by_name)
    again = Database(spark, db.root)
    again.start()
    try:
        assert again.index("by_name").query.isActive
        db.table("people").put(frame(spark, [("k77", "Zoe")], "id string, name string"))
        for _ in range(300):
            if again.index("by_name").object_get("Zoe_k77").count():
                break
            time.sleep(0.2)
        assert again.index("by_name").rows().count() == 7
    finally:
        again.index("by_name").stop()


def test_an_index_that_fails_is_marked(db, spark):
    fill(db)
    with pytest.raises(Exception, match="broken"):
        db.create_index("broken", broken)
    assert db.config("index", "broken")["status"].startswith("failed")
    strict = Database(spark, db.root, remove_failed=True)
    strict.update_indexes()
    assert strict.names("index") == []
    with pytest.raises(ValueError, match="limit"):
        db.create_index("limited", lambda i, o, p: i.table("people").of_range({"limit": 2}).to(o))


def test_live_list_with_more_changes_than_it_may_have_rows(db):
    fill(db)
    live = db.query_observable(lambda i, o: i.table("people").map(lambda f: {"id": F.concat(f("name"), F.lit("_"), f("id"))}).to(o), most=6)
    people, want = db.table("people"), [f"new_{i}" for i, _ in PEOPLE]
    people.put(frame(db.spark, [(i, "new") for i, _ in PEOPLE], "id string, name string"))  # a delete and a put for each
    live.update()
    assert [r["id"] for r in live.value()] == want
    people.put(frame(db.spark, [("k90", "new")], "id string, name string"))
    for _ in range(2):
        with pytest.raises(ValueError, match="more than 6"):
            live.update()
        assert [r["id"] for r in live.value()] == want
    people.delete(frame(db.spark, [("k03",)], "id string"))
    live.update()
    assert [r["id"] for r in live.value()] == [*want[1:], "new_k90"]


def test_live_join_brings_no_rows_to_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr("lakeloom.streaming.live.LiveList._read", refuse)
    d = f"{TABLES_AT}/sf0.001"
    assert compare(spark, connect(d), d, store_queries.QUERIES["live_join"], store_queries.SQL["live_join"]) == ""


def test_table_compacted_removes_versions(spark, monkeypatch):
    clear, cleared = Changelog.clear, []
    monkeypatch.setattr(Changelog, "clear", lambda *a: cleared.append(clear(*a)) or cleared[-1])
    assert store_queries.QUERIES["table_compacted"](spark, f"{TABLES_AT}/sf0.001").count() > 0
    assert [c["count"] > 0 for c in cleared] == [True]


def test_live_objects_ranges_and_counts(db):
    fill(db)
    one, some, n = live_object(db, "people", "k07"), live_range(db, "people", {"gt": "k07", "lt": "k31"}), LiveCount(db.table("people"), {"gte": "k11"})
    seen = []
    one.observe(lambda signal, value, _: seen.append(value.name if value else None))
    assert [r.id for r in some.value()] == ["k11", "k20"] and n.value == 4
    db.table("people").put(frame(db.spark, [("k07", "renamed"), ("k15", "between")], "id string, name string"))
    db.table("people").delete(frame(db.spark, [("k20",)], "id string"))
    one.update(), some.update()
    assert seen == ["Marek", "renamed"] and [r.id for r in some.value()] == ["k11", "k15"] and n.update() == 4
    db.table("people").delete(frame(db.spark, [("k07",)], "id string"))
    one.update()
    assert seen[-1] is None
    first = db.query_object_observable(lambda i, o: i.table("people").to(o))
    db.table("people").delete(frame(db.spark, [("k03",)], "id string"))
    first.update()
    assert first.first().id == "k11"
    with pytest.raises(ValueError, match="more than 1 rows"):
        db.query_observable(lambda i, o: i.table("people").to(o), most=1)


def test_change_algebra(spark):
    schema = "id string, seq string, obj struct<id:string,n:int>, old struct<id:string,n:int>"
    changes = ChangeStream(spark.createDataFrame([("a", "1", ("a", 5), None), ("b", "2", ("b", 1), ("b", 9)), ("c", "3", None, ("c", 7)), ("d", "4", ("d", 8), ("d", 9)), ("e", "5", None, None)], schema))
    kept = {r.id: (r.obj and r.obj.n, r.old and r.old.n) for r in changes.filter(lambda f: f("n") > 4).changes.collect()}
    assert kept == {"a": (5, None), "b": (None, 9), "c": (None, 7), "d": (8, 9)}
    index = changes.index_by(lambda f: F.when(f("n") > 4, F.lit("big")).otherwise("small"), when=lambda f: f("n") != 7).changes
    assert {(r.id, r.obj is not None) for r in index.collect()} == {('"big"_a', True), ('"small"_b', True), ('"big"_b', False)}
    pipe, got = Pipe(), []
    pipe.on_change(got.append)
    pipe.change(changes)
    pipe.unobserve(got.append)
    pipe.change(changes)
    assert len(got) == 1


def test_prefix_ranges_need_their_separator(spark):
    df = spark.createDataFrame([("1_a",), ("10_b",), ("2_c",)], "id string")
    assert [r.id for r in Range.prefix("1_").apply(df).collect()] == ["1_a"]
    assert [r.id for r in Range.prefix("1").apply(df).collect()] == ["10_b", "1_a"]


def test_profiler(spark):
    p = Profiler(3)
    p.log("ignored")
    p.start_log()

    @p.profiled
    def work(x):
        return x + 1

    assert work(1) == 2
    assert [(r.type, r.details) for r in p.frame(spark).orderBy("at_ms", "type").collect()] == [("begin", "x=1"), ("end", "")]
