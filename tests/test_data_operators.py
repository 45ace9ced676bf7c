"""The operators for the general data problems: nulls, ties, repeats, empty tables, clashing columns, skew, failures, brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.keys import numbered
from lakeloom.operators import cdc
from lakeloom.operators.cdc import _upsert_batches, apply_changes, current, reduce_changes, state_of
from lakeloom.operators.history import AttributeHistory, snapshot_events
from lakeloom.operators.hotkeys import KeyProfile, distinct_elements, hot_keys, id_owner
from lakeloom.operators.incremental import IncrementalTarget, fingerprint, latest_delivery, run_marks, state_at_marks
from lakeloom.operators.references import Reference, author_key, find_orphans, orphan_report
from lakeloom.session import materialize
from lakeloom.sources.versioned import VersionConflict, VersionedTable

T0 = datetime(2025, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(days=n)


# p1

SOURCE = "store string, id string, v string, _part int, _held_id string"


def source(spark, rows):
    return spark.createDataFrame([(s, i, v, 1, "x") for s, i, v in rows], SOURCE)


def target(spark, tmp_path, **kw):
    return IncrementalTarget(VersionedTable(spark, f"file://{tmp_path}/t"), ["store", "id"], "v", {"shown": F.upper("v")}, **kw)


def test_runs_take_what_is_new_or_changed(spark, tmp_path):
    t = target(spark, tmp_path, compact_after=3)
    rows = [("a", "1", "x"), ("a", None, "x"), (None, "1", None)]
    assert t.pending(source(spark, rows)).count() == 3 and t.rows() is None
    t.run(source(spark, rows))
    assert t.pending(source(spark, rows)).count() == 0  # nulls are equal to nulls
    for i in range(4):
        rows = [("a", "1", f"y{i}"), *rows[1:], ("a", f"new{i}", "z")]
        assert t.pending(source(spark, rows)).count() == 2
        t.run(source(spark, rows))
        assert {(r.store, r.id, r.v, r.shown) for r in t.rows().collect()} == {(s, k, v, v and v.upper()) for s, k, v in rows}
        assert t.rows().count() == len(rows)
        assert len(t.table.manifest()["parts"]) <= 3
    version = t.table.version()
    t.run(source(spark, []))
    assert t.run(source(spark, rows)) == version and t.rows().count() == len(rows)  # nothing pending, nothing published


def test_parts_are_merged_by_size(spark, tmp_path):
    t, rows = target(spark, tmp_path, compact_after=3), [("a", str(i), "x") for i in range(300)]
    t.run(source(spark, rows))
    first = t.table.manifest()["parts"][0]
    for i in range(9):
        rows[i] = ("a", str(i), f"y{i}")
        t.run(source(spark, rows))
        m = t.table.manifest()
        assert len(m["parts"]) <= 3 and m["parts"][0] == first  # the large part isn't written again
    assert {(r.id, r.v) for r in t.rows().collect()} == {(i, v) for _, i, v in rows}
    rows[0] = ("a", "0", "x")  # back to what an old part says
    assert t.pending(source(spark, rows)).count() == 1


def test_a_failed_run_leaves_nothing_and_the_next_takes_all(spark, tmp_path):
    t, rows = target(spark, tmp_path), [("a", "1", "x"), ("a", "2", "y")]

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        t.run(source(spark, rows), before_publish=fail)
    assert t.rows() is None and t.pending(source(spark, rows)).count() == 2
    t.run(source(spark, rows))
    with pytest.raises(VersionConflict):  # a second writer publishes while ours is at work
        t.run(source(spark, [*rows, ("a", "3", "z")]), before_publish=lambda: t.run(source(spark, [*rows, ("a", "4", "w")])))
    assert {r.id for r in t.rows().collect()} == {"1", "2", "4"}
    assert t.table.vacuum() == 2
    assert t.rows().count() == 3


def test_latest_delivery_ties_and_nulls(spark):
    rows = [("a", at(1), "x"), ("a", at(2), "y"), ("a", at(2), "z"), ("b", None, "n"), (None, at(1), None), (None, None, "q")]
    df = spark.createDataFrame(rows, "id string, t timestamp, v string")
    assert {(r.id, r.v) for r in latest_delivery(df, ["id"], "t", "v").collect()} == {("a", "z"), ("b", "n"), (None, None)}
    assert latest_delivery(df.limit(0), ["id"], "t", "v").count() == 0


def test_fingerprints_tell_null_from_empty(spark):
    df = spark.createDataFrame([((None, "a", None),), (("a", None, None),), (("a", "", None),), (("a", None, []),), (("a", None, [None]),)], "s struct<x:string,y:string,z:array<string>>")
    assert df.select(fingerprint(F.col("s")).alias("f")).distinct().count() == 5


def test_state_at_marks(spark):
    runs = spark.createDataFrame([("i", "s", "succeeded", at(3)), ("i", "s", "failed", at(9)), ("j", "s", "succeeded", at(5)), ("j", "s", None, at(8)), ("k", "s", "failed", at(9))], "index_name string, store string, status string, read_to timestamp")
    marks = run_marks(runs, ["index_name", "store"])
    assert {(r.index_name, r.mark) for r in marks.collect()} == {("i", at(3)), ("j", at(5)), ("k", None)}
    log = spark.createDataFrame([("s", "1", at(1), "a"), ("s", "1", at(3), "b"), ("s", "1", at(4), "c"), ("s", "2", at(6), "d"), ("s", "3", None, "e"), ("t", "9", at(1), "f")], "store string, id string, t timestamp, v string")
    out = state_at_marks(log, marks, "store", "id", "t", "v")
    assert {tuple(r) for r in out.collect()} == {("i", "s", "1", "b"), ("j", "s", "1", "c")}


# p2


def orphans(spark, users, messages, entries):
    tables = {
        "users": spark.createDataFrame(users, "id string, arrived_at timestamp"),
        "messages": spark.createDataFrame(messages, "id string, author string, arrived_at timestamp").withColumn("_key", F.lit(1)),
        "index": spark.createDataFrame(entries, "id string, to_id string, arrived_at timestamp"),
    }
    return find_orphans(tables, [Reference("messages", author_key(F.col("author")), "users"), Reference("index", F.col("to_id"), "messages")])


def test_direct_and_inherited_orphans(spark):
    out = orphans(
        spark,
        [("u", at(5)), ("u", at(1)), ("w", at(40))],
        [("1", "u", at(2)), ("2", " u.0 ", at(2)), ("3", "nobody", at(2)), ("3", "nobody", at(33)), ("4", "w", at(2)), ("5", None, at(2)), ("6", " ", at(2)), (None, "nobody", None)],
        [("a", "1", at(3)), ("b", "3", at(3)), ("c", "4", at(3)), ("d", "99", at(3)), ("e", "5", at(1)), ("f", None, at(1))],
    )
    got = {(r.ref_table, r.record_id, r.ref_month, r.state, r.kind, r.depth) for r in out.collect()}
    assert got == {
        ("messages", "3", "2025-01", "absent", "direct", 0), ("messages", "4", "2025-01", "late", "direct", 0), ("messages", None, None, "absent", "direct", 0),
        ("index", "d", "2025-01", "absent", "direct", 0), ("index", "e", "2025-01", "late", "direct", 0),
        ("index", "b", "2025-01", "absent", "inherited", 1), ("index", "c", "2025-01", "late", "inherited", 1),
    }
    assert orphan_report(out).agg(F.sum("n")).first()[0] == 7


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [], []).count() == 0
    assert {(r.record_id, r.kind) for r in orphans(spark, [], [("1", "u", at(1))], [("a", "1", at(2))]).collect()} == {("1", "direct"), ("a", "inherited")}


def test_orphans_in_a_cycle_end(spark):
    nodes = spark.createDataFrame([("1", "gone", at(1)), ("2", "1", at(2)), ("3", "2", at(3)), ("4", "5", at(6)), ("5", "4", at(6)), ("6", "6", at(1))], "id string, up string, arrived_at timestamp")
    out = find_orphans({"nodes": nodes}, [Reference("nodes", F.col("up"), "nodes")])
    assert {(r.record_id, r.kind, r.depth) for r in out.collect()} == {("1", "direct", 0), ("2", "inherited", 1), ("3", "inherited", 2)}


def test_two_references_to_one_table(spark):
    """Which reference is bad can be told, one doesn't hide the other, and the graver state holds though it's found later."""
    users = spark.createDataFrame([("u", at(1)), ("w", at(9))], "id string, arrived_at timestamp")
    messages = spark.createDataFrame([("1", "gone", "gone", at(2)), ("2", "u", "w", at(2)), ("3", "u", None, at(2)), ("4", "u", None, at(2))], "id string, author string, editor string, arrived_at timestamp")
    replies = spark.createDataFrame([("a", "3", "b", at(3)), ("b", "2", "c", at(3)), ("c", "3", "d", at(3)), ("d", "1", None, at(3))], "id string, of string, after string, arrived_at timestamp")
    out = find_orphans({"users": users, "messages": messages, "replies": replies}, [
        Reference("messages", F.col("author"), "users", "author"), Reference("messages", F.col("editor"), "users", "editor"),
        Reference("replies", F.col("of"), "messages", "of"), Reference("replies", F.col("after"), "replies", "after"),
    ])
    assert {(r.ref_name, r.record_id, r.state, r.kind, r.depth) for r in out.collect()} == {
        ("author", "1", "absent", "direct", 0), ("editor", "1", "absent", "direct", 0), ("editor", "2", "late", "direct", 0),
        ("of", "b", "late", "inherited", 1), ("of", "d", "absent", "inherited", 1), ("after", "c", "absent", "inherited", 2), ("after", "b", "absent", "inherited", 3), ("after", "a", "absent", "inherited", 2),
    }
    with pytest.raises(ValueError, match="same name"):
        find_orphans({"users": users}, [Reference("users", F.col("id"), "users")] * 2)


# p3


@pytest.mark.parametrize("spread", [1, 50, 10**6, 10**15, 2**61])
def test_exact_quantiles_against_brute_force(spark, spread):
    rng, rows = random.Random(spread), []
    for key, n in (("hot", 4000), ("warm", 300), ("one", 1), (None, 50)):
        rows += [(key, rng.randrange(-spread, spread)) for _ in range(n)]
    rows += [("hot", None)] * 10 + [("empty", None)]
    profile = KeyProfile(spark.createDataFrame(rows, "k string, v long"), F.col("k"), F.col("v"))
    got = {(r.key, r.q): r.value for r in profile.quantiles([0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    want = {}
    for key in ("hot", "warm", "one"):
        values = sorted(v for k, v in rows if k == key and v is not None)
        for q in (0.0, 0.25, 0.5, 0.99, 1.0):
            want[key, q] = values[max(1, -int(-q * len(values) // 1)) - 1]
    assert got == want
    counts = {r.key: (r.n_rows, r.least, r.most) for r in profile.counts().collect()}
    assert counts["hot"][0] == 4010 and counts["empty"] == (1, None, None) and None not in counts
    assert profile.total == len(rows)
    df = spark.createDataFrame(rows, "k string, v long")
    assert {(r.key, r.n_rows) for r in hot_keys(df, F.col("k")).collect()} == {("hot", 4010), ("warm", 300)}
    assert {r.key for r in hot_keys(df, F.col("k"), 50).collect()} == {"hot"}


def test_profile_of_nothing(spark):
    profile = KeyProfile(spark.createDataFrame([], "k string, v long"), F.col("k"), F.col("v"))
    assert profile.total == 0 and profile.quantiles([0.5]).count() == 0
    assert hot_keys(spark.createDataFrame([], "k string"), F.col("k")).count() == 0
    assert hot_keys(spark.createDataFrame([(None,)] * 3, "k string"), F.col("k")).count() == 0


def test_quantiles_with_far_values_and_no_exchange_of_rows(spark, monkeypatch):
    """Some far values don't coarsen the bins of the others; finer counts are joined, rows are not, even where nothing may be broadcast."""
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(30)}", rng.randrange(10**9)) for _ in range(3000)] + [("k1", -(10**15)), ("k2", 10**17)]
    df = spark.createDataFrame(rows, "k string, v long")
    written = []
    monkeypatch.setattr("lakeloom.operators.hotkeys.materialize", lambda x, label: written.append(x) or materialize(x, label))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.key, r.q): r.value for r in KeyProfile(df, F.col("k"), F.col("v")).quantiles([0.1, 0.5]).collect()}
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in written]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for k in {k for k, _ in rows}:
        values = sorted(v for key, v in rows if key == k)
        assert [got[k, q] for q in (0.1, 0.5)] == [values[max(1, -int(-q * len(values) // 1)) - 1] for q in (0.1, 0.5)]
    semi = [p for p in plans if "LeftSemi" in p]
    assert semi and all("LeftSemi" not in p or "strategy=broadcast" in p for p in plans)


def test_hot_keys_come_from_the_selection(spark, monkeypatch):
    df = spark.createDataFrame([("hot",)] * 50 + [(f"k{i}",) for i in range(500)], "k string")
    assert [r.key for r in hot_keys(df, F.col("k")).collect()] == ["hot"]
    select = KeyProfile.select
    monkeypatch.setattr(KeyProfile, "select", lambda self, wanted: select(self, wanted).limit(0))
    assert hot_keys(df, F.col("k")).count() == 0


def test_keys_and_elements(spark):
    df = spark.createDataFrame([(" 1.0 ", "1_2_3", ["a", "a", None]), (".0", "_x", None), ("", "none", []), (None, None, ["b"])], "a string, i string, e array<string>")
    assert [tuple(r) for r in df.select(author_key(F.col("a")), id_owner(F.col("i"))).collect()] == [("1", "1_2"), (None, ""), (None, None), (None, None)]
    assert [tuple(r) for r in distinct_elements(df, author_key(F.col("a")), F.col("e")).collect()] == [("1", "a")]


# p4

CHANGES = "store string, object_id string, seq string, tie string, deleted boolean, payload string, batch string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], CHANGES)


def brute(rows):
    state = {}
    for s, o, seq, tie, deleted, payload in rows:
        if o is not None and (s, o) not in state or o is not None and (seq, tie) > state[s, o][:2]:
            state[s, o] = (seq, tie, deleted, payload)
    return {(s, o, v[0], v[3]) for (s, o), v in state.items() if not v[2]}


def test_changes_in_any_order(spark, tmp_path):
    rng, rows = random.Random(1), []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"o{rng.randrange(40)}"
        gone = rng.random() < 0.3
        rows.append(("s", key, f"{rng.randrange(100000):06d}", "", gone, None if gone else rng.choice(["", "é" * 50, f'{{"v": {i}}}'])))
    unique = {(r[1], r[2]): r for r in rows}
    rows = [*unique.values(), *rng.sample(list(unique.values()), 200), ("s", None, "1", "", False, "lost")]
    rng.shuffle(rows)
    table = VersionedTable(spark, f"file://{tmp_path}/state")
    for part in (rows[:1000], rows[1000:2000], rows[2000:], rows[:50], []):
        apply_changes(table, changes(spark, part).repartition(3))
    assert {tuple(r) for r in current(table).collect()} == brute(rows)
    assert state_of(table).filter("deleted").count() > 0  # tombstones stay
    assert table.version() == 4  # the last changes were none
    assert reduce_changes(changes(spark, [])).count() == 0


def test_a_first_reduction_may_flush():
    import pyarrow as pa

    names = ["store", "object_id", "seq", "tie", "deleted", "payload"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, zip(*[("s", f"o{i % 7}", f"{j:03d}{i:03d}", "", False, "p") for i in range(50)])))) for j in range(4)]
    flushed = [r for b in _upsert_batches(iter(batches), 3) for r in b.to_pylist()]
    assert len(flushed) == 28
    whole = [r for b in _upsert_batches(iter(batches)) for r in b.to_pylist()]
    assert {(r["object_id"], r["seq"]) for r in whole} == {(o, max(r["seq"] for r in flushed if r["object_id"] == o)) for o in {r["object_id"] for r in flushed}}


def test_only_touched_buckets_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cdc, "ROWS_A_BUCKET", 10)
    table, rows = VersionedTable(spark, f"file://{tmp_path}/state"), [("s", f"o{i}", "1", "", False, f"p{i}") for i in range(200)]
    apply_changes(table, changes(spark, rows))
    before = table.manifest()["meta"]
    assert before["of"] == 20 and len(before["buckets"]) == 20
    more = [("s", "o7", "2", "", True, None), ("s", "o7", "0", "", False, "late"), ("s", "new", "1", "", False, "n")]
    apply_changes(table, changes(spark, more))
    after = table.manifest()["meta"]
    assert 1 <= sum(after["buckets"][b] != p for b, p in before["buckets"].items()) <= 2
    assert {tuple(r) for r in current(table).collect()} == brute(rows + more)
    many = [("s", f"x{i}", "1", "", False, "q") for i in range(1000)]
    apply_changes(table, changes(spark, many))  # too many for the buckets there are
    assert table.manifest()["meta"]["of"] > 80
    assert {tuple(r) for r in current(table).collect()} == brute(rows + more + many)
    assert table.vacuum() >= 2 and current(table).count() == 1200


# p5


def brute_versions(events):
    out = []
    for key in {e[0] for e in events}:
        now = start = None
        for _, seq, put, *attributes in sorted(e for e in events if e[0] == key):
            new = tuple(attributes) if put else None
            if new != now:
                if now is not None:
                    out.append((key, *now, start, seq))
                now, start = new, seq
        if now is not None:
            out.append((key, *now, start, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_hot", [10**9, 20])
def test_versions_against_brute_force(spark, least_hot):
    """The same, whether the entity with a third of all events is one chunk or cut into several."""
    rng, events = random.Random(7), []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        events.append((key, f"{i:06d}", rng.random() < 0.8, rng.choice([None, "", "a", "A "]), rng.choice([None, "x", "y"])))
    rng.shuffle(events)
    df = spark.createDataFrame([(*e, 0) for e in events], "key string, seq string, put boolean, name string, text string, attribute int")
    history = AttributeHistory(df, ["key"], "seq", ["name", "text"], least_hot)
    assert history.scan.hot is (least_hot == 20)
    got = sorted([tuple(r) for r in history.versions().select("key", "name", "text", "valid_from", "valid_to").collect()], key=repr)
    assert got == brute_versions(events)
    names = history.intervals().filter("attribute = 'name' and key = 'hot'").orderBy("valid_from").collect()
    assert all(a.valid_to == b.valid_from and a.value != b.value for a, b in zip(names, names[1:])) and names[-1].valid_to is None


def test_history_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, seq string, put boolean, name string")
    assert AttributeHistory(empty, ["key"], "seq", ["name"]).versions().count() == 0


def test_snapshots_as_events(spark):
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (1, "a", "late", 2), (8, "a", "late", 1), (22, "a", "late", 1), (1, "b", None, 1), (8, "b", None, 1), (15, "c", "q", 1), (22, "b", "n", 1), (None, "d", "x", 1), (1, None, "x", 1)]
    df = spark.createDataFrame([(at(d) and at(d).date(), i, n, at(s)) for d, i, n, s in rows], "taken_on date, id string, name string, loaded_at timestamp")
    history = AttributeHistory(snapshot_events(df, "taken_on", ["id"], ["name"], "loaded_at"), ["id"], "seq", ["name"])
    assert {tuple(r) for r in history.versions().collect()} == {
        ("a", "late", "2025-01-02", "2025-01-16"), ("a", "late", "2025-01-23", None), ("b", None, "2025-01-02", "2025-01-16"), ("b", "n", "2025-01-23", None), ("c", "q", "2025-01-16", "2025-01-23"),
    }


def test_numbering_without_one_partition(spark):
    df = spark.range(1000, numPartitions=5).withColumn("k", (F.col("id") * 7919) % 1000)
    assert [r.k for r in numbered(df, ["k"]).orderBy("_n").collect()] == list(range(1000))
