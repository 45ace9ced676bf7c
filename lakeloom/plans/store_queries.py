"""Queries of the document store's own operators, each through the operator, with the SQL that checks it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.keys import json_path, sha1, sha256, with_sequence_ids
from lakeloom.operators.changes import ChangeStream, Pipe, fold, net
from lakeloom.operators.joins import dereference, having, inner_lookup, lacking, lookup_join, range_lookup
from lakeloom.operators.mutators import compile_update
from lakeloom.operators.predicates import Range
from lakeloom.operators.incremental import latest_delivery
from lakeloom.plans.query import Group, Rows
from lakeloom.session import work_path
from lakeloom.sources.collection import FrameRows
from lakeloom.sources.database import Database

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def checked(sql: str | None = None):
    """Registers a query, and its SQL under the same name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{_BASE}{sql}" if "FROM u" in sql or "FROM m" in sql or "JOIN u" in sql else sql
        return f

    return add


_BASE = """WITH u AS (SELECT id, name FROM users QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1),
m AS (SELECT id, author, text, reactions FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1) """


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def users(spark, d) -> DataFrame:
    return latest_delivery(_read(spark, d, "users"), ["id"], "arrived_at", "name").drop("arrived_at")


def messages(spark, d) -> DataFrame:
    return latest_delivery(_read(spark, d, "messages"), ["id"], "arrived_at", "author", "text", "reactions").drop("arrived_at")


def orders(spark, d) -> DataFrame:
    return _read(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string")).withColumn("customer", F.col("o_custkey").cast("string"))


def customers(spark, d) -> DataFrame:
    return _read(spark, d, "customer").withColumn("id", F.col("c_custkey").cast("string"))


def events(spark, d) -> DataFrame:
    return _read(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))


# reading


@checked("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = '42'")
def point_lookup(spark, d):
    return FrameRows(customers(spark, d).select("id", "c_name")).object_get("42")


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) >= '12' AND CAST(o_orderkey AS VARCHAR) < '2' ORDER BY id LIMIT 50")
def range_scan(spark, d):
    return FrameRows(orders(spark, d).select("id", "o_orderstatus")).range_get({"gte": "12", "lt": "2", "limit": 50})


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders ORDER BY id DESC LIMIT 10")
def range_last_k(spark, d):
    return FrameRows(orders(spark, d).select("id", "o_orderstatus")).range_get({"reverse": True, "limit": 10})


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '5' ORDER BY id LIMIT 20 OFFSET 30")
def range_offset(spark, d):
    return FrameRows(orders(spark, d).select("id", "o_orderstatus")).range_get(Range(gt="5", offset=30, limit=20))


@checked("SELECT id, name FROM (SELECT id, name FROM u) WHERE id > '10000500' ORDER BY id LIMIT 256")
def page(spark, d):
    return FrameRows(users(spark, d)).page("10000500")


@checked("SELECT count(*) AS n FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '3' AND CAST(o_orderkey AS VARCHAR) <= '7'")
def range_count(spark, d):
    return FrameRows(orders(spark, d)).count_get({"gt": "3", "lte": "7"})


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')")
def prefix_scan(spark, d):
    return FrameRows(orders(spark, d).select("id")).range_get(Range.prefix("12"))


@checked("SELECT min(id) AS first_id, max(id) AS last_id FROM m")
def boundary_ids(spark, d):
    return FrameRows(messages(spark, d)).boundary_ids()


@checked("SELECT id, name FROM u ORDER BY id LIMIT 1")
def single_first(spark, d):
    return FrameRows(users(spark, d)).range_get({"limit": 1})


# changes and indexes


@checked("SELECT concat(CAST(o_custkey AS VARCHAR), '_', CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderkey AS VARCHAR) AS to FROM orders".replace(" AS to ", ' AS "to" '))
def secondary_index(spark, d):
    return ChangeStream.of_rows(orders(spark, d)).map(lambda f: {"id": F.concat(f("customer"), F.lit("_"), f("id")), "to": f("id")}).rows()


@checked("""SELECT concat('"', event_type, '":', CAST(user_id AS VARCHAR), '_', CAST(event_id AS VARCHAR)) AS id, CAST(event_id AS VARCHAR) AS "to" FROM events""")
def index_by_json_key(spark, d):
    return ChangeStream.of_rows(events(spark, d)).index_by(lambda f: [f("event_type"), f("user_id")]).rows()


@checked("""SELECT concat(CASE WHEN author IS NULL THEN 'null' ELSE CAST(to_json(author) AS VARCHAR) END, '_', id) AS id, id AS "to" FROM m WHERE text <> ''""")
def index_partial(spark, d):
    """An index of messages that have a text, by author; a null author has the key null."""
    return ChangeStream.of_rows(messages(spark, d)).index_by(lambda f: f("author"), when=lambda f: f("text") != "").rows()


@checked("""SELECT concat('10000002_', id) AS id, text FROM m WHERE author = '10000002'""")
def index_deref(spark, d):
    """All messages of one author by a range of the index over authors."""
    rows = messages(spark, d)
    index = ChangeStream.of_rows(rows.filter("author is not null")).map(lambda f: {"id": F.concat(f("author"), F.lit("_"), f("id")), "to": f("id")}).rows()
    return dereference(Range.prefix("10000002_").filter(index), rows).select(F.col("index_id").alias("id"), "text")


_OP = """latest AS (SELECT store, id AS op_id, operation FROM op_log QUALIFY row_number() OVER (PARTITION BY store, id ORDER BY arrived_at DESC) = 1)"""


def _op_changes(spark, d) -> ChangeStream:
    """The operation logs of both stores as changes, whose ids begin with the store."""
    last = latest_delivery(_read(spark, d, "op_log"), ["store", "id"], "arrived_at", "operation")
    put = F.col("operation.op_type") == "put"
    kept = last.filter(F.col("operation.op_type").isin("put", "delete") & F.col("operation.obj.id").isNotNull())
    old = F.when(put, F.col("operation.old_obj")).otherwise(F.col("operation.obj"))
    return ChangeStream(kept.select(F.concat("store", F.lit("/"), "operation.obj.id").alias("id"), F.col("id").alias("seq"), F.when(put, F.col("operation.obj")).alias("obj"), old.alias("old")))


_CHANGES = f"""WITH {_OP}, c AS (SELECT concat(store, '/', operation.obj.id) AS id, op_id, operation.op_type AS op_type, CASE WHEN operation.op_type = 'put' THEN operation.obj END AS obj,
  CASE WHEN operation.op_type = 'put' THEN operation.old_obj ELSE operation.obj END AS old FROM latest WHERE operation.op_type IN ('put', 'delete') AND operation.obj.id IS NOT NULL)"""


@checked(f"""{_CHANGES} SELECT id, op_id, new_text, old_text FROM (SELECT id, op_id, CASE WHEN length(obj.text) > 20 THEN obj.text END AS new_text, CASE WHEN length(old.text) > 20 THEN old.text END AS old_text FROM c)
WHERE new_text IS NOT NULL OR old_text IS NOT NULL""")
def filter_changes(spark, d):
    """Changes of objects with a text of more than 20 characters: an update that crosses that becomes an insert or delete."""
    stream = _op_changes(spark, d).filter(lambda f: F.length(f("text")) > 20)
    return stream.changes.select("id", F.col("seq").alias("op_id"), F.col("obj.text").alias("new_text"), F.col("old.text").alias("old_text"))


@checked(f"""{_CHANGES}, k AS (SELECT op_id, CASE WHEN obj IS NOT NULL THEN concat(coalesce(CAST(to_json(coalesce(obj.name, obj.author)) AS VARCHAR), 'null'), '_', id) END AS a,
  CASE WHEN old IS NOT NULL THEN concat(coalesce(CAST(to_json(coalesce(old.name, old.author)) AS VARCHAR), 'null'), '_', id) END AS b FROM c)
SELECT op_id, a AS entry, 'put' AS what FROM k WHERE a IS NOT NULL AND a IS DISTINCT FROM b UNION ALL SELECT op_id, b, 'delete' FROM k WHERE b IS NOT NULL AND a IS DISTINCT FROM b""")
def index_changes(spark, d):
    """What the changes do to an index of users by name and messages by author."""
    entries = _op_changes(spark, d).index_by(lambda f: F.coalesce(f("name"), f("author"))).changes
    return entries.select(F.col("seq").alias("op_id"), F.col("id").alias("entry"), F.when(F.col("obj").isNotNull(), "put").otherwise("delete").alias("what"))


@checked(f"""{_CHANGES} SELECT id, obj.name AS name, obj.author AS author, obj.text AS text FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY op_id DESC) = 1) WHERE op_type = 'put'""")
def fold_changelog(spark, d):
    return fold(_op_changes(spark, d).changes).select("id", "obj.name", "obj.author", "obj.text")


@checked(f"""{_CHANGES}, f AS (SELECT id, max(obj) FILTER (WHERE hi = 1) AS obj, max(old) FILTER (WHERE lo = 1) AS old FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY op_id DESC) AS hi, row_number() OVER (PARTITION BY id ORDER BY op_id) AS lo FROM c) GROUP BY id)
SELECT id, obj.name AS new_name, old.name AS old_name, obj.text AS new_text, old.text AS old_text FROM f WHERE obj IS DISTINCT FROM old""")
def net_changes(spark, d):
    """One change for each object over the whole log."""
    return net(_op_changes(spark, d).changes).select("id", F.col("obj.name").alias("new_name"), F.col("old.name").alias("old_name"), F.col("obj.text").alias("new_text"), F.col("old.text").alias("old_text"))


@checked("SELECT id, arg_max(v, src) AS v FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS v, 1 AS src FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 2 FROM supplier) GROUP BY id")
def union_last_wins(spark, d):
    a = customers(spark, d).select("id", F.col("c_name").alias("v"))
    b = _read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("v"))
    return ChangeStream.of_rows(a, seq=F.lit("1")).union(ChangeStream.of_rows(b, seq=F.lit("2"))).rows()


@checked("SELECT id, name || '!' AS name FROM u")
def pipe_fan_out(spark, d):
    """Changes put into a pipe reach each subscriber, here one that maps them."""
    pipe, got = Pipe(), []
    pipe.on_change(lambda c: got.append(c.map(lambda f: {"id": f("id"), "name": F.concat(f("name"), F.lit("!"))}).rows()))
    pipe.change(ChangeStream.of_rows(users(spark, d)))
    return got[0]


# joins


@checked("SELECT m.id, m.author, u.id AS user_id, u.name AS user_name FROM m LEFT JOIN u ON u.id = m.author")
def lookup(spark, d):
    out = lookup_join(messages(spark, d).select("id", "author"), users(spark, d), "author", "user")
    return out.select("id", "author", F.col("user.id").alias("user_id"), F.col("user.name").alias("user_name"))


@checked("SELECT m.id, u.name AS user_name FROM m JOIN u ON u.id = m.author")
def lookup_inner(spark, d):
    return inner_lookup(messages(spark, d), users(spark, d), "author", "user").select("id", F.col("user.name").alias("user_name"))


@checked("SELECT id, author FROM m WHERE author IN (SELECT id FROM u)")
def lookup_semi(spark, d):
    return having(messages(spark, d), users(spark, d), "author").select("id", "author")


@checked("SELECT id, author FROM m WHERE author IS NULL OR author NOT IN (SELECT id FROM u)")
def lookup_anti(spark, d):
    return lacking(messages(spark, d), users(spark, d), "author").select("id", "author")


@checked("""SELECT e.event_id, s.s_suppkey FROM events e JOIN supplier s ON e.event_id >= s.s_suppkey * 100 AND e.event_id < s.s_suppkey * 100 + 250""")
def range_join(spark, d):
    spans = _read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 100).alias("lo"), (F.col("s_suppkey") * 100 + 250).alias("hi"))
    return range_lookup(_read(spark, d, "events").select("event_id"), spans, "event_id", "lo", "hi", 250).select("event_id", "s_suppkey")


# aggregates, each through the engine's groups


def _grouped(df: DataFrame, key: str, aggregates: dict) -> DataFrame:
    return Group(Rows(df), key, aggregates).rows()


@checked("SELECT event_type AS id, count(*) AS cnt, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(value) AS mx, min(value) AS mn FROM events GROUP BY event_type")
def agg_add_max_min(spark, d):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return _grouped(events(spark, d), "event_type", {"cnt": F.count("*"), "cents": F.sum(cents), "mx": F.max("value"), "mn": F.min("value")})


@checked("SELECT CAST(user_id AS VARCHAR) AS id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def agg_add_to_set(spark, d):
    return _grouped(events(spark, d), "user_id", {"types": F.array_join(F.array_sort(F.collect_set("event_type")), ",")})


@checked("SELECT author AS id, array_to_string(list_sort(list(DISTINCT r)), ',') AS reactions FROM (SELECT author, unnest(reactions) AS r FROM m) WHERE r IS NOT NULL AND author IS NOT NULL GROUP BY author")
def agg_merge_sets(spark, d):
    """The union of the reactions of each author's messages, elements told apart before the shuffle."""
    each = Rows(messages(spark, d)).flat_map(lambda f: F.transform(F.array_distinct(F.filter(f("reactions"), lambda r: r.isNotNull())), lambda r: F.struct(F.concat_ws("_", f("id"), r).alias("id"), f("author").alias("author"), r.alias("r"))))
    return Group(each, "author", {"reactions": F.array_join(F.array_sort(F.collect_set("r")), ",")}).rows()


@checked("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def latest_state(spark, d):
    return _grouped(events(spark, d), "user_id", {"last_type": F.max_by("event_type", "event_id"), "last_id": F.max("event_id")})


@checked("SELECT CAST(user_id AS VARCHAR) AS id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def first_state(spark, d):
    return _grouped(events(spark, d), "user_id", {"first_type": F.min_by("event_type", "event_id")})


@checked("SELECT CAST(user_id AS VARCHAR) AS id, CAST(sum(CASE WHEN event_type = 'purchase' AND value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM events GROUP BY user_id")
def agg_conditional(spark, d):
    big = F.when((F.col("event_type") == "purchase") & (F.col("value") >= 50), 1).otherwise(0)
    return _grouped(events(spark, d), "user_id", {"big": F.sum(big).cast("bigint")})


@checked("SELECT id, name FROM u")
def distinct_by_id(spark, d):
    return users(spark, d)


# updates of documents


def _updated(df: DataFrame, operations: list[dict], legacy: bool = False) -> DataFrame:
    return df.select(compile_update(df.schema, operations, legacy=legacy).alias("doc")).select("doc.*")


@checked("SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(c_acctbal, 0) + 10 AS a, greatest(c_acctbal, 0) AS mx, least(c_acctbal, 100) AS mn FROM customer")
def mut_add_max_min(spark, d):
    df = customers(spark, d).select("id", *[F.col("c_acctbal").alias(c) for c in ("a", "mx", "mn")])
    return _updated(df, [{"op": "add", "property": "a", "value": 10}, {"op": "max", "property": "mx", "value": 0}, {"op": "min", "property": "mn", "value": 100}])


@checked("SELECT CAST(c_custkey AS VARCHAR) AS id, greatest(nullif(c_acctbal, 0), 0) AS mx, least(nullif(c_acctbal, 0), 100) AS mn FROM customer")
def mut_max_min_legacy(spark, d):
    df = customers(spark, d).select("id", *[F.col("c_acctbal").alias(c) for c in ("mx", "mn")])
    return _updated(df, [{"op": "max", "property": "mx", "value": 0}, {"op": "min", "property": "mn", "value": 100}], legacy=True)


_SET_OPS = """SELECT id, array_to_string(list_transform(list_append(list_filter(r, lambda e: e IS DISTINCT FROM 'wow'), 'wow'), lambda e: coalesce(e, '-')), ',') AS added,
array_to_string(list_transform(list_filter(r, lambda e: e IS DISTINCT FROM 'wow'), lambda e: coalesce(e, '-')), ',') AS removed,
array_to_string(list_sort(list_distinct(list_concat(['new', 'wow'], r))), ',') AS merged, CAST(list_count(r) < len(r) AS INTEGER) AS nulls
FROM (SELECT id, coalesce(reactions, []) AS r FROM m)"""


def _set_ops(spark, d, argument):
    """addToSet, deleteFromSet and mergeSets on arrays as they are, with nulls and repeats."""
    df = messages(spark, d).select("id", *[F.col("reactions").alias(c) for c in ("added", "removed", "merged")])
    ops = [{"op": "addToSet", "property": "added", "value": "wow"}, {"op": "deleteFromSet", "property": "removed", "value": "wow"}, {"op": "mergeSets", "property": "merged", argument: ["new", "wow"]}]
    out, shown = _updated(df, ops), lambda c: F.array_join(c, ",", "-").alias(c)
    return out.select("id", shown("added"), shown("removed"), F.array_join(F.array_sort(F.filter("merged", lambda x: x.isNotNull())), ",").alias("merged"), F.exists("merged", lambda x: x.isNull()).cast("int").alias("nulls"))


@checked(_SET_OPS)
def mut_sets(spark, d):
    return _set_ops(spark, d, "value")


@checked(_SET_OPS)
def mut_merge_sets_values(spark, d):
    return _set_ops(spark, d, "values")


@checked("""SELECT CAST(c_custkey AS VARCHAR) AS id, concat_ws(',', CASE WHEN c_acctbal >= 5000 THEN 'gte' END, CASE WHEN c_acctbal < 1000 THEN 'lt' END, CASE WHEN c_acctbal <= 0 THEN 'lte' END) AS said FROM customer""")
def mut_comparisons(spark, d):
    df = customers(spark, d).select("id", F.col("c_acctbal").alias("n"))
    ops = [{"op": "conditional", "conditions": [{"test": t, "property": "n", "value": v}], "operations": [{"op": "set", "property": t, "value": t}]} for t, v in (("gte", 5000), ("lt", 1000), ("lte", 0))]
    return _updated(df, ops).select("id", F.concat_ws(",", "gte", "lt", "lte").alias("said"))


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_orderstatus, CASE WHEN coalesce(o_totalprice > 200000, false) AND o_orderstatus = 'O' THEN 'vip' ELSE o_orderpriority END AS pr FROM orders")
def mut_conditional(spark, d):
    df = orders(spark, d).select("id", "o_totalprice", "o_orderstatus", F.col("o_orderpriority").alias("pr"))
    when = [{"test": "gt", "property": "o_totalprice", "value": 200000}, {"test": "eq", "property": "o_orderstatus", "value": "O"}]
    return _updated(df, [{"op": "conditional", "conditions": when, "operations": [{"op": "set", "property": "pr", "value": "vip"}]}])


@checked("SELECT id, CASE WHEN author IS NULL THEN 'nobody' ELSE author END AS author, CASE WHEN author IS NOT NULL AND length(text) = 0 THEN NULL ELSE text END AS text, 'new' AS state FROM m")
def mut_tests(spark, d):
    """notExist, exist and eq, set and delete in conditionals."""
    df = messages(spark, d).select("id", "author", "text")
    return _updated(df, [
        {"op": "conditional", "conditions": [{"test": "exist", "property": "author"}, {"test": "eq", "property": "text", "value": ""}], "operations": [{"op": "delete", "property": "text"}]},
        {"op": "conditional", "conditions": [{"test": "notExist", "property": "author"}], "operations": [{"op": "set", "property": "author", "value": "nobody"}]},
        {"op": "set", "property": "state", "value": "new"},
    ])


@checked("""SELECT id, coalesce(name, 'nobody') AS name, coalesce(name, 'y') AS home_city, 5 AS home_floor, CASE WHEN length(name) > 8 THEN length(name) ELSE 7 END AS home_size, 1 AS seen FROM u""")
def mut_merge(spark, d):
    """merge of an object into the whole document and into a path, reverseMerge that fills only what's missing."""
    size = F.when(F.length("name") > 8, F.length("name"))
    df = users(spark, d).withColumn("home", F.struct(F.col("name").alias("city"), F.lit(2).alias("floor"), size.alias("size")))
    out = _updated(df, [
        {"op": "merge", "value": {"seen": 1}}, {"op": "merge", "property": "home", "value": {"floor": 5}},
        {"op": "reverseMerge", "value": {"name": "nobody", "home": {"city": "y", "size": 7}}},
    ])
    return out.select("id", "name", *[F.col(f"home.{c}").alias(f"home_{c}") for c in ("city", "floor", "size")], "seen")


# functions


@checked("SELECT CAST(c_custkey AS VARCHAR) AS id, sha1(c_name) AS h1, sha256(c_name) AS h2 FROM customer")
def hashes(spark, d):
    return customers(spark, d).select("id", sha1(F.col("c_name")).alias("h1"), sha256(F.col("c_name")).alias("h2"))


@checked("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_paths(spark, d):
    return events(spark, d).select("event_id", json_path(F.col("props"), "k").cast("bigint").alias("k"))


@checked("""SELECT concat(lpad(CAST(ms AS VARCHAR), 16, '0'), ':', lpad(CAST(n AS VARCHAR), 6, '0')) AS id, event_id FROM (
  SELECT epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS n, event_id FROM events)""")
def log_seq_ids(spark, d):
    return with_sequence_ids(_read(spark, d, "events"), F.unix_millis(F.col("ts").cast("timestamp")), ["event_id"]).select("id", "event_id")


# the database itself, in a folder of its own


def _database(spark) -> Database:
    return Database(spark, work_path(spark, "database"))


@checked("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END AS balance FROM customer WHERE NOT c_acctbal < 0""")
def table_writes(spark, d):
    """Upsert all customers, again without effect, update some in place, delete those in debt."""
    table = _database(spark).create_table("customers", "id string, name string, balance double")
    rows = customers(spark, d).select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    table.put(rows)
    table.put(rows)
    table.delete(rows.filter("balance < 0"))
    table.update(rows.filter("c_mktsegment = 'BUILDING'"), [{"op": "add", "property": "balance", "value": 10}], if_exists=True)
    return table.rows()


@checked("""SELECT * FROM (SELECT 'put' AS op, count(*) AS n, 0 AS with_old FROM customer UNION ALL SELECT 'delete', count(*), count(*) FROM customer WHERE c_acctbal < 0)""")
def table_operations(spark, d):
    """The operations that puts, a repeated put and deletes leave in the log."""
    table = _database(spark).create_table("customers", "id string, balance double")
    rows = customers(spark, d).select("id", F.col("c_acctbal").alias("balance"))
    table.put(rows)
    table.put(rows)
    table.delete(rows.filter("balance < 0"))
    return table.changelog.records().groupBy("op").agg(F.count("*").alias("n"), F.count(F.col("old.id")).cast("int").alias("with_old"))


@checked("""SELECT id, arg_max(author, 1) AS author FROM m WHERE id >= '500000' GROUP BY id""")
def table_compacted(spark, d):
    """Rows after the operation log is compacted and its old versions, all but the last, removed."""
    table = _database(spark).create_table("messages", "id string, author string")
    rows = messages(spark, d).select("id", "author")
    table.put(rows.select("id", F.lit("first").alias("author")))  # a version that is sure to be an old one, whatever the delete finds
    table.put(rows)
    table.delete(rows.filter("id < '500000'"))
    table.clear_oplog(int(time.time() * 1000))
    table.changelog.compact()
    return table.rows()


@checked("""SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS n, event_id, value FROM events""")
def log_appends(spark, d):
    """Events appended in order: the counters in their ids."""
    log = _database(spark).create_log("events", "event_id bigint, value double")
    log.put(_read(spark, d, "events").select("event_id", "value"), ["event_id"])
    return log.rows().select(F.split("id", ":")[1].cast("bigint").alias("n"), "event_id", "value")


def _join(input, output, params=None):
    input.table("orders").lookup(input.table("customers"), "customer", "buyer").to(output)


def _shop(spark, d) -> Database:
    db = _database(spark)
    db.create_table("customers", "id string, name string, balance double").put(customers(spark, d).select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    db.create_table("orders", "id string, customer string, price double").put(orders(spark, d).select("id", "customer", F.col("o_totalprice").alias("price")))
    return db


def _mutate(db: Database) -> None:
    people = db.table("customers").rows()
    db.table("customers").delete(people.filter("balance < 0"))
    db.table("customers").update(people.filter("balance > 9000"), [{"op": "set", "property": "name", "value": "rich"}])
    db.table("orders").delete(db.table("orders").rows().filter("price < 20000"))


_SHOP = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal > 9000 THEN 'rich' ELSE c_name END AS name, c_acctbal FROM customer WHERE NOT c_acctbal < 0),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer, o_totalprice AS price FROM orders WHERE NOT o_totalprice < 20000) """


@checked(_SHOP + "SELECT o.id, o.customer, o.price, c.id AS buyer_id, c.name AS buyer_name FROM o LEFT JOIN c ON c.id = o.customer")
def index_join(spark, d):
    """A join index, built, then updated from changes of both sides."""
    db = _shop(spark, d)
    index = db.create_index("orders_with_customers", _join)
    _mutate(db)
    index.update()
    return index.rows().select("id", "customer", "price", F.col("buyer.id").alias("buyer_id"), F.col("buyer.name").alias("buyer_name"))


def _totals(input, output, params=None):
    output.update(input.table("orders"), "customer", {"n": F.count("*"), "most": F.max("price"), "least": F.min("price")})


@checked(_SHOP + "SELECT customer AS id, count(*) AS n, max(price) AS most, min(price) AS least FROM o GROUP BY customer")
def index_aggregate(spark, d):
    """An index of aggregates, whose maxima and minima shrink as orders are deleted."""
    db = _shop(spark, d)
    index = db.create_index("totals", _totals)
    _mutate(db)
    index.update()
    return index.rows()


@checked(_SHOP + "SELECT o.id, c.name AS buyer_name FROM o LEFT JOIN c ON c.id = o.customer WHERE o.price > 300000")
def live_join(spark, d):
    """The join of all orders, kept live as a table by a stream over the logs of both sides, and the dearest orders of it; no rows come to the driver.

    A live list (``query_observable``) of the same query is an error above its ``most`` rows, and this has no observers.
    """
    db = _shop(spark, d)
    live = db.create_index("orders_with_customers", _join)
    _mutate(db)
    live.start(once=True).awaitTermination()
    return live.rows().filter("price > 300000").select("id", F.col("buyer.name").alias("buyer_name"))


@checked(_SHOP + "SELECT o.id, concat(o.customer, '_', o.id) AS entry, c.name AS buyer FROM o JOIN c ON c.id = o.customer")
def query_get(spark, d):
    """A one-shot query over tables: filter, map and a lookup."""
    db = _shop(spark, d)
    _mutate(db)

    def code(input, output):
        found = input.table("orders").lookup(input.table("customers"), "customer", "buyer").filter(lambda f: f("buyer").isNotNull())
        found.map(lambda f: {"id": f("id"), "entry": F.concat(f("customer"), F.lit("_"), f("id")), "buyer": f("buyer").getField("name")}).to(output)

    return db.query_get(code)


@checked("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'x,y' AS tags FROM orders")
def query_update(spark, d):
    """An update query that merges an array into every order."""
    db = _database(spark)
    db.create_table("orders", "id string, tags array<string>").put(orders(spark, d).select("id"))
    db.query_update(lambda input, output: output.table("orders").update(input.table("orders").get(), [{"op": "merge", "value": {"tags": ["x", "y"]}}]))
    return db.table("orders").rows().select("id", F.array_join("tags", ",").alias("tags"))
