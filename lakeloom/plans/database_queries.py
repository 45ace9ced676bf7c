"""Queries of the database: its entry points, sources, writers, catalog, streams and live results, each with the SQL that checks it."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.store_queries import _database, _read, checked, customers, events, orders
from lakeloom.session import work_path
from lakeloom.sources.database import Database
from lakeloom.streaming.follow import follow
from lakeloom.streaming.live import LiveCount, live_object, live_range
from lakeloom.streaming.profiler import Profiler


def _people(spark: SparkSession, d: str, db: Database | None = None) -> Database:
    db = db or _database(spark)
    db.create_table("people", "id string, name string, balance double").put(customers(spark, d).select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    return db


def _nations(spark: SparkSession, d: str, db: Database | None = None) -> Database:
    """A table of the 25 nations, for what brings its rows to the driver."""
    db = db or _database(spark)
    rows = _read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    db.create_table("nations", rows.schema).put(rows)
    return db


_PEOPLE = "p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance FROM customer)"
_NATIONS = "n AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation)"


def by_name(input, output, params=None):
    input.table("people").map(lambda f: {"id": F.concat(f("name"), F.lit("_"), f("id")), "to": f("id")}).to(output)


def in_debt(input, output, params=None):
    input.table("people").filter(lambda f: f("balance") < 0).to(output)


# entry points and sources


@checked(f"WITH {_PEOPLE} SELECT id, name FROM p WHERE balance < 0 ORDER BY id LIMIT 1")
def query_object_get(spark, d):
    return _people(spark, d).query_object_get(in_debt).select("id", "name")


@checked(f"WITH {_PEOPLE} SELECT id, name FROM p WHERE id = '17'")
def query_point_source(spark, d):
    return _people(spark, d).query_get(lambda i, o: i.table("people").object("17").to(o)).select("id", "name")


@checked(f"WITH {_PEOPLE} SELECT id, name FROM p WHERE id >= '12' AND id < '3'")
def query_range_source(spark, d):
    return _people(spark, d).query_get(lambda i, o: i.table("people").of_range({"gte": "12", "lt": "3"}).to(o)).select("id", "name")


@checked("SELECT event_id, value FROM events WHERE value > 50")
def query_log_source(spark, d):
    db = _database(spark)
    db.create_log("events", "event_id bigint, value double").put(_read(spark, d, "events").select("event_id", "value"))
    return db.query_get(lambda i, o: i.log("events").filter(lambda f: f("value") > 50).to(o)).select("event_id", "value")


def _some_names(input, output, params):
    input.index("by_name").filter(lambda f: f("id") < params["upto"]).to(output)


@checked(f"""WITH {_PEOPLE} SELECT concat(name, '_', id) AS id, id AS "to" FROM p WHERE NOT balance < 0 AND name < 'Customer#000000100'""")
def query_index_source(spark, d):
    """An index over an index, brought up to date in the order in which they depend on each other."""
    db = _people(spark, d)
    db.create_index("by_name", by_name)
    db.create_index("some", _some_names, {"upto": "Customer#000000100"})
    db.table("people").delete(db.table("people").rows().filter("balance < 0"))
    db.update_indexes()
    return db.index("some").rows()


@checked(f"WITH {_PEOPLE} SELECT 'n' AS id, count(*) AS n FROM p WHERE id > '5' UNION ALL SELECT '17', count(*) FROM p WHERE id = '17'")
def query_reader_count_and_get(spark, d):
    def code(input, output):
        people = input.table("people")
        output.put(people.count({"gt": "5"}).select(F.lit("n").alias("id"), "n"))
        output.put(people.get({"gte": "17", "lte": "17"}).groupBy("id").agg(F.count("*").alias("n")))

    return _people(spark, d).query_get(code)


@checked(f"""WITH {_PEOPLE} SELECT id, CASE WHEN balance > 9000 THEN 'rich' ELSE name END AS name FROM p WHERE NOT balance < 0
UNION ALL SELECT 'copy', name FROM p WHERE id = '1' AND NOT balance < 0 AND NOT balance > 9000 UNION ALL SELECT 'copy', 'rich' FROM p WHERE id = '1' AND balance > 9000""")
def query_output(spark, d):
    """Rows put, put again and deleted in one query, and one read back from the result so far."""
    db = _people(spark, d)

    def code(input, output):
        people = input.table("people").get()
        output.put(people.select("id", "name"))
        output.put(people.filter("balance > 9000").select("id", F.lit("rich").alias("name")))
        output.delete(people.filter("balance < 0"))
        output.put(output.get("1").select(F.lit("copy").alias("id"), "name"))

    return db.query_get(code)


@checked("SELECT concat(w, '_', CAST(p_partkey AS VARCHAR)) AS id, w AS word FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) WHERE w <> ''")
def query_flat_map(spark, d):
    db = _database(spark)
    db.create_table("parts", "id string, name string").put(_read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")))

    def words(f):
        return F.transform(F.array_distinct(F.filter(F.split(f("name"), " "), lambda w: w != "")), lambda w: F.struct(F.concat(w, F.lit("_"), f("id")).alias("id"), w.alias("word")))

    return db.query_get(lambda i, o: i.table("parts").flat_map(words).to(o))


# unions


def either(input, output, params=None):
    input.table("people").map(lambda f: {"id": f("id"), "name": f("name")}).to(output)
    input.table("suppliers").to(output)


_EITHER = f"""WITH {_PEOPLE}, a AS (SELECT id, CASE WHEN balance > 9000 THEN 'rich' ELSE name END AS name FROM p WHERE NOT balance < 0),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 1 THEN 'three' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT id, name FROM b UNION ALL SELECT id, name FROM a WHERE id NOT IN (SELECT id FROM b)"""


def _either(spark, d) -> tuple[Database, list]:
    db = _people(spark, d)
    rows = _read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    db.create_table("suppliers", "id string, name string").put(rows)
    people, suppliers = db.table("people"), db.table("suppliers")
    return db, [
        lambda: people.delete(people.rows().filter("balance < 0")), lambda: suppliers.delete(rows.filter("cast(id as int) % 5 = 0")),
        lambda: people.update(people.rows().filter("balance > 9000"), [{"op": "set", "property": "name", "value": "rich"}]),
        lambda: suppliers.put(rows.filter("cast(id as int) % 5 != 0 and cast(id as int) % 3 = 1").withColumn("name", F.lit("three"))),
    ]


@checked(_EITHER)
def index_union(spark, d):
    """An index of two tables with ids in common, kept up to date through changes and deletes on both sides."""
    db, steps = _either(spark, d)
    index = db.create_index("either", either)
    for step in steps:
        step()
        index.update()
    return index.rows()


def _named(input, output, params=None):
    input.table("nations").map(lambda f: {"id": f("id"), "name": f("name")}).to(output)
    input.table("regions").to(output)


@checked(f"""WITH {_NATIONS}, r AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region WHERE r_regionkey <> 2)
SELECT id, name FROM r UNION ALL SELECT id, CASE WHEN region = '1' THEN 'one' ELSE name END FROM n WHERE id NOT IN (SELECT id FROM r) AND region <> '3'""")
def live_union(spark, d):
    """The same through a live list."""
    db = _nations(spark, d)
    rows = _read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    db.create_table("regions", "id string, name string").put(rows)
    live, nations = db.query_observable(_named), db.table("nations")
    db.table("regions").delete(rows.filter("id = '2'"))
    live.update()
    nations.delete(nations.rows().filter("region = '3'"))
    nations.update(nations.rows().filter("region = '1'"), [{"op": "set", "property": "name", "value": "one"}])
    live.update()
    return spark.createDataFrame(live.value(), "id string, name string")


def _people_and_more(input, output, params=None):
    input.table("people").to(output)
    output.put(input.table("people").get({"gte": "1", "lte": "1"}).withColumn("id", F.lit("extra")))
    output.delete(input.table("people").get().filter("balance > 9000"))


@checked(f"WITH {_PEOPLE}, k AS (SELECT * FROM p WHERE NOT balance < 0) SELECT id, name FROM k WHERE NOT balance > 9000 UNION ALL SELECT 'extra', name FROM k WHERE id = '1'")
def index_put_and_delete(spark, d):
    """An index of a stream with rows put and deleted beside it."""
    db = _people(spark, d)
    index = db.create_index("more", _people_and_more)
    db.table("people").delete(db.table("people").rows().filter("balance < 0"))
    index.update()
    return index.rows().select("id", "name")


# live results


@checked(f"WITH {_NATIONS} SELECT id, 'renamed' AS name, 2 AS told FROM n WHERE id = '7'")
def live_point(spark, d):
    """A live object through a change of another row, of its own, and its observers' signals."""
    db, told = _nations(spark, d), []
    one = live_object(db, "nations", "7")
    one.observe(lambda *signal: told.append(signal))
    for key, name in (("8", "other"), ("7", "renamed")):
        db.table("nations").update(spark.createDataFrame([(key,)], "id string"), [{"op": "set", "property": "name", "value": name}])
        one.update()
    return spark.createDataFrame([(one.first().id, one.first().name, len(told))], "id string, name string, told int")


@checked(f"WITH {_NATIONS} SELECT id, CASE WHEN region = '2' THEN 'two' ELSE name END AS name FROM n WHERE id >= '1' AND id < '3' AND region <> '0'")
def live_ranges(spark, d):
    db = _nations(spark, d)
    some, nations = live_range(db, "nations", {"gte": "1", "lt": "3"}), db.table("nations")
    nations.delete(nations.rows().filter("region = '0'"))
    some.update()
    nations.update(nations.rows().filter("region = '2'"), [{"op": "set", "property": "name", "value": "two"}])
    some.update()
    return spark.createDataFrame(some.value(), "id string, name string, region string").select("id", "name")


@checked("SELECT count(*) AS n FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '3' AND NOT o_totalprice < 50000")
def live_count(spark, d):
    """The number of orders in a range, kept from inserts and deletes; only counts come to the driver."""
    db = _database(spark)
    table = db.create_table("orders", "id string, price double")
    rows = orders(spark, d).select("id", F.col("o_totalprice").alias("price"))
    table.put(rows.filter("price >= 20000"))
    n = LiveCount(table, {"gt": "3"})
    table.put(rows)
    n.update()
    table.delete(rows.filter("price < 50000"))
    return spark.createDataFrame([(n.update(),)], "n long")


@checked(f"WITH {_NATIONS} SELECT id, name FROM n WHERE region <> '0' ORDER BY id LIMIT 1")
def live_first(spark, d):
    """A live single result that falls back to the next row, also after it was disposed and respawned."""
    db = _nations(spark, d)
    first, nations = db.query_object_observable(lambda i, o: i.table("nations").to(o)), db.table("nations")
    first.dispose()
    nations.delete(nations.rows().filter("region = '0'"))
    first.respawn()
    return spark.createDataFrame([(first.first().id, first.first().name)], "id string, name string")


# writers


@checked(f"WITH {_PEOPLE} SELECT id, 6 AS n FROM p")
def concurrent_updates(spark, d):
    """Two writers add to the same documents at the same time, three times each; no addition is lost."""
    db = _database(spark)
    rows = customers(spark, d).select("id", F.lit(0).alias("n"))
    db.create_table("counts", "id string, n int").put(rows)
    handles = [Database(spark, db.root).table("counts") for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda h: [h.update(rows.select("id"), [{"op": "add", "property": "n", "value": 1}]) for _ in range(3)], handles))
    return db.table("counts").rows()


@checked("SELECT concat('old:', CAST(event_id AS VARCHAR)) AS id, value FROM events UNION ALL SELECT 'new', value FROM events WHERE event_id = (SELECT min(event_id) FROM events)")
def log_replay(spark, d):
    """Rows appended with ids of their own, then one with an id of the log's."""
    log = _database(spark).create_log("events", "value double")
    rows = events(spark, d)
    log.put_old(rows.select(F.concat(F.lit("old:"), "id").alias("id"), "value"))
    log.put(rows.orderBy("event_id").limit(1).select("value"))
    return log.rows().select(F.when(F.col("id").startswith("old:"), F.col("id")).otherwise("new").alias("id"), "value")


@checked("""WITH r AS (SELECT l_orderkey, l_linenumber, k, row_number() OVER (ORDER BY l_orderkey, l_linenumber, k) - 1 AS n FROM lineitem, (SELECT unnest(range(20)) AS k)),
e AS (SELECT n // 1000000 AS later_ms, min(n % 1000000) AS first_n, max(n % 1000000) AS last_n, count(*) AS cnt, arg_min(struct_pack(a := l_orderkey, b := l_linenumber, c := k), n) AS lo, arg_max(struct_pack(a := l_orderkey, b := l_linenumber, c := k), n) AS hi FROM r GROUP BY 1)
SELECT later_ms, first_n, last_n, cnt, lo.a AS lo_l_orderkey, lo.b AS lo_l_linenumber, lo.c AS lo_k, hi.a AS hi_l_orderkey, hi.b AS hi_l_linenumber, hi.c AS hi_k FROM e""")
def log_appends_large(spark, d):
    """Twenty copies of all line items in one put: more than a million share their ids among several milliseconds, in order."""
    log = _database(spark).create_log("lines", "k bigint, l_orderkey bigint, l_linenumber int")
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    log.put(rows, ["l_orderkey", "l_linenumber", "k"])
    appended = log.rows().select("timestamp", F.split("id", ":")[1].cast("bigint").alias("n"), "l_orderkey", "l_linenumber", "k")
    start = appended.agg(F.min("timestamp")).first()[0]
    # whether the order of the ids is that of the rows shows in the least and greatest row of each millisecond
    by = appended.groupBy((F.col("timestamp") - start).alias("later_ms"))
    ends = by.agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count("*").alias("cnt"), F.min(F.struct("l_orderkey", "l_linenumber", "k")).alias("lo"), F.max(F.struct("l_orderkey", "l_linenumber", "k")).alias("hi"))
    return ends.select("later_ms", "first_n", "last_n", "cnt", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in ("l_orderkey", "l_linenumber", "k")])


@checked(f"""WITH {_PEOPLE} SELECT * FROM (SELECT 'people' AS name, 'clearOpLog' AS op, 1 AS n UNION ALL SELECT 'people', 'delete', count(*) FROM p WHERE balance < 0
UNION ALL SELECT 'by_name', 'delete', count(*) FROM p WHERE balance < 0 UNION ALL SELECT 'by_name', 'clearOpLog', 1)""")
def oplogs_cleared(spark, d):
    """What the operation logs of all tables and indexes hold once all but their last versions are cleared: those and a marker."""
    db = _people(spark, d)
    index = db.create_index("by_name", by_name)
    db.table("people").delete(db.table("people").rows().filter("balance < 0"))
    index.update()
    time.sleep(0.01)
    db.clear_oplogs(int(time.time() * 1000))
    logs = [(n, db.open(k, n).changelog) for k, n in (("table", "people"), ("index", "by_name"))]
    return logs[0][1].records().select(F.lit("people").alias("name"), "op").unionByName(logs[1][1].records().select(F.lit("by_name").alias("name"), "op")).groupBy("name", "op").agg(F.count("*").alias("n"))


# catalog, starting and failing


def broken(input, output, params=None):
    input.table("people").filter(lambda f: F.raise_error(F.lit("broken")).isNotNull()).to(output)


@checked("SELECT * FROM (VALUES ('table', 'folk', 'ready', 3), ('table', 'nations', 'ready', 3), ('index', 'by_name', 'ready', 3)) t(kind, name, status, uids)")
def catalog_changes(spark, d):
    """Collections created through two handles, renamed and deleted, as a third handle sees them."""
    db = _people(spark, d)
    _nations(spark, d, Database(spark, db.root))
    db.create_log("gone", "x int")
    db.create_index("by_name", by_name)
    db.rename("table", "people", "folk")
    db.delete("log", "gone")
    catalog = Database(spark, db.root).catalog()
    return catalog.select("kind", "name", "status", F.lit(catalog.select("uid").distinct().count()).alias("uids"))


@checked(f"""WITH {_PEOPLE} SELECT 'failed' AS status, count(*) AS n FROM p WHERE NOT balance < 0""")
def index_failure(spark, d):
    """An index that fails is marked, the others go on."""
    db = _people(spark, d)
    index = db.create_index("by_name", by_name)
    try:
        db.create_index("broken", broken)
    except Exception:
        pass
    db.table("people").delete(db.table("people").rows().filter("balance < 0"))
    db.update_indexes()
    return index.rows().agg(F.count("*").alias("n")).withColumn("status", F.lit(db.config("index", "broken")["status"][:6]))


@checked(f"""WITH {_PEOPLE} SELECT concat(CASE WHEN balance > 9000 THEN 'rich' ELSE name END, '_', id) AS id, id AS "to" FROM p WHERE NOT balance < 0""")
def database_start(spark, d):
    """A database opened anew starts its indexes, which follow the logs of their tables until they're stopped."""
    db = _people(spark, d)
    db.create_index("by_name", by_name)
    again = Database(spark, db.root)
    again.start()
    people = db.table("people")
    people.delete(people.rows().filter("balance < 0"))
    people.update(people.rows().filter("balance > 9000"), [{"op": "set", "property": "name", "value": "rich"}])
    index = again.index("by_name")
    while index.as_of()[people.changelog.path] < people.changelog.version():
        if not index.query.isActive:
            raise RuntimeError(f"the index stopped: {index.query.exception()}")
        time.sleep(0.1)
    index.stop()
    return index.rows()


@checked(f"""WITH {_PEOPLE} SELECT id, name, 3 AS versions FROM p WHERE balance < 0 AND id <> '17'""")
def index_restart(spark, d):
    """An index goes on where it was after a restart, after an update that failed before it was published, and when it's repeated."""
    db = _people(spark, d)
    index = db.create_index("in_debt", in_debt)
    people = db.table("people")
    people.delete(spark.createDataFrame([("17",)], "id string"))
    people.put(people.rows().limit(1).select(F.lit("new").alias("id"), "name", F.lit(-1.0).alias("balance")))
    append = index.changelog.append

    def fail(*_args, **_kw):
        raise OSError("lost")

    index.changelog.append = fail
    try:
        index.update()
    except OSError:
        index.changelog.append = append
    again = Database(spark, db.root)
    again.index("in_debt").update()
    people.delete(spark.createDataFrame([("new",)], "id string"))
    again.index("in_debt").update()
    again.index("in_debt").update()
    return index.rows().select("id", "name", F.lit(index.changelog.version()).alias("versions"))


@checked(f"""WITH {_PEOPLE} SELECT * FROM (SELECT 'put' AS op, count(*) AS n FROM p UNION ALL SELECT 'delete', count(*) FROM p WHERE balance < 0 UNION ALL SELECT 'put again', count(*) FROM p WHERE balance < 0)""")
def oplog_tail(spark, d):
    """A stream that follows the operation log of a table and copies every operation once, in batches, into a log."""
    db = _people(spark, d)
    people, seen, upto = db.table("people"), db.create_log("seen", "what string, n bigint"), [0]
    checkpoint = work_path(spark, "tail")

    def copy():
        now = people.changelog.version()
        new = people.changelog.records(upto[0], now)
        again = F.when(F.col("op") == "put", F.when(F.lit(upto[0] > 0), "put again").otherwise("put")).otherwise("delete")
        seen.put(new.groupBy(again.alias("what")).agg(F.count("*").alias("n")))
        upto[0] = now

    follow(spark, [people.changelog], copy, checkpoint, once=True).awaitTermination()
    people.delete(people.rows().filter("balance < 0"))
    people.put(people.changelog.records().filter("op = 'delete'").select("old.*"))
    follow(spark, [people.changelog], copy, checkpoint, once=True).awaitTermination()
    return seen.rows().groupBy(F.col("what").alias("op")).agg(F.sum("n").alias("n"))


@checked("SELECT * FROM (VALUES ('begin', 3), ('end', 3), ('log', 1)) t(type, n)")
def profiled_operations(spark, d):
    """The profiler's log of three counts."""
    profiler, count = Profiler(), _read(spark, d, "region").count
    profiler.log("not yet on")
    profiler.start_log()
    for _ in range(3):
        profiler.profiled(count)()
    profiler.log("done")
    return profiler.frame(spark).groupBy("type").agg(F.count("*").alias("n"))
