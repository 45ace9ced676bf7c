"""Queries for the general data problems (p1 to p5), over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.cdc import apply_changes, current
from lakeloom.operators.history import AttributeHistory, snapshot_events
from lakeloom.operators.hotkeys import KeyProfile, distinct_elements, hot_keys, id_owner
from lakeloom.operators.incremental import IncrementalTarget, fingerprint, latest_delivery, run_marks, state_at_marks
from lakeloom.operators.references import Reference, author_key, find_orphans, orphan_report
from lakeloom.session import materialize, work_path
from lakeloom.sources.versioned import VersionedTable

PAYLOAD = "struct<name:string,author:string,text:string,reactions:array<string>>"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# p1: each index takes from op_log what was added or changed since its last successful run


def _p1_target(spark: SparkSession, d: str) -> tuple[IncrementalTarget, DataFrame]:
    """The target as the successful runs left it, and the source as it is now, a row for each index and record."""
    log = table(spark, d, "op_log")
    marks = materialize(run_marks(table(spark, d, "index_runs"), ["index_name", "store"]), "marks")
    said = log.select("store", F.col("id").alias("op_id"), "arrived_at", "operation")
    versions = said.select("store", "op_id", "arrived_at", fingerprint(F.col("operation")).alias("version"))
    target = IncrementalTarget(VersionedTable(spark, work_path(spark, "p1_target")), ["index_name", "store", "op_id"], "version")
    target.run(state_at_marks(versions, marks, "store", "op_id", "arrived_at", "version"))
    now = latest_delivery(versions, ["store", "op_id"], "arrived_at", "version")
    source = now.join(marks.select("index_name", "store"), "store").select("index_name", "store", "op_id", "version")
    return target, source


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    target, source = _p1_target(spark, d)
    return target.pending(source).select("index_name", "store", "op_id")


def p1_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """The entries each index holds after one more run, which processes what is pending and no more: complete, without repeats."""
    target, source = _p1_target(spark, d)
    before = target.table.version()
    target.run(source)
    old = target.rows(before).select(*[F.col(c).alias(f"_old_{c}") for c in ("index_name", "store", "op_id", "version")])
    new = target.rows()
    kept = [new[c].eqNullSafe(old[f"_old_{c}"]) for c in ("index_name", "store", "op_id")]
    how = F.when(F.col("_old_op_id").isNull(), "added").when(F.col("version") != F.col("_old_version"), "changed").otherwise("held")
    return new.join(old, kept, "left").select("index_name", "store", "op_id", how.alias("how"))


# p2: references to records that don't exist or came later


def _p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, n) for n in ("users", "messages", "messages_by_user")}
    return find_orphans(tables, [Reference("messages", author_key(F.col("author")), "users"), Reference("messages_by_user", F.col("to_id"), "messages")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_orphans(spark, d).filter("kind = 'direct'").select("ref_table", "record_id", "ref_month", "state")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_p2_orphans(spark, d))


# p3: results for every author, though a few hold most rows


def _p3_messages(spark: SparkSession, d: str) -> KeyProfile:
    return KeyProfile(table(spark, d, "messages").select("author", "written_at"), author_key(F.col("author")), F.unix_micros(F.col("written_at").cast("timestamp")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Hot authors, by exact selection among the hashes of the authors of all rows."""
    out = None
    for name, key in (("messages", author_key(F.col("author"))), ("messages_by_user", author_key(id_owner(F.col("id"))))):
        found = hot_keys(table(spark, d, name), key).select(F.lit(name).alias("table_name"), F.col("key").alias("author_key"))
        out = found if out is None else out.unionByName(found)
    return out


def p3_author_stats(spark: SparkSession, d: str) -> DataFrame:
    """For every author the messages, first and last time, exact quartiles of the times and the number of distinct reactions."""
    profile = _p3_messages(spark, d)
    quartiles = profile.quantiles([0.25, 0.5, 0.75]).groupBy("key").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    reactions = distinct_elements(table(spark, d, "messages"), author_key(F.col("author")), F.col("reactions")).groupBy("key").agg(F.count("*").alias("n"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return (
        profile.counts()
        .join(quartiles, "key", "left")
        .join(reactions, "key", "left")
        .select(
            F.col("key").alias("author_key"), F.col("n_rows").alias("n_messages"), at("least").alias("first_written"), at("most").alias("last_written"),
            at("q1").alias("written_q1"), at("q2").alias("written_median"), at("q3").alias("written_q3"), F.coalesce("n", F.lit(0)).alias("n_reactions"),
        )
    )


def p3_author_reactions(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    return distinct_elements(messages, author_key(F.col("author")), F.col("reactions")).select(F.col("key").alias("author_key"), F.col("element").alias("reaction"))


# p4 and p5 both read the records of op_log, each with the content of its last delivery


def records(spark: SparkSession, d: str) -> DataFrame:
    """Puts and deletes with an object: (store, op_id, put, object_id and the object's fields)."""
    last = latest_delivery(table(spark, d, "op_log"), ["store", "id"], "arrived_at", "operation")
    last = last.filter(F.col("operation.op_type").isin("put", "delete") & F.col("operation.obj").isNotNull() & F.col("operation.obj.id").isNotNull())
    fields = [F.col(f"operation.obj.{c}").alias(c) for c in ("name", "author", "text", "reactions")]
    return last.select("store", F.col("id").alias("op_id"), (F.col("operation.op_type") == "put").alias("put"), F.col("operation.obj.id").alias("object_id"), *fields)


def _p4_changes(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct("name", "author", "text", "reactions"))
    return records(spark, d).select("store", "object_id", F.col("op_id").alias("seq"), F.lit("").alias("tie"), (~F.col("put")).alias("deleted"), F.when(F.col("put"), payload).alias("payload"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    state = VersionedTable(spark, work_path(spark, "p4_state"))
    apply_changes(state, _p4_changes(spark, d))
    return current(state).select("store", "object_id", F.col("seq").alias("op_id"))


def p4_current_state(spark: SparkSession, d: str) -> DataFrame:
    """Users and messages as of the start of op_log, then all its changes: what exists in the end, each object with its content.

    Of rows of a base table with the same id the one that arrived last counts. op_id is empty for objects that op_log didn't touch.
    """
    state, base = VersionedTable(spark, work_path(spark, "p4_state")), None
    for store, fields in (("users", {"name"}), ("messages", {"author", "text", "reactions"})):
        df = table(spark, d, store)
        payload = F.to_json(F.struct(*[(F.col(c) if c in fields else F.lit(None).cast(t)).alias(c) for c, t in (("name", "string"), ("author", "string"), ("text", "string"), ("reactions", "array<string>"))]))
        time = F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        # of rows that arrived at the same moment the greatest text counts
        changes = df.select(F.lit(store).alias("store"), F.col("id").alias("object_id"), F.lit("").alias("seq"), F.concat(F.coalesce(time, F.lit("")), F.lit(" "), payload).alias("tie"), F.lit(False).alias("deleted"), payload.alias("payload"))
        base = changes if base is None else base.unionByName(changes)
    apply_changes(state, base)
    apply_changes(state, _p4_changes(spark, d))
    content = F.from_json("payload", PAYLOAD)
    fields = [content[c].alias(c) for c in ("name", "author", "text")]
    return current(state).select("store", "object_id", F.col("seq").alias("op_id"), *fields, F.to_json(content["reactions"]).alias("reactions"))


def _p5_histories(spark: SparkSession, d: str) -> dict[str, AttributeHistory]:
    log = materialize(records(spark, d).filter("store is not null and op_id is not null").withColumn("reactions", F.to_json("reactions")), "records")
    out = {}
    for store, attributes in (("users", ["name"]), ("messages", ["author", "text", "reactions"])):
        out[store] = AttributeHistory(log.filter(F.col("store") == store), ["object_id"], "op_id", attributes)
    events = snapshot_events(table(spark, d, "user_snapshots"), "taken_on", ["id"], ["name"], "loaded_at").withColumnRenamed("id", "object_id")
    return out | {"user_snapshots": AttributeHistory(events, ["object_id"], "seq", ["name"])}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for origin, history in _p5_histories(spark, d).items():
        found = history.versions().select(F.lit(origin).alias("origin"), "object_id", "valid_from", F.coalesce("valid_to", F.lit("")).alias("valid_to"))
        out = found if out is None else out.unionByName(found)
    return out


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, with the attributes of each version; reactions as JSON."""
    out = None
    for origin, history in _p5_histories(spark, d).items():
        versions = history.versions()
        fields = [(F.col(c) if c in versions.columns else F.lit(None).cast("string")).alias(c) for c in ("name", "author", "text", "reactions")]
        found = versions.select(F.lit(origin).alias("origin"), "object_id", *fields, "valid_from", "valid_to")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_catch_up, p2_found, p2_report, p3_found, p3_author_stats, p3_author_reactions, p4_found, p4_current_state, p5_found, p5_versions)}
