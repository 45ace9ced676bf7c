"""Applying a stream of inserts, updates and deletes with embedded DuckDB upserts.

Changes are keyed and carry a sequence. A DuckDB database in memory holds the state of one bucket of keys; each batch is
upserted with a conditional conflict update that takes a change only if its sequence is greater than the stored one, and deletes
are kept as tombstones, so repeated and out-of-order changes end in the same state whatever their order. That also makes the
upsert mergeable: every task first reduces its own rows with it, and only one row for each key and task is shuffled, so a key that
holds a third of all changes weighs no more than any other. The state is stored by bucket; a run reads and writes only the buckets
its changes touch, in one job, and publishes them with the untouched ones as one version of a table. Buckets are bounded in
rows and bytes, and DuckDB has no folder to spill to.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakeloom.session import materialize, release
from lakeloom.sources.versioned import VersionedTable

ROWS_A_BUCKET, BYTES_A_BUCKET = 100_000, 64_000_000
STATE_COLUMNS = {"store": "VARCHAR", "object_id": "VARCHAR", "seq": "VARCHAR", "tie": "VARCHAR", "deleted": "BOOLEAN", "payload": "VARCHAR"}
STATE_SCHEMA = "store string, object_id string, seq string, tie string, deleted boolean, payload string"
_ARROW = pa.schema([(c, pa.bool_() if t == "BOOLEAN" else pa.string()) for c, t in STATE_COLUMNS.items()])
UPSERT = """
    INSERT INTO state
    SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY store, object_id ORDER BY seq DESC, tie DESC) = 1
    ON CONFLICT (store, object_id) DO UPDATE SET seq = excluded.seq, tie = excluded.tie, deleted = excluded.deleted, payload = excluded.payload
    WHERE (excluded.seq, excluded.tie) > (state.seq, state.tie)
"""


def _state(con) -> Iterator[pa.RecordBatch]:
    for out in con.sql("SELECT * FROM state").to_arrow_reader(20_000):
        if out.num_rows:
            yield from pa.Table.from_batches([out]).cast(_ARROW).to_batches()


def _upsert_batches(batches: Iterator[pa.RecordBatch], flush_after: int | None = None) -> Iterator[pa.RecordBatch]:
    """The state after upserting all batches of one task, tombstones included.

    flush_after: give the state out and begin anew whenever it has more rows than that or has read more than BYTES_A_BUCKET, for a first
    reduction whose results are upserted again; bounds the task's memory whatever it reads.
    """
    import duckdb

    con, read = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if con is None:
            con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "768MB", "temp_directory": ""})
            con.execute(f"CREATE TABLE state ({', '.join(f'{c} {t}' for c, t in STATE_COLUMNS.items())}, PRIMARY KEY (store, object_id))")
        con.register("batch", pa.Table.from_batches([batch]))
        con.execute(UPSERT)
        con.unregister("batch")
        read += batch.nbytes
        if flush_after is not None and (read > BYTES_A_BUCKET or con.sql("SELECT count(*) FROM state").fetchall()[0][0] > flush_after):
            yield from _state(con)
            con.close()
            con, read = None, 0
    if con is not None:
        yield from _state(con)
        con.close()


def _first_upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _upsert_batches(batches, ROWS_A_BUCKET)


def reduce_changes(changes: DataFrame) -> DataFrame:
    """The last change of every key in each task, as rows of STATE_SCHEMA.

    changes: (store, object_id, seq, tie, deleted, payload). The greatest (seq, tie) wins; both are compared as text and none may be
    null. Changes equal in both must be equal. Changes of a null key are left out.
    """
    return changes.select(*STATE_COLUMNS).filter("store is not null and object_id is not null").mapInArrow(_first_upsert, STATE_SCHEMA)


def _upsert_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _upsert_batches for each of the buckets that a task gets one after the other."""

    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            rows, at = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]), 0
            for bucket, same in itertools.groupby(numbers):
                n = len(list(same))
                yield bucket, rows.slice(at, n)
                at += n

    for bucket, own in itertools.groupby(slices(), lambda x: x[0]):
        for out in _upsert_batches(rows for _, rows in own):
            yield out.append_column("bucket", pa.array([bucket] * out.num_rows, pa.int32()))


def apply_changes(table: VersionedTable, changes: DataFrame) -> int:
    """Upsert changes into the table's state and publish the next version; the state of the touched buckets is just more changes. Without changes nothing is published.

    Tombstones stay in the table, so a change that arrives after the delete it precedes cannot revive an object. A run that fails
    publishes nothing; one that is repeated changes nothing. Buckets are counted anew, and all are written, when they hold four times as much as
    they should.
    """
    base = table.manifest()
    reduced = materialize(reduce_changes(changes), "changes")
    n, size = reduced.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    if not n:
        release(reduced)
        return base["version"]
    held, of = base["meta"].get("buckets", {}), base["meta"].get("of", 0)
    # at most what the state had and what comes
    rows, size = base["meta"].get("rows", 0) + n, base["meta"].get("bytes", 0) + size
    fit = max(1, -(-rows // ROWS_A_BUCKET), -(-size // BYTES_A_BUCKET))
    anew = not of or fit > 4 * of
    of = fit if anew else of
    number = F.pmod(F.xxhash64("store", "object_id"), F.lit(of)).cast("int")
    new = reduced.withColumn("bucket", number)
    touched = [*range(of)] if anew else sorted(r[0] for r in new.select("bucket").distinct().collect())
    old = _buckets(table, held, None if anew else touched)
    if old is not None:
        new = new.unionByName(old.withColumn("bucket", number))
    tasks = max(min(len(touched), of), min(table.spark.sparkContext.defaultParallelism, of))
    state = new.select("bucket", *STATE_COLUMNS).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_upsert_buckets, f"{STATE_SCHEMA}, bucket int")
    part, seen = uuid.uuid4().hex, Observation()
    state.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("size")).write.partitionBy("bucket").parquet(f"{table.path}/data/{part}")
    written = {n.removeprefix("bucket="): part for n in table.files.names(f"{table.path}/data/{part}") if n.startswith("bucket=")}
    release(reduced)
    whole = {"rows": seen.get["n"], "bytes": seen.get["size"]} if anew or len(touched) == of else {"rows": rows, "bytes": size}
    meta = {"of": of, "buckets": written if anew else held | written} | whole
    return table.publish_parts([], {}, reduced.schema, base["version"], meta)


def _buckets(table: VersionedTable, held: dict[str, str], wanted: Sequence[int] | None = None) -> DataFrame | None:
    """The state of some buckets, or of all."""
    paths = [f"{table.path}/data/{part}/bucket={b}" for b, part in sorted(held.items(), key=lambda x: int(x[0])) if wanted is None or int(b) in set(wanted)]
    return table.spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else None


def state_of(table: VersionedTable, version: int | None = None) -> DataFrame:
    """The state with its tombstones."""
    state = _buckets(table, table.manifest(version)["meta"].get("buckets", {}))
    return table.spark.createDataFrame([], STATE_SCHEMA) if state is None else state


def current(table: VersionedTable) -> DataFrame:
    """The objects that exist: the state without its tombstones."""
    return state_of(table).filter(~F.col("deleted")).select("store", "object_id", "seq", "payload")
