"""Following the changelogs of several collections with Structured Streaming.

The stream only says that something was appended; what is read is decided by versions, which the follower publishes together with
its results. So a batch that is run again finds nothing left to do, and no offset can disagree with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeloom.sources.changelog import Changelog, record_schema


def follow(spark: SparkSession, changelogs: Iterable[Changelog], act: Callable[[], object], checkpoint: str, interval: str = "500 milliseconds", once: bool = False, most_files: int = 1000, name: str | None = None) -> StreamingQuery:
    """Call act after every batch of new records in any of the changelogs; once: for what there is, then stop."""
    stream = None
    for log in changelogs:
        log.files.mkdirs(f"{log.path}/oplog")
        part = spark.readStream.schema(record_schema(log.doc)).option("maxFilesPerTrigger", most_files).parquet(f"{log.path}/oplog").select("seq")
        stream = part if stream is None else stream.union(part)
    if stream is None:
        raise ValueError("nothing to follow")
    writer = stream.writeStream.foreachBatch(lambda _df, _batch: act()).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
