"""Keys, hashes and JSON paths as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.session import materialize, owning

#: Width of the time and of the counter in a sequence key, and what follows every key with a given prefix.
TIME_WIDTH, COUNTER_WIDTH = 16, 6
PREFIX_END = "ÿ"


def time_key(ms: Column) -> Column:
    """Milliseconds since the epoch as text that sorts like the number."""
    return F.lpad(ms.cast("string"), TIME_WIDTH, "0")


def sequence_key(ms: Column, n: Column) -> Column:
    """Time and counter as text that sorts like them: of a counter beyond its six digits the rest is carried into the time."""
    most = F.lit(10**COUNTER_WIDTH)
    carried = F.floor(n / most).cast("bigint")
    return F.concat(time_key(ms + carried), F.lit(":"), F.lpad((n - carried * most).cast("string"), COUNTER_WIDTH, "0"))


def with_sequence_ids(df: DataFrame, ms: Column, order: Sequence[str], into: str = "id") -> DataFrame:
    """Rows with ids made of their own time and their rank among the rows of the same millisecond."""
    at = Window.partitionBy("_ms").orderBy(*order)
    return df.withColumn("_ms", ms).withColumn(into, sequence_key(F.col("_ms"), F.row_number().over(at) - 1)).drop("_ms")


def numbered(df: DataFrame, order: Sequence[str], into: str = "_n") -> DataFrame:
    """Rows numbered from 0 in the given order, without bringing them into one partition.

    Range partitions are sorted by themselves and start at the number of rows in the partitions before, which is one figure for
    each partition. Rows equal in the order columns get numbers in any order.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    parted = parted.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parted = materialize(parted, "numbered")
    sizes = parted.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))  # one row for each partition
    out = parted.join(starts, "_part").withColumn(into, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    return owning(out, parted)


def json_text(value: Column, data_type: T.DataType) -> Column:
    """The JSON text of a value; ``null`` for null, whole doubles without a point."""
    if isinstance(data_type, T.StringType):
        escaped = F.to_json(F.array(value))
        text = F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    else:
        text = value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def index_key(parts: Sequence[tuple[Column, T.DataType]], row_id: Column) -> Column:
    """The id of an entry of a secondary index: the JSON texts of the parts joined by ``:``, ``_`` and the row's id."""
    return F.concat(F.concat_ws(":", *[json_text(c, t) for c, t in parts]), F.lit("_"), row_id)


def _text(value: Column, data_type: T.DataType | None) -> Column:
    return value if data_type is None or isinstance(data_type, T.StringType) else json_text(value, data_type)


def sha1(value: Column, data_type: T.DataType | None = None) -> Column:
    """Hexadecimal SHA-1 of a string, of anything else of its JSON text."""
    return F.sha1(_text(value, data_type))


def sha256(value: Column, data_type: T.DataType | None = None) -> Column:
    return F.sha2(_text(value, data_type), 256)


hash_of = sha1


def json_path(value: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where there's none."""
    return F.get_json_object(value, "$." + path)
