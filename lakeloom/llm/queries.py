"""Queries for the problems of training data (p6 to p8), over the tables of a folder, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.mixing import Mixture, ramp_schedule
from lakeloom.llm.packing import pack, with_texts
from lakeloom.llm.splitting import Limit, split_documents

MOST_LIMITS = 1000


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _limits(spark: SparkSession, d: str, purpose: str) -> list[Limit]:
    """The limits of a purpose: a parameter table of a few rows."""
    rows = _table(spark, d, "text_limits").filter(F.col("purpose") == purpose).distinct().orderBy("limit_id").take(MOST_LIMITS + 1)
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    return [Limit(r.limit_id, r.max_tokens, r.overlap_tokens or 0) for r in rows]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_table(spark, d, "documents"), {limit.limit_id: limit.max_tokens for limit in _limits(spark, d, "pack")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that were divided: those whose pieces lie in more than one container."""
    held = _packed(spark, d).groupBy("limit_id", "doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return held.filter("a != b").select("limit_id", "doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(_packed(spark, d), _table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces in the containers, and whether these hold no more than they may and what they say."""
    packed = p6_containers(spark, d).withColumn("_bytes", F.encode("text", "UTF-8"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    fits = (F.col("unused") >= 0) & (F.coalesce(F.octet_length("_bytes"), F.lit(0)) == F.col("n_tokens"))
    texts = packed.groupBy("limit_id", "doc_id").agg(F.md5(F.array_join(parts, "")).alias("text_md5"), F.min(fits).alias("fits"))
    sums = packed.groupBy("limit_id", "container_id").agg((F.sum("n_tokens") != F.max("container_tokens")).cast("int").alias("wrong")).groupBy(F.col("limit_id").alias("_limit")).agg(F.sum("wrong").alias("wrong_containers"))
    return texts.join(sums, texts["limit_id"] == sums["_limit"]).drop("_limit")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    targets = _table(spark, d, "mix_targets")
    return Mixture(_table(spark, d, "documents"), targets, ramp_schedule(targets))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the texts laid out along the demand, each as often as allowed, don't reach."""
    return _mixture(spark, d).unreached()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p7_sequence(spark: SparkSession, d: str) -> DataFrame:
    """In the order of training; positions to nine places."""
    return _mixture(spark, d).ordered().withColumn("position", F.round("position", 9))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(_table(spark, d, "documents"), _limits(spark, d, "split")).filter("piece_no = 0")
    numbers = F.when(F.size("long_blocks") == 0, F.array(F.lit(-1))).otherwise(F.col("long_blocks"))
    return pieces.select("limit_id", "doc_id", F.explode(numbers).alias("block_no"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(_table(spark, d, "documents"), _limits(spark, d, "split")).drop("long_blocks")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text that is too large put together again from its pieces without their overlaps, and whether all keep the limit and repeat what they say."""
    limits = _table(spark, d, "text_limits").select(F.col("limit_id").alias("_limit"), F.col("max_tokens").alias("_most"), F.col("overlap_tokens").alias("_asked"))
    pieces = p8_pieces(spark, d).join(limits, F.col("limit_id") == F.col("_limit")).withColumn("_bytes", F.encode("text", "UTF-8"))
    own = F.decode(F.substring("_bytes", F.col("overlap_tokens").cast("int") + 1, F.octet_length("_bytes")), "UTF-8")
    before = Window.partitionBy("limit_id", "doc_id").orderBy("piece_no")
    said = F.lag("_bytes").over(before)
    repeated = F.when(F.col("piece_no") > 0, F.substring(said, F.octet_length(said) - F.col("overlap_tokens").cast("int") + 1, F.col("overlap_tokens").cast("int")) == F.substring("_bytes", F.lit(1), F.col("overlap_tokens").cast("int"))).otherwise(F.col("overlap_tokens") == 0)
    enough = (F.col("piece_no") == 0) | (F.col("overlap_tokens") >= F.least(F.col("_asked") - 3, F.octet_length(said))) & (F.col("overlap_tokens") <= F.col("_asked"))
    keeps = (F.col("n_tokens") <= F.col("_most")) & (F.octet_length("_bytes") == F.col("n_tokens"))
    pieces = pieces.select("limit_id", "doc_id", "piece_no", own.alias("own"), keeps.alias("keeps"), repeated.alias("repeats"), enough.alias("enough"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"])
    return pieces.groupBy("limit_id", "doc_id").agg(F.md5(F.array_join(parts, "")).alias("text_md5"), *[F.min(c).alias(c) for c in ("keeps", "repeats", "enough")])


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_round_trip, p7_found, p7_shares, p7_sequence, p8_found, p8_pieces, p8_round_trip)}

# texts of a source in the order of a hash, as often as they may be used, along the inverted integral of a weight that falls from 1.5 to 0.5 (repeated sources: rises)
_SEQUENCE = """WITH d AS (SELECT doc_id, lower(trim(source, ' ')) AS k, octet_length(encode(text)) AS n FROM documents),
x AS (SELECT k, doc_id, n, sum(n) OVER (PARTITION BY k ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS start, sum(n) OVER (PARTITION BY k) AS supply
  FROM (SELECT *, md5(concat(doc_id, ':0')) AS h FROM d WHERE k IS NOT NULL AND n > 0)),
t AS (SELECT DISTINCT mix_id, lower(trim(source_key, ' ')) AS k, coalesce(target_share, 0) AS target_share, coalesce(max_repeats, 1) AS max_repeats,
  coalesce(target_share, 0) * (SELECT coalesce(sum(n), 0) FROM d) AS target, CASE WHEN coalesce(max_repeats, 1) > 1 THEN -0.5 ELSE 0.5 END AS up FROM mix_targets),
u AS (SELECT t.*, doc_id, n, start, supply, unnest(range(CAST(greatest(0, least(ceil((target - (start + n / 2)) / supply), max_repeats)) AS BIGINT))) AS use_no FROM x JOIN t USING (k)),
w AS (SELECT *, use_no * supply + start + n / 2 AS y, (1 + up) * target AS w0, (1 - up) * target AS w1 FROM u),
s AS (SELECT mix_id, k AS source_key, doc_id, use_no, n AS n_tokens, least(2 * y / (w0 + sqrt(greatest(0, w0 * w0 + 2 * (w1 - w0) * y))), 1.0) AS position FROM w)"""

SQL = {
    "p6_round_trip": """SELECT limit_id, doc_id, md5(coalesce(text, '')) AS text_md5, true AS fits, 0 AS wrong_containers FROM documents JOIN text_limits ON purpose = 'pack'""",
    "p7_sequence": f"{_SEQUENCE} SELECT mix_id, source_key, doc_id, use_no, n_tokens, round(position, 9) AS position FROM s",
    "p7_shares": f"""{_SEQUENCE}, used AS (SELECT mix_id, source_key, sum(n_tokens) AS used_tokens, count(*) AS uses, count(DISTINCT doc_id) AS texts FROM s GROUP BY ALL),
f AS (SELECT t.mix_id, t.k AS source_key, target_share, max_repeats, target AS target_tokens, CAST(coalesce(supply, 0) AS BIGINT) AS supply_tokens, CAST(coalesce(used_tokens, 0) AS BIGINT) AS used_tokens, coalesce(texts, 0) AS texts, coalesce(uses, 0) AS uses
  FROM t LEFT JOIN (SELECT DISTINCT k, supply FROM x) p USING (k) LEFT JOIN used ON used.mix_id = t.mix_id AND used.source_key = t.k)
SELECT *, CASE WHEN sum(used_tokens) OVER (PARTITION BY mix_id) > 0 THEN used_tokens / sum(used_tokens) OVER (PARTITION BY mix_id) ELSE 0 END AS actual_share, supply_tokens * max_repeats < target_tokens AS exhausted FROM f""",
    "p8_round_trip": """SELECT limit_id, doc_id, md5(text) AS text_md5, true AS keeps, true AS repeats, true AS enough FROM documents JOIN text_limits ON purpose = 'split' AND octet_length(encode(text)) > max_tokens""",
    "p6_found": "SELECT limit_id, doc_id FROM documents JOIN text_limits ON purpose = 'pack' AND octet_length(encode(text)) > max_tokens",
    "p7_found": """WITH s AS (SELECT lower(trim(source, ' ')) AS k, sum(octet_length(encode(text))) AS n FROM documents GROUP BY k)
SELECT DISTINCT mix_id, source_key FROM mix_targets LEFT JOIN s ON k = source_key
WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(octet_length(encode(text))) FROM documents)""",
    "p8_found": r"""WITH d AS (SELECT limit_id, doc_id, text, max_tokens FROM documents JOIN text_limits ON purpose = 'split' AND octet_length(encode(text)) > max_tokens),
b AS (SELECT limit_id, doc_id, max_tokens, unnest(list_filter(regexp_split_to_array(text, '(\r?\n){2,}'), lambda x: x <> '')) AS block,
  generate_subscripts(list_filter(regexp_split_to_array(text, '(\r?\n){2,}'), lambda x: x <> ''), 1) - 1 AS i FROM d),
f AS (SELECT limit_id, doc_id, i FROM b WHERE octet_length(encode(block)) > max_tokens)
SELECT limit_id, doc_id, CAST(i AS INTEGER) AS block_no FROM f
UNION ALL SELECT limit_id, doc_id, -1 FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.limit_id = d.limit_id AND f.doc_id = d.doc_id)""",
}
