"""Rendezvous sharding over weighted shards.

Each record goes to the shard with the least ``-ln(u) / weight``, u being a hash of the
record's key and the shard's number read as a number in (0, 1). A shard's share follows
its weight, and one more shard takes records only into itself: no other score changes.

Defined results: records with a null key all hash as the text "null"; repeated rows go
to one shard and get slots of their own; an empty table gives an empty result; null and
empty texts have size 1 and CRC 0; columns besides the key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import table

#: Slots are numbered in this many runs per shard, so that no task gets a whole shard.
RUNS = 1024


def _named(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _cost(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(_named(key), F.lit(f":{shard}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; a shard of weight 0 takes nothing."""
    scores = [F.struct(_cost(key, j, w).alias("cost"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", runs: int = RUNS) -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard.

    grown: the weights after a change, if grown_shard is to tell where the key goes then.
    Only narrow rows are shuffled, by (shard, run); slot = the run's offset + place in it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        (F.conv(F.substring(F.md5(_named(F.col(key))), 1, 8), 16, 10).cast("long") % runs).alias("__run"),
    )
    offsets = rows.groupBy("shard", "__run").agg(F.count("*").alias("__n"))
    before = W.partitionBy("shard").orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("shard", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("shard", "__run").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("__place", F.row_number().over(inside) - 1).join(offsets, ["shard", "__run"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("__offset") + F.col("__place")).cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards, and where they go when a 17th is added."""
    out = assign_shards(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(n: int) -> str:
    score = "-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return f"(SELECT arg_min(j, {score}) FROM range({n}) r(j))"


# DuckDB has no CRC-32: the oracle computes it bit by bit from the text's bytes.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8
), crc_list AS (SELECT list(c ORDER BY i) AS l FROM crc_table WHERE k = 8
), placed AS (
  SELECT doc_id, coalesce(text, '') AS body, {_sql_shard(16)} AS shard, {_sql_shard(17)} AS grown FROM documents
)
SELECT doc_id, (octet_length(encode(body)) + 1)::BIGINT AS size,
  xor(list_reduce(list_concat([4294967295::BIGINT], CASE WHEN body = '' THEN []::BIGINT[] ELSE
    list_transform(range(1, octet_length(encode(body)) + 1), lambda i: ('0x' || substr(hex(encode(body)), 2 * i - 1, 2))::BIGINT) END),
    lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % 1024, doc_id NULLS FIRST) - 1)::BIGINT AS slot,
  grown::INTEGER AS grown_shard
FROM placed, crc_list
"""
