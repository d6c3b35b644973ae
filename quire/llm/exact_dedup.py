"""Exact dedup with a streaming aggregation whose state never expires.

A file stream of the documents is reduced by SHA-256 digest. The state (RocksDB: on the
executors' disks, with checkpoints in the shared folder) keeps for each digest the
largest id, the number of rows, and a locator (file and row) of the row that stays. The
state is then read as a table. Where a digest was hit more than once, its rows' full
texts are compared: they are grouped by digest and text, so that two texts that shared a
digest would still be apart.

Defined results: a null text counts as empty; of rows with equal text and equal id all
stay (they share keep_id); a null id is less than any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, shared_dir, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _conf(spark: SparkSession, **values: str):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_state(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", max_bytes: int = 64 << 30, checkpoint: str | None = None) -> DataFrame:
    """digest, keep_id, n, keep_file, keep_row: the state after all files below path.

    Run again with the same checkpoint folder, it reads only the files that are new.
    """
    at = checkpoint or shared_dir(spark, "dedup-state")
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a pattern or a folder, but not the path of one file
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(pattern)
    locator = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = stream.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), F.struct(F.col(key).alias("id"), *locator).alias("kept"))
    state = rows.groupBy("digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    with _conf(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true", spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.format("statestore").load(at)
        # the state's value holds the aggregation's buffers in order: the largest row, then the count
        kept, n = (f"value.{f.name}" for f in found.schema["value"].dataType.fields)
        return settle(found.select(F.col("key.digest").alias("digest"), F.col(f"{kept}.id").alias("keep_id"), F.col(n).alias("n"), F.col(f"{kept}.file").alias("keep_file"), F.col(f"{kept}.row").alias("keep_row")), "dedup-digests")


def exact_dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of every row below path."""
    state = digest_state(spark, path, key, text).select("digest", "keep_id", "n")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = spark.read.parquet(path).select(F.col(key).alias("__id"), body.alias("__text"), F.sha2(body, 256).alias("digest"))
    single = rows.select("__id", "digest").join(state.filter("n = 1"), "digest")
    single = single.select("__id", F.col("keep_id"), F.lit(1).cast("long").alias("n"), "digest")
    hits = settle(rows.join(state.filter("n > 1").select("digest"), "digest"), "dedup-hits")
    # the check of full bytes: the text itself is part of the group's key
    same = hits.groupBy("digest", "__text").agg(F.max("__id").alias("keep_id"), F.count("*").alias("n"))
    checked = hits.join(same, ["digest", "__text"]).select("__id", "keep_id", "n", "digest")
    out = single.unionByName(checked)
    return out.select(F.col("__id").alias(key), "keep_id", F.col("n").alias("group_size"), F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal one of largest doc_id, which stays."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
