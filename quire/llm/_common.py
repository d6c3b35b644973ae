"""What the corpus operators share: words, salts, sized broadcasts, settled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, settle, shared_dir

__all__ = ["WORD", "forget", "remainder", "settle", "shared_dir", "sized", "small_batches", "table", "unit"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: rows handed to Python at once, so that a batch of long texts fits a worker and the Arrow buffers stay small
BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS rows; operators that hand texts to Python call this."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column) -> Column:
    """A pseudorandom number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


#: rows of a few bytes that may be broadcast; beyond, they are joined by a shuffle
BROADCAST_ROWS = 200_000


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for a broadcast where its rows, counted, are few enough; rows are to be ids or narrower than 100 bytes."""
    return F.broadcast(small) if small.count() <= rows else small
