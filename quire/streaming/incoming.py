"""PDF files as a stream: facts of each file as it arrives, and counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incoming(spark: SparkSession, folder: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of path, modified, n_bytes, version, num_objs and num_pages of new files below a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    text = F.decode("content", "ISO-8859-1")
    return rows.select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), F.nullif(F.regexp_extract(F.substring(text, 1, 64), r"^%PDF-([12]\.\d)", 1), F.lit("")).alias("version"),
        F.regexp_count(text, F.lit(r"\d+\s+\d+\s+obj\b")).alias("num_objs"), F.regexp_count(text, F.lit(r"/Type\s*/Page\b(?!s)")).alias("num_pages"),
    )


def arrivals(files: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files, pages and bytes by window of arrival; files that come later than the limit are left out."""
    window = F.window("modified", every)
    return files.withWatermark("modified", late).groupBy(window.alias("window")).agg(F.count("*").alias("files"), F.sum("num_pages").alias("pages"), F.sum("n_bytes").alias("n_bytes")).select("window.start", "files", "pages", "n_bytes")
