"""The tables from which the PDF queries start: documents written as PDF files and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reader, writer
from ..sources.scratch import bounded, settle, settled_alone, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_objects(spark: SparkSession, sf_dir: str, compress: bool = True, metadata: bool = False) -> DataFrame:
    """The objects of one PDF for each document: its text, its source as title, its language, and its id as keywords."""
    docs = table(spark, sf_dir, "documents")
    info = docs.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), F.col("source").alias("title"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("keywords"))
    if metadata:
        n = F.col("keywords").cast("bigint")
        info = info.withColumns({"author": F.concat(F.lit("Author "), "keywords"), "subject": F.concat(F.lit("Über "), "language"), "creator": F.lit("quire"), "producer": F.lit("Spark"), "created": F.timestamp_seconds((n + 1) * 86400), "modified": F.timestamp_seconds((n + 1) * 86400 + 3600)})
    # a table of one row group is read by one task: the texts are dealt, so that all cores write and deflate pages
    return settle(writer.pdf_objects(writer.pages_of(spread(docs.select("doc_id", "text"))), info, compress, metadata), "document-objects")


def pdf_files(spark: SparkSession, sf_dir: str, compress: bool = True) -> DataFrame:
    return settled_alone(lambda: writer.written(document_objects(spark, sf_dir, compress)), "pdf")


def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled_alone(lambda: reader.objects(pdf_files(spark, sf_dir)), "objects")


def doc_id(path: str = "path"):
    return F.regexp_extract(path, r"doc-(\d+)\.pdf", 1).cast("bigint").alias("doc_id")
