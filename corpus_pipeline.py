"""A corpus pipeline of the llm operators: documents in, mixed and encoded documents out.

Each stage takes all documents its predecessor kept and returns them with the columns of
documents (n_chars follows the text); the last returns token ids. Between stages the
documents are written to the shared folder and read again. Where columns of documents
are null, where texts are empty or rows repeat, each operator's docstring says what comes
out; an empty table gives an empty result, and extra columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, line_dedup, mixing, near_dedup, quality
from quire.llm._common import remainder, settle, sized


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives one half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.fit(docs, labels, lambda k: remainder(k, 3) != 1)
    return quality.scored(docs, net, docs.columns, name="__quality").filter("__quality >= 0.5").drop("__quality")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left without a word go."""
    out = line_dedup.deduped(docs, min_words=1)
    emptied = (F.col("__removed") > 0) & ~F.col("text").rlike(line_dedup.WORD)
    return _counted(out.filter(~F.coalesce(emptied, F.lit(False))).drop("__removed"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8."""
    gone = near_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").filter("doc_id is not null").distinct()
    return docs.join(sized(settle(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: words in blocks drawn twice are there twice."""
    return _counted(mixing.mixed_texts(docs, mixing.mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text they decode to."""
    columns = ["doc_id", "lang", "source"]
    out = bpe.encode_decode(docs, columns)
    return out.select(*columns, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the classifier, the hashes or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
