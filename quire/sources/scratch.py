"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where none is set, a session in one process (local[...]) gets a temporary one; on a cluster that is an
    error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/quire-{name}-{uuid.uuid4().hex}"


#: session settings that keep what is broadcast and what is handed to Python in bounds. Settled tables are packed up to fifty
#: times (paths, numbers, equal bodies), so a file's bytes say little about the rows a broadcast would hold on the driver; and Arrow
#: batches are cut by bytes, as tokens and encoded streams take a multiple of what comes in. Values set by the user stay.
BOUNDS = {"spark.sql.sources.fileCompressionFactor": ("1.0", "32.0"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def bounded(spark: SparkSession) -> None:
    """Set BOUNDS where the session has Spark's own values; the PDF reader and the queries over it call this, the corpus operators have their own."""
    for key, (own, ours) in BOUNDS.items():
        now = spark.conf.get(key, None)
        if now is None or _plain(now) == own:
            spark.conf.set(key, ours)


def _plain(value: str) -> str:
    """A number of bytes without its unit."""
    units = {"b": 1, "kb": 1 << 10, "k": 1 << 10, "mb": 1 << 20, "m": 1 << 20, "gb": 1 << 30, "g": 1 << 30}
    digits = value.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    unit = value[len(digits) :].lower()
    return str(int(digits) * units[unit]) if unit in units and digits.isdigit() else value


#: tables settled since a settled_alone() began, for each that is under way
_UNDER_WAY: list[list[DataFrame]] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df there and read it again: computed once, lineage cut."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for made in _UNDER_WAY:
        made.append(out)
    return out


def settled_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, settled; the tables that were settled on the way are deleted, so nothing else may read them."""
    made: list[DataFrame] = []
    _UNDER_WAY.append(made)
    try:
        out = settle(make(), name)
    finally:
        _UNDER_WAY.pop()
    forget(*(df for df in made if df is not out))
    return out


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, a few tasks each: for few and small rows that take long, which a read or a shuffle by size would leave in one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def forget(*tables: DataFrame) -> None:
    """Delete settled tables whose results stand in later settled ones."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
