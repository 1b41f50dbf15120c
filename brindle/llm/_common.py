"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and give checkpoints a folder.

    The folder is the one that the cluster names in spark.checkpoint.dir.  Only in local mode (tests on one machine) a
    temporary one is made where that is unset; on a cluster an unset folder is an error, as no other is shared.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return spark


#: Bytes of an Arrow batch, about; one row may be longer.
BATCH_BYTES = 32 << 20


def batches_of(spark: SparkSession, rows: int) -> None:
    """Bound the rows and bytes of an Arrow batch of the session: whole texts are long, and a worker holds a batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects; grows with the input and costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: float, least: int | None = None) -> int:
    """Partitions or buckets so that each takes a bounded share of the input at any size."""
    n = least or tasks(df.sparkSession)
    if size_of(df) >= 1 << 60:  # rows from the driver or an RDD: the optimizer knows no size
        return n
    return int(min(1_000_000, max(n, size_of(df) / (mb * 1e6))))


_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again: cuts lineage with less disk than a checkpoint."""
    spark = ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``staged`` has written so far: for callers that have stored their result and need no input of it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
