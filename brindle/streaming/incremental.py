"""Row-at-a-time operators on Structured Streaming: narrow transforms, windowed counts, incremental class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import removed


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark are dropped and state is freed."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).count()


def class_counts(stream: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """The sufficient statistics of an incremental naive Bayes: attribute, value, label, n."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = stream.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(pairs).alias("x"))
    return long.select("x.attribute", "x.value", "label").groupBy("attribute", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run what is there now into an in-memory table (for small results) and stop."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run what is there now into a shared folder of files, stop and read it: results of any size, none of it on the driver.

    In complete mode a batch holds the whole result, so the last one is read and those before it are deleted.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/none")
    last = [f"{path}/none"]

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        if mode == "complete":
            for old in set(last) - {f"{path}/{number}"}:
                removed(spark, old)
            last.clear()
        last.append(f"{path}/{number}")

    stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*dict.fromkeys(last))
