"""Components of a dataflow on streams: union, running counts, test-then-train, sessions, and sources by folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def folder(spark: SparkSession, path: str, schema, form: str = "parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as they come; ``files`` bounds those of one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).format(form).load(path)


def into_folder(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Appends what is there now to a folder of files, each row once, and stops."""
    query = stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def joined(*streams: DataFrame) -> DataFrame:
    """Streams of one header as one."""
    first = streams[0]
    for s in streams[1:]:
        if s.dtypes != first.dtypes:
            raise ValueError("headers differ")
        first = first.unionByName(s)
    return first


def running_count(stream: DataFrame) -> DataFrame:
    return stream.agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by key and session: rows less than ``gap`` apart."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("session"), key).count()


def sliding(stream: DataFrame, time: str, key: str, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width, slide), key).count()


class NaiveBayesUpdater:
    """Class counts by attribute value, added up batch by batch: ``update`` and ``predict`` as an updateable learner.

    Counts are written to a new folder each batch (the last two are kept), so a lost executor costs no state.
    """

    def __init__(self, spark: SparkSession, attributes: list[str], label: str, path: str) -> None:
        self.spark, self.attributes, self.label, self.path, self.turn = spark, attributes, label, path, 0

    def counts(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{self.turn}") if self.turn else None

    def update(self, batch: DataFrame) -> None:
        from ..operators.features import contingency

        new = contingency(batch, self.attributes, self.label)
        old = self.counts()
        both = new if old is None else old.unionByName(new).groupBy("attribute", "value", "label").agg(F.sum("n").alias("n"))
        both.write.parquet(f"{self.path}/{self.turn + 1}")
        self.turn += 1

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The label of the largest product of smoothed shares; null before the first batch."""
        from ..operators.models import Model, let

        table = self.counts()
        if table is None:
            return df.withColumn(out, F.lit(None).cast("string"))
        rows = table.collect()  # attributes x values x labels
        labels = sorted({r["label"] for r in rows})
        first = [r for r in rows if r["attribute"] == self.attributes[0]]
        prior = {y: sum(r["n"] for r in first if r["label"] == y) for y in labels}
        n = sum(prior.values())
        logs = []
        import math

        for y in labels:
            s = F.lit(math.log((prior[y] + 1) / (n + len(labels))))
            for a in self.attributes:
                own = {r["value"]: r["n"] for r in rows if r["attribute"] == a and r["label"] == y}
                values = {r["value"] for r in rows if r["attribute"] == a and r["value"] is not None}
                total = sum(v for k, v in own.items() if k is not None) + len(values)
                cells = [x for v in sorted(values) for x in (F.lit(v), F.lit(math.log((own.get(v, 0) + 1) / total)))]
                s = s + (F.coalesce(F.try_element_at(F.create_map(*cells), F.col(a).cast("string")), F.lit(0.0)) if cells else F.lit(0.0))
            logs.append(s)
        model = Model(labels, let(F.array(*logs), lambda d: F.transform(d, lambda x: F.exp(x - F.array_max(d)))))
        return model.apply(df, out, None)


def test_then_train(stream: DataFrame, learner, label: str, checkpoint: str) -> list[tuple[int, int, int]]:
    """(batch, rows, right) of each micro-batch: scored by the learner as it was, then given to it."""
    seen: list[tuple[int, int, int]] = []

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        r = learner.predict(rows, "_p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("_p") == F.col(label).cast("string"), F.lit(False))).alias("k")).first()
        seen.append((number, r["n"], r["k"]))
        learner.update(rows)
        rows.unpersist()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return seen


class Flow:
    """Named steps over tables: a fold maker, a fitted filter, a learner, a predictor and an evaluator, one after another."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable]] = []

    def then(self, name: str, step: Callable) -> "Flow":
        self.steps.append((name, step))
        return self

    def run(self, value):
        """What every step returns, by name, the first taking ``value``."""
        out = {}
        for name, step in self.steps:
            value = out[name] = step(value)
        return out
