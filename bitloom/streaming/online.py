"""Online insertion from streams: each micro-batch goes into the stored cluster table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pairs
from ..operators.cluster import LEAVES, Params, partial_fit


class OnlineClusters:
    """A cluster table in versions under a path, version 0 being empty; each batch writes the next one.

    A batch that runs again after a failure starts from the same version and writes the same next
    one, so insertion is exactly once.
    """

    def __init__(self, spark: SparkSession, path: str, n_features: int, params: Params = Params()):
        self.spark, self.path, self.n_features, self.params = spark, path.rstrip("/"), n_features, params

    def clusters(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], LEAVES)
        return self.spark.read.parquet(f"{self.path}/v={version}").drop("v")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        old = self.clusters(batch_id)
        partial_fit(old, batch, self.n_features, self.params).write.mode("overwrite").parquet(f"{self.path}/v={batch_id + 1}")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """stream: fp_id, words.  Ids are append-only, so there is no event time and no watermark."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def assign_stream(stream: DataFrame, centroids: DataFrame) -> DataFrame:
    """fp_id, label of the most similar of a fixed set of centroids(label, words), stateless.

    The centroids are a table that joins the stream: one row where they are small enough to broadcast.
    More of them can't be compared without state; assign batches with ``nearest_centroid`` instead.
    """
    if not pairs.fits(centroids):
        raise ValueError("too many centroids to broadcast; assign in foreachBatch with nearest_centroid")
    return pairs.nearest_centroid(stream, centroids).select("fp_id", "label")


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type in windows of an hour, with a watermark: profile bits of users arrive this way."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
