"""Estimator and model with Spark ML's shape: fit, transform, predict distances, parameters."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits as B
from .operators import cluster, pairs


class _Settings(Params):
    threshold = Param(Params._dummy(), "threshold", "merge threshold", TypeConverters.toFloat)
    branchingFactor = Param(Params._dummy(), "branchingFactor", "most entries of a node", TypeConverters.toInt)
    mergeCriterion = Param(Params._dummy(), "mergeCriterion", "merge criterion", TypeConverters.toString)
    tolerance = Param(Params._dummy(), "tolerance", "tolerance of criteria that have one", TypeConverters.toFloat)
    nFeatures = Param(Params._dummy(), "nFeatures", "bits of a fingerprint", TypeConverters.toInt)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the label", TypeConverters.toString)

    def _start(self, **given) -> None:
        self._setDefault(threshold=0.65, branchingFactor=50, mergeCriterion="diameter", tolerance=0.05, nFeatures=2048, predictionCol="prediction")
        self._set(**given)

    def settings(self) -> cluster.Params:
        g = self.getOrDefault
        return cluster.Params(g(self.threshold), g(self.branchingFactor), g(self.mergeCriterion), g(self.tolerance))


class BitClusters(Estimator, _Settings):
    """Clusters fingerprints (fp_id, words): one tree per ``part`` column where there is one; else one tree for a
    table of up to ``cluster.PART_ROWS`` rows, and trees and merging rounds for a larger one."""

    def __init__(self, **given):
        super().__init__()
        self._start(**given)

    def _fit(self, dataset: DataFrame) -> BitClustersModel:
        n, settings = self.getOrDefault(self.nFeatures), self.settings()
        if "part" in dataset.columns:
            return self._model(cluster.labelled(cluster.fit(dataset, n, settings, part="part")))
        found, members = cluster.fit_all(dataset, n, settings)
        return self._model(found, members)

    def partial_fit(self, model: BitClustersModel | None, dataset: DataFrame) -> BitClustersModel:
        """The model after online insertion of more rows."""
        old = model.clusters.select("pos", "n", "ls", "ids") if model else None
        return self._model(cluster.labelled(cluster.partial_fit(old, dataset, self.getOrDefault(self.nFeatures), self.settings())))

    def _model(self, clusters: DataFrame, members: DataFrame | None = None) -> BitClustersModel:
        return self._copyValues(BitClustersModel(clusters.cache(), members))

    def fit_predict(self, dataset: DataFrame) -> DataFrame:
        """fp_id, label as the tree assigned them (transform assigns to the nearest centroid instead)."""
        return self.fit(dataset).assignments()


class BitClustersModel(Model, _Settings):
    def __init__(self, clusters: DataFrame, members: DataFrame | None = None):
        super().__init__()
        self._start()
        self.clusters, self.members = clusters, members

    def assignments(self) -> DataFrame:
        """fp_id, label of every fitted row."""
        return cluster.assignments(self.clusters) if self.members is None else self.members

    def save(self, path: str) -> None:
        """Clusters, members and parameters; ``load`` gives the model back."""
        self.clusters.write.parquet(f"{path}/clusters")
        self.assignments().write.parquet(f"{path}/members")
        given = [(p.name, json.dumps(self.getOrDefault(p))) for p in self.params if self.isDefined(p)]
        self.clusters.sparkSession.createDataFrame(given, "name string, value string").coalesce(1).write.parquet(f"{path}/parameters")

    @classmethod
    def load(cls, path: str) -> BitClustersModel:
        spark = SparkSession.active()
        model = cls(spark.read.parquet(f"{path}/clusters"), spark.read.parquet(f"{path}/members"))
        return model._set(**{r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/parameters").collect()})  # a row a parameter

    def centroids(self) -> DataFrame:
        """label, words of the clusters."""
        return cluster.cluster_centroids(self.clusters, self.getOrDefault(self.nFeatures)).select("label", "words")

    def features_out(self) -> list[str]:
        """Names of the distances, one for each label: labels are 1, 2, 3, ... without gaps."""
        return [f"cluster{i}" for i in range(1, self.clusters.count() + 1)]

    def distances(self, dataset: DataFrame) -> DataFrame:
        """fp_id, label, distance to every centroid."""
        return pairs.centroid_distances(dataset, self.centroids())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = pairs.nearest_centroid(dataset, self.centroids()).select("fp_id", F.col("label").alias(self.getOrDefault(self.predictionCol)))
        return dataset.join(found, "fp_id", "left")


class UnpackedBitClusters(BitClusters):
    """The same for rows of 0/1 in a column ``bits``."""

    def _fit(self, dataset: DataFrame) -> BitClustersModel:
        return super()._fit(dataset.withColumn("words", B.pack(F.col("bits"), self.getOrDefault(self.nFeatures))))
