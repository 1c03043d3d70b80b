"""Cluster quality from cluster summaries: Calinski-Harabasz, Davies-Bouldin and Dunn forms on JT.

Clusters are a table (label, fp_id, words), which may overlap; centres default to majority
centroids.  Pairs are formed among clusters only (one row each), never among fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import isim as I
from .pairs import meet
from .summaries import centroids, linear_sums, medoids


def centres(members: DataFrame, n_features: int, kind: str = "centroid") -> DataFrame:
    """label, n, words: the centroid or medoid of each cluster."""
    sums = linear_sums(members, n_features, "label")
    if kind == "centroid":
        return centroids(sums).select("label", "n", B.pack(F.col("centroid"), n_features).alias("words"))
    if kind == "medoid":
        m = medoids(members, n_features, "label").withColumnRenamed("medoid_id", "fp_id")
        return m.join(members.select("label", "fp_id", "words"), ["label", "fp_id"]).join(sums.select("label", "n"), "label").select("label", "n", "words")
    raise ValueError(f"centres are centroids or medoids, not {kind!r}")


def _to_own(members: DataFrame, own: DataFrame) -> DataFrame:
    both = members.select("label", "fp_id", "words").join(own.select("label", F.col("words").alias("centre")), "label")
    return both.select("label", "fp_id", (1 - B.jt_words(F.col("words"), F.col("centre"))).alias("d"))


def chi(members: DataFrame, n_features: int, own: DataFrame | None = None) -> DataFrame:
    """chi: between over within scatter, 0 for at most one cluster, null if all is at its centre."""
    own = centres(members, n_features) if own is None else own
    whole = centroids(linear_sums(members, n_features)).select(B.pack(F.col("centroid"), n_features).alias("middle"))
    apart = own.crossJoin(F.broadcast(whole)).select("n", (1 - B.jt_words(F.col("words"), F.col("middle"))).alias("d"))
    between = apart.agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    within = _to_own(members, own).agg(F.sum(F.col("d") * F.col("d")).alias("w"))
    both = between.crossJoin(F.broadcast(within))
    return both.select(F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))).alias("chi"))


def dbi(members: DataFrame, n_features: int, own: DataFrame | None = None) -> DataFrame:
    """dbi: sum over clusters of the worst (scatter_i + scatter_j) / distance_ij, over the number of fingerprints."""
    own = centres(members, n_features) if own is None else own
    scatter = _to_own(members, own).groupBy("label").agg(F.avg("d").alias("s"), F.count(F.lit(1)).alias("n"))
    side = own.select("label", "words").join(scatter, "label")
    a = side.select(F.col("label").alias("i"), F.col("words").alias("wi"), F.col("s").alias("si"), "n")
    b = side.select(F.col("label").alias("j"), F.col("words").alias("wj"), F.col("s").alias("sj"))
    gap = 1 - B.jt_words(F.col("wi"), F.col("wj"))
    ratio = F.when(gap == 0, F.when(F.col("si") + F.col("sj") > 0, F.lit(float("inf")))).otherwise((F.col("si") + F.col("sj")) / gap)
    worst = meet(a, b, "i", "j", F.col("i") != F.col("j")).groupBy("i", "n").agg(F.max(ratio).alias("r"))
    return worst.agg(F.sum("r").alias("r"), F.sum("n").alias("n")).select((F.col("r") / F.col("n")).alias("dbi"))


def dunn(members: DataFrame, n_features: int) -> DataFrame:
    """dunn: least 1 - iSIM of two clusters' union (at most 1) over the largest iSIM of a cluster.

    Clusters of one fingerprint have no iSIM and don't count for the largest.
    """
    sums = linear_sums(members, n_features, "label")
    top = sums.where("n > 1").agg(F.max(I.isim_of(F.col("ls"), F.col("n"))).alias("d"))
    a = sums.select(F.col("label").alias("i"), F.col("n").alias("ni"), F.col("ls").alias("li"))
    b = sums.select(F.col("label").alias("j"), F.col("n").alias("nj"), F.col("ls").alias("lj"))
    union = 1 - I.isim_of(F.zip_with("li", "lj", lambda x, y: x + y), F.col("ni") + F.col("nj"))
    gap = meet(a, b, "i", "j", F.col("i") < F.col("j"), elements=n_features).agg(F.least(F.min(union), F.lit(1.0)).alias("g"))
    return gap.crossJoin(F.broadcast(top)).select((F.coalesce("g", F.lit(1.0)) / F.when(F.coalesce("d", F.lit(0.0)) == 0, 1.0).otherwise(F.col("d"))).alias("dunn"))
