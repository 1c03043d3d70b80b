"""Cluster tables: sizes, per-cluster iSIM, summary ratios, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isim as I


def sizes(assigned: DataFrame) -> DataFrame:
    """label, size of each cluster of (fp_id, label)."""
    return assigned.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def size_stats(assigned: DataFrame) -> DataFrame:
    """One row: count, mean, min, quartiles (linear, truncated), max of cluster sizes, singletons, clusters above 10 and 100."""
    q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sizes(assigned).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("rows"), F.avg("size").alias("mean"), F.min("size").alias("min"),
        q[0].cast("long").alias("q25"), q[1].cast("long").alias("q50"), q[2].cast("long").alias("q75"), F.max("size").alias("max"),
        F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") > 10).alias("above_10"), F.count_if(F.col("size") > 100).alias("above_100"),
    )


def top_clusters(assigned: DataFrame, top: int = 20, min_size: int = 0) -> DataFrame:
    """label, size, rank of the largest clusters of at least ``min_size``."""
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "label"))
    largest = sizes(assigned).where(F.col("size") >= min_size).orderBy(F.desc("size"), "label").limit(top)
    return largest.withColumn("rank", rank)


def cluster_analysis(assigned: DataFrame, fps: DataFrame, n_features: int, top: int = 20, min_size: int = 0) -> DataFrame:
    """rank, label, size, percent (of all rows) and isim of the largest clusters."""
    from .summaries import linear_sums

    chosen = top_clusters(assigned, top, min_size)
    members = assigned.join(F.broadcast(chosen.select("label")), "label", "left_semi")  # at most ``top`` rows
    sums = linear_sums(members.join(fps.select("fp_id", "words"), "fp_id"), n_features, "label")
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    out = chosen.join(sums.select("label", I.isim_of(F.col("ls"), F.col("n")).alias("isim")), "label")
    return out.crossJoin(F.broadcast(total)).select("rank", "label", "size", (100 * F.col("size") / F.col("total")).alias("percent"), "isim")


def summary_ratios(assigned: DataFrame) -> DataFrame:
    """One row: clusters over rows, and the percentage of clusters that are single, above 10 and above 100."""
    share = lambda c: (100 * F.col(c) / F.col("clusters")).alias(f"{c}_percent")
    return size_stats(assigned).select("clusters", "rows", (F.col("clusters") / F.col("rows")).alias("clusters_per_row"), share("singletons"), share("above_10"), share("above_100"))


def top_offsets(assigned: DataFrame, top: int = 20, min_size: int = 0) -> DataFrame:
    """rank, label, n, start, stop: running ranges of the largest clusters, one after another."""
    chosen = top_clusters(assigned, top, min_size)
    stop = F.sum("size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # at most ``top`` rows
    return chosen.select("rank", "label", F.col("size").alias("n"), (stop - F.col("size")).alias("start"), stop.alias("stop"))


def population(assigned: DataFrame, top: int = 20) -> DataFrame:
    """What a plot of cluster sizes shows: rank, size and the running share of all rows of the largest clusters."""
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    run = F.sum("size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return top_clusters(assigned, top).withColumn("run", run).join(F.broadcast(total), F.lit(True)).select("rank", "size", (F.col("run") / F.col("total")).alias("share"))


def distinct_kinds(assigned: DataFrame, kinds: DataFrame) -> DataFrame:
    """label, n_kinds: how many different values of kinds(fp_id, kind), such as scaffolds, a cluster holds."""
    each = assigned.join(kinds.select("fp_id", "kind"), "fp_id").select("label", "kind").distinct()
    return each.groupBy("label").agg(F.count("kind").alias("n_kinds"))


def folds(assigned: DataFrame, k: int) -> DataFrame:
    """fp_id, label, fold: whole clusters go to folds, by label in turn."""
    return assigned.withColumn("fold", (F.col("label") % k).cast("int"))


def dense_offsets(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, n, start, stop: running ranges of groups in order (of files, of top clusters)."""
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    stop = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return n.select(group, "n", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """+ batch: consecutive runs of ``size`` rows of a dense, zero-based order column."""
    return rows.withColumn("batch", F.floor(F.col(order) / size).cast("long"))
