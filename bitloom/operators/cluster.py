"""Clustering of fingerprint tables: one tree per group of rows, summaries merged over rounds.

A worker builds a tree over its group (``part``), of a bounded number of rows; what leaves it is
one summary row per cluster (n, column sums, members).  Rounds send batches of summaries, never
fingerprints, to further trees.  Members are kept out of those: a round maps summary ids to
summary ids, and memberships are joined at the end.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from . import merges, tree
from .merges import Accept
from .order import cut, numbered
from .summaries import medoids
from .tree import Entry, Tree, exploded, rebuild, regrouped

#: Rows of a group that one tree is built over, and summaries that the last tree of a run is built over.
PART_ROWS, LAST_SUMMARIES = 200_000, 200_000
#: Centroids up to which grouping by agglomeration is done (it takes the square of their number, in one task).
AGGLOMERATED = 5_000
LEAVES = "part long, pos long, dtype int, n long, ls array<long>, ids array<long>"


@dataclass(frozen=True)
class Params:
    """Settings of a tree; what a later step doesn't give stays as it was."""

    threshold: float = 0.65
    branching: int = 50
    merge: str | Accept = "diameter"
    tolerance: float = 0.05

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be within 0 and 1")
        if self.branching < 2:
            raise ValueError("branching must be 2 or more")
        merges.criterion(self.merge, self.tolerance)

    def tree(self, n_features: int) -> Tree:
        return Tree(n_features, self.threshold, self.branching, self.merge, self.tolerance)


#: Settings of the command line and of multi-round runs.
RUN = Params(threshold=0.30, branching=254)


@dataclass(frozen=True)
class Refine:
    """Take the ``n_largest`` clusters apart and insert everything anew, with changed settings if given."""

    n_largest: int = 1
    merge: str | Accept | None = None
    threshold_change: float = 0.0
    tolerance: float | None = None

    def apply(self, t: Tree, words_of) -> Tree:
        if self.n_largest < 0:
            raise ValueError("n_largest must not be negative")
        groups = exploded(t.clusters(), self.n_largest, words_of, t.n_features)
        t.set_merge(t.threshold + self.threshold_change, None, self.merge, self.tolerance)
        return rebuild(t, groups)


@dataclass(frozen=True)
class Recluster:
    """Insert all clusters anew, again and again, the threshold growing by ``extra`` each time.

    ``seed`` shuffles them, anew each time from the same seed; ``stop_early`` ends when no
    singletons are left or their number stays.
    """

    iterations: int = 1
    extra: float = 0.0
    seed: int | None = None
    stop_early: bool = False

    def apply(self, t: Tree, words_of) -> Tree:
        singles = -1
        for _ in range(self.iterations):
            entries = t.clusters()
            now = sum(e.n == 1 for e in entries)
            if self.stop_early and now in (0, singles):
                break
            singles = now
            t.set_merge(t.threshold + self.extra)
            if self.seed is not None:
                random.Random(self.seed).shuffle(entries)
            t = rebuild(t, regrouped(entries))
        return t


def packed_rows(words: pd.Series) -> np.ndarray:
    """Array column of words -> uint64 matrix in the kernel's byte order."""
    return np.stack([np.asarray(w, np.int64) for w in words]).astype(">i8").view(np.uint64)


def _rows(part: int, groups: dict[int, list[Entry]]) -> pd.DataFrame:
    flat = [(part, i, d, e.n, e.ls, e.ids) for i, (d, e) in enumerate((d, e) for d, es in groups.items() for e in es)]
    return pd.DataFrame(flat, columns=["part", "pos", "dtype", "n", "ls", "ids"])


def with_parts(fps: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """+ part: consecutive ranges of fp_id, of at most about ``rows`` rows."""
    return fps.withColumn("part", F.floor(F.col("fp_id") / rows).cast("long"))


def fit(fps: DataFrame, n_features: int, params: Params = Params(), steps: Sequence[Refine | Recluster] = (), part: str | None = None) -> DataFrame:
    """One row per cluster of each part's tree: part, pos, dtype, n, ls, ids (members in order of insertion).

    fps has fp_id, words and the column ``part`` (without one, all rows are one part).  Rows are
    inserted in the order of fp_id.  ``pos`` is the order of a rebuild: by counter width as first
    met, then by size, then by leaf order.  An empty table gives no clusters.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp_id", kind="stable")
        words, ids = packed_rows(pdf["words"]), pdf["fp_id"].to_numpy()
        t = params.tree(n_features)
        t.insert_words(words, ids.tolist())
        for step in steps:
            t = step.apply(t, lambda some: words[np.searchsorted(ids, some)])
        return _rows(int(pdf["part"].iloc[0]), regrouped(t.clusters()))

    rows = fps.select((F.lit(0) if part is None else F.col(part)).cast("long").alias("part"), "fp_id", "words")
    return rows.groupBy("part").applyInPandas(build, LEAVES)


def fit_all(fps: DataFrame, n_features: int, params: Params = Params(), steps: Sequence[Refine | Recluster] = (), rounds: Rounds | None = None, part_rows: int = PART_ROWS, one_tree: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clusters with label, assignments fp_id and label) of a table of any size.

    Up to ``part_rows`` rows are one tree, as they are with ``one_tree``.  More are a tree for each part
    of so many rows, and rounds that merge their summaries; ``steps`` are a matter of single trees,
    multi-round runs have their refinement in ``rounds``.
    """
    if one_tree or fps.limit(part_rows + 1).count() <= part_rows:
        found = labelled(fit(fps, n_features, params, steps))
        return found, assignments(found)
    parts = fps if "part" in fps.columns else with_parts(fps, part_rows)
    return multiround(parts, n_features, params, rounds or Rounds())


def fit_summaries(summaries: DataFrame, n_features: int, params: Params, order: Sequence[str], part: str = "part") -> DataFrame:
    """Trees over summary rows (bf_id, n, ls), each part's in the given order; ids are those of summaries."""
    names = [c.removeprefix("-") for c in order]
    up = [not c.startswith("-") for c in order]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, ascending=up, kind="stable")
        t = params.tree(n_features)
        for n, ls, i in zip(pdf["n"], pdf["ls"], pdf["bf_id"], strict=True):
            t.insert(Entry(int(n), np.array(ls, np.int64), [int(i)]))
        return _rows(int(pdf["part"].iloc[0]), regrouped(t.clusters()))

    rows = summaries.select(F.col(part).cast("long").alias("part"), "bf_id", "n", "ls", *[n for n in names if n not in ("part", "n", "bf_id")])
    return rows.groupBy("part").applyInPandas(build, LEAVES)


def labelled(leaves: DataFrame) -> DataFrame:
    """+ label: rank by size, the largest is 1, equals in the order of (part, pos).

    Only (part, pos, n) are sorted; the column sums and members stay where they are.
    """
    leaves = cut(leaves)
    rank = numbered(leaves.select("part", "pos", "n"), [F.desc("n"), F.asc("part"), F.asc("pos")], "label")
    return leaves.join(rank.select("part", "pos", (F.col("label") + 1).alias("label")), ["part", "pos"])


def assignments(clusters: DataFrame, global_labels: DataFrame | None = None) -> DataFrame:
    """fp_id, label of every member; with ``global_labels`` (label, global_label) that of its group of clusters."""
    out = clusters.select(F.explode("ids").alias("fp_id"), "label")
    if global_labels is None:
        return out
    return out.join(global_labels, "label").select("fp_id", F.col("global_label").alias("label"))


def members(clusters: DataFrame, in_order: bool = False) -> DataFrame:
    """label, ids: members in order of insertion, or ascending."""
    return clusters.select("label", F.array_sort("ids").alias("ids") if in_order else F.col("ids"))


def cluster_medoids(assigned: DataFrame, fps: DataFrame, n_features: int) -> DataFrame:
    """label, fp_id, words: the medoid of each cluster (or group of clusters) of assigned(fp_id, label)."""
    rows = assigned.join(fps.select("fp_id", "words"), "fp_id")
    found = medoids(rows, n_features, "label").withColumnRenamed("medoid_id", "fp_id")
    return found.join(fps.select("fp_id", "words"), "fp_id").select("label", "fp_id", "words")


def save(clusters: DataFrame, path: str, params: Params) -> None:
    """A cluster table and its settings; what ``load`` gives back goes on being refined, merged or inserted into."""
    if callable(params.merge):
        raise ValueError("a custom criterion can't be saved")
    clusters.write.parquet(f"{path}/clusters")
    rows = [(params.threshold, params.branching, params.merge, params.tolerance)]
    clusters.sparkSession.createDataFrame(rows, "threshold double, branching int, merge string, tolerance double").coalesce(1).write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Params]:
    """(clusters, settings) of ``save``."""
    return spark.read.parquet(f"{path}/clusters"), Params(**spark.read.parquet(f"{path}/settings").first().asDict())


def check_assignments(found: DataFrame, n: int) -> None:
    """Raise unless exactly n rows are assigned, each once."""
    got = found.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("fp_id").alias("ids")).first()
    if tuple(got) != (n, n):
        raise ValueError(f"{got['rows']} assignments of {got['ids']} rows; there are {n}")


def cluster_centroids(clusters: DataFrame, n_features: int) -> DataFrame:
    """+ words: majority centroid of each cluster."""
    bits = F.when(F.col("n") <= 1, F.transform("ls", lambda k: k.cast("int"))).otherwise(B.centroid_bits(F.col("ls"), F.col("n")))
    return clusters.withColumn("words", B.pack(bits, n_features))


@dataclass(frozen=True)
class Rounds:
    """How summaries are merged over rounds."""

    bin_size: int = 10
    midsection: int = 1
    merge: str | Accept = "tolerance-diameter"
    final_merge: str | Accept | None = None
    threshold_change: float = 0.0
    refinement: str = "full"  # none, split or full, before the first merging round
    tolerance: float = 0.05
    split_largest: bool = False  # take the largest cluster of each batch apart after every midsection round
    last_summaries: int = LAST_SUMMARIES  # more midsection rounds until so few are left, or until they help no more


def multiround(fps: DataFrame, n_features: int, params: Params = RUN, rounds: Rounds = Rounds(), part: str = "part") -> tuple[DataFrame, DataFrame]:
    """(clusters, assignments): clusters has label, n, ls, ids (of the last round's summaries).

    Round 1 is a tree per part; each merging round takes batches of ``bin_size`` (part, counter
    width) pairs in order, wider counters first within a batch; the last round is one tree over all
    summaries that are left: midsection rounds go on until ``last_summaries`` are left or a round
    makes them hardly fewer.  Results don't depend on the number of executors.  Members of a cluster
    that is taken apart are inserted by fp_id.
    """
    if rounds.refinement not in ("none", "split", "full"):
        raise ValueError("refinement is none, split or full")
    first = replace(params, tolerance=0.05)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp_id", kind="stable")
        words, ids = packed_rows(pdf["words"]), pdf["fp_id"].to_numpy()
        t = first.tree(n_features)
        t.insert_words(words, ids.tolist())
        groups = regrouped(t.clusters())
        if rounds.refinement != "none":
            groups = exploded(t.clusters(), 1, lambda some: words[np.searchsorted(ids, some)], n_features)
        if rounds.refinement == "full":
            t.set_merge(params.threshold + rounds.threshold_change, None, rounds.merge, rounds.tolerance)
            groups = regrouped(rebuild(t, groups).clusters())
        return _rows(int(pdf["part"].iloc[0]), groups)

    rows = fps.select(F.col(part).cast("long").alias("part"), "fp_id", "words")
    leaves = cut(rows.groupBy("part").applyInPandas(build, LEAVES))
    bf_id = (F.shiftleft(F.col("part"), 32) + F.col("pos")).alias("bf_id")
    member = leaves.select(bf_id, F.explode("ids").alias("fp_id"))
    merging = Params(params.threshold + rounds.threshold_change, params.branching, rounds.merge, rounds.tolerance)
    done, left = 0, math.inf
    while True:
        if done >= rounds.midsection:
            before, left = left, leaves.limit(rounds.last_summaries + 1).count()
            if left <= rounds.last_summaries:
                break
            left = leaves.count()
            if left > 0.9 * before:
                break
        done += 1
        summaries = leaves.select(bf_id, "part", "pos", "dtype", "n", "ls")
        pairs = summaries.groupBy("part", "dtype").count()  # a few rows for each part
        number = F.row_number().over(Window.orderBy("part", "dtype")) - 1
        batches = pairs.select("part", "dtype", F.floor(number / rounds.bin_size).cast("long").alias("batch"))
        leaves = cut(fit_summaries(summaries.join(batches, ["part", "dtype"]).withColumn("was", F.col("part")), n_features, merging, ["-dtype", "was", "pos"], part="batch"))
        member = _regroup(member, leaves)
        if rounds.split_largest:
            leaves, member = _without_largest(leaves, member, fps, n_features)
    summaries = leaves.select(bf_id, F.lit(0).alias("all"), "part", "pos", "dtype", "n", "ls").withColumn("was", F.col("part"))
    last = replace(merging, merge=rounds.final_merge or rounds.merge)
    leaves = cut(fit_summaries(summaries, n_features, last, ["was", "dtype", "pos"], part="all"))
    clusters = labelled(leaves)
    member = _regroup(member, leaves).join(clusters.select(bf_id, "label"), "bf_id").select("fp_id", "label")
    return clusters, member


def _regroup(member: DataFrame, leaves: DataFrame) -> DataFrame:
    """Members of summaries -> members of the summaries that took them in."""
    to = leaves.select((F.shiftleft(F.col("part"), 32) + F.col("pos")).alias("to"), F.explode("ids").alias("bf_id"))
    return member.join(to, "bf_id").select(F.col("to").alias("bf_id"), "fp_id")


def _without_largest(leaves: DataFrame, member: DataFrame, fps: DataFrame, n_features: int) -> tuple[DataFrame, DataFrame]:
    """The largest cluster of each part taken apart into its fingerprints, behind all other summaries of the part."""
    bf_id = F.shiftleft(F.col("part"), 32) + F.col("pos")
    largest = leaves.where((F.col("pos") == 0) & (F.col("n") > 1))  # clusters come largest first
    gone = largest.select(bf_id.alias("bf_id"), "part").join(leaves.groupBy("part").agg((F.max("pos") + 1).alias("behind")), "part")
    apart = member.join(gone, "bf_id")
    turn = F.row_number().over(Window.partitionBy("part").orderBy("fp_id")) - 1  # rows of a cluster within a batch
    apart = apart.withColumn("pos", (F.col("behind") + turn).cast("long")).select("part", "pos", "fp_id")
    apart = cut(apart)
    bits = F.transform(B.unpack(F.col("words"), n_features), lambda b: b.cast("long"))
    singles = apart.join(fps.select("fp_id", "words"), "fp_id").select("part", "pos", F.lit(8).alias("dtype"), F.lit(1).cast("long").alias("n"), bits.alias("ls"), F.array(F.lit(-1).cast("long")).alias("ids"))
    kept = leaves.join(largest.select("part", "pos"), ["part", "pos"], "left_anti").select("part", "pos", "dtype", "n", "ls", "ids")
    stay = member.join(gone.select("bf_id"), "bf_id", "left_anti").select("bf_id", "fp_id")
    return cut(kept.unionByName(singles)), cut(stay.unionByName(apart.select(bf_id.alias("bf_id"), "fp_id")))


def partial_fit(summaries: DataFrame | None, fps: DataFrame, n_features: int, params: Params = Params()) -> DataFrame:
    """Online insertion: new fingerprints go into the tree of the stored clusters; the new cluster table.

    Stored clusters (n, ls, ids) are inserted first, in their order, then the rows by fp_id, which travel
    as packed words.  It is one tree, and so one task: a table that has outgrown ``PART_ROWS`` clusters
    is for ``multiround``.
    """
    longs = F.lit(None).cast("array<long>")
    rows = fps.select(F.lit(1).alias("kind"), F.col("fp_id").alias("pos"), F.lit(1).cast("long").alias("n"), longs.alias("ls"), "words", F.array("fp_id").alias("ids"))
    if summaries is not None:
        rows = summaries.select(F.lit(0).alias("kind"), "pos", "n", "ls", longs.alias("words"), "ids").unionByName(rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "pos"], kind="stable")
        t = params.tree(n_features)
        old = pdf[pdf["kind"] == 0]
        for n, ls, ids in zip(old["n"], old["ls"], old["ids"], strict=True):
            t.insert(Entry(int(n), np.array(ls, np.int64), list(ids)))
        new = pdf[pdf["kind"] == 1]
        if len(new):
            t.insert_words(packed_rows(new["words"]), new["pos"].tolist())
        return _rows(0, regrouped(t.clusters()))

    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(build, LEAVES)


def global_clusters(clusters: DataFrame, n_features: int, k: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """label, global_label (from 1): clusters grouped by their centroids with k-means (``kmeans-normalized``
    on unit vectors) of Spark ML, or by ``agglomerative`` merging (Ward's) of at most AGGLOMERATED of them; k is
    at most the number of clusters.  Joined by label, never by position."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    bits = F.transform("ls", lambda k: F.when(2 * k >= F.col("n"), 1.0).otherwise(0.0))
    rows = cut(clusters.select("label", bits.alias("bits"))).select("label", array_to_vector("bits").alias("features"))
    if method == "kmeans-normalized":
        rows = Normalizer(inputCol="features", outputCol="unit").transform(rows).select("label", F.col("unit").alias("features"))
    elif method not in ("kmeans", "agglomerative"):
        raise ValueError(f"unknown method {method!r}")
    k = min(k, rows.count())
    if method == "agglomerative":
        return _agglomerated(clusters.select("label", bits.alias("bits")), k)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="g").fit(rows) if k > 1 else None
    found = model.transform(rows) if model else rows.withColumn("g", F.lit(0))
    return found.select("label", (F.col("g") + 1).cast("long").alias("global_label"))


def _agglomerated(rows: DataFrame, k: int) -> DataFrame:
    """label, global_label: the two groups whose union raises the squared deviations least are merged until k are
    left; groups are numbered by their smallest label."""
    if rows.limit(AGGLOMERATED + 1).count() > AGGLOMERATED:
        raise ValueError(f"more than {AGGLOMERATED} clusters; group them with k-means")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        x = np.stack(pdf["bits"].to_list()).astype(float)
        n, group, live = np.ones(len(x)), np.arange(len(x)), np.ones(len(x), bool)
        square = (x * x).sum(axis=1)
        cost = (square[:, None] + square[None] - 2 * x @ x.T) / 2  # of merging two single ones
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(x) - k):
            i, j = divmod(int(cost.argmin()), len(x))
            i, j = min(i, j), max(i, j)
            # cost of any third group with the union, from those with its halves
            new = ((n[i] + n) * cost[i] + (n[j] + n) * cost[j] - n * cost[i, j]) / (n[i] + n[j] + n)
            live[j] = False
            new[~live] = new[i] = np.inf
            cost[i], cost[:, i], cost[j], cost[:, j] = new, new, np.inf, np.inf
            n[i] += n[j]
            group[group == j] = i
        return pd.DataFrame({"label": pdf["label"].to_numpy(np.int64), "global_label": np.unique(group, return_inverse=True)[1] + 1})

    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(merge, "label long, global_label long")


def threshold_rule(mean_isim: float, std: float, factor: float = 4.0) -> float:
    """A starting threshold: mean similarity and some standard deviations more, within 0 and 1."""
    return min(max(mean_isim + factor * std, 0.0), 1.0) if not math.isnan(mean_isim) else 0.0


for _module in (merges, tree, sys.modules[__name__]):  # workers need not have the package
    cloudpickle.register_pickle_by_value(_module)
