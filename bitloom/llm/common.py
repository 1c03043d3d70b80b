"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Most edges whose components one task finds (some 100 bytes of its memory each); more take rounds of joins.
FEW_EDGES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="bitloom-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a table in the shared folder.

    It cuts the lineage and survives lost executors like checkpoint(), but the plan starts anew from
    a plain scan: nothing that the optimizer had inferred about the old plan is carried along, which
    loops would pile up on the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("cut-"):
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the driver drop plans, broadcasts and shuffles of steps that are over.

    Spark's cleaner waits for the JVM to collect them, and the JVM rather grows its heap first.
    """
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The frame, marked for broadcast only if it has at most ``rows`` (narrow) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, df: DataFrame) -> str:
    """The name, or one like it, that no column of df has (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() would change other alphabets too)."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def _components_in_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of edges (a, b) -> one batch (id, component): roots hook to the smallest root next door, until none is left."""
    pairs = [np.zeros((2, 0), np.int64), *[np.stack([pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)]) for pdf in batches]]
    ends = np.concatenate(pairs, axis=1)
    ids, at = np.unique(ends.ravel(), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            yield pd.DataFrame({"id": ids, "component": ids[root]})
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def union_components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b: long) as (id, component), component the smallest id reachable.

    Up to ``FEW_EDGES`` distinct edges go through one task: rounds of joins cost the driver some hundreds of
    plans and stages, whatever the number of edges.  More edges take the rounds; the result is the same.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() <= FEW_EDGES:
        found = cut(edges.coalesce(1).mapInPandas(_components_in_one, "id long, component long"))
    else:
        found = _components_in_rounds(edges)
    discard(edges)
    return found


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    """The same for any number of distinct edges.

    Every vertex has a parent, at first its smallest neighbour or itself.  Each round hooks the
    parent of a vertex, and the vertex itself, to the smallest grandparent next door and halves all
    paths, until no grandparent changes: a logarithmic number of rounds in practice.  Only minima
    per vertex are aggregated (map-side combined), so a vertex that holds a third of all edges is
    no burden.  Nothing reaches the driver but a flag a round.
    """
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
    up = lambda f: f.join(f.select(F.col("id").alias("p"), F.col("p").alias("g")), "p").select("id", "p", "g")
    first = cut(parent)
    state = cut(up(first))
    discard(first)
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("near"))
        seen = state.join(near.withColumnRenamed("a", "id"), "id").select("id", "p", "g", F.least("g", "near").alias("near"))
        hooks = seen.select(F.inline(F.array(F.struct(F.col("p").alias("id"), F.col("near").alias("p")), F.struct(F.col("id"), F.col("near").alias("p")))))
        parent = cut(hooks.groupBy("id").agg(F.min("p").alias("p")))
        new = up(parent)
        new = cut(new.join(state.select("id", F.col("g").alias("old")), "id").select("id", "p", "g", (F.col("g") != F.col("old")).alias("moved")))
        discard(parent, state)
        state = new.select("id", "p", "g")
        if not new.where("moved").limit(1).count():
            discard(both)
            return state.select("id", F.col("g").alias("component"))


def bounded_batches(spark: SparkSession, bytes_per_batch: int = 4 << 20) -> None:
    """Batches to Python workers end by size too, not by rows alone: texts and packed rows can be long.

    The setting holds from here on, as plans run later than they are made; a smaller one of the caller's stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).removesuffix("b"))
    if not 0 < now <= bytes_per_batch:
        spark.conf.set(name, str(bytes_per_batch))


def ship(module: str) -> None:
    """Functions of this module go to Python workers by value: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
