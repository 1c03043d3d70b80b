"""Line-per-molecule text files, fingerprints by a kind registry, and table sinks."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered


def read_smiles(spark: SparkSession, path: str, max_num: int = -1) -> DataFrame:
    """idx, smiles: lines of the text files at ``path``, files by name, lines in order; -1 means all.

    Lines are numbered by a range sort on file and place; splits of a file are read in order.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("smiles"))
    out = numbered(lines, ["file", "at"], "idx")
    return (out.where(F.col("idx") < max_num) if max_num >= 0 else out).select("idx", "smiles")


def _hashed(text: str, n: int, reach: int) -> np.ndarray:
    bits = np.zeros(n, np.uint8)
    for k in range(1, reach + 1):
        for i in range(len(text) - k + 1):
            bits[crc32(text[i : i + k].encode()) % n] = 1
    return bits


#: kind -> function of (text, n_features) to 0/1 bits, or None if the text is invalid.  Chemistry
#: toolkits register theirs here; the built-in kinds hash substrings and need none.
KINDS: dict[str, Callable[[str, int], np.ndarray | None]] = {
    "substrings4": lambda t, n: _hashed(t, n, 4) if re.fullmatch(r"[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+", t) else None,
    "substrings6": lambda t, n: _hashed(t, n, 6) if re.fullmatch(r"[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+", t) else None,
}


def fps_from_smiles(smiles: DataFrame, kind: str = "substrings4", n_features: int = 2048, skip_invalid: bool = False) -> DataFrame:
    """fp_id (idx), words; invalid texts raise, or have null words with ``skip_invalid`` (see ``invalid_ids``)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    make = KINDS[kind]

    @F.pandas_udf("array<long>")
    def words(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            bits = make(t.strip(), n_features) if t is not None else None
            if bits is None and not skip_invalid:
                raise ValueError(f"invalid: {t!r}")
            out.append(None if bits is None else np.packbits(np.pad(bits, (0, -n_features % 64))).view(">i8").astype(np.int64))
        return pd.Series(out)

    return smiles.select(F.col("idx").alias("fp_id"), words("smiles").alias("words"))


def valid(fps: DataFrame) -> DataFrame:
    return fps.where("words IS NOT NULL")


def invalid_ids(fps: DataFrame) -> DataFrame:
    return fps.where("words IS NULL").select("fp_id")


def write_assignments(found: DataFrame, path: str, smiles: DataFrame | None = None, check_valid: bool = True) -> None:
    """CSV of label (and smiles) in the order of rows.

    Smiles are joined by id; a different number of them, or an id without its line, raises, and so do
    rows without a label unless ``check_valid`` is off.
    """
    rows = found.select("fp_id", F.col("label").alias("assignments"))
    if check_valid and rows.where("assignments IS NULL OR assignments < 1").limit(1).count():
        raise ValueError("there are rows without a label")
    if smiles is not None:
        both = rows.join(smiles.select(F.col("idx").alias("fp_id"), "smiles"), "fp_id", "full")
        if both.where("assignments IS NULL OR smiles IS NULL").limit(1).count():
            raise ValueError("assignments and smiles must have the same ids")
        rows = both
    rows.orderBy("fp_id").drop("fp_id").write.csv(path, header=True)


def write_metrics(table: DataFrame, path: str) -> None:
    """CSV of a cluster table of a bounded number of rows, in order of rank."""
    table.orderBy("rank").coalesce(1).write.csv(path, header=True)


def write_run(spark: SparkSession, path: str, settings: dict, seconds: dict[str, float]) -> None:
    """Settings and timings of a run as two small JSON tables."""
    spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    spark.createDataFrame(list(seconds.items()), "step string, seconds double").coalesce(1).write.mode("overwrite").json(f"{path}/timings")


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Parquet: a cluster table is its own saved tree; refitting from it is loading."""
    clusters.write.parquet(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
