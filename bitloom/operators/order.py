"""Dense numbering of a table in an order, without bringing the table into one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's folder for checkpoints; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="bitloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a table in the shared folder; the plan starts anew from a scan."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """+ name: 0, 1, 2, ... in the order.  A range sort, then each range's first number from the
    ranges' sizes (one row per range)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = sorted_.withColumn("at_", F.monotonically_increasing_id())
    at = cut(at.withColumn("range_", F.shiftright("at_", 33)).withColumn("at_", F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = at.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    start = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range_", start.alias("start_"))
    return at.join(F.broadcast(starts), "range_").withColumn(name, F.col("start_") + F.col("at_")).drop("range_", "at_", "start_")  # as many rows as partitions
