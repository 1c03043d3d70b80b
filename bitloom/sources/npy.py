"""Fingerprint matrices in .npy files: scan, header statistics, sink, reshaping.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do; global ids
run over files in the order of their names.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import cut, numbered
from ..operators.pairs import small

#: Bytes of a header that are looked at (its length field included).
HEADER = 512
#: Rows packed at a time into pieces of exported files; bytes that the driver passes on at a time.
PIECE, PASSED = 4096, 16 << 20


def _header(data: bytes) -> tuple[tuple[int, ...], np.dtype, int]:
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran:
        raise ValueError("column-major files aren't fingerprint matrices")
    return shape, dtype, f.tell()


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, rows, width, dtype, valid of each .npy file of a folder (or one file); bodies aren't parsed.

    Valid: two dimensions of whole numbers.
    """

    def info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shape, dtype, _ = _header(r.head)
                ok = len(shape) == 2 and np.issubdtype(dtype, np.integer)
                out.append((r.path, shape[0] if shape else 0, shape[1] if len(shape) > 1 else 0, str(dtype), ok))
            yield pd.DataFrame(out, columns=["path", "rows", "width", "dtype", "valid"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", F.substring("content", 1, HEADER).alias("head")).mapInPandas(info, "path string, rows long, width long, dtype string, valid boolean")


def file_ranges(info: DataFrame, max_rows: int | None = None) -> DataFrame:
    """+ start, stop: global id range of each file, by name; a window over one row per file."""
    rows = F.least("rows", F.lit(max_rows)) if max_rows is not None else F.col("rows")
    stop = F.sum("rows").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return info.withColumn("rows", rows.cast("long")).withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("rows"))


def read_npy(spark: SparkSession, path: str, n_features: int | None = None, packed: bool = True, max_rows: int | None = None) -> DataFrame:
    """fp_id, file, words of all rows of the .npy files at ``path``; ``max_rows`` is a head limit per file.

    Packed rows hold 8 bits a byte, most significant first; ``n_features`` below that width cuts the
    tail.  Unpacked rows hold 0/1.  A wrong shape, width or dtype raises, and so does no file at all.
    """
    ranges = file_ranges(cut(file_info(spark, path)), max_rows)  # heads are read once
    facts = ranges.agg(F.count(F.lit(1)).alias("files"), F.min("width").alias("lo"), F.max("width").alias("hi"), F.count_if(~F.col("valid")).alias("bad")).first()
    if not facts["files"]:
        raise FileNotFoundError(f"no .npy file at {path}")
    if facts["bad"] or facts["lo"] != facts["hi"]:
        raise ValueError("fingerprint files must be two-dimensional, of whole numbers and of one width")
    width = facts["hi"] * 8 if packed else facts["hi"]
    if n_features is not None and (n_features > width or not packed and n_features != width):
        raise ValueError(f"{n_features} features of rows of {width}")
    bits_wanted = n_features or width

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                shape, dtype, at = _header(r.content[:HEADER])
                a = np.frombuffer(r.content, dtype, shape[0] * shape[1], at).reshape(shape)[: r.rows]
                for lo in range(0, len(a), 8192):
                    part = a[lo : lo + 8192]
                    bits = np.unpackbits(part.astype(np.uint8), axis=1) if packed else part.astype(np.uint8)
                    bits = np.pad(bits[:, :bits_wanted], ((0, 0), (0, -bits_wanted % 64)))
                    words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
                    yield pd.DataFrame({"fp_id": np.arange(r.start + lo, r.start + lo + len(part)), "file": r.path, "words": list(words)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    both = files.join(small(ranges.select("path", "rows", "start"), 0), "path")  # one row per file
    return both.mapInPandas(rows, "fp_id long, file string, words array<long>")


def gather(fps: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given global ids (fp_id), by id; an id that isn't there raises."""
    found = fps.join(ids.select("fp_id").distinct(), "fp_id")
    if found.count() != ids.select("fp_id").distinct().count():
        raise IndexError("an id is out of range")
    return found.orderBy("fp_id")


def write_npy(fps: DataFrame, path: str, n_features: int, rows_per_file: int = 1_000_000) -> None:
    """Export for other tools: .npy files of packed rows in id order, named by number.

    Workers pack rows into pieces of files, all in one job; the driver passes the pieces on, in order and a
    partition of about PASSED bytes at a time, to files of any store that Spark writes to.  It is an export: tables
    stay in Parquet otherwise.
    """
    spark, width = fps.sparkSession, (n_features + 7) // 8
    files, parts = max(1, PIECE // rows_per_file), -(-rows_per_file // PIECE)  # files of a lot, or lots of a file

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for file, rows in pdf.sort_values("at").groupby("file", sort=True):
            packed = np.stack(rows["words"].to_list()).astype(">i8").view(np.uint8)[:, :width]
            out.append((file, rows["at"].iloc[0], len(rows), packed.tobytes()))
        return pd.DataFrame(out, columns=["file", "at", "n", "content"])

    at = F.col("at")
    ordered = numbered(fps.select("fp_id", "words"), ["fp_id"], "at").withColumn("file", F.floor(at / rows_per_file).cast("long"))
    lot = F.floor(F.col("file") / files) if parts == 1 else F.col("file") * parts + F.floor(at % rows_per_file / PIECE)
    packed = cut(ordered.select(lot.cast("long").alias("lot"), "file", "at", "words").groupBy("lot").applyInPandas(pieces, "file long, at long, n long, content binary"))
    sizes = {r["file"]: r["n"] for r in packed.groupBy("file").agg(F.sum("n").alias("n")).collect()}  # a row a file
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    store, open_file, out = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), None, None
    in_order = packed.repartitionByRange(1 + sum(sizes.values()) * width // PASSED, "at").sortWithinPartitions("at")
    for r in in_order.select("file", "content").toLocalIterator():
        content = r["content"]
        if r["file"] != open_file:
            if out is not None:
                out.close()
            open_file = r["file"]
            out = store.create(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{open_file:06d}.npy"), False)
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, {"descr": "|u1", "fortran_order": False, "shape": (sizes[open_file], width)})
            content = head.getvalue() + content
        out.write(bytearray(content))
    if out is not None:
        out.close()


def split(fps: DataFrame, parts: int | None = None, max_rows: int | None = None) -> DataFrame:
    """+ part: consecutive chunks; exactly one of parts (2 or more) and rows per part is given."""
    if (parts is None) == (max_rows is None) or parts is not None and parts < 2:
        raise ValueError("give either parts (2 or more) or max_rows")
    size = max_rows or -(-fps.count() // parts)
    return fps.withColumn("part", F.floor(F.col("fp_id") / size).cast("long"))


def merge(tables: list[DataFrame]) -> DataFrame:
    """Tables one after another, ids renumbered to run on; each table's ids must be dense from 0."""
    out, start = None, 0
    for t in tables:
        own = t.withColumn("fp_id", F.col("fp_id") + start)
        out, start = own if out is None else out.unionByName(own), start + t.count()
    return out


def shuffle(fps: DataFrame, seed: int) -> DataFrame:
    """A seeded permutation: rows by a hash of id and seed, numbered anew from 0 (a global sort)."""
    ranked = numbered(fps.withColumn("h", F.xxhash64("fp_id", F.lit(seed))), ["h", "fp_id"], "new")
    return ranked.withColumn("fp_id", F.col("new")).drop("h", "new")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
