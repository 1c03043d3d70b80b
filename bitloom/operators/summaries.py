"""Aggregations over fingerprint tables: column sums, iSIM, centroids, medoids, sampling.

A fingerprint table has ``fp_id``, ``words`` and any grouping columns.  Column sums come from one
row per word (not per bit), 64 sums wide, with map-side partial aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import isim as I
from .order import cut, numbered


def _by(cols: list[str] | str | None) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols or [])


def word_sums(fps: DataFrame, by: list[str] | str | None = None) -> DataFrame:
    """by, w, n, k: for each word the array of its 64 column sums."""
    keys = _by(by)
    each = fps.select(*keys, F.posexplode("words").alias("w", "word"))
    sums = [F.expr(f"sum(CAST(getbit(word, {63 - i}) AS BIGINT)) AS k{i}") for i in range(64)]
    grouped = each.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"), *sums)
    return grouped.select(*keys, "w", "n", F.array(*[f"k{i}" for i in range(64)]).alias("k"))


def linear_sums(fps: DataFrame, n_features: int, by: list[str] | str | None = None) -> DataFrame:
    """by, n, ls: number of fingerprints and array of column sums of each group (one row in all without groups)."""
    keys = _by(by)
    rows = word_sums(fps, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("w", "k"))).alias("parts"))
    flat = F.slice(F.flatten(F.transform("parts", lambda p: p["k"])), 1, n_features)
    return rows.select(*keys, "n", flat.alias("ls"))


def merge_sums(sums: DataFrame, by: list[str] | str | None = None) -> DataFrame:
    """by, n, ls of the unions of summaries (n, ls): element by element, combined before the shuffle."""
    keys = _by(by)
    each = sums.select(*keys, "n", F.posexplode("ls").alias("pos", "k")).groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rows = each.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("parts"))  # a number for each feature
    return rows.select(*keys, "n", F.transform("parts", lambda p: p["k"]).alias("ls"))


def isims(fps: DataFrame, by: list[str] | str | None = None) -> DataFrame:
    """by, n, isim.  Squares are summed per word first, so no array of column sums is ever built."""
    keys = _by(by)
    s = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate("k", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    part = word_sums(fps, keys).select(*keys, "n", s.alias("s"), q.alias("q"))
    total = part.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("s").alias("s"), F.sum("q").cast("decimal(38,0)").alias("q"))
    return total.select(*keys, "n", I.isim(F.col("n"), F.col("s"), F.col("q")).alias("isim"))


def centroids(sums: DataFrame) -> DataFrame:
    """+ centroid: array of majority bits."""
    bits = F.when(F.col("n") <= 1, F.transform("ls", lambda k: k.cast("int"))).otherwise(B.centroid_bits(F.col("ls"), F.col("n")))
    return sums.withColumn("centroid", bits)


def radii(sums: DataFrame) -> DataFrame:
    """+ isim, diameter (1 - isim), radius_complement, radius (1 - it)."""
    c = I.radius_complement(F.col("ls"), F.col("n"))
    d = I.isim_of(F.col("ls"), F.col("n"))
    return sums.withColumns({"isim": d, "diameter": 1 - d, "radius_complement": c, "radius": 1 - c})


def _on_sum(words: Column, ls: Column, n_features: int) -> Column:
    """Sum of the column sums at a fingerprint's set bits."""
    return F.aggregate(F.zip_with(B.unpack(words, n_features), ls, lambda b, k: b * k), F.lit(0).cast("long"), lambda a, x: a + x)


def complementary_isims(fps: DataFrame, n_features: int, by: list[str] | str | None = None) -> DataFrame:
    """The rows of fps + comp_isim: iSIM of their group without them; NaN in groups of fewer than three.

    Taking a row out changes the sums in closed form: s - |row| and q - 2 * (sums at its bits) + |row|.
    The group's sums (one row a group) are joined back.
    """
    keys = _by(by)
    sums = linear_sums(fps, n_features, keys)
    s, q = I.sums(F.col("ls"))
    sums = sums.withColumns({"s_": s, "q_": q}).withColumnRenamed("n", "n_")
    both = fps.join(sums, keys) if keys else fps.crossJoin(F.broadcast(sums))  # a single row
    card, on = B.popcount(F.col("words")), _on_sum(F.col("words"), F.col("ls"), n_features)
    rest = I.isim(F.col("n_") - 1, F.col("s_") - card, F.col("q_") - 2 * on + card)
    out = F.when(F.col("n_") < 3, F.lit(float("nan"))).otherwise(rest)
    return both.withColumn("comp_isim", out).drop("ls", "s_", "q_", "n_")


def medoids(fps: DataFrame, n_features: int, by: list[str] | str | None = None) -> DataFrame:
    """by, medoid_id: the first fingerprint of least complementary iSIM; the first of all in groups of one or two."""
    keys = _by(by)
    rows = complementary_isims(fps, n_features, keys)
    # minima of structs: mergeable, and ties go to the smaller id
    order = F.struct(F.when(F.isnan("comp_isim"), 0.0).otherwise(F.col("comp_isim")).alias("c"), F.col("fp_id"))
    return rows.groupBy(*keys).agg(F.min(order)["fp_id"].alias("medoid_id"))


def most_dissimilar(fps: DataFrame, n_features: int, by: list[str] | str | None = None) -> DataFrame:
    """by, fp_1, fp_2: the fingerprint least similar to the centroid, and the one least similar to it."""
    keys = _by(by)
    c = centroids(linear_sums(fps, n_features, keys)).select(*keys, B.pack(F.col("centroid"), n_features).alias("probe"))
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  a single row
    least = lambda df: df.groupBy(*keys).agg(F.min(F.struct(B.jt_words(F.col("words"), F.col("probe")).alias("s"), F.col("fp_id"), F.col("words"))).alias("m"))
    one = least(join(fps.select(*keys, "fp_id", "words"), c)).select(*keys, F.col("m.fp_id").alias("fp_1"), F.col("m.words").alias("probe"))
    two = join(fps.select(*keys, "fp_id", "words"), one.select(*keys, "fp_1", "probe"))
    return two.groupBy(*keys, "fp_1").agg(F.min(F.struct(B.jt_words(F.col("words"), F.col("probe")).alias("s"), F.col("fp_id"))).alias("m")).select(*keys, "fp_1", F.col("m.fp_id").alias("fp_2"))


def stratified_sample(fps: DataFrame, n_features: int, strata: int) -> DataFrame:
    """stratum, fp_id: rows ordered by complementary iSIM, cut into even strata, the first of each.

    No strata: no rows; more strata than rows is an error.
    """
    rows = complementary_isims(fps, n_features).select("fp_id", "comp_isim")
    if strata == 0:
        return rows.select(F.lit(0).alias("stratum"), "fp_id").limit(0)
    n = fps.count()
    if n < strata:
        raise ValueError(f"{strata} strata of {n} rows")
    # the sizes of ntile, without its single task: the first n % strata have one row more
    q, more = divmod(n, strata)
    at = F.col("at")
    stratum = F.when(at < more * (q + 1), F.floor(at / (q + 1))).otherwise(more + F.floor((at - more * (q + 1)) / q))
    tile = numbered(rows, ["comp_isim", "fp_id"], "at").withColumn("stratum", (stratum + 1).cast("long"))
    return tile.groupBy("stratum").agg(F.min(F.struct("comp_isim", "fp_id"))["fp_id"].alias("fp_id"))


def jt_std(fps: DataFrame, n_features: int, samples: int | None = None) -> DataFrame:
    """jt_std: population standard deviation of all pairwise similarities of a stratified sample."""
    from .pairs import similarity_pairs, small

    if samples is None:
        samples = max(fps.count() // 1000, 50)
    chosen = cut(stratified_sample(fps, n_features, samples))
    few = cut(fps.join(small(chosen.select("fp_id"), 0), "fp_id", "left_semi"))  # as many rows as strata
    return similarity_pairs(few).agg(F.stddev_pop("jt").alias("jt_std"))
