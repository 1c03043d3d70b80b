"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in pseudo-random order, repeated up to ``max_epochs``
times.  A copy of a document has a virtual finish time: the words of its source up to and
including it, divided by the source's target.  All copies are range-ordered by that time and the
order is truncated where the running total would pass the budget (all words of the corpus).

Running totals over a source (which may hold a third of all rows) or over everything are never
one task's work: rows fall into ranges of the order, the sums of ranges are prefix-summed in two
levels, and only the rows of one small range are ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

#: Rows aimed at in one range of the order.
RANGE_ROWS = 128
#: Most sources whose table is broadcast; with more, it is joined by shuffling.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"
#: Stands for a null id.
NULL_ID = -(1 << 63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(*parts: Column) -> Column:
    """60 pseudo-random bits of the parts, the same in every run."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size) -> + rank, weight, target.

    Weights go round by code point of the source (null last).  Shares of the total of all sizes
    are by weight; a target stops at ``max_epochs`` times its source's size and the excess is
    reshared by weight.  With sources ordered by cap/weight that level has a closed form: the
    first position whose level (total less the caps before it, over the weights from it on) is
    not above its own cap/weight.  One row per source: a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("long")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    asc = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(asc.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (total - before).cast("double") / after).withColumn("pos", F.row_number().over(asc))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("pos", "level"))).over(Window.partitionBy())
    return level.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * first["level"])).select("source", "source_size", "rank", "weight", "target")


def _prefix(sums: DataFrame, keys: list[str], bits: int, value: str) -> DataFrame:
    """sums(keys, bucket, value) -> + before: the total of smaller buckets of the same keys, in two levels."""
    coarse = F.shiftright("bucket", (bits + 1) // 2).alias("coarse")
    fine = sums.withColumn("coarse", coarse)
    top = fine.groupBy(*keys, "coarse").agg(F.sum(value).alias("v"))
    wide = Window.partitionBy(*keys).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*keys, "coarse", F.coalesce(F.sum("v").over(wide), F.lit(0)).alias("base"))
    narrow = Window.partitionBy(*keys, "coarse").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = fine.withColumn("inner", F.coalesce(F.sum(value).over(narrow), F.lit(0)))
    return inner.join(top, [*keys, "coarse"]).withColumn("before", F.col("base") + F.col("inner")).drop("coarse", "base", "inner")


def _time_bucket(vft: Column, bits: int) -> Column:
    """A whole number that never falls as vft grows; even steps below 2, octaves beyond."""
    n = 1 << bits
    return F.when(vft < 2, F.floor(vft * (n // 2))).otherwise(n + F.floor(F.log2(F.greatest(vft, F.lit(2.0))) * 64)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words the mix takes).

    Null texts and texts of white space only have size 0 and take 0.  A null source is a source
    of its own, last in the order.  Repeated ids are rows like any others.  No rows in: no rows out.
    Ties of the finish time go by source, copy, hash, id and size.  Extra columns play no part.
    ``taken`` is ``size`` times the number of copies taken, 0 to ``max_epochs``.
    """
    # what a row is ordered by covers its text too, so that repeated ids spread
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col)).alias("h")))
    n = rows.count()
    info = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    found = info.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    small = F.broadcast(info) if found[0] <= BROADCAST_SOURCES else info
    budget = found[1]
    bits = max(1, math.ceil(math.log2(max(2, n / RANGE_ROWS))))
    rows = rows.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("v"))
    before = _prefix(sums, ["rank"], bits, "v").select("rank", "bucket", "before")
    within = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.join(before, ["rank", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    queued = cut(queued.select("doc_id", "source", "size", "source_size", "target", "rank", "h", "upto"))

    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    vft = lambda e: (F.col("source_size") * e + F.col("upto")).cast("double") / F.col("target")
    live = queued.where("size > 0 AND target > 0").withColumn("e", F.explode(epochs)).withColumn("vft", vft(F.col("e"))).withColumn("bucket", _time_bucket(F.col("vft"), bits))
    times = cut(_prefix(live.groupBy("bucket").agg(F.sum("size").alias("v")).withColumn("one", F.lit(1)), ["one"], bits, "v"))
    edge = times.where(F.col("before") + F.col("v") > budget).orderBy("bucket").limit(1).collect()
    if edge:
        full = Window.orderBy("vft", "rank", "e", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        inside = live.where(F.col("bucket") == edge[0]["bucket"]).withColumn("run", F.sum("size").over(full) + F.lit(edge[0]["before"]))
        last = inside.where(F.col("run") <= budget).agg(F.max(F.struct("vft", "rank", "e", "h", "doc_id", "size")).alias("m")).first()["m"]
        here = F.struct(*[F.lit(None).cast("double") if last is None else F.lit(last["vft"]), *[F.lit(None if last is None else last[k]).cast(t) for k, t in (("rank", "int"), ("e", "int"), ("h", "long"), ("doc_id", "long"), ("size", "long"))]])
        b = lambda e: _time_bucket(vft(e), bits)
        mine = lambda e: F.struct(vft(e), F.col("rank"), e, F.col("h"), F.col("doc_id"), F.col("size"))
        took = lambda e: (b(e) < edge[0]["bucket"]) | ((b(e) == edge[0]["bucket"]) & F.lit(last is not None) & (mine(e) <= here))
    else:
        took = lambda e: F.lit(True)
    copies = sum((F.when(took(F.lit(e)), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), copies * F.col("size")).otherwise(0).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "h")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with all their columns.

    Rows of equal id, text and source are interchangeable: together they appear as often as the mix
    takes them, dealt out evenly.  No row appears more than ``max_epochs`` times.
    """
    own, h, of, n, m, at = (fresh(c, docs) for c in ("mixed_id", "mixed_h", "mixed_source", "mixed_n", "mixed_m", "mixed_at"))
    source = options.get("source_col", "source")
    found = mix(docs, id_col, text_col, **options)
    keys = F.coalesce("doc_id", F.lit(NULL_ID)).alias(own), F.col("h").alias(h), F.xxhash64("source").alias(of)
    found = found.groupBy(*keys).agg(F.sum(F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0 END")).alias(n), F.count(F.lit(1)).alias(m)).where(F.col(n) > 0)
    rows = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(h, order_key(F.col(id_col), F.col(text_col))).withColumn(of, F.xxhash64(F.col(source).cast("string")))
    found = cut(found)
    single = rows.join(found.where(F.col(m) == 1), [own, h, of]).withColumn(at, F.lit(1))
    equal = found.where(F.col(m) > 1)
    if equal.limit(1).count():
        several = rows.join(equal, [own, h, of]).withColumn(at, F.row_number().over(Window.partitionBy(own, h, of).orderBy(h)))
        single = single.unionByName(several)
    each = F.expr(f"`{n}` div `{m}`") + (F.col(at) <= F.col(n) % F.col(m)).cast("long")
    return single.withColumn(n, each.cast("int")).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((rank - 1) % 3 + 1) AS ratio FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, rank) AS pos,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, pos) AS lv, (SELECT sum(source_size) FROM s) AS budget FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, rank, least(cap::DOUBLE, weight * lv) AS target, budget FROM l, f),
q AS (
  SELECT d.*, t.source_size, t.rank, t.target, t.budget, row_number() OVER () AS row,
    sum(size) OVER (PARTITION BY t.rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, (source_size * e + upto)::DOUBLE / target AS vft FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY vft, rank, e, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT row, count(*) AS n FROM r WHERE run <= budget GROUP BY row)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(k.n, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN k ON q.row = k.row
"""
