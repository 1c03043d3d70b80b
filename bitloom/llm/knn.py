"""Exact top-k inner-product search by a Voronoi join.

Integer vectors are lifted to ``(x, sqrt(M - |x|^2))``, M the largest squared norm: a query
``(q, 0)`` then has its highest inner products at its nearest lifted points.  Data and queries are
grouped by their nearest pivot.  Per cell a summary row keeps its size and its least and greatest
distance to the pivot; from the summaries alone each query group gets an upper bound on the
distance of its k-th neighbour, and only data blocks whose lower bound is not beyond it are sent to
the group.  Vectors travel packed, a block of them in a row; each (query block, data block)
meeting is solved by one matrix product in whole numbers, and a task keeps the k best of each of its
queries over all its meetings, so its output doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, ship, table

#: Vectors in a packed block (queries, data), and most pivots (their distances are a table of its square).
QUERY_BLOCK, DATA_BLOCK, MOST_PIVOTS = 1024, 2048, 512
#: Query blocks of a cell that meet data in one place.
CHUNK_BLOCKS = 16
#: Queries whose best candidates a task keeps before it hands them on.
HELD_QUERIES = 100_000
#: Vectors with whole components of at least this size are wide: they go the way of Python's integers.
MOST = 1 << 24
#: Vectors in a block there, and what makes scores positive (products of doubles' whole parts are less).
WIDE_BLOCK, OFFSET = 256, 1 << 2200


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of each component as double, and wide (array<double>).

    A vector with a component beyond MOST has null v and stands as ``wide``, scaled; others have null
    wide.  Left out: null ids and vectors, empty vectors, vectors with a component that is null or,
    scaled, no finite double.  Vectors of several lengths count as filled up with zeros.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * float(scale))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    narrow = F.forall("x", lambda c: F.abs(c) < float(MOST))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
    return rows.select("vec_id", F.when(narrow, F.transform("x", lambda c: F.floor(c).cast("long"))).alias("v"), F.when(~narrow, F.col("x")).alias("wide"))


def _as_matrix(vs, dims: int) -> np.ndarray:
    out = np.zeros((len(vs), dims), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _packed(rows: DataFrame, pivots: np.ndarray, dims: int, top: int, block: int, lifted: bool) -> DataFrame:
    """Blocks of vectors of one cell: cell, lo, hi (distances to the pivot), n, ids and matrix as bytes."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}

        def out(cell: int) -> pd.DataFrame:
            ids, m, d = (np.concatenate(x) for x in zip(*waiting.pop(cell), strict=True))
            return pd.DataFrame({"cell": [cell], "lo": [d.min()], "hi": [d.max()], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "m": [m.astype("<i4").tobytes()]})

        for pdf in batches:
            m = _as_matrix(pdf["v"].tolist(), dims)
            norm = (m * m).sum(axis=1)
            z = np.sqrt(np.maximum(top - norm, 0).astype(float)) if lifted else np.zeros(len(m))
            full = np.column_stack([m.astype(float), z])
            d2 = (full * full).sum(axis=1)[:, None] - 2 * full @ pivots.T + (pivots * pivots).sum(axis=1)
            cell = d2.argmin(axis=1)
            d = np.sqrt(np.maximum(((full - pivots[cell]) ** 2).sum(axis=1), 0))
            for c in np.unique(cell):
                mine = np.flatnonzero(cell == c)
                for at in range(0, len(mine), block):
                    part = mine[at : at + block]
                    held = waiting.setdefault(int(c), [])
                    held.append((pdf["vec_id"].to_numpy()[part], m[part], d[part]))
                    if sum(len(x[0]) for x in held) >= block:
                        yield out(int(c))
        for c in list(waiting):
            yield out(c)

    return rows.mapInPandas(blocks, "cell int, lo double, hi double, n long, ids binary, m binary").withColumn("block", F.monotonically_increasing_id())


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, exclude_same_id: bool = True, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest inner products with the data.

    Inputs are vec_id, v (array<long>) and, where v is null, wide (array<double>).  Ties go to the
    smaller vec_id; with fewer than k candidates all are returned; an empty side gives no rows.
    Repeated ids in the data are candidates of their own; of repeated query ids the smallest vector
    asks.  Ranks are exact for wide vectors too; a score that 64 bits don't hold is null.
    """
    if "wide" not in data.columns or not data.where("wide IS NOT NULL").union(queries.where("wide IS NOT NULL")).limit(1).count():
        return _packed_top_k(queries.select("vec_id", "v"), data.select("vec_id", "v"), k, exclude_same_id, data_block, query_block)
    data = cut(data)
    whole = F.coalesce("wide", F.col("v").cast("array<double>"))
    queries = cut(queries.groupBy("vec_id").agg(F.min(F.struct(whole.alias("x"), "v", "wide")).alias("q")).select("vec_id", "q.v", "q.wide"))
    narrow = lambda df: df.where("wide IS NULL").select("vec_id", "v")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[_key(int(s)) for s in pdf["score"]])

    schema = "query_id long, vec_id long, score long, key string"
    found = _packed_top_k(narrow(queries), narrow(data), k, exclude_same_id, data_block, query_block).select("query_id", "vec_id", "score").mapInPandas(keyed, schema)
    met = _blocks(narrow(queries).withColumn("wide", F.lit(None).cast("array<double>")), "q").crossJoin(_blocks(data.where("wide IS NOT NULL"), "d"))
    met = met.unionByName(_blocks(queries.where("wide IS NOT NULL"), "q").crossJoin(_blocks(data, "d")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ds, out = list(zip(*pickle.loads(r.d), strict=True)), []
                for qi, q in pickle.loads(r.q):
                    # vectors of several lengths: what one lacks is zero
                    all_ = [(-sum(a * b for a, b in zip(q, d)), i) for i, d in zip(*ds, strict=True) if not (exclude_same_id and i == qi)]
                    out += [(qi, i, -s if -(1 << 63) <= -s < 1 << 63 else None, _key(-s)) for s, i in sorted(all_)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "key"]).astype({"score": "Int64"})

    found = found.unionByName(met.select("q", "d").mapInPandas(solve, schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _key(score: int) -> str:
    """Text that sorts as the scores do."""
    return format(score + OFFSET, "0552x")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Pickled lists of (id, vector of Python integers)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import math
        import pickle

        for pdf in batches:
            each = [(int(i), [int(c) for c in v] if w is None else [math.floor(c) for c in w]) for i, v, w in zip(pdf["vec_id"], pdf["v"], pdf["wide"], strict=True)]
            for at in range(0, len(each), WIDE_BLOCK):
                yield pd.DataFrame({name: [pickle.dumps(each[at : at + WIDE_BLOCK])]})

    return cut(rows.select("vec_id", "v", "wide").mapInPandas(pack, f"{name} binary"))


def _packed_top_k(queries: DataFrame, data: DataFrame, k: int, exclude_same_id: bool, data_block: int, query_block: int) -> DataFrame:
    """top_k of vec_id, v alone."""
    bounded_batches(data.sparkSession)
    data = cut(data)
    queries = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    spark = data.sparkSession
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    facts = data.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    qdims = queries.agg(F.max(F.size("v"))).first()[0]
    if not facts["n"] or not qdims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = max(facts["dims"], qdims), int(facts["top"])
    # pivots: the vectors of smallest hash, a bounded sample; any pivots give the same result
    want = int(min(MOST_PIVOTS, max(1, round((facts["n"] / data_block) ** 0.5))))
    sample = data.select(F.xxhash64("vec_id", "v").alias("h"), "v").orderBy("h", "v").limit(want).collect()
    p = _as_matrix([r["v"] for r in sample], dims)
    pivots = np.column_stack([p.astype(float), np.sqrt(np.maximum(top - (p * p).sum(axis=1), 0).astype(float))])
    qs = cut(_packed(queries, pivots, dims, top, query_block, False))
    ds = cut(_packed(data, pivots, dims, top, data_block, True))

    sent = _sent(qs, ds, pivots, k + (data.groupBy("vec_id").count().agg(F.max("count")).first()[0] if exclude_same_id else 0), float(top))
    # query blocks of a cell in chunks: (cell, chunk) are as many keys as there are queries for
    turn = Window.partitionBy("cell").orderBy("block")
    chunk = F.floor((F.row_number().over(turn) - 1) / CHUNK_BLOCKS).alias("chunk")
    chunks = cut(qs.select("cell", "block", chunk))  # a row a block
    asked = qs.join(F.broadcast(chunks) if chunks.limit(200_001).count() <= 200_000 else chunks, ["cell", "block"])
    asked = asked.select(F.col("cell").alias("i"), "chunk", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    parts = chunks.groupBy(F.col("cell").alias("i")).agg(F.max("chunk").alias("last"))
    sent = sent.join(F.broadcast(parts), "i").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last")))  # a row a cell
    meet = sent.select("i", "chunk", "block").join(ds.select("block", F.col("ids").alias("d_ids"), F.col("m").alias("d_m")), "block")
    pairs = meet.join(asked, ["i", "chunk"]).select("q_block", "q_ids", "q_m", "d_ids", "d_m")
    nothing, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the k best so far of each query of this task, over all the data blocks it met
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for qi, ids, scores in held.values():
                there = ids != last
                yield pd.DataFrame({"query_id": np.repeat(qi, there.sum(axis=1)), "vec_id": ids[there], "score": scores[there]})
            held.clear()

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qi, di = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.d_ids, "<i8")
                q, d = (np.frombuffer(m, "<i4").reshape(-1, dims) for m in (r.q_m, r.d_m))
                order = np.argsort(di, kind="stable")  # then a stable sort by score leaves ties in id order
                di, d = di[order], d[order]
                _, ids, scores = held.setdefault(r.q_block, (qi, np.full((len(qi), k), last), np.full((len(qi), k), nothing)))
                exact = float(np.abs(q).max()) * float(np.abs(d).max()) * dims < 2**53
                for at in range(0, len(qi), 256):
                    own = q[at : at + 256]
                    s = (own.astype(float) @ d.T.astype(float)).astype(np.int64) if exact else own.astype(np.int64) @ d.T.astype(np.int64)
                    take = min(k, s.shape[1])
                    for i, row in enumerate(s, at):
                        if exclude_same_id:  # below any product
                            row[np.searchsorted(di, qi[i]) : np.searchsorted(di, qi[i], "right")] = nothing
                        edge = max(np.partition(row, len(row) - take)[len(row) - take], scores[i, -1], nothing + 1)
                        new = np.flatnonzero(row >= edge)
                        if len(new):
                            new = new[np.argsort(-row[new], kind="stable")][:k]
                            both_ids, both = np.concatenate([ids[i], di[new]]), np.concatenate([scores[i], row[new]])
                            # what stands for nothing has no negative; it sorts last all the same
                            best = np.lexsort((both_ids, -np.maximum(both, nothing + 1)))[:k]
                            ids[i], scores[i] = both_ids[best], both[best]
                if sum(len(x[0]) for x in held.values()) > HELD_QUERIES:
                    yield from out()
        yield from out()

    found = pairs.mapInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sent(qs: DataFrame, ds: DataFrame, pivots: np.ndarray, need: int, top: float) -> DataFrame:
    """i, block: the data blocks that may hold one of the ``need`` nearest of a query of cell i.

    From summaries alone: the cells nearest by their farthest vector bound how far the last of the
    nearest can be; a block goes where its nearest vector could be nearer than that.
    """
    spark = ds.sparkSession
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0))
    between = [(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    gaps = spark.createDataFrame(between, "i int, cell int, gap double")
    groups = qs.groupBy("cell").agg(F.max("hi").alias("reach")).withColumnRenamed("cell", "i")
    cells = ds.groupBy("cell").agg(F.max("hi").alias("hi"), F.sum("n").alias("n"))
    near = gaps.join(F.broadcast(groups), "i")  # no more rows than pivots
    far = F.col("reach") + F.col("gap") + F.col("hi")
    run = F.sum("n").over(Window.partitionBy("i").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, 0))
    bound = near.join(F.broadcast(cells), "cell").withColumn("far", far).withColumn("run", run).where(F.col("run") >= need).groupBy("i").agg(F.min("far").alias("bound"))
    slack = 1e-6 * (1 + top**0.5)  # rounding of the distances; products are compared exactly
    least = F.greatest(F.lit(0.0), F.col("gap") - F.col("reach") - F.col("hi"), F.col("lo") - F.col("reach") - F.col("gap"))
    limits = near.join(F.broadcast(bound), "i", "left")
    met = ds.select("block", "cell", "lo", "hi").join(F.broadcast(limits), "cell")  # the square of the pivots at most
    return met.where(F.col("bound").isNull() | (least <= F.col("bound") + slack)).select("i", "block")


def op8_knn(spark, sf_dir: str) -> DataFrame:
    rows = cut(whole_vectors(table(spark, sf_dir, "embeddings")))
    return top_k(rows.where("vec_id % 20 = 0"), rows)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, d.v)])::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


ship(__name__)
