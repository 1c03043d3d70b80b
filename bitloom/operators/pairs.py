"""Pairwise operators: similarity pairs and matrices, neighbours, nearest centroids.

All pairs of a table are quadratic by definition.  Pairs of fingerprints are made by workers, a tile at a
time: rows are dealt into blocks in the order of (popcount, fp_id), two blocks are a tile, and NumPy
compares them.  Tiles hold few different similarities and ids, so that columnar files of all pairs take
about a byte a row.  Joins on summaries (``meet``) broadcast a side that is small in bytes; beyond that,
rows fall into blocks, and blocks of both sides meet under keys of their own, so no key grows with the table.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from .order import cut, numbered

#: Bytes of a side that is broadcast, and of a row's columns besides its array.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Rows of a block, where all rows of a table meet all others.
BLOCK_ROWS = 20_000
#: Rows of a side of a tile at most; the tiles along a table's side if they have RUN_ROWS rows; tasks that tiles are dealt to at most.
SIDE_ROWS, SIDES, TASKS = 10_080, 12, 10_000
#: Rows whose pairs with one row stand together in all pairs (63 groups of 8: Parquet's longest packed run, so that
#: equal runs compress); pairs that are computed at a time.
RUN_ROWS, AT_ONCE = 504, 1 << 17
FOUND = ("id_1", "id_2", "jt")


def _row_bytes(df: DataFrame, elements: int) -> int:
    """Bytes of a row whose arrays have up to ``elements`` numbers."""
    return ROW_BYTES + 8 * elements * sum(t.startswith("array") for _, t in df.dtypes)


def fits(df: DataFrame, elements: int = 32) -> bool:
    """Whether the frame, with arrays of so many numbers, is small enough to broadcast; it counts up to the limit."""
    rows = BROADCAST_BYTES // _row_bytes(df, elements)
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, elements: int = 32) -> DataFrame:
    """The frame, marked for broadcast only if it is small in bytes."""
    return F.broadcast(df) if fits(df, elements) else df


def blocks(n: int) -> int:
    return max(1, math.ceil(n / BLOCK_ROWS))


def meet(a: DataFrame, b: DataFrame, id_a: str, id_b: str, on: Column, elements: int = 32) -> DataFrame:
    """Rows of a with rows of b for which ``on`` holds.

    b is broadcast if it is small; else each row of a stands in one row of blocks and each of b in one
    column, and every cell of that square is a join key.
    """
    if fits(b, elements):
        return a.join(F.broadcast(b), on)
    sa, sb = blocks(a.count()), blocks(b.count())
    turn = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = a.withColumn("block_a", turn(id_a, sa)).withColumn("block_b", every(sb))
    right = b.withColumn("block_b", turn(id_b, sb)).withColumn("block_a", every(sa))
    return left.join(right, ["block_a", "block_b"]).where(on).drop("block_a", "block_b")


def _jt():
    return B.jt(B.intersection(F.col("words_1"), F.col("words_2")), F.col("card_1"), F.col("card_2"))


class Blocks:
    """Fingerprints in the order of (popcount, fp_id), in blocks of equal size: block, ids, words (one after another)."""

    def __init__(self, fps: DataFrame):
        rows = cut(fps.select("fp_id", "words", B.popcount(F.col("words")).alias("card")))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("words")).alias("width")).first()
        self.n, self.width, self.id_type = facts["n"], max(1, facts["width"] or 1), dict(rows.dtypes)["fp_id"]
        side = min(SIDE_ROWS, max(RUN_ROWS, -(-self.n // SIDES)))
        self.count = -(-self.n // side)
        at = numbered(rows, ["card", "fp_id"], "at")
        own = F.sort_array(F.collect_list(F.struct("at", "fp_id", "words")))  # of a block's rows
        found = at.groupBy(F.floor(F.col("at") / side).cast("long").alias("block")).agg(own.alias("own"))
        self.rows = cut(found.select("block", F.transform("own", lambda r: r["fp_id"].cast("long")).alias("ids"), F.flatten(F.transform("own", lambda r: r["words"])).alias("words")))

    def side(self, key: str, tag: str) -> DataFrame:
        return self.rows.select(F.col("block").alias(key), F.col("ids").alias(f"ids_{tag}"), F.col("words").alias(f"words_{tag}"))

    def small(self) -> bool:
        return self.n * (ROW_BYTES + 8 * self.width) <= BROADCAST_BYTES


def _tiles(a: Blocks, b: Blocks, upper: bool = False) -> DataFrame:
    """i, j and both blocks, for all pairs of blocks, or those with i <= j."""
    one, two = a.side("i", "1"), b.side("j", "2")
    if a.small() and b.small():
        n = a.count * b.count
        cells = a.rows.sparkSession.range(0, n, 1, max(1, min(n, TASKS))).select(F.expr(f"id div {max(1, b.count)}").alias("i"), (F.col("id") % max(1, b.count)).alias("j"))
        cells = cells.where("i <= j") if upper else cells
        return cells.join(F.broadcast(one), "i").join(F.broadcast(two), "j").select("i", "j", "ids_1", "words_1", "ids_2", "words_2")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = one.withColumn("j", every(b.count)).join(two.withColumn("i", every(a.count)), ["i", "j"])
    return met.where("i <= j") if upper else met


def _values(column: pa.Array, k: int, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Of row k of a list column: its numbers, in rows of ``width`` if over 0, and which of them are null (None: none is)."""
    values = column[k].values
    null = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    numbers = values.fill_null(0).to_numpy()
    return numbers.view(np.uint64).reshape(-1, width) if width else numbers, null


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common set bits of each row of words with each other one."""
    out = np.bitwise_count(x[:, 0, None] & y[None, :, 0])
    if x.shape[1] > 1:
        out = out.astype(np.int32)
        for k in range(1, x.shape[1]):
            out += np.bitwise_count(x[:, k, None] & y[None, :, k])
    return out


def _cards(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _similar(common: np.ndarray, cards: np.ndarray) -> np.ndarray:
    """Similarities of pairs with so many bits in common, and so many in one and the other together."""
    either = cards - common
    return common / np.maximum(either, 1, out=either)


def _found(id_1: np.ndarray, id_2: np.ndarray, jt: np.ndarray, null_1: np.ndarray | None = None, null_2: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(id_1, mask=null_1), pa.array(id_2, mask=null_2), pa.array(jt)], list(FOUND))


def _solved(tiles: DataFrame, width: int, id_type: str, solve) -> DataFrame:
    """id_1, id_2, jt of ``solve(i, j, (ids, words, nulls), (ids, words, nulls))`` of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                one, two = ((*_values(c[f"ids_{t}"], k, 0), _values(c[f"words_{t}"], k, width)[0]) for t in "12")
                yield from solve(c["i"][k].as_py(), c["j"][k].as_py(), one, two)

    found = tiles.mapInArrow(run, "id_1 long, id_2 long, jt double")
    return found if id_type == "bigint" else found.select(F.col("id_1").cast(id_type).alias("id_1"), F.col("id_2").cast(id_type).alias("id_2"), "jt")


def _all_pairs(fps: DataFrame, ordered: bool) -> DataFrame:
    """All pairs of rows with id_1 < id_2, or else all ordered pairs, those of equal ids 1.

    A row stands with a run of others, and the next row with the same run.
    """

    def solve(i, j, one, two):
        (x, x_null, xw), (y, y_null, yw) = one, two
        if ordered and not x.min() < y.max():
            return
        xc, yc = _cards(xw), _cards(yw)
        for at in range(0, len(y), RUN_ROWS):
            run = slice(at, at + RUN_ROWS)
            ids, words, cards, null = y[run], yw[run], yc[run], None if y_null is None else y_null[run]
            step = max(1, AT_ONCE // len(ids))
            for lo in range(0, len(x), step):
                own = slice(lo, lo + step)
                if ordered and not x[own].min() < ids.max():
                    continue
                jt = _similar(_common(xw[own], words), xc[own, None] + cards)
                k = len(jt)
                id_1, id_2 = np.repeat(x[own], len(ids)), np.tile(ids, k)
                if ordered:
                    keep = id_1 < id_2
                    yield _found(id_1, id_2, jt.ravel()) if keep.all() else _found(id_1[keep], id_2[keep], jt.ravel()[keep])
                    continue
                same, jt = id_1 == id_2, jt.ravel()
                nulls = [None if n is None else f(n) for n, f in ((None if x_null is None else x_null[own], lambda n: np.repeat(n, len(ids))), (null, lambda n: np.tile(n, k)))]
                for n in nulls:
                    if n is not None:
                        same &= ~n
                jt[same] = 1.0
                yield _found(id_1, id_2, jt, *nulls)

    b = Blocks(fps.where(F.col("fp_id").isNotNull()) if ordered else fps)
    return _solved(_tiles(b, b), b.width, b.id_type, solve)


def similarity_pairs(fps: DataFrame) -> DataFrame:
    """id_1 < id_2, jt for all pairs."""
    return _all_pairs(fps, True)


def similarity_matrix(fps: DataFrame) -> DataFrame:
    """id_1, id_2, jt for all ordered pairs, 1 on the diagonal."""
    return _all_pairs(fps, False)


def least_common(threshold: float, width: int) -> np.ndarray:
    """By the set bits of two fingerprints together (0 up to 128 a word): the fewest in common that make them similar."""
    bits = np.arange(64 * width + 1)
    found = np.full(128 * width + 1, 64 * width + 1)
    for s in range(len(found)):
        common = bits[: s // 2 + 1]
        enough = np.flatnonzero(common / np.maximum(s - common, 1) >= threshold)
        if len(enough):
            found[s] = enough[0]
    return found


def pairs_above(fps: DataFrame, threshold: float) -> DataFrame:
    """id_1 < id_2, jt of at least ``threshold`` (> 0), exactly.

    Each unordered pair is compared once.  Rows of one popcount stand together in a block; against each popcount
    of the other block they need a fixed number of common bits, and where none of both can have it (popcounts too
    far apart) nothing is compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")

    def solve(i, j, one, two):
        (x, _, xw), (y, _, yw) = one, two
        xc, yc = _cards(xw), _cards(yw)
        need = least_common(threshold, xw.shape[1])
        kind = np.uint8 if xw.shape[1] == 1 else np.int32
        kept, held = [], 0
        for card in np.unique(xc):
            least = need[card + yc]
            able = np.flatnonzero(least <= np.minimum(card, yc))  # popcounts ascend: a range, if any
            if not len(able):
                continue
            own = np.flatnonzero(xc == card)
            for at in range(able[0], able[-1] + 1, 4 * RUN_ROWS):
                run = slice(at, min(at + 4 * RUN_ROWS, able[-1] + 1))
                enough = least[run].astype(kind)
                for lo in range(0, len(own), 64):
                    rows = own[lo : lo + 64]
                    common = _common(xw[rows], yw[run])
                    r, c = np.nonzero(common >= enough)
                    jt = _similar(common[r, c].astype(np.int64), card + yc[run][c])
                    r, c = rows[r], c + at
                    a, b = x[r], y[c]
                    keep = (r < c) & (a != b) if i == j else a != b
                    kept.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], jt[keep]))
                    held += len(kept[-1][0])
                    if held >= AT_ONCE:
                        yield _found(*map(np.concatenate, zip(*kept, strict=True)))
                        kept, held = [], 0
        if held:
            yield _found(*map(np.concatenate, zip(*kept, strict=True)))

    b = Blocks(fps.where(F.col("fp_id").isNotNull()))
    return _solved(_tiles(b, b, upper=True), b.width, b.id_type, solve)


def nearest(queries: DataFrame, fps: DataFrame, k: int = 5, exclude_same_id: bool = True) -> DataFrame:
    """id_1, rank, id_2, jt: the k most similar fps of each query, ties to the smaller id.

    Blocks of queries meet blocks of fps; of each query a tile gives its k best, and those are ranked.
    """

    def solve(i, j, one, two):
        (x, x_null, xw), (y, y_null, yw) = one, two
        xc, yc = _cards(xw), _cards(yw)
        order = np.where(y_null, np.iinfo(np.int64).min, y) if y_null is not None else y
        cards, of_card = np.unique(yc, return_inverse=True)
        some = np.arange(0, len(y), max(1, len(y) // RUN_ROWS))
        step = max(1, 4 * AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            own = slice(lo, lo + step)
            common = _common(xw[own], yw)
            # the k-th best of some rows is a bound: whoever has less in common than it asks for is out
            bound = np.zeros(len(common))
            if len(some) >= k:
                jt = _similar(common[:, some], xc[own, None] + yc[some])
                if exclude_same_id:
                    jt[x[own, None] == y[some]] = -1
                bound = np.maximum(np.partition(jt, -k, axis=1)[:, -k], 0)
            least = np.floor(bound[:, None] * (xc[own, None] + cards) / (1 + bound[:, None]) - 1e-6).clip(0).astype(common.dtype)
            r, c = np.nonzero(common >= least[:, of_card])
            if exclude_same_id:
                other = x[own][r] != y[c]
                r, c = r[other], c[other]
            jt = _similar(common[r, c].astype(np.int64), xc[own][r] + yc[c])
            best = np.lexsort((order[c], -jt, r))
            best = best[np.arange(len(r)) - np.searchsorted(r[best], r[best]) < k]
            r, c, jt = r[best], c[best], jt[best]
            yield _found(x[own][r], y[c], jt, None if x_null is None else x_null[own][r], None if y_null is None else y_null[c])

    if exclude_same_id:
        queries, fps = (t.where(F.col("fp_id").isNotNull()) for t in (queries, fps))
    q, d = Blocks(queries), Blocks(fps)
    met = _solved(_tiles(q, d), d.width, d.id_type, solve)
    best = Window.partitionBy("id_1").orderBy(F.desc("jt"), "id_2")
    # row_number() <= k on a window: Spark limits each group before and after the exchange
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id_1", "rank", "id_2", "jt")


def _centroid_side(centroids: DataFrame) -> DataFrame:
    return centroids.select("label", F.col("words").alias("words_2"), B.popcount(F.col("words")).alias("card_2"))


def centroid_distances(fps: DataFrame, centroids: DataFrame) -> DataFrame:
    """fp_id, label, distance (1 - JT) to every centroid(label, words)."""
    f = fps.select("fp_id", F.col("words").alias("words_1"), B.popcount(F.col("words")).alias("card_1"))
    return meet(f, _centroid_side(centroids), "fp_id", "label", F.lit(True)).select("fp_id", "label", (1 - _jt()).alias("distance"))


def nearest_centroid(fps: DataFrame, centroids: DataFrame) -> DataFrame:
    """fp_id, label of the most similar centroid, the smallest label on ties, and its distance.

    Small sets of centroids travel as one array, and the minimum is taken within the row: no shuffle of
    the fingerprints.  With more, each pair is a row and the minimum is merged per fingerprint.
    """
    c = _centroid_side(centroids)
    if not fits(c):
        return centroid_distances(fps, centroids).groupBy("fp_id").agg(F.min(F.struct("distance", "label")).alias("m")).select("fp_id", F.col("m.label").alias("label"), F.col("m.distance").alias("distance"))
    table = c.agg(F.collect_list(F.struct("label", "words_2", "card_2")).alias("table"))  # one row, of a checked size
    f = fps.select("fp_id", F.col("words").alias("words_1"), B.popcount(F.col("words")).alias("card_1"))
    distance = lambda o: (1 - B.jt(B.intersection(F.col("words_1"), o["words_2"]), F.col("card_1"), o["card_2"])).alias("distance")
    least = F.array_min(F.transform("table", lambda o: F.struct(distance(o), o["label"].alias("label"))))
    found = f.join(F.broadcast(table), F.lit(True)).withColumn("m", least).where(F.col("m").isNotNull())
    return found.select("fp_id", F.col("m.label").alias("label"), F.col("m.distance").alias("distance"))


def reassign(fps: DataFrame, assignments: DataFrame, centroids: DataFrame, top: int = 20) -> DataFrame:
    """fp_id, label: rows of the ``top`` largest clusters go to the most similar of their centroids, others stay."""
    sizes = assignments.groupBy("label").count()
    largest = sizes.orderBy(F.desc("count"), "label").limit(top).select("label")
    mine = assignments.join(F.broadcast(largest), "label", "left_semi")  # at most ``top`` rows
    moved = nearest_centroid(fps.join(mine.select("fp_id"), "fp_id", "left_semi"), centroids.join(F.broadcast(largest), "label", "left_semi"))
    out = assignments.join(moved.select("fp_id", F.col("label").alias("to")), "fp_id", "left")
    return out.select("fp_id", F.coalesce("to", "label").alias("label"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package
