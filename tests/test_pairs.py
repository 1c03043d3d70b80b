"""Pairs of tables that are several blocks of fingerprints, against all pairs by NumPy; what files of all pairs take."""

import numpy as np
import pytest

from bitloom.operators import pairs


def table(spark, n, width=1, seed=0):
    rng = np.random.default_rng(seed)
    bits = (rng.random((n, 64 * width)) < rng.uniform(0.2, 0.8, (n, 1))).astype(np.uint8)
    bits[7], bits[11] = 0, bits[13]
    ids = rng.permutation(n) * 3
    words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    df = spark.createDataFrame([(int(i), w) for i, w in zip(ids, words.tolist(), strict=True)], "fp_id long, words array<long>")
    order = np.argsort(ids)
    x = bits[order].astype(np.int64)
    common, card = x @ x.T, x.sum(axis=1)
    return df, ids[order], common / np.maximum(card[:, None] + card - common, 1)


def same(df, ids, jt, which):
    got = df.toPandas().sort_values(["id_1", "id_2"])
    r, c = np.nonzero(which)
    assert (got["id_1"].to_numpy() == ids[r]).all() and (got["id_2"].to_numpy() == ids[c]).all()
    assert (got["jt"].to_numpy() == jt[r, c]).all()


@pytest.mark.parametrize(("n", "width"), [(1300, 1), (600, 3)])
def test_blocks_match_all_pairs(spark, monkeypatch, n, width):
    df, ids, jt = table(spark, n, width)
    upper = np.triu(np.ones((n, n), bool), 1)
    same(pairs.similarity_pairs(df), ids, jt, upper)
    same(pairs.pairs_above(df, 0.5), ids, jt, upper & (jt >= 0.5))
    one = jt.copy()
    np.fill_diagonal(one, 1.0)
    same(pairs.similarity_matrix(df), ids, one, one >= 0)
    queries = df.where("fp_id % 20 = 0")
    for limit in (pairs.BROADCAST_BYTES, 1):  # blocks are broadcast, or meet in a join
        monkeypatch.setattr(pairs, "BROADCAST_BYTES", limit)
        got = pairs.nearest(queries, df, 5)
        want = {(int(ids[i]), k + 1, int(ids[j]), jt[i, j]) for i in np.flatnonzero(ids % 20 == 0) for k, j in enumerate([j for j in np.lexsort((ids, -jt[i])) if j != i][:5])}
        assert {tuple(r) for r in got.collect()} == want
        same(pairs.pairs_above(df, 0.6), ids, jt, upper & (jt >= 0.6))


def test_rows_of_one_id(spark):
    """Rows of equal ids are no pair, and 1 in the matrix."""
    df = spark.createDataFrame([(1, [3]), (1, [7]), (2, [3])], "fp_id long, words array<long>")
    assert sorted(tuple(r) for r in pairs.similarity_pairs(df).collect()) == [(1, 2, 2 / 3), (1, 2, 1.0)]
    assert sorted(tuple(r) for r in pairs.similarity_matrix(df).collect()) == sorted([(1, 1, 1.0)] * 4 + [(1, 2, 1.0), (2, 1, 1.0), (1, 2, 2 / 3), (2, 1, 2 / 3), (2, 2, 1.0)])
    assert pairs.similarity_pairs(df.limit(0)).count() == 0 and pairs.nearest(df.limit(0), df).count() == 0


@pytest.mark.parametrize("all_pairs", [pairs.similarity_pairs, pairs.similarity_matrix])
def test_files_of_all_pairs_are_small(spark, tmp_path, all_pairs):
    df, _, _ = table(spark, 2000)
    found = all_pairs(df)
    found.write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 1.9 * found.count()


def test_workers_compare_blocks(spark):
    """No join makes a row of each pair that is compared."""
    df, _, _ = table(spark, 50)
    for found in (pairs.pairs_above(df, 0.5), pairs.nearest(df, df, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "words_1" in plan.split("MapInArrow")[1]
