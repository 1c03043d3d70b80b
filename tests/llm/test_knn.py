"""Exact top-k search against brute force."""

import random

import numpy as np

from bitloom.llm import knn


def brute(rows, k):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in whole:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])}
    return out


def test_knn(spark):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [r.gauss(c, 0.3) for c in centres[r.randrange(6)]]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(40)]  # one very common vector
    rows += [(340, None), (341, [None] * 8), (342, [float("nan")] * 8), (343, [float("inf")] * 8), (344, []), (None, [1.0] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    whole = knn.whole_vectors(data)
    plain = [(x.vec_id, x.embedding) for x in data.collect() if x.vec_id is not None]
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in knn.top_k(whole.where("vec_id % 20 = 0"), whole).collect()}
    assert got == brute(plain, 20)
    few = whole.where("vec_id < 5")
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in knn.top_k(few.where("vec_id = 0"), few).collect()}
    assert got == brute([x for x in plain if x[0] < 5], 20)
    assert knn.top_k(whole.limit(0), whole).count() == 0 and knn.top_k(whole, whole.limit(0)).count() == 0
    twice = whole.where("vec_id < 40").union(whole.where("vec_id < 40"))
    assert knn.top_k(twice.where("vec_id = 0"), twice).count() == 20


def test_knn_of_many_cells(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 2) for _ in range(6)] for _ in range(12)]
    rows = [(i, [r.gauss(c, 0.2) for c in centres[r.randrange(12)]]) for i in range(900)]
    whole = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    plain = [(x.vec_id, x.embedding) for x in spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect()]
    found = knn.top_k(whole.where("vec_id % 20 = 0"), whole, data_block=8, query_block=2)  # some ten cells, chunks of queries
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in found.collect()} == brute(plain, 20)
