"""Bit functions, summaries, criteria and indices against NumPy and golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits as B
from bitloom.functions import isim as I
from bitloom.operators import merges, metrics, pairs, summaries
from bitloom.sources.fake import fake_fingerprints

SEED = 12620509540149709235


def words_of(bits):
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(">i8").astype(np.int64)


def frame(spark, bits, labels=None):
    rows = [(i, [int(w) for w in ws], 0 if labels is None else int(labels[i])) for i, ws in enumerate(words_of(bits))]
    return spark.createDataFrame(rows, "fp_id long, words array<long>, label long")


def test_generator_golden():
    assert fake_fingerprints(20, 32, SEED)[0].tolist() == [218, 42, 91, 221]
    rows = fake_fingerprints(10, 2048, 17408390758220920002, pack=False)
    assert rows.sum(axis=1).tolist() == [1137, 124, 558, 1159, 281, 323, 1264, 1252, 879, 631]


@pytest.mark.parametrize("n", [20, 64, 100, 128])
def test_pack_round_trip(spark, n):
    bits = np.random.default_rng(n).integers(0, 2, (30, n)).astype(np.uint8)
    df = spark.createDataFrame([(i, [int(x) for x in b]) for i, b in enumerate(bits)], "fp_id long, bits array<int>")
    df = df.withColumn("words", B.pack(F.col("bits"), n))
    got = df.select("fp_id", "words", B.unpack(F.col("words"), n).alias("back"), B.popcount(F.col("words")).alias("card")).orderBy("fp_id").collect()
    assert [r.words for r in got] == words_of(bits).tolist()
    assert [r.back for r in got] == bits.tolist() and [r.card for r in got] == bits.sum(axis=1).tolist()


def test_isim_golden_and_degenerate(spark):
    bits = fake_fingerprints(100, 2048, 17408390758220920002, pack=False)
    assert summaries.isims(frame(spark, bits)).first()["isim"] == 0.21824334501491158
    for rows, want in ((np.ones((3, 64)), 1.0), (np.zeros((3, 64)), 1.0), (np.eye(3, 64), 0.0)):
        assert summaries.isims(frame(spark, rows.astype(np.uint8))).first()["isim"] == want
    assert math.isnan(summaries.isims(frame(spark, np.ones((1, 64), np.uint8))).first()["isim"])
    ls = bits.sum(axis=0).astype(np.int64)
    assert merges.isim(ls, 100) == 0.21824334501491158
    got = summaries.radii(summaries.linear_sums(frame(spark, bits), 2048)).first()
    assert got["ls"] == ls.tolist() and got["radius_complement"] == merges.radius_complement(ls, 100)


def test_similarity_of_empty_rows(spark):
    got = pairs.similarity_pairs(frame(spark, np.zeros((2, 64), np.uint8))).first()
    assert got["jt"] == 0.0


def test_stratified_golden(spark):
    df = frame(spark, fake_fingerprints(10, 2048, 1345, pack=False))
    assert [r.fp_id for r in summaries.stratified_sample(df, 2048, 3).orderBy("stratum").collect()] == [0, 4, 2]
    assert [r.fp_id for r in summaries.stratified_sample(df, 2048, 10).orderBy("stratum").collect()] == [0, 9, 1, 5, 4, 3, 6, 2, 8, 7]
    assert summaries.stratified_sample(df, 2048, 0).count() == 0
    with pytest.raises(ValueError):
        summaries.stratified_sample(df, 2048, 11)


def test_most_dissimilar_golden(spark):
    df = frame(spark, fake_fingerprints(10, 2048, 17408390758220920002, pack=False))
    got = summaries.most_dissimilar(df, 2048).first()
    assert (got["fp_1"], got["fp_2"]) == (1, 2)


def test_indices_golden(spark):
    bits = fake_fingerprints(50, 32, SEED, pack=False)
    words = words_of(bits)
    rows = [(k, i, [int(w) for w in words[i]]) for k in range(5) for i in range(k, k + 10)]
    df = spark.createDataFrame(rows, "label long, fp_id long, words array<long>")
    assert abs(metrics.dbi(df, 32).first()["dbi"] - 0.5183197174528508) < 1e-12
    assert metrics.dunn(df, 32).first()["dunn"] == 2.1591579714616436
    assert abs(metrics.chi(df, 32).first()["chi"] - 4.411591622357663) < 1e-12
    assert metrics.chi(df.where("label = 0"), 32).first()["chi"] == 0.0


def test_pairs_above_is_exact(spark):
    bits = (np.random.default_rng(3).random((120, 64)) < np.random.default_rng(4).random((120, 1))).astype(np.uint8)
    bits[5] = bits[9]
    df = frame(spark, bits)
    every = {(r.id_1, r.id_2, r.jt) for r in pairs.similarity_pairs(df).collect()}
    for t in (0.3, 0.7, 1.0):
        assert {(r.id_1, r.id_2, r.jt) for r in pairs.pairs_above(df, t).collect()} == {x for x in every if x[2] >= t and x[2] > 0}


@pytest.mark.parametrize("name", merges.NAMES)
def test_criteria_agree(spark, name):
    bits = fake_fingerprints(60, 64, 5, pack=False).astype(np.int64)
    cases = []
    for old, nom in ((1, 1), (1, 20), (20, 1), (20, 30)):
        a, b = bits[:old].sum(axis=0), bits[30 : 30 + nom].sum(axis=0)
        cases.append((old, a.tolist(), nom, b.tolist()))
    df = spark.createDataFrame(cases, "on long, ol array<long>, nn long, nl array<long>")
    union = F.zip_with("ol", "nl", lambda x, y: x + y)
    for t in (0.1, 0.6, 0.95):
        ok = I.accepts(name, t, (F.col("on") + F.col("nn"), union), (F.col("on"), F.col("ol")), (F.col("nn"), F.col("nl")))
        got = [r.ok for r in df.select("on", "nn", ok.alias("ok")).collect()]
        f = merges.criterion(name)
        want = [bool(f(t, np.array(ol) + np.array(nl), on + nn, np.array(ol), np.array(nl), on, nn)) for on, ol, nn, nl in cases]
        assert got == want


def test_unknown_criterion():
    with pytest.raises(ValueError):
        merges.criterion("nearest")
    assert merges.criterion(lambda *_: True)(0, None, 0, None, None, 0, 0)


@pytest.mark.parametrize(("n", "rank"), [(255, 8), (256, 16), (65535, 16), (65536, 32), (2**32 - 1, 32), (2**32, 64)])
def test_dtype_rank(spark, n, rank):
    assert spark.range(1).select(B.dtype_rank(F.lit(n))).first()[0] == rank
