"""Trees and rounds against golden clusterings and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import cluster
from bitloom.operators.cluster import Params, Recluster, Refine, Rounds
from bitloom.operators.tree import Tree
from bitloom.sources.fake import fake_fingerprints

SEED = 12620509540149709235


def frame(spark, packed, start=0, part=0):
    words = packed.view(">i8").astype(np.int64)
    return spark.createDataFrame([(start + i, part, [int(w) for w in r]) for i, r in enumerate(words)], "fp_id long, part long, words array<long>")


def kernel(n, seed, **settings):
    t = Tree(2048, **settings)
    t.insert_words(fake_fingerprints(n, 2048, seed).view(np.uint64), list(range(n)))
    return [e.ids for e in t.clusters()]


def test_diameter_golden():
    got = kernel(3000, SEED, threshold=0.65, branching=50)
    assert got[0] == [2195, 2196, 2378, 2440, 2443, 2454, 2463, 2464, 2465, 2467, 2527, 2544]
    assert got[4:8] == [[1059, 1065, 1072, 1077, 1154, 1194, 1301], [1779, 1802, 1807, 1828, 1856, 1864], [2826, 2896, 2970, 2973, 2975], [1986, 2107, 2139, 2141]]
    assert got[8:13] == [[1933, 1949], [2233, 2294], [1551, 1552], [1219, 1226], [614, 637]]
    assert sorted(i for ids in got for i in ids) == list(range(3000))


def test_radius_and_tolerance_golden():
    got = kernel(1000, SEED, threshold=0.65, branching=50, merge="radius")
    assert got[2:6] == [[749, 751, 766, 798, 825, 827, 840, 845], [463, 464, 470, 477, 496, 498], [0, 3, 32, 53], [607, 609, 614, 615]]
    got = kernel(500, SEED, threshold=0.65, branching=50, merge="tolerance-legacy")
    assert got[:4] == [[182, 255, 311, 389, 405, 438, 457, 461, 470], [107, 228], [13], [0]]


@pytest.mark.parametrize("n", [1, 2, 10])
@pytest.mark.parametrize("value", [0, 255])
def test_repeats_are_one_cluster(spark, n, value):
    got = cluster.fit(frame(spark, np.full((n, 256), value, np.uint8)), 2048).collect()
    assert [r.ids for r in got] == [list(range(n))]


def test_fit_and_refine_golden(spark):
    df = frame(spark, fake_fingerprints(100, 2048, SEED))
    label = lambda steps: [r.label for r in cluster.assignments(cluster.labelled(cluster.fit(df, 2048, Params(0.3), steps))).orderBy("fp_id").collect()]
    assert label(())[:20] == [1, 5, 6, 1, 1, 7, 8, 9, 1, 10, 1, 2, 11, 52, 12, 13, 14, 15, 16, 17]
    refined = label((Refine(1),))
    assert sorted(refined)[0] == 1 and len(refined) == 100 and refined != label(())
    again = label((Recluster(2, 0.01, seed=3),))
    assert len(again) == 100


def test_summaries_hold_their_members(spark):
    packed = fake_fingerprints(300, 2048, 5)
    bits = np.unpackbits(packed, axis=1).astype(int)
    for steps in ((), (Refine(2, "tolerance-diameter"),), (Recluster(2, 0.01, seed=1, stop_early=True),)):
        rows = cluster.fit(frame(spark, packed), 2048, Params(0.5), steps).collect()
        assert sorted(i for r in rows for i in r.ids) == list(range(300))
        for r in rows:
            assert r.n == len(r.ids) and r.ls == bits[r.ids].sum(axis=0).tolist()


def test_multiround_golden(spark):
    df = None
    for k, seed in enumerate(range(1, 21, 2)):
        part = frame(spark, fake_fingerprints(100, 2048, seed), 100 * k, k)
        df = part if df is None else df.unionByName(part)
    rounds = Rounds(bin_size=2, merge="tolerance-legacy")
    found, members = cluster.multiround(df.repartition(3), 2048, Params(0.65, 254), rounds)
    members.cache()
    cluster.check_assignments(members, 1000)
    first = sorted(r.fp_id for r in members.where("label = 1").collect())
    assert first[:8] == [368, 414, 422, 423, 520, 549, 581, 609]
    again = cluster.multiround(df.repartition(7), 2048, Params(0.65, 254), rounds)[1]
    assert members.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        cluster.check_assignments(members, 999)


def test_partial_fit_equals_one_fit_of_singletons(spark):
    packed = fake_fingerprints(60, 2048, 9)
    whole = cluster.partial_fit(None, frame(spark, packed), 2048, Params(0.9)).collect()
    assert sorted(i for r in whole for i in r.ids) == list(range(60))
    first = cluster.partial_fit(None, frame(spark, packed[:30]), 2048, Params(0.9))
    both = cluster.partial_fit(first, frame(spark, packed[30:], 30), 2048, Params(0.9)).collect()
    assert sorted(i for r in both for i in r.ids) == list(range(60))


def test_parameters():
    for bad in ({"threshold": 1.5}, {"branching": 1}, {"merge": "x"}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        cluster.multiround(None, 64, rounds=Rounds(refinement="some"))


def test_custom_criterion(spark):
    rows = cluster.fit(frame(spark, fake_fingerprints(20, 2048, 3)), 2048, Params(merge=lambda *_: True)).collect()
    assert len(rows) == 1 and rows[0].n == 20


def test_global_clusters(spark):
    found = cluster.labelled(cluster.fit(frame(spark, fake_fingerprints(60, 2048, 3)), 2048, Params(0.6)))
    got = cluster.global_clusters(found, 2048, 4)
    assert got.count() == found.count() and got.agg(F.countDistinct("global_label")).first()[0] == 4
