"""Connected components of edges: in one task, and in rounds of joins."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from bitloom.llm import common, simhash


def brute_force(edges):
    found = {v: v for e in edges for v in e if e[0] != e[1]}
    while True:
        before = dict(found)
        for a, b in edges:
            if a != b:
                found[a] = found[b] = min(found[a], found[b])
        if found == before:
            return found


def shapes():
    rng = random.Random(5)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    chain = list(zip(ids[:100], ids[1:100], strict=False))
    star = [(ids[100], v) for v in ids[101:200]]
    loose = [(rng.choice(ids[200:]), rng.choice(ids[200:])) for _ in range(60)]
    return {"mixed": chain + star + loose, "repeated": [(3, 1), (1, 3), (3, 1), (1, 2)], "loops": [(7, 7)], "none": []}


@pytest.mark.parametrize("few", [500_000, 0])
@pytest.mark.parametrize("shape", shapes())
def test_components_against_brute_force(spark, monkeypatch, shape, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    edges = shapes()[shape]
    got = common.union_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x.id for x in got})
    assert {x.id: x.component for x in got} == brute_force(edges)


def test_few_edges_take_few_jobs(spark):
    """Each job's plans, stages and tasks stay in the driver's memory for a while."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "components of a chain")
    try:
        found = common.union_components(spark.createDataFrame(shapes()["mixed"], "a long, b long"))
        jobs = sc.statusTracker().getJobIdsForGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() and len(jobs) <= 8, len(jobs)


@pytest.mark.parametrize("m,tau", [(10, 8), (11, 8), (6, 4), (7, 4)])
def test_chain_test_against_brute_force(spark, m, tau):
    rng = random.Random(m)
    flips = [rng.sample(range(64), rng.randrange(tau + 4)) for _ in range(2000)]
    xs = [sum(1 << i for i in f) for f in flips]
    counts = [[(x >> a & ((1 << n) - 1)).bit_count() for a, n in simhash.segments(m)] for x in xs]
    want = [any(all(sum(c[(s + i) % m] for i in range(l)) <= l * tau // m for l in range(1, m)) for s in range(m)) for c in counts]
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(xs)]
    got = spark.createDataFrame(signed, "k long, x long").select("k", simhash._chain_test(F.col("x"), m, tau).alias("t")).collect()
    assert [x.t for x in sorted(got)] == want and 0 < sum(want) < len(want)


def test_chain_test_is_a_short_expression(spark):
    """The driver rewrites it again and again as the joins' stages end."""
    shown = spark.range(1).select(simhash._chain_test(F.col("id"), 10, 8).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("bit_count") <= 90, shown.count("bit_count")
