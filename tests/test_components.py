"""Connected components on few edges, in one task a round, and on many, with shuffles."""

import random

import pytest

from graphloom.operators.components import connected_components


def plain(edges):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in up)


def graphs():
    rng = random.Random(5)
    path = rng.sample(range(120), 120)
    return {
        "path": list(zip(path, path[1:])),
        "star": [(500, k) for k in range(300)],
        "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(9, 9), (2000, 2000), (None, 3), (4, None)],
        "none": [],
    }


@pytest.mark.parametrize("few", [250_000, 150, 0])
@pytest.mark.parametrize("name", list(graphs()))
def test_components_against_plain(spark, name, few):
    edges = graphs()[name]
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), few=few).collect()
    assert sorted(map(tuple, got)) == plain(edges)


def test_rounds_on_few_edges_take_one_job(spark):
    """Each shuffle of a round is a job that the driver plans and keeps track of: with shuffled rounds a path of 300 nodes took 59 jobs, in one task 11."""
    edges = graphs()["path"]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("components", "components")
    try:
        assert sorted(map(tuple, connected_components(frame).collect())) == plain(edges)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
