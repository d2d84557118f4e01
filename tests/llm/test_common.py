import random

from peakgrid.llm import common


def slow(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_on_random_edges_with_small_plans(spark, monkeypatch):
    """The driver holds the plan of every round; each had 16 reads of the edges."""
    reads = []

    def store(df, name, codec=None, real=common.store):
        reads.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return real(df, name, codec)
    monkeypatch.setattr(common, "store", store)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 7), (8, None), (None, None)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(slow(edges).items())
    assert len(reads) > 2 and max(reads) <= 4


def test_components_of_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
