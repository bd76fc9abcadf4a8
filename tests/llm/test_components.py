import random

import pytest

from tracemill.llm import common, components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root if find(x) != x)


@pytest.mark.parametrize("held,hot", [(500_000, 1000), (7, 3)])
def test_components(spark, monkeypatch, held, hot):
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(components, "LEAST_HOT", hot)
    rng = random.Random(held)
    star = [(n, 10**6) for n in range(50)] + [(10**6, -5)]
    path = [(2000 + i, 2001 + i) for i in range(70)]
    some = [(rng.randrange(3000, 3060), rng.randrange(3000, 3060)) for _ in range(40)]
    edges = [*star, *path, *some, (9, 9), (7777, 7777), *star[:3]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert sorted(map(tuple, components.components(df).collect())) == brute(edges)


def test_no_edges(spark):
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()
    assert not components.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect()


def test_plans_stay_small(spark, monkeypatch):
    scans, write = [], components.durable

    def counted(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, name)

    monkeypatch.setattr(components, "durable", counted)
    edges = [(n, n + 1) for n in range(0, 60)]
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert found.count() == 60 and len(scans) > 1
    assert max(scans) <= 6  # a round in one plan had a hundred


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, found):
            self.found = found

        def get(self, key, default):
            return self.found

    class Context:
        def __init__(self, master, found=None):
            self.master, self.conf = master, Conf(found)

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        def __init__(self, *args):
            self.sparkContext = Context(*args)

    assert common.scratch_dir(Session("yarn", "/shared/x/")) == "/shared/x"
    assert common.scratch_dir(Session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.scratch_dir(Session(master))


def test_durable_leaves_the_setting_alone(spark):
    before = spark.conf.get(common.CLEANUP)
    assert common.durable(spark.range(5).groupBy("id").count()).count() == 5
    assert spark.conf.get(common.CLEANUP) == before
