"""What is read once, and the kernels of K-Means against plain versions."""

import numpy as np

from tessella.functions import values
from tessella.operators import cluster, family
from tessella.plans import registry
from tessella.sources import tables

SF = "/root/testdata/sf0.001"


def test_raw_table_reads_its_base_once(spark):
    df = tables.raw_behaviour(spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice#") > 0
    assert df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    base = {r["ID"]: r for r in tables.behaviour(spark, SF).collect()}
    want = sorted([*base, *[i for i in base if i % 50 == 0], *[i + 10_000_000 for i in base if i % 20 == 0]])
    rows = df.collect()
    assert sorted(r["ID"] for r in rows) == want and all(r[1:] == base[r["ID"] % 10_000_000][1:] for r in rows)


def test_families_are_fitted_to_one_table(spark, monkeypatch):
    read = []
    monkeypatch.setattr(registry, "behaviour", lambda *a, f=registry.behaviour: read.append(1) or f(*a))
    monkeypatch.setattr(family, "fit", lambda df, own, *a: (registry.GIVEN[own.name], 0.0))
    assert registry.family_models(spark, SF).count() > 0 and registry.trained(spark, SF).count() > 0
    assert len(read) == 2


def test_kernels_and_empty_clusters(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, 3)), rng.normal(size=(7, 3))
    assert np.allclose(cluster._square(x, c), ((x[:, None] - c[None]) ** 2).sum(axis=2))
    ties = np.column_stack([np.repeat([3.0, 1.0, 2.0], 100), np.arange(300)])
    assert np.array_equal(cluster._greatest(ties, 150), ties[np.argsort(-ties[:, 0], kind="stable")[:150]])
    df = spark.createDataFrame([(float(i), 0.0) for i in range(20)] + [(100.0, 0.0)], "a double, b double").repartition(3)
    (centers, cost, rounds), = cluster.lloyd_many(df, ["a", "b"], [np.array([[9.0, 0.0], [900.0, 900.0]])])
    assert rounds > 1 and sorted(centers[:, 0].tolist()) == [9.5, 100.0] and np.isclose(cost, ((np.arange(20) - 9.5) ** 2).sum())


def test_value_counts_hold_few_values(spark):
    df = spark.range(0, 260_000, 1, 1).selectExpr("id AS a", "id % 7 AS b", "string(id % 90000) AS c", "IF(id % 5 = 0, NULL, id) AS d")
    got = {r["column"]: tuple(r)[1:] for r in values.distinct_counts(df, df.columns).collect()}
    assert got == {"a": (260_000, 0, 260_000), "b": (7, 0, 260_000), "c": (90_000, 0, 260_000), "d": (208_000, 52_000, 260_000)}
    assert values.HELD <= 100_000  # of a task, beside one batch
