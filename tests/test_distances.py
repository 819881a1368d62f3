"""Sums of distances by boxes against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distances
from tessella.operators import cluster


@pytest.fixture
def boxes_used(monkeypatch):
    """Pairs count as dear, so that few points are dealt into boxes too; gives the levels that were chosen."""
    used, run = [], distances.grouped_sums
    monkeypatch.setattr(distances, "PAIR", 1e-5)
    monkeypatch.setattr(distances, "PORTIONS", 7)
    monkeypatch.setattr(distances, "grouped_sums", lambda *a: used.append(a[5]) or run(*a))
    monkeypatch.setattr(cluster, "FAR_FROM", 100)
    return used


def table(spark, d):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(size=(1200, d)), rng.exponential(size=(300, d)) * 3 + 1])
    x = np.vstack([x, x[:100], x[:50]])  # copies weigh more
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "ID long, " + ", ".join(f"f{j} double" for j in range(d))).repartition(5).cache()


@pytest.mark.parametrize("d", [1, 2, 3])
def test_silhouettes_from_boxes(spark, boxes_used, d):
    x, df = table(spark, d)
    features = [f"f{j}" for j in range(d)]
    centers = {k: [[-1.0 + 2.5 * i / (k - 1)] * d for i in range(k)] for k in (2, 3, 5)}
    found = cluster.mean_silhouettes(df, features, centers)
    assert boxes_used and boxes_used[0] >= 3
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k, c in centers.items():
        own = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.stack([far[:, own == q].sum(axis=1) for q in range(k)], axis=1)
        n, at = np.bincount(own, minlength=k), np.arange(len(x))
        a, away = sums[at, own] / (n[own] - 1), sums / n
        away[at, own] = np.inf
        b = away.min(axis=1)
        s = (b - a) / np.maximum(a, b)
        assert found[k] == pytest.approx(s.mean(), abs=1e-9)
        if k != 3:
            continue
        rows = cluster.silhouettes(cluster.assign(df, features, c), features).orderBy("ID").toPandas()["s"].to_numpy()
        assert len(rows) == len(x) and np.abs(rows - s).max() < 1e-7 and (np.sign(rows) == np.sign(s)).all()
        assert cluster.negative_silhouettes(cluster.assign(df, features, c), features).first()["n"] == (s < 0).sum()


def test_points_near_zero_are_compared_again(spark, boxes_used, monkeypatch):
    """With a wide margin many points are; their silhouettes are then those of all pairs, to the last places."""
    _, df = table(spark, 2)
    assigned = cluster.assign(df, ["f0", "f1"], [[-1.0, 0.0], [1.0, 1.0]])
    monkeypatch.setattr(cluster, "CLOSE", 0.3)
    found = cluster.silhouettes(assigned, ["f0", "f1"]).orderBy("ID").toPandas()["s"].to_numpy()
    assert boxes_used
    monkeypatch.setattr(cluster, "FAR_FROM", 10**9)
    pairs = cluster.silhouettes(assigned, ["f0", "f1"]).orderBy("ID").toPandas()["s"].to_numpy()
    near = np.abs(pairs) < 0.29
    assert near.sum() > 50 and np.abs(found - pairs)[near].max() < 1e-13 and np.abs(found - pairs).max() < 1e-7


def test_work_grows_with_the_points(spark):
    """Eight times as many different points take less than twenty times as long by the plan; all pairs would take 64 times."""
    cost = []
    for n in (40_000, 320_000):
        df = spark.range(n).select(*[F.randn(j).alias(f"f{j}") for j in range(3)]).cache()
        cost.append(distances.choose(df, ["f0", "f1", "f2"], [-6.0] * 3, 12.0)[2].sum())
    assert cost[1] < 20 * cost[0]


def test_sweep_measures_all_rows(spark):
    """Beyond 20,000 rows too, the silhouettes of a sweep are those of all rows, and none is taken from a sample."""
    df = spark.range(24_000).selectExpr("id AS ID", "double(id % 240) AS x").cache()
    found = {r["k"]: r["silhouette"] for r in cluster.sweep(df, ["x"], range(2, 4), starts=1).collect()}
    centers = {k: c.tolist() for k, (c, _, _) in cluster.best_starts(df, ["x"], [2, 3], 1).items()}
    for k, c in centers.items():
        labelled = cluster.assign(df, ["x"], c)
        assert found[k] == pytest.approx(cluster.silhouettes(labelled, ["x"]).agg(F.avg("s")).first()[0], abs=1e-9)
