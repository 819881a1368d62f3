"""Wide correlations, running totals, inferred types, the processing log, and the silhouette's estimate, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import crossproduct, ranges, stats
from tessella.operators import clean, cluster, compare, features, scale, transform
from tessella.operators.log import Log
from tessella.sources import infer

RNG = np.random.default_rng(21)


def test_correlations_of_many_columns(spark):
    n, p = 400, 300
    base = RNG.normal(size=(n, 5))
    x = base @ RNG.normal(size=(5, p)) + RNG.normal(size=(n, p)) + 1e6
    x[:, 7] = 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(p))).repartition(5)
    found = stats.correlation_matrix(df, df.columns).collect()
    assert len(found) == p * (p - 1) // 2
    want = np.corrcoef(np.delete(x, 7, axis=1), rowvar=False)
    place = [i - (i > 7) for i in range(p)]
    for r in found:
        if 7 in (r["i"], r["j"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want[place[r["i"]], place[r["j"]]], abs=1e-9)
    means, cov = crossproduct.covariances(df, df.columns[:6])
    assert np.allclose(means, x[:, :6].mean(axis=0)) and np.allclose(cov, np.cov(x[:, :6], rowvar=False))


def test_correlations_with_nulls_are_pairwise(spark):
    rows = [tuple(None if RNG.random() < 0.2 else float(v) for v in r) for r in RNG.normal(size=(200, 4))] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("none", F.lit(None).cast("double")).repartition(3)
    one = {(r["f1"], r["f2"]): r["r"] for r in stats.correlation_matrix(df, df.columns).collect()}
    two = {(r["f1"], r["f2"]): r["r"] for r in stats.correlation_matrix(df, df.columns, wide=1).collect()}
    assert one.keys() == two.keys()
    assert all((one[k] is None) == (two[k] is None) and (one[k] is None or one[k] == pytest.approx(two[k])) for k in one)


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_running_totals(spark, kind):
    keys = [f"k{int(i):04d}" for i in RNG.integers(0, 300, 2000)] if kind == "string" else [int(i) for i in RNG.integers(0, 10**4, 2000)]
    keys[:600] = keys[:1] * 600  # a key of a third of the rows
    vals = [float(v) for v in RNG.integers(0, 50, 2000)]
    df = spark.createDataFrame(list(zip(keys, vals)), f"k {'string' if kind == 'string' else 'long'}, v double")
    df = df.withColumn("k", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int"))) if kind == "date" else df.withColumn("k", F.col("k").cast(kind))
    df = df.union(df.sparkSession.createDataFrame([(None, 1.5), (None, None)], df.schema)).repartition(4)
    got = sorted(ranges.running_totals(df, ["k"], "v", 7).collect(), key=lambda r: r["cum"])
    rows = sorted(((r["k"] is not None, r["k"], r["v"] is not None, r["v"]) for r in df.collect()), key=lambda r: (r[0], r[1] or type(rows_key(r))(), r[2], r[3] or 0.0) if r[0] else (r[0], 0, r[2], r[3] or 0.0))
    assert [r["cum"] for r in got] == pytest.approx(np.cumsum([r[3] or 0.0 for r in rows]).tolist())
    assert ranges.running_totals(df.limit(0), ["k"], "v").collect() == []


def rows_key(r):
    return r[1]


def test_ranges_are_even(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('key', id * id) END AS k", "1.0D AS v").repartition(4)
    dealt = df.groupBy("k", "v").count().repartitionByRange(8, "k", "v").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r[1] for r in dealt]
    assert max(sizes) <= 2 * np.mean(sizes)  # the hot key is one row
    assert ranges.running_totals(df, ["k"], "v", 8).agg(F.max("cum"), F.count("*")).first()[:] == (20_000.0, 20_000)


def test_inferred_types_and_quarantine(spark, tmp_path):
    lines = ["id\tn\tx\tflag\tname\tgap\tempty\todd"]
    lines += [f"{i}\t{i * 3 if i != 5 else ''}\t{i / 4 if i % 2 else '1e3'}\t{'True' if i % 2 else 'False'}\tn{i}\t{'NA' if i == 3 else 'True'}\t\t{i if i != 7 else 'x7'}" for i in range(40)]
    lines += ["1\t2\t3", "1\t2\t3\tTrue\tx\tTrue\t\t5\textra"]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    kept, quarantine, found = infer.read(spark, str(tmp_path / "t.tsv"))
    # as a reader of whole files would find them: whole numbers with gaps are decimal, logical ones with gaps are text
    assert {r["column"]: r["type"] for r in found.collect()} == {"id": "int64", "n": "float64", "x": "float64", "flag": "bool", "name": "object", "gap": "object", "empty": "float64", "odd": "object"}
    assert kept.count() == 40 and sorted(r["reason"] for r in quarantine.collect()) == ["number of fields"] * 2
    row = kept.filter("id = 5").first()
    assert (row["n"], row["x"], row["flag"], row["name"], row["empty"]) == (None, 1.25, True, "n5", None) and kept.schema["id"].dataType.simpleString() == "bigint"
    # all but one value of `odd` are whole numbers
    kept, quarantine, found = infer.read(spark, str(tmp_path / "t.tsv"), tolerance=0.05)
    assert {r["column"]: r["type"] for r in found.collect()}["odd"] == "int64"
    assert kept.count() == 39 and sorted(r["reason"] for r in quarantine.collect()) == ["number of fields"] * 2 + ["odd"]
    (tmp_path / "none.tsv").write_text("a\tb\n")
    kept, quarantine, found = infer.read(spark, str(tmp_path / "none.tsv"))
    assert kept.collect() == quarantine.collect() == [] and {r["type"] for r in found.collect()} == {"object"}


def test_log_counts_without_jobs(spark):
    log = Log()
    df = log.step(spark.range(100).repartition(3), "load")
    df = log.step(df.filter("id % 2 = 0"), "filter", "even")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("log", "log")
    df.write.format("noop").mode("overwrite").save()
    jobs = len(tracker.getJobIdsForGroup("log"))
    rows = log.table(spark).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["step"], r["action"], r["details"], r["rows"], r["removed"]) for r in rows] == [(1, "load", "", 100, 0), (2, "filter", "even", 50, 50)]
    plain = spark.range(100).repartition(3).filter("id % 2 = 0")
    spark.sparkContext.setJobGroup("plain", "plain")
    plain.write.format("noop").mode("overwrite").save()
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_type_histogram_and_required_columns(spark):
    one, two = spark.createDataFrame([(1, 2, "a")], "a long, b long, c string"), spark.createDataFrame([(1, 2.0)], "a long, d double")
    assert [tuple(r) for r in compare.type_histogram(one, two).collect()] == [("bigint", 2, 1, -1), ("double", 0, 1, 1), ("string", 1, 0, -1)]
    for f in (clean.clean, features.product_channel, features.rfm, lambda df: features.demographic(df, {}, []), lambda df: scale.scaled(df, ["x"])):
        with pytest.raises(ValueError, match="missing columns"):
            f(one)


def test_silhouette_estimate_keeps_its_bound(spark):
    points = np.vstack([RNG.normal(c, 1.0, (m, 2)) for c, m in (((0, 0), 3000), ((3, 0), 1500), ((0, 4), 300), ((9, 9), 1))])
    own = cluster._square(points, np.array([[0, 0], [3, 0], [0, 4], [9, 9.0]])).argmin(axis=1)
    df = spark.createDataFrame([(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(points, own))], "ID long, x double, y double, cluster int").repartition(4).cache()
    exact = cluster.silhouettes(df, ["x", "y"]).agg(F.avg("s")).first()[0]
    for seed, error in ((1, 0.05), (2, 0.02), (3, 0.02)):
        mean, bound, n = cluster.silhouette_estimate(df, ["x", "y"], error, exact_up_to=100, seed=seed)
        assert abs(mean - exact) <= bound <= error and n < 4801
    assert cluster.silhouette_estimate(df, ["x", "y"], 0.05) == (pytest.approx(exact), 0.0, 4801)
    row = cluster.measured(df.drop("cluster"), ["x", "y"], {2: [[0.0, 0.0], [3.0, 0.0]]}, 0.05).first()
    assert -1 <= row["silhouette"] <= 1


def test_principal_components(spark):
    x = RNG.normal(size=(300, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    means, loadings, shares = transform.principal(df, ["a", "b", "c"], 2)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    assert np.allclose(means, x.mean(axis=0)) and np.allclose(shares, values[::-1][:2] / values.sum())
    assert np.allclose(abs(loadings @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-9)
