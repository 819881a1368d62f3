"""Base operators against pandas, numpy and SQL on small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella import roles
from tessella.functions import stats
from tessella.operators import clean, cluster, features, profile, scale, transform
from tessella.plans import oracle, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ID": range(200), "a": rng.gamma(2.0, 3.0, 200), "b": rng.normal(0, 1, 200)})
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 0.5, 200)
    pdf["flat"] = 1.0
    return spark.createDataFrame(pdf), pdf


def one(df):
    return df.first().asDict()


def test_every_query_is_registered():
    assert set(oracle.SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 120
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rfm_features", "dup_full_row", "outlier_iqr_spending", "feat_dependency", "corr_matrix", "davies_bouldin", "posthoc_education", "elbow_point"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.execute(oracle.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(repr(r) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == theirs


def test_statistics_match_pandas(numbers):
    df, pdf = numbers
    row = one(df.agg(stats.skew_adjusted("a").alias("s"), stats.skew_adjusted("flat").alias("f"), stats.quantiles(df, ["a"], [0.99])("a", 0.99).alias("q"), stats.correlation("a", "c").alias("r"), stats.correlation("a", "flat").alias("n")))
    assert row["s"] == pytest.approx(pdf["a"].skew()) and row["f"] == 0.0 and row["q"] == pytest.approx(pdf["a"].quantile(0.99))
    assert row["r"] == pytest.approx(pdf["a"].corr(pdf["c"])) and row["n"] is None


def test_skew_of_two_values_is_null(spark):
    assert one(spark.createDataFrame([(1.0,), (2.0,)], ["x"]).agg(stats.skew_adjusted("x").alias("s")))["s"] is None


def test_fitted_exponents_are_most_likely(numbers):
    df, pdf = numbers
    lam = transform.fit(df, "a", transform.BOX_COX)
    x = pdf["a"].to_numpy()
    llf = lambda p: (p - 1) * np.log(x).sum() - len(x) / 2 * np.log((np.log(x) if p == 0 else (x**p - 1) / p).var())
    assert llf(lam) >= max(llf(p) for p in np.linspace(-3, 3, 601)) - 1e-6
    assert one(transform.decision(df, "b", 0.0001))["method"] == transform.YEO_JOHNSON
    assert one(transform.decision(df, "flat", 0.5))["method"] == transform.NONE


def test_scaling(numbers):
    df, pdf = numbers
    for kind in (scale.STANDARD, scale.ROBUST):
        out = scale.scaled(df, ["a", "flat"], kind)
        checks = {r["feature"]: r for r in scale.validated(out, ["a", "flat"], kind).collect()}
        assert checks["a"]["centred"] and checks["a"]["unit_spread"] and not checks["flat"]["unit_spread"]
        assert all(one(scale.preserved(df, out, ["b", "c"], "ID")).values())


def test_pair_reduction_is_the_first_component(numbers):
    df, pdf = numbers
    pairs = transform.pairs_to_reduce(df, ["a", "b", "c"])
    assert [p[:2] for p in pairs] == [("a", "c")]
    got = transform.reduce_pairs(df.select("ID", "a", "b", "c"), pairs).toPandas().sort_values("ID")
    z = (pdf[["a", "c"]] - pdf[["a", "c"]].mean()) / pdf[["a", "c"]].std(ddof=0)
    assert list(got.columns) == ["ID", "b", "PC1_a_c"]
    assert np.allclose(got["PC1_a_c"], z.sum(axis=1) / np.sqrt(2))


def test_silhouettes_across_blocks(numbers):
    df, pdf = numbers
    assigned = cluster.assign(df, ["a", "b"], [[2.0, 0.0], [12.0, 0.0]])
    x, labels = pdf[["a", "b"]].to_numpy(), assigned.orderBy("ID").toPandas()["cluster"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i, own in enumerate(labels):
        a = d[i, labels == own].sum() / max(1, (labels == own).sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        want.append((b - a) / max(a, b))
    got = cluster.silhouettes(assigned, ["a", "b"], block=32).orderBy("ID").toPandas()["s"]
    assert np.allclose(got, want)


def test_silhouettes_of_equal_points_and_what_they_move(spark, monkeypatch):
    """Copies share one point; sums of distances leave a task once for each point, whatever the number of blocks."""
    x = np.repeat(np.random.default_rng(3).normal(size=(150, 2)).round(1), 4, axis=0)
    x[7] = -0.0
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ID long, a double, b double").repartition(3).cache()
    centers = {2: [[-1.0, 0.0], [1.0, 0.0]], 3: [[-1.0, 0.0], [1.0, 0.0], [50.0, 0.0]], 4: [[0.0, 0.0], [9.0, 9.0], [0.5, 1.0], [-1.0, -1.0]]}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    packed, settle = [], cluster.settle
    monkeypatch.setattr(cluster, "settle", lambda df: packed.append(settle(df)) or packed[-1])
    got = cluster.mean_silhouettes(df, ["a", "b"], centers)
    for k, c in centers.items():
        own = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).argmin(axis=1)
        a = [d[i, own == o].sum() / max(1, (own == o).sum() - 1) for i, o in enumerate(own)]
        b = [min(d[i, own == q].mean() for q in set(own) if q != o) for i, o in enumerate(own)]
        s = [(q - p) / max(p, q) if (own == o).sum() > 1 else 0.0 for p, q, o in zip(a, b, own)]
        assert got[k] == pytest.approx(np.mean(s), abs=1e-12)
        rows = cluster.silhouettes(cluster.assign(df, ["a", "b"], c), ["a", "b"], block=16).orderBy("ID").toPandas()
        assert len(rows) == len(x) and np.allclose(rows["s"], s)
    points = len(np.unique(x + 0.0, axis=0))
    assert packed[0].count() == points and sum(len(r["data"]) for r in packed[1].collect()) == points * 8 * (2 + 3 + 1)


def test_exact_curve_of_many_rows(spark):
    """Beyond the rows that the estimate takes exactly, the curve of given centres has the exact silhouette, as its SQL has."""
    df = spark.range(24_000).selectExpr("id AS ID", "double(id % 240) AS x").cache()
    found = cluster.mean_silhouettes(df, ["x"], {2: [[60.0], [180.0]]})[2]
    labelled = cluster.assign(df, ["x"], [[60.0], [180.0]])
    assert found == pytest.approx(cluster.silhouettes(labelled, ["x"]).agg(F.avg("s")).first()[0], abs=1e-12)
    x = np.arange(240.0)
    d = abs(x[:, None] - x[None]) * 100
    own = x > 120
    a, b = np.where(own, d[:, own].sum(axis=1), d[:, ~own].sum(axis=1)) / (np.where(own, own.sum(), (~own).sum()) * 100 - 1), np.where(own, d[:, ~own].mean(axis=1), d[:, own].mean(axis=1)) / 100
    assert found == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)


def test_lloyd_refills_an_empty_cluster(numbers):
    df, _ = numbers
    centers = cluster.lloyd(df, ["a", "b"], [[2.0, 0.0], [900.0, 900.0]], 20)
    assert len(centers) == 2 and cluster.sizes(cluster.assign(df, ["a", "b"], centers)).count() == 2


def test_cleaning_with_nulls_and_copies(spark):
    rows = [(1, 1970, "A", 10.0), (2, 1970, "A", 10.0), (2, 1970, "A", 10.0), (3, 1880, "B", 5.0), (4, None, "B", 5.0), (5, 1990, "B", 600000.0)]
    df = spark.createDataFrame(rows, "ID long, Year_Birth long, Education string, Income double")
    assert {r["ID"] for r in clean.dedupe(df).collect()} == {1, 3, 4, 5}
    assert {r["ID"] for r in clean.remove_outliers(df).collect()} == {1, 2, 4}
    assert sorted((r["ID"], r["reason"]) for r in clean.removed_records(df).collect()) == [(3, "too old"), (5, "suspicious income")]
    counts = one(profile.duplicate_counts(df, df.columns))
    assert (counts["surplus"], counts["in_groups"], counts["n_groups"]) == (1, 2, 1)
    got = {r["Education"]: r["code"] for r in df.select("Education", clean.ordinal("Education", ["A"]).alias("code")).collect()}
    assert got == {"A": 0, "B": None}


def test_ratios_of_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(features.ratio("a", "b")).collect()] == [0.0, 0.5, 0.0]


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError):
        roles.assert_columns(spark.range(1), ["Income"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "ID long, a double")
    assert one(profile.duplicate_counts(empty, ["a"]))["surplus"] == 0
    assert scale.scaled(empty, ["a"]).count() == 0
    assert one(empty.agg(F.count("*").alias("n")))["n"] == 0


def test_kmeans_queries_make_ten_starts(spark, monkeypatch):
    import pyspark.ml.clustering as ml

    seeds, fit, many = [], ml.KMeans.fit, cluster.seed_many
    monkeypatch.setattr(cluster, "seed_many", lambda df, features, models, key: seeds.extend(seed for _, seed in models) or many(df, features, models, key))
    monkeypatch.setattr(ml.KMeans, "fit", lambda self, df: seeds.append(self.getSeed()) or fit(self, df))
    for name in ("kmeans_restarts", "kmeans_ml"):
        seeds.clear()
        registry.QUERIES[name](spark, SF)
        assert seeds == list(range(42, 52))


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantiles_narrow_down_to_the_exact_value(spark, monkeypatch, few):
    """Ties, a skewed column, nulls, a constant one and one without values; brackets are narrowed by several passes where few values may be fetched."""
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "ACCURACY", 50)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"ties": rng.integers(0, 5, 3000).astype(float), "skewed": np.exp(rng.normal(0, 6, 3000)), "flat": 2.5, "holes": np.where(rng.random(3000) < 0.4, np.nan, rng.normal(size=3000))})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "ties double, skewed double, flat double, holes double").withColumn("none", F.lit(None).cast("int"))
    shares = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    at = stats.quantiles(df, df.columns, shares)
    row = df.limit(1).select(*[at(c, q).alias(f"{c}{i}") for c in df.columns for i, q in enumerate(shares)]).first()
    for c in pdf.columns:
        assert [row[f"{c}{i}"] for i in range(len(shares))] == pytest.approx(list(pdf[c].quantile(shares)), rel=1e-12)
    assert row["none3"] is None
    assert stats.quantiles(df.limit(0), ["ties"], [0.5])("ties", 0.5) is not None


def test_sweep_against_numpy(spark):
    """Inertia, silhouette and Davies-Bouldin of the chosen centres, and that ten starts find the planted groups."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ID long, a double, b double")
    found = cluster.best_starts(df, ["a", "b"], [2, 3])
    centers, cost, rounds = found[3]
    assert rounds > 0 and sorted(np.round(centers).tolist()) == [[0, 0], [0, 6], [5, 5]]
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    own = d.argmin(axis=1)
    assert cost == pytest.approx(d.min(axis=1).sum()) and all(np.allclose(centers[k], x[own == k].mean(axis=0), atol=1e-3) for k in range(3))
    row = {r["k"]: r for r in cluster.measured(df, ["a", "b"], {3: centers.tolist()}).collect()}[3]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i, c in enumerate(own):
        a = far[i, own == c].sum() / ((own == c).sum() - 1)
        b = min(far[i, own == o].mean() for o in range(3) if o != c)
        s.append((b - a) / max(a, b))
    mid = np.array([x[own == k].mean(axis=0) for k in range(3)])
    spread = [np.sqrt(((x[own == k] - mid[k]) ** 2).sum(axis=1)).mean() for k in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(mid[i] - mid[j]) for j in range(3) if j != i) for i in range(3)])
    assert row["silhouette"] == pytest.approx(np.mean(s)) and row["davies_bouldin"] == pytest.approx(db)
    curve = cluster.sweep(df, ["a", "b"], range(2, 5), starts=3)
    assert {r["k"]: r["wcss"] for r in curve.collect()}[3] == pytest.approx(cost, rel=1e-3) and cluster.vote(curve).first()["silhouette_k"] == 3


def test_clustering_of_too_few_rows_is_refused(spark):
    empty = spark.createDataFrame([], "ID long, a double")
    two = spark.createDataFrame([(1, 1.0), (2, 1.0)], "ID long, a double")
    for df, k in ((empty, 1), (two, 3), (two, 2)):
        with pytest.raises(ValueError):
            cluster.kmeans(df, ["a"], k)
    with pytest.raises(ValueError):
        cluster.random_centers(two, ["a"], 3, 1)
    with pytest.raises(ValueError):
        cluster.lloyd_many(empty, ["a"], [np.zeros((1, 1))])


def test_components_against_numpy(numbers):
    df, pdf = numbers
    means, loadings, shares = transform.principal(df, ["a", "b", "c"], 3)
    x = pdf[["a", "b", "c"]].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(shares, values[::-1] / values.sum()) and np.allclose(np.abs(loadings), np.abs(vectors.T[::-1]), atol=1e-6)
    got = transform.projected(df, ["a", "b", "c"], means, loadings).orderBy("ID").toPandas()
    assert np.allclose(got[["PC1", "PC2", "PC3"]], (x - x.mean(axis=0)) @ np.array(loadings).T)


def test_yeo_johnson_exponent_is_most_likely(numbers):
    df, pdf = numbers
    x = pdf["b"].to_numpy()

    def llf(p):
        y = np.where(x >= 0, ((np.maximum(x, 0) + 1) ** p - 1) / p if p else np.log1p(np.maximum(x, 0)), -(((1 - np.minimum(x, 0)) ** (2 - p) - 1) / (2 - p)) if p != 2 else -np.log1p(-np.minimum(x, 0)))
        return (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() - len(x) / 2 * np.log(y.var())

    assert llf(transform.fit(df, "b", transform.YEO_JOHNSON)) >= max(llf(p) for p in np.linspace(-1, 3, 401)) - 1e-6


def test_reports_and_schemas(spark, tmp_path):
    import json

    from tessella.operators import compare
    from tessella.sources import io

    report = json.loads(registry.QUERIES["encoding_report_json"](spark, "/root/testdata/sf0.01").first()[0])
    assert report["marital_status_encoding"]["rare_categories"] == ["ALONE"] and "Marital_Other" in report["marital_status_encoding"]["dummy_columns"]
    a, b = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(1.0, 2)], "a double, c long")
    assert sorted(tuple(r) for r in compare.schema_diff(a, b).collect()) == [("a", "bigint", "double"), ("b", "string", None), ("c", None, "bigint")]
    path = str(tmp_path / "out")
    for v in ("old", "new"):
        io.write_delimited(spark.createDataFrame([(1, v)], "a long, b string"), path)
    assert [tuple(r) for r in io.read_delimited(spark, path, a.schema).collect()] == [(1, "new")] and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception):
        io.write_delimited(spark.range(1).select(F.raise_error(F.lit("stop")).alias("a")), path)
    assert io.read_delimited(spark, path, a.schema).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]
    io.write_text(spark.createDataFrame([("s", "k", 1.5)], "section string, key string, value double"), str(tmp_path / "text"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["s | k | 1.5"]
    assert scale.split_features(["x", "Product_HHI", "y"], ["y", "Product_HHI"]) == (["Product_HHI", "y"], ["x"])


def test_trained_families_and_summary(spark):
    rows = registry.QUERIES["trained_families"](spark, SF).collect()
    assert {f: sum(r["family"] == f for r in rows) for f in roles.TRAINED_K} == roles.TRAINED_K
    found = {(r["section"], r["key"]): r["value"] for r in registry.QUERIES["cluster_summary"](spark, SF).collect()}
    assert found["explained", "PC1"] >= found["explained", "PC2"] >= found["explained", "PC3"] and found["quality", "rounds"] >= 1
    assert sum(v for (s, _), v in found.items() if s == "explained") == pytest.approx(1) and -1 <= found["quality", "silhouette"] <= 1


def test_transforms_lessen_skew(spark):
    rows = registry.QUERIES["transform_report"](spark, SF).collect()
    assert rows and all(abs(r["skew_after"]) <= abs(r["skew_before"]) + 1e-9 for r in rows)
