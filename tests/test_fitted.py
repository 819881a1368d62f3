"""Fitted models, seeding, bounded Lloyd, distinct and frequent values, exact quantiles: against numpy and plain counts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import stats, values
from tessella.operators import cluster, family, scale, transform

RNG = np.random.default_rng(11)


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(None if v is None else v.item() if isinstance(v, np.generic) else v for v in r) for r in zip(*columns.values())]
    kinds = ["long" if n == "ID" else "string" if isinstance(next((v for v in columns[n] if v is not None), 0.0), str) else "double" for n in names]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).repartition(3)


def test_quantiles_with_nan_and_equal_values(spark):
    n = 30_000
    x = RNG.normal(size=n)
    columns = {"nan": np.where(np.arange(n) % 2, np.nan, x), "same": np.full(n, 7.0), "few": RNG.integers(0, 3, n).astype(float), "inf": np.where(np.arange(n) % 5, x, np.inf)}
    got = stats.quantile_values(frame(spark, **columns), list(columns), [0.0, 0.25, 0.5, 0.9, 1.0])
    for c, v in columns.items():
        s = np.sort(v)  # NaN last
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            h = q * (n - 1)
            low, high = s[math.floor(h)], s[math.ceil(h)]
            want = low if low == high or h == math.floor(h) else low + (h - math.floor(h)) * (high - low)
            assert got[c, q] == pytest.approx(want, nan_ok=True), (c, q)
    assert stats.quantile_values(frame(spark, a=[None, None]), ["a"], [0.5]) == {("a", 0.5): None}


def llf(x, lam):
    y = np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def yeo(x, lam):
    up = np.log1p(x.clip(0)) if lam == 0 else ((x.clip(0) + 1) ** lam - 1) / lam
    down = -np.log1p(-x.clip(None, 0)) if lam == 2 else -((1 - x.clip(None, 0)) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, up, down)


def test_exponents_of_many_columns(spark, monkeypatch):
    z = RNG.normal(3, 0.4, 3000).clip(1)
    columns = {"far": z ** (1 / 9.0), "root": z**2, "neg": RNG.gamma(2, 2, 3000) - 2, "same": np.full(3000, 4.0), "huge": z**0.2 * 1e60}
    df = frame(spark, **columns).withColumn("none", F.lit(None).cast("double")).cache()
    jobs = []
    monkeypatch.setattr(transform, "_spreads", lambda *a, f=transform._spreads: jobs.append(1) or f(*a))
    methods = dict.fromkeys(["far", "root", "same", "huge", "none"], transform.BOX_COX) | {"neg": transform.YEO_JOHNSON}
    got = transform.fit_many(df, methods)
    assert len(jobs) <= 8 and got["same"] == got["none"] == 1.0
    assert got["far"] > 5
    for c in ("far", "root"):
        near = np.linspace(got[c] - 0.5, got[c] + 0.5, 201)
        assert llf(columns[c], got[c]) >= max(llf(columns[c], p) for p in near) - 1e-6
    assert got["huge"] == pytest.approx(5 * got["root"] * 2 / 1.0, rel=0.02)
    x = columns["neg"]
    at = lambda p: (p - 1) * (np.sign(x) * np.log1p(abs(x))).sum() - len(x) / 2 * np.log(yeo(x, p).var())
    assert at(got["neg"]) >= max(at(p) for p in np.linspace(-2, 3, 401)) - 1e-6


def test_box_cox_with_values_that_are_not_positive(spark):
    x = RNG.normal(3, 0.4, 2000).clip(1) ** 2
    df = frame(spark, a=[*x, 0.0, 0.0, -1.0, None], b=[*x, *x[:4]])
    got = transform.fit_many(df, {"a": transform.BOX_COX})["a"]
    assert got == pytest.approx(transform.fit(frame(spark, a=x), "a", transform.BOX_COX))
    assert df.agg(F.count(transform.in_domain("a", transform.BOX_COX))).first()[0] == len(x)
    zero = frame(spark, a=[*x, 0.0])
    found = {r["lambda"]: r["llf"] for r in transform.log_likelihoods(zero, "a", transform.BOX_COX, [-1.0, 0.0, 0.5, 1.0, 2.0]).collect()}
    assert found[0.5] == math.inf and found[2.0] == -math.inf and all(math.isnan(found[p]) for p in (-1.0, 0.0, 1.0))


@pytest.fixture(scope="module")
def blobs():
    return np.vstack([RNG.normal(c, 0.6, (400, 2)) for c in ((0, 0), (5, 0), (0, 5), (6, 6), (10, 1))])


def test_parallel_seeds_and_bounded_lloyd(spark, blobs):
    df = frame(spark, ID=np.arange(len(blobs)), x=blobs[:, 0], y=blobs[:, 1]).cache()
    cost = lambda c: cluster._square(blobs, c).min(axis=1).sum()
    models = [(5, s) for s in range(4)] + [(3, 1)]
    new, old = cluster.seed_many(df, ["x", "y"], models), cluster.seed_in_turn(df, ["x", "y"], models)
    assert [c.shape for c in new] == [(5, 2)] * 4 + [(3, 2)]
    assert min(map(cost, new[:4])) <= min(map(cost, old[:4]))
    text = df.withColumn("ID", F.concat(F.lit("k"), "ID"))
    assert cluster.seed_many(text, ["x", "y"], [(4, 0)])[0].shape == (4, 2)
    with pytest.raises(ValueError):
        cluster.seed_many(frame(spark, ID=[1, 2, 3], x=[1.0, 1.0, 1.0]), ["x"], [(2, 0)])

    start = blobs[[0, 1, 2, 900, 1900]]
    (want, inertia, _), = cluster.lloyd_many(df, ["x", "y"], [start])
    got, total, spent = cluster.lloyd_bounded(df, ["x", "y"], start.tolist())
    assert np.allclose(got, want, atol=1e-9) and total == pytest.approx(inertia)
    assert spent[0] == len(blobs) * 5 and spent[-1] < len(blobs)
    # a centre without rows takes the farthest row, as in lloyd_many
    start = np.array([[0.0, 0.0], [100.0, 100.0], [5.0, 5.0]])
    assert np.allclose(cluster.lloyd_bounded(df, ["x", "y"], start.tolist(), 4)[0], cluster.lloyd_many(df, ["x", "y"], [start], 4)[0][0], atol=1e-9)
    with pytest.raises(ValueError):
        cluster.lloyd_bounded(df.limit(0), ["x", "y"], start.tolist())


def made(df, cut):
    return df.withColumns({"sum": F.col("a") + F.col("b"), "ratio": F.least(F.col("a") / F.col("b"), F.lit(cut))})


FAMILY = family.Family("f", made, {"a": "a_T"}, 0.5, ["a_T", "b", "sum", "ratio"], None, ["tag"], lambda df: stats.quantile_values(df.withColumn("r", F.col("a") / F.col("b")), ["r"], [0.99])["r", 0.99], 2)


def test_family_is_fitted_saved_and_applied(spark, tmp_path):
    a, b = RNG.gamma(2, 3, 900) + 0.1, RNG.gamma(3, 2, 900) + 0.1
    data = {"ID": np.arange(900), "a": a, "b": b, "tag": RNG.normal(size=900)}
    df = frame(spark, **data)
    model, inertia = family.fit(df, FAMILY)
    # numpy, step by step
    cut = np.quantile(a / b, 0.99)
    lam = model.exponents[0][3]
    t, total, ratio = (a**lam - 1) / lam, a + b, np.minimum(a / b, cut)
    assert model.cut == pytest.approx(cut) and model.exponents[0][:3] == ("a", "a_T", transform.BOX_COX)
    have, gone, pairs = {"a_T": t, "b": b, "sum": total, "ratio": ratio}, set(), []
    names = list(have)
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            r = np.corrcoef(have[p], have[q])[0, 1]
            if abs(r) >= 0.7 and not {p, q} & gone:
                gone |= {p, q}
                pairs.append((p, q, r))
    assert pairs and [p[:2] for p in model.pairs] == [p[:2] for p in pairs]
    z = lambda v: (v - v.mean()) / v.std()
    parts = {c: v for c, v in have.items() if c not in gone}
    parts |= {transform.component_name(p, q): (z(have[p]) + np.sign(r) * z(have[q])) / np.sqrt(2) for p, q, r in pairs}
    assert model.columns == list(parts)
    scaled = np.column_stack([(v - np.median(v)) / (np.quantile(v, 0.75) - np.quantile(v, 0.25)) for v in parts.values()])
    d2 = cluster._square(scaled, np.array(model.centers))
    assert inertia == pytest.approx(d2.min(axis=1).sum(), rel=1e-6)
    # the saved model gives the same scores, row by row, whatever rows it is applied to
    path = family.save(spark, [model], str(tmp_path / "model"))
    again = family.load(spark.read.parquet(path))["f"]
    assert again == model
    got = {r["ID"]: r for r in family.score(df, FAMILY, again).collect()}
    assert [got[i]["cluster"] for i in range(900)] == d2.argmin(axis=1).tolist()
    assert np.allclose([got[i]["d2"] for i in range(900)], d2.min(axis=1))
    assert np.allclose([got[i]["tag"] for i in range(900)], data["tag"])
    one = family.score(df.filter("ID = 5").unionByName(frame(spark, ID=[-1], a=[None], b=[1.0], tag=[0.0])), FAMILY, again).collect()
    assert {r["ID"]: r["cluster"] for r in one} == {5: got[5]["cluster"], -1: None}
    assert "Aggregate" not in family.score(df, FAMILY, again)._jdf.queryExecution().executedPlan().toString()


def test_scaling_state(spark):
    df = frame(spark, ID=[1, 2, 3, 4], a=[1.0, 2.0, 3.0, 10.0], b=[5.0, 5.0, 5.0, 5.0])
    for kind in (scale.STANDARD, scale.ROBUST):
        state = scale.fitted(df, ["a", "b"], kind)
        want = {r["ID"]: r for r in scale.scaled(df, ["a", "b"], kind).collect()}
        assert all(r["a"] == pytest.approx(want[r["ID"]]["a"]) and r["b"] == 0 for r in scale.apply(df, state).collect())
    with pytest.raises(ValueError):
        scale.fitted(df.withColumn("c", F.lit(None).cast("double")), ["c"])


def test_distinct_counts_need_no_expand(spark):
    n = 3000
    long = ["x" * 100 + str(i % 7) for i in range(n)]
    df = spark.createDataFrame([(i % 11 if i % 5 else None, [-0.0, 0.0, math.nan, 1.5][i % 4], long[i], [i % 3], bytes([i % 2]), i) for i in range(n)], "a int, b double, c string, d array<int>, e binary, f long").repartition(4)
    found = values.distinct_counts(df, df.columns)
    want = {"a": (11, 600), "b": (3, 0), "c": (7, 0), "d": (3, 0), "e": (2, 0), "f": (n, 0)}
    assert {r["column"]: (r["n_distinct"], r["n_missing"]) for r in found.collect()} == want
    assert all(r["n_rows"] == n for r in found.collect())
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in values.distinct_counts(df.limit(0), ["a", "b"]).collect()} == {("a", 0, 0, 0), ("b", 0, 0, 0)}


def test_merging_of_value_counts(spark, monkeypatch):
    monkeypatch.setattr(values, "HELD", 50)
    df = spark.range(1000).selectExpr("id % 300 AS a", "id % 7 AS b").repartition(3)
    got = {(r["column"], r["value"]): r["n"] for r in values.value_counts(df, ["a", "b"]).collect()}
    assert got == {("a", str(k)): v for k, v in Counter(i % 300 for i in range(1000)).items()} | {("b", str(k)): v for k, v in Counter(i % 7 for i in range(1000)).items()}


def test_duplicates_share_one_exchange(spark):
    rows = [(1, None, "x", 0.0), (1, None, "x", -0.0), (2, None, "x", 0.0), (3, "null", "x", 0.0), (3, "null", "y", 1.0), (4, "a", "b,c", 1.0), (5, "a,b", "c", 1.0)]
    df = spark.createDataFrame(rows, "ID long, a string, b string, c double")
    found = values.duplicates(df, {"row": df.columns, "features": ["a", "b", "c"], "key": ["ID"]})
    assert {r["name"]: tuple(r)[1:] for r in found.collect()} == {"row": (1, 2, 1), "features": (2, 3, 1), "key": (2, 4, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(x#") <= 1 and "hashpartitioning(ID" not in plan
    assert {tuple(r) for r in values.duplicates(df.limit(0), {"row": ["a"]}).collect()} == {("row", 0, 0, 0)}


@pytest.mark.parametrize("counters", [20, 4096])
def test_top_values(spark, counters):
    heavy = [v for i, k in enumerate([900, 700, 700, 500, 300]) for v in [i] * k]
    for tail in (range(100, 1300), range(100, 30100)):  # the bound decides, and does not
        xs = heavy + list(tail)
        RNG.shuffle(xs)
        df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 9, "v long").repartition(3)
        want = sorted(Counter(xs).items(), key=lambda x: (-x[1], x[0]))
        for n in (4, 8):
            top, nulls, more = values.top_values(df, "v", n, counters)
            assert [tuple(r) for r in top.collect()] == want[:n] and nulls == 9 and more
    few, _, more = values.top_values(spark.createDataFrame([("a",), ("b",), ("a",)], "v string"), "v", 5)
    assert [tuple(r) for r in few.collect()] == [("a", 2), ("b", 1)] and not more
    assert values.top_values(df.limit(0), "v", 3)[0].collect() == []
