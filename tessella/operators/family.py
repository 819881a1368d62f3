"""Fitted feature families: power transforms, reduction of pairs, scaling and clusters, fitted once, kept as one table and applied to other rows.

A family says how its features are made, which of them are transformed when they are skewed, which columns may be clustered and which
pairs become one component. Fitting settles the features once; what it finds is a few numbers for each step. Applying a model is row expressions
only: it reads no statistics of the rows that it is applied to.

Edges: rows with a null in a column that is to be clustered do not take part in fitting and have no cluster. A column without values
cannot be fitted (ValueError), nor can fewer different rows than clusters. Columns that a step adds replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import roles
from tessella.operators import cluster, scale, transform
from tessella.sources import io

SCHEMA = "family string, step string, place int, name string, method string, inputs array<string>, numbers array<double>"


@dataclass(frozen=True)
class Family:
    """make(df, cut) gives the features; cut(df), where there is one, a number that it needs from the rows of fitting. `transforms`: feature
    -> what it is called afterwards. `pairs`: (feature, feature) to reduce; None: those that correlate, in column order."""

    name: str
    make: Callable[[DataFrame, float | None], DataFrame]
    transforms: dict[str, str]
    threshold: float
    candidates: list[str]
    pairs: list[tuple[str, str]] | None = None
    reference: list[str] = field(default_factory=list)
    cut: Callable[[DataFrame], float | None] | None = None
    k: int = 2


@dataclass(frozen=True)
class Model:
    """What fitting found. exponents: (feature, name, method, exponent); pairs: (feature, feature, name, mean, spread, mean, spread,
    sign); scales: column -> (centre, spread), in the order of the clustered columns; centres in scaled space."""

    family: str
    cut: float | None
    exponents: list[tuple[str, str, str, float | None]]
    pairs: list[tuple[str, str, str, float, float, float, float, float]]
    scales: dict[str, tuple[float, float]]
    centers: list[list[float]]

    @property
    def columns(self) -> list[str]:
        return list(self.scales)

    def rows(self) -> list[tuple]:
        out = [("cut", 0, "", "", [], [])] if self.cut is None else [("cut", 0, "", "", [], [self.cut])]
        out += [("transform", i, name, method, [c], [] if lam is None else [lam]) for i, (c, name, method, lam) in enumerate(self.exponents)]
        out += [("pair", i, name, "", [a, b], numbers) for i, (a, b, name, *numbers) in enumerate(self.pairs)]
        out += [("scale", i, c, "", [c], list(state)) for i, (c, state) in enumerate(self.scales.items())]
        out += [("centre", i, "", "", self.columns, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        return [(self.family, *r) for r in out]


def table(spark: SparkSession, models: list[Model]) -> DataFrame:
    """The models as one table, some ten rows for each."""
    return spark.createDataFrame([r for m in models for r in m.rows()], SCHEMA)


def save(spark: SparkSession, models: list[Model], path: str) -> str:
    return io.write_table(table(spark, models).coalesce(1), path)


def load(df: DataFrame) -> dict[str, Model]:
    """family -> model, from a model table."""
    steps: dict[str, dict[str, list]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["family"], r["step"], r["place"])):
        steps.setdefault(r["family"], {}).setdefault(r["step"], []).append((r["name"], r["method"], r["inputs"], r["numbers"]))
    found = {}
    for name, has in steps.items():
        exponents = [(i[0], n, m, x[0] if x else None) for n, m, i, x in has.get("transform", [])]
        pairs = [(*i, n, *x) for n, _, i, x in has.get("pair", [])]
        cut = has["cut"][0][3]
        found[name] = Model(name, cut[0] if cut else None, exponents, pairs, {n: tuple(x) for n, _, _, x in has["scale"]}, [x for _, _, _, x in has.get("centre", [])])
    return found


def features(df: DataFrame, family: Family, model: Model) -> DataFrame:
    """The family's features of any rows, transformed and with its components, as fitted; not scaled."""
    roles.assert_columns(df, [roles.ID])
    made = family.make(df, model.cut)
    made = made.withColumns({name: transform.power(c, method, lam) for c, name, method, lam in model.exponents})
    return transform.with_components(made, model.pairs)


def export(df: DataFrame, family: Family, model: Model) -> DataFrame:
    """ID, the columns to be clustered, and the columns that describe the clusters afterwards."""
    return features(df, family, model).select(roles.ID, *model.columns, *family.reference)


def score(df: DataFrame, family: Family, model: Model) -> DataFrame:
    """export() with the clustered columns scaled, the cluster of each row, and its squared distance to the centre."""
    return cluster.assign(scale.apply(export(df, family, model), model.scales), model.columns, model.centers)


def _components(df: DataFrame, family: Family) -> list[tuple]:
    """The pairs to reduce with their means, spreads and sign."""
    pairs = [(a, b) for a, b, _ in transform.pairs_to_reduce(df, family.candidates)] if family.pairs is None else family.pairs
    return transform.pair_state(df, pairs)


def compared(df: DataFrame, family: Family, ks: dict[str, int], error: float = 0.02, starts: int = 10, seed: int = 42) -> DataFrame:
    """(family, scaling, metric, value): the quality of the family's clustering under each way of scaling, with the number of clusters
    that `ks` has for it. The silhouette is within `error`; see silhouette_estimate()."""
    rows = []
    for kind, k in ks.items():
        model, cost = fit(df, replace(family, k=k), kind, starts, seed)
        found = io.settle(score(df, family, model).filter("cluster IS NOT NULL").select(roles.ID, "cluster", "d2", *model.columns))
        one = lambda x: float(x.first()[0])
        values = {
            "k": float(k), "inertia": cost, "silhouette": cluster.silhouette_estimate(found, model.columns, error)[0], "calinski_harabasz": one(cluster.calinski_harabasz(found, model.columns)),
            "davies_bouldin": one(cluster.davies_bouldin(found, model.columns)), "balance": one(cluster.balance(found)),
        }
        rows += [(family.name, kind, metric, value) for metric, value in values.items()]
    return df.sparkSession.createDataFrame(rows, "family string, scaling string, metric string, value double")


def fit(df: DataFrame, family: Family, kind: str = scale.ROBUST, starts: int = 10, seed: int = 42) -> tuple[Model, float]:
    """(model, inertia) of a family over the rows of `df`."""
    cut = family.cut(df) if family.cut else None
    sources = {name: c for c, name in family.transforms.items()}
    wanted = list(dict.fromkeys([*(sources.get(c, c) for c in family.candidates), *family.transforms]))
    made = io.settle(family.make(df, cut).select(roles.ID, *wanted).na.drop("any", subset=wanted))
    exponents = [(c, family.transforms[c], *step) for c, step in transform.plan(made, list(family.transforms), family.threshold).items()]
    made = made.withColumns({name: transform.power(c, method, lam) for c, name, method, lam in exponents})
    pairs = _components(made, family)
    gone = {c for a, b, *_ in pairs for c in (a, b)}
    columns = [c for c in family.candidates if c not in gone] + [p[2] for p in pairs]
    made = io.settle(transform.with_components(made, pairs).select(roles.ID, *columns))
    scales = scale.fitted(made, columns, kind)
    centers, cost, _ = cluster.best_starts(io.settle(scale.apply(made, scales)), columns, [family.k], starts, seed)[family.k]
    return Model(family.name, cut, exponents, pairs, scales, centers.tolist()), cost
