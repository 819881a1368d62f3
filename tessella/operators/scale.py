"""Standard and robust scaling with exact statistics, and their self-checks. Other columns pass through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import roles
from tessella.functions.stats import quantile_values, quantiles, skew_adjusted, tall
from tessella.sources.io import settle

STANDARD, ROBUST = "standard", "robust"
TIGHT = 1e-10


def _centre_and_spread(df: DataFrame, columns: list[str], kind: str) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    if kind == STANDARD:
        return F.avg, F.stddev_pop
    at = quantiles(df, columns, [0.25, 0.5, 0.75])
    return (lambda c: at(c, 0.5)), (lambda c: at(c, 0.75) - at(c, 0.25))


def _state(df: DataFrame, columns: list[str], kind: str) -> dict[str, tuple[float | None, float | None]]:
    """column -> (centre, spread); a spread of zero is one, a column without values has neither."""
    if kind == STANDARD:
        row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("c", F.avg), ("s", F.stddev_pop))]).first()
        found = {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    else:
        at = quantile_values(df, columns, [0.25, 0.5, 0.75])
        found = {c: (at[c, 0.5], None if at[c, 0.5] is None else at[c, 0.75] - at[c, 0.25]) for c in columns}
    return {c: (centre, 1.0 if spread == 0 else spread) for c, (centre, spread) in found.items()}


def fitted(df: DataFrame, columns: list[str], kind: str = ROBUST) -> dict[str, tuple[float, float]]:
    """column -> (centre, spread), to scale other rows with. A column without values raises ValueError."""
    found = _state(df, columns, kind)
    if missing := [c for c, (centre, _) in found.items() if centre is None]:
        raise ValueError(f"columns without values: {missing}")
    return {c: (float(centre), float(spread)) for c, (centre, spread) in found.items()}


def apply(df: DataFrame, state: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Columns scaled in place with a fitted state: row expressions only."""
    number = lambda x: F.lit(x).cast("double")
    return df.withColumns({c: (F.col(c) - number(centre)) / number(spread) for c, (centre, spread) in state.items()})


def scaled(df: DataFrame, columns: list[str], kind: str = STANDARD) -> DataFrame:
    """(x - centre) / spread; a spread of zero counts as one. `df` is computed once, for its constants and for the result."""
    roles.assert_columns(df, columns)
    held = settle(df)
    return apply(held, _state(held, columns, kind))


def stats(df: DataFrame, columns: list[str], population: bool = False) -> DataFrame:
    """The metrics of each feature before (sample) or after (population) scaling."""
    at = quantiles(df, columns, [0.25, 0.5, 0.75])
    return tall(df, columns, {
        "n": F.count, "mean": F.avg, "std": F.stddev_pop if population else F.stddev_samp, "least": F.min, "greatest": F.max,
        "median": lambda c: at(c, 0.5), "iqr": lambda c: at(c, 0.75) - at(c, 0.25), "skew": skew_adjusted,
        "n_missing": lambda c: F.count_if(F.col(c).isNull()),
    })


def validated(df: DataFrame, columns: list[str], kind: str = STANDARD, tolerance: float = TIGHT) -> DataFrame:
    """(feature, centred, unit_spread, n_missing): whether the scaled features are as they should be."""
    centre, spread = _centre_and_spread(df, columns, kind)
    found = tall(df, columns, {"centre": centre, "spread": spread, "n_missing": lambda c: F.count_if(F.col(c).isNull())})
    return found.select("feature", (F.abs("centre") < tolerance).alias("centred"), (F.abs(F.col("spread") - 1) < tolerance).alias("unit_spread"), "n_missing")


def preserved(before: DataFrame, after: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Whether scaling left `columns` as they were, row by row."""
    old = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = after.join(old, F.col(key) == F.col("_key"), "full_outer")
    return joined.agg(*[F.coalesce(F.bool_and(F.col(c).eqNullSafe(F.col(f"_{c}"))), F.lit(True)).alias(c) for c in columns])


def split_features(columns: list[str], candidates: list[str]) -> tuple[list[str], list[str]]:
    """(clustering features, reference columns): columns among the candidates, in their own order, and all others."""
    return [c for c in columns if c in candidates], [c for c in columns if c not in candidates]
