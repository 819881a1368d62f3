"""Exact statistics as expressions and aggregates over many columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from math import ceil, floor, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.crossproduct import correlations
from tessella.sources.io import settle

#: Values of a bracket that are fetched to take an order statistic from; and the accuracy of the sketch that narrows brackets.
FEW, ACCURACY = 10_000, 10_000
#: Columns whose pairs are expressions of one aggregate.
WIDE = 12


def unpivot(df: DataFrame, columns: list[str], key: str = "feature", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row for each (row, column): the column's name and its value as a double."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(*[f"`{k}`" for k in keep or []], f"stack({len(columns)}, {pairs}) AS (`{key}`, `{value}`)")


def tall(df: DataFrame, columns: list[str], metrics: dict, key: str = "feature") -> DataFrame:
    """One aggregate over `df`, one row for each column: metrics maps a name to column -> aggregate."""
    wide = df.agg(*[fn(c).alias(f"{c}__{m}") for c in columns for m, fn in metrics.items()])
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{c}__{m}").alias(m) for m in metrics]) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def skew_adjusted(c: str | Column) -> Column:
    """Bias-adjusted skewness; null below three values, zero for a constant column."""
    n = F.count(c).cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(adjusted)


def order_statistics(df: DataFrame, ranks: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """(column, rank from 0) -> the value of that rank among the column's values, which are doubles without nulls. NaN is the greatest.

    Every rank has a bracket: two values that it lies strictly between, with the number of values up to the lower one and within. A
    quantile sketch of the values inside gives two cuts, whose counts are then taken exactly: either the rank falls on a cut, or its
    bracket loses at least the cuts' own values, so that it always ends. Brackets shrink some thousandfold a pass, for all columns and
    ranks together. The last `FEW` values are fetched; nothing holds all values.
    """
    sizes = df.agg(*[F.count_if(~F.isnan(c)).alias(f"n{i}") for i, c in enumerate(ranks)]).first()
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float | None, int, float | None, int]] = {}  # above, values up to it, below, values inside
    for i, (c, rs) in enumerate(ranks.items()):
        for r in rs:
            if r < sizes[f"n{i}"]:
                open_[c, r] = (None, 0, None, sizes[f"n{i}"])
            else:
                found[c, r] = math.nan
    inside = lambda c, lo, hi: F.when(~F.isnan(c) & (F.lit(True) if lo is None else F.col(c) > lo) & (F.lit(True) if hi is None else F.col(c) < hi), F.col(c))
    while open_:
        asked, places = [], list(open_)
        for i, (c, r) in enumerate(places):
            lo, upto, hi, n = open_[c, r]
            place = (r - upto + 0.5) / n
            around = [max(0.0, place - 2 / ACCURACY), min(1.0, place + 2 / ACCURACY)]
            asked.append((F.sort_array(F.collect_list(inside(c, lo, hi))) if n <= FEW else F.percentile_approx(inside(c, lo, hi), around, ACCURACY)).alias(f"x{i}"))
        got = df.agg(*asked).first()
        cuts: dict[tuple[str, int], list[float]] = {}
        for i, at in enumerate(places):
            if open_[at][3] <= FEW:
                found[at] = got[f"x{i}"][at[1] - open_.pop(at)[1]]
            else:
                cuts[at] = list(got[f"x{i}"])
        if cuts:
            points = {p: i for i, p in enumerate(dict.fromkeys((c, x) for (c, _), xs in cuts.items() for x in xs))}
            counts = lambda c, x, i: [F.count_if(F.col(c) < x).alias(f"b{i}"), F.count_if(F.col(c) <= x).alias(f"u{i}")]
            row = df.agg(*[e for (c, x), i in points.items() for e in counts(c, x, i)]).first()
            for at, (x, y) in cuts.items():
                (lo, upto, hi, n), rank = open_[at], at[1]
                bx, ux, by, uy = (row[f"{name}{points[at[0], v]}"] for v in (x, y) for name in "bu")
                if bx <= rank < ux or by <= rank < uy:
                    found[at] = x if rank < ux else y
                    del open_[at]
                elif rank < bx:
                    open_[at] = (lo, upto, x, bx - upto)
                elif rank < by:
                    open_[at] = (x, ux, y, by - ux)
                else:
                    open_[at] = (y, uy, hi, upto + n - uy)
    return found


def quantile_values(df: DataFrame, columns: list[str], shares: list[float]) -> dict[tuple[str, float], float | None]:
    """(column, share) -> the exact quantile with linear interpolation; None for a column without values."""
    columns = list(dict.fromkeys(columns))
    held = settle(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    sizes = held.agg(*[F.count(f"c{i}") for i in range(len(columns))]).first()
    at = {(i, q): q * (n - 1) for i, n in enumerate(sizes) for q in shares if n}
    ranks: dict[str, set[int]] = {}
    for (i, _), h in at.items():
        ranks.setdefault(f"c{i}", set()).update((floor(h), ceil(h)))
    found = order_statistics(held, ranks) if ranks else {}

    def value(i: int, q: float) -> float | None:
        if (i, q) not in at:
            return None
        h = at[i, q]
        low, high = found[f"c{i}", floor(h)], found[f"c{i}", ceil(h)]
        return float(low if low == high or floor(h) == ceil(h) else (ceil(h) - h) * low + (h - floor(h)) * high)

    return {(c, q): value(i, q) for i, c in enumerate(columns) for q in shares}


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> Callable[[str, float], Column]:
    """quantile_values() as a function (column, share) -> literal."""
    found = quantile_values(df, columns, shares)
    return lambda c, q: F.lit(found[c, q]).cast("double")


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where a column is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    varies = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_matrix(df: DataFrame, columns: list[str], wide: int = WIDE) -> DataFrame:
    """(i, j, f1, f2, r) for i < j, from one aggregate; of more than `wide` columns, from products of blocks."""
    if len(columns) > wide:
        return correlations(df, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.agg(*[correlation(columns[i], columns[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    rows = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("f1"), F.lit(columns[j]).alias("f2"), F.col(f"r_{i}_{j}").alias("r"))
        for i, j in pairs
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def row_sum(columns: list[str]) -> Column:
    """Sum across columns that skips nulls."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal-width bins; the last bin holds the maximum; empty bins are listed."""
    spread = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    filled = df.filter(F.col(c).isNotNull()).crossJoin(F.broadcast(spread))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col(c) - F.col("lo"), width)), F.lit(bins - 1)))
    counts = filled.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = spread.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def density(df: DataFrame, c: str, points: int = 100) -> DataFrame:
    """(x, density) at evenly spaced points from the least to the greatest value: Gaussian kernels of Scott's bandwidth.

    The points are few and stand in every task; rows are read once and send one sum for each point. A constant column has no density.
    """
    facts = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.stddev_samp(c).alias("s"), F.count(c).alias("n")).filter("s > 0")
    facts = facts.withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1))
    rows = df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL").crossJoin(F.broadcast(facts.withColumn("at", at)))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2.0)) / (F.col("n") * F.col("h") * (2 * pi) ** 0.5)
    return rows.select("v", "h", "n", F.explode("at").alias("x")).groupBy("x").agg(F.sum(kernel).alias("density"))


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five numbers for each column: quartiles, and the outermost values within 1.5 IQR of them."""
    at = quantiles(df, columns, [0.25, 0.5, 0.75])
    q = tall(df, columns, {"q1": lambda c: at(c, 0.25), "median": lambda c: at(c, 0.5), "q3": lambda c: at(c, 0.75)})
    values = unpivot(df, columns).filter("value IS NOT NULL").join(F.broadcast(q), "feature")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return values.groupBy("feature", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"),
    )
