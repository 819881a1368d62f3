"""Two states of a table against each other: size, quality, statistics, schema."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import quantiles, tall
from tessella.operators.profile import duplicate_counts
from tessella.sources.io import settle

STATISTICS = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]


def _cells(df: DataFrame):
    return reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])


def quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, missing cells and duplicate rows on both sides."""
    side = lambda df, s: df.agg(F.count("*").alias(f"rows_{s}"), _cells(df).alias(f"missing_{s}")).crossJoin(duplicate_counts(df, df.columns).select(F.col("surplus").alias(f"duplicates_{s}")))
    return side(before, "before").crossJoin(F.broadcast(side(after, "after")))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    removed = F.col("rows_before") - F.col("rows_after")
    return quality(before, after).withColumns({"rows_removed": removed, "pct_removed": F.try_divide(100.0 * removed, F.col("rows_before"))})


def described(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(column, statistic, value) in long form; `df` is computed once."""
    df = settle(df.select(*columns))
    at = quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = tall(df, columns, {
        "n": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": lambda c: F.min(c).cast("double"), "p25": lambda c: at(c, 0.25),
        "p50": lambda c: at(c, 0.5), "p75": lambda c: at(c, 0.75), "max": lambda c: F.max(c).cast("double"),
    }, "column")
    pairs = ", ".join(f"'{s}', {s}" for s in STATISTICS)
    return wide.selectExpr("column", f"stack({len(STATISTICS)}, {pairs}) AS (statistic, {name})")


def describe(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics on both sides with difference and percent; infinite where the base is 0."""
    both = described(before, columns, "before").join(described(after, columns, "after"), ["column", "statistic"])
    diff = F.col("after") - F.col("before")
    return both.withColumns({"diff": diff, "pct": F.when(F.col("before") == 0, float("inf")).otherwise(F.try_divide(100.0 * diff, F.col("before")))})


def threshold_counts(before: DataFrame, after: DataFrame, tests: dict[str, str]) -> DataFrame:
    """(test, before, after): rows that meet each SQL condition."""
    count = lambda df, s: df.agg(*[F.count_if(F.expr(t)).alias(f"{s}{i}") for i, t in enumerate(tests.values())])
    rows = [F.struct(F.lit(t).alias("test"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, t in enumerate(tests)]
    return count(before, "b").crossJoin(F.broadcast(count(after, "a"))).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, type_before, type_after) of both schemas; only the schemas are read."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    return before.sparkSession.createDataFrame([(c, old.get(c), new.get(c)) for c in sorted(old | new)], "column string, type_before string, type_after string")


def type_histogram(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, n_before, n_after, change): how many columns of each type both schemas have; only the schemas are read."""
    old, new = (Counter(t for _, t in df.dtypes) for df in (before, after))
    return before.sparkSession.createDataFrame([(t, old[t], new[t], new[t] - old[t]) for t in sorted(old | new)], "type string, n_before long, n_after long, change long")
