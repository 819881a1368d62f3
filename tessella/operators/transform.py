"""Power transforms with fitted exponents, and reduction of correlated features to principal components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import roles
from tessella.functions.crossproduct import covariances
from tessella.functions.stats import correlation_matrix, skew_adjusted, tall
from tessella.sources.io import settle

BOX_COX, YEO_JOHNSON, NONE = "box-cox", "yeo-johnson", "none"
#: Exponents nearer to 0 are logarithms; grids are not widened beyond the other.
_LEAST_POWER, _MOST_WIDTH = 1e-8, 1e6


def logarithm(x: Column) -> Column:
    """ln as SQL and IEEE have it: -inf for 0 and NaN for less, where Spark's is null and an aggregate would skip the row."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan))


def box_cox(c: str, lam: float) -> Column:
    x = F.col(c).cast("double")
    return logarithm(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeo_johnson(c: str, lam: float) -> Column:
    x = F.col(c).cast("double")
    up = F.ln(x + 1) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.ln(1 - x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def power(c: str, method: str, lam: float | None) -> Column:
    return F.col(c).cast("double") if method == NONE else (box_cox if method == BOX_COX else yeo_johnson)(c, lam)


def _jacobian(c: str, method: str) -> Column:
    return logarithm(F.col(c).cast("double")) if method == BOX_COX else F.sign(c) * F.ln(F.abs(c) + 1)


def log_likelihoods(df: DataFrame, c: str, method: str, lambdas: list[float]) -> DataFrame:
    """(lambda, llf) for every exponent, from one aggregate over `df`. Values that are not positive have no finite Box-Cox likelihood, and none is made up."""
    wide = df.agg(
        F.count(c).alias("n"), F.sum(_jacobian(c, method)).alias("j"), *[F.var_pop(power(c, method, x)).alias(f"v{i}") for i, x in enumerate(lambdas)]
    )
    llf = lambda i, x: F.lit(x - 1.0) * F.col("j") - F.col("n") / 2 * logarithm(F.col(f"v{i}"))
    rows = [F.struct(F.lit(float(x)).alias("lambda"), llf(i, x).alias("llf")) for i, x in enumerate(lambdas)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def in_domain(c: str, method: str) -> Column:
    """The value as a double where the transform has a likelihood: for Box-Cox, positive and finite values; else null."""
    x = F.col(c).cast("double")
    return F.when((x > 0) & (x < math.inf), x) if method == BOX_COX else x


def _scaled_power(x: np.ndarray, method: str, lam: float, s: float) -> np.ndarray:
    """The transform of each value times exp(-s), up to a constant."""
    if method == BOX_COX:
        return np.log(x) if abs(lam) < _LEAST_POWER else np.exp(lam * np.log(x) - s) / lam
    none = math.exp(-s)
    side = lambda power, log: log * none if abs(power) < _LEAST_POWER else (np.exp(power * log - s) - none) / power
    up = x >= 0
    return np.where(up, side(lam, np.log1p(np.where(up, x, 0.0))), -side(2 - lam, np.log1p(np.where(up, 0.0, -x))))


def _log_scale(method: str, lam: float, low: float, high: float) -> float:
    """s, so that no power of a value from low to high exceeds exp(s)."""
    if method == BOX_COX:
        return 0.0 if abs(lam) < _LEAST_POWER else lam * math.log(high if lam > 0 else low)
    return max(0.0, lam * math.log1p(max(high, 0.0)), (2 - lam) * math.log1p(max(-low, 0.0)))


def _spreads(df: DataFrame, methods: dict[str, str], grids: dict[str, np.ndarray], facts: dict[str, tuple]) -> dict[tuple[str, int], tuple[float, float]]:
    """(column, place in its grid) -> (log scale, variance of the scaled transform). A task sends two sums for each."""
    columns = list(grids)
    scales = {(c, k): _log_scale(methods[c], float(lam), facts[c][1], facts[c][2]) for c in columns for k, lam in enumerate(grids[c])}
    # sums are taken about the transform of the column's mean
    about = {(c, k): float(_scaled_power(np.array([facts[c][4]]), methods[c], float(lam), scales[c, k])[0]) for c in columns for k, lam in enumerate(grids[c])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            for i, c in enumerate(columns):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                for k, lam in enumerate(grids[c]):
                    v = _scaled_power(x, methods[c], float(lam), scales[c, k]) - about[c, k]
                    own = sums.setdefault((i, k), [0.0, 0.0])
                    own[0] += float(v.sum())
                    own[1] += float((v * v).sum())
        rows = [(i, k, *own) for (i, k), own in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["i", "k", "s", "q"])

    found = df.select(*[in_domain(c, methods[c]).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "i long, k long, s double, q double")
    found = found.groupBy("i", "k").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()  # the grids' points
    return {(c := columns[r["i"]], r["k"]): (scales[c, r["k"]], (r["q"] - r["s"] ** 2 / facts[c][0]) / facts[c][0]) for r in found}


def fit_many(df: DataFrame, methods: dict[str, str], points: int = 17, passes: int = 6) -> dict[str, float]:
    """The exponent of greatest likelihood of each column (column -> method), all columns in the same passes.

    A pass is one job over a grid for each column, around the best exponent of the pass before. Where the best is at an end of its
    grid, the grid moves beyond that end and doubles instead of shrinking, so no optimum is out of reach. Values are scaled in log
    space, so that powers do not overflow. A constant column, or one without values, has the exponent 1. A Box-Cox exponent is that of
    the positive values, as in_domain() has them: with a 0 among them no exponent has a finite likelihood.
    """
    found = {c: 1.0 for c in methods}
    if not methods:
        return found
    held = df.select(*[in_domain(c, m).alias(f"c{i}") for i, (c, m) in enumerate(methods.items())])
    facts = held.agg(*[f(f"c{i}").alias(f"{n}{i}") for i, m in enumerate(methods.values()) for n, f in (
        ("n", F.count), ("l", F.min), ("h", F.max), ("j", lambda c, m=m: F.sum(_jacobian(c, m))), ("m", F.avg),
    )]).first()
    of = {c: tuple(facts[f"{n}{i}"] for n in "nlhjm") for i, c in enumerate(methods)}
    brackets = {c: (-5.0, 5.0, passes) for c, (n, low, high, *_) in of.items() if n and low < high}
    while brackets:
        grids = {c: np.linspace(low, high, points) for c, (low, high, _) in brackets.items()}
        spreads = _spreads(df, methods, grids, of)
        for c, grid in grids.items():
            n, j, left = of[c][0], of[c][3], brackets[c][2]
            llf = [(lam - 1) * j - n / 2 * (2 * s + math.log(v)) if v > 0 else -math.inf for lam, (s, v) in zip(grid, (spreads[c, k] for k in range(points)))]
            best, width = int(np.argmax(llf)), float(grid[-1] - grid[0])
            found[c] = float(grid[best])
            step = width / (points - 1)
            if best in (0, points - 1) and width < _MOST_WIDTH:
                brackets[c] = (found[c] - step, found[c] + 2 * width, left) if best else (found[c] - 2 * width, found[c] + step, left)
            elif left > 1:
                brackets[c] = (found[c] - step, found[c] + step, left - 1)
            else:
                del brackets[c]
    return found


def fit(df: DataFrame, c: str, method: str) -> float:
    """fit_many() of one column."""
    return fit_many(df, {c: method})[c]


def decision(df: DataFrame, c: str, threshold: float) -> DataFrame:
    """skew, zeros, negatives and the transform that they call for; one row."""
    return decisions(df, [c], threshold)


def decisions(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """decision() of each column, from one aggregate."""
    found = tall(df, columns, {"skew": skew_adjusted, "least": lambda c: F.min(c).cast("double"), "n_zero": lambda c: F.count_if(F.col(c) == 0)})
    method = F.when(F.coalesce(F.abs("skew") < threshold, F.lit(True)), NONE).when((F.col("least") < 0) | (F.col("n_zero") > 0), YEO_JOHNSON).otherwise(BOX_COX)
    return found.select("feature", "skew", (F.col("least") < 0).alias("has_negative"), "n_zero", method.alias("method"))


def plan(df: DataFrame, columns: list[str], threshold: float) -> dict[str, tuple[str, float | None]]:
    """column -> (method, exponent): what transforming `df` will do. One row for each column comes to the driver."""
    methods = {r["feature"]: r["method"] for r in decisions(df, columns, threshold).collect()}
    fitted = fit_many(df, {c: m for c, m in methods.items() if m != NONE})
    return {c: (methods[c], fitted.get(c)) for c in columns}


def transformed(df: DataFrame, steps: dict[str, tuple[str, float | None]], suffix: str = "_Transformed") -> DataFrame:
    """`df` with each column transformed, in place where `suffix` is empty; columns that need nothing are passed on as they are."""
    return df.withColumns({f"{c}{suffix}": power(c, *step) for c, step in steps.items()})


def report(df: DataFrame, steps: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Skew of each column before and after, from one pass."""
    out = transformed(df, steps, "__new")
    wide = out.agg(*[skew_adjusted(f"{c}{s}").alias(f"{c}{s}") for c in steps for s in ("", "__new")])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(m).alias("method"), F.lit(x).cast("double").alias("lambda"), F.col(c).alias("skew_before"), F.col(f"{c}__new").alias("skew_after")) for c, (m, x) in steps.items()]
    tall = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return tall.withColumn("improvement", F.abs("skew_before") - F.abs("skew_after"))


def high_pairs(df: DataFrame, columns: list[str], threshold: float = roles.HIGH_CORRELATION) -> DataFrame:
    return correlation_matrix(df, columns).filter(F.abs("r") >= threshold)


def strongest_pair(df: DataFrame, columns: list[str]) -> DataFrame:
    best = F.max_by(F.struct("f1", "f2", "r"), F.struct(F.abs("r"), -F.col("i"), -F.col("j")))
    return correlation_matrix(df, columns).agg(best.alias("x")).select("x.*")


def pairs_to_reduce(df: DataFrame, columns: list[str], threshold: float = roles.HIGH_CORRELATION) -> list[tuple[str, str, float]]:
    """Highly correlated pairs in column order, each column at most once; a few rows for a few features."""
    used, out = set(), []
    for r in high_pairs(df, columns, threshold).orderBy("i", "j").collect():
        if not {r["f1"], r["f2"]} & used:
            used |= {r["f1"], r["f2"]}
            out.append((r["f1"], r["f2"], r["r"]))
    return out


def component_name(a: str, b: str) -> str:
    return f"PC1_{a.split('_')[0]}_{b.split('_')[0]}"


def pair_state(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, str, float, float, float, float, float]]:
    """(a, b, name, mean a, spread a, mean b, spread b, sign) of each pair, from one aggregate; a constant column has the spread 1."""
    if not pairs:
        return []
    together = lambda a, b: F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double"))
    asked = [f.alias(f"{n}{i}") for i, (a, b) in enumerate(pairs) for n, f in (("ma", F.avg(a)), ("sa", F.stddev_pop(a)), ("mb", F.avg(b)), ("sb", F.stddev_pop(b)), ("c", together(a, b)))]
    row = df.agg(*asked).first()
    at = lambda n, i: float(row[f"{n}{i}"] or 0.0)
    return [(a, b, component_name(a, b), at("ma", i), at("sa", i) or 1.0, at("mb", i), at("sb", i) or 1.0, -1.0 if at("c", i) < 0 else 1.0) for i, (a, b) in enumerate(pairs)]


def with_components(df: DataFrame, state: list[tuple]) -> DataFrame:
    """`df` with the first principal component of each pair, (z1 + sign z2) / sqrt 2, at the end of the columns."""
    for a, b, name, ma, sa, mb, sb, sign in state:
        part = lambda c, m, s: (F.col(c) - F.lit(m)) / F.lit(s)
        df = df.withColumn(name, (part(a, ma, sa) + F.lit(sign) * part(b, mb, sb)) / F.lit(math.sqrt(2)))
    return df


def reduce_pairs(df: DataFrame, pairs: list[tuple[str, str, float]]) -> DataFrame:
    """Each pair becomes its first principal component; `df` is computed once."""
    held = settle(df)
    return with_components(held, pair_state(held, [p[:2] for p in pairs])).drop(*[c for p in pairs for c in p[:2]])


def pair_variance(df: DataFrame, columns: list[str], threshold: float = roles.HIGH_CORRELATION) -> DataFrame:
    """The share of a pair's variance that its first component carries: (1 + |r|) / 2."""
    return high_pairs(df, columns, threshold).select("f1", "f2", "r", ((1 + F.abs("r")) / 2).alias("share"))


def principal(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, k loading rows, explained shares) from one pass of cross products; the greatest loading of a component is positive."""
    means, cov = covariances(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(k), np.abs(loadings).argmax(axis=1)])[:, None]
    return means, loadings, values[order] / values.sum()


def projected(df: DataFrame, columns: list[str], means: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """`df` with PC1, PC2 and so on: a row expression, so centroids can be projected in the same way."""
    at = lambda row: sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, means, row)), F.lit(0.0))
    return df.withColumns({f"PC{i + 1}": at(row) for i, row in enumerate(loadings)})
