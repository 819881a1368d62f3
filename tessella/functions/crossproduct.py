"""Correlations and covariances of hundreds of columns: blocked cross products of Arrow batches, merged in two steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at once, and groups of tasks whose sums are merged before all are.
ROWS, GROUPS = 8192, 32
SCHEMA = "i int, part int, n array<double>, s array<double>, q array<double>, c array<double>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one i added up, in the group of its first; what is held is one row for each i of the partition."""
    held: dict[int, list] = {}
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        for i, part, *sums in zip(*columns):
            own = held.setdefault(int(i), [int(part), *[0.0] * 4])
            own[1:] = [a + b for a, b in zip(own[1:], sums)]
    yield from _rows(held)


def _rows(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
    if held:
        parts = [(i, *own) for i, own in held.items()]
        i, part, *sums = zip(*parts)
        arrays = [pa.array(np.array(x, dtype=np.int32)) for x in (i, part)] + [pa.array([list(v) for v in x], pa.list_(pa.float64())) for x in sums]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "part", "n", "s", "q", "c"])


def cross_products(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float]]:
    """((i, n, s, q, c), means): for each column i, arrays over all columns j of what rows with both have: their number, the sum of i, of
    its square, and of i times j, all about the mean of each column. A null leaves out its pairs only.

    A task multiplies matrices of batches and sends one row for each column; these are added up within groups of tasks first, so that no
    task adds up what all tasks send.
    """
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = np.array([row[i] or 0.0 for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                there = np.column_stack([np.asarray(c.is_valid()) for c in part.columns]).astype(float)
                x = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]) - means) * there
                x[there == 0] = 0.0
                own = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
                total = own if total is None else tuple(a + b for a, b in zip(total, own))
        if total is not None:
            part = TaskContext.get().partitionId() % GROUPS
            yield from _rows({i: [part, *[m[i] for m in total]] for i in range(len(columns))})

    sums = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, SCHEMA)
    merged = sums.repartition("i", "part").mapInArrow(_merged, SCHEMA).repartition("i").mapInArrow(_merged, SCHEMA)
    return merged.drop("part"), means.tolist()


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, f1, f2, r) for i < j; null where a column is constant among the rows that have both."""
    merged, means = cross_products(df, columns)
    each = merged.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "c"))).select("i", F.col("pos").alias("j"), "col.*")
    low = each.filter("i < j")
    high = each.filter("i > j").select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"), F.col("q").alias("u"))
    both = low.join(high, ["i", "j"])
    names, centres = F.array(*map(F.lit, columns)), F.array(*map(F.lit, means))
    spread = lambda q, s: F.col(q) / F.col("n") - F.pow(F.col(s) / F.col("n"), F.lit(2.0))
    noise = lambda i: F.pow(F.abs(centres[F.col(i)]) * 4e-16, F.lit(2.0))  # noqa: E731 - what rounding of the values alone can give
    varies = (F.col("n") > 0) & (spread("q", "s") > noise("i")) & (spread("u", "t") > noise("j"))
    together = F.col("c") / F.col("n") - F.col("s") / F.col("n") * F.col("t") / F.col("n")
    r = F.when(varies, together / (F.sqrt(spread("q", "s")) * F.sqrt(spread("u", "t"))))
    return both.select("i", "j", names[F.col("i")].alias("f1"), names[F.col("j")].alias("f2"), r.alias("r"))


def covariances(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, sample covariances) of a few hundred columns; their matrix comes to the driver."""
    merged, means = cross_products(df, columns)
    rows = {r["i"]: r for r in merged.collect()}
    n, s, c = (np.array([rows[i][k] for i in range(len(columns))]) for k in ("n", "s", "c"))
    return np.array(means), (c - s * s.T / n) / (n - 1)
