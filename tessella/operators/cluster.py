"""K-Means on column expressions, choice of K, and measures of a clustering. Centres are a few rows on the driver; points never are.

Edges: an empty table, or fewer rows than centres, raises ValueError where centres are to be found; measures of an empty
clustering are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.functions import distances
from tessella.functions.ranges import running_totals
from tessella.sources.io import remove, scratch, settle

#: Rows of a block when all pairs of points are compared, and of the blocks that a task compares its own with.
BLOCK, REACH = 1024, 1 << 20
#: Different points up to which all pairs are compared; clusters of a labelling up to which they are not, beyond it; and how near to 0 a
#: silhouette is compared again pair by pair where its sign counts.
FAR_FROM, MANY, CLOSE = 30_000, 200, 1e-6
#: What rounding may have taken from a bound.
_SLACK = 1e-9


def squared_distances(features: list[str], centers: list[list[float]]) -> Column:
    """An array of the squared distances to each centre."""
    to = lambda center: sum(((F.col(f) - F.lit(float(x))) * (F.col(f) - F.lit(float(x))) for f, x in zip(features, center)), F.lit(0.0))
    return F.array(*[to(c) for c in centers])


def assign(df: DataFrame, features: list[str], centers: list[list[float]]) -> DataFrame:
    """`df` with `cluster` (the first nearest centre, from 0) and `d2`, the squared distance to it."""
    df = df.withColumn("_d", squared_distances(features, centers))
    return df.withColumns({"cluster": F.array_position("_d", F.array_min("_d")) - 1, "d2": F.array_min("_d")}).drop("_d")


def update(assigned: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, n, mean of each feature)."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("inertia"))


def lloyd(df: DataFrame, features: list[str], centers: list[list[float]], rounds: int = 300, tolerance: float = 1e-4, key: str = "ID") -> list[list[float]]:
    """Centres after Lloyd's iteration. A centre that loses all its points takes the point farthest from its own centre."""
    for _ in range(rounds):
        assigned = assign(df, features, centers)
        found = {r["cluster"]: [r[f] for f in features] for r in update(assigned, features).collect()}
        empty = [i for i in range(len(centers)) if i not in found]
        far = assigned.orderBy(F.desc("d2"), key).select(*features).limit(len(empty)).collect() if empty else []
        new = [found.get(i) or list(far[empty.index(i)]) for i in range(len(centers))]
        moved = float(np.linalg.norm(np.array(new, dtype=float) - np.array(centers, dtype=float)))
        centers = new
        if moved < tolerance:
            break
    return centers


def random_centers(df: DataFrame, features: list[str], k: int, seed: int, key: str = "ID") -> list[list[float]]:
    """k distinct rows in the order of a keyed hash."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = [list(r) for r in df.orderBy(hashed, key).select(*features).limit(k).collect()]
    if len(rows) < k:
        raise ValueError(f"{len(rows)} rows are too few for {k} centres")
    return rows


def seeding_weights(df: DataFrame, features: list[str], centers: list[list[float]], key: str = "ID") -> DataFrame:
    """(key, d2, p, cum): chance of each row as the next k-means++ centre and its cumulative chance in the order of the keys, of any type."""
    rows = df.select(key, F.array_min(squared_distances(features, centers)).alias("d2"))
    ended = running_totals(rows, [key], "d2")
    return ended.crossJoin(F.broadcast(rows.agg(F.sum("d2").alias("_all")))).select(key, "d2", (F.col("d2") / F.col("_all")).alias("p"), (F.col("cum") / F.col("_all")).alias("cum"))


def _scramble(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _square(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (row, centre), a feature at a time: no array of rows by centres by features."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        one = np.subtract.outer(x[:, j], centers[:, j])
        one *= one
        out += one
    return out


def _greatest(rows: np.ndarray, n: int) -> np.ndarray:
    """The n rows of the greatest first column, greatest first; only rows near them are sorted."""
    if len(rows) > n:
        rows = rows[rows[:, 0] >= np.partition(rows[:, 0], len(rows) - n)[len(rows) - n]]
    return rows[np.argsort(-rows[:, 0], kind="stable")[:n]]


def seed_in_turn(df: DataFrame, features: list[str], models: list[tuple[int, int]], key: str = "ID") -> list[np.ndarray]:
    """k-means++ centres for each of `models` (k, seed), one pass over the rows for each place among the centres.

    A draw by squared distance takes the row of the greatest d2 / -log(u), where u is a hash of the key, seed and place: each
    task sends its best row of each model.
    """
    centers = [np.empty((0, len(features))) for _ in models]
    schema = "model int, score double, " + ", ".join(f"f{i} double" for i in range(len(features)))
    for place in range(max(k for k, _ in models)):
        todo = [(m, seed, centers[m]) for m, (k, seed) in enumerate(models) if place < k]

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                x, keys = rows[features].to_numpy(dtype=float), rows[key].to_numpy(dtype=np.int64).view(np.uint64)
                best = []
                for m, seed, have in todo:  # noqa: B023
                    salt = _scramble(np.array([seed * 1000 + place], dtype=np.uint64))  # noqa: B023
                    u = ((_scramble(keys ^ salt) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                    score = (_square(x, have).min(axis=1) if len(have) else np.ones(len(x))) / -np.log(u)
                    i = int(score.argmax())
                    best.append((m, score[i], *x[i]))
                yield pd.DataFrame(best, columns=["model", "score", *[f"f{i}" for i in range(len(features))]])

        names = [f"f{i}" for i in range(len(features))]
        found = df.select(key, *features).mapInPandas(draw, schema).groupBy("model").agg(F.max(F.struct("score", *names)).alias("x"))
        got = {r["model"]: r["x"] for r in found.collect()}  # one row for each model
        if len(got) < len(todo) or any(r["score"] <= 0 for r in got.values()):
            raise ValueError("the rows are too few, or too alike, for so many centres")
        for m, _, have in todo:
            centers[m] = np.vstack([have, [got[m][n] for n in names]])
    return centers


#: Rounds of seed_many(), and candidates that each of them adds for each centre.
SEED_ROUNDS, OVERSAMPLE = 5, 2


def _weighted_seeds(x: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of a few weighted candidates by k-means++, moved to the weighted means of what they are nearest to until they rest."""
    rng = np.random.default_rng(seed)
    centers = x[[rng.choice(len(x), p=weights / weights.sum())]]
    while len(centers) < k:
        chance = _square(x, centers).min(axis=1) * weights
        centers = np.vstack([centers, x[rng.choice(len(x), p=chance / chance.sum())]])
    for _ in range(100):
        own = _square(x, centers).argmin(axis=1)
        new = np.array([np.average(x[own == i], axis=0, weights=weights[own == i]) if (own == i).any() else centers[i] for i in range(k)])
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def seed_many(df: DataFrame, features: list[str], models: list[tuple[int, int]], key: str = "ID") -> list[np.ndarray]:
    """Centres for each of `models` (k, seed) by k-means||: SEED_ROUNDS + 2 passes over the rows, whatever k is.

    The first pass takes one row; each round takes OVERSAMPLE * k further rows without replacement, the chance of a row being its squared
    distance to those taken before (the greatest d2 / -log(u), where u is a hash of key, seed and round); a last pass weighs the
    candidates by how many rows are nearest to them, and k-means++ over these few gives the centres. A task sends its best rows of each model.
    Keys may be of any type; rows with equal keys share their chance. Fewer different rows than k raise ValueError.
    """
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(F.xxhash64(key).alias("_h"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    found = [np.empty((0, len(features))) for _ in models]
    for turn in range(SEED_ROUNDS + 1):
        wanted = [1 if turn == 0 else OVERSAMPLE * k for k, _ in models]
        held = list(found)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[np.ndarray | None] = [None] * len(models)
            for batch in batches:
                x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(features))])
                keys = batch.column(0).to_numpy().view(np.uint64)
                for m, (_, seed) in enumerate(models):
                    salt = _scramble(np.array([seed * 1000 + turn], dtype=np.uint64))  # noqa: B023
                    u = ((_scramble(keys ^ salt) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                    far = _square(x, held[m]).min(axis=1) if len(held[m]) else np.ones(len(x))  # noqa: B023
                    score = far / -np.log(u)
                    rows = np.column_stack([score, x])[score > 0]
                    rows = rows if best[m] is None else np.vstack([best[m], rows])
                    best[m] = _greatest(rows, wanted[m])  # noqa: B023
            for m, rows in enumerate(best):
                if rows is not None and len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(rows)), *map(pa.array, rows.T)], names=["model", "score", *names])

        drawn = rows.mapInArrow(draw, "model long, score double, " + ", ".join(f"{n} double" for n in names))
        most = F.create_map(*[F.lit(v) for m, w in enumerate(wanted) for v in (m, w)])[F.col("model")]
        place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), *names))
        got = drawn.withColumn("_place", place).filter((F.col("_place") <= max(wanted)) & (F.col("_place") <= most)).collect()  # candidates of a round
        for m in range(len(models)):
            new = [[r[n] for n in names] for r in got if r["model"] == m]
            found[m] = np.unique(np.vstack([found[m], new]), axis=0) if new else found[m]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(c), dtype=np.int64) for c in found]
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(features))])
            for m, c in enumerate(found):
                sums[m] += np.bincount(_square(x, c).argmin(axis=1), minlength=len(c))
        for m, n in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), m)), pa.array(np.arange(len(n))), pa.array(n)], names=["model", "candidate", "n"])

    if any(len(c) < k for c, (k, _) in zip(found, models)):
        raise ValueError("the rows are too few, or too alike, for so many centres")
    weights = [np.zeros(len(c)) for c in found]
    for r in rows.mapInArrow(weigh, "model long, candidate long, n long").groupBy("model", "candidate").agg(F.sum("n").alias("n")).collect():
        weights[r["model"]][r["candidate"]] = r["n"]
    return [_weighted_seeds(c, w, k, seed) for c, w, (k, seed) in zip(found, weights, models)]


def _farthest(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[int, list[list[float]]]:
    """model -> the row of each cluster that is farthest from its centre, the farthest first."""
    names = rows.columns
    to = F.array(*[F.struct(F.lit(m).alias("model"), F.array_min(d := squared_distances(names, c.tolist())).alias("d2"), F.array_position(d, F.array_min(d)).alias("cluster")) for m, c in models.items()])
    found = rows.select(*names, F.explode(to).alias("x")).groupBy("x.model", "x.cluster").agg(F.max(F.struct("x.d2", *names)).alias("far")).collect()  # a row for each centre
    return {m: [list(x)[1:] for x in sorted((r["far"] for r in found if r["model"] == m), reverse=True)] for m in models}


def lloyd_many(df: DataFrame, features: list[str], centers: list[np.ndarray], rounds: int = 300, tolerance: float = 1e-4) -> list[tuple[np.ndarray, float, int]]:
    """(centres, inertia, rounds) of Lloyd's iteration from each of several starts, all of them in one pass over the rows a round.

    A task sends the sizes and sums of each cluster. A centre that loses all its points takes the row that is farthest from its
    own, which one more pass finds.
    """
    names = [f"s{i}" for i in range(len(features))]
    schema = "model long, cluster long, n long, cost double, " + ", ".join(f"{x} double" for x in names)
    rows_ = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    out: list[tuple[np.ndarray, float, int]] = [(c, float("nan"), 0) for c in centers]
    moving, final = set(range(len(centers))), set()
    for n_round in range(rounds + 1):
        if not moving | final:
            break
        now = {m: out[m][0] for m in moving | final}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {m: np.zeros((len(c), len(features) + 2)) for m, c in now.items()}  # noqa: B023
            for batch in batches:
                every = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for low in range(0, len(every), 2048):  # what stays in the cache
                    x = every[low : low + 2048]
                    for m, c in now.items():  # noqa: B023
                        d = _square(x, c)
                        own, at = d.argmin(axis=1), held[m]
                        at[:, 0] += np.bincount(own, minlength=len(c))
                        at[:, 1] += np.bincount(own, d.min(axis=1), len(c))
                        for j in range(x.shape[1]):
                            at[:, j + 2] += np.bincount(own, x[:, j], len(c))
            found = [(m, k, int(v[0]), *v[1:]) for m, own in held.items() for k, v in enumerate(own) if v[0]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["model", "cluster", "n", "cost", *names])

        all_ = rows_.mapInArrow(sums, schema).groupBy("model", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(x).alias(x) for x in names])
        got: dict[int, dict] = {}
        for r in all_.collect():  # one row for each centre
            got.setdefault(r["model"], {})[r["cluster"]] = r
        if not got:
            raise ValueError("no rows to cluster")
        short = {m for m, rows in got.items() if m in moving and len(rows) < len(now[m])}
        away = _farthest(rows_, {m: now[m] for m in short}) if short and n_round < rounds else {}
        settled = set()
        for m, rows in got.items():
            cost = sum(r["cost"] for r in rows.values())
            if m in final or n_round == rounds:
                out[m] = (out[m][0], cost, out[m][2])
                final.discard(m)
                moving.discard(m)
                continue
            spare = away.get(m, [])
            new = np.array([[rows[k][x] / rows[k]["n"] for x in names] if k in rows else spare.pop(0) for k in range(len(out[m][0]))])
            if float(np.linalg.norm(new - out[m][0])) < tolerance:
                settled.add(m)
            out[m] = (new, cost, n_round + 1)
        moving -= settled
        final |= settled  # one more pass for the inertia of the last centres
    return out


def lloyd_bounded(df: DataFrame, features: list[str], centers: list[list[float]], rounds: int = 300, tolerance: float = 1e-4) -> tuple[np.ndarray, float, list[int]]:
    """(centres, inertia, distances computed in each round) of Lloyd's iteration that skips distances by bounds: the centres of lloyd_many().

    Every row carries its cluster, an upper bound of the distance to its own centre and a lower bound of that to any other, in a table that
    each round writes anew. Bounds move with the centres: where the upper one stays below the lower one, or below half the way from its
    centre to the next, the row keeps its cluster and computes nothing; else its own distance is made exact, and only if that does not do
    are all distances computed. A centre that loses all its points takes the row that is farthest from its own centre. A round's table goes when the next one is written.
    """
    names = [f"f{i}" for i in range(len(features))]
    fields = ", ".join(f"{n} double" for n in names) + ", cluster int, upper double, lower double"
    c, spent = np.array(centers, dtype=float), []
    bare = df.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    state = bare.withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0)})
    drift, path, spark = np.zeros(len(c)), None, df.sparkSession

    def assigned(state: DataFrame, c: np.ndarray, drift: np.ndarray) -> tuple[DataFrame, str, int]:
        half = _square(c, c)
        np.fill_diagonal(half, np.inf)
        half, away = np.sqrt(half.min(axis=1)) / 2 if len(c) > 1 else np.array([np.inf]), float(drift.max())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy() for i in range(len(features))])
                own, upper, lower = (batch.column(len(features) + i).to_numpy().copy() for i in range(3))
                fresh, n = own < 0, np.zeros(len(x), dtype=np.int64)
                upper += np.where(fresh, 0.0, drift[own])
                lower -= away
                loose = ~fresh & (upper * (1 + _SLACK) >= np.maximum(half[own], lower))
                at = np.nonzero(loose)[0]
                upper[at] = np.sqrt(((x[at] - c[own[at]]) ** 2).sum(axis=1))
                n[at] += 1
                at = np.nonzero(fresh | loose & (upper * (1 + _SLACK) >= np.maximum(half[own], lower)))[0]
                if len(at):
                    d = np.sqrt(_square(x[at], c))
                    n[at] += d.shape[1]
                    own[at] = d.argmin(axis=1)
                    upper[at] = d.min(axis=1)
                    lower[at] = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.inf
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(features))], pa.array(own), pa.array(upper), pa.array(lower), pa.array(n)], names=[*names, "cluster", "upper", "lower", "n"])

        seen, to = Observation(), scratch(spark, "lloyd")
        state.mapInArrow(run, fields + ", n long").observe(seen, F.sum("n").alias("n")).drop("n").write.parquet(to)
        return spark.read.schema(fields).parquet(to), to, int(seen.get["n"] or 0)

    try:
        for _ in range(rounds):
            state, new_path, n = assigned(state, c, drift)
            path, old = new_path, path
            if old:
                remove(spark, old)
            spent.append(n)
            means = {r["cluster"]: [r[x] for x in names] for r in state.groupBy("cluster").agg(*[F.avg(x).alias(x) for x in names]).collect()}
            if not means:
                raise ValueError("no rows to cluster")
            if empty := [i for i in range(len(c)) if i not in means]:
                away = state.withColumn("_d", squared_distances(names, c.tolist())).groupBy("cluster").agg(F.max(F.struct(F.array_min("_d").alias("d2"), *names)).alias("x"))
                spare = sorted((r["x"] for r in away.collect()), reverse=True)  # one row for each centre
                means |= {i: list(x)[1:] for i, x in zip(empty, spare)}
            new = np.array([means[i] for i in range(len(c))])
            drift, moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)), float(np.linalg.norm(new - c)), new
            if moved < tolerance:
                break
        cost = bare.select(F.array_min(squared_distances(names, c.tolist())).alias("d2")).agg(F.sum("d2")).first()[0]
    finally:
        if path:
            remove(spark, path)
    return c, cost, spent


def best_starts(df: DataFrame, features: list[str], ks: list[int], starts: int = 10, seed: int = 42, key: str = "ID") -> dict[int, tuple[np.ndarray, float, int]]:
    """k -> (centres, inertia, rounds) of the best of several k-means|| starts by inertia."""
    models = [(k, seed + i) for k in ks for i in range(starts)]
    found = lloyd_many(df, features, seed_many(df, features, models, key))
    return {k: min((r for (own, _), r in zip(models, found) if own == k), key=lambda r: r[1]) for k in ks}


def kmeans(df: DataFrame, features: list[str], k: int, starts: int = 10, seed: int = 42, key: str = "ID") -> list[list[float]]:
    """The centres of the best of several starts by inertia."""
    return best_starts(df, features, [k], starts, seed, key)[k][0].tolist()


def ml_kmeans(df: DataFrame, features: list[str], k: int, starts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """(df with `cluster`, inertia) by Spark ML's K-Means, best of several seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
    models = [KMeans(k=k, maxIter=300, tol=1e-4, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(vectors) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).drop("_v"), best.summary.trainingCost


def measured(df: DataFrame, features: list[str], centers: dict[int, list[list[float]]], exact: bool | float = True, key: str = "ID") -> DataFrame:
    """(k, wcss, silhouette, davies_bouldin) of given centres for each k. The silhouette is the Euclidean one of all rows, see mean_silhouettes(); with
    a number it is within that error, as silhouette_estimate() has it, and with False it is the one under squared distance."""
    rows, exact_ = [], mean_silhouettes(df, features, centers) if exact is True else {}
    for k, c in centers.items():
        labelled = assign(df, features, c)
        if exact is not False:
            mean = exact_[k] if exact is True else silhouette_estimate(labelled, features, exact, key)[0]
            mean = df.sparkSession.createDataFrame([(mean,)], "s double")
        else:
            mean = squared_silhouette(labelled, features)
        row = inertia(labelled).crossJoin(F.broadcast(mean.toDF("silhouette"))).crossJoin(F.broadcast(davies_bouldin(labelled, features)))
        rows.append((k, *map(float, row.first())))
    return df.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double, davies_bouldin double")


def sweep(df: DataFrame, features: list[str], ks: range = range(2, 11), seed: int = 42, starts: int = 10, exact: bool | float = True, key: str = "ID") -> DataFrame:
    """(k, wcss, silhouette, davies_bouldin) of the best of several starts for each k; all starts of all k share their passes."""
    found = best_starts(df, features, list(ks), starts, seed, key)
    return measured(df, features, {k: c.tolist() for k, (c, _, _) in found.items()}, exact, key)


def elbow(curve: DataFrame) -> DataFrame:
    """(k, distance) of every k: how far the scaled curve is from the chord between its ends. A few rows."""
    w = Window.partitionBy(F.lit(0))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    scaled = curve.select("k", unit("k").alias("x"), unit("wcss").alias("y"))
    end = lambda c, f: f(F.struct("k", F.col(c))).over(w)[c]
    x0, y0, x1, y1 = end("x", F.min), end("y", F.min), end("x", F.max), end("y", F.max)
    cross = F.abs((x1 - x0) * (F.col("y") - y0) - (y1 - y0) * (F.col("x") - x0))
    return scaled.select("k", (cross / F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).alias("distance"))


def vote(curve: DataFrame) -> DataFrame:
    """The K of the elbow, that of the best silhouette, and the one chosen: the elbow's where they differ."""
    bend = elbow(curve).agg(F.max_by("k", F.struct("distance", -F.col("k"))).alias("elbow_k"))
    best = curve.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette_k"))
    return bend.crossJoin(best).withColumn("chosen_k", F.col("elbow_k"))


def sizes(assigned: DataFrame) -> DataFrame:
    counts = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def balance(assigned: DataFrame) -> DataFrame:
    return sizes(assigned).agg((F.min("n") / F.max("n")).alias("balance"))


def _point_silhouettes(rows: DataFrame, features: list[str], labels: list[str], block: int = BLOCK, signs: bool = False) -> DataFrame:
    """(features, labels, w, s0, s1, ...): each different point of `rows`, doubles and longs, with the number of its rows and its exact Euclidean
    silhouette under each of several labellings.

    Equal rows become one weighted point. Beyond FAR_FROM different points of at most three features, sums of distances come from
    functions.distances, whose time grows nearly with the points; with `signs`, points whose silhouette is within CLOSE of 0 are then compared
    with all others pair by pair. Else all pairs are compared: points are packed into blocks, and each pair of blocks is compared in memory, once for
    all labellings; a task keeps only sums of distances by cluster. So nothing but those sums is shuffled: for each point, one for every
    cluster and REACH points. That time is quadratic in the number of different points.
    """
    f, names = len(features), [*features, *labels]
    points = settle(rows.groupBy(*names).agg(F.count("*").alias("w")))
    sizes = [{r[0]: r[1] for r in points.groupBy(c).agg(F.sum("w")).collect()} for c in labels]  # a row for each cluster
    known = [sorted(x) for x in sizes]
    starts = np.cumsum([0, *map(len, known)])
    amount = np.concatenate([np.array([size[c] for c in order], dtype=float) for size, order in zip(sizes, known)]) if sizes[0] else np.empty(0)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            for i, order in enumerate(known):
                columns[f + i] = np.searchsorted(order, columns[f + i]).astype(float)
            yield np.column_stack(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(names) + 1))
        for rows_ in coded(batches):
            held = np.vstack([held, rows_])
            while len(held) >= block:
                yield pa.RecordBatch.from_arrays([pa.array([held[:block].tobytes()], pa.binary())], names=["data"])
                held = held[block:]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, total = None, np.empty((0, len(names) + 1)), np.empty((0, 0))
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["id", "data", "total"])
        for batch in batches:
            for i, mine, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if i != at:
                    if at is not None:
                        yield out()
                    at, x = i, np.frombuffer(mine.as_buffer(), dtype=float).reshape(-1, len(names) + 1)
                    total = np.zeros((len(x), starts[-1]))
                y = np.frombuffer(data.as_buffer(), dtype=float).reshape(-1, len(names) + 1)
                weight = np.zeros((len(y), starts[-1]))
                for k in range(len(labels)):
                    weight[np.arange(len(y)), starts[k] + y[:, f + k].astype(int)] = y[:, -1]
                distances.add_sums(x[:, :f], y[:, :f], weight, total)
        if at is not None:
            yield out()

    def scored(x: np.ndarray, total: np.ndarray) -> pa.Table:
        out, at, close = [pa.array(x[:, j]) for j in range(f)], np.arange(len(x)), np.zeros(len(x), dtype=bool)
        out += [pa.array(np.array(order)[x[:, f + k].astype(int)], pa.int64()) for k, order in enumerate(known)] + [pa.array(x[:, -1].astype(np.int64))]
        for k in range(len(labels)):
            own, t, m = x[:, f + k].astype(int), total[:, starts[k] : starts[k + 1]], amount[starts[k] : starts[k + 1]]
            a, away = t[at, own] / np.maximum(m[own] - 1, 1), t / m
            away[at, own] = np.inf
            b = away.min(axis=1)
            none = (m[own] == 1) | (len(m) < 2) | (np.maximum(a, b) == 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where(none, 0.0, (b - a) / np.maximum(a, b))
            close |= ~none & (np.abs(s) < CLOSE)
            out.append(pa.array(s))
        return pa.Table.from_arrays([*out, pa.array(close)], names=[*schema_names, "close"])

    def finish(sums: pa.Table) -> pa.Table:
        x = np.frombuffer(sums.column("data")[0].as_buffer(), dtype=float).reshape(-1, len(names) + 1)
        return scored(x, sum(np.frombuffer(t.as_buffer(), dtype=float).reshape(len(x), -1) for t in sums.column("total")))

    schema_names = [*names, "w", *[f"s{k}" for k in range(len(labels))]]
    kinds = ["double"] * f + ["long"] * (len(labels) + 1) + ["double"] * len(labels)
    schema = ", ".join(f"{c} {t}" for c, t in zip([*schema_names, "close"], [*kinds, "boolean"]))

    def pairwise(wanted: DataFrame, n: int) -> DataFrame:
        """The `n` points of `wanted`, compared with all."""
        packed = settle(points.select(*names, "w").mapInArrow(pack, "data binary").withColumn("id", F.monotonically_increasing_id()))
        blocks = packed.count()
        mine = packed if wanted is points else settle(wanted.select(*names, "w").mapInArrow(pack, "data binary").withColumn("id", F.monotonically_increasing_id()))
        tasks = max(1, min(-(-n // block) if wanted is not points else blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism))
        first, second = mine.repartition(tasks, "id"), packed.select(F.col("data").alias("other")).repartition(max(1, -(-blocks * block // REACH)))
        sums = first.select("id", "data").crossJoin(second).mapInArrow(compare, "id long, data binary, total binary")
        return sums.groupBy("id").applyInArrow(finish, schema).drop("close")

    ends = points.agg(F.count("*").alias("n"), *[x(c).alias(f"{p}{i}") for i, c in enumerate(features) for p, x in (("n_", F.count), ("low", F.min), ("high", F.max))]).first()
    n, low, high = ends["n"], [ends[f"low{i}"] for i in range(f)], [ends[f"high{i}"] for i in range(f)]
    if n <= FAR_FROM or f not in distances.NODES or any(ends[f"n_{i}"] < n for i in range(f)) or not np.isfinite([*low, *high]).all() or max(len(x) for x in known) > MANY:
        return pairwise(points, n)
    side = max(np.subtract(high, low)) * (1 + 1e-12)
    leaf, boxes, cost = distances.choose(points, features, low, side)
    if not leaf or not np.isfinite(side) or np.prod([float(len(x)) for x in known]) > 2.0**62 or cost.sum() > float(n) * n * distances.PAIR:
        return pairwise(points, n)
    place = {c: F.array_position(F.array(*[F.lit(v) for v in order]), F.col(c)) - 1 for c, order in zip(labels, known)}
    ready = points.select(*features, *[place[c].cast("double").alias(c) for c in labels], F.col("w").cast("double").alias("w"))
    found = distances.grouped_sums(ready, features, [len(x) for x in known], low, side, leaf, boxes, cost, scored, schema)
    if not signs:
        return found.drop("close")
    found = settle(found)
    unsure = settle(found.filter("close").select(*names, "w"))
    n = unsure.count()
    return found.filter("NOT close").drop("close").unionByName(pairwise(unsure, n)) if n else found.drop("close")


def silhouettes(assigned: DataFrame, features: list[str], key: str = "ID", block: int = BLOCK) -> DataFrame:
    """(key, cluster, s): the exact silhouette of every row under Euclidean distance; rows without a cluster take no part.

    See _point_silhouettes(): the signs are those of all pairs, the values beyond FAR_FROM points of at most three features exact to rounding
    errors of interpolation. With more features the time is quadratic in the number of different points.
    """
    names = [f"_f{i}" for i in range(len(features))]
    rows = assigned.select(F.col(key).alias("_key"), F.col("cluster").cast("long").alias("_c"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    rows = settle(rows.filter("_c IS NOT NULL"))
    found = _point_silhouettes(rows, names, ["_c"], block, signs=True).withColumnsRenamed({c: f"r{c}" for c in [*names, "_c"]})
    same = [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in [*names, "_c"]]
    return rows.join(found, same).select(F.col("_key").alias(key), F.col("_c").alias("cluster"), F.col("s0").alias("s"))


def point_silhouettes(assigned: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, w, s): the silhouettes() of every different point of a cluster, with the number `w` of its rows."""
    names = [f"_f{i}" for i in range(len(features))]
    rows = assigned.select(F.col("cluster").cast("long").alias("_c"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)]).filter("_c IS NOT NULL")
    return _point_silhouettes(rows, names, ["_c"], signs=True).select(F.col("_c").alias("cluster"), "w", F.col("s0").alias("s"))


def mean_silhouette(assigned: DataFrame, features: list[str]) -> DataFrame:
    return point_silhouettes(assigned, features).agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("silhouette"))


def negative_silhouettes(assigned: DataFrame, features: list[str]) -> DataFrame:
    """(n, pct): the rows whose silhouette is below zero."""
    n = F.coalesce(F.sum(F.when(F.col("s") < 0, F.col("w")).otherwise(0)), F.lit(0))
    return point_silhouettes(assigned, features).agg(n.alias("n"), F.round(F.try_divide(100.0 * n, F.sum("w")), 4).alias("pct"))


def mean_silhouettes(df: DataFrame, features: list[str], centers: dict[int, list[list[float]]]) -> dict[int, float]:
    """k -> the exact mean silhouette of given centres for each k, all from the same distances."""
    names, labels = [f"_f{i}" for i in range(len(features))], [f"_k{k}" for k in centers]
    rows = df.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    near = {c: F.array_position(d := squared_distances(names, x), F.array_min(d)) - 1 for c, x in zip(labels, centers.values())}
    found = _point_silhouettes(rows.select(*names, *[v.alias(c) for c, v in near.items()]), names, labels)
    row = found.agg(*[(F.sum(F.col("w") * F.col(f"s{i}")) / F.sum("w")).alias(f"s{i}") for i in range(len(labels))]).first()
    return {k: float("nan") if row[i] is None else row[i] for i, k in enumerate(centers)}


#: Rows of each cluster that the estimate of the silhouette looks at first, and at most.
PILOT, MOST_SAMPLED = 200, 20_000


def silhouette_estimate(assigned: DataFrame, features: list[str], error: float, key: str = "ID", exact_up_to: int = 20_000, z: float = 3.0, seed: int = 1) -> tuple[float, float, int]:
    """(mean silhouette, bound, rows looked at): the mean Euclidean silhouette within `bound`, which is at most `error` where that takes
    no more than MOST_SAMPLED rows, else what these give; up to `exact_up_to` rows it is exact and the bound 0.

    Rows are sampled by a hash of their key within each cluster, and compared with all rows: tasks sum the distances of the sampled rows to
    their rows of each cluster. The spread within each cluster in a first sample says how many rows of it are needed; the bound is z standard
    errors of the stratified mean, with correction for the finite clusters. A cluster whose rows are all sampled has no error.
    """
    rows = settle(assigned.select(F.col(key).alias("_key"), F.col("cluster").cast("long").alias("_cluster"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))
    sizes = {r["_cluster"]: r["n"] for r in rows.groupBy("_cluster").agg(F.count("*").alias("n")).collect()}
    n, order = sum(sizes.values()), sorted(sizes)
    if n <= exact_up_to or len(sizes) < 2:
        found = silhouettes(rows.withColumnRenamed("_cluster", "cluster"), [f"f{i}" for i in range(len(features))], "_key").agg(F.avg("s")).first()[0]
        return (float("nan") if found is None else found), 0.0, n

    def measured_(wanted: dict[int, int]) -> dict[int, np.ndarray]:
        most = F.create_map(*[F.lit(v) for c, m in wanted.items() for v in (c, m)])[F.col("_cluster")]
        place = F.row_number().over(Window.partitionBy("_cluster").orderBy(F.xxhash64(F.lit(seed), "_key"), "_key"))
        some = rows.withColumn("_place", place).filter((F.col("_place") <= max(wanted.values())) & (F.col("_place") <= most)).collect()  # MOST_SAMPLED at most
        own = np.array([order.index(r["_cluster"]) for r in some])
        x = np.array([[r[f"f{i}"] for i in range(len(features))] for r in some])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(x), len(order)))
            for batch in batches:
                cluster_ = np.searchsorted(order, batch.column("_cluster").to_numpy())
                y = np.column_stack([batch.column(f"f{i}").to_numpy() for i in range(len(features))])
                for at in range(0, len(y), step := max(1, (1 << 18) // max(1, len(x)))):
                    d = _square(x, y[at : at + step])
                    total += np.sqrt(d, out=d) @ (cluster_[at : at + step, None] == np.arange(len(order))).astype(float)
            i, c = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c), pa.array(total[i, c])], names=["i", "c", "d"])

        total = np.zeros((len(x), len(order)))
        for r in rows.mapInArrow(sums, "i long, c long, d double").groupBy("i", "c").agg(F.sum("d").alias("d")).collect():
            total[r["i"], r["c"]] = r["d"]
        counts = np.array([sizes[c] for c in order], dtype=float)
        at = np.arange(len(x))
        a = total[at, own] / np.maximum(counts[own] - 1, 1)
        mean = total / counts
        mean[at, own] = np.inf
        b = mean.min(axis=1)
        s = np.where(counts[own] == 1, 0.0, np.divide(b - a, np.maximum(a, b), out=np.zeros(len(x)), where=np.maximum(a, b) > 0))
        return {c: s[own == i] for i, c in enumerate(order)}

    def stated(found: dict[int, np.ndarray]) -> tuple[float, float, int]:
        mean = sum(sizes[c] * s.mean() for c, s in found.items()) / n
        spread = sum((sizes[c] / n) ** 2 * s.var(ddof=1) / len(s) * (1 - len(s) / sizes[c]) for c, s in found.items() if 1 < len(s) < sizes[c])
        return float(mean), float(z * np.sqrt(spread)), sum(map(len, found.values()))

    first = measured_({c: min(m, PILOT) for c, m in sizes.items()})
    if stated(first)[1] <= error:
        return stated(first)
    # rows in proportion to size and spread, a third more than the first sample says
    weight = {c: sizes[c] * max(first[c].std(ddof=1) if len(first[c]) > 1 else 0.0, 0.05) for c in order}
    need = min(MOST_SAMPLED, int(1.33 * (z / error * sum(weight.values()) / n) ** 2) + 1)
    return stated(measured_({c: min(sizes[c], max(PILOT, int(np.ceil(need * weight[c] / sum(weight.values()))))) for c in order}))


def squared_silhouette(assigned: DataFrame, features: list[str]) -> DataFrame:
    """The mean silhouette under squared distance, from the clusters' sizes, sums and square sums: linear in the rows."""
    square = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    groups = assigned.groupBy(F.col("cluster").alias("g")).agg(F.count("*").alias("gn"), F.sum(square).alias("gq"), *[F.sum(f).alias(f"g_{f}") for f in features])
    held = groups.agg(F.collect_list(F.struct(*groups.columns)).alias("groups"))  # one entry for each cluster
    rows = assigned.withColumn("q", square).crossJoin(F.broadcast(held))
    total = lambda g: F.col("q") * g["gn"] + g["gq"] - 2 * sum((F.col(f) * g[f"g_{f}"] for f in features), F.lit(0.0))
    own = F.filter("groups", lambda g: g["g"] == F.col("cluster"))[0]
    a = F.try_divide(total(own), own["gn"] - 1)
    b = F.array_min(F.transform(F.filter("groups", lambda g: g["g"] != F.col("cluster")), lambda g: total(g) / g["gn"]))
    rows = rows.select(F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).alias("s"))
    return rows.agg(F.avg("s").alias("silhouette"))


def davies_bouldin(assigned: DataFrame, features: list[str]) -> DataFrame:
    """The mean over clusters of the worst ratio of spread to separation. Only the clusters' centres are paired, k rows."""
    centers = update(assigned, features).drop("n").withColumnsRenamed({f: f"m_{f}" for f in features}).withColumnRenamed("cluster", "c")
    away = lambda: F.sqrt(sum(((F.col(f) - F.col(f"m_{f}")) * (F.col(f) - F.col(f"m_{f}")) for f in features), F.lit(0.0)))
    spread = assigned.join(F.broadcast(centers), F.col("cluster") == F.col("c")).groupBy("c", *[f"m_{f}" for f in features]).agg(F.avg(away()).alias("s"))
    left, right = (spread.select(*[F.col(c).alias(f"{p}_{c}") for c in spread.columns]) for p in ("l", "r"))
    apart = F.sqrt(sum(((F.col(f"l_m_{f}") - F.col(f"r_m_{f}")) * (F.col(f"l_m_{f}") - F.col(f"r_m_{f}")) for f in features), F.lit(0.0)))
    pairs = left.join(F.broadcast(right), F.col("l_c") != F.col("r_c"))
    return pairs.groupBy("l_c").agg(F.max((F.col("l_s") + F.col("r_s")) / apart).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def calinski_harabasz(assigned: DataFrame, features: list[str]) -> DataFrame:
    """(B / (k - 1)) / (W / (n - k)) from the clusters' sizes, sums and square sums."""
    square = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    g = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(square).alias("q"), *[F.sum(f).alias(f) for f in features])
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(norm / F.col("n")).alias("within"), *[F.sum(f).alias(f) for f in features])
    between, inside = F.col("within") - norm / F.col("n"), F.col("q") - F.col("within")
    return t.select(((between / (F.col("k") - 1)) / (inside / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def profile(assigned: DataFrame, columns: list[str]) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def levels_by_cluster(assigned: DataFrame, c: str, levels: list) -> DataFrame:
    """Share of each level within each cluster, zero where a level is absent: (cluster, level, n, pct)."""
    counted = assigned.groupBy("cluster").agg(F.count("*").alias("total"), *[F.count_if(F.col(c) == v).alias(f"n{i}") for i, v in enumerate(levels)])
    rows = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"n{i}").alias("n")) for i, v in enumerate(levels)])
    return counted.select("cluster", "total", F.explode(rows).alias("r")).select("cluster", "r.level", "r.n", (100.0 * F.col("r.n") / F.col("total")).alias("pct"))


def top_levels_by_cluster(assigned: DataFrame, c: str, top: int = 8) -> DataFrame:
    """levels_by_cluster() of the most frequent values; their number is the parameter `top`."""
    counts = assigned.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(top)
    return levels_by_cluster(assigned, c, [r[0] for r in counts.collect()])
