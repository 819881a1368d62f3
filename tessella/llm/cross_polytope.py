"""Approximate nearest neighbours by largest inner product: cross-polytope hashing with several probes in each of several tables.

Three rounds of random signs and a fast Hadamard transform rotate a vector; the signed axis that it is then nearest to is its hash, and
`m` hashes are its code in a table. Where norms differ, one more coordinate makes all rows equally long and is zero in queries, so that
the largest inner product is the smallest angle. A query probes, in every table, the codes that its own rotation is next nearest to. How many
is fitted: at most SAMPLE queries are searched exactly (one pass over all rows), and the least number of probes is taken whose codes hold
the share RECALL of their neighbours. m follows the number of rows; where probes do not suffice, it is lowered, and one hash with all its
codes holds every row, so the share is always reached on the sample.

Tables are searched one after the other. Rows go to groups of codes, with their vectors; a query goes to each group that it probes, with
the codes. Groups are split into blocks of about ROWS rows by their counted size, however many rows a code has. A block's rows come
first and are held as one matrix, its queries stream past it. The probed rows' scores are computed anew in a fixed order of summation, so
that equal vectors tie. A block gives a query its k best, and of them only what reaches the k-th best score that the query has from the
searches before, the first of which is one group, that of its nearest code; so what leaves the blocks does not grow with their number.
Of equal vectors only the k + 1 of least id are kept, as no more can be among the k best. Queries that find fewer than k rows are
searched exactly, block by block.

Edges: rows with a null id, or a vector that is null, empty, zero or holds null, NaN or infinity, take no part. Rows equal in id and
vector count once; a query does not find rows of its own id. A shorter vector counts as if it went on with zeros. Equal scores go by id. Without
rows or queries there is no result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrow_words import mixed
from tessella.llm.common import settle

#: Tables; rows of a block; rows that a code should hold; queries that the fit searches exactly, and the share of their neighbours wanted.
TABLES, ROWS, CODE_ROWS, SAMPLE, RECALL = 3, 4096, 65_536, 100, 0.95
#: Probes of a table that the fit considers where a code has more than one hash.
MOST_PROBES = 256
#: Numbers that are worked on at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class Index:
    """A fitted index: rotations (signs of tables x hashes x rounds x axes), codes that a query probes in a table, groups of codes in
    a table; the greatest norm where norms differ, else 0."""

    signs: np.ndarray
    probes: int
    groups: int
    norm: float

    @property
    def width(self) -> int:
        return self.signs.shape[-1]

    def _scores(self, x: np.ndarray, table: int, h: int) -> np.ndarray:
        """The coordinate of each row along every signed axis, positive axes first."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for signs in self.signs[table, h]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], axis=1)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows with the coordinate that makes their norms equal."""
        if not self.norm:
            return x
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, more[:, None]])

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The code of each row in a table."""
        x, out = self.lifted(x, False), np.zeros(len(x), dtype=np.int64)
        for h in range(self.signs.shape[1]):
            out = out * (2 * self.width) + self._scores(x, table, h).argmax(axis=1)
        return out

    def probed(self, x: np.ndarray, table: int, most: int) -> np.ndarray:
        """(row, place) -> the codes of a table nearest to a query, nearest first: by the sum over hashes of squared gaps to the best axis."""
        x = self.lifted(x, True)
        codes, gaps = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for h in range(self.signs.shape[1]):
            scores = self._scores(x, table, h)
            axes = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            gap = (scores.max(axis=1, keepdims=True) - np.take_along_axis(scores, axes, axis=1)) ** 2
            gaps = (gaps[:, :, None] + gap[:, None]).reshape(len(x), -1)
            codes = (codes[:, :, None] * (2 * self.width) + axes[:, None]).reshape(len(x), -1)
            best = np.argsort(gaps, axis=1, kind="stable")[:, :most]
            gaps, codes = np.take_along_axis(gaps, best, axis=1), np.take_along_axis(codes, best, axis=1)
        return codes

    def group(self, codes: np.ndarray, table: int) -> np.ndarray:
        """The group of codes of a table."""
        return (mixed(codes.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64) + table * self.groups


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of every row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, ended with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, CELLS // width)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def valid(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Rows once each, and of equal vectors the k + 1 of least id."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.distinct().withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place")


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best of every query, by `scores` up to rounding and then by exact order. -inf is no candidate."""
    least = np.full(len(scores), -np.inf)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(least), least, 0.0)))
    q, r = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
    exact = np.empty(len(q))
    for at in range(0, len(q), step := max(1, CELLS // rows.shape[1])):
        s = slice(at, at + step)
        exact[s] = (queries[q[s]] * rows[r[s]]).sum(axis=1)
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], r[first], exact[first]


def _in_block(width: int, k: int, seen: bool):
    """Streams the queries of each (group, block) past its rows. `seen`: only rows of a code that the query probes count."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in _parts(batches, width):
            group, place, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.nonzero((np.diff(group) != 0) | (np.diff(place) != 0) | (np.diff(side) != 0))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                if (group[a], place[a]) != key:
                    key, held, block = (group[a], place[a]), [], None
                if side[a] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    codes = np.concatenate([np.asarray(p.column("codes").flatten()) for p in held])
                    block = np.vstack([_matrix(p.column("v"), width) for p in held]), np.concatenate([p.column("vec_id").to_numpy() for p in held]), *np.unique(codes, return_inverse=True)
                    held = []
                if block is not None:
                    rows, ids, codes, code = block
                    for step in range(0, part.num_rows, size := max(1, CELLS // len(ids))):
                        some = part.slice(step, size)
                        queries, own = _matrix(some.column("v"), width), some.column("vec_id").to_numpy()
                        scores = queries @ rows.T
                        if seen:
                            wanted, sizes = np.asarray(some.column("codes").flatten()), np.diff(np.asarray(some.column("codes").offsets))
                            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                            there = np.nonzero(codes[at] == wanted)[0]
                            probed = np.zeros((len(queries), len(codes)), dtype=bool)
                            probed[np.repeat(np.arange(len(queries)), sizes)[there], at[there]] = True
                            scores[~probed[:, code]] = -np.inf
                        scores[own[:, None] == ids[None]] = -np.inf
                        floor = some.column("floor").to_numpy()
                        scores[scores < (floor - 1e-9 * (1.0 + np.abs(np.where(np.isfinite(floor), floor, 0.0))))[:, None]] = -np.inf
                        q, r, exact = _best(scores, ids, rows, queries, k)
                        yield pa.RecordBatch.from_arrays([pa.array(some.column("q").to_numpy()[q]), pa.array(ids[r]), pa.array(exact)], schema=schema)

    return run


def _compared(rows: DataFrame, queries: DataFrame, width: int, k: int, seen: bool) -> DataFrame:
    """(q, vec_id, score): the k best of each query in each block, from its `floor` on. Both have group, block, codes, vec_id, v; queries
    have q and floor."""
    names = ["group", "block", "side", "q", "floor", "vec_id", "codes", "v"]
    sides = rows.withColumns({"side": F.lit(0), "q": F.lit(0).cast("long"), "floor": F.lit(0.0)}).select(names).union(queries.withColumn("side", F.lit(1)).select(names))
    dealt = sides.repartition("group", "block").sortWithinPartitions("group", "block", "side")
    return dealt.mapInArrow(_in_block(width, k, seen), "q long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each q, each row once."""
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["q", "rank"])


def _blocks(n: int) -> int:
    return max(1, -(-n // ROWS))


def exact(rows: DataFrame, queries: DataFrame, n: int, width: int, k: int) -> DataFrame:
    """(q, vec_id, score, rank): each query against all rows, in blocks."""
    none = {"group": F.lit(0).cast("long"), "codes": F.array(F.lit(0).cast("long")), "floor": F.lit(float("-inf"))}
    rows = rows.withColumns(none | {"block": F.pmod(F.xxhash64("vec_id"), F.lit(_blocks(n)))})
    queries = queries.withColumns(none | {"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_blocks(n) - 1).cast("long")))})
    return ranked(_compared(rows, queries, width, k, False), k)


def _hits(index: Index, width: int, queries: np.ndarray, neighbours: list[tuple[int, np.ndarray]], most: int) -> np.ndarray:
    """For each (query, neighbour) the least place of the neighbour's code among the query's probes of a table; `most` if it is in none."""
    at, x = np.array([q for q, _ in neighbours]), np.vstack([x for _, x in neighbours])
    best = np.full(len(at), most)
    for t in range(len(index.signs)):
        same = index.probed(queries, t, most)[at] == index.codes(x, t)[:, None]
        best = np.minimum(best, np.where(same.any(axis=1), same.argmax(axis=1), most))
    return best


def fit(rows: DataFrame, queries: DataFrame, n: int, width: int, norms: tuple[float, float], k: int, recall: float = RECALL, seed: int = 1) -> Index:
    """An index for `rows` whose probes hold the share `recall` of the neighbours of at most SAMPLE queries."""
    low, high = norms
    norm = 0.0 if low >= high * (1 - 1e-6) else high
    axes = 1 << max(0, width + bool(norm) - 1).bit_length()
    hashes = max(1, int(np.ceil(np.log(max(1.0, n / CODE_ROWS)) / np.log(2 * axes))))
    sample = queries.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE)
    held = sample.collect()
    pad = lambda v: np.pad(np.array(v, dtype=np.float64), (0, width - len(v)))
    asked = np.vstack([pad(r["v"]) for r in held])
    near = _near_sample(rows, asked, np.array([r["vec_id"] for r in held]), width, k)
    neighbours = [(r["q"], pad(r["v"])) for r in near.collect()]  # SAMPLE times k rows
    while True:
        signs = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(TABLES, hashes, 3, axes))
        most = 2 * axes if hashes == 1 else MOST_PROBES
        index = Index(signs, most, _blocks(n), norm)
        if not neighbours:
            return index
        place = np.sort(_hits(index, width, asked, neighbours, most))
        probes = int(place[int(np.ceil(recall * len(place))) - 1]) + 1
        if probes <= most:
            return Index(signs, probes, _blocks(n), norm)
        hashes -= 1


def _near_sample(rows: DataFrame, asked: np.ndarray, own: np.ndarray, width: int, k: int) -> DataFrame:
    """(q, v) of the k best rows for each of a few queries; a task sends its k best of each."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for part in _parts(batches, max(width, len(asked))):
            x, ids = _matrix(part.column("v"), width), part.column("vec_id").to_numpy()
            scores = asked @ x.T
            scores[own[:, None] == ids[None]] = -np.inf
            q, r, score = _best(scores, ids, x, asked, k)
            found = pa.table({"q": q, "vec_id": ids[r], "score": score, "v": part.column("v").take(pa.array(r))})
            best = found if best is None else pa.concat_tables([best, found]).combine_chunks()
            q, score = best.column("q").to_numpy(), best.column("score").to_numpy()
            order = np.lexsort((best.column("vec_id").to_numpy(), -score, q))
            order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
            best = best.take(pa.array(order)).combine_chunks()
        if best is not None:
            yield from best.to_batches()

    found = rows.select("vec_id", "v").mapInArrow(run, f"q long, vec_id long, score double, v {kind}")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).select("q", "v")


def _placed(rows: DataFrame, blocks: DataFrame, index: Index, width: int, table: int) -> DataFrame:
    """Each row in its group and block of a table: (group, block, codes, vec_id, v)."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 4 * index.width):
            codes = index.codes(_matrix(part.column("v"), width), table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32)), pa.array(codes))
            yield pa.RecordBatch.from_arrays([pa.array(index.group(codes, table)), lists, part.column("vec_id"), part.column("v")], names=["group", "codes", "vec_id", "v"])

    placed = rows.select("vec_id", "v").mapInArrow(run, f"group long, codes array<long>, vec_id long, v {kind}")
    return placed.join(blocks, "group", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))))


def _asked(queries: DataFrame, blocks: DataFrame, index: Index, width: int, table: int, probes: int) -> DataFrame:
    """Each query once for each block of the groups that its probes of a table are in: (group, block, codes, q, floor, vec_id, v)."""
    kind = queries.schema["v"].dataType.simpleString()
    names = ["q", "floor", "vec_id", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(4 * index.width, probes)):
            codes = index.probed(_matrix(part.column("v"), width), table, probes)
            group, row = index.group(codes, table).ravel(), np.repeat(np.arange(len(codes)), codes.shape[1])
            order = np.lexsort((group, row))
            row, group, codes = row[order], group[order], codes.ravel()[order]
            starts = np.nonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group) != 0)]))[0] if len(row) else row
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(codes))
            at = pa.array(row[starts])
            yield pa.RecordBatch.from_arrays([pa.array(group[starts]), lists, *[part.column(c).take(at) for c in names]], names=["group", "codes", *names])

    asked = queries.select(names).mapInArrow(run, f"group long, codes array<long>, q long, floor double, vec_id long, v {kind}")
    all_ = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)
    return asked.join(blocks, "group", "left").withColumn("block", F.explode(all_))


def _counts(rows: DataFrame, index: Index, width: int) -> DataFrame:
    """(group, blocks) of the groups that take more than one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 4 * index.width):
            x = _matrix(part.column("v"), width)
            group, n = np.unique([index.group(index.codes(x, t), t) for t in range(len(index.signs))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(n)], names=["group", "n"])

    counted = rows.select("v").mapInArrow(run, "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") > 2 * ROWS).select("group", F.ceil(F.col("n") / ROWS).alias("blocks"))


def search(df: DataFrame, is_query: Column | str, id_: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that meets `is_query`, nearest first."""
    sound = valid(df.filter(is_query), id_, vector).distinct().withColumn("q", F.monotonically_increasing_id())
    queries, rows = settle(sound), settle(few_copies(valid(df, id_, vector), k))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.min(norm).alias("low"), F.max(norm).alias("high")).first()
    named = lambda found: found.join(queries.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
    n, width = facts["n"], facts["width"]
    if not n or queries.isEmpty():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, queries, n, width, (facts["low"], facts["high"]), k, recall)
    blocks, found = settle(_counts(rows, index, width)), None
    # the group of the nearest code first, for a score to reach; then the tables
    for table, probes in [(len(index.signs) - 1, 1), *((t, index.probes) for t in range(len(index.signs)))]:
        asked = queries.withColumn("floor", F.lit(float("-inf")))
        if found is not None:
            floors = found.filter(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("score").alias("floor"))
            asked = queries.join(floors, F.col("q") == F.col("_q"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).drop("_q")
        new = _compared(_placed(rows, blocks, index, width, table), _asked(asked, blocks, index, width, table, probes), width, k, True)
        found = settle(ranked(new if found is None else found.select("q", "vec_id", "score").union(new), k))
    short = queries.join(found.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").filter(F.coalesce("n", F.lit(0)) < min(k, n - 1)).drop("n")
    short = settle(short)
    if short.isEmpty():
        return named(found)
    rest = exact(rows, short, n, width, k)
    return named(found.join(short.select("q"), "q", "left_anti").unionByName(rest))
