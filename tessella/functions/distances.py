"""Sums of Euclidean distances from every point to the points of each group, without comparing all pairs.

Space is halved into cubes ("boxes"), level by level. Points of a box and of the boxes that touch it are compared one by one. Between boxes
that do not touch, the distance is a smooth function: it is taken from its values at Chebyshev nodes of both boxes (an interpolating fast
multipole method), so that all pairs of two boxes cost one product of matrices. Every point takes part in every sum; nothing is sampled.
The interpolation is off by less than 1e-6 of a box's half side for the worst pair, with both signs; README has what that leaves in sums.

A box is a code of its whole-number coordinates, BITS for each feature. `leaf` is the level of the smallest boxes. The last step works on
portions, some boxes of `leaf` within one box of the level `top`: it gets their points, those of the boxes that touch them, and sums of the
boxes around them; what comes from larger boxes was added up before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.io import settle

#: Nodes in each direction of a box, by the number of features; more features are compared pair by pair.
NODES = {1: 16, 2: 12, 3: 9}
BITS, DEEPEST, TOP = 20, 18, 4
#: Boxes of the smallest size, at most.
MOST_BOXES = 60_000
#: Seconds of a core that one pair of points takes, and an entry of a matrix between two boxes, for the choice of `leaf`; portions, at least.
PAIR, ENTRY, PORTIONS = 8e-9, 2.5e-10, 400
#: Points of a row that carries points, and bytes of an Arrow batch that is sent on.
CHUNK, SENT = 4096, 1 << 24


def pack(boxes: np.ndarray) -> np.ndarray:
    return sum(boxes[:, i].astype(np.int64) << (BITS * i) for i in range(boxes.shape[1]))


def unpack(codes: np.ndarray, d: int) -> np.ndarray:
    return np.stack([(codes >> (BITS * i)) & ((1 << BITS) - 1) for i in range(d)], axis=-1)


def _up(codes: np.ndarray, levels: int, d: int) -> np.ndarray:
    return pack(unpack(codes, d) >> levels)


def box(features: list[str], low: list[float], side: float, level: int) -> Column:
    """The code of a row's box."""
    at = [F.greatest(F.lit(0), F.least(F.lit((1 << level) - 1), F.floor((F.col(f) - F.lit(x)) * F.lit((1 << level) / side)))) for f, x in zip(features, low)]
    return sum((c.cast("long") * F.lit(1 << (BITS * i)).cast("long") for i, c in enumerate(at)), F.lit(0).cast("long"))


def _nodes(p: int) -> np.ndarray:
    return np.cos((2 * np.arange(p) + 1) * np.pi / (2 * p))


def _lagrange(p: int, x: np.ndarray) -> np.ndarray:
    """(point, node): the polynomials that are one at a node and zero at the others, for points from -1 to 1."""
    k, share = np.arange(p), np.full(p, 2 / p)
    share[0] = 1 / p
    return (np.cos(np.outer(np.arccos(np.clip(x, -1, 1)), k)) * share) @ np.cos(np.outer(np.arccos(_nodes(p)), k)).T


def _tensor(x: np.ndarray) -> np.ndarray:
    """(point, node of the box) for points from -1 to 1 in each feature."""
    p = NODES[x.shape[1]]
    out = _lagrange(p, x[:, 0])
    for i in range(1, x.shape[1]):
        out = (out[:, :, None] * _lagrange(p, x[:, i])[:, None, :]).reshape(len(x), -1)
    return out


def _halves(p: int) -> list[np.ndarray]:
    """(node of a box, node of its lower or upper half) in one direction."""
    return [_lagrange(p, (_nodes(p) + side) / 2).T for side in (-1, 1)]


def _along(x: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
    """A matrix for each of the first directions of x, which has the nodes of a box in its first axis."""
    shape, p = x.shape, len(matrices[0])
    x = x.reshape(*[p] * len(matrices), -1)
    for i, m in enumerate(matrices):
        x = np.moveaxis(np.tensordot(m, x, axes=(1, i)), 0, i)
    return x.reshape(shape)


def _touching(boxes: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which boxes, the boxes that touch them or they themselves), one direction after another."""
    for step in product((-1, 0, 1), repeat=boxes.shape[1]):
        other = boxes + step
        at = np.nonzero(((other >= 0) & (other < 1 << level)).all(axis=1))[0]
        yield at, other[at]


def _met(codes: np.ndarray, n: np.ndarray, level: int, d: int) -> np.ndarray:
    """For each box, in the order of their codes, the sum of n over it and those that touch it."""
    out = np.zeros(len(codes))
    for at, other in _touching(unpack(codes, d), level):
        wanted = pack(other)
        found = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        out[at] += n[found] * (codes[found] == wanted)
    return out


def choose(points: DataFrame, features: list[str], low: list[float], side: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(leaf, codes of its boxes, seconds of a core for each): the level at which pairs of points and of boxes take least together."""
    d = len(features)
    best, above = (0, np.zeros(0, dtype=np.int64), np.full(1, np.inf)), 0.0
    for level in range(2, DEEPEST + 1):
        rows = points.groupBy(box(features, low, side, level).alias("c")).agg(F.count("*").alias("n")).limit(MOST_BOXES + 1).collect()
        if len(rows) > MOST_BOXES:
            break
        codes, n = (np.array(c, dtype=np.int64) for c in zip(*sorted(map(tuple, rows))))
        parents, own, children = np.unique(_up(codes, 1, d), return_inverse=True, return_counts=True)
        far = _met(parents, children, level - 1, d)[own] * ENTRY * NODES[d] ** (2 * d)
        cost = n * _met(codes, n, level, d) * PAIR + far
        if cost.sum() + above < best[2].sum():
            best = level, codes, cost + above / len(codes)
        above += far.sum()
        if above > best[2].sum():
            break
    return best


def _portions(codes: np.ndarray, cost: np.ndarray, levels: int, d: int) -> np.ndarray:
    """The portion of each box: boxes in a row, of one box that many levels above, that take a PORTIONS-th of the time or are one box."""
    region = _up(codes, levels, d)
    halfway = _up(codes, max(0, levels - 1), d)
    order = np.lexsort((codes, halfway, region))
    out, portion, held = np.zeros(len(codes), dtype=np.int64), -1, 0.0
    for at, before in zip(order, [None, *order[:-1]]):
        if before is None or region[at] != region[before] or held + cost[at] > cost.sum() / PORTIONS:
            portion, held = portion + 1, 0.0
        out[at], held = portion, held + cost[at]
    return out


def add_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Adds to `total` (point of x, column) the distances to the points of y, times their weights in each column."""
    x, y = np.ascontiguousarray(x), np.ascontiguousarray(y.T)
    for b in range(0, y.shape[1], 1024):
        to, weight = y[:, b : b + 1024], weights[b : b + 1024]
        one, both = np.empty((min(64, len(x)), to.shape[1])), np.empty((min(64, len(x)), to.shape[1]))  # what stays in the cache
        for a in range(0, len(x), 64):
            mine = x[a : a + 64]
            d, e = both[: len(mine)], one[: len(mine)]
            for j in range(len(to)):
                np.subtract(mine[:, j, None], to[j], out=e if j else d)
                np.multiply(e if j else d, e if j else d, out=e if j else d)
                if j:
                    np.add(d, e, out=d)
            total[a : a + 64] += np.sqrt(d, out=d) @ weight


@cache
def _turned(step: tuple[int, ...]) -> np.ndarray:
    """Where each node comes to lie when directions are swapped and turned so that `step` has falling coordinates, none below zero."""
    d, p = len(step), NODES[len(step)]
    index = np.stack(np.meshgrid(*[np.arange(p)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    out = np.zeros(len(index), dtype=np.int64)
    for j in np.argsort(-np.abs(step), kind="stable"):
        out = out * p + (p - 1 - index[:, j] if step[j] < 0 else index[:, j])
    return out


@cache
def _between(step: tuple[int, ...]) -> np.ndarray:
    """Distances (node, node) of two boxes of half side 1, the first `step` boxes away from the second; 16 of them for three features."""
    d, p = len(step), NODES[len(step)]
    grid = np.stack(np.meshgrid(*[_nodes(p)] * d, indexing="ij"), axis=-1).reshape(-1, d)
    out = np.zeros((len(grid), len(grid)))
    for i in range(d):
        one = np.subtract.outer(grid[:, i] + 2.0 * step[i], grid[:, i])
        one *= one
        out += one
    return np.sqrt(out, out=out)


def _far(targets: np.ndarray, sources: np.ndarray, kinds: np.ndarray, sums: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, sums of distances (target, kind, node)) over the sources whose parents touch a target's parent and that do not touch it.

    `sources` are boxes, each once for each kind of its points. Boxes that lie to each other as others do, but for turns and swaps, share a matrix.
    """
    names, kind = np.unique(kinds, return_inverse=True)
    out = np.zeros((len(targets) * len(names), sums.shape[1]))
    steps = targets[:, None] - sources[None]
    t, s = np.nonzero((np.abs((targets >> 1)[:, None] - (sources >> 1)[None]).max(axis=2) <= 1) & (np.abs(steps).max(axis=2) >= 2))
    steps = steps[t, s]
    shape = pack(-np.sort(-np.abs(steps), axis=1))
    for code in np.unique(shape):
        own = np.nonzero(shape == code)[0]
        way = pack(steps[own] + 4)
        own, way = own[order := np.argsort(way, kind="stable")], way[order]
        cuts = [*np.nonzero(np.diff(way, prepend=-1))[0], len(way)]
        turns = [_turned(tuple(steps[own[at]].tolist())) for at in cuts[:-1]]
        moved = np.empty((len(own), sums.shape[1]))
        for turn, at, end in zip(turns, cuts, cuts[1:]):
            moved[at:end, turn] = sums[s[own[at:end]]]
        moved = moved @ _between(tuple(unpack(np.array([code]), targets.shape[1])[0].tolist())).T
        for turn, at, end in zip(turns, cuts, cuts[1:]):  # each target and kind once
            i = own[at:end]
            out[t[i] * len(names) + kind[s[i]]] += moved[at:end, turn]
    return names, out.reshape(len(targets), len(names), -1) * half


def grouped_sums(
    points: DataFrame, names: list[str], sizes: list[int], low: list[float], side: float, leaf: int, codes: np.ndarray, cost: np.ndarray,
    finish: Callable[[np.ndarray, np.ndarray], pa.Table], schema: str,
) -> DataFrame:
    """What `finish` makes of blocks of points and their sums of distances to the points of every group.

    `points` has doubles: the features of `names`, then for each labelling (their numbers of groups are `sizes`) a group from 0, then a
    weight. The sums have a column for each group of each labelling. `leaf`, `codes` and `cost` are from choose().
    """
    d, p, spark = len(names), NODES[len(names)], points.sparkSession
    size, top, starts = p**d, max(2, min(TOP, leaf - 2)), np.cumsum([0, *sizes])
    strides, halves = np.cumprod([1, *sizes]), _halves(p)
    portion = _portions(codes, cost, leaf - top, d)
    upper = {level: np.unique(_up(codes, leaf - level, d)) for level in range(1, top)}
    # level -> (box, portion) of every portion that has boxes of `leaf` in it
    under = {level: np.unique(np.stack([_up(codes, leaf - level, d), portion]), axis=1) for level in range(2, leaf + 1)}
    half = lambda level: side / (1 << (level + 1))
    bits = lambda b: [int(v) & 1 for v in b]

    def kinds_of(rows: np.ndarray) -> np.ndarray:
        return sum((rows[:, d + k].astype(np.int64) * strides[k] for k in range(len(sizes))), np.zeros(len(rows), dtype=np.int64))

    def spread(kinds: np.ndarray) -> np.ndarray:
        """(kind, group): the groups that points of a kind, a combination of groups, belong to."""
        out = np.zeros((len(kinds), starts[-1]))
        for k in range(len(sizes)):
            out[np.arange(len(kinds)), starts[k] + kinds // strides[k] % sizes[k]] = 1.0
        return out

    def within(rows: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
        """Points from -1 to 1 in their box."""
        return (rows[:, :d] - np.array(low)) / half(level) - (2.0 * place + 1.0)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(code, points) of the boxes of `leaf`; the rows of a task come in the order of their codes."""
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)
            code = batch.column(0).to_numpy()
            cuts = [*np.nonzero(np.diff(code, prepend=-1))[0], len(code)]
            for at, end in zip(cuts, cuts[1:]):
                for i in range(at, end, CHUNK):
                    yield int(code[at]), rows[i : min(end, i + CHUNK)]

    def sums_of(found: dict[int, dict]) -> None:
        """Adds the sums of every level above `leaf` to those of `leaf`: level -> (code, kind) -> a weight for each node."""
        for level in range(leaf, 2, -1):
            for (code, kind), weights in found[level].items():
                place = unpack(np.array([code]), d)[0]
                part = _along(weights[:, None], [halves[b] for b in bits(place)])[:, 0]
                to = int(pack(place[None] >> 1)[0]), kind
                found[level - 1][to] = found[level - 1][to] + part if to in found[level - 1] else part

    fields = ["key", "level", "code", "kind", "data"]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    def around(place: np.ndarray, level: int) -> np.ndarray:
        return np.concatenate([pack(other) for _, other in _touching(place[None], level)])

    def portions(boxes: np.ndarray, level: int) -> list[int]:
        has, keys = under[level]
        ends = zip(np.searchsorted(has, boxes), np.searchsorted(has, boxes, side="right"))
        return np.unique(np.concatenate([keys[a:b] for a, b in ends])).tolist()

    def among(boxes: np.ndarray, known: np.ndarray) -> list[int]:
        return boxes[known[np.minimum(np.searchsorted(known, boxes), len(known) - 1)] == boxes].tolist()

    def dealt(above: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sums of boxes for every parent of targets (`above`: levels to `top`), or points and sums for every portion that needs them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, dict] = {level: {} for level in range(2, leaf + 1)}
            rows, held = [], 0
            for code, block in blocks(batches):
                place = unpack(np.array([code]), d)[0]
                names_, own = np.unique(kinds_of(block), return_inverse=True)
                weights = np.zeros((len(names_), len(block)))
                weights[own, np.arange(len(block))] = block[:, -1]
                for kind, part in zip(names_.tolist(), weights @ _tensor(within(block, place, leaf))):
                    at = code, kind
                    found[leaf][at] = found[leaf][at] + part if at in found[leaf] else part
                if not above:
                    data = block.tobytes()
                    for key in portions(around(place, leaf), leaf):
                        rows.append((key, -1, code, 0, data))
                        held += len(data)
                    if held > SENT:
                        yield sent(rows)
                        rows, held = [], 0
            sums_of(found)
            for level in range(2, top + 1) if above else range(top + 1, leaf + 1):
                for (code, kind), weights in found[level].items():
                    data = weights.tobytes()
                    parent = unpack(np.array([code]), d)[0] >> 1
                    near = around(parent, level - 1)
                    for key in among(near, upper[level - 1]) if above else portions(near, level - 1):
                        rows.append((key, level, code, kind, data))
                        held += len(data)
                    if held > SENT:
                        yield sent(rows)
                        rows, held = [], 0
            if rows:
                yield sent(rows)

        return run

    def merged(table: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(boxes, kinds, sums) of a level, each box and kind once, as tasks may each have a part of them."""
        out: dict[tuple, np.ndarray] = {}
        for own, code, kind, data in zip(*[table.column(c).to_pylist() for c in ("level", "code", "kind")], table.column("data")):
            if own == level:
                part = np.frombuffer(data.as_buffer(), dtype=float)
                out[code, kind] = out[code, kind] + part if (code, kind) in out else part
        at = np.array(list(out), dtype=np.int64).reshape(-1, 2)
        return unpack(at[:, 0], d), at[:, 1], np.array(list(out.values())).reshape(-1, size)

    def above(table: pa.Table) -> pa.Table:
        """The sums at the nodes of a parent's boxes (node, group), from the boxes of their own level alone."""
        level, key = table.column("level")[0].as_py(), table.column("key")[0].as_py()
        sources, kinds, sums = merged(table, level)
        targets = unpack(np.unique(pack(sources[pack(sources >> 1) == key])), d)
        names_, out = _far(targets, sources, kinds, sums, half(level))
        out = out.transpose(0, 2, 1) @ spread(names_)
        return pa.Table.from_arrays([pa.array([level] * len(targets), pa.int32()), pa.array(pack(targets)), pa.array([x.tobytes() for x in out], pa.binary())], names=["level", "code", "data"])

    def work(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        parts: dict[int, list[np.ndarray]] = {}
        given: dict[int, np.ndarray] = {}
        for level, code, data in zip(table.column("level").to_pylist(), table.column("code").to_pylist(), table.column("data")):
            if level == -1:
                parts.setdefault(code, []).append(np.frombuffer(data.as_buffer(), dtype=float).reshape(-1, d + len(sizes) + 1))
            elif level < -1:
                given[-level] = np.frombuffer(data.as_buffer(), dtype=float).reshape(size, -1)
        boxes = {code: np.vstack(x) for code, x in parts.items()}
        every = np.array(sorted(boxes), dtype=np.int64)
        own = codes[portion == key]
        place = unpack(_up(own[:1], leaf - top, d), d)[0]
        at_nodes = given[2]
        for level in range(3, top + 1):
            at_nodes = given[level] + _along(at_nodes, [halves[b].T for b in bits(place >> (top - level))])
        now = {int(pack(place[None])[0]): at_nodes}
        for level in range(top + 1, leaf + 1):
            targets = np.unique(_up(own, leaf - level, d))
            sources, kinds, sums = merged(table, level)
            names_, out = _far(unpack(targets, d), sources, kinds, sums, half(level))
            out = out.transpose(0, 2, 1) @ spread(names_)
            up = _up(targets, 1, d)
            now = {int(c): x + _along(now[int(u)], [halves[b].T for b in bits(b_)]) for c, u, b_, x in zip(targets, up, unpack(targets, d), out)}
        done = []
        for code in own.tolist():
            rows, place = boxes[code], unpack(np.array([code]), d)[0]
            other = np.vstack([boxes[c] for c in among(around(place, leaf), every)])
            names_, kind = np.unique(kinds_of(other), return_inverse=True)
            weights, to = np.zeros((len(other), len(names_))), spread(names_)
            weights[np.arange(len(other)), kind] = other[:, -1]
            for low_ in range(0, len(rows), CHUNK):
                x = rows[low_ : low_ + CHUNK]
                total = _tensor(within(x, place, leaf)) @ now[code]
                near = np.zeros((len(x), len(names_)))
                add_sums(x[:, :d], other[:, :d], weights, near)
                done.append(finish(x, total + near @ to))
        return pa.concat_tables(done)

    region = sum((F.shiftright(F.shiftright("_code", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)), leaf - top) * F.lit(1 << (BITS * i)).cast("long") for i in range(d)), F.lit(0).cast("long"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    own = points.select(box(names, low, side, leaf).alias("_code"), *points.columns).withColumn("_region", region)
    own = settle(own.repartitionByRange(tasks, "_region", "_code", *names).sortWithinPartitions("_region", "_code").drop("_region"))
    form = "key long, level int, code long, kind long, data binary"
    nodes = own.mapInArrow(dealt(True), form).repartition(tasks, "level", "key").groupBy("level", "key").applyInArrow(above, "level int, code long, data binary")
    to = [(level, int(c), int(k)) for level in range(2, top + 1) for c, k in under[level].T]
    to = spark.createDataFrame(to, "level int, code long, key long")
    given = nodes.join(F.broadcast(to), ["level", "code"]).select("key", (-F.col("level")).alias("level"), "code", F.lit(0).cast("long").alias("kind"), "data")
    every = own.mapInArrow(dealt(False), form).unionByName(given)
    return every.repartition(2 * tasks, "key").groupBy("key").applyInArrow(work, schema)
