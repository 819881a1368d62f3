"""Scores texts with a hidden Markov model: Baum-Welch counts aggregated across partitions, scaled forward recursion.

Tokens are the words of the text with A-Z lowered, then one end token. The latent states emit tokens: state s emits token w with
(E[w, s] + 1 / STATES) / (E[s] + (V + 1) / STATES), where E are expected counts and V is the number of known tokens; all unknown
tokens together are one more token without counts. So every word has a profile of its own, whatever the vocabulary, and the
likelihood of the whole text is exact: the forward recursion runs over all its tokens, scaled at each.

Texts are encoded once, in chunks of about `CHUNK` bytes: a chunk holds the codes of its tokens and its own vocabulary. About
`TASK_CHUNKS` chunks are a group with one vocabulary, whose tokens get numbers and training counts by one exchange. Groups are
stored in buckets, one in each, so that no chunk moves again. A chunk is one row, small enough that Spark never holds large arrays;
the recursion takes the chunks of a group together until they have about `BLOCK_TOKENS` tokens. Training passes over every training text until a round gains less
than `GAIN` of the log likelihood. In a round a task runs the forward-backward recursion over the whole texts of one group, adds up
the expected counts of its tokens and sends them, packed by ranges of token numbers; the counts of a range are added up and go back
to the groups that asked. The most frequent `FREQUENT` tokens, a fixed number, are broadcast. Expected counts travel as 40-bit
numbers, without the last state's, which the token's count tells, and are added up as 64-bit ones.

A text of more than `SEGMENT` tokens is cut into segments that run through the recursion side by side: the product of a
segment's transition matrices tells what enters the next one, forwards and backwards, so that the cut changes no value.

Nulls and edges: a null text is an empty one (its only token is the end). A null id counts as training and is not held out.
Every row gives one row, repeated ids included. Without training rows N and V are 0, and all tokens are unknown. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrow_words as aw
from tessella.llm.common import Tables, settle

STATES = 6
#: Size of the emission matrix in the tests of the recursion; the model has a row for every token.
CLASSES = 1 << 13
#: Training ends with a round that gains less than this share of the log likelihood.
GAIN = 1e-3
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: Most tokens of a segment, and tokens that run through the recursion at once.
SEGMENT, BLOCK_TOKENS = 512, 300_000
FREQUENT = 200_000
#: Tokens of chunks that one range of token numbers has, at most about; and frequent tokens that are added up together.
RANGE, SLICE = 250_000, 256
#: Chunks of a group, about: a task works on one group and sends the sums of its tokens once.
TASK_CHUNKS = 36
#: Distinct tokens of a chunk, about; more of them only make ranges larger.
DISTINCT = 27_000
#: How tables with large values are written: these are compressed already, and in row groups of this size readers and writers hold little.
LARGE = {"compression": "none", "parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1}
#: The end token; no word is empty.
END = ""
HELD_OUT, FOLDS = 2, 7
Batches = Iterator[pa.RecordBatch]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


# The recursion


def _times(lengths: np.ndarray) -> list[int]:
    """How many sequences have a token at each step, for descending lengths."""
    return np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right").tolist()


def _in_step(codes: np.ndarray, starts: np.ndarray, active: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The codes of all first tokens, of all second ones and so on; and the sequence of each token in that order."""
    step = np.repeat(np.arange(len(active)), active)
    places = np.cumsum([0, *active])
    which = np.arange(places[-1]) - np.repeat(places[:-1], active)
    ordered = codes[starts[which] + step]
    return [ordered[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())], which


class Room:
    """Arrays that are used again for every block, as fresh memory costs as much time as the recursion itself."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return Room, ()  # tasks get rooms of their own, without the arrays

    def give(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size)
        return self.held[name][:size].reshape(shape)

    def steps(self, name: str, states: int, codes: list[np.ndarray]) -> list[np.ndarray]:
        """An array (states, sequences) for each step."""
        whole, at, out = self.give(name, states * sum(map(len, codes))), 0, []
        for own in codes:
            out.append(whole[at : at + states * len(own)].reshape(states, -1))
            at += states * len(own)
        return out


ROOM = Room()


def _emitted(emit: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
    """The emissions of tokens in step, by state first."""
    out = ROOM.steps("emitted", emit.shape[1], codes)
    for own, E in zip(codes, out):
        E[:] = emit.take(own, axis=0).T
    return out


def _forward(emitted: list[np.ndarray], step: np.ndarray, entering: np.ndarray):
    """(scaled forward values, by state first; scales) of tokens in step; `entering`: the states before the first emission, by sequence."""
    values = ROOM.steps("values", len(step), [E[0] for E in emitted])
    scales, turn = [], np.ascontiguousarray(step.T)
    for t, (now, E) in enumerate(zip(values, emitted)):
        np.multiply(turn @ values[t - 1][:, : E.shape[1]] if t else entering, E, out=now)
        scale = np.add.reduce(now, axis=0)
        now /= scale
        scales.append(scale)
    return values, scales


def _backward(values, emitted, scales, step, after, pairs) -> np.ndarray:
    """Turns `values` into the chance of each state at each token; gives what the token before each sequence gets.

    `after`: what the last token of each sequence gets from behind, scaled so that its states' chances add up to one. The
    chances of two states in turn are added to `pairs`.
    """
    ahead = np.empty((len(step), 0))
    for t in range(len(values) - 1, -1, -1):
        k, j = values[t].shape[1], ahead.shape[1]
        now = step @ ahead if j == k else np.concatenate([step @ ahead, after[:, j:k]], axis=1)
        ahead = emitted[t]
        ahead *= now
        ahead /= scales[t]
        if t:
            pairs += values[t - 1][:, :k] @ ahead.T
        values[t] *= now
    return ahead


def _products(emitted: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    """(state after, state before, segment): the products of the transition matrices of segments of equal length, each scaled."""
    states, n, turn = len(step), emitted[0].shape[1], np.ascontiguousarray(step.T)
    now = np.repeat(np.eye(states)[:, :, None], n, axis=2)
    for t, E in enumerate(emitted):
        now = (turn @ now.reshape(states, -1)).reshape(states, states, n)
        now *= E[:, None]
        if t % 8 == 7:  # eight emissions are far from what 64 bits can hold
            now /= np.add.reduce(now.reshape(-1, n), axis=0)
    return now


def _parted(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """`order`, by descending lengths, in parts of about BLOCK_TOKENS tokens."""
    total = np.cumsum(lengths[order])
    cuts = np.searchsorted(total, np.arange(BLOCK_TOKENS, total[-1] if len(total) else 0, BLOCK_TOKENS))
    yield from (p for p in np.split(order, np.unique(cuts)) if len(p))


def run(obs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: tuple, into: tuple | None = None) -> np.ndarray:
    """log10 P(tokens) of sequences of `obs`, none of them empty; adds the expected counts of start, step and emission to `into`."""
    start, step, emit = model
    states, total = len(start), np.zeros(len(starts))
    head = (lengths - 1) % SEGMENT + 1  # the first segment is what the others, which are full, leave
    more = (lengths - head) // SEGMENT
    base = np.cumsum(more) - more  # of each sequence's full segments
    owner = np.repeat(np.arange(len(starts)), more)
    at = starts[owner] + head[owner] + (np.arange(len(owner)) - base[owner]) * SEGMENT
    long = np.nonzero(more)[0]
    parts = list(_parted(np.arange(len(owner)), np.full(len(owner), SEGMENT)))
    product = np.empty((states, states, len(owner)))
    for part in parts:
        product[:, :, part] = _products(_emitted(emit, _in_step(obs, at[part], [len(part)] * SEGMENT)[0]), step)
    # what the last token of each segment gets from behind
    behind, behind_head = np.ones((states, len(owner))), np.ones((states, len(starts)))
    for j in range(int(more.max(initial=0)) - 1, -1, -1):
        here = long[more[long] > j]
        got = np.einsum("oik,ok->ik", product[:, :, base[here] + j], behind[:, base[here] + j])
        got /= got.sum(axis=0)
        if j:
            behind[:, base[here] + j - 1] = got
        else:
            behind_head[:, here] = got

    def through(codes, entering, after, first):
        """(log10 of each token's scale, states at the last tokens, what the token before gets) of segments in step."""
        emitted = _emitted(emit, codes)
        values, scales = _forward(emitted, step, entering)
        n = [*map(len, codes), 0]
        ends = np.concatenate([v[:, stay:] for v, stay in zip(values[::-1], n[:0:-1])], axis=1)
        logs, ahead = np.log10(np.concatenate(scales)), None
        if into is not None:
            pairs = np.zeros((states, states))
            ahead = _backward(values, emitted, scales, step, after / (ends * after).sum(axis=0), pairs)
            into[1][:] += pairs * step
            seen = np.concatenate(codes)
            for s in range(states):
                chance = np.concatenate([v[s] for v in values], out=ROOM.give("chance", len(seen)))
                into[2][:, s] += np.bincount(seen, weights=chance, minlength=len(emit))
            if first:
                into[0][:] += values[0].sum(axis=1)
        return logs, ends, ahead

    ended = np.empty((states, len(starts)))
    for part in _parted(np.argsort(-head, kind="stable"), head):
        codes, which = _in_step(obs, starts[part], _times(head[part]))
        logs, ended[:, part], _ = through(codes, start[:, None], behind_head[:, part], True)
        total[part] += np.bincount(which, weights=logs, minlength=len(part))
    # the states at the last token before each full segment
    before = np.empty((states, len(owner)))
    for j in range(int(more.max(initial=0))):
        here = long[more[long] > j]
        before[:, base[here] + j] = ended[:, here]
        got = np.einsum("oik,ik->ok", product[:, :, base[here] + j], ended[:, here])
        ended[:, here] = got / got.sum(axis=0)
    for part in parts:
        codes, which = _in_step(obs, at[part], [len(part)] * SEGMENT)
        logs, _, ahead = through(codes, step.T @ before[:, part], behind[:, part], False)
        if into is not None:
            into[1][:] += (before[:, part] @ ahead.T) * step
        total += np.bincount(owner[part][which], weights=logs, minlength=len(starts))
    return total


def forward(obs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: tuple) -> np.ndarray:
    """log10 P(tokens) of sequences of `obs`."""
    return run(obs, starts, lengths, model)


def expected(obs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: tuple, into: tuple) -> float:
    """Adds the expected counts of start, step and emission to `into`; gives the log10 likelihood."""
    return float(run(obs, starts, lengths, model, into).sum())


def emission(counts: np.ndarray, totals: np.ndarray, v_all: int) -> np.ndarray:
    """P(token | state) from expected counts by token and state; a token without counts is the unknown one."""
    return (counts + 1 / STATES) / (totals + (v_all + 1) / STATES)


def _tilted(numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    seeds = numbers[:, None] + np.arange(1, STATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tilt = 0.5 + (aw.mixed(seeds) >> np.uint64(11)) / float(1 << 53)
    return n[:, None] * tilt / tilt.sum(axis=1, keepdims=True)


def first_counts(tokens: pa.Array, n: np.ndarray) -> np.ndarray:
    """The counts of tokens dealt over the states, for each token with a different tilt."""
    return _tilted(aw.hashes(tokens), n)


# Texts as chunks


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, codes, offsets) with an end token after each text."""
    distinct, codes, offsets = aw.split(pc.ascii_lower(pc.fill_null(texts, "")))
    distinct = pa.concat_arrays([distinct.cast(pa.string()), pa.array([END])])
    codes = np.insert(codes, offsets[1:], len(distinct) - 1)
    return distinct, codes, offsets + np.arange(len(offsets))


def _pack(x: np.ndarray) -> bytes:
    """Numbers, compressed byte place by byte place."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _wanted(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _groups(docs: DataFrame) -> list[int]:
    """Numbers for groups of about TASK_CHUNKS chunks, such that Spark's hash deals each to a partition of its own; at least one for each core."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, total // (CHUNK * TASK_CHUNKS))
    dealt = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("partition")).agg(F.min("id").alias("grp"))
    return [r["grp"] for r in dealt.orderBy("grp").collect()]  # a partition without a number, which is as good as impossible, stays empty


def _chunks(docs: DataFrame, groups: list[int]) -> DataFrame:
    """(grp, chunk, held_out, doc_ids, n, lengths, codes, v, tokens, sizes, counts): texts of one kind as codes, with their vocabulary.

    The chunks of a task are dealt to groups in turn.
    """

    def encode(batches: Batches) -> Batches:
        task = TaskContext.get().partitionId()
        made, turn = task << 32, int(aw.mixed(np.array([task], dtype=np.uint64))[0] % np.uint64(len(groups)))
        waiting: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def flush(out: bool) -> pa.RecordBatch:
            nonlocal made, turn
            whole = pa.Table.from_batches(waiting[out]).combine_chunks()
            texts, ids = (pa.concat_arrays(whole.column(c).chunks) for c in ("text", "doc_id"))
            waiting[out], size[out] = [], 0
            distinct, codes, offsets = tokenized(texts)
            tokens, at = aw.contents(distinct)
            sizes = np.diff(at).astype(np.int32)
            counts = np.bincount(codes, minlength=len(distinct)).astype(np.int32) * (not out)
            made, turn = made + 1, (turn + 1) % len(groups)
            pa.default_memory_pool().release_unused()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([groups[turn]]), pa.array([made]), pa.array([out]), lists, pa.array([len(codes)]), pa.array([_pack(np.diff(offsets).astype(np.int32))]),
                    pa.array([_pack(codes.astype(np.int32))]), pa.array([len(distinct)]), pa.array([_pack(tokens)]),
                    pa.array([_pack(sizes)]), pa.array([_pack(counts)]),
                ],
                names=["grp", "chunk", "held_out", "doc_ids", "n", "lengths", "codes", "v", "tokens", "sizes", "counts"],
            )

        for batch in batches:
            for piece in aw.pieces(batch, "text", CHUNK):
                for out in (True, False):
                    mask = piece.column("held_out")
                    part = piece.filter(mask if out else pc.invert(mask))
                    if part.num_rows:
                        waiting[out].append(part)
                        size[out] += part.column("text").nbytes
                        if size[out] >= CHUNK:
                            yield flush(out)
        for out in (True, False):
            if waiting[out]:
                yield flush(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(
        encode, f"grp long, chunk long, held_out boolean, doc_ids array<{kind}>, n long, lengths binary, codes binary, v long, tokens binary, sizes binary, counts binary"
    )


def _split_up(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) for every part that occurs."""
    order = np.argsort(parts, kind="stable")
    ranked = parts[order]
    cuts = np.nonzero(np.diff(ranked))[0] + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(parts[places[0]]), places


OFFER = "part int, grp long, idx binary, tokens binary, sizes binary, counts binary"
LOOKUP = "part int, grp long, idx binary, codes binary, n binary, seeds binary, n_all long, v_all long, " + ", ".join(f"x{s} double" for s in range(STATES))


def _strings(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _hashes(tokens: pa.Array) -> np.ndarray:
    """The hashes of a group's tokens, some at a time, as hashing takes some forty bytes for each byte."""
    step = 1 << 16
    return np.concatenate([np.empty(0, dtype=np.uint64), *(aw.hashes(tokens.slice(i, step)) for i in range(0, len(tokens), step))])


def _merged(table: pa.Table) -> tuple[list[int], pa.Array, list[np.ndarray]]:
    """(rows of the chunks of a group in their order, the group's distinct tokens, where each chunk's are among them)."""
    order = np.argsort(table.column("chunk").to_numpy(), kind="stable").tolist()
    tokens, sizes, v = (table.column(c).to_pylist() for c in ("tokens", "sizes", "v"))
    each = []
    for i in order:
        own = _unpack(sizes[i], np.int32, v[i])
        each.append(_strings(_unpack(tokens[i], np.uint8, int(own.sum(dtype=np.int64))), own))
    coded = pa.concat_arrays(each).dictionary_encode()
    return order, coded.dictionary, np.split(np.asarray(coded.indices, dtype=np.int32), np.cumsum([v[i] for i in order])[:-1])


def _numbered(parts: int):
    """Functions that offer the tokens of groups by range, and that number the tokens of a range and add up their counts."""

    def offer(table: pa.Table) -> pa.Table:
        grp, counts, v = table.column("grp")[0].as_py(), table.column("counts").to_pylist(), table.column("v").to_pylist()
        order, held, places = _merged(table)
        n = np.concatenate([_unpack(counts[i], np.int32, v[i]) for i in order])
        counts, rows = np.rint(np.bincount(np.concatenate(places), weights=n, minlength=len(held))).astype(np.int64), []
        for part, at in _split_up((_hashes(held) % np.uint64(parts)).astype(np.int64)):
            own, ends = aw.contents(held.take(pa.array(at)))
            rows.append((part, grp, at.astype(np.int32).tobytes(), own.tobytes(), np.diff(ends).astype(np.int32).tobytes(), _pack(counts[at])))
        del held, own
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([_rows(rows, _wanted(OFFER))])

    def number(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        groups, idx, tokens, sizes, counts = (table.column(c).to_pylist() for c in ("grp", "idx", "tokens", "sizes", "counts"))
        coded = pa.concat_arrays([_strings(t, np.frombuffer(s, dtype=np.int32)) for t, s in zip(tokens, sizes)]).dictionary_encode()
        codes, n = np.asarray(coded.indices, dtype=np.int32), np.concatenate([_unpack(c, np.int64, len(x) // 4) for c, x in zip(counts, idx)])
        total = np.rint(np.bincount(codes, weights=n, minlength=len(coded.dictionary))).astype(np.int64)
        cuts, rows = np.cumsum([0, *(len(x) // 4 for x in idx)]), []
        for k, grp in enumerate(groups):
            own = codes[cuts[k] : cuts[k + 1]]
            rows.append((part, grp, idx[k], own.tobytes(), _pack(total[own]), None, *[None] * (2 + STATES)))
        known = np.nonzero(total)[0]
        seeds = aw.hashes(coded.dictionary.take(pa.array(known)))
        sums = _tilted(seeds, total[known].astype(np.float64)).sum(axis=0)
        rows.append((part, None, None, known.astype(np.int32).tobytes(), total[known].tobytes(), seeds.tobytes(), int(total.sum()), len(known), *sums.tolist()))
        return pa.Table.from_batches([_rows(rows, _wanted(LOOKUP))])

    return offer, number


CHUNK_ROW = ["grp", "chunk", "held_out", "doc_ids", "n", "lengths", "codes", "v"]
#: Where a chunk's tokens are among the group's; and, in one row of each group, what is known of these.
KEPT = "words binary, n_words long, place binary, counts binary, n_rare long, rare_at binary, rare_part binary, rare_code binary, seeds binary"


def _looked_up(parts: int, known):
    """A function that gives a group the places of its tokens among the frequent ones, and the numbers of all others."""

    def look_up(chunks: pa.Table, found: pa.Table) -> pa.Table:
        frequent = known.value
        order, tokens, places = _merged(chunks)
        v = len(tokens)
        part, code, n = np.zeros(v, dtype=np.int32), np.zeros(v, dtype=np.int32), np.zeros(v, dtype=np.int64)
        for x in found.to_pylist():
            at = np.frombuffer(x["idx"], dtype=np.int32)
            part[at], code[at], n[at] = x["part"], np.frombuffer(x["codes"], dtype=np.int32), _unpack(x["n"], np.int64, len(at))
        number = code.astype(np.int64) * parts + part
        place = np.full(v, -1, dtype=np.int32)
        if len(frequent):
            near = np.minimum(np.searchsorted(frequent, number), len(frequent) - 1)
            place = np.where((frequent[near] == number) & (n > 0), near, -1).astype(np.int32)
        rare = np.nonzero((place < 0) & (n > 0))[0]
        rare = rare[np.argsort(part[rare], kind="stable")]
        seeds = _hashes(tokens.take(pa.array(rare)))
        group = (v, _pack(place), _pack(n), len(rare), _pack(rare.astype(np.int32)), _pack(part[rare]), _pack(code[rare]), seeds.tobytes())
        more = _rows([(_pack(own), *(group if not k else [None] * len(group))) for k, own in enumerate(places)], _wanted(KEPT))
        del tokens
        pa.default_memory_pool().release_unused()
        kept = pa.concat_tables([chunks.slice(i, 1) for i in order]).select(CHUNK_ROW)
        return pa.Table.from_arrays([*kept.columns, *more.columns], names=[*CHUNK_ROW, *more.schema.names])

    return look_up


def _most_frequent(batches: Batches) -> Batches:
    for batch in batches:
        for part, codes, n, seeds in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "n", "seeds"))):
            codes, n, seeds = np.frombuffer(codes, dtype=np.int32), np.frombuffer(n, dtype=np.int64), np.frombuffer(seeds, dtype=np.int64)
            top = np.lexsort((seeds, -n))[:FREQUENT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(top), part, dtype=np.int32)), pa.array(codes[top]), pa.array(n[top]), pa.array(seeds[top])], names=["part", "code", "n", "seed"]
            )


# Training

SENT = "part int, grp long, codes binary, x binary"
SUMS = "part int, grp long, x binary, " + ", ".join(f"x{s} double" for s in range(STATES - 1))


def _short(x: np.ndarray) -> bytes:
    """All states' counts but the last one's: the upper five bytes of each 64-bit number, compressed byte place by byte place."""
    rounded = np.ascontiguousarray(x[:, : STATES - 1], dtype=np.float64).reshape(-1).view(np.uint64) + np.uint64(1 << 23)
    planes = np.ascontiguousarray(rounded.view(np.uint8).reshape(-1, 8)[:, 3:].T).tobytes()
    return len(rounded).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _wide(x: bytes) -> np.ndarray:
    """The numbers of _short(), by token and state."""
    n = int.from_bytes(x[:4], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 3:] = np.frombuffer(pa.decompress(x[4:], decompressed_size=5 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(5, -1).T
    return out.view(np.float64).reshape(-1, STATES - 1)


def _all_states(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts with the last state's, given the counts of the tokens."""
    return np.concatenate([x, np.maximum(n - x.sum(axis=-1), 0.0)[..., None]], axis=-1)


def _added(ranges: int):
    """A function that adds up what groups send: for key -1 start, step and likelihood; from `ranges` on frequent tokens; else a range of token numbers."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nothing = key[0].as_py(), [None] * (STATES - 1)
        total, asked = 0.0, []
        sums = np.zeros((SLICE, STATES - 1))
        for batch in batches:
            for grp, codes, x in zip(*(batch.column(c).to_pylist() for c in ("grp", "codes", "x"))):
                if part < 0:
                    total = total + np.frombuffer(x, dtype=np.float64)
                elif part >= ranges:
                    sums[np.frombuffer(codes, dtype=np.int32)] += _wide(x)
                else:
                    asked.append((grp, np.frombuffer(codes, dtype=np.int32), x))
        if part < 0:
            rows = [(part, None, total.tobytes(), *nothing)]
        elif part >= ranges:
            rows = [(part, None, sums.tobytes(), *nothing)]
        else:
            own = np.zeros((max(int(a[1].max()) for a in asked) + 1, STATES - 1))
            for _, codes, x in asked:
                own[codes] += _wide(x)  # a group has a token once
            rows = [(part, grp, _short(own[codes]), *nothing) for grp, codes, _ in asked]
            rows.append((part, None, None, *own.sum(axis=0).tolist()))
        asked.clear()
        pa.default_memory_pool().release_unused()
        yield _rows(rows, _wanted(SUMS))

    return add


class Block:
    """Some chunks of a group, all held out or none, as one, with the emissions of their tokens."""

    def __init__(self, rows: pa.Table, group: Group):
        self.doc_ids = pa.concat_arrays([c.flatten() for c in rows.column("doc_ids").chunks])
        rows = rows.select(["held_out", "n", "lengths", "codes", "v", "words", "doc_ids"])
        sizes = pc.list_value_length(rows.column("doc_ids")).to_pylist()
        rows = rows.drop_columns(["doc_ids"]).to_pylist()
        self.held_out = rows[0]["held_out"]
        self.lengths = np.concatenate([_unpack(x["lengths"], np.int32, n) for x, n in zip(rows, sizes)]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words, place = np.unique(np.concatenate([_unpack(x["words"], np.int32, x["v"]) for x in rows]), return_inverse=True)
        own = np.split(place, np.cumsum([x["v"] for x in rows])[:-1])
        self.codes = np.concatenate([p.take(_unpack(x["codes"], np.int32, x["n"])) for p, x in zip(own, rows)])
        self.emit = emission(group.counts.take(self.words, axis=0), group.totals, group.v_all)


class Group:
    """The chunks that a task works on, with the model's counts for their tokens."""

    def __init__(self, chunks: pa.Table, found: pa.Table, model: tuple):
        pa.default_memory_pool().release_unused()
        frequent, _, _, self.totals, self.v_all, first = model
        self.rows, self.grp = chunks, chunks.column("grp")[0].as_py()
        at = int(np.nonzero(chunks.column("n_words").is_valid().to_numpy())[0][0])
        x = chunks.slice(at, 1).drop_columns(["doc_ids", "codes"]).to_pylist()[0]
        self.place = _unpack(x["place"], np.int32, x["n_words"])
        self.n = _unpack(x["counts"], np.int64, x["n_words"])
        # tokens beyond the frequent ones: their places, in the order of their ranges
        self.rare, part = _unpack(x["rare_at"], np.int32, x["n_rare"]), _unpack(x["rare_part"], np.int32, x["n_rare"])
        self.code = _unpack(x["rare_code"], np.int32, x["n_rare"])
        cuts = np.nonzero(np.diff(part, prepend=-1, append=-1))[0] if len(part) else np.zeros(1, dtype=np.int64)
        self.ranges = {int(part[a]): slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())}
        self.counts = np.zeros((x["n_words"], STATES))
        there = np.nonzero(self.place >= 0)[0]
        self.counts[there] = frequent.take(self.place[there], axis=0)
        if first:
            self.counts[self.rare] = _tilted(np.frombuffer(x["seeds"], dtype=np.uint64), self.n[self.rare].astype(np.float64))
        for part, x in zip(*(found.column(c).to_pylist() for c in ("part", "x"))):
            at = self.rare[self.ranges[part]]
            self.counts[at] = _all_states(_wide(x), self.n[at])

    def blocks(self, held_out: bool) -> Iterator[Block]:
        """The chunks of one kind, in blocks of about BLOCK_TOKENS tokens; a chunk is never cut."""
        kinds, sizes = (self.rows.column(c).to_pylist() for c in ("held_out", "n"))
        own, total = [], 0
        for i in [i for i, kind in enumerate(kinds) if kind == held_out]:
            if own and total + sizes[i] > BLOCK_TOKENS:
                yield Block(pa.concat_tables(own), self)
                own, total = [], 0
                pa.default_memory_pool().release_unused()
            own.append(self.rows.slice(i, 1))
            total += sizes[i]
        if own:
            yield Block(pa.concat_tables(own), self)


class Model:
    """The chunks, and the expected counts: of frequent tokens here, of all others as a table that has them by group."""

    def __init__(self, docs: DataFrame, tables: Tables):
        self.spark, self.tables, self.counts = docs.sparkSession, tables, None
        groups = _groups(docs)
        chunks, n_chunks = tables.buckets(_chunks(docs, groups).repartition(len(groups), "grp"), len(groups), "grp", **LARGE)
        tables.release()
        self.ranges = max(1, -(-n_chunks * DISTINCT // RANGE))
        offer, number = _numbered(self.ranges)
        offers = chunks.select("grp", "chunk", "v", "tokens", "sizes", "counts").groupBy("grp").applyInArrow(offer, OFFER)
        found, _ = tables.write(offers.groupBy("part").applyInArrow(number, LOOKUP))
        tables.release()

        words = found.filter("grp IS NULL")
        all_ = words.agg(F.sum("n_all"), F.sum("v_all"), *[F.sum(f"x{s}") for s in range(STATES)]).first()
        self.n_all, self.v_all, self.totals = int(all_[0] or 0), int(all_[1] or 0), np.array([x or 0.0 for x in all_[2:]])
        top = words.select("part", "codes", "n", "seeds").mapInArrow(_most_frequent, "part int, code int, n long, seed long")
        top = top.orderBy(F.desc("n"), "seed", "part", "code").limit(FREQUENT).toArrow()
        part, code, n, seed = (top.column(c).to_numpy().astype(np.int64) for c in ("part", "code", "n", "seed"))
        number = code * self.ranges + part
        order = np.argsort(number)
        self.n = n[order].astype(np.float64)
        self.frequent = _tilted(seed[order].view(np.uint64), self.n)
        self.start, self.step = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(self.step, 0.95)

        known = self.spark.sparkContext.broadcast(number[order])
        own = found.filter("grp IS NOT NULL").select("grp", "part", "idx", "codes", "n")
        kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in CHUNK_ROW)
        looked_up = chunks.drop("counts").groupBy("grp").cogroup(own.groupBy("grp")).applyInArrow(_looked_up(self.ranges, known), f"{schema}, {KEPT}")
        self.chunks, _ = tables.buckets(looked_up, len(groups), "grp", **LARGE)
        known.unpersist()
        tables.drop(chunks)
        tables.drop(found)
        tables.release()

    def model(self) -> tuple:
        return self.frequent, self.start, self.step, self.totals, self.v_all, self.counts is None

    def by_group(self, function, schema: str) -> DataFrame:
        """`function` of the chunks of each group and the expected counts of their tokens beyond the frequent ones, which are none before the first round."""
        if self.counts is None:
            chunks, found = self.chunks, self.spark.createDataFrame([], SUMS)
        else:
            chunks, found = self.chunks.drop("seeds"), self.counts.filter("grp IS NOT NULL")
        return chunks.groupBy("grp").cogroup(found.select("grp", "part", "x").groupBy("grp")).applyInArrow(function, schema)

    def round(self) -> float:
        """One round of Baum-Welch over all training texts; gives the log10 likelihood before it."""
        held, ranges = self.spark.sparkContext.broadcast(self.model()), self.ranges

        def count(chunks: pa.Table, found: pa.Table) -> pa.Table:
            model = held.value
            start, step = model[1], model[2]
            group, ends, steps, likelihood = Group(chunks, found, model), np.zeros(STATES), np.zeros((STATES, STATES)), 0.0
            counts = np.zeros(group.counts.shape)
            for block in group.blocks(False):
                own = np.zeros(block.emit.shape)
                likelihood += expected(block.codes, block.starts, block.lengths, (start, step, block.emit), (ends, steps, own))
                counts[block.words] += own
            rows = [(part, group.grp, group.code[at].tobytes(), _short(counts[group.rare[at]])) for part, at in group.ranges.items()]
            rows.append((-1, None, None, np.concatenate([ends, steps.ravel(), [likelihood]]).tobytes()))
            met = np.nonzero(group.place >= 0)[0]
            for piece, at in _split_up(group.place[met] // SLICE):
                rows.append((ranges + piece, None, (group.place[met[at]] % SLICE).astype(np.int32).tobytes(), _short(counts[met[at]])))
            return pa.Table.from_batches([_rows(rows, _wanted(SENT))])

        sent = self.by_group(count, SENT)
        counts, _ = self.tables.write(sent.groupBy("part").applyInArrow(_added(ranges), SUMS), **LARGE)
        if self.counts is not None:
            self.tables.drop(self.counts)
        self.counts = counts
        got = counts.filter("grp IS NULL AND x IS NOT NULL").select("part", "x").collect()  # one row for SLICE frequent tokens
        rare = np.array([v or 0.0 for v in counts.agg(*[F.sum(f"x{s}") for s in range(STATES - 1)]).first()])
        sums = {r["part"]: np.frombuffer(r["x"], dtype=np.float64) for r in got}
        frequent = np.zeros((-(-len(self.n) // SLICE) * SLICE, STATES - 1))
        for part, x in sums.items():
            if part >= 0:
                frequent[(part - ranges) * SLICE : (part - ranges + 1) * SLICE] = x.reshape(-1, STATES - 1)
        self.frequent = _all_states(frequent[: len(self.n)], self.n)
        self.totals = self.frequent.sum(axis=0) + _all_states(rare, np.array(self.n_all - self.n.sum()))
        start, step = sums[-1][:STATES] + 1e-3, sums[-1][STATES:-1].reshape(STATES, STATES) + 1e-3
        self.start, self.step = start / start.sum(), step / step.sum(axis=1, keepdims=True)
        held.unpersist()
        return float(sums[-1][-1])

    def train(self, rounds: int | None) -> list[float]:
        """Rounds until one gains too little, or `rounds` of them; gives the log10 likelihoods before each."""
        gone: list[float] = []
        while (rounds is None or len(gone) < rounds) and not (len(gone) > 1 and gone[-1] - gone[-2] < GAIN * abs(gone[-2])):
            gone.append(self.round())
            self.tables.release()
        return gone


def score(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; `rounds`: a fixed number of them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Tables(docs.sparkSession, "lm") as tables:
        trained = Model(docs, tables)
        if trained.n_all:
            trained.train(rounds)
        held, n_all, base_size = docs.sparkSession.sparkContext.broadcast(trained.model()), trained.n_all, trained.n_all + trained.v_all + 1

        def judge(chunks: pa.Table, found: pa.Table) -> pa.Table:
            model, out = held.value, []
            group = Group(chunks, found, model)
            for block in (b for kind in (False, True) for b in group.blocks(kind)):
                n, size = group.n[block.words], len(block.lengths)
                add = lambda x: np.add.reduceat(x[block.codes], block.starts)  # noqa: B023, E731
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            block.doc_ids, pa.array(np.full(size, block.held_out)), pa.array(block.lengths),
                            pa.array(add((n > 0).astype(np.int64))), pa.array(np.full(size, n_all)),
                            pa.array(add(np.log10((n + 1) / base_size))), pa.array(forward(block.codes, block.starts, block.lengths, (model[1], model[2], block.emit))),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                )
            return pa.Table.from_batches(out)

        return settle(
            trained.by_group(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        )
