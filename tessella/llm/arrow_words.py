"""Words of a batch of texts as Arrow and numpy arrays, for operators that work on batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm.common import SHINGLE

#: Characters of text that are worked on at once.
PIECE = 8_000_000
BASE = np.uint64(0xD6E8FEB86659FD93)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of `column`; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the code of each word in text order, offsets of each text's words). A null text has no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = parts.values, np.asarray(parts.offsets, dtype=np.int64)
    values, offsets = values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]
    there = np.asarray(pc.greater(pc.binary_length(values), 0))
    if not there.all():
        offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
        values = values.filter(pa.array(there))
    coded = values.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), offsets


def contents(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of an array of strings, offsets of each)."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    if not len(strings) or data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(strings) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, dtype=np.uint64))])


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process: its bytes as a polynomial, scrambled."""
    data, offsets = contents(strings)
    starts, sizes = offsets[:-1], np.diff(offsets)
    total = np.zeros(len(strings), dtype=np.uint64)
    there = np.nonzero(sizes)[0]
    near = _powers(4096, BASE)
    far = _powers(int(sizes.max(initial=0)) // 4096 + 1, np.uint64(pow(int(BASE), 4096, 1 << 64)))
    for a in range(0, len(data), PIECE // 2):
        b = min(len(data), a + PIECE // 2)
        part = there[np.searchsorted(offsets[there + 1], a, side="right") : np.searchsorted(starts[there], b)]
        begins, ends = np.maximum(starts[part], a), np.minimum(offsets[part + 1], b)
        place = np.arange(a, b) - np.repeat(starts[part], ends - begins)
        weight = near[place] if len(far) == 1 else near[place % 4096] * far[place // 4096]
        total[part] += np.add.reduceat((data[a:b].astype(np.uint64) + np.uint64(1)) * weight, begins - a)
    return mixed(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of every window of `size` words, in text order."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = mixed(total + word_hashes[k : k + n] + np.uint64(k + 1))
    return total


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number mixed in, so that each is different from all others of its text."""
    if len(shingles) < 2:
        return shingles
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return shingles
    run = np.arange(len(ranked))
    number = np.empty(len(ranked), dtype=np.uint64)
    number[order] = run - np.maximum.accumulate(np.where(new, run, 0))
    return np.where(number > 0, mixed(shingles + number * np.uint64(0x9E3779B97F4A7C15)), shingles)
