"""Token counts of whole texts under a public byte-level BPE vocabulary: map-side two-tier lookup of pre-token lengths.

A text is cut in front of every single space that a visible character follows. The vocabulary's own pre-tokenizer always ends
a pre-token there, so the pieces are counted independently. Tier one is a broadcast table of `FREQUENT` pieces of at most `SHORT`
bytes, about the most frequent ones, with their token counts; its size is fixed. Tier two is a cache in the worker: a piece is
encoded when it is first met. Pieces of more than `SHORT` bytes, as texts without spaces are, are encoded each time and kept
nowhere. Pieces are never shuffled; only bounded lists of frequent pieces leave a task when tier one is built.

Texts where white space other than single spaces adjoins a space, or that hold a special token's string, are encoded whole.

Nulls and edges: a null text is an empty one, 0 bytes and 0 tokens. Every row gives one row; other columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrow_words as aw

LIMIT = 1024
FREQUENT = 65_536
#: Pieces that a task names when tier one is built, and that a worker's cache holds before it starts anew.
NAMED = 2_048
CACHED = 500_000
#: Bytes of the longest piece that is broadcast or cached.
SHORT = 64
#: White space as Unicode has it; a space next to any of it is irregular.
WHITE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
IRREGULAR = f" [{WHITE}]|[{WHITE}] | $"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def irregular(texts: pa.Array, specials: list[str]) -> np.ndarray:
    """Texts that must be encoded whole."""
    found = pc.match_substring_regex(texts, IRREGULAR)
    for s in specials:
        found = pc.or_(found, pc.match_substring(texts, s))
    return np.asarray(found)


def regular_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, codes, offsets) of texts that are not irregular. All pieces but a text's first stand after a space,
    and carry it; an empty text has one empty piece."""
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    values = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    n = len(coded.dictionary)
    spaced = pc.binary_join_element_wise("", coded.dictionary, " ")
    # a text's first piece has no space before it
    firsts = offsets[:-1][np.diff(offsets) > 0]
    bare, at = np.unique(codes[firsts], return_inverse=True)
    codes[firsts] = n + at
    return pa.concat_arrays([spaced.cast(pa.string()), coded.dictionary.take(pa.array(bare)).cast(pa.string())]), codes, offsets


def _texts(piece: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(piece.column("text"), "").cast(pa.string())


def frequent_pieces(docs: DataFrame, path: str, limit: int = FREQUENT) -> list[str]:
    """The most frequent pieces: each task names its NAMED most frequent, their counts are added up over all of `docs`."""
    specials = _specials(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for piece in aw.pieces(batch, "text"):
                texts = _texts(piece)
                distinct, codes, _ = regular_pieces(texts.filter(pa.array(~irregular(texts, specials))))
                n = np.bincount(codes, minlength=len(distinct)) * (np.asarray(pc.binary_length(distinct)) <= SHORT)
                top = np.argsort(-n, kind="stable")[:NAMED]
                top = top[n[top] > 0]
                for token, k in zip(distinct.take(pa.array(top)).to_pylist(), n[top].tolist()):
                    total[token] = total.get(token, 0) + k
        top = sorted(total, key=lambda x: (-total[x], x))[:NAMED]
        yield pa.RecordBatch.from_arrays([pa.array(top, type=pa.string()), pa.array([total[x] for x in top], type=pa.int64())], names=["piece", "n"])

    named = docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r[0] for r in named.orderBy(F.desc("n"), "piece").limit(limit).collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    specials = _specials(path)
    top = frequent_pieces(docs, path)
    lengths = [len(e) for e in _tokenizer(path).encode_batch(top, add_special_tokens=False)] if top else []
    table = docs.sparkSession.sparkContext.broadcast((pa.array(top, type=pa.string()), np.array(lengths, dtype=np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier1, known = table.value
        tokenizer, cache = None, {}
        for batch in batches:
            for piece in aw.pieces(batch, "text"):
                texts = _texts(piece)
                odd = irregular(texts, specials)
                distinct, codes, offsets = regular_pieces(texts.filter(pa.array(~odd)))
                place = pc.index_in(distinct, value_set=tier1)
                hit = np.asarray(place.is_valid())
                length = np.zeros(len(distinct), dtype=np.int64)
                length[hit] = known[np.asarray(place.drop_null())]
                long = np.asarray(pc.binary_length(distinct)) > SHORT
                missed = np.nonzero(~hit & ~long)[0]
                strings = distinct.take(pa.array(missed)).to_pylist()
                new = [s for s in strings if s not in cache]
                if tokenizer is None and (new or odd.any() or long.any()):
                    tokenizer = _tokenizer(path)
                if new:
                    if len(cache) + len(new) > CACHED:
                        cache.clear()
                        new = strings
                    for start in range(0, len(new), 10_000):
                        part = new[start : start + 10_000]
                        cache.update(zip(part, (len(e) for e in tokenizer.encode_batch(part, add_special_tokens=False))))
                length[missed] = [cache[s] for s in strings]
                for i in np.nonzero(long)[0].tolist():
                    length[i] = len(tokenizer.encode(distinct[i].as_py(), add_special_tokens=False))
                n = np.zeros(len(texts), dtype=np.int64)
                if len(offsets) > 1:
                    n[~odd] = np.add.reduceat(length[codes], offsets[:-1])
                for i in np.nonzero(odd)[0].tolist():
                    n[i] = len(tokenizer.encode(texts[i].as_py(), add_special_tokens=False))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
