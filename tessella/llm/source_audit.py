"""Source divergence audit: how far the term shares of the sources of a language are apart, and which terms set a source off.

Sort-based streaming. Tasks count terms document by document and merge what they counted, so that a term leaves a task once for each
source; rows are dealt by (lang, term) and sorted by (lang, term, source, document). A scan of the runs gives document frequency and
counts of the terms that enough documents of the language have. The kept runs, with their groups' totals joined, are dealt and sorted
once more, and a second scan emits partial sums for pairs of sources and candidate terms.

A pair (s, t) sums f over all kept terms, also those that only one source has or neither. With p0 for the share of an absent term,
    f(s, t) = f(p0s, p0t) + [f(s, p0t) - f(p0s, p0t)] + [f(p0s, t) - f(p0s, p0t)] + [f(s, t) - f(s, p0t) - f(p0s, t) + f(p0s, p0t)]:
the first part is one number for each pair, the next two follow from how many terms of a source have which count, and only the last
needs terms that both have, so only those are paired. All of it is whole numbers.

The most frequent term sends one row for each task and source, so no key outgrows the others. Pairs of sources are the result itself.

Edges: every row is a document of its own, also rows of one id or none. A null text, language or source counts as ''. A language
without kept terms, and an empty text, still have their pairs, with value 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import arrow_words
from tessella.llm.common import settle

#: Documents of a language that a kept term stands in, at least; the parts of a share; terms reported for each source.
MIN_DOCUMENTS, PARTS, TOP = 10, 1_000_000_000, 10
#: Rows that a task gathers before it merges them.
GATHERED = 1_000_000

#: A text's bytes as those of its terms: letters, A-Z lower-cased, and all that is not ASCII; the rest parts terms.
_FOLDED = np.full(256, 32, dtype=np.uint8)
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)

COUNTS = "lang string, term string, source string, document long, n_docs long, n long"
KEPT = "lang string, term string, source string, n long, first int"
FOUND = "lang string, source string, item string, pair boolean, value long"


class _Merged:
    """Rows with sums, merged by key whenever they become many; what stays many is handed out."""

    def __init__(self, keys: list[str], sums: dict[str, str], limit: int):
        self.keys, self.sums, self.limit, self.held, self.n = keys, sums, limit, [], 0

    def _merge(self) -> pa.Table:
        table = pa.concat_tables(self.held).group_by(self.keys).aggregate(list(self.sums.items()))
        return table.rename_columns([n.removesuffix(f"_{self.sums.get(n.rpartition('_')[0], '?')}") for n in table.column_names])

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        self.held.append(table)
        self.n += table.num_rows
        if self.n > self.limit:
            self.held = [self._merge()]
            self.n = self.held[0].num_rows
            if self.n > self.limit // 2:
                yield from self.rest(merge=False)

    def rest(self, merge: bool = True) -> Iterator[pa.Table]:
        if self.n:
            yield self._merge() if merge else self.held[0]
        self.held, self.n = [], 0


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.select(schema.names).cast(schema).combine_chunks().to_batches(max_chunksize=50_000)


def _folded(texts: pa.Array) -> pa.Array:
    data, offsets = arrow_words.contents(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_FOLDED[data]))


def _sums_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, how often each occurs, the sum of its weights)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, dtype=np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys))), np.add.reduceat(weights[order], starts) if len(keys) else weights


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("n_docs", pa.int64()), ("n", pa.int64())])
    merged, seen = _Merged(["lang", "term", "source"], {"document": "min", "n_docs": "sum", "n": "sum"}, GATHERED), TaskContext.get().partitionId() << 33
    for batch in batches:
        for piece in arrow_words.pieces(batch, "text"):
            lang, source = (pc.fill_null(piece.column(c), "").dictionary_encode() for c in ("lang", "source"))
            group = np.asarray(lang.indices, dtype=np.int64) * len(source.dictionary) + np.asarray(source.indices, dtype=np.int64)
            terms, code, offsets = arrow_words.split(_folded(pc.fill_null(piece.column("text"), "")))
            if len(terms):
                doc = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
                own, times, _ = _sums_by(doc * len(terms) + code, code)
                doc, code = own // len(terms), own % len(terms)
                own, docs, times = _sums_by(group[doc] * len(terms) + code, times)
                group, code = own // len(terms), own % len(terms)
                part = {"lang": lang.dictionary.take(pa.array(group // len(source.dictionary))), "term": terms.take(pa.array(code)).cast(pa.string())}
                part |= {"source": source.dictionary.take(pa.array(group % len(source.dictionary))), "document": np.full(len(own), seen), "n_docs": docs, "n": times}
                for table in merged.add(pa.table(part)):
                    yield from _batches(table, schema)
            seen += piece.num_rows
    for table in merged.rest():
        yield from _batches(table, schema)


def _changes(table: pa.Table, *names: str) -> np.ndarray:
    """Whether a row differs from the one above it in one of the columns; the first row does."""
    out = np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for n in names:
        c = table.column(n).combine_chunks()
        out[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return out


def _runs(batches: Iterator[pa.RecordBatch], merge) -> Iterator[pa.Table]:
    """Tables that hold whole runs of (lang, term); `merge` shortens what is held of a run that goes on."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = np.nonzero(_changes(table, "lang", "term"))[0]
        if len(starts):
            if starts[-1]:
                yield table.slice(0, starts[-1])
            held = merge(table.slice(starts[-1]))
    if held is not None:
        yield held


def _by_source(table: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) of a sorted table."""
    starts = np.nonzero(_changes(table, "lang", "term", "source"))[0]
    out = table.take(pa.array(starts))
    for c in ("n_docs", "n"):
        out = out.set_column(out.column_names.index(c), c, pa.array(np.add.reduceat(table.column(c).to_numpy(), starts)))
    return out


def _keep(min_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("first", pa.int32())])
        for table in _runs(batches, _by_source):
            table = _by_source(table)
            new = _changes(table, "lang", "term")
            starts = np.nonzero(new)[0]
            docs = np.add.reduceat(table.column("n_docs").to_numpy(), starts)
            kept = np.repeat(docs >= min_documents, np.diff(np.append(starts, len(new))))
            table = table.append_column("first", pa.array(new.astype(np.int32))).filter(pa.array(kept))
            yield from _batches(table, schema)

    return run


def _shares(n: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    if len(n) and int(n.max()) + 2 > (1 << 62) // PARTS:  # beyond 64 bits: Python's whole numbers
        n = n.astype(object)
    return (1 + (n + 2) * PARTS // (total + 2 * kept)).astype(np.int64)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _strings(table: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    coded = table.column(name).combine_chunks().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("pair", pa.bool_()), ("value", pa.int64())])
    pairs, best = _Merged(["lang", "source", "item", "pair"], {"value": "sum"}, GATHERED), None
    for table in _runs(batches, lambda t: t):  # a run has a row for each source of the language
        term = np.cumsum(_changes(table, "lang", "term")) - 1
        starts = np.nonzero(np.diff(term, prepend=-1))[0]
        n, total, kept, lang_total = (table.column(c).to_numpy() for c in ("n", "total", "kept", "lang_total"))
        (langs, lang), (sources, source) = _strings(table, "lang"), _strings(table, "source")
        p, p0 = _shares(n, total, kept), _shares(np.zeros_like(n), total, kept)
        # terms that a source has more of than its language
        q = _shares(np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(n)))), lang_total, kept)
        over = np.nonzero(p > q)[0]
        some = table.select(["lang", "source", "term"]).take(pa.array(over)).append_column("value", pa.array(_apart(p[over], q[over])))
        best = _first(some if best is None else pa.concat_tables([best, some]))
        if best.num_rows > GATHERED:
            yield from _batches(_as_terms(best), schema)
            best = None
        # pairs of sources that have the term
        found = []
        for step in range(1, int(np.diff(np.append(starts, len(n))).max())):
            i = np.nonzero(term[step:] == term[:-step])[0]
            j = i + step
            value = _apart(p[i], p[j]) - _apart(p[i], p0[j]) - _apart(p0[i], p[j]) + _apart(p0[i], p0[j])
            found.append(_sums_by((lang[i] * len(sources) + source[i]) * len(sources) + source[j], value))
        if found:
            key, _, value = _sums_by(np.concatenate([k for k, _, _ in found]), np.concatenate([v for _, _, v in found]))
            part = {"lang": langs.take(pa.array(key // len(sources) ** 2)), "source": sources.take(pa.array(key // len(sources) % len(sources)))}
            for out in pairs.add(pa.table(part | {"item": sources.take(pa.array(key % len(sources))), "pair": np.ones(len(key), dtype=bool), "value": value})):
                yield from _batches(out, schema)
    for out in pairs.rest():
        yield from _batches(out, schema)
    if best is not None:
        yield from _batches(_as_terms(best), schema)


def _first(table: pa.Table) -> pa.Table:
    """The TOP terms of each (lang, source), by value; rows come in the order of their terms, so that equal values keep it."""
    (_, lang), (sources, source) = _strings(table, "lang"), _strings(table, "source")
    group = lang * max(1, len(sources)) + source
    order = np.lexsort((-table.column("value").to_numpy(), group))
    ranked = group[order]
    begins = np.searchsorted(ranked, ranked)
    return table.take(pa.array(np.sort(order[np.arange(len(order)) - begins < TOP]))).combine_chunks()


def _as_terms(table: pa.Table) -> pa.Table:
    return table.rename_columns(["lang", "source", "item", "value"]).append_column("pair", pa.array(np.zeros(table.num_rows, dtype=bool)))


def share(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(PARTS * (n + 2) / (total + 2 * kept)), exactly."""
    whole = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", (whole(F.lit(n) if isinstance(n, int) else F.col(n)) + 2) * F.lit(PARTS), whole(F.col(total) + 2 * F.col(kept)))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n, first) of the terms that at least `min_documents` documents of the language have; `first` marks one
    row of each term of a language."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, COUNTS)
    dealt = counted.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(_keep(min_documents), KEPT)


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language with the distance of their term
    shares. Part `term`: the TOP terms that the source has a greater share of than its language."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    kept = settle(term_counts(docs, min_documents))
    groups = docs.select(blank("lang"), blank("source")).distinct()
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    totals = settle(totals)

    scanned = kept.join(totals, ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    scanned = settle(scanned.select("lang", "term", "source", "n", "total", "kept", "lang_total").mapInArrow(_scan, FOUND))

    # what pairs of sources have apart from the terms of both
    other = totals.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    absent, item_absent = share(0, "total", "kept"), share(0, "item_total", "kept")
    base = F.when(F.col("kept") > 0, F.col("kept") * apart(absent, item_absent)).otherwise(F.lit(0).cast("long"))
    neither = totals.join(other, "lang").filter("source < item").select("lang", "source", "item", base.alias("value"))
    often = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(totals, ["lang", "source"])
    alone = F.col("times") * (apart(share("n", "total", "kept"), item_absent) - apart(absent, item_absent))
    one = often.join(other, "lang").filter("source <> item").select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), alone.alias("value"))
    both = scanned.filter("pair").select("lang", "source", "item", "value")
    pairs = neither.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", sides.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = scanned.filter("NOT pair").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).filter(F.col("rank") <= TOP))
