"""Near duplicates by Order MinHash: sketches of ordered, occurrence-labelled shingles, candidates by bands, banded alignment.

A sketch samples, for one random order of all shingles, the two least occurrence-labelled five-word shingles of a text and
keeps them in text order, so it agrees for texts that are close in edits and not merely in content. Two sketches make a band;
texts that agree in a band are candidates.

Similarity is that of an alignment: with L the longest common subsequence of the two texts' labelled shingles within a band
around the diagonal, L / (n1 + n2 - L). It is 0.8 or more for near duplicates. As no labelled shingle repeats in a text, the
subsequence is the longest increasing run of matched places, found in n log n.

Equal texts are one vertex: texts are known by a 128-bit digest, whatever the ids of their rows. Groups of any size are handled
without listing their pairs. Each band's bucket first links its members to its most central one, the member that meets most
others in all its buckets, and connected components are formed. What remains are buckets whose members are in several
components. Their members outside of the bucket's largest component are held against all of the bucket in blocks: sketches
and bin signatures, which estimate the similarity to a few hundredths, rule out most pairs, the others are aligned where they
stand, and a block sends only the links that join components. A first pass takes each text in its largest bucket and there in
one block, which joins most of a large group; a second takes all pairs that are then still in different components, each in
the first band that the pair shares. So every pair that shares a band ends up in one class, or has been compared.

Nulls and edges: texts of fewer than five words have no shingles, and are duplicates only if they are equal, as are empty
texts; null texts are in no class (class_id is their own id, `kept` is true). The class is named by its least id that is not
null, and is null where it has none; where an id repeats with different texts, classes may share a name. Ids may be of any type that can be ordered, and may repeat: rows of one id belong to the
classes of their own texts. The row of the least (id, digest) of a class is kept, ids that are null last; rows equal in id and
text are interchangeable, `kept` is true for all of them, and keep_one() leaves one. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrow_words as aw
from tessella.llm.common import SIMILAR, Tables, fresh, settle

BANDS, ROWS_A_BAND = 16, 2
SKETCHES = BANDS * ROWS_A_BAND
#: Bins of a signature, and the least estimate at which a pair is aligned: four standard errors below the threshold.
BINS = 1024
ESTIMATE = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / BINS) ** 0.5
#: Similar texts agree in a sketch with a chance of SIMILAR ** 2 at least; below this number of agreements it is one in 10^5.
AGREE = 9
#: Texts, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
MULTIPLIERS = aw.mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit number for each random order: the two least shingles, in the order in which they stand in the text."""
    if len(shingles) == 1:
        return aw.mixed(shingles * MULTIPLIERS).astype(np.uint32)
    least, places = np.empty((SKETCHES, 0), dtype=np.uint64), np.empty((SKETCHES, 0), dtype=np.int64)
    for start in range(0, len(shingles), 4096):
        part = shingles[None, start : start + 4096] * MULTIPLIERS[:, None]
        for _ in range(2 if part.shape[1] > 1 else 1):
            at = part.argmin(axis=1)[:, None]
            least = np.concatenate([least, np.take_along_axis(part, at, 1)], axis=1)
            places = np.concatenate([places, at + start], axis=1)
            np.put_along_axis(part, at, LAST, 1)
    two = np.argsort(least, axis=1, kind="stable")[:, :2]
    two = np.take_along_axis(two, np.argsort(np.take_along_axis(places, two, 1), axis=1), 1)
    first, second = np.take_along_axis(least, two, 1).T
    return aw.mixed(aw.mixed(first) + second).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """A byte for each bin: of the least shingle that falls into it, 1 to 255; 0 for an empty bin."""
    out = np.zeros(BINS, dtype=np.uint8)
    ordered = np.sort(shingles)[::-1].astype(np.uint64)  # the least of a bin is written last
    scrambled = aw.mixed(ordered)
    out[(scrambled % np.uint64(BINS)).astype(np.int64)] = (scrambled >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in aw.pieces(batch, "text", aw.PIECE // 4):
            distinct, codes, offsets = aw.split(piece.column("text"))
            word_hashes = aw.hashes(distinct)[codes] if len(codes) else np.empty(0, dtype=np.uint64)
            windows = aw.shingle_hashes(word_hashes)
            found, kept, sizes = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                s = aw.labelled(windows[a : max(a, b - aw.SHINGLE + 1)])
                found.append(sketch(s).tobytes() if len(s) else None)
                kept.append(s.astype(np.uint32).tobytes() if len(s) else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(sizes, pa.int32()), pa.array(found, pa.binary()), pa.array(kept, pa.binary())],
                names=["row", "doc_id", "text_key", "size", "sketch", "shingles"],
            )


def text_key(text: Column) -> Column:
    """A 128-bit digest of the text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, size, sketch, shingles) of every row with a text, numbered; sketch and shingles (32-bit numbers, in text order) are null for texts without shingles."""
    rows = docs.filter(F.col("text").isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sketches, f"row long, doc_id {kind}, text_key binary, size int, sketch binary, shingles binary")


def increasing(places: np.ndarray) -> int:
    """Length of the longest strictly increasing subsequence."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tops: list[int] = []
    for p in places.tolist():
        i = bisect_left(tops, p)
        tops[i : i + 1] = [p]
    return len(tops)


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILAR) -> float:
    """Similarity of two texts' labelled shingles by alignment within the band that `threshold` allows."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    at = np.minimum(np.searchsorted(ranked, b), len(a) - 1)
    j = np.nonzero(ranked[at] == b)[0]
    if len(j) < threshold * (n - len(j)):
        return 0.0
    i = order[at[j]]
    band = n * (1 - threshold) / (1 + threshold)  # more unmatched shingles than this, and the similarity is too low
    length = increasing(i[np.abs(i - j) <= band])
    return length / (n - length)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint32)


def _aligned_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = batch.column("shingles_a"), batch.column("shingles_b")
        good = [aligned(_numbers(x.as_buffer()), _numbers(y.as_buffer())) >= SIMILAR for x, y in zip(one, other)]
        mask = pa.array(good, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def align(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose `texts` (key, shingles) are similar."""
    left = pairs.join(texts, F.col("a") == F.col("key")).select("a", "b", F.col("shingles").alias("shingles_a"))
    both = left.join(texts, F.col("b") == F.col("key")).select("a", "b", "shingles_a", F.col("shingles").alias("shingles_b"))
    return both.mapInArrow(_aligned_pairs, "a binary, b binary")


def components(edges: DataFrame, tables: Tables) -> DataFrame | None:
    """(v, c) for every vertex of `edges` (a, b): c is the least vertex connected with it. None if there are no edges.

    Each round every vertex moves to the least vertex around it, and edges move along, so that the graph shrinks; vertices are
    digests, in random order, so this takes a number of rounds that grows with the logarithm of the size. A round writes two
    tables, and a lost executor costs part of one.
    """
    edges, n = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    moves = []
    while n:
        around = edges.union(edges.select("b", "a"))
        move, _ = tables.write(around.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p")))
        moves.append(move)
        to_a, to_b = move.toDF("va", "pa"), move.toDF("vb", "pb")
        moved = edges.join(to_a, F.col("a") == F.col("va")).select("pa", "b").join(to_b, F.col("b") == F.col("vb"))
        moved = moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).filter("a <> b").distinct()
        edges, n = tables.write(moved)
    if not moves:
        return None
    out = moves[-1].toDF("v", "c")
    for move in moves[-2::-1]:
        out = move.join(out.toDF("next", "c"), F.col("p") == F.col("next"), "left").select("v", F.coalesce("c", "p").alias("c"))
    return tables.write(out)[0]


def relabel(parts: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """The components `parts` (key, c) after further `edges` (a, b) between components."""
    found = components(edges, tables)
    if found is None:
        return parts
    moved = parts.join(found.toDF("v", "to"), F.col("c") == F.col("v"), "left")
    return tables.write(moved.select("key", F.coalesce("to", "c").alias("c")))[0]


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, band, key, size) for the bands of every sketch."""
    width = 8 * ROWS_A_BAND  # hexadecimal digits
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.hex("sketch"), i * width + 1, F.lit(width))),
    )
    return reps.select("key", "size", F.posexplode(numbers).alias("band", "bucket"))


def _shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimates of the similarity of the signature x to the signatures y."""
    def total(same: np.ndarray) -> np.ndarray:
        lanes = same.view(np.uint64).reshape(len(same), -1, 64).sum(axis=2)  # bytes up to 64 each
        halves = (lanes & np.uint64(0x00FF00FF00FF00FF)) + ((lanes >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))
        return ((halves * np.uint64(0x0001000100010001)) >> np.uint64(48)).sum(axis=1).astype(np.int64)

    neither = total((y | x) == 0)
    return (total(y == x) - neither) / np.maximum(BINS - neither, 1)


def block_links(rows: pd.DataFrame, every_pair: bool) -> pd.DataFrame:
    """Links (a, b) between components that similar texts of one block and another (or itself) make; never two that say the same.

    With `every_pair` false, pairs that share an earlier band are compared too.
    """
    one, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
    out: list[tuple[bytes, bytes]] = []
    if len(one) and len(other):
        names = sorted({*one["c"], *other["c"]})
        parent, number = list(range(len(names))), {c: i for i, c in enumerate(names)}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        unpack = lambda side: np.frombuffer(b"".join(side["sketch"]), dtype=np.uint32).reshape(len(side), -1)
        x, y, band = unpack(one), unpack(other), int(rows["band"].iloc[0])
        pair = lambda z: np.ascontiguousarray(z).view(np.uint64)  # a band is two sketches
        bands_x, bands_y = pair(x), pair(y)
        comps = np.array([number[c] for c in other["c"]])
        ours, theirs = list(map(_numbers, one["shingles"])), list(map(_numbers, other["shingles"]))
        sizes, signed = np.array([len(s) for s in theirs]), None
        for k, (row, bands, mine, c) in enumerate(zip(x, bands_x, ours, one["c"])):
            c, n = number[c], len(mine)
            fits = (np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n)) & (comps != c)
            hit = np.nonzero(fits & ((y == row).sum(axis=1) >= AGREE))[0]
            if every_pair and band and len(hit):
                hit = hit[(bands_y[hit, :band] != bands[:band]).all(axis=1)]  # no earlier band is shared
            if not len(hit):
                continue
            if signed is None:
                signed = np.stack([signature(s) for s in theirs])
            share = _shares(signature(mine), signed[hit])
            order = np.argsort(-share, kind="stable")
            for j in hit[order[share[order] >= ESTIMATE]].tolist():
                p, q = root(c), root(int(comps[j]))
                if p != q and aligned(mine, theirs[j]) >= SIMILAR:
                    parent[max(p, q)] = min(p, q)
                    out.append((names[c], names[comps[j]]))
    return pd.DataFrame(out, columns=["a", "b"])


def across(members: DataFrame, every_pair: bool) -> DataFrame:
    """Links (a, b) between components within buckets.

    `members`: bucket, band, key, c, main (the bucket's largest component), blocks (of all its texts), outer (of those outside
    of the main component), sketch, shingles. Of two texts in different components one is outside the main one, so those are
    held against all. Both are dealt into blocks of about BLOCK texts; each pair of blocks is one group, so no task sees a
    whole bucket. With `every_pair` false a text meets the one block that it falls into itself.
    """
    wanted = ["bucket", "band", "c", "sketch", "shingles"]
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    outside = members.filter("c <> main")
    if every_pair:
        outside = outside.select(*wanted, block("outer").alias("x"), every("blocks").alias("y"), F.lit(0).alias("side"))
        rows = members.select(*wanted, every("outer").alias("x"), block("blocks").alias("y"), F.lit(1).alias("side"))
    else:
        outside = outside.select(*wanted, block("blocks").alias("x"), block("blocks").alias("y"), F.lit(0).alias("side"))
        rows = members.select(*wanted, block("blocks").alias("x"), block("blocks").alias("y"), F.lit(1).alias("side"))
    links = lambda rows: block_links(rows, every_pair)
    return outside.union(rows).groupBy("bucket", "x", "y").applyInPandas(links, "a binary, b binary")


def mixed_buckets(linked: DataFrame, parts: DataFrame, tables: Tables) -> tuple[DataFrame, int]:
    """The rows of `linked` in buckets that hold several components, with `c`, `main`, `blocks` and `outer` as across() has them, and their number."""
    known = linked.select("bucket", "band", "key", "size").join(parts, "key")
    shares = known.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("n", "held", "c")).alias("x"), F.sum("n").alias("n"), F.sum("held").alias("held"))
    blocks = lambda n, held: F.greatest(F.ceil(n / BLOCK), F.ceil(held / BLOCK_SHINGLES), F.lit(1))
    mixed = mixed.filter(F.col("n") > F.col("x.n")).select(
        "bucket", F.col("x.c").alias("main"), blocks(F.col("n"), F.col("held")).alias("blocks"),
        blocks(F.col("n") - F.col("x.n"), F.col("held") - F.col("x.held")).alias("outer"), "n",
    )
    mixed, found = tables.write(mixed)
    return tables.write(known.join(mixed, "bucket")) if found else (known, 0)


def _parts(reps: DataFrame, shingled: DataFrame, tables: Tables) -> DataFrame | None:
    """(key, c): the component of every text that shares a bucket. None if there are no such texts. `shingled`: row, shingles."""
    bands = _bands(reps.filter("sketch IS NOT NULL"))
    shared, n = tables.write(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    if not n:
        return None
    linked, _ = tables.write(bands.join(shared, "bucket").select("bucket", "band", "key", "size", "n"))
    central, _ = tables.write(linked.groupBy("key").agg(F.sum("n").alias("met")))
    wanted = reps.select("row", "key", "sketch").join(central, "key", "left_semi")
    texts, _ = tables.write(shingled.join(wanted, "row").select("key", "sketch", "shingles"))

    leaders = linked.join(central, "key").groupBy("bucket").agg(F.max(F.struct("met", "key", "size")).alias("x"))
    leaders, _ = tables.write(leaders.select("bucket", F.col("x.key").alias("leader"), F.col("x.size").alias("leader_size")))
    star = linked.join(leaders, "bucket").filter("key <> leader")
    star = star.filter(F.least("size", "leader_size") >= SIMILAR * F.greatest("size", "leader_size"))
    star = star.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    parts = tables.write(central.select("key", F.col("key").alias("c")))[0]
    parts = relabel(parts, align(star, texts.select("key", "shingles")), tables)

    for every_pair in (False, True):
        members, n = mixed_buckets(linked, parts, tables)
        if not n:
            break
        if not every_pair:
            largest = members.groupBy("key").agg(F.max(F.struct("n", "bucket")).alias("x")).select("key", "x.bucket")
            members = members.join(tables.write(largest)[0], ["key", "bucket"], "left_semi")
        links = across(members.join(texts, "key"), every_pair)
        parts = relabel(parts, links, tables)
    return parts


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, n_rows, kept) for every distinct (id, text) with a text; n_rows is the number of such rows.

    Aggregates that hot keys are joined with are written out first: both sides of the join then come from a shuffle, and Spark
    splits the hot key among tasks.
    """
    with Tables(docs.sparkSession, "near_dedup") as tables:
        found, _ = tables.write(sketches(docs))
        held = found.groupBy("doc_id", F.col("text_key").alias("key")).agg(F.count("*").alias("n_rows"), F.min("row").alias("row"))
        held, _ = tables.write(held)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
        ids = held.groupBy("key").agg(least.alias("least"), F.min("row").alias("row"))
        reps, _ = tables.write(ids.join(found.select("row", "sketch", "size"), "row"))
        parts = _parts(reps, found.select("row", "shingles"), tables)
        if parts is None:
            parts = reps.select("key", F.col("key").alias("c"))
        known = reps.select("key", "least").join(parts, "key", "left").select("key", "least", F.coalesce("c", "key").alias("c"))
        named = known.groupBy("c").agg(F.min(F.struct(F.col("least.none"), F.col("least.doc_id"), "key")).alias("first"))
        named = known.select("key", "c").join(tables.write(named)[0], "c").select("key", "first")
        rows = held.join(tables.write(named)[0], "key")
        kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
        return settle(rows.select("doc_id", F.col("key").alias("text_key"), F.col("first.doc_id").alias("class_id"), "n_rows", kept.alias("kept")))


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """`docs` joined with `found` by id and text; `found` keeps its other columns under its own names."""
    own, key, mine = (fresh(c, [*docs.columns, *found.columns]) for c in ("found_id", "found_key", "own_key"))
    found = found.withColumnsRenamed({"doc_id": own, "text_key": key})
    docs = docs.withColumn(mine, text_key(F.col("text")))  # a column of its own, so that the text need not move with it
    return docs.join(found, docs["doc_id"].eqNullSafe(found[own]) & (docs[mine] == found[key]), how).drop(own, key, mine)


def with_classes(docs: DataFrame) -> DataFrame:
    """`docs` with `class_id`, `n_rows` (rows of that id and text) and `kept` added, renamed where `docs` has them."""
    names = {c: fresh(c, docs.columns) for c in ("class_id", "n_rows", "kept")}
    none = fresh("no_text", [*docs.columns, *names.values()])
    joined = _matched(docs.withColumn(none, F.col("text").isNull()), classes(docs).withColumnsRenamed(names), "left")
    joined = joined.withColumn(names["class_id"], F.when(F.col(none), F.col("doc_id")).otherwise(F.col(names["class_id"])))
    return joined.withColumn(names["kept"], F.when(F.col(none), F.lit(True)).otherwise(F.col(names["kept"]))).drop(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of rows equal in id and text, one. Rows without a text stay."""
    found = classes(docs)
    repeated = found.filter("kept AND n_rows > 1").select("doc_id", "text_key")
    going = found.filter("NOT kept").select("doc_id", "text_key").union(repeated)
    content = fresh("content", docs.columns)
    again = _matched(docs, repeated, "left_semi").withColumn(content, F.sha2("text", 256)).dropDuplicates(["doc_id", content]).drop(content)
    return _matched(docs, going, "left_anti").union(again)
