"""Finds short test items inside long documents: MinHash containment search, then exact shingle containment.

Items are partitioned by their number of shingles; each partition has its own sketch size, a fixed share of its upper bound
and all shingles for the smallest. A sketch is the least hash values of the item. Because a document is far larger than an
item, only the item is sampled: the share of its sketch that the document has estimates its containment, whatever the
document's size. Documents whose estimate is not clearly too low are candidates, and for these the share of all the item's
shingles in the document is counted.

The items' shingles, and the candidates, are broadcast only if they are at most `BROADCAST_ROWS` rows, counted beforehand;
beyond that the join shuffles. Shingles are five words; an item of fewer words is one shingle of its own length, and documents
get shingles of that length too.

Nulls and edges: a document is an id with a text, and so is an item: rows of one id, or of none, but with different texts are
judged each by itself, and rows equal in both are one. A null or empty text has no shingles and never matches. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SHINGLE, SIMILAR, fresh, once, settle, windows, words

#: Upper bound of a size partition -> sketch size. Larger items take the last.
SKETCH = {16: 16, 64: 24, 256: 32, 1 << 30: 64}
#: A document is a candidate from this share of the threshold on, as estimated from the sketch.
SLACK = 0.5
BROADCAST_ROWS = 1_000_000


def _lengths(items: DataFrame) -> list[int]:
    """The shingle lengths in use: five, and the number of words of items that have fewer. Five values at most."""
    n = F.least(F.size(words(F.col("text"))), F.lit(SHINGLE))
    return sorted(r[0] for r in items.select(n.alias("n")).filter("n > 0").distinct().collect())


def _shingles(ws: str, lengths: list[int]) -> Column:
    """All distinct shingles of the given lengths of the words in `ws`."""
    return F.array_distinct(F.concat(*[windows(ws, k) for k in lengths]))


def _key(text: Column) -> Column:
    """A 128-bit digest of the text, which tells rows of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, item_key, shingle, in_sketch, n_sketch, n_shingles): every distinct shingle of every item, marked where the sketch has it."""
    rows = items.select("item_id", _key(F.col("text")).alias("item_key"), once(words(F.col("text"))).alias("ws"))
    # an item of fewer words than a shingle is one shingle of all its words
    own = F.when(F.size("ws") >= SHINGLE, _shingles("ws", [SHINGLE]))
    for k in range(1, SHINGLE):
        own = own.when(F.size("ws") == k, windows("ws", k))
    rows = rows.select("item_id", "item_key", once(F.array_sort(own)).alias("shingles")).filter(F.size("shingles") > 0)
    rows = rows.groupBy("item_id", "item_key").agg(F.first("shingles").alias("shingles"))
    size = F.size("shingles")
    k = F.lit(None)
    for bound, sketch in reversed(SKETCH.items()):
        k = F.when(size <= bound, F.lit(sketch)).otherwise(k)
    rows = rows.select("item_id", "item_key", "shingles", size.cast("long").alias("n_shingles"), F.least(k, size).cast("long").alias("n_sketch"))
    exploded = rows.select("item_id", "item_key", "n_shingles", "n_sketch", F.posexplode("shingles").alias("at", "shingle"))
    return exploded.select("item_id", "item_key", "shingle", (F.col("at") < F.col("n_sketch")).alias("in_sketch"), "n_sketch", "n_shingles")


def document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, doc_key, shingle) for every distinct shingle of every row of `docs` (doc_id, doc_key, text)."""
    rows = docs.select("doc_id", "doc_key", once(words(F.col("text"))).alias("ws"))
    found = rows.select("doc_id", "doc_key", F.explode_outer(once(_shingles("ws", lengths))).alias("shingle"))
    return found.filter("shingle IS NOT NULL")


def _contained(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key, n_found, n_shingles) for every item contained in a document to `threshold` or more."""
    wanted = settle(item_shingles(items.select("item_id", "text")))
    lengths = _lengths(items) or [SHINGLE]
    sized = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df
    docs = docs.select("doc_id", _key(F.col("text")).alias("doc_key"), "text")
    names = ["doc_id", "doc_key", "item_id", "item_key"]

    sketch = wanted.filter("in_sketch").select("item_id", "item_key", "shingle", "n_sketch")
    candidates = document_shingles(docs, lengths).join(sized(sketch), "shingle").groupBy(*names, "n_sketch")
    candidates = candidates.agg(F.count_distinct("shingle").alias("n")).filter(F.col("n") >= threshold * SLACK * F.col("n_sketch"))
    candidates = settle(candidates.select(*[F.col(c).alias(f"cand_{c}") for c in names]))
    picked = F.broadcast if candidates.count() <= BROADCAST_ROWS else lambda df: df
    same = lambda df, columns: [df[c].eqNullSafe(F.col(f"cand_{c}")) for c in columns]
    ids = candidates.select("cand_doc_id", "cand_doc_key").distinct()
    texts = docs.join(picked(ids), same(docs, names[:2]), "left_semi")
    whole = wanted.select("item_id", "item_key", "shingle", "n_shingles")
    counted = document_shingles(texts, lengths).join(sized(whole), "shingle").groupBy(*names, "n_shingles")
    counted = counted.agg(F.count_distinct("shingle").alias("n_found"))
    exact = counted.join(picked(candidates), same(counted, names), "left_semi").filter(F.col("n_found") >= threshold * F.col("n_shingles"))
    return exact.select(*names, "n_found", "n_shingles")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, n_found, n_shingles, containment) for every item contained in a document to `threshold` or more."""
    found = _contained(docs, items, threshold)
    return found.select("doc_id", "item_id", "n_found", "n_shingles", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    own, leak_id, leak_key = (fresh(c, docs.columns) for c in ("own_key", "leak_id", "leak_key"))
    leaks = _contained(docs, items, threshold).select(F.col("doc_id").alias(leak_id), F.col("doc_key").alias(leak_key)).distinct()
    docs = docs.withColumn(own, _key(F.col("text")))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks[leak_id]) & (docs[own] == leaks[leak_key]), "left_anti").drop(own)
