"""Mixes sources to target weights: each source is cut at its exact budget of words, after whole epochs where needed.

Every document gets a hash-random key. Keys are spread evenly, so ranges of equal width of the key hold equal shares of a source,
however large: documents are sorted within (source, range), the ranges' word totals are summed up before each range, and both
together are the prefix sums of a source in key order. No task holds a whole source. Rows that are equal in id, source and text
are counted before they are sorted, and stand side by side.

Sources are few against documents, `MOST_SOURCES` at most, which is checked; only their totals are put in one order, in one
task. They are sorted by code point, null last, and weigh 5, 2, 1 repeating. A target is the source's share of all words by
weight, three times its own words at most; what is cut off is shared again by weight among the rest until none is above.

Nulls and edges: a null text has size 0; a null source is a source of its own; null ids take part like others. Rows that are
equal in id, source and text are interchangeable: which of them takes how much is undefined, what they take together is not. A
source without words has target 0. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh, n_words, settle

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows of a source to a key range, on average.
RANGE_ROWS = 5_000
SEED = "mix-1"
MOST_SOURCES = 1_000_000
#: Equal rows that one task writes out.
COPIES = 10_000


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with `target`: words to take. One row for each source.

    The level at which a source stops growing with its weight is most * size / weight. With sources in the order of their
    levels, the first that does not reach its level when all below have stopped gives the common words per unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    below = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0)),
            "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
        }
    )
    stops = F.col("rest") * F.col("weight") >= F.col("cap") * F.col("rest_weight")
    rows = rows.withColumn("first", F.min(F.when(~stops, F.struct("level", "rest", "rest_weight"))).over(everything))
    share = F.col("first")["rest"] * F.col("weight") / F.col("first")["rest_weight"]
    target = F.when(F.col("first").isNull() | stops, F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def _text_key(text):
    return F.md5(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken, copy, copies) for every row of `docs`.

    `copy` numbers the `copies` rows that are equal in id, source and text from 0.
    """
    rows = docs.select("doc_id", "source", _text_key(F.col("text")).alias("text_key"), n_words(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("copies"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text_key"))
    rows = settle(rows.withColumn("key", key))
    n, sources, copies = rows.agg(F.count("*"), F.approx_count_distinct("source"), F.max("copies")).first()
    if sources > MOST_SOURCES:
        raise ValueError(f"about {sources} sources; targets are for {MOST_SOURCES} at most")
    ranges = max(1, min(1 << 20, -(-n // RANGE_ROWS)))
    unit = F.conv(F.substring("key", 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))
    rows = rows.withColumn("range", F.floor(unit * ranges).cast("long")).withColumn("total", F.col("size") * F.col("copies"))

    parts = rows.groupBy("source", "range").agg(F.sum("total").alias("part_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    plan = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
    plan = plan.withColumnRenamed("source", "t_source")
    parts = parts.withColumnsRenamed({"source": "p_source", "range": "p_range"})
    parts = parts.join(plan, F.col("p_source").eqNullSafe(F.col("t_source"))).drop("t_source", "part_size")
    joined = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("start", F.col("offset") + F.coalesce(F.sum("total").over(within), F.lit(0)))
    if (copies or 1) > 1:
        joined = joined.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
        if copies > COPIES:
            joined = joined.repartition("doc_id", "text_key", "block")
        first = F.col("block") * COPIES
        joined = joined.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)))
    else:
        joined = joined.withColumn("copy", F.lit(0).cast("long"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("start") - F.col("copy") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"), "copy", "copies")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The documents that the mix takes, with `size`, `source_size`, `target` and `taken` added (renamed where `docs` has them)."""
    added = {c: fresh(c, docs.columns) for c in ("size", "source_size", "target", "taken")}
    taken_names = [*docs.columns, *added.values()]
    mine = {c: fresh(f"mix_{c}", taken_names) for c in ("doc_id", "source", "text_key", "copy")}
    own, number = fresh("own_key", taken_names), fresh("own_copy", taken_names)
    plan = settle(mix(docs, weights, most).withColumnsRenamed(added | mine))
    used = plan.filter(F.col(added["taken"]) > 0)
    keyed = docs.withColumn(own, _text_key(F.col("text")))
    match = lambda df, plan: (
        df["doc_id"].eqNullSafe(plan[mine["doc_id"]]) & df["source"].eqNullSafe(plan[mine["source"]]) & (df[own] == plan[mine["text_key"]])
    )
    once = used.filter("copies = 1").drop("copies")
    out = keyed.join(once, match(keyed, once)).drop(own, *mine.values())
    again = used.filter("copies > 1").drop("copies")
    if again.isEmpty():
        return out
    alike = keyed.join(again.select(*[mine[c] for c in ("doc_id", "source", "text_key")]).distinct(), match(keyed, again), "left_semi")
    order = Window.partitionBy("doc_id", "source", own).orderBy(F.lit(0))
    alike = alike.withColumn(number, F.row_number().over(order).cast("long") - 1)
    return out.union(alike.join(again, match(alike, again) & (alike[number] == again[mine["copy"]])).drop(own, number, *mine.values()))
