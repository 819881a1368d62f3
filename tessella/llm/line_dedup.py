"""Removal of boilerplate lines: lines that stand on many distinct sites.

Each line of a document sends (line hash, site); a HyperLogLog sketch of the sites grows for every line hash and merges by
aggregation, map side first. A sketch whose estimate lies within its error of the threshold decides nothing: those lines get an
exact distinct count of their sites. A boilerplate line stays in the one document of least id that has it and goes everywhere
else. The texts are read three times: for the sketches, for the places of lines that may be boilerplate, and for the result.

Lines are split at newlines and compared without the white space at their ends, by a 64-bit hash. Lines of fewer than
`min_words` words are never boilerplate; 1, the default, looks at every line that has a word. The lines that may be boilerplate
are broadcast only if they are at most `BROADCAST_ROWS`, counted beforehand; beyond that the join shuffles, from written tables
on both sides, so that Spark splits a line that is everywhere.

Nulls and edges: a null text has no lines and stays null; a null site is a site of its own, unlike the empty one; rows with a
null id are counted but keep all their lines; rows that repeat an id are one document as to who keeps a line. A text whose
lines all go becomes empty, its row stays. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import GAP, WORD, Tables, fresh, once, settle

MIN_SITES = 5
MIN_WORDS = 1
LOG2_REGISTERS = 8
BROADCAST_ROWS = 500_000


def _hash(line):
    return F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _candidate(min_words: int):
    """Whether a line has at least `min_words` words."""
    pattern = rf"{WORD}(?:{GAP}{WORD}){{{min_words - 1}}}"
    return lambda line: line.rlike(pattern)


def _key(text):
    return F.md5(F.coalesce(text, F.lit("")))


def line_sites(docs: DataFrame, site: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, site, at, line): place and hash of every candidate line of every row. A site begins with "=", no site is empty."""
    hashes = F.transform(_lines("text"), lambda x: F.when(_candidate(min_words)(x), _hash(x)))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{site}`").cast("string")), F.lit(""))
    rows = docs.select("doc_id", _key(F.col("text")).alias("text_key"), named.alias("site"), once(hashes).alias("lines"))
    return rows.select("doc_id", "text_key", "site", F.posexplode("lines").alias("at", "line")).filter("line IS NOT NULL")


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def boilerplate(lines: DataFrame, tables: Tables, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text_key, at, line, keeper) of the boilerplate among `lines`, in all documents; keeper is the document that keeps the line."""
    slack = max(1, math.ceil(3 * 1.04 / math.sqrt(2**LOG2_REGISTERS) * min_sites))
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG2_REGISTERS)).alias("about"), F.min("doc_id").alias("keeper")
    )
    spread, n = tables.write(spread.filter(F.col("about") >= min_sites - slack))
    found, _ = tables.write(lines.join(_sized(spread, n), "line"))
    sure = F.col("about") > min_sites + slack
    exact = found.filter(~sure).select("line", "site").distinct().groupBy(F.col("line").alias("counted")).agg(F.count("*").alias("sites"))
    exact, n = tables.write(exact.filter(F.col("sites") >= min_sites))
    all_ = found.join(_sized(exact, n), F.col("line") == F.col("counted"), "left").filter(sure | F.col("counted").isNotNull())
    return all_.select("doc_id", "text_key", "at", "line", "keeper")


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: bool = False
) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`; with `counts`, also n_lines and n_removed."""
    key, own, gone, n_all, left, places = (fresh(c, docs.columns) for c in ("own_key", "going_id", "going", "lines_all", "lines_left", "places"))
    with Tables(docs.sparkSession, "line_dedup") as tables:
        found = boilerplate(line_sites(docs, site, min_words), tables, min_sites)
        going = found.filter(F.col("doc_id") != F.col("keeper")).groupBy("doc_id", "text_key").agg(F.collect_list("at"))
        going = settle(going.toDF(own, key + "_", gone))
    joined = docs.withColumn(key, _key(F.col("text")))
    joined = joined.join(going, (joined["doc_id"] == going[own]) & (joined[key] == going[key + "_"]), "left")
    joined = joined.withColumn(n_all, once(_lines("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(n_all) - 1), F.col(gone))
    joined = joined.withColumn(places, once(F.when(F.col(gone).isNotNull(), stay)))
    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), F.size(n_all)).otherwise(F.size(places)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col(n_all), i)), "\n"))
    kept = [(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns]
    if counts:
        kept += [F.size(n_all).cast("long").alias("n_lines"), (F.size(n_all) - F.col(left)).cast("long").alias("n_removed")]
    return joined.select(*kept)


def with_length(docs: DataFrame, name: str = "n_chars") -> DataFrame:
    """`docs` with the column `name`, if it has one, set to the number of characters of `text`."""
    if name not in docs.columns:
        return docs
    length = F.length("text").cast(docs.schema[name].dataType)
    return docs.select(*[length.alias(c) if c == name else F.col(f"`{c}`") for c in docs.columns])
