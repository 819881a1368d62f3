"""What the corpus operators share: the word definition, table access and checkpointing."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.sources.io import scratch, settle, shared

__all__ = ["GAP", "SHINGLE", "SIMILAR", "SPACES", "WORD", "Tables", "common", "fresh", "n_words", "once", "remove", "scratch", "settle", "table", "windows", "words", "written"]

#: White space between words: space and the ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Words in a shingle, and the least similarity of near duplicates.
SHINGLE = 5
SIMILAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def once(value: Column) -> Column:
    """`value`, marked so that the optimizer computes it once a row.

    An array column that a lambda reads is otherwise copied into that lambda, as when a filter moves below it, and then
    computed anew for every element. An expression with a row number is never copied; the condition always holds.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def windows(ws: str, size: int = SHINGLE) -> Column:
    """A 64-bit hash for every window of `size` words of the array column `ws`, in text order; fewer words give an empty array.

    `ws` must come from once().
    """
    places = F.sequence(F.lit(0), F.greatest(F.size(ws) - size, F.lit(0)))
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(F.size(ws) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores in front until no column in `taken` has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def common(spark: SparkSession) -> str:
    """The folder that sessions have in common: the one that holds the session's own."""
    return shared(spark).rsplit("/", 1)[0]


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


class Tables:
    """Intermediate tables in the shared folder, which go when the block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.names = spark, scratch(spark, name), {}, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.root)

    def write(self, df: DataFrame, **options) -> tuple[DataFrame, int]:
        """`df` written as Parquet, with the writer's `options`, and read again, which cuts the lineage; and its number of rows, counted in the same job."""
        path, seen = f"{self.root}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**options).parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        return written, int(seen.get["n"])

    def buckets(self, df: DataFrame, n: int, key: str, **options) -> tuple[DataFrame, int]:
        """Like write(), in `n` buckets by `key`: grouping what is read by `key` moves no row. Rows of a bucket had best be in one task already."""
        name, seen = f"bucketed_{uuid.uuid4().hex}", Observation()
        path = f"{self.root}/{name}"
        self.names.append(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(n, key).options(**options).option("path", path).format("parquet").saveAsTable(name)
        written = self.spark.table(name)
        self.paths[id(written)] = path
        return written, int(seen.get["n"])

    def drop(self, written: DataFrame) -> None:
        """Delete a table before the block ends."""
        remove(self.spark, self.paths.pop(id(written)))

    def release(self) -> None:
        """Let Spark drop the shuffle files of finished jobs, which it does when their plans are collected as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
