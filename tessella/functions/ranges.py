"""Running totals over any sortable key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.io import settle


def running_totals(df: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """(keys, value, cum): the total of `value` over all rows up to each row, in the order of the keys and then of the value; nulls first.

    Equal rows are counted first, so that a key which many rows share is one row; the rest is dealt into ranges of about as many rows by
    sampled splitters and sorted within them. Ranges are summed, one number each, and every task adds up its own range from the total of those
    before it. Keys of any sortable type, with gaps and repeats; a null value counts 0. An empty table stays empty.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.select(*keys, F.col(value).cast("double").alias(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counted.repartitionByRange(ranges, *keys, value).sortWithinPartitions(*keys, value).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt)
    sums = {r["_range"]: r["s"] for r in dealt.groupBy("_range").agg(F.sum(F.coalesce(value, F.lit(0.0)) * F.col("_n")).alias("s")).collect()}  # one for each range
    before, total = {}, 0.0
    for at in sorted(sums):
        before[at], total = total, total + sums[at]
    place = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = None
        for batch in batches:
            if batch.num_rows:
                if reached is None:
                    reached = before[batch.column("_range")[0].as_py()]
                x = batch.column(place).fill_null(0.0).to_numpy() * batch.column("_n").to_numpy()
                ends = reached + np.cumsum(x)
                reached = float(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[: place + 2], pa.array(ends)], names=[*batch.schema.names[: place + 2], "_end"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[: place + 1])
    # a range stays a partition, in its order
    ends = dealt.mapInArrow(run, f"{kinds}, _n long, _end double")
    copies = ends.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return copies.select(*keys, value, (F.col("_end") - F.col("_copy") * F.coalesce(value, F.lit(0.0))).alias("cum"))
