"""Distinct values, duplicates and most frequent values of tables of any width, without a row for each column and without wide keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.io import settle

#: Values that a task holds before it merges or sends them, and characters beyond which a value is told by its SHA-256.
HELD, LONG = 100_000, 64
#: Counters of a task's sketch of frequent values, and candidates that are counted exactly at most.
COUNTERS, CANDIDATES = 4096, 10_000


def _plain(df: DataFrame, c: str) -> Column:
    """A column as a type that Arrow can tell values of apart."""
    kind = df.schema[c].dataType.simpleString()
    return F.to_json(F.col(c)) if kind.startswith(("array", "struct", "map")) else F.hex(F.col(c)) if kind == "binary" else F.col(c)


def _counted(values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(distinct values, how often each occurs); -0.0 is 0.0."""
    if pa.types.is_floating(values.type):
        values = pc.add(values, 0.0)
    found = pc.value_counts(values)
    return found.field("values"), found.field("counts")


def _named(values: pa.Array) -> pa.Array:
    """Values as strings of bounded length."""
    out = pc.cast(values, pa.string())
    if (pc.max(pc.utf8_length(out)).as_py() or 0) > LONG:
        out = pa.array([v if v is None or len(v) <= LONG else hashlib.sha256(v.encode()).hexdigest() + str(len(v)) for v in out.to_pylist()], pa.string())
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of every value of every column, values as strings, or as digests if they are long; null is a value.

    Tasks count the values of their batches by column and merge them, so that a value leaves a task once. The key is short.
    """
    schema = pa.schema([("i", pa.int32()), ("value", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by(["i", "value"]).aggregate([("n", "sum")])
            return pa.table([table.column("i"), table.column("value"), table.column("n_sum")], schema=schema)

        for batch in batches:
            for i, column in enumerate(batch.columns):
                values, n = _counted(column)
                held.append(pa.table([pa.array([i] * len(values), pa.int32()), _named(values), n], schema=schema))
                size += len(values)
            if size > HELD:
                held = [merged()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                    held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(max_chunksize=50_000)

    counted = df.select(*[_plain(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "i int, value string, n long")
    names = F.array(*[F.lit(c) for c in columns])
    return counted.groupBy("i", "value").agg(F.sum("n").alias("n")).select(names[F.col("i")].alias("column"), "value", "n")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct, n_missing, n_rows) of each column, exact; an empty table has a row of zeros for each."""
    found = value_counts(df, columns).groupBy("column").agg(
        F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.sum("n").alias("n_rows")
    )
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(found, "column", "left").na.fill(0)


def digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the values of `columns`, 32 bytes: equal for equal rows, null being equal to null and 0.0 to -0.0."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shown = lambda c: (F.col(c) + F.lit(0.0).cast(fields[c]) if fields[c] in ("double", "float") else _plain(df, c)).cast("string")
    return F.unhex(F.sha2(F.to_json(F.array(*map(shown, columns)), {"ignoreNullFields": "false"}), 256))


def duplicates(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(name, surplus, in_groups, n_groups) for each set of columns: rows beyond the first of groups of equal rows, rows in groups of two or
    more, such groups. All sets share one pass and one exchange, in which a group of rows is one digest for each task."""
    digests = F.array(*[F.struct(F.lit(name).alias("name"), digest(df, columns).alias("digest")) for name, columns in sets.items()])
    n = F.col("n")
    sized = df.select(F.explode(digests).alias("x")).groupBy("x.name", "x.digest").agg(F.count(F.lit(1)).alias("n"))
    found = sized.groupBy("name").agg(F.sum(n - 1).alias("surplus"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("in_groups"), F.count_if(n > 1).alias("n_groups"))
    return df.sparkSession.createDataFrame([(name,) for name in sets], "name string").join(found, "name", "left").na.fill(0)


def _sketch(df: DataFrame, c: str, counters: int) -> DataFrame:
    """(value, n, lost) of the frequent values of each task: n is at most the task's `lost` too low, which a row of its own holds; one more
    row has the number of nulls."""
    kind = df.schema[c].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost, nulls = None, 0, 0
        for batch in batches:
            column = batch.column(0)
            nulls += column.null_count
            values, n = _counted(column.drop_null())
            table = pa.table({"value": values, "n": n})
            if held is not None:
                merged = pa.concat_tables([held, table]).group_by("value").aggregate([("n", "sum")])
                table = pa.table({"value": merged.column("value"), "n": merged.column("n_sum")})
            if table.num_rows > counters:
                n = table.column("n").to_numpy()
                cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                lost += cut
                table = table.filter(pa.array(n > cut))
                table = table.set_column(1, "n", pc.subtract(table.column("n"), pa.scalar(cut, pa.int64())))
            held = table
        if held is None:
            return
        of = held.column("value").type
        held = held.combine_chunks()
        out = [pa.table({"value": held.column("value"), "n": held.column("n"), "lost": pa.array([0] * held.num_rows, pa.int64())}), pa.table({"value": pa.array([None], of), "n": pa.array([nulls]), "lost": pa.array([lost])})]
        yield from pa.concat_tables(out).combine_chunks().to_batches(max_chunksize=50_000)

    found = df.select(c).mapInArrow(run, f"value {kind}, n long, lost long")
    return found.groupBy("value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))


def top_values(df: DataFrame, c: str, n: int, counters: int = COUNTERS) -> tuple[DataFrame, int, bool]:
    """((value, n) of the n most frequent values, ties by value, exactly; number of rows with a null; whether there are more values).

    Tasks keep a bounded number of counters; what a counter may have missed is bounded by what the sketches have lost together. If the
    n-th best counter exceeds that bound, no other value can be among the n best, and only candidates near it are counted, in a second
    pass. Where the bound decides nothing, as in columns of mostly distinct values, all values are counted.
    """
    sketch = settle(_sketch(df, c, counters))
    facts = sketch.agg(F.sum("lost").alias("lost"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("values")).first()
    lost, nulls, more = facts["lost"] or 0, facts["nulls"] or 0, facts["values"] > n or (facts["lost"] or 0) > 0
    known = sketch.filter("value IS NOT NULL").select("value", "n").orderBy(F.desc("n"), "value")
    if not lost:
        return known.limit(n), nulls, more
    best = known.limit(CANDIDATES + 1).collect()
    least = best[n - 1]["n"] if len(best) >= n else 0
    near = [r["value"] for r in best if r["n"] + lost >= least]
    if least > lost and len(near) <= CANDIDATES:
        kind = df.schema[c].dataType
        listed = df.sparkSession.createDataFrame([(v,) for v in near], f"value {kind.simpleString()}")
        rows = df.select(F.col(c).alias("value")).join(F.broadcast(listed), "value")  # CANDIDATES rows at most
    else:
        rows = df.select(F.col(c).alias("value")).filter("value IS NOT NULL")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n), nulls, more
