"""Cleaning and encoding. "First" always means the least key: Spark rows have no order of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import roles
from tessella.operators.log import Log, step
from tessella.sources.io import settle

#: Rare categories that are broadcast.
FEW_CATEGORIES = 100_000


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def dedupe(df: DataFrame, key: str = roles.ID) -> DataFrame:
    """One row for each set of features, that of the least key; rows equal in all columns count once.

    A grouped minimum, so that copies are merged before the shuffle and a set that many rows share lands nowhere whole.
    """
    features = [c for c in df.columns if c != key]
    return df.groupBy(*features).agg(F.min(key).alias(key)).select(*df.columns)


def outlier_mask() -> Column:
    """True where a row is removed; a null value never removes its row."""
    return F.coalesce(F.col("Income") >= roles.SUSPICIOUS_INCOME, F.lit(False)) | F.coalesce(F.col("Year_Birth") < roles.OLDEST_BIRTH, F.lit(False))


def remove_outliers(df: DataFrame) -> DataFrame:
    return df.filter(~outlier_mask())


def removed_records(df: DataFrame) -> DataFrame:
    """The removed rows with the reason; a row that breaks both rules is listed twice."""
    reasons = F.array_compact(F.array(
        F.when(F.col("Income") >= roles.SUSPICIOUS_INCOME, F.lit("suspicious income")),
        F.when(F.col("Year_Birth") < roles.OLDEST_BIRTH, F.lit("too old")),
    ))
    return df.select("ID", "Year_Birth", "Income", F.explode(reasons).alias("reason"))


def remap(df: DataFrame, c: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[c])


def remap_counts(df: DataFrame, c: str, mapping: dict[str, str]) -> DataFrame:
    """How many rows each entry of the mapping changes."""
    counts = df.agg(*[F.count_if(F.col(c) == old).alias(f"_{i}") for i, old in enumerate(mapping)])
    rows = [F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.col(f"_{i}").alias("n")) for i, (o, n) in enumerate(mapping.items())]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def parse_date(df: DataFrame, c: str = "Dt_Customer", pattern: str = "dd-MM-yyyy", strict: bool = True) -> DataFrame:
    """A date from text; a malformed one raises, or gives null if not `strict`."""
    return df.withColumn(c, F.to_timestamp(c, pattern) if strict else F.try_to_timestamp(F.col(c), F.lit(pattern)))


def ordinal(c: str, order: list[str]) -> Column:
    """Place of a category in `order`, from 0; null for anything else."""
    return (F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)) - 1).cast("int")


def rare_levels(df: DataFrame, c: str, threshold: float = roles.RARE) -> DataFrame:
    """(category): the categories of a smaller share of all rows than `threshold`."""
    counts = df.groupBy(F.col(c).alias("category")).agg(F.count("*").alias("_n"))
    all_ = counts.agg(F.sum("_n").alias("_all"))
    return counts.crossJoin(F.broadcast(all_)).filter((F.col("_n") / F.col("_all") < threshold) & F.col("category").isNotNull()).select("category")


def group_rare(df: DataFrame, c: str, threshold: float = roles.RARE, other: str = "Other") -> DataFrame:
    """Categories of a smaller share of all rows than `threshold` become `other`.

    The rare ones are counted first and broadcast if they are few, so that the rows need no exchange.
    """
    rare = settle(rare_levels(df, c, threshold).withColumnRenamed("category", "_category"))
    rare = F.broadcast(rare) if rare.count() <= FEW_CATEGORIES else rare
    joined = df.join(rare, F.col(c) == F.col("_category"), "left")
    return joined.withColumn(c, F.when(F.col("_category").isNotNull(), F.lit(other)).otherwise(F.col(c))).drop("_category")


def levels(df: DataFrame, c: str) -> list[str]:
    """The categories of a column, sorted: they become columns, so they must be known before the plan is built."""
    return [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).collect()]


def one_hot(df: DataFrame, c: str, prefix: str = "Marital_", threshold: float = roles.RARE, drop: bool = False) -> DataFrame:
    """One 0/1 column for each category, in alphabetical order; a null row has zeros; a clashing name gets `_enc`."""
    grouped = group_rare(df, c, threshold)
    name = lambda v: f"{prefix}{v}" + "_enc" * (f"{prefix}{v}" in df.columns)
    out = grouped.withColumns({name(v): F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for v in levels(grouped, c)})
    return out.drop(c) if drop else out


def binary_columns(df: DataFrame) -> DataFrame:
    """(column, is_binary) for every integer column: no value but 0 and 1."""
    ints = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint")]
    found = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False)).alias(c) for c in ints])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("is_binary")) for c in ints])).alias("r")).select("r.*")


def as_binary(c: str) -> Column:
    """0/1 of a column of any type: 1 only for 1 and true."""
    return F.when(F.col(c).cast("string").isin("1", "1.0", "true"), 1).otherwise(0).cast("tinyint")


def archive(df: DataFrame) -> DataFrame:
    """The columns that cleaning drops but later mapping may want."""
    return df.select(*[c for c in [roles.ID, *roles.BINARY, "Education", "Marital_Status"] if c in df.columns])


def drop_columns(df: DataFrame) -> DataFrame:
    return df.drop(*roles.DROPPED)


def clean(
    df: DataFrame, marital_map: dict = roles.MARITAL_MAP, order: list[str] = roles.EDUCATION_ORDER, threshold: float = roles.RARE, key: str | None = None,
    log: Log | None = None,
) -> DataFrame:
    """The whole cleaning in order: missing, duplicates, outliers, categories, types and encodings, drop, second dedupe.

    Rows that become equal only by remapping or by the drop of the key go in the last step. With `key`, that column is kept
    and the last dedupe keeps its least value. A `log` counts the rows of each step in the jobs that compute them.
    """
    roles.assert_columns(df, [roles.ID, "Income", "Year_Birth", "Education", "Marital_Status", "Dt_Customer"])
    df = step(log, df, "load")
    df = step(log, drop_missing(df), "drop rows with missing values")
    df = step(log, dedupe(df), "drop duplicate features")
    df = step(log, remove_outliers(df), "remove outliers")
    # what remains is read three times: for shares, for levels and for the result
    df = settle(parse_date(remap(df, "Marital_Status", marital_map)))
    df = df.withColumn("Education_ord", ordinal("Education", order))
    df = step(log, one_hot(df, "Marital_Status", threshold=threshold), "encode categories")
    if key:
        return step(log, dedupe(df.drop(*[c for c in roles.DROPPED if c != key]), key), "drop columns and duplicate rows")
    return step(log, drop_columns(df).distinct(), "drop columns and duplicate rows")


def category_changes(before: DataFrame, after: DataFrame, c: str) -> DataFrame:
    """Counts of each category before and after; 0 where it is absent."""
    one = before.groupBy(F.col(c).alias("category")).agg(F.count("*").alias("n_before"))
    two = after.groupBy(F.col(c).alias("category")).agg(F.count("*").alias("n_after"))
    both = one.join(two, "category", "full_outer")
    return both.select("category", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_before", "n_after")])


def category_sets(before: DataFrame, after: DataFrame, c: str) -> DataFrame:
    """Each category with the side it is on: before, after or both."""
    side = F.when(F.col("n_after") == 0, "before").when(F.col("n_before") == 0, "after").otherwise("both")
    return category_changes(before, after, c).select("category", side.alias("side"))
