"""Profiling: missing values, duplicates, categories, contextual outlier rules, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import roles
from tessella.functions.stats import quantiles, tall, unpivot
from tessella.functions.values import digest, distinct_counts, duplicates, top_values
from tessella.sources.io import settle


def others(df: DataFrame, key: str = roles.ID) -> list[str]:
    return [c for c in df.columns if c != key]


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct) for every column, from one aggregate."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns])
    return counts.select("_n", F.explode(rows).alias("r")).select(
        "r.column", "r.n_missing", F.round(F.try_divide(100.0 * F.col("r.n_missing"), F.col("_n")), 2).alias("pct")
    )


def rows_with_missing(df: DataFrame) -> DataFrame:
    any_null = F.greatest(*[F.col(c).isNull().cast("int") for c in df.columns]) if len(df.columns) > 1 else F.col(df.columns[0]).isNull().cast("int")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(any_null), F.lit(0)).cast("long").alias("n_with_missing"))


def groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows grouped by all of `columns` with their number; null equals null."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def duplicate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """surplus: rows beyond the first of each group; in_groups: rows in groups of two or more."""
    return duplicates(df, {"rows": columns}).select("surplus", "in_groups", "n_groups")


def duplicate_groups(df: DataFrame, columns: list[str], key: str = roles.ID) -> DataFrame:
    """The members of groups of rows equal in `columns`, one row for each: (n, first_key, member). A group of any size is never one
    row, and what moves is a digest and a key for each row."""
    rows = settle(df.select(digest(df, columns).alias("_digest"), F.col(key).alias("member")))
    found = rows.groupBy("_digest").agg(F.count("*").alias("n"), F.min("member").alias("first_key")).filter("n > 1")
    return rows.join(found, "_digest").select("n", "first_key", "member")


def duplicate_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """group size -> number of groups and rows."""
    sized = df.select(digest(df, columns).alias("_digest")).groupBy("_digest").agg(F.count("*").alias("n")).filter("n > 1")
    return sized.groupBy("n").agg(F.count("*").alias("n_groups")).withColumn("n_rows", F.col("n") * F.col("n_groups"))


def duplicate_keys(df: DataFrame, key: str = roles.ID) -> DataFrame:
    return groups(df, [key]).filter("n > 1")


def _surplus(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """One row with the surplus of each set of columns, from one pass."""
    return duplicates(df, sets).agg(*[F.max(F.when(F.col("name") == n, F.col("surplus"))).alias(n) for n in sets])


def hidden_duplicates(df: DataFrame, key: str = roles.ID) -> DataFrame:
    """Rows that repeat another's features under another key."""
    found = _surplus(df, {"full_row": df.columns, "features": others(df, key)})
    return found.withColumn("hidden", F.col("features") - F.col("full_row"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """All rows of groups of two or more, sorted by all columns, with the group's size. Digests find them; only these rows are grouped
    and move whole."""
    columns, df = df.columns, settle(df.withColumn("_digest", digest(df, df.columns)))
    again = df.groupBy("_digest").agg(F.count("*").alias("n")).filter("n > 1").select("_digest")
    df = df.join(again, "_digest", "left_semi").select(*columns)
    sized = groups(df, columns).filter("n > 1")
    return sized.select(*columns, "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).orderBy(*columns, "copy")


def frequencies(df: DataFrame, c: str, all_up_to: int = 15, top: int = 10) -> DataFrame:
    """Counts and shares of the non-null values: all if there are few, else the most frequent. Shares are of all rows."""
    first, _, more = top_values(df, c, max(all_up_to, top))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "value"))  # of a few rows
    shown = first.withColumn("rank", rank).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    shown = shown.filter(F.col("rank") <= (top if more else all_up_to))
    return shown.select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column and the class of their ratio to the rows."""
    counts = distinct_counts(df, columns).select("column", "n_distinct", "n_rows")
    ratio = F.try_divide(F.col("n_distinct"), F.col("n_rows"))
    kind = F.when(ratio > 0.9, "HIGH").when(ratio > 0.5, "MEDIUM").when(ratio > 0.1, "LOW").when(F.col("n_distinct") == 1, "CONSTANT").otherwise("CATEGORICAL")
    return counts.withColumn("class", kind)


def basic_info(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(len(df.columns) - len(text)).cast("long").alias("n_other"), F.lit(len(text)).cast("long").alias("n_text")
    )


def column_info(df: DataFrame) -> DataFrame:
    """(column, type, n_missing, n_distinct) of every column."""
    kind = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])[F.col("column")]
    return distinct_counts(df, df.columns).select("column", kind.alias("type"), "n_missing", "n_distinct")


def outlier_bounds(df: DataFrame, columns: list[str], floor: bool = True, factor: float = roles.IQR_FACTOR) -> DataFrame:
    """q1, q3 and bounds of each column; with `floor`, the lower bound is at least 0."""
    at = quantiles(df, columns, [0.25, 0.75])
    q = tall(df, columns, {"q1": lambda c: at(c, 0.25), "q3": lambda c: at(c, 0.75)}, "column")
    low = F.col("q1") - factor * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.greatest(low, F.lit(0.0)) if floor else low, "high": F.col("q3") + factor * (F.col("q3") - F.col("q1"))})


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds of each column and how many values lie strictly outside. Two aggregates for all columns together."""
    values = unpivot(df, columns, "column").filter("value IS NOT NULL").join(F.broadcast(outlier_bounds(df, columns)), "column")
    return values.groupBy("column", "q1", "q3", "low", "high").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < F.col("low")).alias("n_low"), F.count_if(F.col("value") > F.col("high")).alias("n_high")
    )


def largest_outliers(df: DataFrame, c: str, key: str = roles.ID, n: int = 3) -> DataFrame:
    """The n largest values above the upper bound, ties by key."""
    bounds = outlier_bounds(df, [c]).select("high")
    return df.crossJoin(F.broadcast(bounds)).filter(F.col(c) > F.col("high")).select(key, c).orderBy(F.desc(c), key).limit(n)


def not_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each column are neither 0 nor 1."""
    return tall(df, columns, {"n": F.count, "n_outliers": lambda c: F.count_if(~F.col(c).isin(0, 1))}, "column")


def income_outliers(df: DataFrame, c: str = "Income", suspicious: float = roles.SUSPICIOUS_INCOME) -> DataFrame:
    """iqr_outliers of an income column with the number of suspicious values and the distinct ones, sorted."""
    odd = df.agg(F.count_if(F.col(c) >= suspicious).alias("n_suspicious"), F.array_sort(F.collect_set(F.when(F.col(c) >= suspicious, F.col(c)))).alias("suspicious"))
    return iqr_outliers(df, [c]).crossJoin(F.broadcast(odd))


def suspicious_values(df: DataFrame, c: str = "Income", suspicious: float = roles.SUSPICIOUS_INCOME) -> DataFrame:
    """(value, n) of the suspicious values, a row for each, however many they are."""
    return df.filter(F.col(c) >= suspicious).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))


def birth_year_outliers(df: DataFrame, c: str = "Year_Birth") -> DataFrame:
    old, young = F.col(c) < roles.OLDEST_BIRTH, F.col(c) > roles.YOUNGEST_BIRTH
    age = roles.REPORT_YEAR - F.col(c)
    return df.agg(
        F.count_if(old).alias("too_old"), F.count_if(young).alias("too_young"), F.count_if(old | young).alias("n_outliers"),
        F.min(age).alias("youngest_age"), F.max(age).alias("oldest_age"),
    )


def constants(df: DataFrame, columns: list[str]) -> DataFrame:
    least = tall(df, columns, {"value": F.min}, "column")
    found = distinct_counts(df, columns).select("column", "n_distinct").join(F.broadcast(least), "column")  # a row for each column
    return found.withColumn("is_constant", F.col("n_distinct") == 1)


def outlier_summary(df: DataFrame, column_roles: dict[str, str] = roles.ROLES) -> DataFrame:
    """(column, role, n_outliers) under each column's own rule; columns that are absent are skipped."""
    have = {c: r for c, r in column_roles.items() if c in df.columns}
    by = lambda *names: [c for c, r in have.items() if r in names]
    parts = [not_binary(df, by("binary")).select("column", "n_outliers")] if by("binary") else []
    if by("count", "spending", "income"):
        parts.append(iqr_outliers(df, by("count", "spending", "income")).select("column", (F.col("n_low") + F.col("n_high")).alias("n_outliers")))
    for c in by("special"):
        parts.append(birth_year_outliers(df, c).select(F.lit(c).alias("column"), "n_outliers"))
    if by("constant"):
        parts.append(constants(df, by("constant")).select("column", F.when(F.col("is_constant"), 0).otherwise(F.col("n_distinct") - 1).cast("long").alias("n_outliers")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    role = F.create_map(*[F.lit(x) for pair in have.items() for x in pair])[F.col("column")]
    return out.select("column", role.alias("role"), "n_outliers")


def extremes(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Scaled columns with values beyond +-limit: least, greatest, how many and what share."""
    found = tall(df, columns, {"least": F.min, "greatest": F.max, "n": F.count, "n_extreme": lambda c: F.count_if(F.abs(F.col(c)) > limit)})
    found = found.filter((F.abs("least") > limit) | (F.abs("greatest") > limit))
    return found.select("feature", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), "n_extreme", F.round(100.0 * F.col("n_extreme") / F.col("n"), 4).alias("pct"))


def validate_clean(df: DataFrame, irregular: list[str], category: str = "Marital_Status", date: str = "Dt_Customer") -> DataFrame:
    """After cleaning: nulls, irregular categories, the date's type; suspicious birth years and incomes are warnings."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    is_date = df.schema[date].dataType.simpleString() in ("timestamp", "date", "timestamp_ntz")
    row = df.agg(
        nulls.alias("n_missing"),
        F.count_if(F.col(category).isin(*irregular)).alias("n_irregular"),
        F.count_if(F.col("Year_Birth") < roles.OLDEST_BIRTH).alias("too_old"),
        F.count_if(F.col("Year_Birth") > roles.YOUNGEST_BIRTH).alias("too_young"),
        F.count_if(F.col("Income") >= roles.SUSPICIOUS_INCOME).alias("suspicious_income"),
    )
    return row.withColumns({"date_ok": F.lit(is_date), "all_passed": (F.col("n_missing") == 0) & (F.col("n_irregular") == 0) & F.lit(is_date)})


def validate_features(df: DataFrame, columns: list[str], low: float = 0.01) -> DataFrame:
    """Nulls, infinities and variance of each feature, with a flag for low variance."""
    found = tall(df, columns, {
        "n_missing": lambda c: F.count_if(F.col(c).isNull()),
        "n_infinite": lambda c: F.count_if(F.abs(F.col(c).cast("double")) == float("inf")),
        "variance": F.var_samp,
    })
    return found.withColumn("low_variance", F.coalesce(F.col("variance") < low, F.lit(False)))


def quality_summary(df: DataFrame, key: str = roles.ID) -> DataFrame:
    """One row: size, missing cells and their share, duplicates of rows, of features and of keys."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    size = df.agg(F.count("*").alias("n_rows"), cells.alias("missing_cells"))
    size = size.withColumn("missing_pct", F.round(F.try_divide(100.0 * F.col("missing_cells"), F.col("n_rows") * len(df.columns)), 2))
    found = _surplus(df, {"full_row": df.columns, "features": others(df, key), "duplicate_keys": [key]})
    found = found.select("full_row", "features", (F.col("features") - F.col("full_row")).alias("hidden"), "duplicate_keys")
    return size.crossJoin(F.broadcast(found))
