"""Types of the columns of raw delimited files, found over all rows, and rows that do not fit kept apart.

Types form a chain: logical or whole, then decimal, then text. A column has the narrowest type that its values have, missing ones left out; whole
numbers with missing values are decimal, logical values with missing ones are text. With a tolerance, a type only needs all but that
share of the values; rows with one of the rest go to quarantine with the column's name, as do rows of the wrong number of fields. Every line is either
kept or in quarantine. Blank lines are none. An empty file has text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
DECIMAL = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI]nf(inity)?)[ \t]*$"
LOGICAL = ["True", "TRUE", "true", "False", "FALSE", "false"]
TYPES = {"bool": "boolean", "int64": "bigint", "float64": "double", "object": "string"}


def raw_rows(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All fields as text, and `_line`: the whole line where the number of fields is wrong."""
    names = spark.read.csv(path, sep=sep, header=True).columns  # reads the header
    schema = ", ".join(f"`{n}` string" for n in names) + ", _line string"
    # without pruning: a line of the wrong number of fields shows only if all of it is parsed
    reader = spark.read.option("columnPruning", False)
    return reader.csv(path, sep=sep, header=True, schema=schema, columnNameOfCorruptRecord="_line", enforceSchema=True, nullValue="\u0000", emptyValue="")


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).isin(MISSING)


def _fits(c: str, kind: str) -> Column:
    whole = F.col(c).rlike(WHOLE) & F.trim(F.col(c)).try_cast("bigint").isNotNull()
    return {"bool": F.col(c).isin(LOGICAL), "int64": whole, "float64": F.col(c).rlike(DECIMAL), "object": F.lit(True)}[kind]


def types(rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(column, type, n, n_missing, n_bool, n_int64, n_float64): one aggregate over all rows of the right number of fields."""
    columns = [c for c in rows.columns if c != "_line"]
    good = rows.filter("_line IS NULL")
    asked = []
    for i, c in enumerate(columns):
        here = ~_missing(c)
        asked += [F.count(F.lit(1)).alias(f"n{i}"), F.count_if(~here).alias(f"m{i}"), *[F.count_if(here & _fits(c, k)).alias(f"{k}{i}") for k in ("bool", "int64", "float64")]]
    wide = good.agg(*asked)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("n_missing"), *[F.col(f"{k}{i}").alias(f"n_{k}") for k in ("bool", "int64", "float64")]) for i, c in enumerate(columns)]
    each = wide.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    values = F.col("n") - F.col("n_missing")
    enough = lambda k: (F.col(f"n_{k}") > 0) & (F.col(f"n_{k}") >= values * (1 - tolerance))
    full = F.col("n_missing") == 0
    # a column that is all missing is decimal, as an empty number would be
    empty = (values == 0) & (F.col("n") > 0)
    kind = F.when(enough("bool") & full, "bool").when(enough("int64") & full, "int64").when(enough("float64") | empty, "float64").otherwise("object")
    return each.select("column", kind.alias("type"), "n", "n_missing", "n_bool", "n_int64", "n_float64")


def typed(rows: DataFrame, found: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the found types, quarantine): quarantine has (line, reason), the first column that does not fit or the number of fields."""
    columns = list(found)
    wrong = [F.when(~_missing(c) & ~_fits(c, k), F.lit(c)) for c, k in found.items()]
    reason = F.when(F.col("_line").isNotNull(), F.lit("number of fields")).otherwise(F.coalesce(*wrong) if wrong else F.lit(None))
    judged = rows.withColumn("_reason", reason)
    value = lambda c, k: F.when(~_missing(c), F.col(c).isin(LOGICAL[:3]) if k == "bool" else F.col(c) if k == "object" else F.trim(F.col(c)).try_cast(TYPES[k]))
    kept = judged.filter("_reason IS NULL").select(*[value(c, k).alias(c) for c, k in found.items()])
    line = F.coalesce("_line", F.to_json(F.struct(*columns)))
    return kept, judged.filter("_reason IS NOT NULL").select(line.alias("line"), F.col("_reason").alias("reason"))


def read(spark: SparkSession, path: str, sep: str = "\t", tolerance: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, types) of a delimited file with a header."""
    rows = raw_rows(spark, path, sep)
    found = types(rows, tolerance)
    kinds = {r["column"]: r["type"] for r in found.collect()}  # one for each column
    ordered = {c: kinds[c] for c in rows.columns if c != "_line"}
    return *typed(rows, ordered), found

