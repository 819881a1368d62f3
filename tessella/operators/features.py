"""Feature families as row expressions: demographic, product and channel, recency-frequency-monetary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import roles
from tessella.functions.stats import quantile_values, row_sum

PREFERENCES = [f"{c}_Preference" for c in ("Wine", "Fruit", "Meat", "Fish", "Sweet", "Gold")]
#: Ties of the dominant product go to the first of these.
DOMINANCE = ["Wine", "Meat", "Fish", "Fruit", "Sweet", "Gold"]


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; 0 where b is 0 or either is null."""
    column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.try_divide(column(a).cast("double"), column(b).cast("double")), F.lit(0.0))


def age(year: int = roles.FEATURE_YEAR) -> Column:
    return F.when(F.col("Year_Birth").isNotNull(), F.least(F.lit(year) - F.col("Year_Birth"), F.lit(roles.MOST_AGE)))


def children() -> Column:
    return F.col("Kidhome") + F.col("Teenhome")


def income_per_member() -> Column:
    return F.col("Income") / (2 + F.col("TotalChildren"))


def marital_score_of(c: str, weights: dict[str, int]) -> Column:
    """The weight of a category; without one it counts 0."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col(c)], F.lit(0))


def life_stage() -> Column:
    """0 to 4; where several rules hold, the later one in the reference order wins, so the tests run in reverse."""
    kids, years = F.col("TotalChildren") > 0, F.col("Age")
    return (
        F.when(kids & (F.col("Marital_Encoded") == 0), 4)
        .when(years >= 60, 3)
        .when((years >= 45) & (years < 60) & kids, 2)
        .when((years < 45) & kids & (F.col("Marital_Encoded") > 0), 1)
        .otherwise(0)
    )


def dependency() -> Column:
    """Children against income per member."""
    return F.col("TotalChildren") * 10000.0 / (F.col("Income_per_Family_Member") + 1e-6)


def dependency_cut(df: DataFrame) -> float | None:
    """The exact 99th percentile of dependency() over rows with demographic columns."""
    return quantile_values(df.withColumn("_ratio", dependency()), ["_ratio"], [0.99])["_ratio", 0.99]


def demographic(df: DataFrame, marital_weight: dict[str, int], order: list[str], cut: float | None = None) -> DataFrame:
    """df with the demographic features; needs Education and Marital_Status as categories. The dependency ratio is cut at `cut`, or at
    the 99th percentile of these rows."""
    from tessella.operators.clean import ordinal

    roles.assert_columns(df, ["Year_Birth", "Kidhome", "Teenhome", "Income", "Marital_Status", "Education"])
    df = df.withColumn("Age", age()).withColumn("TotalChildren", children())
    df = df.withColumn("Income_per_Family_Member", income_per_member())
    df = df.withColumn("Marital_Encoded", marital_score_of("Marital_Status", marital_weight)).withColumn("Life_Stage", life_stage())
    most = F.lit(dependency_cut(df) if cut is None else cut).cast("double")
    return df.withColumn("Dependency_Ratio", F.when(dependency().isNotNull(), F.least(dependency(), most))).withColumn("Education_ord", ordinal("Education", order))


def hhi() -> Column:
    """Concentration of spending: the sum of squared shares."""
    return sum((F.pow(F.greatest(F.col(p), F.lit(0.0)), 2) for p in PREFERENCES[1:]), F.pow(F.greatest(F.col(PREFERENCES[0]), F.lit(0.0)), 2))


def dominant_product() -> tuple[Column, Column]:
    """(name, share) of the largest share; the first on ties."""
    shares = F.array(*[F.col(f"{n}_Preference") for n in DOMINANCE])
    names = F.array(*[F.lit(f"{n}_Preference") for n in DOMINANCE])
    name = F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int"))
    return F.regexp_replace(name, "_Preference$", ""), F.array_max(shares)


def product_channel(df: DataFrame) -> DataFrame:
    roles.assert_columns(df, [*roles.SPENDING, *roles.CHANNELS, "NumWebVisitsMonth"])
    df = df.withColumns({"Total_Spent": row_sum(roles.SPENDING), "TotalPurchases": row_sum(roles.CHANNELS)})
    df = df.withColumns({p: ratio(c, "Total_Spent") for p, c in zip(PREFERENCES, roles.SPENDING)})
    name, share = dominant_product()
    return df.withColumns({
        "Product_HHI": hhi(), "Dominant_Product": name, "Top_Product_Share": share,
        "Store_Preference": ratio("NumStorePurchases", "TotalPurchases"), "Web_Engagement": F.col("NumWebVisitsMonth"),
    })


def rfm(df: DataFrame) -> DataFrame:
    roles.assert_columns(df, [*roles.SPENDING, *roles.CHANNELS, "Kidhome", "Teenhome", "Income"])
    df = df.withColumns({"Total_Spent": row_sum(roles.SPENDING), "TotalPurchases": row_sum(roles.CHANNELS), "TotalChildren": children()})
    return df.withColumns({"AvgPerPurchase": ratio("Total_Spent", "TotalPurchases"), "Income_per_Family_Member": income_per_member()})


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
