"""The driver's tables, and the customer behaviour table built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {
    "ECONOMY": "MntWines", "LARGE": "MntFruits", "MEDIUM": "MntMeatProducts", "PROMO": "MntFishProducts",
    "SMALL": "MntSweetProducts", "STANDARD": "MntGoldProds",
}
PRIORITIES = {
    "1-URGENT": "NumWebPurchases", "2-HIGH": "NumCatalogPurchases", "3-MEDIUM": "NumStorePurchases",
    "4-NOT SPECIFIED": "NumDealsPurchases", "5-LOW": "NumWebVisitsMonth",
}
LAST_DAY = "2001-08-02"


def amount() -> Column:
    """What a line costs after discount, in 1/10000: whole numbers, so that sums do not depend on their order."""
    return F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))


def money(total: str) -> Column:
    """A sum of amounts, rounded to cents."""
    return F.floor((F.col(total) + 50) / 100) / 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency in days, number of orders and money spent of every customer with orders.

    Lineitem is summed up by order before it meets orders, so the join and both aggregates share the order key, and only one
    row for each order moves to its customer.
    """
    spent = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(amount()).alias("spent"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        orders.join(spent, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.date_diff(F.lit(LAST_DAY).cast("date"), F.max("o_orderdate").cast("date")).cast("long").alias("recency_days"),
            F.count("*").alias("frequency"),
            F.sum("spent").alias("spent"),
        )
        .select("c_custkey", "recency_days", "frequency", money("spent").alias("monetary"))
    )


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: the raw table's columns, nulls in Income included. Amounts are rounded to cents.

    Some rows break each cleaning rule: births of 1890 and 2010, incomes beyond 600,000, a rare category.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    by_order = lines.groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("p_type") == k, amount())).alias(v) for k, v in TYPES.items()])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    by_customer = (
        orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.date_format(F.min(day), "dd-MM-yyyy").alias("Dt_Customer"),
            F.date_diff(F.lit(LAST_DAY).cast("date"), F.max(day)).cast("long").alias("Recency"),
            *[F.sum(v).alias(v) for v in TYPES.values()],
            *[F.count_if(F.col("o_orderpriority") == k).alias(v) for k, v in PRIORITIES.items()],
        )
    )
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("c_custkey")
    flag = lambda c: c.cast("int").cast("long")
    return customers.join(by_customer, key == F.col("o_custkey"), "left").select(
        key.alias("ID"),
        F.when(key % 499 == 0, 1890).when(key % 397 == 0, 2010).otherwise(1996 - key * 37 % 60).cast("long").alias("Year_Birth"),
        F.col("r_name").alias("Education"),
        F.when(key % 149 == 0, "ALONE").otherwise(F.col("c_mktsegment")).alias("Marital_Status"),
        F.when(key % 93 != 0, F.when(key % 211 == 0, 600_000.0 + key).otherwise(F.col("c_acctbal"))).alias("Income"),
        (key % 3).alias("Kidhome"),
        (F.floor(key / 3) % 2).cast("long").alias("Teenhome"),
        "Dt_Customer",
        "Recency",
        *[F.coalesce(money(v), F.lit(0.0)).alias(v) for v in TYPES.values()],
        *[F.coalesce(v, F.lit(0)).alias(v) for v in PRIORITIES.values()],
        *[flag(key % 7 == i).alias(f"AcceptedCmp{i}") for i in range(1, 6)],
        flag(key % 50 == 0).alias("Complain"),
        flag(key % 6 == 0).alias("Response"),
        F.lit(3).cast("long").alias("Z_CostContact"),
        F.lit(11).cast("long").alias("Z_Revenue"),
    )


def raw_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """behaviour() with duplicates: some rows twice, and some again under a new ID. The base is computed once."""
    base, key = behaviour(spark, sf_dir), F.col("ID")
    ids = F.array_compact(F.array(key, F.when(key % 50 == 0, key), F.when(key % 20 == 0, key + 10_000_000)))
    return base.withColumn("ID", F.explode(ids)).select(*base.columns)
